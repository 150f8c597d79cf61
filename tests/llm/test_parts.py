"""Parts of a large benchmark are scanned and written one after the other."""

import random

from test_decontamination import prose

from versionlink.llm import decontamination as d


def test_part_written_before_the_next(spark, monkeypatch):
    rng = random.Random(6)
    items = [(k, prose(rng, 40)) for k in range(8)]
    docs = spark.createDataFrame([(k, "see " + t) for k, t in items] + [(50, prose(rng, 50))], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    steps = []
    index, stored = d.index, d.stored
    monkeypatch.setattr(d, "PART_BYTES", 900)
    monkeypatch.setattr(d, "index", lambda rows: steps.append("index") or index(rows))
    monkeypatch.setattr(d, "stored", lambda df: steps.append("stored") or stored(df))
    assert {(r.doc_id, r.item_id) for r in d.leaks(docs, bench).collect()} == {(k, k) for k in range(8)}
    assert [r.doc_id for r in d.without_leaks(docs, bench).collect()] == [50]
    assert len(steps) > 4 and steps == ["index", "stored"] * (len(steps) // 2)
