"""The pipeline's stages and its run against plain Python, on a small written table."""

import random
import zlib
from collections import Counter

import corpus_pipeline
import test_lines
import test_minhash
import test_sampling
from versionlink.llm.lines import _judge


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 8))) for _ in range(n)) + "."


def tables(spark, folder):
    rng = random.Random(8)
    items = [(k, prose(rng, 40)) for k in range(5)]
    rows = []
    for k in range(120):
        text = "\n".join(prose(rng, rng.randrange(12, 60)) for _ in range(rng.randrange(1, 4)))
        if k % 10 == 1:
            text += "\nHome | About | News"
        if k % 10 == 2:
            text = " ".join("&&" + w for w in text.split(" "))
        if k % 10 == 3 and k > 20:
            text = rows[k - 20][1]
        if k % 10 == 4:
            text += "\n" + rng.choice(items)[1]
        rows.append((k, text, "en", rng.choice(["a", "b", None]), len(text)))
    rows.append((500, None, None, None, None))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def test_pipeline(spark, tmp_path):
    folder = str(tmp_path)
    rows, items = tables(spark, folder)
    clean = []
    for k, text, _, source, _ in rows:
        if test_lines.brute(text)[-1]:
            clean.append((k, _judge([text.encode()])[1][0].decode(), source))
    kept = {k for k, _, _, stays in test_minhash.brute([c[:2] for c in clean], 80) if stays}
    single = [c for c in clean if c[0] in kept]
    pure = [c for c in single if not any(t.rstrip(".") in c[1] for _, t in items)]
    assert len(rows) > len(clean) > len(single) > len(pure) > 50
    taken = {k: n for k, _, _, n in test_sampling.plain([(k, s, len(t.split())) for k, t, s in pure])}
    want = [clean, single, pure, [c for c in pure for _ in range(taken[c[0]])]]

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for (name, stage), rest in zip(corpus_pipeline.STAGES, want):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        assert sorted((r.doc_id, r.text, r.source) for r in docs.collect()) == sorted(rest), name
        assert all(r.n_chars == len(r.text) for r in docs.collect())

    last = corpus_pipeline.run(spark, folder).collect()
    texts = Counter((k, len(t.encode()) + 1, zlib.crc32(t.encode())) for k, t, _ in want[-1])
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in last) == texts
    sizes = Counter()
    for r in last:
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) <= max(r.size for r in last)
    assert len(corpus_pipeline.STAGES) == 5


def test_empty(spark, tmp_path):
    folder = str(tmp_path)
    tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
