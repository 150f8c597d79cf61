"""Training windows come from all of a long text."""

from versionlink.llm import secrets


def test_windows_of_whole_texts(spark):
    spans = "".join(f"line {k} of the file\ntoken = abcdefghijk{k:05d}\n" for k in range(400))
    assert len(secrets.base_spans(spans)) == 400
    docs = spark.createDataFrame([(k, spans) for k in range(30)], "doc_id long, text string")
    made = secrets.windows(docs)
    rows = [tuple(map(str, r)) for r in made.collect()]
    assert len(rows) <= 30 * (2 * secrets.PER_TEXT + 1)
    places = [at for k in range(30) for at in secrets._sampled(secrets.np.arange(0, 4000, 10), k, len(spans))]
    assert len(places) == 90 and min(places) < 1000 and max(places) > 3000
    assert sum(at > 2000 for at in places) > 20
    assert secrets._sampled(secrets.np.array([4, 9]), 1, 50) == [4, 9]
    assert rows == [tuple(map(str, r)) for r in made.collect()]
