"""Links by several methods form no pairs of equal functions."""

from versionlink.queries import graph

SCHEMA = "p_partkey long, p_name string, p_type string, p_brand string, p_size int"


def test_equal_functions_form_no_pairs(spark, tmp_path):
    rows = [(k, "n", "t", "b", 1) for k in range(40)] + [(40, "m", "t", "b", 1), (43, "m", "t", "c", 2)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/part.parquet")
    links = graph.link_methods(spark, str(tmp_path))
    assert sorted(map(tuple, links.collect())) == [(k, 1, "exact") for k in range(0, 40, 2)]
    # the new rows of each join are one a key: two aggregates there, two of the partners, one of the methods
    assert links._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 5
