"""Positions of rows inside groups that may be very large."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from versionlink.session import settle

# Rows of one group that a single task may sort; larger groups are ranked over many tasks.
TASK_ROWS = 2_000_000


def positions(df: DataFrame, group: list[str], order: list[str], name: str = "position",
              largest: int | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """Add the 1-based position of every row in its group.

    ``order`` must be a total order inside a group. When the ``largest`` group
    (counted here unless given) has up to ``task_rows`` rows, one window does
    it. Otherwise rows are range partitioned by (group, order), numbered inside
    each partition, and shifted by the rows that earlier partitions hold of the
    same group.
    """
    if largest is None:
        largest = df.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    if largest <= task_rows:
        window = Window.partitionBy(*group).orderBy(*order)
        return df.withColumn(name, F.row_number().over(window))
    return _spread_positions(df, group, order, name)


def _spread_positions(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    ranged = df.repartitionByRange(*group, *order).withColumn("__part", F.spark_partition_id())
    local = Window.partitionBy("__part", *group).orderBy(*order)
    # The sampled ranges must not be drawn again, so the parts are fixed here.
    numbered = settle(ranged.withColumn("__local", F.row_number().over(local)))
    parts = numbered.groupBy(*group, "__part").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    return (
        numbered.join(parts, [*group, "__part"])
        .withColumn(name, (F.col("__local") + F.col("__before")).cast("bigint"))
        .drop("__part", "__local", "__before")
    )


def average_rank(value: str, group: list[str]):
    """Average rank of ``value`` in its group (ties share the mean position)."""
    by_value = Window.partitionBy(*group).orderBy(value)
    ties = Window.partitionBy(*group, value)
    return F.rank().over(by_value) + (F.count("*").over(ties) - 1) / 2.0


def positions_from_both_ends(df: DataFrame, group: list[str], order: list[str], up: str, down: str, count: str,
                             largest: int | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """Positions from the first and from the last row of a group, and the group size."""
    if largest is None or largest > task_rows:
        largest = df.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    if largest <= task_rows:
        window = Window.partitionBy(*group)
        ranked = df.withColumn(up, F.row_number().over(window.orderBy(*order)).cast("bigint")).withColumn(
            count, F.count("*").over(window)
        )
    else:
        sizes = df.groupBy(*group).agg(F.count("*").alias(count))
        ranked = positions(df, group, order, up, largest, task_rows).join(sizes, group)
    return ranked.withColumn(down, F.col(count) - F.col(up) + 1)
