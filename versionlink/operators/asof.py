"""As-of joins over an order that spans many files and tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from versionlink.session import settle

# Rows of one range part, which a single task sorts.
PART_ROWS = 2_000_000


def _fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last mark at or before each row of a sorted partition."""
    carried = None
    for batch in batches:
        marks = batch.column("__mark")
        if not len(marks):
            continue
        known = pa.concat_arrays([pa.nulls(1, marks.type) if carried is None else carried, marks])
        at = np.arange(1, len(marks) + 1)
        at[~marks.is_valid().to_numpy(zero_copy_only=False)] = 0
        seen = known.take(pa.array(np.maximum.accumulate(at)))
        carried = seen.slice(len(marks) - 1)
        yield pa.RecordBatch.from_arrays([batch.column("__part"), batch.column("__row"), seen], names=["__part", "__row", "__seen"])


def asof_backward(rows: DataFrame, marks: DataFrame, order: list[str], value: list[str]) -> DataFrame:
    """Attach to each row the ``value`` columns of the nearest mark at or before it.

    ``order`` columns are in both tables; rows before the first mark get nulls.
    Rows and marks are range partitioned together by the order, filled inside
    each partition without another shuffle, and the last mark of each partition is carried on, so no
    task sees the whole order.
    """
    at = [F.col(c).alias(f"__at{k}") for k, c in enumerate(order)]
    left = rows.select(F.struct(*rows.columns).alias("__row"), *at)
    right = marks.select(F.struct(*value).alias("__mark"), *at)
    both = left.unionByName(right, allowMissingColumns=True)
    places = [f"__at{k}" for k in range(len(order))]
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(least, -(-both.count() // PART_ROWS))
    # A mark at the place of a row counts for the row; of several marks at one place the largest counts.
    parts = both.repartitionByRange(wanted, *places).sortWithinPartitions(*places, F.col("__row").isNotNull(), "__mark")
    # The sampled ranges are fixed here: both steps of the fill must see the same parts.
    parts = settle(parts.select("__row", "__mark")).withColumn("__part", F.spark_partition_id())
    schema = parts.select("__part", "__row", F.col("__mark").alias("__seen")).schema
    filled = parts.select("__part", "__row", "__mark").mapInArrow(_fill, schema).where(F.col("__row").isNotNull())
    last = parts.select("__part", "__mark", F.monotonically_increasing_id().alias("__n")).groupBy("__part").agg(
        F.max_by("__mark", F.when(F.col("__mark").isNotNull(), F.col("__n"))).alias("__last"))
    # one row a part
    across = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = last.select("__part", F.last("__last", ignorenulls=True).over(across).alias("__earlier"))
    filled = filled.join(F.broadcast(earlier), "__part").withColumn("__seen", F.coalesce("__seen", "__earlier"))
    return filled.select("__row.*", "__seen.*")


def asof_inside(rows: DataFrame, spans: DataFrame, point: str, lo: str, hi: str, value: list[str]) -> DataFrame:
    """The span with the greatest start at or before the point, kept only if the
    point lies before its end (half-open)."""
    kept = list(dict.fromkeys([*value, lo, hi]))
    marks = spans.withColumn("__point", F.col(lo))
    found = asof_backward(rows.withColumn("__point", F.col(point)), marks, ["__point"], kept)
    return found.where((F.col(point) >= F.col(lo)) & (F.col(point) < F.col(hi))).drop("__point")
