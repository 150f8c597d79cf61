"""Nearest anchor before and after each row of an ordered group.

A window over the whole group would put a huge file into one task. Groups
longer than one segment are cut into segments of consecutive order values;
anchors are filled inside a segment, and one row per segment carries them
across segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# log2 of the order values in one segment: at most 65,536 lines meet in a window.
SEGMENT_BITS = 16


def line_segment(order: str, top: int | None) -> Column | None:
    """Segment of a line number; None when lines up to ``top`` fit into one."""
    if top is not None and top >> SEGMENT_BITS == 0:
        return None
    return F.shiftright(F.col(order), SEGMENT_BITS)


def fill_anchors(df: DataFrame, group: list[str], order: str, anchor: str, segment: Column | None,
                 before: str | None = None, after: str | None = None) -> DataFrame:
    """Add ``before`` / ``after``: the last / first non-null ``anchor`` at or around each row.

    ``segment`` grows with ``order`` inside a group and has boundedly many rows;
    None stands for groups that are one segment.
    """
    keys = group
    if segment is not None:
        df = df.withColumn("__seg", segment)
        keys = [*group, "__seg"]
    inside = Window.partitionBy(*keys).orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    local = df
    if before:
        local = local.withColumn(before, F.last(anchor, ignorenulls=True).over(upto))
    if after:
        local = local.withColumn(after, F.first(anchor, ignorenulls=True).over(onward))
    if segment is None:
        return local
    across = Window.partitionBy(*group).orderBy("__seg")
    place = F.when(F.col(anchor).isNotNull(), F.col(order))
    segments = df.groupBy(*keys).agg(
        F.max_by(anchor, place).alias("__last"), F.min_by(anchor, place).alias("__first")
    ).select(
        *keys,
        F.last("__last", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("__earlier"),
        F.first("__first", ignorenulls=True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("__later"),
    )
    filled = local.join(segments, keys)
    if before:
        filled = filled.withColumn(before, F.coalesce(before, "__earlier"))
    if after:
        filled = filled.withColumn(after, F.coalesce(after, "__later"))
    return filled.drop("__seg", "__earlier", "__later")


def unlinked_between(src: DataFrame, links: DataFrame, top: int | None) -> DataFrame:
    """Lines of ``src`` without a link, with the nearest links around them.

    ``src`` has ``path, line`` and more; ``links`` has ``path, line`` and the
    struct ``link``. Adds ``prev`` and ``next`` (``link`` structs or null).
    ``top`` is the largest line number, or None when it is not known.
    """
    own = src.select("path", "line", F.struct(*src.columns).alias("__row"))
    at = links.select("path", "line", F.struct("line", "link").alias("__anchor"))
    both = own.unionByName(at, allowMissingColumns=True)
    # the link of a line comes before the line itself
    both = both.withColumn("__at", F.struct("line", F.col("__row").isNotNull()))
    filled = fill_anchors(both, ["path"], "__at", "__anchor", line_segment("line", top), "__prev", "__next")
    free = F.col("__prev.line").isNull() | (F.col("__prev.line") != F.col("line"))
    return filled.where(F.col("__row").isNotNull() & free).select(
        "__row.*", F.col("__prev.link").alias("prev"), F.col("__next.link").alias("next")
    )


def neighbours(df: DataFrame, group: list[str], order: str, before: str, after: str,
               top: int | None) -> DataFrame:
    """Add the previous and next ``order`` value of the group (null at its ends)."""
    segment = line_segment(order, top)
    if segment is None:
        window = Window.partitionBy(*group).orderBy(order)
        return df.withColumn(before, F.lag(order).over(window)).withColumn(after, F.lead(order).over(window))
    df = df.withColumn("__seg", segment)
    inside = Window.partitionBy(*group, "__seg").orderBy(order)
    across = Window.partitionBy(*group).orderBy("__seg")
    segments = df.groupBy(*group, "__seg").agg(F.min(order).alias("__min"), F.max(order).alias("__max"))
    segments = segments.select(
        *group, "__seg", F.lag("__max").over(across).alias("__earlier"), F.lead("__min").over(across).alias("__later")
    )
    local = df.withColumn(before, F.lag(order).over(inside)).withColumn(after, F.lead(order).over(inside))
    return (
        local.join(segments, [*group, "__seg"])
        .withColumn(before, F.coalesce(before, "__earlier"))
        .withColumn(after, F.coalesce(after, "__later"))
        .drop("__seg", "__earlier", "__later")
    )
