"""Point-in-interval joins without a nested loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Span lengths are rounded up to powers of 2^STEP, so a point has few cells.
STEP = 6


def contain_join(points: DataFrame, spans: DataFrame, keys: list[str],
                 point: str, lo: str, hi: str, top: int) -> DataFrame:
    """Inner join of points with the half-open spans [lo, hi) that hold them.

    A span goes to the one or two cells of the size step at or above its own
    length, a point to its cell of every size up to ``top`` (no point is
    larger), so the join is an equi-join that meets few rows outside the spans
    and a hot key is split by place. ``keys`` are further equal columns; without any, points go to
    the steps that some span has, as one cell of a large step holds all points. Values
    must not be negative.
    """
    levels = list(range(STEP, max(top, 1).bit_length() + STEP, STEP))
    end = F.least(F.col(hi), F.lit(top + 1))
    spans = spans.withColumn("__end", end).where(F.col(lo) < F.col("__end"))
    bits = F.length(F.bin(F.col("__end") - F.col(lo) - 1))
    spans = spans.withColumn("__level", (F.ceil(bits / STEP) * STEP).cast("int"))
    if not keys:
        levels = sorted(row[0] for row in spans.select("__level").distinct().collect())
        if not levels:
            spans, levels = spans.limit(0), [STEP]
    cell = lambda value: f"shiftright({value}, __level)"
    placed = spans.withColumn(
        "__cell", F.explode(F.expr(f"sequence({cell(f'`{lo}`')}, {cell('(__end - 1)')})"))
    ).drop("__end")
    spread = points.withColumn(
        "__level", F.explode(F.array(*[F.lit(level) for level in levels]))
    ).withColumn("__cell", F.expr(cell(f"`{point}`")))
    return (
        spread.join(placed, [*keys, "__level", "__cell"])
        .where((F.col(point) >= F.col(lo)) & (F.col(point) < F.col(hi)))
        .drop("__level", "__cell")
    )
