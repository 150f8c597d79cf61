"""Joins of two versions inside blocks, for blocks of any size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from versionlink.session import settle

# Rows of a side of one block that meet in one tile.
TILE_ROWS = 20_000


def block_join(old: DataFrame, new: DataFrame, block: list[str], tile_rows: int = TILE_ROWS,
               partitions: int | None = None) -> DataFrame:
    """Equi-join on ``block`` with both sides of big blocks cut into tiles.

    A block is a grid of tiles of up to ``tile_rows`` rows of each side, and every row goes
    to the tiles of its band, so no task meets more than a tile's pairs. Blocks that fit have
    one tile. ``partitions`` fixes the number of tasks where few rows make many pairs.
    """
    def parts(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy(*block).agg(F.ceil(F.count("*") / tile_rows).cast("int").alias(name))

    grid = parts(old, "__rows").join(parts(new, "__columns"), block)

    def band(side: DataFrame, count: str) -> Column:
        payload = [F.col(c) for c in side.columns if c not in block]
        return F.pmod(F.xxhash64(*payload), F.col(count)).cast("int")

    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    spread_old = old.join(grid, block).withColumn("__row", band(old, "__rows")).withColumn("__column", every("__columns"))
    spread_new = new.join(grid, block).withColumn("__column", band(new, "__columns")).withColumn("__row", every("__rows"))
    spread_old, spread_new = (side.drop("__rows", "__columns") for side in (spread_old, spread_new))
    tile = [*block, "__row", "__column"]
    if partitions is not None:
        spread_old, spread_new = spread_old.repartition(partitions, *tile).hint("merge"), spread_new.repartition(partitions, *tile)
    # else no fixed number of partitions, so Spark can merge small ones and split those that are too large
    return spread_old.join(spread_new, tile).drop("__row", "__column")


def weighed_tiles(old: DataFrame, new: DataFrame, block: list[str], weight: str, task_work: int) -> tuple[DataFrame, int]:
    """Rows of both sides (``__old`` tells which) under each ``__tile`` they meet in, and the work over ``task_work``.

    As in :func:`block_join`, but bands are cut by the sum of ``weight``, so that a tile's
    work, the product of its sides' weights, is about ``task_work``. Columns of one side are null for the other.
    """
    side = math.isqrt(task_work)

    def parts(rows: DataFrame, name: str) -> DataFrame:
        bands = F.least(F.count("*"), F.ceil(F.sum(weight) / side)).cast("int")
        return rows.groupBy(*block).agg(F.greatest(bands, F.lit(1)).alias(name), F.sum(weight).cast("double").alias(f"{name}_weight"))

    # numbers of blocks are fixed by the checkpoint
    grid = settle(parts(old, "__rows").join(parts(new, "__columns"), block).withColumn("__block", F.monotonically_increasing_id()))
    work = grid.agg(F.sum(F.col("__rows_weight") * F.col("__columns_weight"))).first()[0] or 0.0
    grid = grid.drop("__rows_weight", "__columns_weight")
    sides = []
    for rows, own, other in ((old, "__rows", "__columns"), (new, "__columns", "__rows")):
        payload = [F.col(c) for c in rows.columns if c not in block]
        at = F.pmod(F.xxhash64(*payload), F.col(own)).cast("int")
        across = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        spread = rows.join(grid, block).withColumn("__at", at).withColumn("__across", across)
        row, column = ("__at", "__across") if own == "__rows" else ("__across", "__at")
        tile = F.struct(F.col("__block").alias("block"), F.col(row).alias("row"), F.col(column).alias("column"))
        kept = [c for c in rows.columns if c not in block and c != weight]
        sides.append(spread.select(tile.alias("__tile"), F.lit(rows is old).alias("__old"), *kept))
    return sides[0].unionByName(sides[1], allowMissingColumns=True), math.ceil(work / task_work)
