"""Where an unlinked line may land: intervals between linked lines.

``top`` is the largest line number (None when not known); it decides whether
paths need to be cut into segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from versionlink.operators.fill import neighbours, unlinked_between
from versionlink.operators.ranks import positions_from_both_ends

FIRST, LAST = 0, 2**63 - 1


def _links(src_map: DataFrame, s: str, link: Column) -> DataFrame:
    return src_map.select(
        F.col(f"{s}_path").alias("path"), F.col(f"{s}_line").alias("line"), link.alias("link")
    )


def _interval(src: DataFrame, s: str, o: str, src_map: DataFrame, room: int, top: int | None) -> DataFrame:
    extra = [c for c in src.columns if c not in ("path", "line")]
    to = F.struct(F.col(f"{o}_path").alias("path"), F.col(f"{o}_line").alias("line"))
    lines = unlinked_between(src, _links(src_map, s, to), top)
    path_prev = F.coalesce("prev.path", "next.path")
    path_next = F.coalesce("next.path", "prev.path")
    before = F.coalesce(F.col("prev.line"), F.lit(FIRST))
    after = F.coalesce(F.col("next.line"), F.lit(LAST))
    return lines.where((path_prev == path_next) & (before < after - room)).select(
        F.col("path").alias(f"{s}_path"), F.col("line").alias(f"{s}_line"), *extra,
        path_prev.alias(f"{o}_path"), before.alias(f"{o}_line_prev"), after.alias(f"{o}_line_next"),
    )


def tight_bounds(src: DataFrame, s: str, o: str, src_map: DataFrame, top: int | None = None) -> DataFrame:
    """Unlinked lines of side ``s`` between the other-side lines of the nearest links around them.

    A missing link leaves that end open. Lines whose two links lead to
    different paths, or leave no line between, are dropped.
    """
    return _interval(src, s, o, src_map, 1, top)


def ranked_bounds(src: DataFrame, s: str, o: str, src_map: DataFrame, top: int | None = None) -> DataFrame:
    """As :func:`tight_bounds` for any growing interval, with the position of equal lines in it."""
    lines = _interval(src, s, o, src_map, 0, top)
    group = [f"{s}_path", "code", f"{o}_line_prev"]
    return positions_from_both_ends(lines, group, [f"{s}_line"], "rank_inc", "rank_dec", "rank_count", top)


def loose_bounds(src: DataFrame, s: str, o: str, src_map: DataFrame, top: int | None = None) -> DataFrame:
    """Intervals from one link only: from the link before to the next linked
    other-side line, and from the previous linked other-side line to the link after."""
    extra = [c for c in src.columns if c not in ("path", "line")]
    around = neighbours(src_map, [f"{o}_path"], f"{o}_line", "__before", "__after", top)
    to = F.struct(
        F.col(f"{o}_path").alias("path"), F.col(f"{o}_line").alias("line"),
        F.coalesce("__before", F.lit(FIRST)).alias("before"), F.coalesce("__after", F.lit(LAST)).alias("after"),
    )
    lines = unlinked_between(src, _links(around, s, to), top)
    own = [F.col("path").alias(f"{s}_path"), F.col("line").alias(f"{s}_line"), *extra]
    one_sided = F.array(
        F.struct(F.col("prev.path").alias("path"), F.col("prev.line").alias("lo"), F.col("prev.after").alias("hi")),
        F.struct(F.col("next.path").alias("path"), F.col("next.before").alias("lo"), F.col("next.line").alias("hi")),
    )
    # both directions may give the same interval
    return lines.select(*own, F.explode(F.array_distinct(one_sided)).alias("__to")).where("__to.path is not null").select(
        f"{s}_path", f"{s}_line", *extra, F.col("__to.path").alias(f"{o}_path"),
        F.col("__to.lo").alias(f"{o}_line_prev"), F.col("__to.hi").alias(f"{o}_line_next"),
    )


def mutual_inside(pairs: DataFrame) -> DataFrame:
    """Pairs where each line lies strictly inside the other's interval."""
    inside = lambda s: (F.col(f"{s}_line") > F.col(f"{s}_line_prev")) & (F.col(f"{s}_line") < F.col(f"{s}_line_next"))
    return pairs.where(inside("old") & inside("new"))
