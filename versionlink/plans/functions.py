"""Links between the named functions of two versions.

Function tables have ``fid, func, namespace, basename, parameters, extension,
chunk, path, line``; a fid may have several rows (alias names). Link tables
have ``old_fid, old_func, new_fid, new_func``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from versionlink.functions.similarity import edit_similarity, edit_similarity_of_long
from versionlink.functions.text import file_name
from versionlink.operators.assign import retire
from versionlink.operators.ordered import Field, rounds_of_ordered_best
from versionlink.plans.paths import replace_with_path
from versionlink.session import empty_like, settle, union_all

NAME = "namespace+basename"


@dataclass(frozen=True)
class Level:
    """One blocking rule: rows meet on ``block`` and are ranked by ``score`` in order."""

    name: str
    block: tuple[str, ...]
    score: tuple[str, ...]
    profiled: bool = True  # old rows limited to profiled names
    same_cold: bool = True  # both or neither are cold parts

    def compared(self) -> list[str]:
        names = ["namespace", "basename"] if NAME in self.score else []
        names += [c for c in self.score if c not in (NAME, "len", "one")]
        if self.same_cold:
            names.append("extension")
        return [c for c in dict.fromkeys(names) if c not in self.block] + ["__len"] * ("len" in self.score)


TAIL = ("extension", "chunk", "len")
LEVELS = [
    Level("func", ("func",), ("one",), False, False),
    Level("all_parts", ("namespace", "basename", "parameters", "extension", "chunk"), ("len",), False, False),
    Level("up_to_extension", ("namespace", "basename", "parameters", "extension"), ("chunk", "len"), True, False),
    Level("up_to_parameters", ("namespace", "basename", "parameters"), TAIL),
    Level("path_namespace_basename", ("path", "namespace", "basename"), ("parameters", *TAIL)),
    Level("namespace_basename", ("namespace", "basename"), ("parameters", *TAIL)),
    Level("path_basename_parameters", ("path", "basename", "parameters"), ("namespace", *TAIL)),
    Level("basename_parameters", ("basename", "parameters"), ("namespace", *TAIL)),
]
# two routes from the same remaining rows; their links are ranked together afterwards
ROUTES = [
    [
        Level("path_basename", ("path", "basename"), ("namespace", "parameters", *TAIL)),
        Level("basename", ("basename",), ("namespace", "parameters", *TAIL)),
    ],
    [
        Level("path_namespace", ("path", "namespace"), ("basename", "parameters", *TAIL)),
        Level("path", ("path",), (NAME, "parameters", *TAIL)),
        Level("file", ("file",), (NAME, "parameters", *TAIL)),
    ],
]
ALL = Level("all", (), (NAME, "parameters", *TAIL), False, False)
BY_NAME = {level.name: level for level in [*LEVELS, *ROUTES[0], *ROUTES[1], ALL]}


def _score(level: Level, long_texts: bool = False) -> Callable[[Field, Field], Column]:
    similarity = edit_similarity_of_long if long_texts else edit_similarity

    def score(a: Field, b: Field) -> Column:
        similar = lambda c: similarity(a(c), b(c))
        parts = []
        for c in level.score:
            if c == "one":
                parts.append(F.lit(1).alias(c))
            elif c == "len":
                parts.append((-F.abs(a("__len") - b("__len"))).alias(c))
            elif c == NAME:
                parts.append((similar("namespace") + similar("basename")).alias("name"))
            else:
                parts.append(similar(c).alias(c))
        return F.struct(*parts)

    return score


def _keep(level: Level):
    if not level.same_cold:
        return None
    cold = lambda side: side("extension").contains("cold")
    return lambda a, b: cold(a) == cold(b)


def _with_parts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("__len", F.length("func")).withColumn("file", file_name(F.col("path")))


def link_level(old: DataFrame, new: DataFrame, profiled: DataFrame, level: Level,
               aliases: bool = True, max_rounds: int | None = None) -> DataFrame:
    """Links of one level. ``profiled`` has the profiled old names as ``func``."""
    old, new = _with_parts(old), _with_parts(new)
    if level.profiled:
        old = old.join(profiled.select("func"), "func", "left_semi")
    return rounds_of_ordered_best(
        old, new, list(level.block), level.compared(), _score(level), _keep(level), aliases, max_rounds,
        long_score=_score(level, True),
    )


def _after_level(old: DataFrame, new: DataFrame, won: DataFrame, level: Level) -> tuple[DataFrame, DataFrame]:
    """Rows that met nobody at this level; rows that met and lost wait for the next full pass."""
    block = list(level.block)
    old_keys, new_keys = _with_parts(old).select(*block), _with_parts(new).select(*block)
    alone = lambda side, other: _with_parts(side).join(other, block, "left_anti").drop("__len", "file").select(*side.columns)
    open_old, open_new = alone(old, new_keys), alone(new, old_keys)
    open_old = retire(open_old, won.select(F.col("old_fid").alias("fid")), ["fid"])
    open_new = retire(open_new, won.select(F.col("new_fid").alias("fid")), ["fid"])
    return settle(open_old), settle(open_new)


def _meeting(levels: list[Level], old: DataFrame, new: DataFrame) -> list[Level]:
    """The levels at which some old and new row meet, profiled or not, found in one pass over the rows.

    A level without such rows links nothing and leaves all rows open, and rows only get fewer, so it can be left out.
    """
    marks = F.explode(F.array(*[
        F.struct(F.lit(level.name).alias("level"), F.array(*[F.col(c).cast("string") for c in level.block]).alias("key"))
        for level in levels
    ])).alias("at")
    keys = lambda side: _with_parts(side).select(marks).where("not exists(at.key, v -> v is null)").select("at.*").distinct()
    met = keys(old).unionByName(keys(new)).groupBy("level", "key").agg(F.count("*").alias("n")).where("n = 2")
    names = {r["level"] for r in met.select("level").distinct().collect()}  # one row a level at most
    return [level for level in levels if level.name in names]


def _has_aliases(*sides: DataFrame) -> bool:
    return any(not s.groupBy("fid").count().where("count > 1").isEmpty() for s in sides)


def _run(levels: list[Level], old: DataFrame, new: DataFrame, profiled: DataFrame, aliases: bool,
         max_rounds: int | None, found: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    levels = _meeting(levels, old, new)
    while levels:
        level, *levels = levels
        won = link_level(old, new, profiled, level, aliases, max_rounds)
        found.append(won.withColumn("level", F.lit(level.name)))
        old, new = _after_level(old, new, won, level)
        levels = _meeting(levels, old, new) if levels else []
    return old, new


def link_functions_once(old: DataFrame, new: DataFrame, profiled: DataFrame,
                        max_rounds: int | None = None) -> DataFrame:
    """One pass over all levels.

    ``profiled`` has ``fid, func`` of the profiled old functions. The links of
    the two last routes compete once more on the full name score. The result is
    given under the profiled alias names, with the level that made the link.
    """
    old, new = settle(old), settle(new)
    aliases = _has_aliases(old, new)
    found: list[DataFrame] = []
    old, new = _run(LEVELS, old, new, profiled, aliases, max_rounds, found)
    if not (old.isEmpty() or new.isEmpty()):
        rivals: list[DataFrame] = []
        for route in ROUTES:
            _run(route, old, new, profiled, aliases, max_rounds, rivals)
        if rivals:
            found.append(_merge_routes(union_all(rivals), old, new, max_rounds))
    if not found:
        found = [_no_links(old)]
    links = union_all(found)
    names = profiled.select(F.col("fid").alias("old_fid"), F.col("func").alias("old_func"))
    return links.drop("old_func").join(names, "old_fid").select(
        "old_fid", "old_func", "new_fid", "new_func", "level"
    ).distinct()


def _no_links(old: DataFrame) -> DataFrame:
    return empty_like(old.select(
        F.col("fid").alias("old_fid"), F.col("func").alias("old_func"), F.col("fid").alias("new_fid"),
        F.col("func").alias("new_func"), F.lit("").alias("level")))


def _merge_routes(rivals: DataFrame, old: DataFrame, new: DataFrame, max_rounds: int | None) -> DataFrame:
    """Pick one to one among the few pairs the routes proposed (at most two per row)."""
    level = ALL
    parts = ["namespace", "basename", "parameters", "extension", "chunk"]
    side = lambda rows, s: rows.select(
        F.col("func").alias(f"{s}_func"), *[F.col(c).alias(f"{s}_{c}") for c in parts]
    ).withColumn(f"{s}___len", F.length(f"{s}_func"))
    scored = (
        rivals.join(side(old, "old"), "old_func").join(side(new, "new"), "new_func")
        .select("old_fid", "old_func", "new_fid", "new_func", "level",
                _score(level, True)(lambda c: F.col(f"old_{c}"), lambda c: F.col(f"new_{c}")).alias("score"))
    )
    rest = settle(scored)
    won_parts: list[DataFrame] = []
    while max_rounds is None or len(won_parts) < max_rounds:
        best = rest
        for s in ("old", "new"):
            best = best.join(rest.groupBy(f"{s}_fid").agg(F.max("score").alias(f"__{s}")), f"{s}_fid")
        best = best.where("score = __old and score = __new")
        order = F.struct("old_func", "new_func", "old_fid", "new_fid", "level")
        taken = best.groupBy("old_fid").agg(F.min(order).alias("t")).select("t.*")
        taken = taken.groupBy("new_fid").agg(F.min(order).alias("t")).select("t.*")
        won = settle(taken)
        if won.isEmpty():
            break
        won_parts.append(won)
        rest = settle(retire(rest, won, ["old_fid"], ["new_fid"]))
    columns = ["old_fid", "old_func", "new_fid", "new_func", "level"]
    return union_all(won_parts).select(*columns) if won_parts else empty_like(rivals, *columns)


def link_functions(old: DataFrame, new: DataFrame, profiled: DataFrame, try_all: bool = True,
                   max_passes: int | None = None) -> DataFrame:
    """All function links of two versions.

    Old paths are first put under their new paths. Passes over all levels run
    on the profiled functions still open until one brings nothing; then what is
    left on both sides is linked by name alone.
    """
    old = settle(replace_with_path(old, "path", new.select("path").distinct()))
    new, profiled = settle(new), settle(profiled)
    found = [settle(link_functions_once(old, new, profiled))]
    passes = 1
    while True:
        done = found[-1]
        profiled = settle(retire(profiled, done.select(F.col("old_fid").alias("fid")), ["fid"]))
        old = settle(old.join(profiled.select("fid"), "fid", "left_semi"))
        new = settle(retire(new, done.select(F.col("new_fid").alias("fid")), ["fid"]))
        if old.isEmpty() or new.isEmpty() or (max_passes is not None and passes >= max_passes):
            break
        won = settle(link_functions_once(old, new, profiled))
        if won.isEmpty():
            break
        found.append(won)
        passes += 1
    if try_all:
        found.append(link_leftovers(old, new).withColumn("level", F.lit(ALL.name)))
    return union_all(found)


def link_leftovers(old: DataFrame, new: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Link any function with any other by name similarity, one to one.

    Every name class of one side is scored against every one of the other, in
    tiles; equal names are one class.
    """
    block = F.lit("").alias("__any")
    level = Level(ALL.name, ("__any",), ALL.score, False, False)
    return rounds_of_ordered_best(
        _with_parts(old).withColumn("__any", block), _with_parts(new).withColumn("__any", block),
        ["__any"], level.compared(), _score(level), None, _has_aliases(old, new), max_rounds,
        long_score=_score(level, True),
    )
