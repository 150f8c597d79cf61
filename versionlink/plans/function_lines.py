"""Line links that use function links, and fallbacks for lines still open.

``fsrc`` tables have ``fid, path, line, code`` (a line may serve several
functions). Function links may be many to many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from versionlink.functions.text import digest
from versionlink.operators.assign import single_on_both
from versionlink.operators.bounds import loose_bounds, mutual_inside, tight_bounds
from versionlink.operators.closest import closest, similar_rows
from versionlink.operators.pairing import block_join
from versionlink.plans.lines import LINK, NEW, OLD, _inside_join, largest_line
from versionlink.session import compact, keep, settle, union_all

PLACE = ["fid", "path", "line"]
FLINK = ["old_fid", *OLD, "new_fid", *NEW]


def _lines_of(fsrc: DataFrame) -> DataFrame:
    return fsrc.select("path", "line", "code")


def _lines(fsrc: DataFrame) -> DataFrame:
    return _lines_of(fsrc).distinct()


def digested(fsrc: DataFrame) -> DataFrame:
    """The digest of each code in its place, for steps that only ask whether codes are equal."""
    return fsrc.withColumn("code", digest(F.col("code")))


def _named(fsrc: DataFrame, s: str) -> DataFrame:
    return fsrc.withColumnsRenamed({c: f"{s}_{c}" for c in fsrc.columns})


def same_code_inside(old_bounds: DataFrame, new_bounds: DataFrame, top: int) -> DataFrame:
    """Lines of the same code inside each other's interval, unique on both sides."""
    pairs = mutual_inside(_inside_join(old_bounds, new_bounds, ["code"], top)).select(*LINK)
    return single_on_both(pairs.distinct(), OLD, NEW)


def same_code_anywhere(old_bounds: DataFrame, new_bounds: DataFrame) -> DataFrame:
    """Lines that are each other's only line of the same code in the paths their links lead to.

    Partners are counted per (paths, code); a pair is formed only for counts of one.
    """
    key = ["old_path", "new_path", "code"]

    def only_partner(own: DataFrame, other: DataFrame, s: str, o: str) -> DataFrame:
        rows = other.select(*key, f"{o}_line").distinct()
        groups = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min(f"{o}_line").alias(f"{o}_line"))
        partners = own.select(*key, f"{s}_line").distinct().join(groups, key)
        return partners.groupBy(f"{s}_path", f"{s}_line").agg(
            F.sum("n").alias("n"), F.min(f"{o}_path").alias(f"{o}_path"), F.min(f"{o}_line").alias(f"{o}_line")
        ).where("n = 1").select(*LINK)

    return only_partner(old_bounds, new_bounds, "old", "new").join(
        only_partner(new_bounds, old_bounds, "new", "old"), LINK
    )


def _bounds_by_function(bounds: DataFrame, fsrc: DataFrame, s: str) -> DataFrame:
    """Loose rows with each owning function and the number of owners of the line."""
    place = [f"{s}_path", f"{s}_line"]
    owners = _named(fsrc, s).select(f"{s}_fid", *place)
    counts = owners.distinct().groupBy(*place).agg(F.count("*").alias("owners"))
    return bounds.join(owners, place).join(counts, place)


def same_code_same_owners(old_fb: DataFrame, new_fb: DataFrame, func_map: DataFrame) -> DataFrame:
    """Lines of the same code whose owning functions are all linked with each other."""
    key = ["new_fid", "old_path", "new_path", "code", "owners"]
    left = old_fb.select("old_fid", *OLD, "new_path", "code", "owners").join(
        func_map.select("old_fid", "new_fid"), "old_fid"
    ).distinct()
    right = new_fb.select("new_fid", *NEW, "old_path", "code", "owners").distinct()
    pairs = block_join(left, right, key).select("old_fid", "new_fid", *LINK, "owners").distinct()
    agreed = pairs.groupBy(*LINK, "owners").agg(F.count("*").alias("n")).where("n = owners").select(*LINK)
    return single_on_both(agreed, OLD, NEW)


def link_lines_with_functions(old_fsrc: DataFrame, new_fsrc: DataFrame, func_map: DataFrame,
                              src_map: DataFrame, remaining: bool = True,
                              max_rounds: int | None = None) -> DataFrame:
    """Line links per function pair; with ``remaining``, fallbacks for open lines follow.

    In each round the first of four steps that gives links counts: same code in
    tight intervals, in loose ones, anywhere in the linked paths, or under
    agreeing functions.
    """
    old_fsrc, new_fsrc, func_map = keep(old_fsrc), keep(new_fsrc), keep(func_map)
    # the loop only asks whether codes are equal
    old_keys, new_keys = keep(_lines(digested(old_fsrc))), keep(_lines(digested(new_fsrc)))
    top = max(largest_line(old_keys, new_keys), src_map.agg(
        F.greatest(F.max("old_line"), F.max("new_line"))).first()[0] or 0)
    found, rounds = [keep(src_map.select(*LINK))], 0
    while max_rounds is None or rounds < max_rounds:
        links = union_all(found)
        old_loose = keep(loose_bounds(old_keys, "old", "new", links, top))
        new_loose = keep(loose_bounds(new_keys, "new", "old", links, top))
        rounds += 1
        steps = [
            lambda: same_code_inside(tight_bounds(old_keys, "old", "new", links, top),
                                     tight_bounds(new_keys, "new", "old", links, top), top),
            lambda: same_code_inside(old_loose, new_loose, top),
            lambda: same_code_anywhere(old_loose, new_loose),
            lambda: same_code_same_owners(_bounds_by_function(old_loose, old_fsrc.select(*PLACE), "old"),
                                          _bounds_by_function(new_loose, new_fsrc.select(*PLACE), "new"), func_map),
        ]
        for step in steps:
            won = settle(step())
            if not won.isEmpty():
                break
        else:
            break
        found = compact([*found, won])

    fsrc_map = keep(lines_by_function(union_all(found), old_fsrc, new_fsrc, func_map))
    if not remaining:
        return fsrc_map
    old_named, new_named = _named(old_fsrc, "old"), _named(new_fsrc, "new")
    links = union_all(found)
    parts = [fsrc_map, keep(near_lines_between(
        open_by_function(old_fsrc, "old", "new", links, top), open_by_function(new_fsrc, "new", "old", links, top), func_map, old_fsrc, new_fsrc))]
    for by_path, one_sided in ((True, False), (True, True), (False, False), (False, True)):
        done = union_all(parts)
        parts.append(keep(_fallback(old_named, new_named, func_map, done, by_path, one_sided)))
    return union_all(parts)


def open_by_function(fsrc: DataFrame, s: str, o: str, links: DataFrame, top: int) -> DataFrame:
    """Open lines with their loose intervals and owning functions; texts are left where they are."""
    return _bounds_by_function(loose_bounds(fsrc.select("path", "line").distinct(), s, o, links, top), fsrc.select(*PLACE), s)


def lines_by_function(src_map: DataFrame, old_fsrc: DataFrame, new_fsrc: DataFrame, func_map: DataFrame) -> DataFrame:
    """Line links under every linked pair of functions that own the two lines."""
    owner = lambda fsrc, s: _named(fsrc.select(*PLACE), s)
    return (
        src_map.join(owner(old_fsrc, "old"), OLD).join(func_map.select("old_fid", "new_fid"), "old_fid")
        .join(owner(new_fsrc, "new"), ["new_fid", *NEW]).select(*FLINK)
    )


def near_lines_between(old_fb: DataFrame, new_fb: DataFrame, func_map: DataFrame, old_fsrc: DataFrame, new_fsrc: DataFrame,
                       at_least: float = 0.9) -> DataFrame:
    """First fallback: open lines of linked functions whose nearest links lead to
    each other's path, at least 0.9 similar and best for either line.

    Only lines that meet others take their texts along.
    """
    block = ["old_fid", "new_fid", "old_path", "new_path"]
    pairs = func_map.select("old_fid", "new_fid").distinct()
    old = keep(old_fb.select("old_fid", *OLD, "new_path").distinct().join(pairs, "old_fid"))
    new = keep(new_fb.select("new_fid", *NEW, "old_path").distinct().join(pairs, "new_fid"))
    blocks = lambda rows: rows.select(*block).distinct()
    old, new = keep(old.join(blocks(new), block, "left_semi")), keep(new.join(blocks(old), block, "left_semi"))

    def codes(fsrc: DataFrame, rows: DataFrame, s: str) -> DataFrame:
        place = [f"{s}_path", f"{s}_line"]
        named = _named(_lines_of(fsrc), s)
        return keep(named.join(rows.select(*place).distinct(), place, "left_semi").distinct())

    old_codes, new_codes = codes(old_fsrc, old, "old"), codes(new_fsrc, new, "new")
    sized = lambda rows, held, place, c: rows.join(held.select(*place, F.length(c).alias("__n")), place)
    sizes = sized(old, old_codes, OLD, "old_code"), sized(new, new_codes, NEW, "new_code")
    found = keep(similar_rows(old.join(old_codes, OLD), new.join(new_codes, NEW), block, "old_code", "new_code",
                              ["old_line"], ["new_line"], at_least, sizes=sizes))
    return _best_for_either(found, OLD, NEW).select(*FLINK)


def _best_for_either(pairs: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    top = lambda key, out: pairs.groupBy(*key).agg(F.max("similarity").alias(out))
    both = pairs.join(top(left, "__l"), left).join(top(right, "__r"), right)
    return both.where("similarity = __l or similarity = __r").drop("__l", "__r")


def _open(named: DataFrame, links: DataFrame, s: str) -> DataFrame:
    key = [f"{s}_{c}" for c in PLACE]
    return keep(named.join(links.select(*key), key, "left_anti"))


def best_lines_in_functions(old: DataFrame, new: DataFrame, pairs: DataFrame, by_path: bool,
                            for_old: bool = True, for_new: bool = True) -> DataFrame:
    """Line pairs of linked functions (and paths) with the best similarity for an asked side.

    Codes are compared as distinct values of a function pair; the lines that
    hold them are put back last, by the digests of their codes.
    """
    lk = ["old_fid", "old_path"] if by_path else ["old_fid"]
    rk = ["new_fid", "new_path"] if by_path else ["new_fid"]
    pairs = pairs.select(*lk, *rk).distinct()
    # texts of functions that meet none are not moved
    some = lambda side, key: side.select(*key).distinct()
    pairs = keep(pairs.join(some(old, lk), lk, "left_semi").join(some(new, rk), rk, "left_semi"))
    sized = lambda side, c, key: side.select(*key, F.xxhash64(c).alias("__h"), F.length(c).alias("__n")).join(pairs, key)
    found = keep(closest(
        old.select(*lk, "old_code").join(pairs, lk), new.select(*rk, "new_code").join(pairs, rk),
        [*lk, *rk], "old_code", "new_code", for_old, for_new,
        sizes=(sized(old, "old_code", lk), sized(new, "new_code", rk)), digests=True,
    ))
    top = lambda key, flag, out: found.where(flag).groupBy(*key).agg(F.max("similarity").alias(out))
    kept = (
        found.join(top([*lk, "old_code"], "best_left", "__l"), [*lk, "old_code"], "left")
        .join(top([*rk, "new_code"], "best_right", "__r"), [*rk, "new_code"], "left")
        .where("(best_left and similarity = __l) or (best_right and similarity = __r)")
        .select(*lk, *rk, "old_code", "new_code")
    )
    held = lambda side, s: side.select(*[f"{s}_{c}" for c in PLACE], digest(F.col(f"{s}_code")).alias(f"{s}_code"))
    return kept.join(held(old, "old"), [*lk, "old_code"]).join(held(new, "new"), [*rk, "new_code"]).select(*FLINK).distinct()


def _fallback(old: DataFrame, new: DataFrame, func_map: DataFrame, links: DataFrame,
              by_path: bool, one_sided: bool) -> DataFrame:
    """Fallbacks two to five on one state of the links.

    Two-sided: open with open lines, best for either. One-sided: each side's
    open lines with all lines of the other side, best for the open line.
    """
    def pairs(s: str, o: str) -> DataFrame:
        if not by_path:
            return func_map
        met = links.select(f"{s}_path", f"{o}_fid", f"{o}_path").distinct()
        return func_map.select("old_fid", "new_fid").join(met, f"{o}_fid")

    if not one_sided:
        return best_lines_in_functions(_open(old, links, "old"), _open(new, links, "new"), pairs("old", "new"), by_path)
    return best_lines_in_functions(
        _open(old, links, "old"), new, pairs("old", "new"), by_path, for_new=False
    ).unionByName(best_lines_in_functions(
        old, _open(new, links, "new"), pairs("new", "old"), by_path, for_old=False
    ))
