"""Links between the source lines of two versions.

Line tables have ``path, line, code``; link tables ``old_path, old_line,
new_path, new_line``. Every step returns new links as a table of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from versionlink.functions.similarity import edge_distance, edit_similarity
from versionlink.functions.text import digest, plain_words, without_line_comment
from versionlink.operators.assign import Tier, retire, rounds_of_unique_best, single_on_both
from versionlink.operators.bounds import FIRST, LAST, mutual_inside, ranked_bounds, tight_bounds
from versionlink.operators.closest import closest
from versionlink.operators.components import connected
from versionlink.operators.fill import unlinked_between
from versionlink.operators.ranges import contain_join
from versionlink.operators.shared_words import LINE_WEIGHT, word_weights
from versionlink.plans.line_parts import PART_LINES, link_parts
from versionlink.plans.paths import link_paths_by_content, link_paths_by_name
from versionlink.session import compact, keep, settle, union_all

OLD, NEW = ["old_path", "old_line"], ["new_path", "new_line"]
LINK = [*OLD, *NEW]
LINK_SCHEMA = "old_path string, old_line bigint, new_path string, new_line bigint"


def no_links(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LINK_SCHEMA)


def _uncommented(src: DataFrame) -> DataFrame:
    """Lines without their line comments; digests have theirs beside them, as ``bare`` where it differs."""
    if "bare" in src.columns:
        return src.withColumn("code", F.coalesce("bare", "code")).drop("bare")
    return src.withColumn("code", without_line_comment(F.col("code")))


def unlinked(src: DataFrame, src_map: DataFrame, s: str) -> DataFrame:
    done = src_map.select(F.col(f"{s}_path").alias("path"), F.col(f"{s}_line").alias("line"))
    return src.join(done, ["path", "line"], "left_anti")


def _single_code(src: DataFrame) -> DataFrame:
    """Lines whose code no other line of the path has."""
    return src.groupBy("path", "code").agg(F.min("line").alias("line"), F.count("*").alias("n")).where("n = 1").drop("n")


def _side(src: DataFrame, s: str) -> DataFrame:
    return src.withColumnsRenamed({c: f"{s}_{c}" for c in src.columns if c != "code"})


def equal_unique_lines(old_src: DataFrame, new_src: DataFrame, path_map: DataFrame) -> DataFrame:
    """Lines with the same code that is unique in both linked paths."""
    single = lambda src, s: _side(_single_code(src.select("path", "line", digest(F.col("code")).alias("code"))), s)
    pairs = (
        path_map.select("old_path", "new_path").join(single(old_src, "old"), "old_path")
        .join(single(new_src, "new"), ["new_path", "code"]).select(*LINK)
    )
    return single_on_both(pairs, OLD, NEW)


def equal_lines_between(old_src: DataFrame, new_src: DataFrame, path_map: DataFrame,
                        src_map: DataFrame, top: int | None = None) -> DataFrame:
    """Unlinked lines with code unique among the unlinked lines of both paths,
    each inside the interval the other's nearest links leave."""
    def open_lines(src: DataFrame, s: str, o: str) -> DataFrame:
        links = src_map.select(
            F.col(f"{s}_path").alias("path"), F.col(f"{s}_line").alias("line"), F.col(f"{o}_line").alias("link")
        )
        # a code of one line keeps that line's values through the aggregate
        single = unlinked_between(src, links, top).groupBy("path", "code").agg(
            F.min("line").alias(f"{s}_line"), F.count("*").alias("n"),
            F.coalesce(F.min("prev"), F.lit(FIRST)).alias(f"{o}_line_prev"),
            F.coalesce(F.min("next"), F.lit(LAST)).alias(f"{o}_line_next"),
        )
        return single.where("n = 1").drop("n").withColumnRenamed("path", f"{s}_path")

    pairs = (
        path_map.select("old_path", "new_path").join(open_lines(old_src, "old", "new"), "old_path")
        .join(open_lines(new_src, "new", "old"), ["new_path", "code"])
    )
    return single_on_both(mutual_inside(pairs).select(*LINK), OLD, NEW)


def has_comments(*sides: DataFrame) -> bool:
    """Whether some line differs without its line comment; if none does, that pass finds nothing new."""
    return any(not s.where(F.col("code") != without_line_comment(F.col("code"))).isEmpty() for s in sides)


def link_equal_unique(old_src: DataFrame, new_src: DataFrame, path_map: DataFrame, max_rounds: int | None = None,
                      top: int | None = None, comments: bool = True) -> DataFrame:
    """:func:`equal_unique_lines`, then :func:`equal_lines_between` until dry,
    then the same once more without line comments (``comments``: some line has one)."""
    found = [settle(equal_unique_lines(old_src, new_src, path_map))]
    stripped, rounds = not comments, 0
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        more = settle(equal_lines_between(old_src, new_src, path_map, union_all(found), top))
        if not more.isEmpty():
            found.append(more)
            continue
        if stripped:
            break
        old_src, new_src, stripped = _uncommented(old_src), _uncommented(new_src), True
    return union_all(found)


def nearest_unique(pairs: DataFrame, stage: list[str]) -> DataFrame:
    """Mutually inside pairs whose edge distances are least for both lines, unique, per ``stage``."""
    near = settle(mutual_inside(pairs).select(
        *stage, *LINK, edge_distance("old_line", "old_line_prev", "old_line_next").alias("old_dist"),
        edge_distance("new_line", "new_line_prev", "new_line_next").alias("new_dist"),
    ))
    least = lambda key, dist: near.groupBy(*key).agg(F.min(dist).alias(f"least_{dist}"))
    near = near.join(least([*stage, *OLD], "old_dist"), [*stage, *OLD])
    near = near.join(least([*stage, *NEW], "new_dist"), [*stage, *NEW])
    near = near.where("old_dist = least_old_dist and new_dist = least_new_dist").select(*stage, *LINK)
    return single_on_both(near, [*stage, *OLD], [*stage, *NEW])


def _inside_join(old: DataFrame, new: DataFrame, keys: list[str], top: int) -> DataFrame:
    """Equal keys, and the new line inside the old line's interval."""
    spans = old.withColumn("__lo", F.col("new_line_prev") + 1)
    shared = [*keys, "old_path", "new_path"]
    return contain_join(new, spans, shared, "new_line", "__lo", "new_line_next", top).drop("__lo")


def link_equal_repeated(old_src: DataFrame, new_src: DataFrame, src_map: DataFrame, top: int,
                        apart: str | None = None, comments: bool = True) -> DataFrame:
    """Repeated code between links: equal count and position, else first with
    first and last with last, else the same without line comments (positions stay).

    The first of these steps that gives links counts for the whole table, or,
    with ``apart``, for each value of that link column (parts whose lines never
    meet then do not wait for each other). ``top`` is the largest line number.
    """
    old = keep(ranked_bounds(old_src, "old", "new", src_map, top))
    new = keep(ranked_bounds(new_src, "new", "old", src_map, top))

    def keyed(side: DataFrame) -> DataFrame:
        end = F.when(F.col("rank_inc") == 1, F.lit(1)).when(F.col("rank_dec") == 1, F.lit(-1))
        counted = side.withColumn("step", F.lit(1)).withColumn("at", F.col("rank_inc"))
        ends = side.withColumn("step", F.lit(2)).withColumn("at", end.cast("bigint")).where("at is not null")
        ends = ends.withColumn("rank_count", F.lit(0).cast("bigint"))
        return counted.unionByName(ends).drop("rank_inc", "rank_dec")

    part = [apart] if apart else []
    found: list[DataFrame] = []
    plain = lambda side: side.drop("bare")
    for strip in (plain, _uncommented) if comments else (plain,):
        pairs = _inside_join(keyed(strip(old)), keyed(strip(new)), ["code", "step", "at", "rank_count"], top)
        won = settle(nearest_unique(pairs, ["step"]))
        if won.isEmpty():
            continue
        first = won.groupBy(*part).agg(F.min("step").alias("__first"))
        if not apart:
            return won.where(F.col("step") == first.first()["__first"]).select(*LINK)
        found.append(settle(won.join(first, apart).where("step = __first").select(*LINK)))
        old, new = retire(old, won, part), retire(new, won, part)
    return union_all(found) if found else won.select(*LINK)


def word_pairs(old_src: DataFrame, new_src: DataFrame, src_map: DataFrame, top: int, codes: bool = True) -> DataFrame:
    """Shared-word weight of unlinked lines that lie inside each other's interval, with their ``codes`` on demand.

    Lines meet by pairs of gaps, so words are counted inside a task and never shuffled on their own.
    """
    def gaps(src: DataFrame, s: str, o: str) -> DataFrame:
        lines = _uncommented(tight_bounds(src, s, o, src_map, top))
        # rows that repeat a line count their words together
        return keep(lines.groupBy(*gap_of(s), f"{s}_line").agg(F.sort_array(F.collect_list("code")).alias("codes")))

    old, new = gaps(old_src, "old", "new"), gaps(new_src, "new", "old")
    both = gap_pairs(old, new, top)

    def lines(side: DataFrame, s: str) -> DataFrame:
        size = F.aggregate("codes", F.lit(LINE_WEIGHT), lambda n, code: n + F.length(code))
        return side.join(both, gap_of(s)).select(
            *both.columns, F.col(f"{s}_line").alias("line"), "codes", size.cast("bigint").alias("__weight"))

    return word_weights(lines(old, "old"), lines(new, "new"), both.columns, plain_words, codes).withColumn("len", F.round("len", 10))


def gap_of(s: str) -> list[str]:
    """Columns that name the gap of a side's line: all lines between the same two links share one."""
    o = "new" if s == "old" else "old"
    return ["old_path", "new_path", f"{o}_line_prev", f"{o}_line_next"]


def gap_pairs(old: DataFrame, new: DataFrame, top: int) -> DataFrame:
    """Pairs of gaps whose lines lie inside each other's interval."""
    # no link lies inside a gap, so one line tells whether the whole gap is inside an interval
    spot = lambda side, s: side.groupBy(*gap_of(s)).agg(F.min(f"{s}_line").alias(f"{s}_line"))
    return settle(
        mutual_inside(_inside_join(spot(old, "old"), spot(new, "new"), [], top))
        .select(*dict.fromkeys([*gap_of("old"), *gap_of("new")]))
    )


def link_by_words(old_src: DataFrame, new_src: DataFrame, src_map: DataFrame, top: int,
                  max_rounds: int | None = None) -> DataFrame:
    """Rounds of unique mutual best word weight, then of (weight, similarity)."""
    pairs = keep(word_pairs(old_src, new_src, src_map, top, codes=False))
    first = rounds_of_unique_best(pairs, OLD, NEW, [Tier("len")], max_rounds).select(*LINK)
    first = settle(first)
    rest = keep(retire(pairs, first, OLD, NEW))

    def codes(src: DataFrame, s: str) -> DataFrame:
        place = [f"{s}_path", f"{s}_line"]
        lines = _uncommented(src).withColumnsRenamed({"path": f"{s}_path", "line": f"{s}_line"})
        lines = lines.join(rest.select(*place).distinct(), place, "left_semi")
        return keep(lines.groupBy(*place).agg(F.sort_array(F.collect_set("code")).alias(f"{s}_codes")))

    code = lambda s: F.get(f"{s}_codes", F.col(f"{s}_at").cast("int"))
    rest = rest.join(codes(old_src, "old"), OLD).join(codes(new_src, "new"), NEW).select(
        *LINK, "len", edit_similarity(code("old"), code("new")).alias("similarity"))
    second = rounds_of_unique_best(rest, OLD, NEW, [Tier("len"), Tier("similarity")], max_rounds)
    return first.unionByName(second.select(*LINK))


def link_fuzzy(old_src: DataFrame, new_src: DataFrame, old_lines: DataFrame, new_lines: DataFrame,
               src_map: DataFrame, top: int) -> DataFrame:
    """Most similar lines of mutual intervals, nearest to an edge, unique.

    Only lines listed in ``old_lines`` / ``new_lines`` (``path, line``) take
    part. All lines between the same two links share one interval, so codes are
    compared per pair of intervals, as distinct values.
    """
    def gaps(src: DataFrame, listed: DataFrame, s: str, o: str) -> DataFrame:
        lines = tight_bounds(src, s, o, src_map, top).join(
            listed.withColumnsRenamed({"path": f"{s}_path", "line": f"{s}_line"}), [f"{s}_path", f"{s}_line"], "left_semi"
        )
        return keep(lines.withColumnRenamed("code", f"{s}_code"))

    old, new = gaps(old_src, old_lines, "old", "new"), gaps(new_src, new_lines, "new", "old")
    old_gap, new_gap = gap_of("old"), gap_of("new")
    both = gap_pairs(old, new, top)
    block = both.columns
    sized = lambda side, gap, c: side.select(*gap, F.xxhash64(c).alias("__h"), F.length(c).alias("__n")).join(both, gap)
    codes = closest(
        old.select(*old_gap, "old_code").join(both, old_gap), new.select(*new_gap, "new_code").join(both, new_gap),
        block, "old_code", "new_code", sizes=(sized(old, old_gap, "old_code"), sized(new, new_gap, "new_code")), digests=True,
    )
    codes = keep(codes.where("best_left and best_right"))
    top_of = lambda gap, code, out: codes.groupBy(*gap, code).agg(F.max("similarity").alias(out))
    codes = (
        codes.join(top_of(old_gap, "old_code", "__o"), [*old_gap, "old_code"])
        .join(top_of(new_gap, "new_code", "__n"), [*new_gap, "new_code"])
        .where("similarity = __o and similarity = __n").select(*block, "old_code", "new_code", "similarity")
    )
    named = lambda side, c: side.withColumn(c, digest(F.col(c)))
    pairs = codes.join(named(old, "old_code"), [*old_gap, "old_code"]).join(named(new, "new_code"), [*new_gap, "new_code"])
    pairs = pairs.withColumn(
        "diff",
        F.greatest(edge_distance("old_line", "old_line_prev", "old_line_next"),
                   edge_distance("new_line", "new_line_prev", "new_line_next")),
    ).select(*LINK, "similarity", "diff")
    pairs = settle(pairs)
    least = lambda key, out: pairs.groupBy(*key).agg(F.min("diff").alias(out))
    near = pairs.join(least(OLD, "__o"), OLD).join(least(NEW, "__n"), NEW).where("diff = __o and diff = __n")
    return single_on_both(near.select(*LINK), OLD, NEW)


def largest_line(*sides: DataFrame) -> int:
    return max(side.agg(F.max("line")).first()[0] or 0 for side in sides)


def link_lines(old_src: DataFrame, new_src: DataFrame, old_lines: DataFrame, new_lines: DataFrame,
               part_lines: int = PART_LINES) -> DataFrame:
    """All line links of two versions.

    Paths are linked by name first. Equal lines are linked until dry, then paths
    are linked again by the content of what is left, until such a link brings
    nothing. Then only the listed lines go on, with the fuzzy step added.

    Paths that links or path links connect form a part; steps of different parts do not touch
    each other. After the first pass only parts go on that a new path link or new line links
    reached. A part of up to ``part_lines`` lines runs its steps in one task, larger ones by rounds of joins.
    """
    old_src, new_src = keep(old_src), keep(new_src)
    top = largest_line(old_src, new_src)
    by_name = settle(link_paths_by_name(old_src.select("path"), new_src.select("path")))
    run = _Run(old_src, new_src, old_lines, new_lines, by_name, top, part_lines)
    path_map = by_name
    won = run.equal_steps(path_map, listed=False)
    while won:
        path_map = settle(link_paths_by_content(*run.open_lines(), top).select("old_path", "new_path"))
        if path_map.isEmpty():
            break
        run.connect(path_map)
        won = run.equal_steps(path_map, listed=False)
    run.equal_steps(path_map, listed=True)
    touched = None
    while run.fuzzy_step(touched):
        touched = run.touched
        run.equal_steps(path_map, listed=True, parts=touched)
    return union_all(run.found)


class _Run:
    """The links found so far, the parts of the paths, and the steps on some of the parts."""

    def __init__(self, old_src: DataFrame, new_src: DataFrame, old_lines: DataFrame, new_lines: DataFrame,
                 by_name: DataFrame, top: int, part_lines: int):
        self.src = {"old": old_src, "new": new_src}
        self.listed = {"old": keep(old_lines.select("path", "line").distinct()), "new": keep(new_lines.select("path", "line").distinct())}
        self.top, self.part_lines = top, part_lines
        self.comments = has_comments(old_src, new_src)
        self.found = [no_links(old_src.sparkSession)]
        self.touched: DataFrame | None = None
        # a part is named after the new path that all its old paths are linked with
        paths = lambda src: src.select("path").distinct()
        named = by_name.select(F.col("old_path").alias("path"), F.col("new_path").alias("to"))
        own = F.coalesce("to", F.concat(F.lit("\0"), "path"))
        self.parts = settle(
            paths(old_src).join(named, "path", "left").select(F.lit("old").alias("side"), "path", own.alias("part"))
            .unionByName(paths(new_src).select(F.lit("new").alias("side"), "path", F.col("path").alias("part")))
        )

    def part_of(self, s: str) -> DataFrame:
        return self.parts.where(F.col("side") == s).select(F.col("path").alias(f"{s}_path"), F.col("part"))

    def in_parts(self, path_map: DataFrame) -> DataFrame:
        return path_map.join(self.part_of("old"), "old_path")

    def connect(self, path_map: DataFrame) -> None:
        """Join the parts that new path links lead between."""
        ends = path_map.join(self.part_of("old").withColumnRenamed("part", "a"), "old_path").join(
            self.part_of("new").withColumnRenamed("part", "b"), "new_path")
        joined = connected(ends, "a", "b").select(F.col("node").alias("part"), F.col("part").alias("to"))
        self.parts = settle(self.parts.join(joined, "part", "left").select("side", "path", F.coalesce("to", "part").alias("part")))

    def open_lines(self) -> tuple[DataFrame, DataFrame]:
        links = union_all(self.found)
        return keep(unlinked(self.src["old"], links, "old")), keep(unlinked(self.src["new"], links, "new"))

    def lines(self, parts: DataFrame, listed: bool) -> DataFrame:
        """All lines of some parts with their links; ``asks`` marks those that take part in the unique step.

        Equal lines are all that is asked for, so codes are digests, and ``bare`` one only where comments make a difference.
        """
        links = union_all(self.found)
        sides = []
        for s, o in (("old", "new"), ("new", "old")):
            own = self.part_of(s).join(parts, "part", "left_semi").withColumnRenamed(f"{s}_path", "path")
            to = links.select(
                F.col(f"{s}_path").alias("path"), F.col(f"{s}_line").alias("line"),
                F.col(f"{o}_path").alias("to_path"), F.col(f"{o}_line").alias("to_line"))
            bare = without_line_comment(F.col("code"))
            keys = self.src[s].select("path", "line", digest(F.col("code")).alias("code"),
                                      (F.when(bare != F.col("code"), digest(bare)) if self.comments else F.lit(None).cast("binary")).alias("bare"))
            rows = keys.join(own, "path").join(to, ["path", "line"], "left")
            if listed:
                rows = rows.join(self.listed[s].withColumn("asks", F.lit(True)), ["path", "line"], "left")
            asks = F.coalesce("asks", F.lit(False)) if listed else F.lit(True)
            sides.append(rows.select(
                "part", F.lit(s == "old").alias("old"), "path", "line", "code", "bare", asks.alias("asks"), "to_path", "to_line"))
        return sides[0].unionByName(sides[1])

    def equal_steps(self, path_map: DataFrame, listed: bool, parts: DataFrame | None = None) -> bool:
        """Run the equal-line steps until dry; without ``parts``, on those that ``path_map`` is in."""
        pairs = self.in_parts(path_map)
        if parts is not None:
            pairs = pairs.join(parts, "part", "left_semi")
        parts = pairs.select("part").distinct() if parts is None else parts
        lines = keep(self.lines(parts, listed))
        sizes = lines.groupBy("part").agg(F.count("*").alias("n"))
        total, largest = sizes.agg(F.sum("n"), F.max("n")).first()
        if not total:
            return False
        won = []
        if largest > self.part_lines:
            large = settle(sizes.where(F.col("n") > self.part_lines).select("part"))
            within = lambda df: df.join(large, "part", "left_semi")
            won.append(self.rounds(within(lines), within(pairs), listed))
            lines, pairs = lines.join(large, "part", "left_anti"), pairs.join(large, "part", "left_anti")
        won.append(keep(link_parts(lines, pairs.select("part", "old_path", "new_path"), total)))
        self.touched = settle(union_all([w.select("part") for w in won]).distinct())
        self.found = compact([*self.found, *[w.select(*LINK) for w in won]])
        return not self.touched.isEmpty()

    def rounds(self, lines: DataFrame, pairs: DataFrame, listed: bool) -> DataFrame:
        """The steps as rounds of joins, for parts of any size; a part without a new link is finished."""
        pairs, lines = settle(pairs), keep(lines)
        found = [no_links(lines.sparkSession)]
        links = lines.where("old and to_path is not null").select(
            F.col("path").alias("old_path"), F.col("line").alias("old_line"),
            F.col("to_path").alias("new_path"), F.col("to_line").alias("new_line"))
        while True:
            sides = [lines.where(F.col("old") == old).select("path", "line", "code", "bare", "asks") for old in (True, False)]
            all_links = settle(links.unionByName(union_all(found)))
            asking = [keep(unlinked(side.where("asks").drop("asks"), all_links, s)) for side, s in zip(sides, ("old", "new"))]
            won = [settle(link_equal_unique(*asking, pairs, top=self.top, comments=self.comments))]
            won.append(link_equal_repeated(*[side.drop("asks") for side in sides], union_all([all_links, *won]), self.top,
                                           comments=self.comments))
            won = [w for w in won if not w.isEmpty()]
            if not won:
                return self.in_parts(union_all(found)).select("part", *LINK)
            found = compact([*found, *won])

    def fuzzy_step(self, parts: DataFrame | None) -> bool:
        """The fuzzy step, on all parts or on some."""
        links = union_all(self.found)
        src, listed = dict(self.src), dict(self.listed)
        if parts is not None:
            for s in src:
                own = self.part_of(s).join(parts, "part", "left_semi").select(F.col(f"{s}_path").alias("path"))
                src[s], listed[s] = (df.join(own, "path", "left_semi") for df in (src[s], listed[s]))
            links = links.join(self.part_of("old").join(parts, "part", "left_semi"), "old_path", "left_semi")
        won = settle(link_fuzzy(src["old"], src["new"], listed["old"], listed["new"], keep(links), self.top))
        if won.isEmpty():
            return False
        self.found = compact([*self.found, won])
        self.touched = settle(self.in_parts(won).select("part").distinct())
        return True
