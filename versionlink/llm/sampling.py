"""Mixing sources to target sizes by Pareto order sampling, in DataFrame functions only.

Targets: the sources, in code point order with null last, take weights in turn;
``percent`` of all words are shared by weight, and no target exceeds ``most`` times
its source, the excess going to the others by weight.

Within a source a document's expected copies grow with the bit length of its
size (``measure``), up to ``most``, and are scaled so that the expected words meet
the target. Everyone takes the whole part of its expected copies. The fraction
is an inclusion probability p: documents are ranked by the odds of a uniform
number, u / (1 - u), over p / (1 - p), and the first ones are taken up to the
number of words left, the last one if that comes nearer. u comes from the MD5 of
the id, so reruns agree.

The rank is cut without sorting a source: sums per source and part of the rank
give the part that holds the cut, twice, and only the rows of that part are
ordered. Sources and measures form a small table that is joined to the rows.

Row cases: null text has size 0, and size 0 is taken as 0 words. A null source
is a source. Equal rows are taken or left together with their tie broken by
id, then size; rows with null ids share one u. Without rows there is no result. A
document's own columns travel in a struct, so their names clash with nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from versionlink.llm.common import WORD, stored

WEIGHTS = (3, 1, 2)
PERCENT = 150
MOST = 2
PARTS = 1024


def _annotated(docs: DataFrame) -> DataFrame:
    """``_size``, ``_measure`` and ``_u`` beside ``doc_id, text, source`` and what else the rows hold."""
    number = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 1, 13), 16, 10)
    return (
        docs.withColumn("_size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
        .withColumn("_measure", F.length(F.bin("_size")))
        .withColumn("_u", (number.cast("double") + 0.5) / F.lit(float(1 << 52)))
    )


def _targets(sizes: DataFrame, weights: tuple[int, ...], percent: int, most: int) -> DataFrame:
    """``source, source_size, target`` from ``source, measure, size``; a row per source."""
    whole = Window.partitionBy()
    in_order = whole.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) + 1
    sources = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn).cast("double"))
        .withColumn("total", F.sum("source_size").over(whole) * (percent / 100))
        .withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    rising = whole.orderBy("ratio", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    capped = sources.withColumn("full", (F.col("total") - before) / onward >= F.col("ratio"))
    level = (F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(whole)) / F.sum(
        F.when(F.col("full"), 0.0).otherwise(F.col("weight"))
    ).over(whole)
    return capped.withColumn(
        "target", F.when(F.col("full"), F.col("cap")).otherwise(level * F.col("weight"))
    ).select("source", "source_size", "target")


def _copies(sizes: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """Per source and measure: ``whole`` copies for each document and the ``fraction`` beyond."""
    own = Window.partitionBy("source")
    falling = own.orderBy(F.col("measure").desc())
    rows = sizes.join(targets.withColumnRenamed("source", "t_source"), F.expr("source <=> t_source"))
    rows = rows.drop("t_source").withColumn("weighed", F.col("measure").cast("double") * F.col("size"))
    before = F.coalesce(F.sum("size").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weighed").over(falling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn(
        "full", F.when(onward > 0, (F.col("target") - most * before) * F.col("measure") / onward >= float(most))
        .otherwise(F.lit(False))
    )
    taken = F.sum(F.when(F.col("full"), F.col("size")).otherwise(0)).over(own)
    rest = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weighed"))).over(own)
    expected = F.when(F.col("full"), float(most)).when(
        rest > 0, (F.col("target") - most * taken) / rest * F.col("measure")
    ).otherwise(0.0)
    return rows.withColumn("expected", F.least(F.greatest(expected, F.lit(0.0)), F.lit(float(most)))).select(
        "source", "measure", "size", "source_size", "target", F.floor("expected").alias("whole"),
        (F.col("expected") - F.floor("expected")).alias("fraction"),
    )


def _ranked(rows: DataFrame) -> DataFrame:
    """The rank ``_q``, and its part of the whole range in two steps."""
    odds = F.col("_u") * (1 - F.col("fraction")) / ((1 - F.col("_u")) * F.col("fraction"))
    share = F.col("_q") / (1 + F.col("_q"))
    return (
        rows.withColumn("_q", F.when(F.col("fraction") > 0, odds))
        .withColumn("_part", F.floor(share * PARTS)).withColumn("_fine", F.floor(share * (PARTS * PARTS)))
    )


def _holding(rows: DataFrame, part: str, left: DataFrame) -> DataFrame:
    """Per source the part of the rank in which its ``left`` words run out, and the words left at its start."""
    sums = rows.groupBy("source", part).agg(F.sum("size").alias("size"))
    order = Window.partitionBy("source").orderBy(part)
    sums = sums.withColumn("upto", F.sum("size").over(order)).join(
        left.withColumnRenamed("source", "l_source"), F.expr("source <=> l_source")
    ).filter("upto >= left and upto - size < left")
    return sums.groupBy("source").agg(
        F.min(F.struct(part, (F.col("left") - F.col("upto") + F.col("size")).alias("left"))).alias("at")
    ).select("source", f"at.{part}", "at.left")


def _plan(docs: DataFrame, weights, percent, most) -> tuple[DataFrame, DataFrame]:
    """The small table of copies by source and measure, and of cuts by source."""
    rows = _annotated(docs.select("doc_id", "text", "source")).select(
        "doc_id", "source", F.col("_size").alias("size"), F.col("_measure").alias("measure"), "_u"
    )
    rows = stored(rows)
    sizes = rows.groupBy("source", "measure").agg(F.sum("size").alias("size"))
    plan = stored(_copies(sizes, _targets(sizes, weights, percent, most), most))
    left = plan.groupBy("source").agg(
        F.round(F.first("target") - F.sum(F.col("whole") * F.col("size"))).cast("long").alias("left")
    )
    ranked = _ranked(
        rows.join(
            plan.select(F.col("source").alias("p_source"), F.col("measure").alias("p_measure"), "fraction"),
            F.expr("source <=> p_source and measure = p_measure"),
        ).filter("fraction > 0 and size > 0").drop("p_source", "p_measure")
    )
    coarse = _holding(ranked, "_part", left)
    inside = ranked.join(
        coarse.select(F.col("source").alias("c_source"), F.col("_part").alias("c_part")),
        F.expr("source <=> c_source and _part = c_part"),
    ).drop("c_source", "c_part")
    fine = _holding(inside, "_fine", coarse.select("source", "left"))
    last = inside.join(
        fine.select(F.col("source").alias("f_source"), F.col("_fine").alias("f_fine"), "left"),
        F.expr("source <=> f_source and _fine = f_fine"),
    )
    order = Window.partitionBy("source").orderBy("_q", F.col("doc_id").asc_nulls_last(), "size")
    place = F.struct("_q", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), "size")
    upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = last.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("size")).filter(
        "before < left and upto - left <= left - before"
    )
    cut = last.groupBy("source").agg(F.max(place).alias("place"))
    cuts = fine.select("source", F.col("_fine").alias("fine")).join(
        cut.withColumnRenamed("source", "k_source"), F.expr("source <=> k_source"), "left"
    ).drop("k_source")
    return plan, stored(cuts)


def counted(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST, keep: list[str] | None = None
) -> DataFrame:
    """``row`` (a struct of the columns ``keep``, all by default), ``size, source_size, target, copies``.

    What is kept travels through the join with the plan; the text only if it is among it.
    """
    plan, cuts = _plan(docs, weights, percent, most)
    plan = plan.select(
        F.col("source").alias("_p"), F.col("measure").alias("_m"), F.col("source_size").alias("_source_size"),
        F.col("target").alias("_target"), F.col("whole").alias("_whole"), "fraction",
    ).join(
        cuts.select(F.col("source").alias("_c"), F.col("fine").alias("_cut"), F.col("place").alias("_place")),
        F.expr("_p <=> _c"), "left",
    )
    own = docs.select(F.struct(*(keep or docs.columns)).alias("row"), "doc_id", "text", "source")
    rows = _ranked(_annotated(own).drop("text").join(plan, F.expr("source <=> _p and _measure = _m")))
    place = F.struct(
        F.col("_q"), F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), F.col("_size").alias("size")
    )
    chosen = (F.col("_size") > 0) & (
        (F.col("_fine") < F.col("_cut")) | ((F.col("_fine") == F.col("_cut")) & (place <= F.col("_place")))
    )
    return rows.select(
        "row", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_whole") + F.coalesce(chosen, F.lit(False)).cast("int")).alias("copies"),
    )


def with_copies(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST
) -> DataFrame:
    """The rows with ``_size, _source_size, _target, _copies`` beside their columns.

    Where a document has a column of such a name, the new one takes more underscores in front.
    """
    def free(name: str) -> str:
        while name in docs.columns:
            name = "_" + name
        return name

    added = [F.col(c).alias(free(f"_{c}")) for c in ("size", "source_size", "target", "copies")]
    return counted(docs, weights, percent, most).select("row.*", *added)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """The rows of the mix: every document as often as it is taken."""
    rows = counted(docs, weights, percent, most).filter("copies > 0")
    turns = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return rows.select("row", turns.alias("turn")).select("row.*")
