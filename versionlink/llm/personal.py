"""Personal data: fixed patterns, and contextual extraction bootstrapped from what they find.

All of it is DataFrame functions. The patterns (``email``, ``ip``, ``card``, ``phone``) give the base
spans of every whole text. Words with a digit or ``@`` are instances; the words around
an instance with the instance's shape are its lexical patterns. Instances inside base
spans are the seeds. In ``ROUNDS`` rounds over the graph of patterns and instances, a
pattern scores the mean of its instances, and an instance one minus the product of
what its patterns leave open (seeds stay at one). Patterns of ``CONFIDENT`` or more that hold at
least ``SUPPORT`` seeds' worth mark their other instances as spans of kind ``context``.

Places come from splitting a text at its matches and adding up lengths, in chunks,
so a text with many matches stays cheap. Patterns are written without
backtracking over long runs, with the same matches: a run is tried at its beginning
and behind the last match, nowhere else. Graph rows hold words, not texts; a frequent pattern is
aggregated before it is shuffled, and joins deal its instances to ``SALTS`` keys.

Row cases: null text counts as empty. Every row is scanned alone; equal rows get equal
spans. Copies add no weight to the graph, which counts different instances. An
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versionlink.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MAY_HAVE = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
BLANK = r"\x20\x09-\x0D"
INSTANCE = rf"(?<![^{BLANK}])[^0-9@{BLANK}]*+[0-9@][^{BLANK}]*+"
ROUNDS = 3
CONFIDENT = 0.8
SUPPORT = 3.0
LEAST = 6
FOCUS = 0.5
SALTS = 32
NEAR = 120
CHUNK = 256
# Run lengths of digits and the sign of their class, longest first.
DIGIT_RUNS = ((20, "E"), (16, "D"), (8, "C"), (4, "B"), (1, "A"))


def _matches(text: Column, may: str, pattern: str) -> Column:
    return F.when(text.rlike(may), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(
        F.array().cast("array<string>")
    )


def _placed(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """Replace the matches in column ``name`` by structs of gap, value, start, end and the gap after."""
    gaps, pairs, totals, offsets = (f"_{name}_{k}" for k in ("gaps", "pairs", "totals", "offsets"))
    some = F.size(name) > 0
    df = df.withColumn(gaps, F.when(some, F.split("text", pattern, -1)))
    df = df.withColumn(pairs, F.when(some, F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(name)).alias("gap"), F.col(name).alias("value"),
                     F.slice(gaps, 2, F.size(name)).alias("then")),
        lambda x: F.struct(
            F.right(x["gap"], F.lit(NEAR)).alias("gap"), x["value"].alias("value"),
            F.left(x["then"], F.lit(NEAR)).alias("then"), F.char_length(x["gap"]).alias("skip"),
            F.char_length(x["value"]).alias("length"),
        ),
    ))).drop(gaps)
    chunks = F.sequence(F.lit(0), F.size(pairs) - 1, F.lit(CHUNK))
    df = df.withColumn(totals, F.when(some, F.transform(chunks, lambda c: F.aggregate(
        F.slice(pairs, c + 1, F.lit(CHUNK)), F.lit(0), lambda s, x: s + x["skip"] + x["length"]
    ))))
    df = df.withColumn(offsets, F.when(some, F.aggregate(
        totals, F.array(F.lit(0)), lambda a, t: F.array_append(a, F.element_at(a, -1) + t)
    ))).drop(totals)
    item = "array<struct<gap:string,value:string,then:string,start:int,end:int>>"

    def chunk(c: Column, k: Column) -> Column:
        first = F.struct(F.get(offsets, k).alias("at"), F.array().cast(item).alias("out"))
        return F.aggregate(F.slice(pairs, c + 1, F.lit(CHUNK)), first, lambda a, x: F.struct(
            (a["at"] + x["skip"] + x["length"]).alias("at"),
            F.array_append(a["out"], F.struct(
                x["gap"], x["value"], x["then"], (a["at"] + x["skip"]).alias("start"),
                (a["at"] + x["skip"] + x["length"]).alias("end"),
            )).alias("out"),
        ), lambda a: a["out"])

    spans = F.when(some, F.flatten(F.transform(chunks, chunk))).otherwise(F.array().cast(item))
    return df.withColumn(name, spans).drop(pairs, offsets)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.char_length(digits) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    """Whether a match of ``kind`` counts."""
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    digits = _digits(value)
    if kind == "card":
        return F.char_length(digits).between(16, 19) & _luhn(digits)
    if kind == "phone":
        return F.char_length(digits).between(8, 15)
    return F.lit(True)


def base_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` (null as empty) and per kind the array of its spans (``start``, ``end``, code points)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    for kind in KINDS:
        rows = _placed(rows.withColumn(kind, _matches(F.col("text"), MAY_HAVE[kind], PATTERNS[kind])),
                       kind, PATTERNS[kind])
        rows = rows.withColumn(kind, F.transform(
            F.filter(kind, lambda x: _holds(kind, x["value"])), lambda x: F.struct(x["start"], x["end"])
        ))
    return rows


def _shape(value: Column) -> Column:
    shape = F.lower(value)
    for least, sign in DIGIT_RUNS:
        shape = F.regexp_replace(shape, f"[0-9]{{{least},}}", sign)
    return F.regexp_replace(shape, "[^A-E@.+-]+", "a")


def _instances(rows: DataFrame) -> DataFrame:
    """``instances``: the trimmed words with a digit or ``@``, their place, shape, contexts and whether they are seeds."""
    name = "instances"
    rows = _placed(rows.withColumn(name, _matches(F.col("text"), "[0-9@]", INSTANCE)), name, INSTANCE)
    word = "[\\p{L}\\p{N}]+"

    def instance(x: Column) -> Column:
        lead = F.char_length(F.regexp_extract(x["value"], "^[^0-9A-Za-z+]*", 0))
        value = F.regexp_replace(x["value"], r"^[^0-9A-Za-z+]++|(?:\G|(?<![^0-9A-Za-z]))[^0-9A-Za-z]++$", "")
        start = x["start"] + lead
        return F.struct(
            F.lower(value).alias("value"), start.alias("start"), (start + F.char_length(value)).alias("end"),
            _shape(value).alias("shape"),
            F.regexp_extract(F.lower(x["gap"]), rf"({word})[^\p{{L}}\p{{N}}]*$", 1).alias("before"),
            F.regexp_extract(F.lower(x["then"]), rf"^[^\p{{L}}\p{{N}}]*({word})", 1).alias("after"),
        )

    rows = rows.withColumn(name, F.filter(F.transform(name, instance), lambda x: F.char_length(x["value"]) >= LEAST))
    base = F.concat(*KINDS)
    return rows.withColumn(name, F.transform(name, lambda x: F.struct(
        x["value"], x["start"], x["end"],
        F.exists(base, lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"])).alias("seed"),
        F.transform(F.array(
            F.concat_ws(" ", F.lit("before"), x["before"]), F.concat_ws(" ", F.lit("after"), x["after"]),
            F.concat_ws(" ", F.lit("both"), x["before"], x["after"]),
        ), lambda words: F.struct(words.alias("words"), x["shape"].alias("shape"))).alias("patterns"),
    )))


def _salted(rows: DataFrame, *of: str) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(F.lit("salt"), *of), F.lit(SALTS)))


def _to_salts(patterns: DataFrame) -> DataFrame:
    return patterns.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))


def confident_patterns(
    edges: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT, support: float = SUPPORT, focus: float = FOCUS
) -> DataFrame:
    """``pattern``: those that score high on the graph ``pattern, value, seed``, a pattern being ``words, shape``."""
    edges = stored(_salted(edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "value"))
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    beside = sizes.groupBy(F.col("pattern.words").alias("words")).agg(F.sum("n").alias("all"))
    focused = stored(
        sizes.filter(F.col("n") >= support).withColumn("words", F.col("pattern.words")).join(beside, "words")
        .filter(F.col("n") >= focus * F.col("all")).select("pattern")
    )
    edges = edges.join(_to_salts(focused), ["pattern", "salt"], "left_semi")
    scored = edges.withColumn("score", F.col("seed").cast("double"))
    for turn in range(rounds):
        patterns = scored.groupBy("pattern").agg(
            F.round(F.avg("score"), 9).alias("trust"), F.round(F.sum("score"), 6).alias("worth")
        )
        if turn == rounds - 1:
            break
        patterns = patterns.filter((F.col("worth") >= support) & (F.col("trust") > 0)).select("pattern", "trust")
        values = edges.join(_to_salts(patterns), ["pattern", "salt"]).groupBy("value").agg(
            F.round(1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-9))))), 9).alias("found")
        )
        scored = stored(edges.join(values, "value", "left").withColumn(
            "score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("found", F.lit(0.0)))
        ).drop("found"))
    return patterns.filter((F.col("trust") >= confident) & (F.col("worth") >= support)).select("pattern")


def find_personal(
    docs: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT, support: float = SUPPORT, focus: float = FOCUS
) -> DataFrame:
    """Per row ``doc_id``, the counts of each kind, ``base_sha256`` and ``spans``."""
    found = stored(
        _instances(base_spans(docs)).drop("text").withColumn("row", F.monotonically_increasing_id())
    )  # numbers of rows are fixed by the written table
    each = found.select("row", F.explode("instances").alias("x")).select(
        "row", "x.value", "x.start", "x.end", "x.seed", F.explode("x.patterns").alias("pattern")
    )
    good = confident_patterns(each.select("pattern", "value", "seed"), rounds, confident, support, focus)
    more = _salted(each.filter("not seed"), "row", "start").join(_to_salts(good), ["pattern", "salt"]).groupBy("row").agg(
        F.sort_array(F.collect_set(F.struct("start", "end"))).alias("context")  # of one text
    )
    rows = found.drop("instances").join(more, "row", "left")

    def told(kind: str) -> Column:
        spans = F.coalesce(F.col(kind), F.array().cast("array<struct<start:int,end:int>>"))
        return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    base = F.concat(*map(told, KINDS))
    return rows.select(
        "doc_id", *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS),
        F.greatest(F.size("context"), F.lit(0)).cast("long").alias("n_context"),
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, told("context")), ",").alias("spans"),
    )
