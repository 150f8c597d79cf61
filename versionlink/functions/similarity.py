"""Similarity and distance measures, as plain Column expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, functions as F

from versionlink.functions.edits import edit_distance


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


# Letters of the two texts from which :func:`distance_of_long` counts in Python.
LONG = 64


def _distances(a: pa.Array, b: pa.Array) -> pa.Array:
    rows = zip(a.to_pylist(), b.to_pylist())
    return pa.array([None if x is None or y is None else edit_distance(x, y) for x, y in rows], pa.int32())


def distance_of_long(a, b) -> Column:
    """Edit distance of texts that are mostly long: Spark's own visits every cell of their table."""
    a, b = _col(a), _col(b)
    # the function is made here, for it needs a session
    python = F.arrow_udf(_distances, "int")
    far = (F.length(a) + F.length(b) >= LONG) & (a != b)
    return F.coalesce(python(F.when(far, a), F.when(far, b)), F.when(~far, F.levenshtein(a, b)))


def edit_similarity_of_long(a, b) -> Column:
    """:func:`edit_similarity` with :func:`distance_of_long`."""
    return edit_similarity(a, b, distance_of_long(a, b))


def edit_similarity(a, b, distance: Column | None = None) -> Column:
    """1 - edit distance / longer length; two empty texts are equal (1.0). ``distance`` is known, or counted here."""
    a, b = _col(a), _col(b)
    longest = F.greatest(F.length(a), F.length(b))
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
        .when(a == b, F.lit(1.0))
        .otherwise(F.lit(1.0) - (F.levenshtein(a, b) if distance is None else distance).cast("double") / longest)
    )


def edit_fraction(a, b) -> Column:
    """Edit distance / longer length, 0 for two empty texts."""
    a, b = _col(a), _col(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, F.lit(0.0)).otherwise(F.levenshtein(a, b).cast("double") / longest)


def overlap_length(a, b, distance: Column | None = None) -> Column:
    """(len a + len b - edit distance) // 2, the length two texts share. ``distance`` is known, or counted here."""
    a, b = _col(a), _col(b)
    shared = F.floor((F.length(a) + F.length(b) - (F.levenshtein(a, b) if distance is None else distance)) / 2)
    return F.when(a == b, F.length(a)).otherwise(shared).cast("bigint")


def length_closeness(a, b) -> Column:
    return -F.abs(F.length(_col(a)) - F.length(_col(b)))


def offset_closeness(a, b) -> Column:
    return -F.abs(_col(a) - _col(b))


def edge_distance(line, before, after) -> Column:
    """Distance of a line to the nearer end of its interval."""
    return F.least(_col(line) - _col(before), _col(after) - _col(line))


def word_share(word, a, b) -> Column:
    """Weight of one shared word in a pair of texts."""
    return F.length(_col(word)) / F.greatest(F.length(_col(a)), F.length(_col(b)))


def _dotted(text: Column) -> Column:
    # A trailing dot ends a token, it does not start an empty one.
    parts = F.split(F.regexp_replace(text, r"\.\z", ""), r"\.")
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(parts)


def suffix_distance(a, b) -> Column:
    """Distance of two dotted suffixes, token by token.

    Two numbers differ by their gap (a base-100 digit of the small part),
    different texts cost 2, a surplus text 1, a surplus number its value.
    """
    number = lambda t: F.when(t.rlike(r"\A[0-9]+\z"), t.cast("double"))

    def step(acc, pair):
        x, y = pair["0"], pair["1"]
        nx, ny = number(x), number(y)
        surplus = x.isNull() | y.isNull()
        shift = F.when(surplus, F.coalesce(nx, ny)).otherwise(F.abs(nx - ny))
        cost = (
            F.when(shift.isNotNull(), F.lit(0.0))
            .when(surplus, F.lit(1.0))
            .when(x != y, F.lit(2.0))
            .otherwise(F.lit(0.0))
        )
        num = F.when(shift.isNotNull(), acc["num"] * 100 + shift).otherwise(acc["num"])
        return F.struct((acc["text"] + cost).alias("text"), num.alias("num"))

    start = F.struct(F.lit(0.0).alias("text"), F.lit(0.0).alias("num"))
    pairs = F.zip_with(
        _dotted(_col(a)), _dotted(_col(b)),
        lambda x, y: F.struct(x.alias("0"), y.alias("1")),
    )
    return F.aggregate(pairs, start, step, lambda acc: acc["text"] + acc["num"] * 1e-12)


def name_distance(context_a, context_b, base_a, base_b, params_a, params_b, suffix_a, suffix_b) -> Column:
    """(name, parameters, suffix) distance; far names make parameters count half."""
    name = (edit_fraction(context_a, context_b) + edit_fraction(base_a, base_b)) / 2
    params = edit_fraction(params_a, params_b)
    far = name > 0.5
    return F.struct(
        F.when(far, F.lit(1.0)).otherwise(name).alias("name"),
        F.when(far, (params + 1.0) / 2).otherwise(params).alias("params"),
        suffix_distance(suffix_a, suffix_b).alias("suffix"),
    )


def without_parameters(name, other) -> Column:
    """Cut a parameter list off ``name`` when ``other`` does not end with one."""
    name, other = _col(name), _col(other)
    return F.when(other.endswith(")"), name).otherwise(F.substring_index(name, "(", 1))


def call_distance(old, new) -> Column:
    """(edit distance, 2*distance - lengths) of two names, cut when only one has parameters."""
    old = _col(old)
    cut = without_parameters(new, old)
    distance = F.levenshtein(old, cut)
    return F.struct(
        distance.alias("distance"),
        (2 * distance - F.length(old) - F.length(cut)).alias("tie"),
    )
