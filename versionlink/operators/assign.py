"""One-to-one assignment by rounds of mutual best pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from versionlink.session import empty_like, keep, settle, union_all

# Rounds whose winners are only subtracted; then the open pairs are written anew.
ROUNDS_PER_CUT = 4


@dataclass(frozen=True)
class Tier:
    """One score column; ``null_safe`` lets a row pass where its whole group has no score."""

    score: str
    largest: bool = True
    null_safe: bool = False


def best_in_group(pairs: DataFrame, key: list[str], score: str, largest: bool = True,
                  null_safe: bool = False) -> DataFrame:
    """Rows that hold the best score of their group.

    The best value is an aggregate with partial results per task, joined back,
    so a hot key does not bring its rows into one window.
    """
    return _best(pairs, [key], Tier(score, largest, null_safe))


def _best(pairs: DataFrame, keys: list[list[str]], tier: Tier) -> DataFrame:
    pick = F.max if tier.largest else F.min
    columns = pairs.columns
    joined, test = pairs, F.lit(True)
    for i, key in enumerate(keys):
        best = pairs.groupBy(*key).agg(pick(tier.score).alias(f"__best{i}"))
        joined = joined.join(best, key)
        score, top = F.col(tier.score), F.col(f"__best{i}")
        test = test & (score.eqNullSafe(top) if tier.null_safe else score == top)
    return joined.where(test).select(*columns)


def mutual_best(pairs: DataFrame, left: list[str], right: list[str], tiers: list[Tier]) -> DataFrame:
    """Pairs best for both sides, tier by tier (each on what the tier before left).

    Every later tier reads the survivors three times, so they are settled first.
    """
    for i, tier in enumerate(tiers):
        pairs = _best(settle(pairs) if i else pairs, [left, right], tier)
    return pairs


def single_on_both(pairs: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """Pairs whose left and right value occur in no other pair.

    One pass counts by left and by right key; a pair that is alone under both
    keys comes out twice.
    """
    sets = [[F.col(c) for c in left], [F.col(c) for c in right]]
    alone = (
        pairs.groupingSets(sets, *left, *right)
        .agg(F.count("*").alias("__n"), F.first(F.struct(*pairs.columns)).alias("__pair"))
        .where("__n = 1").select("__pair.*")
    )
    return alone.groupBy(*pairs.columns).agg(F.count("*").alias("__n")).where("__n = 2").drop("__n")


def unique_mutual_best(pairs: DataFrame, left: list[str], right: list[str], tiers: list[Tier]) -> DataFrame:
    return single_on_both(mutual_best(pairs, left, right, tiers), left, right)


def retire(rows: DataFrame, won: DataFrame, *keys: list[str]) -> DataFrame:
    """Drop rows whose key was won; each key is tested on its own."""
    for key in keys:
        rows = rows.join(won.select(*key), key, "left_anti")
    return rows


def rounds_of_unique_best(pairs: DataFrame, left: list[str], right: list[str], tiers: list[Tier],
                          max_rounds: int | None = None) -> DataFrame:
    """Emit unique mutual best pairs, retire both sides, repeat until nothing is won."""
    if max_rounds == 1:
        return unique_mutual_best(pairs, left, right, tiers)
    rest = keep(pairs)
    won_parts: list[DataFrame] = []
    since_cut: list[DataFrame] = []
    while max_rounds is None or len(won_parts) < max_rounds:
        open_pairs = retire(rest, union_all(since_cut), left, right) if since_cut else rest
        if len(since_cut) >= ROUNDS_PER_CUT:
            rest, since_cut = keep(open_pairs), []
            open_pairs = rest
        won = settle(unique_mutual_best(open_pairs, left, right, tiers))
        if won.isEmpty():
            break
        won_parts.append(won)
        since_cut.append(won.select(*dict.fromkeys([*left, *right])))
    return union_all(won_parts) if won_parts else empty_like(pairs)
