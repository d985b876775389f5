"""Retrieval quality as Column expressions over ranked id lists, intervals and tests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _top(found: Column, k: int) -> Column:
    return F.slice(F.array_distinct(found), 1, k)


def recall_at(found: Column, gold: Column, k: int) -> Column:
    """Share of the gold ids among the first ``k``; each id counts at its best rank."""
    return F.size(F.array_intersect(_top(found, k), gold)) / F.size(F.array_distinct(gold))


def full_recall_at(found: Column, gold: Column, k: int) -> Column:
    """1 if all gold ids are among the first ``k``."""
    return (F.size(F.array_except(gold, _top(found, k))) == 0).cast("double")


def hit_at(found: Column, gold: Column, k: int) -> Column:
    """1 if some gold id is among the first ``k``."""
    return (F.size(F.array_intersect(_top(found, k), gold)) > 0).cast("double")


def _gains(found: Column, gold: Column, k: int) -> Column:
    return F.transform(_top(found, k), lambda x, i: F.when(F.array_contains(gold, x), i + 1))


def reciprocal_rank(found: Column, gold: Column, k: int) -> Column:
    """One over the rank of the first gold id, 0 without one."""
    return F.coalesce(F.lit(1.0) / F.array_min(_gains(found, gold, k)), F.lit(0.0))


def _discount(rank: Column) -> Column:
    return F.log(F.lit(2.0)) / F.log(rank + F.lit(1.0))


def ndcg_at(found: Column, gold: Column, k: int) -> Column:
    """Discounted gain of gold ids over that of the best order; an id counts once, so 1 is the most."""
    add = lambda s, x: s + x
    gain = F.aggregate(F.transform(F.filter(_gains(found, gold, k), lambda r: r.isNotNull()), lambda r: _discount(r)), F.lit(0.0), add)
    best = F.aggregate(F.transform(F.sequence(F.lit(1), F.least(F.size(F.array_distinct(gold)), F.lit(k))), lambda r: _discount(r)), F.lit(0.0), add)
    return gain / best


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson interval of a share."""
    p, zz = successes / n, z * z
    middle, half = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)


def by_category(rows: DataFrame, category: str = "category", digits: int = 4) -> DataFrame:
    """(category, n, full_recall, full_low, full_high, hit, mrr) of rows (full_recall, hit, mrr), with Wilson's interval of full recall."""
    mean = lambda c: F.round(F.avg(c), digits).alias(c)
    table = rows.groupBy(category).agg(F.count("*").alias("n"), F.sum("full_recall").alias("good"), mean("full_recall"), mean("hit"), mean("mrr"))
    low, high = wilson(F.col("good"), F.col("n"))
    return table.select(category, "n", "full_recall", F.round(low, digits).alias("full_low"), F.round(high, digits).alias("full_high"), "hit", "mrr")


def sign_test(wins: int, losses: int) -> float:
    """Exact two-sided probability that a fair coin is as uneven."""
    n = wins + losses
    if not n:
        return 1.0
    tail = sum(math.comb(n, i) for i in range(min(wins, losses) + 1)) / 2**n
    return min(1.0, 2 * tail)
