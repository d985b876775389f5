"""Exact verification of candidate links between texts: no pairs within families, no cap."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import HOT_PART, give_back, hot_join, salted_join, saved
from .components import components

#: Texts that are compared with each other in one task; more are compared block by block.
BUCKET = 200
#: Sets that a task keeps for the next pairs.
KEPT_SETS = 500


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets; two empty sets are equal."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.searchsorted(b, a)
    both = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
    return both / (len(a) + len(b) - both)


def _compare(nodes: list, home: list, block: list, texts: list[str], set_of: Callable[[str], np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links between texts that no link joins yet; of two blocks, only those across."""
    sets = [set_of(x) for x in texts]
    up = {r: r for r in home}

    def root(r):
        while up[r] != r:
            up[r] = up[up[r]]
            r = up[r]
        return r

    across, found = len(set(block)) > 1, []
    for i in range(len(nodes)):
        for j in range(i):
            if across and block[i] == block[j]:
                continue
            a, b = root(home[i]), root(home[j])
            small, large = sorted((len(sets[i]), len(sets[j])))
            if a != b and small >= least * large and jaccard(sets[i], sets[j]) >= least:
                up[max(a, b)] = min(a, b)
                found.append((nodes[i], nodes[j]))
    return found


def verified_components(pairs: DataFrame, texts: DataFrame, set_of: Callable[[str], np.ndarray], least: float) -> DataFrame:
    """(node, root) of the components of texts under links that are similar enough by exact Jaccard.

    ``pairs`` is (node, low): candidates, each compared with the one text of its bucket; ``texts`` is (node, text). First
    each node is compared with its low. Then, where the nodes of a low are of several components still, those that
    aren't linked with the low are compared with each other and with those that are, in blocks of BUCKET, and those that
    a new link joins no more; those linked with the low are one component already and never meet. Hot lows are split.
    """
    bucket = BUCKET

    def star(batches):
        sets: dict[str, np.ndarray] = {}

        def known(x):
            if x not in sets:
                if len(sets) >= KEPT_SETS:
                    sets.clear()
                sets[x] = set_of(x)
            return sets[x]

        def near(s, t):
            x, y = known(s), known(t)
            small, large = sorted((len(x), len(y)))
            return small >= least * large and jaccard(x, y) >= least

        for batch in batches:
            good = pa.array([near(s, t) for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([pc.filter(batch.column(0), good), pc.filter(batch.column(1), good)], names=["a", "b"])
        give_back()

    def units(batches):
        def out(rows):
            found = _compare(*(list(x) for x in zip(*rows)), set_of, least)
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        unit, held = None, []
        for batch in batches:
            for low, x, y, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (low, x, y) != unit:
                    if len(held) > 1:
                        yield out(held)
                    unit, held = (low, x, y), []
                held.append(row)
        if len(held) > 1:
            yield out(held)
        give_back()

    lows = texts.select(F.col("node").alias("low"), F.col("text").alias("low_text"))
    hot = pairs.groupBy("low").agg(F.count("*").alias("n")).filter(F.col("n") > max(1.0, HOT_PART * pairs.count())).select("low")
    held = pairs.join(texts, "node").select("low", "node", "text")
    stars = saved(hot_join(held, lows, ["low"], hot=hot).select(F.col("node").alias("a"), F.col("low").alias("b"), "text", "low_text").mapInArrow(star, "a long, b long"))
    roots = saved(components(stars))
    named = roots.withColumnRenamed("node", "__n").withColumnRenamed("root", "__r")
    placed = pairs.join(named, F.col("node") == F.col("__n"), "left").select("low", "node", F.coalesce("__r", "node").alias("root"))
    # the low of a family with links is the least of a component of its own, or has another root
    mine = named.select(F.col("__n").alias("low"), F.col("__r").alias("own"))
    families = placed.groupBy("low").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least != most").select("low")
    families = families.join(mine, "low", "left").select("low", F.coalesce("own", "low").alias("own"))
    apart = saved(salted_join(placed, families, ["low"]).withColumn("side", (F.col("root") == F.col("own")).cast("int")))
    sizes = apart.groupBy("low").agg(*[F.greatest(F.lit(0), F.ceil(F.sum(F.when(F.col("side") == k, 1).otherwise(0)) / bucket)).cast("int").alias(f"k{k}") for k in (0, 1)]).filter("k0 > 0")
    dealt = salted_join(apart, sizes, ["low"])
    # blocks 0 to k0 - 1 hold what isn't linked with the low; they meet each other and all the blocks of what is
    block = F.when(F.col("side") == 0, F.pmod(F.xxhash64("node"), F.col("k0"))).otherwise(F.col("k0") + F.pmod(F.xxhash64("node"), F.greatest(F.col("k1"), F.lit(1)))).cast("int")
    others = F.when(F.col("side") == 0, F.sequence(F.lit(0), F.col("k0") + F.col("k1") - 1)).otherwise(F.sequence(F.lit(0), F.col("k0") - 1))
    meets = F.transform(others, lambda j: F.struct(F.least(j, F.col("block")).alias("x"), F.greatest(j, F.col("block")).alias("y")))
    units_of = dealt.withColumn("block", block).withColumn("unit", F.explode(meets)).select("low", "unit.x", "unit.y", "node", "root", "block")
    rows = units_of.join(texts, "node").select("low", "x", "y", "node", "root", "block", "text")
    more = saved(rows.repartition("low", "x", "y").sortWithinPartitions("low", "x", "y").mapInArrow(units, "a long, b long"))
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
