"""Connected components of an edge table by alternating large-star and small-star contraction.

Works on edges only, in DataFrame joins and aggregates with map-side combine; no node's neighbours are collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import HOT_PART, drop_saved, local_roots, saved

#: Edges that one task settles by itself (some 100 MB); with more, rounds of contraction go on.
ONE_TASK = 1_000_000


def _star(edges: DataFrame, large: bool, hubs: list[int]) -> DataFrame:
    """One contraction: each node's larger (or smaller) neighbours are linked to its smallest neighbour.

    Edges of ``hubs`` meet their smallest neighbour by a broadcast of these few rows, so no task gets a hub's edges.
    """
    both = edges.union(edges.select(F.col("b"), F.col("a"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    if hubs:
        hub = F.col("a").isin(hubs)
        linked = both.filter(~hub).join(lowest.filter(~hub), "a").union(both.filter(hub).join(F.broadcast(lowest.filter(hub)), "a"))
    else:
        linked = both.join(lowest, "a")
    moved = linked.filter("b > a" if large else "b <= a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.union(lowest.select("a", F.col("m").alias("b")))
    return moved.filter("a != b").distinct()


def _state(edges: DataFrame, number: int) -> tuple[bool, list[int]]:
    """Whether all edges, from the larger to the smaller node, are stars (no node has two, or is both leaf and centre),
    and the hubs: nodes with over HOT_PART of the edges, of which there are fewer than 2 / HOT_PART."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("b", F.lit(0), F.lit(1)))
    seen = ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("into").alias("into"), F.count("*").alias("edges"))
    row = seen.agg(F.max(F.expr("out > 1 or (out = 1 and into = 1)")).alias("open"), F.collect_list(F.when(F.col("edges") > max(number * HOT_PART, 2), F.col("n"))).alias("hubs")).first()
    return not row["open"], row["hubs"]


def _settle(batches):
    """(node, root) of the components of a bounded number of edges."""
    ends = [np.stack([np.asarray(x.column(0)), np.asarray(x.column(1))]) for x in batches if x.num_rows]
    if ends:
        a, b = np.concatenate(ends, axis=1)
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = nodes[local_roots(len(nodes), at[: len(a)], at[len(a) :])]
        for lo in range(0, len(nodes), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[lo : lo + 65536]), pa.array(root[lo : lo + 65536])], names=["node", "root"])


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node reachable.

    Self-loops and edges with a null end are ignored; an empty edge table gives no rows. The number of rounds grows
    with the square of the logarithm of the largest component; each round's edges are written to shared storage. Where
    at most ``one_task`` edges are left, or come, one task of bounded size settles them; the result is the same.
    """
    kept = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null and a != b").distinct()
    now = saved(kept.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    for _ in range(most_rounds):
        number = now.count()
        if number <= one_task:
            return now.repartition(1).mapInArrow(_settle, "node long, root long")
        done, hubs = _state(now, number)
        if done:
            break
        after = saved(_star(_star(now, True, hubs), False, hubs))
        drop_saved(now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.groupBy("a").agg(F.min("b").alias("root"))
    own = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return roots.select(F.col("a").alias("node"), "root").union(own)
