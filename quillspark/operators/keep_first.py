"""Keep-first over a graph of likeness: a row stays unless a row before it, which stays, is like it; found by rounds, not row by row."""

from __future__ import annotations

from collections import defaultdict, deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..storage import stored

#: Edges that one task settles.
ONE_TASK = 1_000_000
#: Rows of a key up to which each is compared with each; a key with more goes by shared words.
MOST_PAIRED = 64


def _settled(edges: DataFrame) -> DataFrame:
    """(node) of what goes, for few edges: nodes are decided in order, each once all before it are."""
    schema = edges.select(F.col("later").alias("node")).schema
    kind = to_arrow_type(schema["node"].dataType)

    def run(batches):
        after, waits, gone, nodes = defaultdict(list), defaultdict(int), set(), set()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                after[a].append(b)
                waits[b] += 1
                nodes.update((a, b))
        ready = deque(n for n in nodes if not waits[n])
        while ready:
            n = ready.popleft()
            for b in after[n]:
                if n not in gone:
                    gone.add(b)
                waits[b] -= 1
                if not waits[b]:
                    ready.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(list(gone), kind)], names=["node"])

    return edges.select("first", "later").repartition(1).mapInArrow(run, schema)


def dropped_by_first(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node) of the rows that go, from edges (first, later): each joins two like rows, in the order in which rows come.

    The lexicographically first independent set of the graph stays. In a round, rows that no undecided row comes before
    stay, and what is like them goes with its edges; the last ``one_task`` edges are settled by one task, so a chain of any length
    takes no more rounds. Edges must follow one order, so they have no cycles.
    """
    left = stored(edges.select("first", "later").distinct())
    gone = None
    while True:
        number = left.count()
        if number <= one_task:
            last = _settled(left)
            return last if gone is None else gone.union(last)
        stays = left.select(F.col("first").alias("node")).distinct().join(left.select(F.col("later").alias("node")), "node", "left_anti")
        goes = stored(left.join(stays.withColumnRenamed("node", "first"), "first", "left_semi").select(F.col("later").alias("node")).distinct())
        kept = left.join(stays.withColumnRenamed("node", "first"), "first", "left_anti").join(goes.withColumnRenamed("node", "first"), "first", "left_anti")
        left = stored(kept.join(goes.withColumnRenamed("node", "later"), "later", "left_anti").select("first", "later"))
        gone = goes if gone is None else gone.union(goes)


def alike_sets(rows: DataFrame, keys: list[str], order: list[str], words: Column, least: float) -> DataFrame:
    """(first, later): ids of rows whose word sets are alike by Jaccard ``least`` or more, within equal ``keys``, in order.

    Up to MOST_PAIRED rows of a key are compared each with each, so sets are sent once a row and not once a word. Keys with
    more go by ``_met_by_words``. Sets must be distinct within the keys; empty ones are like none. ``rows`` is read several times.
    """
    sets = rows.select(*keys, F.struct(*order, "id").alias("o"), "id", F.array_sort(F.array_distinct(words)).alias("w")).filter("size(w) > 0")
    large = stored(sets.groupBy(*keys).count().filter(F.col("count") > MOST_PAIRED).select(*keys))
    near = (F.col("n1") >= least * F.col("n2") - 1e-9) & (F.col("n2") >= least * F.col("n1") - 1e-9)
    shared = F.size(F.array_intersect("w1", "w2"))
    alike = shared / (F.col("n1") + F.col("n2") - shared) >= least
    sides = lambda df: [df.select(*keys, F.col("o").alias(f"o{i}"), F.size("w").alias(f"n{i}"), F.col("w").alias(f"w{i}"), F.col("id").alias(c)) for i, c in ((1, "first"), (2, "later"))]
    if large.isEmpty():
        a, b = sides(sets)
        return a.join(b, keys).filter((F.col("o1") < F.col("o2")) & near & alike).select("first", "later")
    a, b = sides(sets.join(large, keys, "left_anti"))
    few = a.join(b, keys).filter((F.col("o1") < F.col("o2")) & near & alike).select("first", "later")
    many = sets.join(large, keys, "left_semi")
    one, two = (side.drop(*keys, "o1", "o2") for side in sides(many))
    return few.union(_met_by_words(many, keys, near, least).join(one, "first").join(two, "later").filter(alike).select("first", "later"))


def _met_by_words(sets: DataFrame, keys: list[str], near: Column, least: float) -> DataFrame:
    """(first, later) of sets (keys, o, id, w) that may be alike by ``least``.

    Prefix filter: with words from rare to common, two sets that are so alike share one of the first n - ceil(least n) + 1
    words of each. Only rows that share one are compared.
    """
    each = sets.select(*keys, "id", F.explode("w").alias("word"))
    common = each.groupBy(*keys, "word").agg(F.count("*").alias("n"))
    ranked = each.join(common, [*keys, "word"]).groupBy(*keys, "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "word"))), lambda x: x["word"]).alias("p"))
    size = F.size("p")
    prefixes = ranked.select(*keys, "id", F.explode(F.slice("p", F.lit(1), (size - F.ceil(size * least - 1e-9) + 1).cast("int"))).alias("word"))
    met = stored(prefixes.join(sets.select(*keys, "id", "o", F.size("w").alias("n")), [*keys, "id"]))
    a = met.select(*keys, "word", F.col("o").alias("o1"), F.col("n").alias("n1"), F.col("id").alias("first"))
    b = met.select(*keys, "word", F.col("o").alias("o2"), F.col("n").alias("n2"), F.col("id").alias("later"))
    return a.join(b, [*keys, "word"]).filter((F.col("o1") < F.col("o2")) & near).select("first", "later").distinct()


def first_of_alike(rows: DataFrame, keys: list[str], order: list[str], words: Column, least: float) -> DataFrame:
    """Rows of which no kept row before them, by ``order`` within equal ``keys``, has a word set alike by Jaccard ``least``; columns as given.

    The order must tell rows of a key apart. Null keys are keys like any. Rows of one set of words are one node: all but the first go.
    """
    named = rows.withColumn("__words", F.array_sort(F.array_distinct(F.coalesce(words, F.array().cast("array<string>")))))
    named = named.withColumn("__key", F.to_json(F.struct(*keys)))
    named = stored(named.withColumn("__id", F.sha2(F.concat_ws("\x00", "__key", F.array_join("__words", "\x01")), 256)))
    first = F.row_number().over(Window.partitionBy("__key", "__id").orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    nodes = named.withColumn("__n", first).filter("__n = 1").select("__key", F.col("__id").alias("id"), *[F.col(c).alias(f"__o_{c}") for c in order], "__words")
    nodes = stored(nodes)
    edges = alike_sets(nodes, ["__key"], [f"__o_{c}" for c in order], F.col("__words"), least)
    kept = nodes.join(dropped_by_first(edges).withColumnRenamed("node", "id"), "id", "left_anti").select("__key", *[f"__o_{c}" for c in order])
    same = named["__key"] == kept["__key"]
    for c in order:
        same &= named[c].eqNullSafe(kept[f"__o_{c}"])
    return named.join(kept, same, "left_semi").select(rows.columns)
