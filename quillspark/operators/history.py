"""Versions of memories as half-open intervals: building, reading as of a time, erasing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import bridge, remove_touching


def scd2(writes: DataFrame) -> DataFrame:
    """Intervals from writes (memory_id, version, at, seq, content): a version's last write counts, from its first time.

    ``valid_to`` is the next version's ``valid_from``; null while a version is open.
    """
    one = writes.groupBy("memory_id", "version").agg(F.max_by("content", F.struct("at", "seq")).alias("content"), F.min("at").alias("valid_from"))
    w = Window.partitionBy("memory_id").orderBy("version")
    return one.withColumn("valid_to", F.lead("valid_from").over(w))


def as_of(versions: DataFrame, at: Column) -> DataFrame:
    """Newest version of each memory that holds at a time; none before its first."""
    held = versions.filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (at < F.col("valid_to"))))
    w = Window.partitionBy("memory_id").orderBy(F.col("version").desc())
    return held.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def as_of_each(versions: DataFrame, questions: DataFrame) -> DataFrame:
    """As-of join: (qid, memory_id, at) each with the version that holds then; versions of a memory don't overlap.

    Questions and versions are one table, sorted once by memory and time, in which the last version is carried forward: the
    work is linear in both, however many versions a memory has. Questions before the first version, or in a gap, go.
    """
    names = [c for c in versions.columns if c != "memory_id"]
    asked = [c for c in questions.columns if c != "memory_id"]
    version, question = F.struct(*names), F.struct(*asked)
    none = lambda df, columns: F.lit(None).cast(df.select(F.struct(*columns).alias("s")).schema["s"].dataType)
    one = versions.filter("memory_id is not null and valid_from is not null").select("memory_id", F.col("valid_from").alias("__t"), F.lit(0).alias("__k"), F.col("version").alias("__v"), version.alias("__version"), none(questions, asked).alias("__q"))
    two = questions.filter("memory_id is not null and at is not null").select("memory_id", F.col("at").alias("__t"), F.lit(1).alias("__k"), F.lit(None).cast(versions.schema["version"].dataType).alias("__v"), none(versions, names).alias("__version"), question.alias("__q"))
    order = Window.partitionBy("memory_id").orderBy("__t", "__k", "__v").rowsBetween(Window.unboundedPreceding, 0)
    carried = one.unionByName(two).withColumn("__version", F.last("__version", ignorenulls=True).over(order)).filter("__k = 1 and __version is not null")
    rows = carried.select("memory_id", *[F.col(f"__q.{c}").alias(c) for c in asked], *[F.col(f"__version.{c}").alias(c) for c in names])
    return rows.filter(F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))


def live_view(log: DataFrame) -> DataFrame:
    """Current rows of a change log (id, version, seq, deleted, ...): the last write of each id, unless a deletion."""
    w = Window.partitionBy("id").orderBy(F.col("version").desc(), F.col("seq").desc())
    return log.withColumn("__n", F.row_number().over(w)).filter("__n = 1 and not deleted").drop("__n")


def erase_report(versions: DataFrame, edges: DataFrame, memories: DataFrame, erased: DataFrame) -> DataFrame:
    """One row: memories, versions and edges that erasing the ids removes, and supersession edges that it bridges."""
    ids = erased.select("id")
    m = memories.join(ids, "id", "left_semi").agg(F.count("*").alias("memories"))
    v = versions.join(ids.withColumnRenamed("id", "memory_id"), "memory_id", "left_semi").agg(F.count("*").alias("versions"))
    src, dst = ids.select(F.col("id").alias("source_id"), F.lit(1).alias("s")), ids.select(F.col("id").alias("target_id"), F.lit(1).alias("t"))
    e = edges.join(src, "source_id", "left").join(dst, "target_id", "left").filter("s = 1 or t = 1").agg(F.count("*").alias("edges"))
    b = bridge(edges, ids).agg(F.count("*").alias("bridged"))
    return m.join(F.broadcast(v)).join(F.broadcast(e)).join(F.broadcast(b))


def erase(memories: DataFrame, versions: DataFrame, edges: DataFrame, erased: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Memories, versions and edges without the erased ids; their supersession chains are bridged first."""
    ids = erased.select("id")
    made = bridge(edges, ids).withColumn("created_at", F.lit(None).cast(edges.schema["created_at"].dataType))
    kept = remove_touching(edges.unionByName(made.select(edges.columns)), ids)
    return memories.join(ids, "id", "left_anti"), versions.join(ids.withColumnRenamed("id", "memory_id"), "memory_id", "left_anti"), kept


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Current rows with the incoming ones in place of those of their keys; columns as in ``current``.

    Of several incoming rows of a key that with the highest ``order`` (version, if not given) counts; where the current
    row's is higher it stays. Null keys never meet.
    """
    keys, order = keys or ["id"], order or ["version"]
    both = current.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order], F.col("__new").desc(), F.xxhash64(*[c for c in current.columns if "map<" not in current.schema[c].dataType.simpleString()]))
    known = F.lit(True)
    for c in keys:
        known &= F.col(c).isNotNull()
    return both.withColumn("__n", F.row_number().over(w)).filter((F.col("__n") == 1) | ~known).select(current.columns)
