"""Batch ingest: from new texts to memories, chunks, vectors, relations and versions, set by set."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunking import chunk_memories
from ..functions.embed import Embedder, contextual, embed
from ..functions.entities import entities
from ..functions.text import content_hash, normalize
from ..operators import consolidate as C
from ..operators.claims import confirm
from ..operators.graph import link
from ..operators.keep_first import dropped_by_first
from ..operators.synth import Completer
from ..storage import stored

#: Most bytes of one memory, neighbours that each new memory is compared with.
MOST_BYTES, NEIGHBOURS = 1_000_000, 64


@dataclass(frozen=True)
class Space:
    """What is stored of a space: memories (id, content, source, kind, status, occurred_at, tags, version), chunks
    (memory_id, ordinal, text, embedding), edges (source_id, target_id, type, confidence, created_at)."""

    memories: DataFrame
    chunks: DataFrame
    edges: DataFrame


@dataclass(frozen=True)
class Ingested:
    """The space after a batch, and what became of each new row: (id, outcome, into)."""

    space: Space
    report: DataFrame


def ingest(space: Space, batch: DataFrame, embedder: Embedder, now: datetime, adjudicator: Completer | None = None) -> Ingested:
    """Takes in a bounded batch (id, content, source, occurred_at, tags), as if its rows came one by one in order of id.

    Order: normalise, size limit, exact duplicates (of the store, then of earlier rows of the batch), chunks, vectors,
    near duplicates, proposals of supersession (applied only if the adjudicator confirms), contradictions and
    associations. Duplicates count the kept memory's version up.

    A row is a near duplicate if the store, or an earlier row that was kept, is near it: the first independent set of the
    graph of near rows is kept (``dropped_by_first``), each other row goes into the nearest kept one before it. A kept row is
    compared with the NEIGHBOURS nearest memories before it, stored or of the batch; one that an earlier row has superseded
    is no longer active for it.
    """
    clean = batch.withColumn("content", normalize(F.col("content"))).withColumn("sha", content_hash(F.col("content")))
    clean = stored(clean.withColumn("outcome", F.when(F.coalesce(F.col("content"), F.lit("")) == "", "empty").when(F.octet_length("content") > MOST_BYTES, "too_large")))
    fine = clean.filter("outcome is null").drop("outcome")
    have = space.memories.filter("status <> 'archived'").select(content_hash(F.col("content")).alias("sha"), F.col("id").alias("into")).groupBy("sha").agg(F.min("into").alias("into"))
    firsts = fine.groupBy("sha").agg(F.min("id").alias("first"))
    met = stored(fine.join(firsts, "sha").join(have, "sha", "left"))
    repeats = met.filter("into is not null or id <> first").select("id", "first", "into")
    new = met.filter("into is null and id = first").drop("first", "into")
    pieces = chunk_memories(new).join(new.select(F.col("id").alias("memory_id"), "occurred_at", "source", "tags"), "memory_id")
    headed = pieces.withColumn("headed", contextual(F.concat_ws("\n", F.nullif("context", F.lit("")), F.col("text")), F.col("occurred_at"), F.lit(None).cast("string"), F.col("source").cast("string"), F.col("tags")))
    chunks = stored(embed(headed, "headed", embedder).select("memory_id", "ordinal", "text", "embedding"))
    columns = ["id", "content", "source", "kind", "status", "occurred_at", "tags", "version"]
    fresh = new.select("id", "content", "source", F.lit("episodic").alias("kind"), F.lit("active").alias("status"), "occurred_at", "tags", F.lit(1).alias("version"))
    both = space.memories.select(columns).unionByName(fresh)
    pairs = stored(_before(space, new, chunks))
    twins = _twins(pairs, both)
    kept = fresh.join(twins, "id", "left_anti")
    near = pairs.join(kept.select(F.col("id").alias("new_id")), "new_id", "left_semi").join(twins.select(F.col("id").alias("old_id")), "old_id", "left_anti")
    nearest = Window.partitionBy("new_id").orderBy(F.col("sim").desc(), "old_id")
    band = stored(near.withColumn("__n", F.row_number().over(nearest)).filter(F.col("__n") <= NEIGHBOURS).select("new_id", "old_id", "sim"))
    replaced = confirm(C.supersessions(band, both), both, adjudicator).filter("confirmed")
    by_first = Window.partitionBy("old_id").orderBy("new_id")
    replaced = stored(replaced.withColumn("__n", F.row_number().over(by_first)).filter("__n = 1").drop("__n"))
    ended = replaced.select("old_id", F.col("new_id").alias("__by"))
    live = band.join(ended, "old_id", "left").filter("__by is null or new_id <= __by").drop("__by")
    clash = C.contradictions(live, both).select(F.col("left_id").alias("new_id"), F.col("right_id").alias("old_id"), "confidence")
    clash = clash.join(replaced, ["new_id", "old_id"], "left_anti")
    met_ids = band.select(F.col("new_id").alias("id")).union(band.select("old_id")).distinct()
    named = stored(entities(both.join(met_ids, "id", "left_semi").select("id", "content"), "content").select("id", "entities"))
    about = C.associations(live, both, named).select(F.col("left_id").alias("new_id"), F.col("right_id").alias("old_id"), "confidence")
    edge = lambda rows, kind: rows.select(F.col("new_id").alias("source_id"), F.col("old_id").alias("target_id"), F.lit(kind).alias("type"), "confidence", F.lit(now).alias("created_at"))
    edges = stored(edge(replaced, "supersedes").unionByName(edge(clash, "contradicts")).unionByName(edge(about, "references")))
    # a repeat of a row that went into another goes there too, as a near duplicate of it
    through = twins.select(F.col("id").alias("first"), F.col("into").alias("__twin"))
    again = repeats.join(through, "first", "left").select("id", F.when(F.col("into").isNull() & F.col("__twin").isNotNull(), "near_duplicate").otherwise("duplicate").alias("outcome"), F.coalesce("into", "__twin", "first").alias("into"))
    gone = again.unionByName(twins)
    merged = gone.groupBy(F.col("into").alias("id")).agg(F.count("*").cast("int").alias("__more"))
    counted = space.memories.select(columns).unionByName(kept).join(merged, "id", "left").withColumn("version", F.col("version") + F.coalesce("__more", F.lit(0))).drop("__more")
    memories, after = link(counted, space.edges, edges)
    report = clean.filter("outcome is not null").select("id", "outcome", F.lit(None).cast(batch.schema["id"].dataType).alias("into")).unionByName(gone)
    report = report.unionByName(kept.select("id", F.lit("created").alias("outcome"), F.col("id").alias("into")))
    own = chunks.join(kept.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
    return Ingested(Space(stored(memories), space.chunks.unionByName(own), stored(after)), stored(report))


def _before(space: Space, new: DataFrame, chunks: DataFrame) -> DataFrame:
    """(new_id, old_id, sim): each new row's first vector with those of the stored memories and of earlier rows, from the least similarity that any rule asks for."""
    first = chunks.filter("ordinal = 0").select(F.col("memory_id").alias("id"), "embedding")
    there = space.memories.filter("status <> 'archived'").select(F.col("id").alias("memory_id"))
    held = space.chunks.select("memory_id", "embedding").join(there, "memory_id", "left_semi").select(F.col("memory_id").alias("id"), "embedding")
    stored_pairs = C.similar_pairs(first, held, C.ASSOCIATE_LOW, None)
    own = C.similar_pairs(first, chunks.select(F.col("memory_id").alias("id"), "embedding"), C.ASSOCIATE_LOW, None).filter("old_id < new_id")
    return stored_pairs.unionByName(own).groupBy("new_id", "old_id").agg(F.max("sim").alias("sim"))


def _twins(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, outcome, into) of new rows that are near duplicates of what was kept before them."""
    near = stored(C.allowed_duplicates(pairs.filter(F.col("sim") >= C.DUPLICATE), texts))
    fresh = pairs.select(F.col("new_id").alias("old_id")).distinct()
    old = near.join(fresh, "old_id", "left_anti").select("new_id").distinct()
    among = near.join(fresh, "old_id", "left_semi")
    open_ = among.join(old, "new_id", "left_anti").join(old.withColumnRenamed("new_id", "old_id"), "old_id", "left_anti")
    gone = stored(old.union(dropped_by_first(open_.select(F.col("old_id").alias("first"), F.col("new_id").alias("later")))).distinct())
    into = near.join(gone, "new_id", "left_semi").join(gone.withColumnRenamed("new_id", "old_id"), "old_id", "left_anti")
    return stored(C.near_duplicates(into).select(F.col("new_id").alias("id"), F.lit("near_duplicate").alias("outcome"), F.col("old_id").alias("into")))
