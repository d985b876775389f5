"""Derived answers that went stale are derived again: what others stand on first, under a budget, each in place of the last one."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .graph import add_edges
from .synth import Completer, complete

INSTRUCTION = "Answer the question from the statements below it, by one sentence. Reply with nothing if they do not hold the answer."


def former_answers(made: DataFrame, memories: DataFrame) -> DataFrame:
    """(new_id, old_id): active derived answers to the question of a new one (id, question), which it takes the place of."""
    old = memories.filter("kind = 'derived' and status = 'active' and question is not null").select(F.col("id").alias("old_id"), "question")
    return made.select(F.col("id").alias("new_id"), "question").join(old, "question").filter("new_id <> old_id").select("new_id", "old_id")


def replace_answers(memories: DataFrame, edges: DataFrame, made: DataFrame, pairs: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """(memories, edges) with new answers, and the old ones of ``pairs`` (new_id, old_id) superseded by them."""
    old = pairs.select(F.col("old_id").alias("id"), F.lit(True).alias("__hit")).distinct()
    hit = F.coalesce("__hit", F.lit(False))
    moved = memories.join(old, "id", "left").withColumns({"status": F.when(hit, "superseded").otherwise(F.col("status")), "version": F.col("version") + hit.cast("int")}).drop("__hit")
    fresh = made.join(memories.select("id"), "id", "left_anti")
    known = memories.columns
    filled = fresh.select([F.col(c) if c in fresh.columns else F.lit(None).cast(memories.schema[c].dataType).alias(c) for c in known])
    link = pairs.select(F.col("new_id").alias("source_id"), F.col("old_id").alias("target_id"), F.lit("supersedes").alias("type"), F.lit(1.0).alias("confidence"), F.lit(now).cast("timestamp").alias("created_at"))
    return moved.select(known).unionByName(filled), add_edges(edges, link.select(edges.columns))


def rederive(memories: DataFrame, edges: DataFrame, completer: Completer | None, budget: int, now: datetime, instruction: str = INSTRUCTION) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(memories, edges, report) after stale derived memories (with a ``question``) were derived again, ``budget`` of them at most.

    A round takes those that stand on no stale one that is still to come, in order of id: so answers that others are
    derived from come first, and these see the new ones. An answer is asked for from the contents of what the old one was derived
    from; where that has been replaced, from what replaced it. The new answer takes the old one's place: it supersedes it,
    and is derived from the evidence. One that comes out word by word as before is active again. Where a model gives none,
    the old one stays stale, and so does what stands on it. ``report`` is (id, outcome, into).
    """
    stale = "kind = 'derived' and status = 'stale' and question is not null"
    waiting = stored(memories.filter(stale).select("id"))
    reports, left = None, budget
    while left > 0:
        on = edges.filter("type = 'derived_from'").select(F.col("source_id").alias("id"), F.col("target_id").alias("of"))
        held_up = on.join(waiting.withColumnRenamed("id", "of"), "of", "left_semi").select("id").distinct()
        if reports is not None:  # what stands on an answer that failed waits for another time
            failed = reports.filter("outcome = 'no_answer'").select(F.col("id").alias("of"))
            held_up = held_up.unionByName(on.join(failed, "of", "left_semi").select("id")).distinct()
        ready = stored(waiting.join(held_up, "id", "left_anti").orderBy("id").limit(left))
        number = ready.count()
        if not number:
            break
        left -= number
        heads = edges.filter("type = 'supersedes'").select(F.col("target_id").alias("of"), F.col("source_id").alias("by"))
        latest = heads.groupBy("of").agg(F.max("by").alias("by"))
        evidence = stored(on.join(ready, "id", "left_semi").join(latest, "of", "left").select("id", F.coalesce("by", "of").alias("of")).distinct())
        said = evidence.join(memories.select(F.col("id").alias("of"), "content"), "of").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("of", "content"))), lambda x: F.concat(F.lit("- "), x["content"])), "\n").alias("said"))
        asked = memories.join(ready, "id", "left_semi").select("id", "question", F.col("content").alias("was")).join(said, "id", "left")
        replied = stored(complete(asked.withColumn("prompt", F.concat_ws("\n\n", F.lit(instruction), F.col("question"), F.col("said"))), "prompt", completer).select("id", "question", "was", F.nullif(F.btrim("reply"), F.lit("")).alias("answer")))
        key = F.concat(F.lit("drv_"), F.substring(F.sha2(F.concat_ws("|", "question", "answer", F.array_join("evidence", ",")), 256), 1, 26))
        proofs = evidence.groupBy("id").agg(F.array_sort(F.collect_list(F.col("of").cast("string"))).alias("evidence"))
        judged = stored(replied.join(proofs, "id", "left").withColumn("outcome", F.when(F.col("answer").isNull(), "no_answer").when(F.col("answer") == F.col("was"), "confirmed").otherwise("replaced")).withColumn("into", F.when(F.col("outcome") == "replaced", key)))
        new = judged.filter("outcome = 'replaced'")
        made = new.groupBy(F.col("into").alias("id")).agg(F.min("answer").alias("content"), F.min("question").alias("question")).withColumns({"kind": F.lit("derived"), "status": F.lit("active"), "version": F.lit(1), "occurred_at": F.lit(now).cast("timestamp")})
        same = judged.filter("outcome = 'confirmed'").select("id", F.lit(True).alias("__same"))
        again = F.coalesce("__same", F.lit(False))
        memories = memories.join(same, "id", "left").withColumns({"status": F.when(again, "active").otherwise(F.col("status")), "version": F.col("version") + again.cast("int")}).drop("__same")
        memories, edges = replace_answers(memories, edges, made, new.select(F.col("into").alias("new_id"), F.col("id").alias("old_id")), now)
        from_ = new.select("id", "into").join(evidence, "id").select(F.col("into").alias("source_id"), F.col("of").alias("target_id"), F.lit("derived_from").alias("type"), F.lit(1.0).alias("confidence"), F.lit(now).cast("timestamp").alias("created_at"))
        memories, edges = stored(memories), stored(add_edges(edges, from_.distinct().select(edges.columns)))
        report = judged.select("id", "outcome", "into")
        reports = stored(report if reports is None else reports.unionByName(report))
        waiting = stored(waiting.join(ready, "id", "left_anti"))
    return memories, edges, reports if reports is not None else waiting.select("id", F.lit(None).cast("string").alias("outcome"), F.lit(None).cast("string").alias("into")).limit(0)
