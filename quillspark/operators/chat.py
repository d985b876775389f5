"""Grounded chat for a batch of questions: numbered memories in a prompt, a reply by a model, and what it cites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .synth import Completer, complete

# Fixed values -------------------------------------------------------------------------------------------------------

MOST_CHARS, MOST_TURNS = 4_000, 8
CUT_MARK = " […truncated]"
UNSURE = ["unverified", "low", "unsure"]
CITATION = r"\[(\d{1,3})\]"
NOTHING = "I don't have anything in memory about that."

# --------------------------------------------------------------------------------------------------------------------

INSTRUCTION = (
    "Use nothing but the numbered memories. Cite each one that you use by its number in square brackets. Say so if they do not hold the answer, "
    "where they contradict each other, and where one that you use is marked UNVERIFIED. Be short."
)


def unverified(confidence: Column) -> Column:
    """Whether a memory's stated confidence says that it is not established."""
    return F.coalesce(F.lower(confidence).isin(UNSURE), F.lit(False))


def memory_line(number: Column, text: Column, occurred_at: Column, confidence: Column) -> Column:
    """A memory as the prompt shows it: number, day of the event, whether it is unverified, text up to MOST_CHARS with the cut marked."""
    bare = F.btrim(F.coalesce(text, F.lit("")))
    shown = F.when(F.length(bare) > MOST_CHARS, F.concat(F.substring(bare, 1, MOST_CHARS), F.lit(CUT_MARK))).otherwise(bare)
    day = F.coalesce(F.concat(F.lit(" ("), F.date_format(occurred_at, "dd MMM yyyy"), F.lit(")")), F.lit(""))
    return F.concat(number.cast("string"), F.lit("."), day, F.when(unverified(confidence), F.lit(" [UNVERIFIED]")).otherwise(""), F.lit(" "), shown)


def told(history: Column) -> Column:
    """The last MOST_TURNS turns (role, content) of a conversation, a line each; empty where there is none."""
    last = F.slice(history, F.greatest(F.lit(1), F.size(history) - MOST_TURNS + 1), F.lit(MOST_TURNS))
    lines = F.transform(last, lambda t: F.concat(F.initcap(t["role"]), F.lit(": "), F.btrim(t["content"])))
    return F.when(F.size(history) > 0, F.concat(F.lit("Conversation so far:\n"), F.array_join(lines, "\n"), F.lit("\n\n"))).otherwise("")


def prompts(hits: DataFrame, questions: DataFrame, instruction: str = INSTRUCTION) -> DataFrame:
    """(qid, prompt, considered, unsure): one prompt for each question (qid, text, and history where known) that has hits.

    ``hits`` has qid, rank, memory_id, content, occurred_at and, where known, confidence; at most some hundred a question.
    ``considered`` lists the memories by their numbers, ``unsure`` which of them are unverified.
    """
    confidence = F.col("confidence").cast("string") if "confidence" in hits.columns else F.lit(None).cast("string")
    row = F.struct("rank", "memory_id", F.col("content").alias("text"), "occurred_at", confidence.alias("confidence"))
    listed = hits.groupBy("qid").agg(F.array_sort(F.collect_list(row)).alias("docs"))
    lines = F.transform("docs", lambda d, i: memory_line(i + 1, d["text"], d["occurred_at"], d["confidence"]))
    before = told(F.coalesce(F.col("history"), F.array())) if "history" in questions.columns else F.lit("")
    asked = questions.select("qid", F.btrim("text").alias("__q"), before.alias("__h")).join(listed, "qid")
    body = F.concat(F.lit(instruction), F.lit("\n\n"), F.col("__h"), F.lit("Memories:\n"), F.array_join(lines, "\n"), F.lit("\n\nQuestion: "), F.col("__q"), F.lit("\nAnswer:"))
    ids = F.transform("docs", lambda d: d["memory_id"])
    unsure = F.transform(F.filter("docs", lambda d: unverified(d["confidence"])), lambda d: d["memory_id"])
    return asked.select("qid", body.alias("prompt"), ids.alias("considered"), unsure.alias("unsure"))


def cited(reply: Column, considered: Column) -> Column:
    """Memories that a reply cites as [n], in order, each once; numbers without a memory are dropped."""
    numbers = F.array_distinct(F.transform(F.regexp_extract_all(reply, F.lit(CITATION), F.lit(1)), lambda n: n.cast("int")))
    return F.transform(F.filter(numbers, lambda n: (n >= 1) & (n <= F.size(considered))), lambda n: F.get(considered, n - 1))


def answers(hits: DataFrame, questions: DataFrame, completer: Completer | None, instruction: str = INSTRUCTION) -> DataFrame:
    """(qid, reply, cited, considered, used_unverified) of every question; one without hits is answered without a model.

    Where the model gives no reply, the reply is null and nothing is cited.
    """
    replied = complete(prompts(hits, questions, instruction), "prompt", completer)
    found = questions.select("qid").join(replied, "qid", "left")
    none = F.col("considered").isNull()
    reply = F.when(none, F.lit(NOTHING)).otherwise(F.btrim("reply"))
    empty = F.array().cast(replied.schema["considered"].dataType)
    named = F.when(none | F.col("reply").isNull(), empty).otherwise(cited(F.col("reply"), F.col("considered")))
    rows = found.select("qid", reply.alias("reply"), named.alias("cited"), F.coalesce("considered", empty).alias("considered"), F.coalesce("unsure", empty).alias("unsure"))
    return rows.select("qid", "reply", "cited", "considered", F.arrays_overlap("cited", "unsure").alias("used_unverified"))
