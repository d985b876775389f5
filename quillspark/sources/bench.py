"""Benchmark files, saved retrievals and dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def dialogue_turns(spark: SparkSession, path: str, sessions: int = 50) -> DataFrame:
    """(corpus_id, session, turn, speaker, id, text, occurred) of multi-session dialogue JSON.

    A sample is {sample_id, conversation: {session_N: [{speaker, text, dia_id}], session_N_date_time}}.
    """
    line = "array<struct<speaker:string,text:string,dia_id:string>>"
    fields = ",".join(f"session_{n}:{line},session_{n}_date_time:string" for n in range(1, sessions + 1))
    raw = spark.read.schema(f"sample_id string, conversation struct<{fields}>").json(path, multiLine=True)
    each = F.array(*[F.struct(F.lit(n).alias("session"), F.col(f"conversation.session_{n}").alias("turns"), F.col(f"conversation.session_{n}_date_time").alias("occurred")) for n in range(1, sessions + 1)])
    rows = raw.select("sample_id", F.explode(each).alias("s")).select("sample_id", "s.session", "s.occurred", F.posexplode("s.turns").alias("turn", "t"))
    return rows.select(F.col("sample_id").alias("corpus_id"), "session", "turn", "t.speaker", F.col("t.dia_id").alias("id"), "t.text", "occurred")


def dialogue_questions(spark: SparkSession, path: str) -> DataFrame:
    """(corpus_id, qid, text, answer, evidence_ids, category, is_abstention) of the same files; packed evidence ids are split."""
    raw = spark.read.schema("sample_id string, qa array<struct<question:string,answer:string,adversarial_answer:string,evidence:array<string>,category:int>>").json(path, multiLine=True)
    rows = raw.select("sample_id", F.posexplode("qa").alias("n", "q"))
    ids = F.filter(F.flatten(F.transform("q.evidence", lambda e: F.split(e, r"[;,\s]+"))), lambda e: e != "")
    return rows.select(F.col("sample_id").alias("corpus_id"), F.concat_ws("-", "sample_id", F.col("n").cast("string")).alias("qid"), F.col("q.question").alias("text"), F.coalesce("q.answer", "q.adversarial_answer").alias("answer"), ids.alias("evidence_ids"), F.col("q.category").alias("category"), (F.col("q.category") == 5).alias("is_abstention"))


def session_documents(spark: SparkSession, path: str) -> DataFrame:
    """(qid, question, answer, kind, asked, id, occurred, text, is_evidence, is_abstention), a row a session, of haystack JSON."""
    ddl = (
        "question_id string, question string, answer string, question_type string, question_date string, haystack_sessions array<array<struct<role:string,content:string>>>,"
        "haystack_session_ids array<string>, haystack_dates array<string>, answer_session_ids array<string>"
    )
    raw = spark.read.schema(ddl).json(path, multiLine=True)
    rows = raw.withColumn("s", F.explode(F.arrays_zip("haystack_sessions", "haystack_session_ids", "haystack_dates")))
    text = F.array_join(F.transform("s.haystack_sessions", lambda t: F.concat_ws(": ", t["role"], t["content"])), "\n")
    return rows.select(
        F.col("question_id").alias("qid"), "question", "answer", F.col("question_type").alias("kind"), F.col("question_date").alias("asked"), F.col("s.haystack_session_ids").alias("id"),
        F.col("s.haystack_dates").alias("occurred"), text.alias("text"), F.array_contains("answer_session_ids", F.col("s.haystack_session_ids")).alias("is_evidence"), F.col("question_id").endswith("_abs").alias("is_abstention"),
    )


def save_retrieval(results: DataFrame, path: str) -> None:
    """Keeps ranked results for replays."""
    results.write.mode("overwrite").parquet(path)


def load_retrieval(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def dump(memories: DataFrame, path: str) -> None:
    """All memories as JSON lines."""
    memories.write.mode("overwrite").json(path)


def counters(memories: DataFrame, edges: DataFrame, versions: DataFrame) -> DataFrame:
    """(table, n) of what is stored."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, df in (("memories", memories), ("edges", edges), ("versions", versions))]
    return parts[0].union(parts[1]).union(parts[2])
