"""The driver's tables as the memory model: memories, chunks, edges, versions, turns.

The same definitions stand as SQL in ``VIEWS``, by which another engine checks the queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memories; space is the language, event time an hour a document id."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    d = docs.join(labels, "doc_id", "left")
    status = F.when(F.col("doc_id") % 17 == 0, "archived").when(F.col("doc_id") % 13 == 0, "stale").when(F.col("doc_id") % 11 == 0, "superseded").otherwise("active")
    return d.select(
        F.col("doc_id").alias("id"),
        F.lit("org_0").alias("org_id"),
        F.col("lang").alias("space_id"),
        F.col("text").alias("content"),
        "source",
        status.alias("status"),
        F.when(F.col("doc_id") % 5 == 0, "derived").otherwise("episodic").alias("kind"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600).alias("occurred_at"),
        F.array_compact(F.array("lang", "source", F.when(F.col("quality") == 1, "quality"))).alias("tags"),
        "quality",
        "toxic",
    )


def chunks_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as single chunks of the memories of their id."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("memory_id"), F.lit(0).alias("ordinal"), "embedding")


def memories_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as memories of their customers' nations."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    status = F.when(F.col("o_orderstatus") == "F", "superseded").when(F.col("o_orderstatus") == "O", "active").otherwise("stale")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("spc_"), F.col("c_nationkey").cast("string")).alias("space_id"),
        status.alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("occurred_at"),
        F.col("o_custkey").alias("source"),
        F.col("o_totalprice").alias("score"),
        F.col("o_orderpriority").alias("tag"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations between consecutive orders of a customer; each contradiction stands both ways."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    lag = table(spark, sf_dir, "orders").withColumn("target_id", F.lag("o_orderkey").over(w)).filter("target_id is not null")
    r = F.col("o_orderkey") % 10
    kind = F.when(r <= 3, "supersedes").when(r <= 5, "derived_from").when(r == 6, "contradicts").when(r <= 8, "references").otherwise("depends_on")
    one = lag.select(F.col("o_orderkey").alias("source_id"), "target_id", kind.alias("type"), (F.lit(0.5) + (F.col("o_orderkey") % 50) / 100).alias("confidence"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    back = one.filter("type = 'contradicts'").select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "type", "confidence", "created_at")
    return one.unionByName(back)


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as versions of one memory, valid until the next."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("memory_id"),
        F.row_number().over(w).alias("version"),
        F.col("event_type").alias("content"),
        "value",
        F.col("ts").cast("timestamp").alias("valid_from"),
        F.lead(F.col("ts").cast("timestamp")).over(w).alias("valid_to"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", "text")


_STATUS = "CASE WHEN doc_id % 17 = 0 THEN 'archived' WHEN doc_id % 13 = 0 THEN 'stale' WHEN doc_id % 11 = 0 THEN 'superseded' ELSE 'active' END"

#: SQL of the views, for common table expressions.
VIEWS = {
    "memories_text": f"""SELECT doc_id AS id, 'org_0' AS org_id, lang AS space_id, text AS content, source, {_STATUS} AS status,
  CASE WHEN doc_id % 5 = 0 THEN 'derived' ELSE 'episodic' END AS kind, TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 HOUR AS occurred_at,
  list_filter([lang, source, CASE WHEN quality = 1 THEN 'quality' END], lambda x: x IS NOT NULL) AS tags, quality, toxic
  FROM documents LEFT JOIN labels USING (doc_id)""",
    "chunks_vec": "SELECT vec_id AS memory_id, 0 AS ordinal, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings",
    "memories_order": """SELECT o_orderkey AS id, 'spc_' || c_nationkey AS space_id, CASE o_orderstatus WHEN 'F' THEN 'superseded' WHEN 'O' THEN 'active' ELSE 'stale' END AS status,
  o_orderdate AS occurred_at, o_custkey AS source, o_totalprice AS score, o_orderpriority AS tag FROM orders JOIN customer ON o_custkey = c_custkey""",
    "edges": """SELECT * FROM (
  SELECT o_orderkey AS source_id, target_id, CASE WHEN o_orderkey % 10 <= 3 THEN 'supersedes' WHEN o_orderkey % 10 <= 5 THEN 'derived_from' WHEN o_orderkey % 10 = 6 THEN 'contradicts'
    WHEN o_orderkey % 10 <= 8 THEN 'references' ELSE 'depends_on' END AS type, 0.5::DOUBLE + (o_orderkey % 50)::DOUBLE / 100 AS confidence, o_orderdate AS created_at
  FROM (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS target_id FROM orders) WHERE target_id IS NOT NULL
  ) UNION ALL SELECT * FROM (SELECT lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS source_id, o_orderkey AS target_id, 'contradicts' AS type,
    0.5::DOUBLE + (o_orderkey % 50)::DOUBLE / 100 AS confidence, o_orderdate AS created_at FROM orders) WHERE source_id IS NOT NULL AND target_id % 10 = 6""",
    "versions": """SELECT user_id AS memory_id, row_number() OVER w AS version, event_type AS content, value, ts AS valid_from, lead(ts) OVER w AS valid_to
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
}


def with_views(*names: str, recursive: bool = False) -> str:
    """WITH clause of the named views."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
