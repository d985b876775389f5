"""Streaming ingest (an extension of the batch engine): duplicates within a watermark, consolidation by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import content_hash, normalize
from ..operators.consolidate import exact_duplicates


def clean_stream(memories: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of memories with normalised content, each content of a space once within the watermark.

    State holds a hash for each content until the watermark passes it, so it is bounded by the rate times ``late``.
    """
    rows = memories.withColumn("content", normalize(F.col("content"))).withColumn("content_sha256", content_hash(F.col("content")))
    return rows.withWatermark("occurred_at", late).dropDuplicatesWithinWatermark(["space_id", "content_sha256"])


def usage_stream(memories: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Writes and bytes of each space by event-time window."""
    rows = memories.withWatermark("occurred_at", late)
    per = rows.groupBy(F.window("occurred_at", window).alias("w"), "space_id")
    return per.agg(F.count("*").alias("memories"), F.sum(F.octet_length("content")).alias("bytes")).select("space_id", F.col("w.start").alias("start"), "memories", "bytes")


def ingest(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Starts the ingest: each micro-batch, without contents that the batch itself repeats, goes to ``sink`` with its number.

    ``sink`` must take a repeated number for the same batch, as after a failure the last one comes again.
    """

    def batch(rows: DataFrame, number: int) -> None:
        firsts = exact_duplicates(rows, ["space_id"]).filter("not duplicate").select("id")
        sink(rows.join(firsts, "id", "left_semi"), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
