from datetime import datetime, timezone

from pyspark.sql import functions as F

from quillspark.streaming.ingest import clean_stream, ingest


def test_stream_drops_repeats(spark, tmp_path):
    rows = [(i, "s", f"text {i % 3} ", datetime(2026, 1, 1, 0, i, tzinfo=timezone.utc), "active") for i in range(9)]
    schema = "id int, space_id string, content string, occurred_at timestamp, status string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = []
    query = ingest(clean_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), lambda df, n: got.extend(r["content"] for r in df.collect()), str(tmp_path / "check"))
    query.awaitTermination(120)
    assert sorted(got) == ["text 0", "text 1", "text 2"]
