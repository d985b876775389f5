"""Snapshots, history and failed writes of the log."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from quillspark.sources.log_store import ConcurrentCommit, SpaceStore

M = "org_id string, space_id string, id long, version int, content string, status string"
E = "org_id string, space_id string, source_id long, target_id long, type string, confidence double"


def day(d):
    return datetime(2026, 1, d, tzinfo=timezone.utc)


def ids(spark, *keys):
    return spark.createDataFrame([("o", "s", k) for k in keys], "org_id string, space_id string, id long")


def test_log(spark, tmp_path):
    log = SpaceStore(spark, f"file://{tmp_path}/log")
    assert log.memories() is None and log.history() is None and log.version() == 0
    memories = [("o", "s", k, 1, f"m{k}", "active") for k in range(1, 6)] + [("o", "t", 1, 1, "other", "active")]
    edges = [("o", "s", 3, 2, "supersedes", 0.9), ("o", "s", 2, 1, "supersedes", 0.7), ("o", "s", 4, 5, "references", 1.0), ("o", "t", 2, 1, "supersedes", 0.5)]
    log.put(day(1), spark.createDataFrame(memories, M), spark.createDataFrame(edges, E))
    log.put(day(2), spark.createDataFrame([("o", "s", 4, 2, "m4 again", "active")], M))
    log.delete(ids(spark, 2), day(3))
    live = lambda v=None: {(r.space_id, r.id): r.content for r in log.memories(v).collect()}
    assert live() == {("s", 1): "m1", ("s", 3): "m3", ("s", 4): "m4 again", ("s", 5): "m5", ("t", 1): "other"}
    assert {(r.space_id, r.source_id, r.target_id, r.confidence) for r in log.edges().collect()} == {("s", 3, 1, 0.7), ("s", 4, 5, 1.0), ("t", 2, 1, 0.5)}
    assert live(1)[("s", 4)] == "m4" and ("s", 2) in live(2)
    then = lambda d: {(r.space_id, r.id): r.content for r in log.as_of(F.lit(day(d))).collect()}
    assert then(1) == live(1) and then(2) == live(2) and then(3) == live(3)
    counts = log.erase(ids(spark, 4), day(4))
    assert counts["memories"] == 2 and ("s", 4) not in live() and not log.history().filter("space_id = 's' and id = 4").count()
    assert {(r.source_id, r.target_id) for r in log.edges().filter("space_id = 's'").collect()} == {(3, 1)}
    assert log.drop_space("o", "s", day(5)) and not log.drop_space("o", "s", day(5)) and not log.drop_space("o", "none", day(5))
    assert live() == {("t", 1): "other"} and {r.space_id for r in log.edges().collect()} == {"t"}
    assert then(3)[("s", 3)] == "m3" and then(6) == {("t", 1): "other"}
    assert log.vacuum() > 0 and live() == {("t", 1): "other"}


def test_a_failed_write_changes_nothing(spark, tmp_path):
    log = SpaceStore(spark, f"file://{tmp_path}/log")
    rows = spark.createDataFrame([("o", "s", 1, 1, "a", "active")], M)
    log.put(day(1), rows)
    with pytest.raises(Exception):
        log.put(day(2), rows.withColumn("content", F.raise_error(F.lit("broken")).cast("string")))
    assert log.version() == 1 and [r.content for r in log.memories().collect()] == ["a"]
    before = log.manifest()
    log.put(day(2), rows.withColumn("content", F.lit("b")))
    with pytest.raises(ConcurrentCommit):
        log._commit(before, before["logs"], day(3))
    assert [r.content for r in log.memories().collect()] == ["b"]
