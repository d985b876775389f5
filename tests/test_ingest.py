from datetime import datetime, timezone

from pyspark.sql import functions as F

from quillspark.functions.embed import hash_embedder
from quillspark.operators import claims, graph
from quillspark.plans.ingest import Space, ingest


def at(day):
    return datetime(2026, 1, day, tzinfo=timezone.utc)


def empty(spark):
    m = spark.createDataFrame([], "id string, content string, source string, kind string, status string, occurred_at timestamp, tags array<string>, version int")
    c = spark.createDataFrame([], "memory_id string, ordinal int, text string, embedding array<double>")
    e = spark.createDataFrame([], "source_id string, target_id string, type string, confidence double, created_at timestamp")
    return Space(m, c, e)


def test_batches(spark):
    schema = "id string, content string, source string, occurred_at timestamp, tags array<string>"
    one = spark.createDataFrame([("m1", "The invoice for the harbour crane costs 45 euros a month.", "a", at(1), ["x"]), ("m2", " the INVOICE for the harbour crane costs 45 euros a month. ", "a", at(2), ["x"]), ("m3", "", "a", at(2), ["x"])], schema)
    state = ingest(empty(spark), one, hash_embedder(64), at(3))
    assert {r["id"]: r["outcome"] for r in state.report.collect()} == {"m1": "created", "m2": "duplicate", "m3": "empty"}
    assert [(r["id"], r["version"]) for r in state.space.memories.collect()] == [("m1", 2)]
    two = spark.createDataFrame([("m4", "The invoice for the harbour crane costs 60 euros a month.", "a", at(4), ["x"])], schema)

    def model(prompts):
        return ['[{"n": 1, "supersedes": true, "confidence": 0.9, "old_value": "45 euros", "new_value": "60 euros"}]'] * len(prompts)

    after = ingest(state.space, two, hash_embedder(64), at(5), model)
    assert {r["id"]: r["outcome"] for r in after.report.collect()} == {"m4": "created"}
    status = {r["id"]: r["status"] for r in after.space.memories.collect()}
    assert status == {"m1": "superseded", "m4": "active"}
    assert ("m4", "m1", "supersedes") in {(r["source_id"], r["target_id"], r["type"]) for r in after.space.edges.collect()}
    plain = ingest(state.space, two, hash_embedder(64), at(5))
    assert {r["status"] for r in plain.space.memories.collect()} == {"active"}
    assert {r["type"] for r in plain.space.edges.collect()} >= {"contradicts"}


def test_verdicts_need_evidence(spark):
    ok = '[{"n": 1, "supersedes": true, "confidence": 0.9, "old_value": "45", "new_value": "60"}]'
    rows = [
        (1, ok.replace("45", "45 dollars"), ["costs 45 dollars"], "it costs 60 now"),
        (0, ok.replace('"45"', '"unknown"'), ["costs 45"], "it costs 60"),
        (0, ok.replace('"60"', '"45.0"').replace('"45"', '"45 dollars"'), ["costs 45 dollars"], "Redis is unchanged at 45"),
        (0, ok.replace("0.9", "0.5"), ["costs 45 dollars"], "x"), (0, "no json", ["a"], "b"), (0, None, ["a"], "b"),
        (0, ok.replace('"n": 1', '"n": 2').replace("45", "45 dollars"), ["costs 45 dollars"], "it costs 60 now"),
        (0, ok.replace("true", "false").replace("45", "45 dollars"), ["costs 45 dollars"], "it costs 60 now"),
        (1, ok[:-1] + ", " + ok[1:], ["it is 45, costs 45"], "it costs 60 now"),
        (0, ok.replace('"60"', '"the price went to 60 dollars in May"').replace('"45"', '"costs 45"'), ["costs 45"], "the price went to 60 dollars in May."),
        (0, ok.replace('"60"', '"so the price went to 60 in May"').replace('"45"', '"costs 45"'), ["costs 45"], "the price went to 60 in May"),
        (1, ok.replace('"45"', '"lives in Rome"').replace('"60"', '"Oslo"'), ["Anna lives, still, in Rome"], "Anna moved to Oslo last week"),
        (1, '{"n": "1", "confidence": "0.8", "old_value": 1200, "new_value": 1300} trailing', ["it is 1,200 euros; 1200"], "it is 1300 euros from now on"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, want int, reply string, olds array<string>, statement string")
    assert [(r["i"], len(r["verdicts"])) for r in claims.verdicts(df).orderBy("i").collect()] == [(i, r[0]) for i, r in enumerate(rows)]


def test_claims(spark):
    text = "Anna lives in  Porto with two cats. " * 3 + "She works at the harbour."
    rows = spark.createDataFrame([("m1", text), ("m2", "short")], "id string, content string")

    def model(prompts):
        return ['[{"claim": "Anna lives in Porto", "quote": "lives in Porto"}, {"claim": "Anna now lives in Porto", "quote": "lives in porto"}, {"claim": "Anna is rich", "quote": "rich"}]'] * len(prompts)

    got = claims.extract_claims(rows, model).collect()
    assert [(r["extracted_from"], r["content"]) for r in got] == [("m1", "Anna lives in Porto")] and got[0]["id"].startswith("clm_")
    assert claims.extract_claims(rows, None).count() == 0
    assert [len(w) <= 50 for w in claims.windows("a" * 120 + "\n\nb", 50)] == [True] * 3


def test_link_and_topology(spark):
    m = spark.createDataFrame([(1, "active", 1), (2, "active", 1), (3, "active", 1)], "id long, status string, version int")
    e = spark.createDataFrame([(3, 1, "derived_from", 1.0, at(1))], "source_id long, target_id long, type string, confidence double, created_at timestamp")
    new = spark.createDataFrame([(2, 1, "supersedes", 1.0, at(2)), (2, 3, "contradicts", 1.0, at(2))], e.schema)
    moved, after = graph.link(m, e, new)
    assert {r["id"]: (r["status"], r["version"]) for r in moved.collect()} == {1: ("superseded", 2), 2: ("active", 1), 3: ("stale", 2)}
    assert after.count() == 4
    deps = spark.createDataFrame([(1, 2, "depends_on", 1.0, at(1)), (1, 3, "depends_on", 1.0, at(1)), (2, 3, "depends_on", 1.0, at(1)), (3, 1, "depends_on", 1.0, at(1))], e.schema)
    closure = graph.dependency_closure(deps, spark.createDataFrame([(1,)], "root long"), 5)
    assert graph.topological(closure, deps).first()["nodes"] == [3, 2, 1]


def test_materialise_and_trace(spark):
    answers = spark.createDataFrame([(1, "how many", "3"), (2, "who", None)], "qid int, question string, answer string")
    made, edges = claims.materialise(answers, spark.createDataFrame([(1, "m1"), (1, "m2"), (2, "m3")], "qid int, memory_id string"), at(1))
    assert made.count() == 1 and edges.count() == 2
    stage = spark.createDataFrame([(1, "m1", 1)], "qid int, memory_id string, rank int")
    rows = claims.trace_stages(spark.createDataFrame([(1, "m1"), (1, "m2")], "qid int, memory_id string"), {"fused": stage, "cut": stage.filter("rank > 1")}).orderBy("memory_id").collect()
    assert [r["lost_at"] for r in rows] == ["cut", "fused"]
