"""Question kinds of their own, supposed answers, model labels, lineage, upserts, maps of metadata, levels without results."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from quillspark.functions.embed import hash_embedder
from quillspark.functions.text import kept_tokens, word_counts
from quillspark.operators import bands
from quillspark.operators import consolidate as C
from quillspark.operators import filters as P
from quillspark.operators import graph as G
from quillspark.operators import history as H
from quillspark.operators import ranking as R
from quillspark.operators import retrieval as S
from quillspark.operators import synth as Y
from quillspark.plans import catalogue
from quillspark.plans.search import SearchOptions, search
from quillspark.sources.store import MemoryStore

SF = "/root/testdata/sf0.001"


def at(day):
    return datetime(2024, 1, day, tzinfo=timezone.utc)


def test_search_by_each_questions_kind(spark):
    memories, asked = catalogue.X.memories_text(spark, SF), catalogue._questions(spark, SF).limit(6)
    chunks, vectors = catalogue._chunks(memories), catalogue.X.chunks_vec(spark, SF)
    kinds = ["direct", "count", "advice", "direct", "order", "compare"]
    ids = [r["qid"] for r in asked.select("qid").orderBy("qid").collect()]
    named = asked.join(spark.createDataFrame(list(zip(ids, kinds)), "qid long, kind string"), "qid")
    options = dict(limit=5, use_decay=False, route_by_kind=True)

    def rows(questions, **more):
        return sorted((r["qid"], r["rank"], r["memory_id"], r["score"]) for r in search(memories, chunks, vectors, questions, SearchOptions(**options, **more)).collect())

    want = sorted(r for kind in set(kinds) for r in rows(named.filter(F.col("kind") == kind).drop("kind"), question_kind=kind))
    assert rows(named) == want
    wide = rows(named.withColumn("kind", F.when(F.col("qid") == ids[0], "list_all").otherwise(F.col("kind"))))
    assert sum(r[0] == ids[0] for r in wide) > 5 and all(sum(r[0] == i for r in wide) <= 5 for i in ids[1:])


def test_supposed_answers_and_labels(spark):
    q = spark.createDataFrame([(1, "where is the bike", [1.0] + [0.0] * 15), (2, " ", [0.0, 1.0] + [0.0] * 14), (3, "Where is the BIKE", None)], "qid int, text string, embedding array<double>")

    def model(prompts):
        return ["I  left the bike\nat home"] * len(prompts)

    got = {r["qid"]: r for r in Y.expand_queries(q, model, hash_embedder(16)).collect()}
    own, told = [1.0] + [0.0] * 15, hash_embedder(16)(["I left the bike at home"])[0]
    mean = [a + b for a, b in zip(own, told)]
    size = sum(x * x for x in mean) ** 0.5
    assert got[1]["hypothesis"] == "I left the bike at home" and got[1]["embedding"] == pytest.approx([x / size for x in mean])
    assert got[2]["embedding"][1] == 1.0 and got[2]["hypothesis"] is None and got[3]["embedding"] is None
    plain = {r["qid"]: r["embedding"] for r in Y.expand_queries(q, None, hash_embedder(16)).collect()}
    assert plain[1] == own

    def labels(prompts):
        return [" Label: `count`." if "bike" in p.lower() else "no idea" for p in prompts]

    kinds = {r["qid"]: (r["kind"], r["decided_by"]) for r in Y.understand(q.union(spark.createDataFrame([(4, "how many cats do I have", None)], q.schema)), labels).collect()}
    assert kinds == {1: ("count", "llm"), 2: ("direct", "rules"), 3: ("count", "llm"), 4: ("count", "rules")}
    assert {r["decided_by"] for r in Y.understand(q, None).collect()} == {"rules"}


def test_a_model_that_is_down_is_left_alone(spark, tmp_path):
    path = str(tmp_path / "calls")

    def broken(prompts):
        with open(path, "a") as f:
            f.write("x")
        raise RuntimeError("down")

    def slow(prompts):
        import time

        time.sleep(3)
        return prompts

    rows = spark.range(400).coalesce(1).selectExpr("cast(id as string) as p")
    assert Y.complete(rows, "p", broken, batch=4).filter("reply is not null").count() == 0
    assert len(open(path).read()) == 3
    assert Y.complete(rows.limit(4), "p", slow, timeout=0.2).filter("reply is not null").count() == 0


def test_lineage_and_bounds(spark):
    e = spark.createDataFrame([(2, 1, "supersedes", 0.9, at(2)), (3, 2, "supersedes", 0.6, at(3)), (4, 2, "supersedes", 0.6, at(4)), (7, 8, "supersedes", 0.5, at(1)), (8, 7, "supersedes", 0.5, at(1))], "source_id long, target_id long, type string, confidence double, created_at timestamp")
    roots = spark.createDataFrame([(1,), (2,), (3,), (7,), (9,)], "root long")
    got = {r["root"]: (r["ancestors"], r["successors"], r["is_current"], r["head"]) for r in G.lineage(e, roots).collect()}
    assert got == {1: ([], [2, 3], False, 3), 2: ([1], [3], False, 3), 3: ([2, 1], [], True, 3), 7: ([8], [8], False, 8), 9: ([], [], True, 9)}
    closure = spark.createDataFrame([(1, 5, 1), (1, 4, 1), (1, 6, 2), (2, 9, 1)], "root long, node long, depth int")
    assert sorted((r["root"], r["node"], r["truncated"]) for r in G.bounded_closure(closure, 2).collect()) == [(1, 4, True), (1, 5, True), (2, 9, False)]
    steps = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 5)], "from long, to long")
    assert sorted(r["node"] for r in G.reached(spark.createDataFrame([(1,), (5,), (9,)], "node long"), steps).collect()) == [1, 2, 3, 5]


def test_upserts_and_spaces(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "memories"))
    schema = "org_id string, space_id string, id string, content string, version int"
    store.upsert(spark.createDataFrame([("o", "a", "1", "x", 1), ("o", "a", "1", "y", 2), ("o", "b", "1", "z", 1)], schema))
    store.upsert(spark.createDataFrame([("o", "a", "1", "old", 1), ("o", "a", "2", "new", 1)], schema))
    rows = sorted((r["space_id"], r["id"], r["content"]) for r in store.read().collect())
    assert rows == [("a", "1", "y"), ("a", "2", "new"), ("b", "1", "z")]
    assert store.delete_space("o", "a") and not store.delete_space("o", "a")
    spark.catalog.refreshByPath(store.path)
    assert [r["space_id"] for r in store.read().collect()] == ["b"]
    one = spark.createDataFrame([(1, 1, "a"), (None, 1, "b"), (None, 1, "c")], "id int, version int, content string")
    assert sorted(r["content"] for r in H.upsert(one, spark.createDataFrame([(1, 1, "n")], one.schema)).collect()) == ["b", "c", "n"]


def test_metadata_maps_sources_and_no_results(spark):
    rows = spark.createDataFrame([(1, "active", {"topic": "x", "n": "3"}, None, "d1", "s"), (2, "active", {"topic": "y"}, 1, "d2", "s"), (3, "active", None, None, None, None)], "id int, status string, metadata map<string,string>, extracted_from int, doc_id string, source string")
    ids = lambda *pairs: sorted(r["id"] for r in rows.filter(P.MemoryFilter(metadata=pairs, in_map=True).column()).collect())
    assert ids(("topic", "x")) == [1] and ids(("n", 3)) == [1] and ids(("n", None)) == [2, 3] and ids() == [1, 2, 3]
    assert [r[0] for r in rows.orderBy("id").select(P.source_of(rows)).collect()] == ["d1", "1", None]
    scored = spark.createDataFrame([(1, 0.9, 1), (1, 0.2, 2)], "qid int, score double, rank int")
    got = {r["qid"]: (r["level"], r["n_results"]) for r in R.confidence(scored, asked=spark.createDataFrame([(1,), (2,)], "qid int")).collect()}
    assert got == {1: ("high", 2), 2: ("none", 0)}


def test_word_counts_are_the_kept_tokens(spark):
    texts = ["The cat's toys aren't cats' — CAT cat", None, "", "' ' '", "the of", "Straße don't 42 x_y ÉTÉ"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").union(catalogue.X.table(spark, SF, "documents").select(F.col("doc_id").cast("int"), "text"))
    got = sorted((r["id"], r["length"], sorted(zip(r["words"], r["tfs"]))) for r in word_counts(rows, ["id"], "text").collect())
    want = []
    for r in rows.select("id", kept_tokens(F.col("text")).alias("t")).collect():
        want.append((r["id"], len(r["t"]), sorted((w, r["t"].count(w)) for w in set(r["t"]))))
    assert got == sorted(want)


def test_searches_and_pairs_in_blocks(spark, monkeypatch):
    vectors = catalogue.X.chunks_vec(spark, SF)
    asked = vectors.limit(30).select(F.col("memory_id").alias("qid"), "embedding")
    chunks = catalogue._chunks(catalogue.X.memories_text(spark, SF))
    texts = catalogue.X.table(spark, SF, "benchmark").select(F.col("item_id").alias("qid"), "text").limit(20)
    ids = vectors.select(F.col("memory_id").alias("id"), "embedding")
    run = lambda: [sorted(map(tuple, df.collect())) for df in (S.vector_search(vectors, asked, 5), S.lexical_search(chunks, texts, 5), C.similar_pairs(ids.limit(25), ids, 0.2, None))]
    whole = run()
    monkeypatch.setattr(S, "MOST_QUERIES", 7)
    monkeypatch.setattr(bands, "UNIT_ROWS", 7)
    assert run() == whole and all(whole)
