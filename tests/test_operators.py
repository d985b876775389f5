import math
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from quillspark.operators import consolidate as C
from quillspark.operators import filters as P
from quillspark.operators import graph as G
from quillspark.operators import history as H
from quillspark.operators import ranking as R
from quillspark.operators import retrieval as S
from quillspark.operators import synth as Y
from quillspark.plans.search import SearchOptions, search
from quillspark.sources import bench

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


def at(day):
    return datetime(2026, 1, day, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        (1, "The office is in Madrid", "a", "episodic", "active", at(1)), (2, "The office moved to Lisbon", "b", "episodic", "active", at(5)),
        (3, "Coffee beans from Brazil", "a", "derived", "active", at(6)), (4, "The office in Porto is closed", "c", "episodic", "archived", at(7)),
    ]
    memories = spark.createDataFrame(rows, "id long, content string, source string, kind string, status string, occurred_at timestamp").withColumn("tags", F.array("source"))
    chunks = memories.select(F.col("id").alias("memory_id"), F.lit(0).alias("ordinal"), F.col("content").alias("text"))
    vectors = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.9, 0.1]), (3, 0, [0.0, 1.0]), (4, 0, [1.0, 0.0])], "memory_id long, ordinal int, embedding array<double>")
    asked = spark.createDataFrame([(7, "where is the office", [1.0, 0.0])], "qid long, text string, embedding array<double>")
    return memories, chunks, vectors, asked


def test_search_end_to_end(spark, corpus):
    memories, chunks, vectors, asked = corpus
    got = [r["memory_id"] for r in search(memories, chunks, vectors, asked, SearchOptions(limit=5, now=at(8))).orderBy("rank").collect()]
    assert got[:2] == [1, 2] and 4 not in got
    edges = spark.createDataFrame([(2, 1, "supersedes", 0.9, at(5))], "source_id long, target_id long, type string, confidence double, created_at timestamp")
    for options in (SearchOptions(limit=5), SearchOptions(limit=5, use_mmr=True, route_by_kind=True, max_per_source=1, use_rerank=True)):
        kept = [r["memory_id"] for r in search(memories, chunks, vectors, asked, options, edges).collect()]
        assert 1 not in kept and 2 in kept


def test_names_bring_in_what_no_arm_finds(spark):
    rows = [(1, "the office is run by Berta Klein"), (2, "a letter from Berta Klein to the bank"), (3, "coffee from the old mill")]
    memories = spark.createDataFrame([(i, t, "s", "episodic", "active", at(1)) for i, t in rows], "id long, content string, source string, kind string, status string, occurred_at timestamp").withColumn("tags", F.array("source"))
    chunks = memories.select(F.col("id").alias("memory_id"), F.lit(0).alias("ordinal"), F.col("content").alias("text"))
    none = spark.createDataFrame([], "memory_id long, ordinal int, embedding array<double>")
    asked = spark.createDataFrame([(7, "who heads the office", None)], "qid long, text string, embedding array<double>")
    plain = search(memories, chunks, none, asked, SearchOptions(limit=5))
    assert {r["memory_id"] for r in plain.collect()} == {1}
    got = {r["memory_id"]: r["explain"] for r in search(memories, chunks, none, asked, SearchOptions(limit=5, use_entities=True)).collect()}
    assert set(got) == {1, 2} and got[2][0] == "entity rank 1"


def test_multi_chunk_best_and_ties(spark):
    chunks = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 0, [1.0, 0.0]), (3, 0, None), (4, 0, [1.0]), (5, 0, [0.0, 0.0])], "memory_id int, ordinal int, embedding array<double>")
    q = spark.createDataFrame([("x", [2.0, 0.0])], "qid string, embedding array<double>")
    got = [(r["memory_id"], r["ordinal"], r["score"]) for r in S.vector_search(chunks, q, 3).orderBy("rank").collect()]
    assert got == [(1, 0, 1.0), (2, 0, 1.0), (5, 0, 0.0)]


def test_cursor():
    assert P.decode_cursor(P.encode_cursor("mem_1")) == "mem_1"
    with pytest.raises(ValueError):
        P.decode_cursor("***")


def test_filters(spark, corpus):
    memories = corpus[0]
    ids = lambda f: sorted(r["id"] for r in memories.filter(f.column()).collect())
    assert ids(P.MemoryFilter()) == [1, 2, 3] and ids(P.MemoryFilter(kinds=frozenset({"derived"}))) == [3]
    assert ids(P.MemoryFilter(tags=frozenset({"A"}))) == [1, 3] and ids(P.MemoryFilter(after=at(5), before=at(6))) == [2, 3]
    assert ids(P.MemoryFilter(metadata=(("source", "b"),))) == [2]


def test_fusion_rules(spark):
    arm = spark.createDataFrame([(1, 10, 1, 0.9), (1, 11, 2, 0.5)], "qid int, memory_id int, rank int, score double")
    fused = R.rank_fusion({"a": (arm, 1.0), "b": (arm, 0.5), "off": (arm, 0.0)}).orderBy("rank").collect()
    assert fused[0]["score"] == pytest.approx(1.5 / 61, abs=1e-9) and fused[0]["ranks"] == {"a": 1, "b": 1}
    with pytest.raises(ValueError):
        R.rank_fusion({"a": (arm, -1.0)})
    with pytest.raises(ValueError):
        R.rank_fusion({"a": (arm, 1.0)}, 0)


def test_decay_and_access(spark):
    row = spark.range(1).select(R.recency_factor(F.lit(at(1)), F.lit(at(1))), R.recency_factor(F.lit(at(9)), F.lit(at(1))), R.recency_factor(F.lit(datetime(1800, 1, 1, tzinfo=timezone.utc)), F.lit(at(1))), R.access_factor(F.lit(0)), R.access_factor(F.lit(100))).first()
    assert list(row) == pytest.approx([1.0, 1.0, 0.25, 1.0, 1.1])


def test_mmr_prefers_the_different(spark):
    rows = spark.createDataFrame([(1, 1, 1.0, [1.0, 0.0]), (1, 2, 0.9, [1.0, 0.0]), (1, 3, 0.7, [0.0, 1.0])], "qid int, memory_id int, score double, embedding array<double>")
    assert [r["memory_id"] for r in R.mmr(rows, 2, 0.5).orderBy("rank").collect()] == [1, 3]


def test_chain_with_cycle_and_erase(spark):
    e = spark.createDataFrame([(2, 1, "supersedes", 0.9, at(2)), (3, 2, "supersedes", 0.6, at(3)), (1, 3, "supersedes", 0.5, at(4))], "source_id long, target_id long, type string, confidence double, created_at timestamp")
    roots = spark.createDataFrame([(1,)], "root long")
    assert sorted((r["node"], r["depth"]) for r in G.reachable_superseders(e, roots).collect()) == [(2, 1), (3, 2)]
    assert G.lineage_heads(e, roots).first()["head"] == 3
    gone = spark.createDataFrame([(2,)], "id long")
    assert [tuple(r) for r in G.bridge(e, gone).collect()] == [(3, 1, "supersedes", 0.6)]
    memories = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    versions = spark.createDataFrame([(2, 1), (2, 2), (3, 1)], "memory_id long, version int")
    assert H.erase_report(versions, e, memories, gone).first().asDict() == {"memories": 1, "versions": 2, "edges": 2, "bridged": 1}
    m, v, kept = H.erase(memories, versions, e, gone)
    assert m.count() == 2 and v.count() == 1 and sorted((r["source_id"], r["target_id"]) for r in kept.collect()) == [(1, 3), (3, 1)]


def test_versions(spark):
    w = spark.createDataFrame([(1, 1, at(1), 1, "a"), (1, 1, at(2), 2, "b"), (1, 2, at(3), 3, "c")], "memory_id int, version int, at timestamp, seq int, content string")
    v = H.scd2(w)
    assert [r["content"] for r in H.as_of(v, F.lit(at(2))).collect()] == ["b"] and H.as_of(v, F.lit(T0.replace(year=2025))).count() == 0
    log = spark.createDataFrame([(1, 1, 1, False), (1, 1, 2, True), (2, 1, 1, False)], "id int, version int, seq int, deleted boolean")
    assert [r["id"] for r in H.live_view(log).collect()] == [2]


def test_conflict_rules(spark):
    pairs = [
        ("the flag is enabled", "the flag was disabled", True, False), ("we pay 100 euros", "we pay 200 euros", False, True), ("it is not paid", "it is paid", True, False),
        ("runs on Python", "the flag is off", False, False), ("they dislike it", "they dislike that", False, False), ("closed on Monday", "closed on tuesday", False, True),
    ]
    df = spark.createDataFrame(pairs, "a string, b string, p boolean, f boolean")
    for r in df.select("*", C.polarity_conflict(F.col("a"), F.col("b")).alias("gp"), C.figure_conflict(F.col("a"), F.col("b")).alias("gf")).collect():
        assert (r["gp"], r["gf"]) == (r["p"], r["f"]), r


def test_proposals_and_application(spark):
    m = spark.createDataFrame([(1, "I live in Madrid", "active", at(1), ["x"], 1), (2, "I no longer live in Madrid", "active", at(2), ["x"], 1)], "id int, content string, status string, occurred_at timestamp, tags array<string>, version int")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, math.sqrt(1 - 0.81)])], "id int, embedding array<double>")
    p = C.supersessions(C.similar_pairs(v, v, 0.72, 0.97), m).collect()
    assert [(r["new_id"], r["old_id"]) for r in p] == [(2, 1)] and p[0]["confidence"] == pytest.approx(min(0.99, 0.35 + 0.45 * 0.18 / 0.25 + 0.25), abs=1e-6)
    df = spark.createDataFrame([(1, 0.8, True)], "old_id int, confidence double, confirmed boolean")
    assert [(r["id"], r["status"], r["version"]) for r in C.apply_supersessions(m, df).orderBy("id").collect()] == [(1, "superseded", 2), (2, "active", 1)]
    assert C.apply_supersessions(m, df.drop("confirmed")).filter("status = 'superseded'").count() == 0


def test_reductions(spark):
    rows = spark.createDataFrame([(1, 1, at(1).date(), "saw a film"), (1, 2, at(9).date(), "saw a play"), (2, 1, at(1).date(), "caught 12 bass"), (2, 2, at(2).date(), "went home"), (3, 1, at(1).date(), "moved in"), (4, 1, None, "a"), (5, 1, at(1).date(), "ran for 3 hours")], "qid int, seq int, date date, fact string")
    q = spark.createDataFrame([(1, "count", "how many shows", None), (2, "count", "how many fish", None), (3, "date_arith", "how many weeks ago did I move in", at(22).date()), (4, "order", "what came last", None), (5, "date_arith", "how long did I run", None)], "qid int, kind string, text string, asked_at date")
    assert {r["qid"]: r["answer"] for r in Y.reduce_rows(rows, q).collect()} == {1: "2", 2: None, 3: "3 weeks", 4: None, 5: "ran for 3 hours"}


def test_derive_with_a_scripted_model(spark):
    docs = spark.createDataFrame([(1, 10, "Anna  bought a RED bike. Then rain.", "what did Anna buy"), (1, 11, "Nothing here", "what did Anna buy")], "qid int, id int, text string, question string")

    def model(prompts):
        return ['Sure: [{"date": "2024-01-02", "fact": "Anna bought a bike", "quote": "bought a red bike"}, {"fact": "invented", "quote": "not there"}, {"fa'] * len(prompts)

    got = Y.derive_rows(docs, model, "Extract.").collect()
    assert [(r["source_id"], r["fact"], str(r["date"])) for r in got] == [(10, "Anna bought a bike", "2024-01-02")]
    assert Y.derive_rows(docs, None, "Extract.").count() == 0


def test_parsing(spark):
    replies = [("noise [2, 0, 9, 2] more", [2, 0, 1]), ("first 1 then 0", [1, 0, 2]), ("none", None), (None, None), ("[1] or [ 2,1 ]", [2, 1, 0]), ("[] 3 1", None), ("-1 2", [2, 0, 1]), ("[99999999999, 1]", [1, 0, 2])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(replies)], "i int, reply string, want array<int>")
    assert [r["got"] for r in df.select("i", Y.stated_order(F.col("reply"), F.lit(3)).alias("got")).orderBy("i").collect()] == [w for _, w in replies]
    assert Y.parse_citations("see [2], [9], [2] and [1]", ["a", "b"]) == ["b", "a"]


def test_hydrate_by_brute_force(spark):
    import random

    draw = random.Random(3)
    doc = lambda i: (i, "x" * (i * 7 % 23), at(1 + i % 28))
    rows, want = [], {}
    for q in range(40):
        anchors = [(q, r, *doc(draw.randrange(30)), [doc(draw.randrange(30)) for _ in range(draw.randint(0, 3))], [doc(draw.randrange(30)) for _ in range(draw.randint(0, 3))]) for r in range(draw.randint(1, 4))]
        rows += anchors
        left, chosen = 60 - sum(i * 7 % 23 for i in {a[2] for a in anchors}), {a[2] for a in anchors}
        order = sorted(((k, a[1], s), d[0]) for a in anchors for s, side in ((0, a[5][::-1]), (1, a[6])) for k, d in enumerate(side))
        for _, i in order:
            if i not in chosen and i * 7 % 23 <= left:
                chosen.add(i)
                left -= i * 7 % 23
        want[q] = sorted((1 + i % 28, i, i in {a[2] for a in anchors}) for i in chosen)
    schema = "qid int, rank int, id int, text string, occurred_at timestamp, before array<struct<id:int,text:string,occurred_at:timestamp>>, after array<struct<id:int,text:string,occurred_at:timestamp>>"
    got = {}
    for r in Y.hydrate(spark.createDataFrame(rows, schema), 60).orderBy("qid", "place").collect():
        got.setdefault(r["qid"], []).append((1 + r["id"] % 28, r["id"], r["anchor"]))
    assert got == want


def test_listwise_rerank(spark):
    pool = spark.createDataFrame([(1, 10, 1, "a", "q"), (1, 11, 2, "b", "q")], "qid int, memory_id int, rank int, text string, question string")
    assert [r["memory_id"] for r in Y.listwise_rerank(pool, lambda p: ["[1, 0]"] * len(p)).orderBy("rank").collect()] == [11, 10]
    assert [r["memory_id"] for r in Y.listwise_rerank(pool, None).orderBy("rank").collect()] == [10, 11]


def test_evidence_formats(spark):
    rows = spark.createDataFrame([(1, 1, 5, "a", "2024-01-02"), (1, 2, 6, "b", "2024-01-01")], "qid int, rank int, id int, text string, day string")
    assert Y.evidence_blocks(rows).first()["evidence"] == "[1] a\n[2] b"
    assert Y.evidence_blocks(rows, "timeline").first()["evidence"] == "2024-01-01 b\n2024-01-02 a"


def test_bench_sources(spark, tmp_path):
    (tmp_path / "d.json").write_text('[{"sample_id": "s", "conversation": {"session_1": [{"speaker": "A", "text": "hi", "dia_id": "D1:1"}], "session_1_date_time": "1 May"}, "qa": [{"question": "q?", "answer": "x", "evidence": ["D1:1; D1:2"], "category": 5}]}]')
    assert [r["id"] for r in bench.dialogue_turns(spark, str(tmp_path / "d.json")).collect()] == ["D1:1"]
    q = bench.dialogue_questions(spark, str(tmp_path / "d.json")).first()
    assert q["evidence_ids"] == ["D1:1", "D1:2"] and q["is_abstention"]
    (tmp_path / "s.json").write_text('[{"question_id": "q1_abs", "question": "?", "answer": "a", "question_type": "t", "question_date": "2024/01/01", "haystack_sessions": [[{"role": "user", "content": "hello"}]], "haystack_session_ids": ["h1"], "haystack_dates": ["d"], "answer_session_ids": ["h1"]}]')
    r = bench.session_documents(spark, str(tmp_path / "s.json")).first()
    assert r["text"] == "user: hello" and r["is_evidence"] and r["is_abstention"]


def test_disagreement_reads_words_as_sql_does(spark):
    """Words end at letters beyond ASCII, as in the SQL's regular expressions: flags of odd texts in both engines."""
    import duckdb

    from quillspark.plans import oracle

    texts = ["noñjaóue", "ünot here", "say n'té, don'té", "losesícorr", "selló", "deliKe liKe", "deſell ſell liKed", "disliKed", "é5 5é 1,é 2,3ö", "mondayé émonday", "x1.é a-1ß 7.", "1, 2. 3_4", "nothing_ no_", ""]
    got = [tuple(r) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(C.disagreement_flags(F.col("t")).alias("f"), C.digit_words(F.col("t")).alias("g")).select("f.negated", F.array_sort("f.terms"), "f.figures", "f.days", "g").collect()]
    con = duckdb.connect()
    terms = sorted({w for pair in C.ANTONYMS for w in pair})
    held = ", ".join(rf"CASE WHEN regexp_matches($t, '(?i)\b{w}{C.INFLECTIONS}\b') THEN '{w}' END" for w in terms)
    sql = f"SELECT {oracle._NEG.format(x='$t')}, list_filter([{held}], lambda x: x IS NOT NULL), " + r"regexp_extract_all($t, '\b(\d[\d,]*(\.\d+)?)\b', 1), regexp_extract_all(lower($t), '\b(monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b', 1), " + oracle._DIGITS.format(x="$t")
    want = [con.execute(sql, {"t": t}).fetchall()[0] for t in texts]
    assert got == want and got[0][0] and got[3][1] == ["lose"]


def test_supersessions_need_no_pairs_with_others(spark):
    rows = [(i, "no longer " * (i % 2) + "x" * (600 if i == 3 else 9), "stale" if i == 4 else "active", at(i + 1), ["t"]) for i in range(8)]
    m = spark.createDataFrame(rows, "id long, content string, status string, occurred_at timestamp, tags array<string>")
    pairs = spark.createDataFrame([(a, b, 0.8) for a in range(8) for b in range(8) if a != b], "new_id long, old_id long, sim double")
    few = pairs.join(C.replaceable(m).select(F.col("id").alias("old_id")), "old_id", "left_semi").select("new_id", "old_id", "sim")
    got, want = (sorted(map(tuple, C.supersessions(p, m).collect())) for p in (few, pairs))
    assert got == want and {(a, b) for a, b, _, _ in got} == {(a, b) for a in range(8) for b in range(a) if b not in (3, 4)}
