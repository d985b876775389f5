"""Grounded chat, derivation again under a budget, retries, the breaker, cached claims, sources of results."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from quillspark.functions import embed as M
from quillspark.operators import chat, claims, synth
from quillspark.operators.rederive import rederive
from quillspark.plans.search import SearchOptions, projected, search

NOW = datetime(2026, 3, 4, tzinfo=timezone.utc)


def test_chat(spark):
    hits = spark.createDataFrame([(1, 1, 70, " Anna owns a boat. ", NOW, None), (1, 2, 71, "x" * 5000, None, "Low"), (1, 3, 72, "Rain.", NOW, "high"), (3, 1, 70, "Other.", NOW, None)], "qid int, rank int, memory_id long, content string, occurred_at timestamp, confidence string")
    turns = [(f"r{i}", f" turn {i} ") for i in range(10)]
    asked = spark.createDataFrame([(1, " Who? ", turns), (2, "Nothing known", []), (3, "What?", None)], "qid int, text string, history array<struct<role:string,content:string>>")
    prompt = {r.qid: r.prompt for r in chat.prompts(hits, asked, "Rules.").collect()}
    said = "Conversation so far:\n" + "\n".join(f"R{i}: turn {i}" for i in range(2, 10)) + "\n\n"
    assert prompt[1] == f"Rules.\n\n{said}Memories:\n1. (04 Mar 2026) Anna owns a boat.\n2. [UNVERIFIED] {'x' * 4000} […truncated]\n3. (04 Mar 2026) Rain.\n\nQuestion: Who?\nAnswer:"
    assert prompt[3].startswith("Rules.\n\nMemories:\n1.") and 2 not in prompt

    def model(prompts):
        return [" Anna [2], [1] and [2] but not [9] or [2026]. " if "boat" in p else None for p in prompts]

    got = {r.qid: r for r in chat.answers(hits, asked, model).collect()}
    assert (got[1].reply, got[1].cited, got[1].considered, got[1].used_unverified) == ("Anna [2], [1] and [2] but not [9] or [2026].", [71, 70], [70, 71, 72], True)
    assert got[2].reply == chat.NOTHING and got[2].cited == [] and got[3].reply is None and got[3].cited == [] and not got[3].used_unverified


def state(spark):
    m = [("a", "fact a", "episodic", "active", None), ("b", "fact b", "episodic", "active", None), ("d1", "old one", "derived", "stale", "q1"), ("d2", "old two", "derived", "stale", "q2"), ("d3", "old top", "derived", "stale", "q3"), ("d4", "same", "derived", "stale", "q4")]
    e = [("d1", "a"), ("d2", "b"), ("d3", "d1"), ("d3", "d2"), ("d4", "a")]
    memories = spark.createDataFrame([(*r[:4], 1, r[4], NOW) for r in m], "id string, content string, kind string, status string, version int, question string, occurred_at timestamp")
    edges = spark.createDataFrame([(s, t, "derived_from", 1.0, NOW) for s, t in e], "source_id string, target_id string, type string, confidence double, created_at timestamp")
    return memories, edges


@pytest.fixture
def model():
    """Not a function of this module, which workers can't import."""
    return lambda prompts: ["same" if "q4" in p else f"new from {' + '.join(x[2:] for x in p.splitlines() if x.startswith('- '))}" for p in prompts]


def test_derivation_again_in_order(spark, model):
    memories, edges, report = rederive(*state(spark), model, 10, NOW)
    got = {r.id: (r.outcome, r["into"]) for r in report.collect()}
    assert {k: v[0] for k, v in got.items()} == {"d1": "replaced", "d2": "replaced", "d3": "replaced", "d4": "confirmed"}
    rows = {r.id: r for r in memories.collect()}
    assert {k: (rows[k].status, rows[k].version) for k in ("d1", "d2", "d3", "d4")} == {"d1": ("superseded", 2), "d2": ("superseded", 2), "d3": ("superseded", 2), "d4": ("active", 2)}
    top = rows[got["d3"][1]]
    assert sorted(top.content.removeprefix("new from ").split(" + ")) == ["new from fact a", "new from fact b"] and top.question == "q3" and top.status == "active"
    links = {(r.source_id, r.target_id, r.type) for r in edges.collect()}
    assert (got["d3"][1], "d3", "supersedes") in links and (got["d3"][1], got["d1"][1], "derived_from") in links


def test_budget_ends_midway_and_failures_wait(spark, model):
    memories, _, report = rederive(*state(spark), model, 2, NOW)
    assert sorted(r.id for r in report.collect()) == ["d1", "d2"] and {r.id for r in memories.filter("status = 'stale'").collect()} == {"d3", "d4"}
    memories, _, report = rederive(*state(spark), lambda prompts: [None if "q1" in p else "x" for p in prompts], 10, NOW)
    assert {r.id: r.outcome for r in report.collect()} == {"d1": "no_answer", "d2": "replaced", "d4": "replaced"} and memories.filter("id = 'd3'").first().status == "stale"
    assert rederive(*state(spark), None, 0, NOW)[2].count() == 0


def test_retries():
    calls = []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) < 3:
            raise OSError("down")
        return [[3.0, 4.0]] * len(texts)

    assert M.asked_again(flaky, ["a", "b"], 2, 3, 0.001) == [[0.6, 0.8]] * 2 and calls == [2, 2, 2]
    calls.clear()
    with pytest.raises(OSError):
        M.asked_again(flaky, ["a"], 2, 2, 0.001)
    with pytest.raises(M.WrongSize):
        M.asked_again(lambda t: (calls.append(1), [[1.0]])[1], ["a"], 2, 3, 0.001)
    assert len(calls) == 3


def test_breaker_opens_again(spark):
    def down_at_first(prompts):
        import time

        if not hasattr(time, "_since"):
            time._since = time.monotonic()
        if time.monotonic() - time._since < 0.5:
            raise OSError("down")
        time.sleep(0.01)
        return ["yes"] * len(prompts)

    def slow(prompts):
        import time

        time.sleep(0.3)
        return down_at_first(prompts)

    rows = spark.range(12).selectExpr("cast(id as string) p").coalesce(1)
    got = [r.reply for r in synth.complete(rows, "p", slow, batch=1, failures=1, pause=0.0).collect()]
    assert got[0] is None and got[-1] == "yes"
    shut = [r.reply for r in synth.complete(rows, "p", lambda p: 1 / 0, batch=1, failures=1, pause=60.0).collect()]
    assert shut == [None] * 12


def test_claim_cache(spark):
    text = "Anna lives in Porto with two cats and works at the harbour; she likes it there very much indeed."
    rows = spark.createDataFrame([("m1", text), ("m2", text), ("m3", "Nothing of note was said here at all, and so there is nothing that one could take from it, sadly.")], "id string, content string")
    cache = spark.createDataFrame([], "key string, content string, quote string")

    def model(prompts):
        return ['[{"claim": "Anna lives in Porto", "quote": "lives in Porto"}]' if "Porto" in p else "[]" for p in prompts]

    got, new = claims.with_claim_cache(rows, cache, model, "v1")
    assert sorted((r.extracted_from, r.content) for r in got.collect()) == [("m1", "Anna lives in Porto"), ("m2", "Anna lives in Porto")] and new.count() == 2
    again, none = claims.with_claim_cache(rows, new, lambda p: 1 / 0, "v1")
    assert none.count() == 0 and sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))


def test_search_caps_by_what_memories_were_taken_from(spark):
    memories = spark.createDataFrame([(i, "crane boat", "same" if i < 3 else "", "episodic", "active", NOW, "d1" if i in (3, 4) else "") for i in range(6)], "id long, content string, source string, kind string, status string, occurred_at timestamp, extracted_from string")
    chunks = memories.select(F.col("id").alias("memory_id"), F.lit(0).alias("ordinal"), F.col("content").alias("text"))
    vectors = memories.select(F.col("id").alias("memory_id"), F.lit(0).alias("ordinal"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    asked = spark.createDataFrame([(1, "crane", [1.0, 0.0])], "qid int, text string, embedding array<double>")
    found = search(memories, chunks, vectors, asked, SearchOptions(max_per_source=1, use_decay=False))
    assert sorted(r.memory_id for r in found.collect()) == [0, 3, 5]
    shown = projected(found, memories, chars=5).collect()
    assert {r.preview for r in shown} == {"crane"} and "explain" not in shown[0].asDict()
