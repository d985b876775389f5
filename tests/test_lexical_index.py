"""The kept inverted index against BM25 by plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions.text import analyze, analyze_query
from quillspark.operators import lexical_index as L
from quillspark.operators.ranking import heuristic_rerank

CHUNKS = "memory_id long, ordinal int, text string"


def brute(spark, chunks, queries, k):
    docs = [(m, o, t) for m, o, t in spark.createDataFrame(chunks, CHUNKS).select("memory_id", "ordinal", analyze(F.col("text"))).collect()]
    asked = spark.createDataFrame(queries, "qid int, text string").select("qid", analyze_query(F.col("text"))).collect()
    mean = sum(len(t) for _, _, t in docs) / max(1, len(docs)) or 1.0
    out = []
    for qid, terms in asked:
        best = {}
        for m, o, t in docs:
            score = 0.0
            for w in set(terms):
                df, tf = sum(w in d[2] for d in docs), t.count(w)
                if tf:
                    score += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
            score = round(score, 6)
            if score > 0 and (m not in best or (-score, o) < best[m]):
                best[m] = (-score, o)
        ranked = sorted((s, m, o) for m, (s, o) in best.items())[:k]
        out += [(qid, m, -s, o, i + 1) for i, (s, m, o) in enumerate(ranked)]
    return sorted(out)


def got(df):
    return sorted((r.qid, r.memory_id, round(r.score, 6), r.ordinal, r["rank"]) for r in df.collect())


def close(a, b):
    return [(x[:2], x[3:]) for x in a] == [(x[:2], x[3:]) for x in b] and all(abs(x[2] - y[2]) < 2e-6 for x, y in zip(a, b))


WORDS = ["running", "runs", "run", "naïve", "straße", "strasse", "cats", "cat", "the", "not", "can't", "moved", "moving", "x9", "zeta", "eta"]


def made(seed, many):
    draw = random.Random(seed)
    return [(m, o, None if draw.random() < 0.05 else " ".join(draw.choices(WORDS, k=draw.randint(0, 30)))) for m in range(many) for o in range(draw.randint(1, 3))]


QUERIES = [(1, "Running cats"), (2, "the"), (3, "straße not naïve zeta"), (4, ""), (5, "unknown words"), (6, "x9"), (7, "run run moved eta")]


def test_search_equals_loops(spark, monkeypatch):
    monkeypatch.setattr(L, "QUERIES_EACH", 3)
    chunks, asked = made(1, 60), spark.createDataFrame(QUERIES, "qid int, text string")
    index = L.temporary_index(spark.createDataFrame(chunks, CHUNKS).repartition(3), buckets=5)
    assert close(got(index.search(asked, 4)), brute(spark, chunks, QUERIES, 4))
    some = spark.createDataFrame([(m,) for m in range(0, 60, 3)], "memory_id long")
    assert close(got(index.search(asked, 4, within=some)), brute(spark, [c for c in chunks if c[0] % 3 == 0], QUERIES, 4))
    assert index.search(asked, 4, within=some.limit(0)).count() == 0


@pytest.mark.parametrize("shard, pruned, bits", [(7, 1, 2), (1 << 15, 1, 3)])
def test_shards_and_bounds_lose_nothing(spark, monkeypatch, shard, pruned, bits):
    for name, value in (("SHARD_CHUNKS", shard), ("PRUNED_FROM", pruned), ("BLOCK_BITS", bits)):
        monkeypatch.setattr(L, name, value)
    chunks = made(2, 150)
    index = L.temporary_index(spark.createDataFrame(chunks, CHUNKS), buckets=3)
    assert close(got(index.search(spark.createDataFrame(QUERIES, "qid int, text string"), 2)), brute(spark, chunks, QUERIES, 2))


def test_batches_replace_and_remove(spark):
    chunks, asked = made(3, 50), spark.createDataFrame(QUERIES, "qid int, text string")
    old = [(m, o, "cats cats moved") for m, o, _ in chunks if m % 2] + [(900, 0, "cats naïve"), (901, 0, "run")]
    index = L.temporary_index(spark.createDataFrame(old + [c for c in chunks if c[0] % 4 == 0], CHUNKS))
    index.add(spark.createDataFrame([c for c in chunks if c[0] % 4], CHUNKS))
    index.remove(spark.createDataFrame([(900,), (901,), (-5,)], "memory_id long"))
    assert close(got(index.search(asked, 6)), brute(spark, chunks, QUERIES, 6))
    before = index.batches()
    with pytest.raises(Exception):  # a batch that fails leaves no mark and changes nothing
        index.add(spark.createDataFrame(chunks, CHUNKS).withColumn("text", F.raise_error(F.lit("broken")).cast("string")))
    assert index.batches() == before and close(got(index.search(asked, 6)), brute(spark, chunks, QUERIES, 6))


def test_search_reads_its_terms_buckets_only(spark):
    index = L.temporary_index(spark.createDataFrame(made(4, 80), CHUNKS), buckets=16)
    plan = index._wanted(L.query_terms(spark.createDataFrame([(1, "zeta")], "qid int, text string")))
    files = {f.rsplit("bucket=", 1)[1].split("/")[0] for f in plan.inputFiles()}
    assert len(files) >= 1 and "bucket" in plan._jdf.queryExecution().executedPlan().toString()
    scanned = plan._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert "PartitionFilters" in scanned.toString() and "bucket" in scanned.toString().split("PartitionFilters")[1]


def test_rerank_from_postings_equals_rerank_from_texts(spark):
    chunks = [c for c in made(5, 60) if c[1] == 0]
    index = L.temporary_index(spark.createDataFrame(chunks, CHUNKS))
    asked = spark.createDataFrame(QUERIES, "qid int, text string")
    pool = index.search(asked, 20).join(spark.createDataFrame(chunks, CHUNKS).select("memory_id", "text"), "memory_id").select("qid", "memory_id", "ordinal", "score", "text")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(heuristic_rerank(pool, asked, index=index)) == rows(heuristic_rerank(pool, asked))


def test_empty_index(spark):
    index = L.temporary_index(spark.createDataFrame([], CHUNKS))
    assert index.search(spark.createDataFrame(QUERIES, "qid int, text string"), 3).count() == 0


def test_a_shard_stays_small(spark):
    from quillspark.operators import lexical_index

    rows = spark.range(9000).selectExpr("id AS memory_id", "0 AS ordinal", "concat('word', id % 7) AS text")
    sizes = [r[0] for r in lexical_index._built(rows, 1).filter("word is null").selectExpr("size(offs)").collect()]
    assert sum(sizes) == 9000 and max(sizes) <= 8192


def test_a_larger_batch_is_sorted_by_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD_CHUNKS", 10)
    rows = [(i, 0, f"common word{i % 9} words{i % 5}") for i in range(400)]
    index = L.temporary_index(spark.createDataFrame(rows, CHUNKS), 2)
    postings = index.postings()
    assert max(r["count"] for r in postings.groupBy(F.input_file_name()).count().collect()) < postings.count() / 10
    assert postings.count() == postings.select("term", "shard").distinct().count()
    asked = [(1, "common word3"), (2, "words4 word8")]
    assert got(index.search(spark.createDataFrame(asked, "qid int, text string"), 20)) == brute(spark, rows, asked, 20)
