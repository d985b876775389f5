"""Diversification of the registered query against a plain loop over all pairs."""

import math

from pyspark.sql import functions as F

from quillspark.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_mmr_query_equals_the_loop(spark):
    vectors = {r.memory_id: list(r.embedding) for r in catalogue.X.chunks_vec(spark, SF).collect()}
    pools = {}
    for r in catalogue._by_vector(spark, SF, 60).collect():
        pools.setdefault(r.qid, {})[r.memory_id] = r.score

    def cosine(a, b):
        dot = sum(x * y for x, y in zip(a, b))
        return dot / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    got = {}
    for r in catalogue.mmr_topk(spark, SF).orderBy("qid", F.col("rank")).collect():
        got.setdefault(r.qid, []).append(r.memory_id)
    want = {}
    for qid, pool in pools.items():
        low, high, chosen = min(pool.values()), max(pool.values()), []
        while len(chosen) < min(10, len(pool)):
            value = {}
            for m, s in pool.items():
                if m not in chosen:
                    rel = 1.0 if high == low else (s - low) / (high - low)
                    worst = max((cosine(vectors[m], vectors[c]) for c in chosen), default=0.0)
                    value[m] = round(0.7 * rel - 0.3 * worst, 12)
            chosen.append(min(value, key=lambda m: (-value[m], m)))
        want[qid] = chosen
    assert got == want and len(got) >= 4
