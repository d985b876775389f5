"""The whole search of the registered query against plain loops over the arms' rows, which have SQL of their own."""

import math
from datetime import datetime, timezone

from pyspark.sql import functions as F

from quillspark.functions.text import analyze
from quillspark.plans import catalogue

SF = "/root/testdata/sf0.001"
NOW = datetime(2024, 6, 1, tzinfo=timezone.utc)


def test_search_production_equals_loops(spark):
    vector, lexical = ({} for _ in range(2))
    for rows, into in zip(catalogue._arms(spark, SF), (vector, lexical)):
        for r in rows.collect():
            into.setdefault(r.qid, []).append((r["rank"], r.memory_id, r.score))
    live = catalogue.X.memories_text(spark, SF).filter("status = 'active'")
    about = {r.id: r for r in live.select("id", "source", F.unix_micros("occurred_at").alias("at"), analyze(F.col("content")).alias("terms")).collect()}
    asked = {r.qid: r.terms for r in catalogue._questions(spark, SF).select("qid", analyze(F.col("text")).alias("terms")).collect()}
    want = {}
    for qid in sorted(set(vector) | set(lexical)):
        fused = {}
        for rows, weight in ((vector.get(qid, []), 1.0), (lexical.get(qid, []), 1.15)):
            for rank, m, _ in rows:
                fused[m] = fused.get(m, 0.0) + weight / (60 + rank)
        pool = sorted(((round(s, 9), m) for m, s in fused.items()), key=lambda x: (-x[0], x[1]))[:32]
        words, terms = asked[qid], sorted(set(asked[qid]))
        df = {t: sum(t in about[m].terms for _, m in pool) for t in terms}
        scored = []
        for prior, m in pool:
            own = about[m].terms
            hit = [t for t in terms if t in own]
            base = sum(math.log(1 + (len(pool) + 1) / (df[t] + 1)) * own.count(t) / (own.count(t) + 1.2) for t in hit)
            score = base * (0.5 + 0.5 * len(hit) / len(terms)) if terms else prior
            if terms:
                phrase = len(hit) == len(terms) and " ".join(words) in " ".join(own)
                score = 0.0 if not own else round(score * (1.35 if phrase else 1.0) + 0.15 * prior, 6)
            age = max(0.0, (NOW.timestamp() * 1e6 - about[m].at) / 86_400e6)
            factor = 0.25 if age > 36_500 else 0.25 + 0.75 * 0.5 ** (age / 180)
            scored.append((round(score * factor, 9), m))
        seen, out = {}, []
        for score, m in sorted(scored, key=lambda x: (-x[0], x[1])):
            key = about[m].source if about[m].source else f"own:{m}"
            seen[key] = seen.get(key, 0) + 1
            if seen[key] <= 3:
                out.append((m, score))
        want[qid] = out[:10]
    got = {}
    for r in catalogue.search_production(spark, SF).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.memory_id, r.score))
    assert set(got) == set(want)
    for qid, rows in want.items():
        assert [m for m, _ in got[qid]] == [m for m, _ in rows], qid
        assert all(abs(a - b) < 2e-6 for (_, a), (_, b) in zip(got[qid], rows))
