"""Joins and rounds that take the place of loops over rows: each against the loop."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions.embed import hash_embedder
from quillspark.operators import bands, claims, keep_first
from quillspark.operators import filters as P
from quillspark.operators import graph as G
from quillspark.operators import history as H
from quillspark.operators import ranking as R
from quillspark.operators.keep_first import dropped_by_first, first_of_alike
from quillspark.plans.ingest import Space, ingest

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)
EDGES = "source_id long, target_id long, type string, confidence double, created_at timestamp"


@pytest.mark.parametrize("one_task", [0, 40, 10**6])
def test_keep_first_equals_the_loop(spark, one_task):
    draw = random.Random(one_task)
    edges = {tuple(sorted(draw.sample(range(80), 2))) for _ in range(120)} | {(k, k + 1) for k in range(100, 120)}
    gone = set()
    for n in range(200):
        if any(b == n and a not in gone for a, b in edges):
            gone.add(n)
    df = spark.createDataFrame(sorted(edges), "first long, later long")
    assert {r.node for r in dropped_by_first(df, one_task).collect()} == gone
    assert dropped_by_first(df.limit(0), one_task).count() == 0


def test_first_of_alike_equals_the_loop(spark):
    draw = random.Random(2)
    words = [f"w{i}" for i in range(14)]
    rows = [(draw.choice(["x", "y", None]), i, " ".join(draw.sample(words, draw.randint(0, 7)))) for i in range(220)]
    kept, want = {}, []
    for g, i, t in rows:
        s = set(t.split())
        if s and any(len(s & k) / len(s | k) >= 0.6 for k in kept.setdefault(g, [])):
            continue
        kept.setdefault(g, []).append(s)
        want.append(i)
    df = spark.createDataFrame(rows, "g string, i long, t string")
    split = F.filter(F.split("t", " "), lambda w: w != "")
    some = df.filter(F.size(split) > 0)
    got = {r.i for r in first_of_alike(some, ["g"], ["i"], split, 0.6).collect()}
    assert got == {i for i in want if rows[i][2]}


@pytest.mark.parametrize("most", [0, 5, 100])
def test_first_of_alike_stores_no_rows_a_word(spark, monkeypatch, most):
    draw, held, was = random.Random(3), [], keep_first.stored
    monkeypatch.setattr(keep_first, "MOST_PAIRED", most, raising=False)
    monkeypatch.setattr(keep_first, "stored", lambda df: held.append(was(df)) or held[-1])
    rows = [(None if i % 9 == 8 else i % 50 if i % 2 else 0, i, draw.sample(range(12), 8)) for i in range(180)]
    kept, want = {}, set()
    for g, i, w in rows:
        if not any(len({*w} & k) / len({*w} | k) >= 0.6 for k in kept.setdefault(g, [])):
            kept[g].append({*w})
            want.add(i)
    df = spark.createDataFrame(rows, "g long, i long, w array<long>").withColumn("w", F.col("w").cast("array<string>"))
    assert {r.i for r in keep_first.first_of_alike(df, ["g"], ["i"], F.col("w"), 0.6).collect()} == want
    if most == 100:
        assert max(d.count() for d in held if "later" not in d.columns) <= len(rows)


@pytest.mark.parametrize("low, high", [(0.97, None), (0.72, 0.97), (0.3, 0.6), (-0.2, 0.1)])
def test_band_join_equals_all_pairs(spark, monkeypatch, low, high):
    monkeypatch.setattr(bands, "UNIT_ROWS", 17)
    draw = np.random.default_rng(7)
    centres = draw.normal(size=(6, 12))
    vectors = [(int(i), (centres[i % 6] + draw.normal(scale=0.25, size=12)).tolist()) for i in range(150)]
    vectors += [(200, [0.0] * 12), (201, [1.0, 2.0]), (202, None), (203, [None] * 12), (204, [1.0, 2.1]), (205, [])]
    new = spark.createDataFrame([v for v in vectors if v[0] % 3 == 0 or v[0] > 199], "id long, embedding array<double>")
    old = spark.createDataFrame(vectors, "id long, embedding array<double>")
    want = set()
    fine = [(i, np.array(v)) for i, v in vectors if v and None not in v]
    for i, a in fine:
        for j, b in fine:
            if (i % 3 == 0 or i > 199) and i != j and len(a) == len(b):
                norm = np.linalg.norm(a) * np.linalg.norm(b)
                sim = round(float(np.clip(a @ b / norm, -1, 1)), 9) + 0.0 if norm else 0.0
                if sim >= low and (high is None or sim < high):
                    want.add((i, j))
    assert {(r.new_id, r.old_id) for r in bands.similar_pairs(new, old, low, high).collect()} == want


def test_band_join_compares_few_pairs_of_groups(spark):
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(40, 32))
    rows = [(i, (centres[i % 40] + draw.normal(scale=0.1, size=32)).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    done, whole = bands.compared(df, df, 0.97)
    assert done < whole / 10


def one_by_one(space, rows, schema, spark, model):
    reports = []
    for r in sorted(rows):
        state = ingest(space, spark.createDataFrame([r], schema), hash_embedder(64), T0, model)
        space = state.space
        reports += [tuple(x) for x in state.report.collect()]
    return space, sorted(reports)


def test_batch_equals_one_by_one(spark):
    schema = "id string, content string, source string, occurred_at timestamp, tags array<string>"
    base = "the harbour crane is moved to the north pier by the night crew every second week of the month"
    chain = [base + " s" * k for k in range(4)]
    others = ["Berta Klein owns 4 boats in Porto"]
    rows = [(f"m{i:02d}", t, "a", T0 + timedelta(days=max(0, i - 3)), ["x"]) for i, t in enumerate([*chain, *others])]

    def model(prompts):
        return ['[{"n": 1, "supersedes": true, "confidence": 0.9, "old_value": "3 boats", "new_value": "4 boats"}]'] * len(prompts)

    none = Space(
        spark.createDataFrame([], "id string, content string, source string, kind string, status string, occurred_at timestamp, tags array<string>, version int"),
        spark.createDataFrame([], "memory_id string, ordinal int, text string, embedding array<double>"),
        spark.createDataFrame([], "source_id string, target_id string, type string, confidence double, created_at timestamp"),
    )
    start = ingest(none, spark.createDataFrame([("a0", "Berta Klein owns 3 boats", "a", T0, ["x"])], schema), hash_embedder(64), T0, model).space
    space, reports = one_by_one(start, rows, schema, spark, model)
    batch = ingest(start, spark.createDataFrame(rows, schema), hash_embedder(64), T0, model)
    assert sorted(tuple(r) for r in batch.report.collect()) == reports
    state = lambda s: (sorted((r.id, r.status, r.version) for r in s.memories.collect()), sorted((r.source_id, r.target_id, r.type, round(r.confidence, 6)) for r in s.edges.collect()), s.chunks.count())
    assert state(batch.space) == state(space)
    assert {r[1] for r in reports} >= {"created", "near_duplicate"}


def test_statements_that_say_less(spark):
    cases = [
        ("Mara works with Delft Harbour", "Mara is Chief Pilot and co-owner of Delft Harbour Tugs B.V. since May 2026", True),
        ("the price is $45.00 now", "the price is 60 now", False),
        ("Anna moved to Oslo", "Anna lives in Rome", False),
        ("the crane costs 45", "the crane costs 60 each month of 2024", True),
        ("totally other words here", "Anna lives in Rome since 2020 with two cats", False),
        ("", "Anna lives in Rome", False),
    ]
    df = spark.createDataFrame(cases, "n string, o string, want boolean")
    assert [(r.n, r.got) for r in df.select("n", claims.says_less(F.col("n"), F.col("o")).alias("got")).collect()] == [(n, w) for n, _, w in cases]


def bfs(roots, steps, most):
    out = set()
    for root in roots:
        seen, frontier = {root}, {root}
        for d in range(1, most + 1):
            frontier = {b for a, b in steps if a in frontier} - seen
            seen |= frontier
            out |= {(root, n, d) for n in frontier}
    return out


@pytest.mark.parametrize("most", [1, 3, 6, 20])
def test_closures(spark, most):
    draw = random.Random(most)
    steps = [(draw.randrange(40), draw.randrange(40)) for _ in range(45)] + [(k, k + 1) for k in range(50, 80)] + [(90, 90)]
    df = spark.createDataFrame(steps, "from long, to long")
    for roots in (range(95), [3, 50, 777]):
        got = G.reach(spark.createDataFrame([(r,) for r in roots], "root long"), df, most)
        assert {tuple(r) for r in got.select("root", "node", "depth").collect()} == bfs(roots, steps, most)


@pytest.mark.parametrize("most", [1, 3, 20])
def test_chains(spark, most):
    draw = random.Random(4)
    edges = [(b, a, "supersedes", 1.0, T0 + timedelta(days=draw.randrange(5))) for a, b in [(draw.randrange(30), draw.randrange(30)) for _ in range(30)] + [(k, k + 1) for k in range(50, 90)] + [(95, 96), (96, 97), (97, 95)] if a != b]
    step = {}
    for s, t, _, _, at in sorted(edges, key=lambda e: (e[4], e[0])):
        step.setdefault(t, s)
    want = {}
    for root in range(100):
        path = [root]
        while len(path) <= most and path[-1] in step and step[path[-1]] not in path:
            path.append(step[path[-1]])
        want[root] = (path[-1], len(path) - 1)
    got = G.lineage_heads(spark.createDataFrame(edges, EDGES), spark.createDataFrame([(r,) for r in range(100)], "root long"), most)
    assert {r.root: (r["head"], r.depth) for r in got.collect()} == want


def test_limited_closure_stops_a_root(spark):
    edges = [(1, k, "depends_on", 1.0, T0) for k in range(10, 40)] + [(10, k, "derived_from", 1.0, T0) for k in range(100, 130)] + [(2, 3, "depends_on", 1.0, T0), (3, 4, "depends_on", 1.0, T0), (4, 2, "references", 1.0, T0)]
    df, roots = spark.createDataFrame(edges, EDGES), spark.createDataFrame([(1,), (2,), (9,)], "root long")
    got = {tuple(r) for r in G.limited_closure(df, roots, 5, 5).select("root", "node", "depth", "truncated").collect()}
    assert got == {(1, k, 1, True) for k in range(10, 15)} | {(2, 3, 1, False), (2, 4, 2, False)}


def test_as_of_carries_versions_forward(spark):
    v = [(1, 1, "a", T0, T0 + timedelta(days=2)), (1, 2, "b", T0 + timedelta(days=2), T0 + timedelta(days=2)), (1, 3, "c", T0 + timedelta(days=2), T0 + timedelta(days=5)), (2, 1, "x", T0, None), (None, 1, "n", T0, None)]
    q = [(k, m, T0 + timedelta(days=d)) for k, (m, d) in enumerate([(1, -1), (1, 0), (1, 1), (1, 2), (1, 5), (2, 900), (3, 1), (None, 1)])]
    got = H.as_of_each(spark.createDataFrame(v, "memory_id long, version int, content string, valid_from timestamp, valid_to timestamp"), spark.createDataFrame(q, "qid long, memory_id long, at timestamp"))
    assert {r.qid: r.content for r in got.collect()} == {1: "a", 2: "a", 3: "c", 5: "x"}


def test_wide_ranks_equal_ranks(spark):
    draw = random.Random(1)
    rows = [(draw.choice(["a", "b", "c", None]), i, draw.choice([0.5, 0.25, 1.0, None])) for i in range(500)]
    df = spark.createDataFrame(rows, "qid string, memory_id long, score double")
    assert sorted(map(str, R.ranked_wide(df).select("qid", "memory_id", "rank").collect())) == sorted(map(str, R.ranked(df).select("qid", "memory_id", "rank").collect()))


def test_typed_metadata(spark):
    rows = [(1, '{"a": 1, "b": "1", "c": true}'), (2, '{"a": 1.0, "b": null}'), (3, '{"a": "1"}'), (4, '{"a": true}'), (5, "{}"), (6, None), (7, '{"a": [1], "x y": "z"}')]
    df = spark.createDataFrame(rows, "id int, j string").select("id", F.parse_json("j").alias("metadata"))
    ids = lambda *pairs: [r.id for r in df.filter(P.MemoryFilter(frozenset(), metadata=pairs, in_variant=True).column()).orderBy("id").collect()]
    assert ids(("a", 1)) == [1, 2] and ids(("a", "1")) == [3] and ids(("a", True)) == [4] and ids(("b", None)) == [2, 3, 4, 5, 6, 7]
    assert ids(("x y", "z")) == [7] and ids(("a", 1), ("c", True)) == [1] and ids(("a", 2)) == []


def test_band_join_deals_by_columns_not_by_pivots(spark, monkeypatch):
    monkeypatch.setattr(bands, "UNIT_ROWS", 100)
    x = np.random.default_rng(3).normal(size=(400, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, [1.0, float(i)]) for i in range(250)], "id long, embedding array<double>")
    one, held, layout = bands._dealt(df, df, 0.45)
    columns = [{int(f) + k for f, n in zip(c[4], c[5]) for k in range(n)} for c in layout.cells.values()]
    assert held.select("size", "cell").distinct().count() > 20 and sum(map(len, columns)) <= 4 + 1 + 3 + 1
    assert len(set.union(*columns)) == sum(map(len, columns)) and one.count() == 650
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i, j in zip(*np.nonzero(unit @ unit.T >= 0.45)) if i != j}
    assert {(r.new_id, r.old_id) for r in bands.similar_pairs(df, df, 0.45, None).collect() if r.new_id < 1000 and r.old_id < 1000} == want
