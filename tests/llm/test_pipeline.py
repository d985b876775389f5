"""The corpus pipeline, stage by stage, against brute force on its own input; odd and empty tables."""

import importlib
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from quillspark.llm import decontaminate, quality, sharding
from quillspark.llm.mixing import mix_copies, word_count

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus_pipeline():
    sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
    return importlib.import_module("corpus_pipeline")


def _shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages_by_brute_force(spark, corpus_pipeline):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, given = docs.columns, [tuple(r) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "simhash", "decontaminate", "mix", "shard"]

    # rejected documents go, all others stay as they are
    scored = quality.score_quality(docs, spark.read.parquet(f"{DATA}/labels.parquet")).collect()
    kept = stages["quality"](spark, docs, DATA).cache()
    assert kept.columns == columns
    rows = [tuple(r) for r in kept.collect()]
    assert Counter(rows) == Counter(tuple(r[c] for c in columns) for r in scored if r["score"] >= 0.5) and 0 < len(rows) < len(given)

    # one row, that of the least id, of each group of texts that links of similarity 0.8 join
    rows = sorted(rows)
    sets = [_shingles(r[1]) for r in rows]
    label = list(range(len(rows)))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in range(20):
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    left = stages["simhash"](spark, kept, DATA).cache()
    got = [tuple(r) for r in left.collect()]
    assert left.columns == columns and sorted(got) == [r for i, r in enumerate(rows) if label[i] == i]

    # no window of ten words of a benchmark item is left
    cut = lambda t: (t or "").encode().translate(decontaminate._CLEAN).split()
    windows = {tuple(w[p : p + 10]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() for w in [cut(r["text"])] for p in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}
    dirty = {r for r in got if any(tuple(w[p : p + n]) in windows for w in [cut(r[1])] for n in sizes for p in range(len(w) - n + 1))}
    clean = stages["decontaminate"](spark, left, DATA).cache()
    assert clean.columns == columns and sorted(tuple(r) for r in clean.collect()) == sorted(set(got) - dirty) and dirty

    # each document as often as the mix takes it
    plan = {r["__id"]: r["copies"] for r in mix_copies(clean, size=word_count(clean["text"]), tie=sharding.row_tie(clean)).collect()}
    mixed = stages["mix"](spark, clean, DATA).cache()
    assert mixed.columns == columns and Counter(r["doc_id"] for r in mixed.collect()) == Counter({i: n for i, n in plan.items() if n})

    # all of them in shards of near equal bytes with gapless slots
    out = stages["shard"](spark, mixed, DATA).collect()
    assert Counter(tuple(r[c] for c in columns) for r in out) == Counter(tuple(r) for r in mixed.collect())
    slots, weight = defaultdict(list), Counter()
    for r in out:
        slots[r["shard"]].append(r["slot"])
        weight[r["shard"]] += len(r["text"].encode()) + 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(weight.values()) <= sum(weight.values()) / 40 + 2 * max(len(r["text"].encode()) + 16 for r in out)

    whole = corpus_pipeline.run(spark, DATA)
    assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, out))


def test_odd_and_empty_tables(spark, odd, none, corpus_pipeline):
    for table in (odd, none):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, DATA)
            assert set(table.columns) <= set(docs.columns), name
        assert docs.count() >= 0


def test_differencing_by_brute_force():
    """The partition differs by nothing from one that plain lists and sorting make."""
    draw = np.random.default_rng(8)
    for k in (2, 3, 5):
        sizes = np.unique(draw.integers(1, 100_000, 60))[::-1]
        parts = [([int(x)] + [0] * (k - 1), [[n]] + [[] for _ in range(k - 1)]) for n, x in enumerate(sizes)]
        while len(parts) > 1:
            parts.sort(key=lambda p: max(p[0]) - min(p[0]), reverse=True)
            a, b = parts.pop(0), parts.pop(0)
            one = sorted(zip(a[0], a[1]), key=lambda x: -x[0])
            two = sorted(zip(b[0], b[1]), key=lambda x: x[0])
            parts.append(([x + y for (x, _), (y, _) in zip(one, two)], [m + n for (_, m), (_, n) in zip(one, two)]))
        start = np.zeros((len(sizes), k), np.int64)
        start[:, 0] = sizes
        place, sums = sharding.difference(start)
        assert sorted(sums.tolist()) == sorted(parts[0][0])
        assert sorted(np.bincount(place[:, 0], sizes, k).astype(int).tolist()) == sorted(parts[0][0])
