"""Each operator against brute force on small tables, and on odd and empty ones."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, embedding_dedup, line_dedup, mixing, packing, quality, sharding, simhash, substring, url_filter, verify
from quillspark.llm.components import components

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_components(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)] + [(None, 5), (7, None), (9, 9)]
    label = {n: n for e in edges for n in e if None not in e and e[0] != e[1]}
    for _ in range(80):
        for a, b in edges:
            if a in label and b in label and a != b:
                label[a] = label[b] = min(label[a], label[b])
    for one_task in (1_000_000, 0):
        got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), one_task=one_task).collect()}
        assert got == label
    hub = [(10**6, k) for k in range(500, 3000)] + [(k, 10**6 + 1) for k in range(2990, 5000)]
    got = components(spark.createDataFrame(hub, "a long, b long"), one_task=0).agg(F.min("root"), F.max("root"), F.count("*")).first()
    assert tuple(got) == (500, 500, 4502)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- op1


def test_differencing_is_tight():
    draw = np.random.default_rng(1)
    sizes = draw.integers(1, 1000, 3000)
    parts = np.zeros((3000, 7), np.int64)
    parts[:, 0] = sizes
    place, _ = sharding.difference(parts)
    sums = np.bincount(place[:, 0], sizes, 7)
    assert sums.max() - sums.min() <= 2


def test_shards(docs, odd, none):
    rows = sharding.shard_by_bytes(docs, 8).collect()
    assert len(rows) == docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    by, bytes_, homes = defaultdict(list), Counter(), defaultdict(set)
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 16
        by[r["shard"]].append(r["slot"])
        bytes_[r["shard"]] += r["size"]
        homes[texts[r["doc_id"]]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert all(len(h) == 1 for h in homes.values())
    assert max(bytes_.values()) - min(bytes_.values()) < 0.1 * sum(bytes_.values()) / 8
    again = sharding.shard_by_bytes(docs.repartition(7), 8).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, again), key=repr)
    placed = sharding.shard_documents(odd, 3)
    assert placed.count() == odd.count() and set(placed.columns) == {*odd.columns, "slot"}
    assert sharding.shard_by_bytes(none).count() == 0


def test_a_heavy_group_is_cut(spark):
    rows = spark.createDataFrame([(i, "same text here" if i % 3 else f"text {i}") for i in range(600)], "doc_id long, text string")
    sums = Counter()
    for r in sharding.shard_by_bytes(rows, 10).collect():
        sums[r["shard"]] += r["size"]
    assert len(sums) == 10 and max(sums.values()) < 1.2 * min(sums.values())


# --- op2


def test_embedding_links(spark):
    draw = np.random.default_rng(5)
    base = draw.normal(size=(300, 16))
    near = np.concatenate([base, base[:60] + draw.normal(0, 0.08, (60, 16)), base[:40] * 2, np.repeat(base[:1], 30, 0)])
    rows = [(i, [float(x) for x in v.astype(np.float32)]) for i, v in enumerate(near)]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [None] + [1.0] * 15), (904, []), (905, [1.0] * 8), (906, [2.0] * 8), (None, [1.0] * 4)]
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_links(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")).collect()}
    v = np.array([r[1] for r in rows], np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    link = (v @ v.T >= 0.95) & ~np.eye(len(v), dtype=bool)
    label = np.arange(len(v))
    for _ in range(len(v)):
        label = np.minimum(label, np.where(link, label[None, :], len(v)).min(1))
    assert [got[i]["n_links"] for i in range(len(v))] == link.sum(1).tolist()
    assert [got[i]["component_id"] for i in range(len(v))] == label.tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(900, 905))
    assert got[906]["component_id"] == 905 and got[905]["n_links"] == 1
    assert embedding_dedup.embedding_links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_units_whose_recall_is_too_low(spark, monkeypatch):
    draw = np.random.default_rng(8)
    base = draw.normal(size=(200, 16))
    x = np.concatenate([base, base[:80] + draw.normal(0, 0.05, (80, 16)), base[:1] + draw.normal(0, 0.02, (60, 16))]).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    run = lambda: sorted(map(tuple, embedding_dedup.embedding_links(table, shards=3).collect()))
    by_graph = run()
    monkeypatch.setattr(embedding_dedup, "RECALL", 2.0)  # no beam reaches it
    assert run() == by_graph


def test_graph_recall():
    draw = np.random.default_rng(6)
    x = draw.normal(size=(3000, 32)).astype(np.float32)
    x = np.concatenate([x, x[:500] + draw.normal(0, 0.05, (500, 32)).astype(np.float32)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = embedding_dedup.Graph(x)
    ef, recall = embedding_dedup.audited_beam(graph, x, 0.95)
    a, b, dense = graph.within(x, 0.95, ef)
    truth = np.argwhere(x @ x.T >= 0.95)
    assert recall >= embedding_dedup.RECALL and not len(dense)
    assert len(set(zip(a.tolist(), b.tolist())) & set(map(tuple, truth.tolist()))) >= 0.99 * len(truth)


@pytest.mark.parametrize("kind,spread", [("float", 0.01), ("double", 0.025), ("float", 0.03)])
def test_a_large_group_of_vectors(spark, kind, spread):
    draw = np.random.default_rng(15)
    x = np.concatenate([draw.normal(0, 0.125, (400, 64)), draw.normal(0, 0.125, 64) + draw.normal(0, spread, (1500, 64))])
    x = x.astype(np.float32).astype(float) if kind == "float" else x
    table = spark.createDataFrame([(i, v.tolist(), "a", 1) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>, node string, dim int")
    table = table.union(table.filter("vec_id = 1000"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_links(table).collect()}
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    n = link.sum(1) + link[:, 1000]
    n[1000] += 1
    label = np.arange(len(x))
    while (label != (new := np.minimum(label, np.where(link, label[None, :], len(x)).min(1)))).any():
        label = new
    assert got == {i: (int(n[i]), int(label[i])) for i in range(len(x))}


# --- op3


def _simhash(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _classes(rows):
    label = [r[0] if r[0] is not None else 10**9 + k for k, r in enumerate(rows)]
    codes = [_simhash(r[1]) for r in rows]
    for _ in rows:
        old = list(label)
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (codes[i] ^ codes[j]).bit_count() <= 4:
                    label[i] = label[j] = min(label[i], label[j])
        if old == label:
            return codes, label


def test_simhash(spark, docs, odd, none):
    for table in (docs, odd):
        rows = [(r["doc_id"], r["text"]) for r in table.collect()]
        codes, label = _classes(rows)
        got = Counter((r["__id"], r["__fp"] % 2**64, r["component_id"]) for r in simhash.simhash_classes(table).collect())
        assert got == Counter((r[0], c, l if l < 10**9 else None) for r, c, l in zip(rows, codes, label))
    assert simhash.simhash_classes(none).count() == 0 == simhash.drop_near_copies(none).count()
    kept = simhash.drop_near_copies(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len(set(_classes([(r["doc_id"], r["text"]) for r in odd.collect()])[1]))


def test_fingerprints_of_long_texts(spark, monkeypatch):
    draw = random.Random(2)
    text = " ".join("".join(draw.choice("abcXYZé") for _ in range(draw.randint(1, 9))) for _ in range(600_000)) + "  "
    rows = [(1, text), (2, "x" * 3_000_000), (3, " " * 3_000_000 + "a b")]
    got = {r["__id"]: r["__fp"] % 2**64 for r in simhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: _simhash(t) for d, t in rows}


@pytest.mark.parametrize("limit", [8192, 40])
def test_near_codes_links_all_pairs(spark, limit):
    draw = random.Random(7)
    codes = {draw.getrandbits(64) for _ in range(300)}
    for c in list(codes)[:60]:
        for _ in range(6):
            for b in draw.sample(range(64), draw.randint(1, 5)):
                c ^= 1 << b
            codes.add(c)
    codes |= {(5 << 40) + k for k in range(300)}  # one masked pattern holds very many
    codes = sorted(codes)
    table = spark.createDataFrame([(c - 2**64 if c >> 63 else c,) for c in codes], "fp long")
    roots = {r["node"] % 2**64: r["root"] for r in components(simhash.near_codes(table, limit=limit)).collect()}
    x = np.array(codes, np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 4
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(x)).min(1))
        if (new == label).all():
            break
        label = new
    for i in range(len(x)):
        assert (codes[i] in roots) == (near[i].sum() > 1)
    groups, mine = defaultdict(set), defaultdict(set)
    for i, c in enumerate(codes):
        groups[label[i]].add(c)
        mine[roots.get(c, ("alone", c))].add(c)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def _alike(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in (a, b))
    return len(x & y) >= 0.8 * len(x | y)


def test_near_texts_by_five_words(spark, odd, none):
    draw = random.Random(9)
    words = ["".join(draw.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(400)]
    rows, texts = [], []
    for k in range(40):
        base = [draw.choice(words) for _ in range(draw.randint(120, 300))]
        for _ in range(draw.randint(1, 5)):
            copy = list(base)
            for _ in range(draw.randint(0, 4)):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            texts.append(" ".join(copy))
    rows = [(i, t) for i, t in enumerate(texts + texts[:5])]
    label = list(range(len(rows)))
    for _ in range(6):
        for i, (_, a) in enumerate(rows):
            for j in range(i):
                if _alike(a, rows[j][1]):
                    label[i] = label[j] = min(label[i], label[j])
    got = [r["doc_id"] for r in simhash.drop_near_texts(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == sorted(set(label))
    kept = simhash.drop_near_texts(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "2", "5", "8"]
    assert simhash.drop_near_texts(none).count() == 0


# --- op4


def test_quality(spark, odd, none):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r["doc_id"]: r for r in quality.score_quality(docs, labels).collect()}
    held = [(got[r["doc_id"]], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert np.mean([g["predicted"] == q for g, q in held]) > 0.95
    assert all(0 <= g["score"] <= 1 for g, _ in held)
    scored = quality.score_quality(odd, labels.limit(0))
    assert scored.count() == odd.count() and {r["score"] for r in scored.collect()} == {0.5}
    assert set(scored.columns) == {*odd.columns, "held_out", "predicted"}
    assert quality.score_quality(none, labels).count() == 0


def test_word_vectors_and_pooling_by_brute_force(spark, monkeypatch):
    texts = ["The cat sat, the cat ran 42 times!", "a b a b a", None, "", "  ", "it's über-cool... " * 3]
    words = [[m.group() for m in __import__("regex").finditer(r"[A-Za-z\x80-\U0010ffff]+|[0-9]+|([^A-Za-z0-9\s\x80-\U0010ffff])\1*", t or "")] for t in texts]
    bucket = lambda w: xxhash.xxh64_intdigest(w.encode(), 42) % quality.BUCKETS
    index, total, often = quality.index_vectors(), np.zeros((quality.BUCKETS, quality.DIMENSIONS)), np.zeros((quality.BUCKETS, 1))
    for ws in words:
        for i, w in enumerate(ws):
            often[bucket(w)] += 1
            for j in range(max(0, i - quality.SIDE), min(len(ws), i + quality.SIDE + 1)):
                if j != i:
                    total[bucket(w)] += index[bucket(ws[j])]
    often /= often.sum()
    total = total - often.T @ total
    size = np.linalg.norm(total, axis=1, keepdims=True)
    want = total / np.where(size > 0, size, 1) * (1e-3 / (1e-3 + often)) ** 0.5
    got = quality.fit_word_vectors(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert np.allclose(got, want, atol=1e-5)
    import pyarrow as pa

    pooled = quality._pooled(pa.array(texts), got)
    for t, p in zip(words, pooled):
        x = got[[bucket(w) for w in t]]
        assert np.allclose(p, np.concatenate([x.mean(0), x.std(0)]) if len(t) else 0, atol=1e-3)
    long = " ".join(f"w{k % 50} {k % 7}" for k in range(4000))
    whole = quality._pooled(pa.array([long]), got)
    for name, value in (("CHUNK_BYTES", 3000), ("STEP_BYTES", 2000), ("STEP_WORDS", 500)):
        monkeypatch.setattr(quality, name, value)
    assert np.allclose(quality._pooled(pa.array([long]), got), whole, atol=1e-5)


def test_temperature_and_network():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(2000, 8))
    p = 1 / (1 + np.exp(-2 * x[:, 0]))
    net = quality.fit_network(x, (draw.random(2000) < p).astype(int))
    assert np.abs(net.score(x) - p).mean() < 0.08


# --- op5


def test_pivot_keeps_words():
    draw = np.random.default_rng(3)
    for _ in range(50):
        size, mass = draw.integers(1, 500, 80).astype(float), draw.random(80)
        out, left = mixing.pivot(mass, size, draw.random(80))
        assert abs((out * size).sum() - (mass * size).sum()) < 1e-5 * size.sum()
        assert all(v in (0, 1) for k, v in enumerate(out) if k != left)


def test_mix(spark, docs, odd, none):
    plan = mixing.mix_copies(docs).collect()
    size, target, taken, largest = Counter(), {}, Counter(), Counter()
    for r in plan:
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
        taken[r["source"]] += r["copies"] * r["size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert 0 <= r["copies"] <= 2
    order = sorted(size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, free, budget = {}, set(order), 1.5 * sum(size.values())
    while True:
        left = budget - sum(2 * size[s] for s in order if s not in free)
        want = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = {s for s in free if want[s] > 2 * size[s]}
        if not over:
            break
        free -= over
    for s in order:
        assert target[s] == pytest.approx(want.get(s, 2 * size[s]))
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
    assert sorted(map(repr, plan)) == sorted(map(repr, mixing.mix_copies(docs.repartition(5)).collect()))
    mixed = mixing.mix_documents(odd)
    assert mixed.columns == odd.columns
    assert mixed.count() == sum(r["copies"] for r in mixing.mix_copies(odd).collect())
    assert mixing.mix_documents(none).count() == 0


def test_results_do_not_follow_the_cores(spark, docs):
    """Rows of one id, parallelism and partitions: op1's slots and op5's draws stay."""
    rows = docs.union(docs.limit(50).withColumn("source", F.lit("other"))).union(docs.limit(3))
    runs = []
    for cores, parts in ((1, 1), (16, 9)):
        context = type(spark.sparkContext)
        old = context.defaultParallelism
        context.defaultParallelism = property(lambda self, n=cores: n)
        try:
            table = rows.repartition(parts)
            runs.append([Counter(map(repr, x.collect())) for x in (sharding.shard_by_bytes(table), sharding.shard_documents(table, 7), mixing.mix_copies(table), mixing.mix_documents(table))])
        finally:
            context.defaultParallelism = old
    assert runs[0] == runs[1]


# --- op6


def test_packing_round_trip(docs, odd, none):
    encode = packing.load_tokenizer("x.tiktoken", open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb").read())
    for table in (docs, odd):
        got = defaultdict(list)
        for r in packing.pack_tokens(table, length=300).collect():
            ids, at = np.frombuffer(r["input_ids"], "<u2"), np.frombuffer(r["position_ids"], "<u2")
            assert len(ids) == 300 and r["cu_seqlens"][-1] == r["n_tokens"]
            for k, d in enumerate(r["doc_ids"]):
                a, b = r["cu_seqlens"][k : k + 2]
                assert at[a:b].tolist() == list(range(b - a))
                got[d].append((r["doc_starts"][k], ids[a:b].tolist()))
        want = Counter(t for r in table.collect() if r["text"] for t in encode([r["text"]])[0] + [50256])
        assert Counter(t for parts in got.values() for _, p in parts for t in p) == want
        if table is docs:
            for r in docs.collect():
                assert [t for _, p in sorted(got[r["doc_id"]]) for t in p] == encode([r["text"]])[0] + [50256]
    assert packing.pack_tokens(none).count() == 0


def test_long_runs_are_packed(spark):
    encode = packing.load_tokenizer("x.tiktoken", open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb").read())
    texts = [" " * 2_000_000, "a" * 300_000, "word and\n\n  more " * 20_000, "x \u00a0 " * 50_000]
    got = defaultdict(list)
    for r in packing.pack_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        ids = np.frombuffer(r["input_ids"], "<u2")
        for k, d in enumerate(r["doc_ids"]):
            got[d].append((r["doc_starts"][k], ids[r["cu_seqlens"][k] : r["cu_seqlens"][k + 1]].tolist()))
    import tiktoken

    ranks = {__import__("base64").b64decode(a): int(b) for a, b in map(bytes.split, open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb").read().splitlines())}
    coder = tiktoken.Encoding("packing", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for d, t in enumerate(texts):
        assert coder.decode([i for _, p in sorted(got[d]) for i in p][:-1]) == t
    assert encode(texts[2:]) == [coder.encode_ordinary(t) for t in texts[2:]]


def test_texts_are_encoded_by_characters(monkeypatch):
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    with open(path, "rb") as f:
        encode = packing.load_tokenizer(path, f.read())
    texts = ["a b " * 100, None, "", "word, and \n words " * 900, "é漢 " * 70, *["short"] * 200]
    whole = [np.array(x) for x in encode([t or "" for t in texts])]
    monkeypatch.setattr(packing, "SLICE_CHARS", 1000)
    most, got = 0, {}
    for lo, made in packing.encoded(encode, pa.array(texts), True):
        most = max(most, len(made))
        got |= {lo + i: t.tolist() for i, t in enumerate(made)}
    assert got == {i: t.tolist() for i, t in enumerate(whole)} and most <= 64


def test_best_fit_is_best():
    draw = random.Random(4)
    for _ in range(100):
        length = draw.randint(1, 40)
        sizes = np.array([draw.randint(1, length) for _ in range(draw.randint(1, 60))])
        bins = packing.best_fit_decreasing(sizes, length)
        left = []
        for i in np.argsort(-sizes, kind="stable"):
            fits = [(c, k) for k, c in enumerate(left) if c >= sizes[i]]
            if fits:
                left[min(fits)[1]] -= sizes[i]
            else:
                left.append(length - sizes[i])
        assert sorted(left) == sorted(length - sizes[b].sum() for b in bins)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))


# --- op7


def test_fuzzy_lines(spark, docs, odd, none):
    got = {r["doc_id"]: r for r in line_dedup.remove_fuzzy_lines(docs, texts=True).collect()}
    rows = sorted((r["doc_id"], [x.strip(" \t\r\x0b\x0c") for x in (r["text"] or "").split("\n")]) for r in docs.collect())
    first, names = {}, []
    for d, lines in rows:
        for n, x in enumerate(lines):
            if x and x not in first:
                first[x] = (d, n)
                names.append(x)
    sets = [set(line_dedup.line_set(x).tolist()) for x in names]
    label = list(range(len(names)))
    pairs = [(i, j) for i in range(len(names)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in range(20):
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    head, at = {}, {x: k for k, x in enumerate(names)}
    for k, x in enumerate(names):
        head[label[k]] = min(head.get(label[k], first[x]), first[x])
    for d, lines in rows:
        assert got[d]["removed_lines"] == [n for n, x in enumerate(lines) if x and head[label[at[x]]] != (d, n)]
    assert line_dedup.remove_fuzzy_lines(odd).count() == odd.count()
    twins = spark.createDataFrame([(1, "one shared line of text\nfirst"), (1, "one shared line of text\nsecond"), (2, "one shared line of text")], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in line_dedup.remove_fuzzy_lines(twins).collect()) == [0, 1, 1]
    assert line_dedup.remove_fuzzy_lines(none).count() == 0


def test_line_slices(monkeypatch):
    import pyarrow as pa

    draw = random.Random(21)
    texts = [None, "", "\n", " \n \n", "\n\nab\n", "é \r\n\t漢字 x \n"] + ["".join(draw.choice("ab \n\té") for _ in range(draw.randint(0, 60))) for _ in range(80)] + ["x" * 50 + "\n" + " y" * 40 + "\n\n" + "z\n" * 30]
    want = [(r, n, x.strip(" \t\r\x0b\x0c")) for r, t in enumerate(texts) for n, x in enumerate((t or "").split("\n")) if x.strip(" \t\r\x0b\x0c")]
    for size in (1 << 20, 40, 16):
        slices = line_dedup.text_slices
        monkeypatch.setattr(line_dedup, "CHUNK_BYTES", size)
        monkeypatch.setattr(line_dedup, "text_slices", lambda t, k=size: slices(t, k))
        got = []
        for row, number, ids, data, starts, ends in line_dedup.line_slices(pa.array(texts)):
            lines = [data[a:b].decode() for a, b in zip(starts, ends)]
            assert ids.tolist() == [xxhash.xxh64_intdigest(x.encode(), 42) for x in lines]
            got += zip(row.tolist(), number.tolist(), lines)
        monkeypatch.undo()
        assert got == want


def test_buckets_are_compared_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(verify, "BUCKET", 3)
    draw = random.Random(8)
    words = ["".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(40)]
    lines = [" ".join(words[:30] + [words[30 + k % 5] * 2, str(k) * 3]) for k in range(25)]
    table = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string")
    gone = sum(r["n_removed"] for r in line_dedup.remove_fuzzy_lines(table).collect())
    assert gone == 24


# --- op8


def test_url_rules(spark):
    rules = [url_filter.UrlRule("org", "/", "allow"), url_filter.UrlRule("example.org", "/en/1", "block"), url_filter.UrlRule("a.b", "/cd", "block"), url_filter.UrlRule("b", "/cdxx", "allow")]
    urls = ["http://Example.ORG/en/1?x", "https://x.example.org/en/12#y", "https://notexample.org/en/1", "http://org", "no scheme/en/1", None, "", "http://a.b/cdxx", "ftp://u@x.org:80/p", "http://ÄÖ.org/É", "http://example.org/en/1"]
    table = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls + urls[:1])], "page_id long, url string, host string")
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.apply_url_rules(table, url_filter.rules_table(spark, rules)).orderBy("page_id").collect()]
    assert got[0][1:] == ("example.org", "/en/1", "example.org/en/1", "block") == got[11][1:]
    assert got[1][1:] == ("x.example.org", "/en/12", "example.org/en/1", "block")
    assert got[2][3:] == ("org/", "allow") and got[3][1:] == ("org", "", None, "allow")
    assert all(g[1:] == ("", "", None, "allow") for g in got[4:7])
    assert got[7][3:] == ("a.b/cd", "block") and got[8][1] == "u@x.org:80" and got[9][1:3] == ("ÄÖ.org", "/É")
    dealt = url_filter.apply_url_rules(table, url_filter.rules_table(spark, rules), sent_rules=0).orderBy("page_id")
    assert [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in dealt.collect()] == got
    dealt = url_filter.apply_url_rules(table, url_filter.rules_table(spark, rules), sent_rules=0, sent_filter=0).orderBy("page_id")
    assert [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in dealt.collect()] == got
    assert url_filter.apply_url_rules(table, url_filter.rules_table(spark, []), otherwise="block").filter("verdict = 'block'").count() == 12
    assert url_filter.apply_url_rules(table.limit(0), url_filter.rules_table(spark, rules)).count() == 0


def test_url_plan_has_no_python(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    plan = url_filter.apply_url_rules(pages, url_filter.rules_table(spark, [url_filter.UrlRule("org", "/", "allow")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_a_million_url_rules(spark):
    rules = spark.range(1_000_000).selectExpr("concat('h', id, '.com') as host", "concat('/', id % 7) as path", "'block' as verdict")
    rules = rules.union(spark.createDataFrame([("com", "/", "allow")], rules.schema))
    pages = spark.range(3000).selectExpr("id as page_id", "concat('http://x.h', id * 331, '.com/', (id * 331) % 7 + id % 2, '/y') as url", "'html' as html")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.apply_url_rules(pages, rules).collect()}
    assert got == {k: (f"h{k * 331}.com/{k * 331 % 7}", "block") if k % 2 == 0 and k * 331 < 1_000_000 else ("com/", "allow") for k in range(3000)}


# --- op9


def _substring(rows, window=20):
    first, out = {}, {}
    for d, h, words in sorted(rows, key=lambda r: (r[0] is not None, r[0], str(r[1]))):
        for p in range(len(words) - window + 1):
            gram = tuple(words[p : p + window])
            first[gram] = min(first.get(gram, ((True, 10**9), 0)), ((d is not None, d or 0), p))
    for d, h, words in rows:
        gone = set()
        for p in range(len(words) - window + 1):
            if first[tuple(words[p : p + window])] != ((d is not None, d or 0), p):
                gone.update(range(p, p + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out[d, h] = (len(words), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_substring(docs, odd, none):
    for table in (docs, odd):
        rows = [(r["doc_id"], r["text"], (r["text"] or "").encode().split()) for r in table.collect()]
        want = Counter((d, *_substring(rows)[d, h]) for d, h, _ in rows)
        got = substring.remove_repeats(table, texts=True).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == want
        for r in got:
            assert sum(x["end"] - x["start"] for x in r["repeats"]) == r["n_removed"]
    assert substring.remove_repeats(none).count() == 0


@pytest.mark.parametrize("most", [20_000, 3])
def test_shared_passages(spark, monkeypatch, most):
    """Passages in many documents, ends that differ, a frequent anchor, texts in pieces; large groups by their windows."""
    monkeypatch.setattr(substring.later_stretches, "__defaults__", (*substring.later_stretches.__defaults__[:-1], most))
    draw = random.Random(31)
    words = ["w%d" % k for k in range(50)]
    passages = [" ".join(draw.choice(words) for _ in range(draw.randint(15, 60))) for _ in range(6)]
    rows = []
    for d in range(80):
        parts = []
        for _ in range(draw.randint(0, 6)):
            p = draw.choice(passages).split()
            a, b = sorted((draw.randint(0, 5), len(p) - draw.randint(0, 5)))
            parts += [draw.choice(words) for _ in range(draw.randint(0, 12))] + p[a:b]
        rows.append((draw.choice([d, 500, None]), "  ".join(parts)))
    rows.append((7, " ".join("w%d" % (k * k % 97) for k in range(1500))))
    rows.append((9, " ".join("w%d" % (k * k % 4973) for k in range(450_000))))  # over two pieces
    table = spark.createDataFrame(rows + rows[:5], "doc_id long, text string")
    found = [(r["doc_id"], r["h"], (r["text"] or "").encode().split()) for r in table.withColumn("h", F.xxhash64("text")).collect()]
    first, out = {}, {}
    for d, h, w in sorted(set((d, h, tuple(w)) for d, h, w in found), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        for p in range(len(w) - 19):
            first.setdefault(w[p : p + 20], (d, h, p))
    for d, h, w in found:
        gone = {i for p in range(len(w) - 19) if first[tuple(w[p : p + 20])] != (d, h, p) for i in range(p, p + 20)}
        out[d, h] = (len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())
    got = substring.remove_repeats(table).collect()
    assert Counter((r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in got) == Counter((d, *out[d, h]) for d, h, _ in found)


def test_repeated_words(spark):
    rows = [(1, "for " * 50), (2, "for " * 19), (3, "a b c d e f g h i j " * 7), (4, "x " + "for " * 21)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(table).collect()}
    want = _substring([(d, d, t.encode().split()) for d, t in rows])
    assert got == {d: want[d, d] for d, _ in rows}


# --- op10


def test_contamination(spark, docs, odd, none, monkeypatch):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()] + [(90, "short item"), (91, None), (92, "..."), (90, "short item")]
    docs = docs.union(spark.createDataFrame([(9001, "A SHORT--item, short item!", "en", "s", 26), (9002, "ashort item shortitem", "en", "s", 21)], docs.schema))
    table = spark.createDataFrame(items, "item_id long, text string")
    cut = lambda t: (t or "").encode().translate(decontaminate._CLEAN).split()
    windows = {(tuple(w[p : p + 10]), i) for i, t in items for w in [cut(t)] for p in range(max(1, len(w) - 9)) if w}
    by = defaultdict(set)
    for w, i in windows:
        by[w].add(str(i))
    monkeypatch.setattr(decontaminate, "SCAN_BYTES", 3000)
    for limit in (decontaminate.PART_BYTES, 8000):
        for r in decontaminate.scan_contamination(docs, table, part_bytes=limit).collect():
            words, hit, ids = cut(r["text"]), set(), set()
            for n in {len(w) for w in by}:
                for p in range(len(words) - n + 1):
                    if found := by.get(tuple(words[p : p + n])):
                        hit.update(range(p, p + n))
                        ids |= found
            assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(words), len(hit), len(ids), bool(hit))
            assert r["items_sha256"] == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
            raw = r["text"].encode()
            assert sum(len(cut(raw[s["start"] : s["end"]].decode())) for s in r["hit_spans"]) == len(hit)
    assert decontaminate.scan_contamination(odd, table).count() == odd.count()
    assert decontaminate.scan_contamination(odd, table.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.scan_contamination(none, table).count() == 0


def test_contamination_by_a_large_benchmark(spark):
    draw = random.Random(12)
    words = ["".join(draw.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(30_000)]
    items = [(k, " ".join(draw.choice(words) for _ in range(120))) for k in range(1200)]
    table = spark.createDataFrame(items, "item_id long, text string")  # 10 MB of windows
    docs, want = [], {}
    for d in range(60):
        text, hit, ids = [], 0, set()
        for _ in range(5):
            text += [draw.choice(words) for _ in range(50)]
            if d % 2:
                k, p = draw.randrange(1200), draw.randrange(100)
                text += ["and"] + items[k][1].split()[p : p + 15] + ["then"]
                hit += 15
                ids.add(str(k))
        docs.append((d, " ".join(text).upper()))
        want[d] = (len(text), hit, hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest())
    got = decontaminate.scan_contamination(spark.createDataFrame(docs, "doc_id long, text string"), table).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items_sha256"]) for r in got} == want


def test_long_rows_in_pieces():
    from quillspark.llm import _shared

    text = b"  ab cd  e " + b"x" * 50 + b" f g h i j k" * 30
    data = np.concatenate([np.frombuffer(text, np.uint8), np.zeros(8, np.uint8)])
    for overlap in (0, 1, 3):
        got = {}
        for begin, word, piece, starts, ends in _shared.row_pieces(data, len(text), overlap=overlap, limit=16):
            for k, (a, b) in enumerate(zip(starts, ends)):
                assert got.setdefault(word + k, (begin + a, begin + b)) == (begin + a, begin + b)
        assert [text[got[k][0] : got[k][1]] for k in range(len(got))] == text.split()


def test_single_lines_are_not_classed(spark, monkeypatch):
    from quillspark.llm import line_dedup

    held, was = [], line_dedup.saved
    monkeypatch.setattr(line_dedup, "saved", lambda df: held.append(was(df)) or held[-1])
    rows = [(i, f"a line that stands in all of them\nnumber {hashlib.md5(str(i).encode()).hexdigest()}") for i in range(30)]
    got = {r.doc_id: r.n_removed for r in line_dedup.remove_fuzzy_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: int(i > 0) for i in range(30)}
    assert [d.count() for d in held if d.columns == ["line", "n", "root"]] == [1]
