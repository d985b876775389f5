"""Suffix-array dedup against all windows, its order against plain sorting."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from quillspark.llm import suffix_array as S

DATA = "/root/testdata/sf0.001"


def brute(rows, length):
    """{row number: (bytes, removed, spans, hash)} by a table of all windows."""
    texts = [(t or "").encode() for _, t in rows]
    places = defaultdict(list)
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            places[t[p : p + length]].append((i, p))
    gone = [np.zeros(len(t) + 1, bool) for t in texts]
    for spots in places.values():
        if len(spots) > 1:
            for i, p in spots:
                gone[i][p : p + length] = True
    out = []
    for t, g in zip(texts, gone):
        g = g[:-1]
        kept = np.frombuffer(t, np.uint8)[~g].tobytes()
        out.append((len(t), int(g.sum()), int((g & np.concatenate([[True], ~g[:-1]])[: len(g)]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def made(seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefghij é漢\x00", k=draw.randint(1, 9)))
    passages = [" ".join(word() for _ in range(draw.randint(10, 60))) for _ in range(6)]
    texts = []
    for _ in range(50):
        parts = [draw.choice(passages) if draw.random() < 0.4 else " ".join(word() for _ in range(draw.randint(1, 30))) for _ in range(draw.randint(1, 6))]
        texts.append(" ".join(parts))
    texts += texts[:3] + texts[:2] + ["a" * 700, "a" * 500 + "b", "ab" * 300, "\x00" * 300, "\x00" * 299 + "x", "", None, None, "short", passages[0][5:] + "!"]
    return [(i % 60 if i % 7 else None, t) for i, t in enumerate(texts)]


def found(df):
    return sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("hot, ordered", [(6000, 2 << 20), (2, 2 << 20), (6000, 500)])
def test_removed_bytes_equal_all_windows(spark, monkeypatch, hot, ordered):
    monkeypatch.setattr(S, "HOT_ANCHOR", hot)
    monkeypatch.setattr(S, "ORDERED_BYTES", ordered)
    rows = made(hot)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start int, context string").repartition(3)
    for length in (64, 200):
        assert found(S.remove_repeated_bytes(df, length=length)) == sorted(brute(rows, length))


def test_pieces_of_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "STEP_BYTES", 1000)
    draw = random.Random(9)
    body = "".join(draw.choices("abcdefgh ", k=9000))
    rows = [(1, body), (2, "x" + body[500:4200] + "".join(draw.choices("abcdefgh ", k=3000)) + body[8000:]), (3, body[990:1195])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(S.remove_repeated_bytes(df)) == sorted(brute(rows, 200))
    kept = {r.doc_id: bytes(r.kept) for r in S.remove_repeated_bytes(df, texts=True).collect()}
    assert kept[3] == b"" and len(kept[1]) == 9000 - 3700 - 1000 and kept[2].startswith(b"x")


def test_documents_of_the_smallest_scale(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeated_bytes(docs).collect()}
    assert got == dict(zip([r[0] for r in rows], brute(rows, 200)))
    assert S.remove_repeated_bytes(docs.limit(0)).count() == 0


def test_order_is_that_of_the_bytes():
    draw = np.random.default_rng(4)
    for alphabet, zero in ((4, 97), (2, 0), (30, 60)):
        passage = draw.integers(zero, zero + alphabet, 900).astype(np.uint8)
        texts = [np.concatenate([draw.integers(zero, zero + alphabet, 30).astype(np.uint8), passage[a : a + 400]]) for a in draw.integers(0, 500, 40)]
        offsets = np.append(0, np.cumsum([len(t) for t in texts]))
        data = np.concatenate([*texts, np.zeros(8, np.uint8)])
        places = np.concatenate([offsets[i] + np.arange(len(t) - 199) for i, t in enumerate(texts)])
        windows = [data[p : p + 200].tobytes() for p in places]
        order = S.suffix_order(data, offsets, places, 200)
        assert [windows[i] for i in order] == sorted(windows)
        counts = defaultdict(int)
        for w in windows:
            counts[w] += 1
        assert S.repeated_places(data, offsets, np.diff(offsets) - 199, 200).tolist() == [counts[w] > 1 for w in windows]
