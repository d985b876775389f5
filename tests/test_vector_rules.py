"""Rules decided where vectors meet, against the same rules over pairs."""

from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import bands
from quillspark.operators import consolidate as C
from quillspark.plans import catalogue

SAID = ["we pay 100 euros", "we no longer pay 100 or 200 euros", "not enabled on Monday", "disabled on tuesday, 7 of 9", "they like it", "they dislike it", "x" * 600, "9 of 200", None, ""]
TAGS = [["a", "b"], ["b"], ["c"], [], None, [None, "a"], ["a", None]]


@pytest.fixture
def world(spark):
    """(vectors, memories): texts, tags, times and states in many mixtures, some of them null, some memories of one parent."""
    rng = np.random.default_rng(4)
    day = lambda i: datetime(2024, 1, 1 + i % 9, tzinfo=timezone.utc) if i % 23 else None
    rows = [(i, SAID[i % len(SAID)], "stale" if i % 8 == 0 else "active", day(i), TAGS[i % len(TAGS)], i - 3 if i % 6 == 0 else 1000 + i // 5) for i in range(150)]
    memories = spark.createDataFrame(rows, "id long, content string, status string, occurred_at timestamp, tags array<string>, extracted_from long")
    vectors = [(i, rng.normal(size=6).tolist()) for i in range(160)] + [(500, None), (501, [0.0] * 6), (3, [1.0] * 6)]
    return spark.createDataFrame(vectors, "id long, embedding array<double>"), memories


def _same(one, two):
    got, want = (sorted(map(tuple, df.select(one.columns).collect())) for df in (one, two))
    assert got == want and len(want) > 50


def test_vector_supersessions_are_those_of_pairs(world, monkeypatch):
    v, m = world
    monkeypatch.setattr(bands, "TILE_ROWS", 16), monkeypatch.setattr(bands, "PART_ROWS", 40)
    for memories in (m, m.drop("extracted_from")):
        _same(C.vector_supersessions(v, v, memories, 0.1, 0.97), C.supersessions(C.similar_pairs(v, v, 0.1, 0.97), memories, 0.1, 0.97))


def test_vector_flags_are_those_of_pairs(world, monkeypatch):
    v, m = world
    monkeypatch.setattr(bands, "TILE_ROWS", 16), monkeypatch.setattr(bands, "PART_ROWS", 40)
    pairs = C.similar_pairs(v, v, 0.1, 0.97)
    _same(C.vector_contradictions(v, v, m, 0.1, 0.97), C.contradictions(pairs, m, 0.1, 0.97))
    _same(C.vector_unexplained(v, v, m, 0.1, 0.97), C.unexplained(pairs, m, 0.1, 0.97))


@pytest.mark.parametrize("query", ["contradiction_proposals", "unexplained_pairs"])
def test_no_pair_is_written_before_it_is_judged(spark, tmp_path, monkeypatch, query):
    """the pairs of the band were written, and joined with both texts' flags."""
    spark.createDataFrame([(i, f"paid {i % 3} euros", "en", "a") for i in range(120)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(i, [1.0, i / 40]) for i in range(120)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    written, was = [], C.stored
    monkeypatch.setattr(C, "stored", lambda df: written.append(df.columns) or was(df))
    rows = catalogue.queries()[query](spark, str(tmp_path)).collect()
    assert len(rows) > 20 and not [c for c in written if "sim" in c]


@pytest.mark.parametrize("floors", [(0.1, 0.1, 0.5), (0.45, 0.6, 0.45)])
def test_vector_associations_are_those_of_pairs(spark, world, monkeypatch, floors):
    v, m = world
    v = v.unionByName(v.filter("id between 10 and 60").withColumn("id", F.col("id") + 90).filter("id < 150"))  # equal vectors
    monkeypatch.setattr(bands, "TILE_ROWS", 16), monkeypatch.setattr(bands, "PART_ROWS", 40)
    low, tag_low, name_low = floors
    named = lambda rows: rows.select("id", F.split("content", " ").alias("entities"))
    pairs = C.similar_pairs(v, v, low, 0.97)
    for memories in (m, m.drop("extracted_from")):
        for find in (None, named):
            known = named(memories) if find else None
            want = C.associations(pairs, memories, known, low=low, tag_low=tag_low, name_low=name_low)
            _same(C.vector_associations(v, v, memories, find, low=low, tag_low=tag_low, name_low=name_low), want)


def test_pairs_that_are_no_association_are_not_written(spark, tmp_path, monkeypatch):
    """all pairs of the band were shuffled and joined; now a unit passes on few of them."""
    spark.createDataFrame([(i, "plain", "en", "a") for i in range(400)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    turn = [(i * 7919 % 400) / 400 for i in range(400)]
    spark.createDataFrame([(i, [float(np.cos(t * 3)), float(np.sin(t * 3))] if i % 50 else [float(np.cos(4.4)), float(np.sin(4.4))]) for i, t in enumerate(turn)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    passed, was = [], C.stored
    monkeypatch.setattr(C, "stored", lambda df: passed.append((df.columns, df.count())) or was(df))
    rows = catalogue.association_edges(spark, str(tmp_path)).collect()
    pairs = [n for c, n in passed if "sim" in c]
    assert len(rows) == 32 and len(pairs) == 1 and pairs[0] < 400


def test_every_memory_is_asked_what_it_replaces(spark, tmp_path):
    """not every 50th only."""
    spark.createDataFrame([(i, f"text {i}", "en", "a") for i in range(60)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(i, [1.0, i / 60]) for i in range(60)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r["new_id"], r["old_id"]) for r in catalogue.supersession_proposals(spark, str(tmp_path)).collect()}
    turn = [np.arctan(np.float32(i / 60)) for i in range(60)]
    assert got == {(a, b) for a in range(60) for b in range(a) if b % 17 and b % 13 and b % 11 and 0.1 <= np.cos(turn[a] - turn[b]) < 0.97} and len({a for a, _ in got}) > 30


def _by_loop(text, size):
    """The embedder, a key at a time."""
    import hashlib
    import re

    folded = text.casefold()
    found = re.findall(r"\w+", folded)
    padded = f" {' '.join(found) if found else folded} "
    keys = [(f"w:{w}", 1.0) for w in found] + [(f"c{k}:{padded[i : i + k]}", 0.5) for k in (3, 4) for i in range(len(padded) - k + 1)]
    raw = np.zeros(size)
    slot = lambda key: (lambda n: (n % size, 1.0 if n >> 63 else -1.0))(int.from_bytes(hashlib.blake2b(key.encode(), digest_size=8).digest(), "big"))
    for key, weight in keys:
        raw[slot(key)[0]] += slot(key)[1] * weight
    vector = np.copysign(np.log1p(np.abs(raw)), raw)
    if not vector.any():
        vector[slot(f"fallback:{folded}")[0]] = slot(f"fallback:{folded}")[1]
    return (vector / np.linalg.norm(vector)).tolist()


def test_the_embedder_hashes_a_gram_once(monkeypatch):
    """a key was looked up for each place in a text, and hashed again in each call."""
    import hashlib

    from quillspark.functions import embed

    rng = np.random.default_rng(3)
    letters = [chr(c) for c in [*range(97, 123), 0x20, 0x20, 0x20, 0xE9, 0xDF, 0x130, 0x65E5, 0x1F600, 0x1D518]]
    texts = ["", " ", "a", "?!", "\0a", "a\0b", "İßẞ", "😀 a😀b", "of " * 9000, *("".join(rng.choice(letters[:n], 3000)) for n in (3, 29, 33, 35))]
    for size in (1, 16, 128):
        want = [_by_loop(t, size) for t in texts]
        monkeypatch.setattr(embed, "MOST_GRAMS", 1 << 13), monkeypatch.setattr(embed, "MOST_WORDS", 50), monkeypatch.setattr(embed, "PIECE", 1000)
        monkeypatch.setattr(embed, "_KNOWN", {})
        assert embed.hash_embedder(size)(texts) == want == embed.hash_embedder(size)(texts[::-1])[::-1]
    monkeypatch.undo()
    asked, was = [], hashlib.blake2b
    monkeypatch.setattr(hashlib, "blake2b", lambda key, **k: asked.append(key) or was(key, **k))
    run, plain = embed.hash_embedder(33), ["the crane is out of order", "the order is out"]
    first, n = run(plain), len(asked)
    assert run(plain[::-1])[::-1] == first and len(asked) == n
