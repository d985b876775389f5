import math
import re
from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.functions import chunking, embed, entities, metrics, questions, text, vector


def test_stems_and_tokens(spark):
    words = ["running", "stopped", "boxes", "upgrades", "dishes", "cities", "nation", "organization", "quickly", "falling", "cats", "is", "agreed", "happiness", "movement", "newest"]
    want = ["run", "stop", "box", "upgrade", "dish", "city", "nat", "organ", "quick", "fall", "cat", "is", "agre", "happi", "mov", "new"]
    got = [r[0] for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").orderBy("i").select(text.stem(F.col("w"))).collect()]
    assert got == want
    row = spark.createDataFrame([("What's the  ‘Straße’? Don't stop, Anna's dogs'",)], "t string").select(text.tokens(F.col("t")), text.analyze(F.col("t")), text.analyze_query(F.lit("how do we"))).first()
    assert row[0] == ["what", "the", "strasse", "don't", "stop", "anna", "dogs"]
    assert row[1] == ["strasse", "not", "stop", "anna", "dog"] and row[2] == ["how", "do", "we"]


def test_hash_and_normalise(spark):
    df = spark.createDataFrame([(" A  b\tC ", "a b c"), ("x\r\ny\x00\rz ", "")], "a string, b string")
    rows = df.select((text.content_hash(F.col("a")) == text.content_hash(F.col("b"))).alias("same"), text.normalize(F.col("a")).alias("n"), text.token_estimate(F.col("b")).alias("e")).collect()
    assert rows[0]["same"] and rows[1]["n"] == "x\ny\nz" and [r["e"] for r in rows] == [2, 0]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(vector.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(1 / math.sqrt(2)) and got[1:] == [0.0, None, None]
    mean = df.limit(1).select(vector.mean_direction([F.col("a"), F.col("b")])).first()[0]
    assert mean == pytest.approx(np.array([2.0, 1.0]) / math.sqrt(5))


@pytest.mark.parametrize("question,asked,window", [
    ("trips last week", "2024-05-10", ("2024-04-26", "2024-05-03")),
    ("trips last month", "2024-03-10", ("2024-02-01", "2024-02-29")),
    ("trips last year", "2024-03-10", ("2023-01-01", "2023-12-31")),
    ("trips last winter", "2024-03-10", ("2023-12-01", "2024-02-29")),
    ("trips last quarter", "2024-02-10", ("2023-10-01", "2023-12-31")),
    ("from January to April 2023", "2024-02-10", ("2023-01-01", "2023-04-30")),
    ("in 2500 ways", "2024-02-10", None),
    ("on 2024-13-40", "2024-02-10", None),
    ("on 31 February 2024", "2024-02-10", None),
    ("the past decade", "2024-02-10", ("2014-02-12", "2024-02-10")),
    ("until June 2020", "2024-02-10", ("1900-01-01", "2020-06-30")),
])
def test_windows(question, asked, window):
    got = questions.date_window(question, date.fromisoformat(asked))
    assert (got and (got[0].isoformat(), got[1].isoformat())) == window


def test_prose_chunks_lose_nothing():
    words = [f"word{i}." if i % 9 == 0 else f"word{i}" for i in range(3000)]
    body = " ".join(w.capitalize() if i and words[i - 1].endswith(".") else w for i, w in enumerate(words))
    chunks = chunking.prose_chunks(body, 80, 12)
    assert {w for c in chunks for w in c.text.split()} == set(body.split())
    assert all(len(c.text) <= 80 * 4 for c in chunks) and [c.ordinal for c in chunks] == list(range(len(chunks)))
    assert all(set(a.text.split()) & set(b.text.split()) for a, b in zip(chunks, chunks[1:]))
    assert chunking.prose_chunks("") == [] and chunking.chunks_of(None) == []
    assert len(chunking.prose_chunks("x" * 5000, 100, 0)) == 13


def test_chunks_by_brute_force():
    """Every unit of a text is in a chunk, in order, no chunk is over the target, and its place is that of its first unit."""
    import random

    draw = random.Random(4)
    for _ in range(60):
        text = "".join(draw.choice(["word", "Word.", "x" * 50, " ", "  ", "\n", "\n\n", "! Then ", "終。次", "\t"]) for _ in range(draw.randint(0, 400)))
        spans = chunking.prose_spans(chunking.clean(text), 120) if chunking.clean(text) else []
        units = [chunking.clean(text)[a:b] for a, b in spans]
        assert "".join("".join(units).split()) == "".join(text.split()) and all(len(u) <= 120 for u in units)
        chunks, at = chunking.prose_chunks(text, 30, 6), 0
        for c in chunks:
            first = next(i for i in range(len(units)) if spans[i][0] == c.start)
            assert first <= at  # no gap to the chunk before
            size = next(k for k in range(1, len(units) - first + 1) if " ".join(units[first : first + k]).strip() == c.text)
            assert len(c.text) <= 120 and (first + size == len(units) or len(" ".join(units[first : first + size + 1])) + 1 > 120)
            at = first + size
        assert at == len(units)


def test_structured_chunks():
    import json

    doc = json.dumps({"steps": [{"id": f"s{i}", "in": f"s{i - 1}.out", "note": "n " * 300} for i in range(20)]})
    chunks = chunking.structured_chunks("The plan:\n" + doc, "json", 600)
    assert re.sub(r"[\s,]", "", "".join(c.text for c in chunks)) in re.sub(r"[\s,]", "", "Theplan:" + doc)
    assert chunks[-1].context == "The plan: in steps" and chunks[-1].depends_on
    code = "\n\n".join(f"@wrap\ndef f{i}(x):\n    y = f{max(i - 1, 0)}(x)\n" + "    y += 1\n" * 60 for i in range(12))
    chunks = chunking.structured_chunks(code, "code", 500)
    assert all(c.text.startswith("@wrap") for c in chunks) and any(c.depends_on for c in chunks)
    assert chunking.content_kind(code) == "code" and chunking.content_kind('x:\n{"a": 1}') == "json" and chunking.content_kind("Just prose.") == "prose"
    assert chunking.chunk_closure({2: [1, 0], 1: [0], 0: [2]}, 2) == [0, 1, 2]


def test_names():
    texts = pd.Series(["Anna: Wow. We met Berta Klein in SKU-4471 with gpt-4o, k8s and NASA in 2024. Wow.", None, "Berta? Berta! and then\nBerta The Iliad"])
    found = {n: (c, s) for _, n, c, s in entities.name_table(texts[:1]).itertuples(index=False)}
    third = {n: (c, s) for r, n, c, s in entities.name_table(texts).itertuples(index=False) if r == 2}
    assert third == {"berta": (2, False), "berta the iliad": (1, True)}
    assert found["berta klein"] == (1, True) and found["wow"][1] is False and "anna" not in found
    assert all(found[n][1] for n in ("sku-4471", "gpt-4o", "k8s", "nasa", "2024"))


def test_salient(spark):
    seeds = spark.createDataFrame([(1, "we saw Kestrel and Osprey"), (1, "then Osprey left"), (1, "and Osprey met Falcon"), (1, "the Heron")], "qid int, text string")
    q = spark.createDataFrame([(1, "tell me about the Heron")], "qid int, text string")
    assert [r["entity"] for r in entities.salient(seeds, q).orderBy("entity").collect()] == ["falcon", "kestrel"]


def test_embedder(spark):
    v = embed.hash_vector("Hello world", 64)
    assert np.linalg.norm(v) == pytest.approx(1) and (v == embed.hash_vector("hello WORLD", 64)).all() and embed.hash_vector("", 64).any()
    with pytest.raises(ValueError):
        embed.checked([[0.0, 0.0]], 1)
    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "id int, t string")
    cache = spark.createDataFrame([], "key string, embedding array<double>")
    out, new = embed.with_cache(rows, "t", cache, embed.hash_embedder(16), "m", 16)
    assert new.count() == 2 and out.filter("embedding is null").count() == 0

    def broken(texts):
        raise RuntimeError("down")

    assert embed.embed(rows, "t", broken).filter("embedding is null").count() == 3


def test_metrics(spark):
    df = spark.createDataFrame([([3, 3, 1, 9], [1, 2])], "f array<int>, g array<int>")
    f, g = F.col("f"), F.col("g")
    row = df.select(metrics.recall_at(f, g, 3), metrics.full_recall_at(f, g, 3), metrics.hit_at(f, g, 3), metrics.reciprocal_rank(f, g, 3), metrics.ndcg_at(f, g, 3)).first()
    best = 1 + 1 / math.log2(3)
    assert list(row) == pytest.approx([0.5, 0, 1, 0.5, (1 / math.log2(3)) / best])
    assert metrics.sign_test(10, 0) == pytest.approx(2 / 1024) and metrics.sign_test(3, 3) == 1.0 and metrics.sign_test(0, 0) == 1.0


def test_grades(spark):
    from quillspark.functions import scoring

    rows = [
        ("It is 180cm tall", "180", True, 1.0), ("It is 180 tall", "18", False, 1.0), ("a pair of slip-ons", "slipons", True, 1.0), ("your body weight", "bodyweight", True, 1.0),
        ("secondhand car", "second hand", True, 1.0), ("the cats", "cat s", False, 1.0), ("$1,500 in all", "1500", True, 1.0), ("red eye flight", "aisle; red-eye|red eye", False, 1.0),
        ("aisle seat, red-eye", "aisle; red-eye|red eye", True, 1.0), ("Yes: 180", "yes + 180 210", True, 0.5), (None, "x", False, 1.0), ("x", " + y", None, None), ("STRASSE", "straße", True, 1.0),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, answer string, spec string, want boolean, share double")
    got = df.withColumn("g", scoring.grade(F.col("answer"), F.col("spec"))).orderBy("i").collect()
    assert [(r["g"] and r["g"]["correct"], r["g"] and r["g"]["completeness"]) for r in got] == [r[2:] for r in rows]
    assert got[7]["g"]["missing"] == ["aisle"]


def test_names_are_found_by_slices(monkeypatch):
    import pandas as pd

    from quillspark.functions import entities as N

    texts = pd.Series(["we met Berta Klein at the gate", None, "", "the ship QX17 left Porto Santo. Then QX17 sank", "a" * 50 + " at Delft Harbour"], index=[3, 4, 9, 11, 20])
    whole = next(N.names.func(iter([texts])))
    seen, was = [], N.name_table
    monkeypatch.setattr(N, "NAMED_CHARS", 20)
    monkeypatch.setattr(N, "name_table", lambda some: seen.append(len(some)) or was(some))
    part = next(N.names.func(iter([texts])))
    assert part.tolist() == whole.tolist() and list(part.index) == list(texts.index) and len(seen) > 2 and sum(seen) == 5


def test_hash_vector_holds_no_list_of_grams():
    import tracemalloc

    from quillspark.functions.embed import hash_vector

    tracemalloc.start()
    hash_vector("ab " * 20_000, 16, {})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20
