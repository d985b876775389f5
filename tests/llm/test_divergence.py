"""Source divergence against plain counting."""

import random
import re

from quillspark.llm import divergence as D

DOCS = "doc_id long, lang string, source string, text string"


def brute(docs, least, ranks):
    docs = [((a or ""), (b or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for a, b, t in docs]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = {}
        for _, _, words in mine:
            for w in set(words):
                df[w] = df.get(w, 0) + 1
        kept = sorted((w for w, n in df.items() if n >= least), key=lambda w: w.encode())
        sources = sorted({d[1] for d in mine})
        count = {s: {w: sum(d[2].count(w) for d in mine if d[1] == s) for w in kept} for s in sources}
        whole = {w: sum(count[s][w] for s in sources) for w in kept}
        share = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}
        p, q = {s: share(count[s]) for s in sources}, share(whole)
        for s in sources:
            pairs = [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in sources if o != s]
            terms = [(p[s][w] - q[w], w) for w in kept if count[s][w] and p[s][w] > q[w]]
            for part, items, most in (("pair", pairs, None), ("term", terms, ranks)):
                items = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(items)]
    return sorted(out)


def test_divergence_equals_counting(spark, monkeypatch):
    draw = random.Random(3)
    words = ["Die", "die", "der", "Straße", "Äpfel", "äpfel", "日本", "x1y", "a-b", "zz", "", "Ok_no"] + [f"w{chr(97 + i)}" for i in range(20)]
    docs = [(draw.choice(["de", "en", None, ""]), draw.choice(["a", "b", "ß", None, "c"]), " ".join(draw.choices(words, k=draw.randint(0, 12)))) for _ in range(300)]
    docs += [("de", "empty", None), ("de", "a", "dup dup dup")] * 3 + [("xx", "only", "alone"), ("yy", "p", "rare"), ("yy", "q", "")]
    df = spark.createDataFrame([(i, *d, "clash", 1) for i, d in enumerate(docs)], DOCS + ", term string, n int")
    want = brute(docs, 3, 4)
    get = lambda: sorted(tuple(r) for r in D.source_divergence(df, least_docs=3, ranks=4).collect())
    assert get() == want
    monkeypatch.setattr(D, "CELLS", 12)
    monkeypatch.setattr(D, "PAIRS", 4)
    assert get() == want
    assert D.source_divergence(df.limit(0)).collect() == []


def test_very_long_text_counts_once(spark, monkeypatch):
    monkeypatch.setattr(D, "STEP_BYTES", 1 << 20)
    docs = [("en", "a", "big word " * 400_000), ("en", "b", "word"), ("en", "b", "big")]
    got = {(r.source, r.item): r.value for r in D.source_divergence(spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], DOCS), least_docs=2).collect() if r.part == "pair"}
    share = lambda c, n: 1 + 10**9 * (c + 5) // (n + 10)
    value = 2 * abs(share(400_000, 800_000) - share(1, 2))
    assert got == {("a", "b"): value, ("b", "a"): value}


def test_shares_do_not_overflow():
    import numpy as np

    counts, total, kept = np.array([9 * 10**12, 0, 17]), 10**13, 123
    assert D.shares(counts, np.array(total), kept).tolist() == [1 + 10**9 * (c + 5) // (total + 5 * kept) for c in counts.tolist()]
