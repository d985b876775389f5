import random

import numpy as np
import pyarrow as pa
import xxhash

from quillspark.llm._shared import joined_words, local_roots, text_slices, word_bounds, xxh64_slices


def test_words_and_hashes_match_the_library():
    draw = random.Random(1)
    texts = ["", None, "Hello  wörld\n\tfoo", "a" * 100 + " b", "x y z " * 500] + ["".join(draw.choice("abcdeéß \n\t") for _ in range(draw.randint(0, 300))) for _ in range(200)]
    for first, data, offsets in text_slices(pa.array(texts), 500):
        starts, ends, of = word_bounds(data, offsets)
        for r in range(len(offsets) - 1):
            got = [bytes(data[a:b]) for a, b in zip(starts[of[r] : of[r + 1]], ends[of[r] : of[r + 1]])]
            assert got == (texts[first + r] or "").encode().split()
        buffer, s, e = joined_words(data, starts, ends)
        if len(s) > 20:
            i = np.arange(len(s) - 19)
            h = xxh64_slices(buffer, s[i], e[i + 19] - s[i])
            assert [int(x) for x in h] == [xxhash.xxh64_intdigest(bytes(buffer[s[k] : e[k + 19]]), 42) for k in i]


def test_local_roots_are_smallest_members():
    draw = random.Random(2)
    for _ in range(50):
        n = draw.randint(1, 40)
        edges = [(draw.randrange(n), draw.randrange(n)) for _ in range(draw.randint(0, 40))]
        label = list(range(n))
        for _ in range(n):
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        got = local_roots(n, np.array([a for a, _ in edges], int), np.array([b for _, b in edges], int))
        assert got.tolist() == label
