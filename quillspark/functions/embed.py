"""Offline embedder by feature hashing, its contract, contextual headers and a cache of vectors."""

from __future__ import annotations

import hashlib
import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A function from texts to vectors; anything that pickles may take its place.
Embedder = Callable[[list[str]], list[list[float]]]


#: Words whose slots are kept, most entries of a table of grams, and characters whose grams are looked up at once.
MOST_WORDS, MOST_GRAMS, PIECE = 1 << 17, 1 << 19, 1 << 14
#: What each size's keys hash to; kept while a worker lives.
_KNOWN: dict[int, dict] = {}


def _hashed(key: str, size: int) -> int:
    """Place and sign of a key as one number: the place from 1 up, negative where the sign is."""
    value = int.from_bytes(hashlib.blake2b(key.encode(), digest_size=8).digest(), "big")
    return value % size + 1 if value >> 63 else -(value % size + 1)


class _Grams:
    """Hashes of grams by code, each in the one place that its code allows; a gram that finds it taken replaces the other."""

    def __init__(self, entries: int = 1 << 12):
        self.codes, self.hashed, self.held = np.zeros(entries, np.uint64), np.zeros(entries, np.int32), 0

    def _at(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - len(self.codes).bit_length())).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Hashes, 0 where a code isn't held."""
        at = self._at(codes)
        return np.where(self.codes[at] == codes, self.hashed[at], 0)

    def add(self, codes: np.ndarray, hashed: np.ndarray) -> None:
        while (self.held + len(codes)) * 8 > len(self.codes) and len(self.codes) < MOST_GRAMS:
            used = self.hashed != 0
            before = self.codes[used], self.hashed[used]
            self.codes, self.hashed, self.held = np.zeros(2 * len(used), np.uint64), np.zeros(2 * len(used), np.int32), 0
            self._put(*before)
        self._put(codes, hashed)

    def _put(self, codes: np.ndarray, hashed: np.ndarray) -> None:
        at, first = np.unique(self._at(codes), return_index=True)
        self.held += int((self.hashed[at] == 0).sum())
        self.codes[at], self.hashed[at] = codes[first], hashed[first]


def _gram_hashes(piece: str, k: int, n: int, size: int, known: dict) -> np.ndarray:
    """Hashes of the first ``n`` grams of ``k`` characters of a piece; each distinct one is hashed once, most only once a worker."""
    letters = np.frombuffer(piece.encode("utf-32-le"), np.uint32)
    local = bool((letters >> 16).any())  # characters beyond 16 bits are numbered within the piece
    if local:
        letters = np.unique(letters, return_inverse=True)[1]
    letters, codes = letters.astype(np.uint64), np.zeros(n, np.uint64)
    for i in range(k):
        codes = (codes << np.uint64(16)) | letters[i : i + n]
    table = _Grams() if local else known.setdefault(k, _Grams())
    out = table.find(codes)
    missed = np.flatnonzero(out == 0)
    if len(missed):
        new, first, which = np.unique(codes[missed], return_index=True, return_inverse=True)
        hashed = np.array([_hashed(f"c{k}:{piece[p : p + k]}", size) for p in missed[first].tolist()], np.int32)
        out[missed] = hashed[which]
        table.add(new, hashed)
    return out


def hash_vector(text: str, size: int = 768, known: dict | None = None) -> np.ndarray:
    """Unit vector of signed hashes: words weigh 1, character 3- and 4-grams of the joined words a half; logarithmic.

    ``known`` keeps hashes from text to text. All sums are of halves, so they are exact in any order.
    """
    known = {} if known is None else known
    folded = text.casefold()
    found = re.findall(r"\w+", folded)
    padded = f" {' '.join(found) if found else folded} "
    counts, words = Counter(found), known.setdefault("words", {})
    del found
    hashes = np.array([words.get(w) or _hashed(f"w:{w}", size) for w in counts], np.int64)
    if len(words) < MOST_WORDS:
        words.update(zip(islice(counts, MOST_WORDS - len(words)), hashes.tolist()))
    n = np.fromiter(counts.values(), float, len(counts))
    raw = np.bincount(np.abs(hashes), np.where(hashes > 0, n, -n), size + 1).astype(float)  # of no words it has whole numbers
    for lo in range(0, len(padded), PIECE):
        piece = padded[lo : lo + PIECE + 3]
        for k in (3, 4):
            n = min(PIECE, len(piece) - k + 1)
            if n > 0:
                hashed = _gram_hashes(piece, k, n, size, known)
                raw += np.bincount(np.abs(hashed), np.where(hashed > 0, 0.5, -0.5), size + 1)
    raw = raw[1:]
    vector = np.copysign(np.log1p(np.abs(raw)), raw)
    if not vector.any():
        hashed = _hashed(f"fallback:{folded}", size)
        vector[abs(hashed) - 1] = 1.0 if hashed > 0 else -1.0
    return vector / np.linalg.norm(vector)


def hash_embedder(size: int = 768) -> Embedder:
    """The offline embedder as an injectable function."""

    def run(texts: list[str]) -> list[list[float]]:
        known = _KNOWN.setdefault(size, {})
        return [hash_vector(t, size, known).tolist() for t in texts]

    return run


class WrongSize(ValueError):
    """Vectors of another size than asked for, which asking again does not mend."""


def checked(vectors: list[list[float]], number: int, size: int | None = None) -> list[list[float]]:
    """Unit vectors; ValueError unless there are ``number`` of one size, finite and not zero."""
    if len(vectors) != number:
        raise ValueError(f"{len(vectors)} vectors for {number} texts")
    out = []
    for v in vectors:
        a = np.asarray(v, float)
        if size and len(a) != size:
            raise WrongSize(f"a vector has {len(a)} components, not {size}")
        if not np.isfinite(a).all() or not a.any():
            raise ValueError("a vector is not finite or is zero")
        out.append((a / np.linalg.norm(a)).tolist())
    return out


def asked_again(embedder: Embedder, texts: list[str], size: int | None = None, attempts: int = 3, delay: float = 0.25) -> list[list[float]]:
    """Checked vectors of texts; a failed call is made again, ``attempts`` times in all, after ``delay`` seconds and twice as long each time."""
    for left in range(attempts - 1, -1, -1):
        try:
            return checked(embedder(texts), len(texts), size)
        except WrongSize:
            raise
        except Exception:
            if not left:
                raise
            time.sleep(delay)
            delay *= 2
    raise AssertionError


def embed(rows: DataFrame, text: str, embedder: Embedder, name: str = "embedding", batch: int = 64, size: int | None = None, attempts: int = 3, delay: float = 0.25) -> DataFrame:
    """``rows`` with vectors of a text column, in batches; rows of a batch that fails ``attempts`` times get null."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            for i in range(0, len(texts), batch):  # passed on at once, so no more vectors are held than a call gives
                some = [t or "" for t in texts.iloc[i : i + batch]]
                try:
                    out = asked_again(embedder, some, size, attempts, delay)
                except Exception:  # a provider that is down leaves the lexical arm
                    out = [None] * len(some)
                yield pd.Series(out, index=texts.index[i : i + batch], dtype=object)
            if not len(texts):
                yield pd.Series([], dtype=object)

    return rows.withColumn(name, run(F.col(text)))


def contextual(text: Column, day: Column, title: Column, source: Column, tags: Column) -> Column:
    """Text for embedding under a header of date, title, source and two tags, 160 characters at most."""
    parts = F.array_compact(F.flatten(F.array(F.array(F.date_format(day, "yyyy-MM-dd"), F.nullif(title, F.lit("")), F.nullif(source, F.lit(""))), F.slice(F.coalesce(tags, F.array().cast("array<string>")), 1, 2))))
    header = F.substring(F.array_join(parts, " · "), 1, 160)
    return F.when(header == "", text).otherwise(F.concat(F.lit("<context>"), header, F.lit("</context>\n"), text))


def cache_key(text: Column, model: str, size: int) -> Column:
    """Key of a text's vector in the cache."""
    return F.sha2(F.concat_ws("|", F.lit(model), F.lit(str(size)), text), 256)


def with_cache(rows: DataFrame, text: str, cache: DataFrame, embedder: Embedder, model: str, size: int) -> tuple[DataFrame, DataFrame]:
    """(rows with vectors, new cache rows): only texts whose key the cache (key, embedding) lacks are embedded, once each."""
    keyed = rows.withColumn("key", cache_key(F.col(text), model, size))
    missing = keyed.select("key", text).dropDuplicates(["key"]).join(cache, "key", "left_anti")
    new = embed(missing, text, embedder).select("key", "embedding")
    return keyed.join(cache.select("key", "embedding").unionByName(new), "key", "left"), new
