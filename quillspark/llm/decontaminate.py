"""Benchmark decontamination by one Aho-Corasick automaton over the windows of the test items."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._shared import LOWER, give_back, row_pieces, saved, text_slices, word_bounds, xxh64_slices

#: Bytes that separate words: all ASCII but digits and letters.
APART = np.ones(256, bool)
APART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Lower-cases A-Z and turns separators into spaces.
_CLEAN = bytes(0x20 if APART[b] else int(LOWER[b]) for b in range(256))
_CLEAN_BYTES = np.frombuffer(_CLEAN, np.uint8)

#: A word is two letters of the automaton, six bits of its hash each; letters of first and second place differ.
LETTER_BITS, FIRST_LETTER = 6, 0x100
#: Bytes of benchmark that one automaton covers (some 130 bytes of worker's memory each); a larger one takes a pass for each part.
PART_BYTES = 2 << 20
#: Bytes of text that are scanned at once.
SCAN_BYTES = 1 << 20


def _letters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two letters (UTF-32 codes) of each word."""
    h = xxh64_slices(data, starts, ends - starts)
    out = np.empty((len(starts), 2), np.uint32)
    for k in range(2):
        out[:, k] = (h >> np.uint64(k * LETTER_BITS)) & np.uint64((1 << LETTER_BITS) - 1)
        out[:, k] += np.uint32(FIRST_LETTER + (k << LETTER_BITS))
    return out


class Windows:
    """Automaton over the windows of items, and the exact words and item ids of each window.

    Words enter as two hashed letters each, so a window costs a few nodes whatever the length of its words. What the
    automaton finds is looked up by its words, which removes chance hits.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        import ahocorasick

        self.exact: dict[bytes, list[str]] = {}
        self.trie = ahocorasick.Automaton()
        for item, text in items:
            data = np.frombuffer(text + bytes(8), np.uint8)
            starts, ends, _ = word_bounds(data, np.array([0, len(text)]), APART)
            if not len(starts):
                continue
            letters, n = _letters(data, starts, ends).tobytes().decode("utf-32-le"), min(window, len(starts))
            words = text.split()
            for i in range(len(words) - n + 1):
                ids = self.exact.setdefault(b" ".join(words[i : i + n]), [])
                if not ids:
                    self.trie.add_word(letters[2 * i : 2 * (i + n)], n)
                if not ids or ids[-1] != item:
                    ids.append(item)
        self.exact = {k: sorted(set(v)) for k, v in self.exact.items()}
        if self.exact:
            self.trie.make_automaton()

    def hits(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray):
        """(first word, last word + 1, exact window) of each occurrence; ``rows`` is the row of each word, ascending."""
        if not self.exact or not len(starts):
            return
        at = 2 * np.arange(len(starts)) + rows - rows[0]
        codes = np.full(int(at[-1]) + 2, 0x20, np.uint32)
        letters = _letters(data, starts, ends)
        codes[at], codes[at + 1] = letters[:, 0], letters[:, 1]
        for end, n in self.trie.iter(codes.tobytes().decode("utf-32-le")):
            last = int(np.searchsorted(at, end))
            first = last - n
            words = b" ".join(data[starts[first] : ends[last - 1]].tobytes().split())
            if words in self.exact:
                yield first, last, words


_built: dict = {}


def _windows(sent, window: int) -> Windows:
    """The automaton of a broadcast list of items: built once in a worker process, then kept for its next tasks."""
    key = sent._jbroadcast.id() if getattr(sent, "_jbroadcast", None) is not None else sent._path
    if key not in _built:
        _built.clear()
        _built[key] = Windows(sent.value, window)
    return _built[key]


def _merged(spans: list[tuple[int, int, int, int]]) -> tuple[int, list[dict]]:
    """Words in the union of (first word, last word + 1, first byte, last byte + 1), and its stretches in bytes."""
    a, b, s, e = np.array(sorted(spans), np.int64).T
    reach = np.maximum.accumulate(b)
    begin = np.flatnonzero(np.concatenate([[True], a[1:] > reach[:-1]]))
    finish = np.append(begin[1:], len(a)) - 1
    return int((reach[finish] - a[begin]).sum()), [{"start": int(x), "end": int(y)} for x, y in zip(s[begin], np.maximum.accumulate(e)[finish])]


#: Columns that the scan adds.
_ADDED = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_spans array<struct<start:long,end:long>>"
_NAMES = [c.split()[0] for c in _ADDED.split(", ")]
_HELD = "array<struct<a:long,b:long,s:long,e:long>>"
_NONE = hashlib.sha256(b"").hexdigest()


def _digest(words: np.ndarray, spans: list[list[tuple]], ids: list[set[str]]) -> list[pa.Array]:
    """Arrays of the columns _ADDED."""
    out: dict[str, list] = {c: [] for c in _NAMES}
    for w, s, i in zip(words.tolist(), spans, ids):
        hit, stretches = _merged(s) if s else (0, [])
        values = (w, hit, len(i), hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() if i else _NONE, hit > 0, stretches)
        for c, v in zip(out, values):
            out[c].append(v)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    return [pa.array(v, k) for v, k in zip(out.values(), kinds)]


def _scanned(rows: DataFrame, items: list[tuple[str, bytes]], window: int, text: str, columns: list[str], last: bool) -> DataFrame:
    """``rows`` after a scan for the items: their ``columns`` and _ADDED, or before the last part with its hits in __spans and __items."""
    sent = rows.sparkSession.sparkContext.broadcast(items)
    span = pa.struct([(c, pa.int64()) for c in "abse"])
    schema = StructType([*rows.select(*columns).schema.fields, *StructType.fromDDL(_ADDED).fields]) if last else rows.schema
    held = "__spans" in rows.columns

    def scan(batches):
        found = _windows(sent, window)
        for batch in batches:
            at = batch.schema.get_field_index
            texts = batch.column(at(text))
            spans, ids, words = [[] for _ in range(len(texts))], [set() for _ in range(len(texts))], np.zeros(len(texts), np.int64)
            if held:
                spans = [[tuple(x[c] for c in "abse") for x in s] for s in batch.column(at("__spans")).to_pylist()]
                ids = [set(i) for i in batch.column(at("__items")).to_pylist()]
            seen: set[tuple[int, bytes]] = set()

            def add(row, word, shift, first, last_word, key, starts, ends):
                spans[row].append((word + first, word + last_word, shift + int(starts[first]), shift + int(ends[last_word - 1])))
                if (row, key) not in seen:
                    seen.add((row, key))
                    ids[row].update(found.exact[key])

            for first, data, offsets in text_slices(texts, SCAN_BYTES):
                if len(offsets) == 2 and offsets[1] > SCAN_BYTES:
                    for shift, word, piece, starts, ends in row_pieces(data, int(offsets[1]), APART, window - 1, SCAN_BYTES):
                        words[first] = word + len(starts)
                        for a, b, key in found.hits(_CLEAN_BYTES[piece], starts, ends, np.zeros(len(starts), np.int64)):
                            add(first, word, shift, a, b, key, starts, ends)
                    continue
                starts, ends, of = word_bounds(data, offsets, APART)
                count = np.diff(of)
                words[first : first + len(count)] = count
                of_row = np.repeat(np.arange(len(count)), count)
                for a, b, key in found.hits(_CLEAN_BYTES[data], starts, ends, of_row):
                    r = int(of_row[a])
                    add(first + r, -int(of[r]), -int(offsets[r]), a, b, key, starts, ends)
            if last:
                made = [*(batch.column(at(c)) for c in columns), *_digest(words, [sorted(set(s)) for s in spans], ids)]
            else:
                new = {"__spans": pa.array([[dict(zip("abse", x)) for x in sorted(set(s))] for s in spans], pa.list_(span)), "__items": pa.array([sorted(i) for i in ids], pa.list_(pa.string()))}
                made = [new.get(c, batch.column(at(c))) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(made, names=schema.names)
        give_back()

    return rows.mapInArrow(scan, schema)


def scan_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, keep: list[str] | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """``keep`` columns of ``docs`` (all by default) and ``n_words, n_hit, n_items, items_sha256, contaminated, hit_spans``.

    Texts and items are lower-cased (A-Z) and cut into words of ASCII letters, digits and bytes from 0x80. A document
    word inside any occurrence of an item's window is hit; an item of fewer words than ``window``, but not none, is one
    window. ``hit_spans`` lists the hit stretches as (start, end) byte offsets of the original UTF-8 text.

    The items are read on the driver and sent to the workers, each of which builds one automaton and keeps it; each
    text is scanned once by it, very long ones piece by piece. That table's size is checked first: what goes to the
    driver and the workers at once is at most ``part_bytes``, and a larger benchmark is dealt into parts by hash, one
    pass over the texts each, whose hits are added up.

    Null and empty texts have no words and no hits; items without words have no window; repeated items count by their
    ids once; an empty benchmark hits nothing. Rows stay as they are, repeats too; own columns of these names go.
    """
    columns = [c for c in (keep if keep is not None else docs.columns) if c not in _NAMES]
    t = F.col(item_text)
    listed = benchmark.filter(t.isNotNull()).select(F.col(item_id).cast("string").alias("item"), t.alias("text")).distinct()
    parts = max(1, -(-(listed.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // part_bytes))
    name = text if text in columns else "__t"
    rows = docs.select(*columns, *([] if name == text else [F.col(text).alias(name)]))
    if parts > 1:
        rows = rows.withColumns({"__spans": F.array().cast(_HELD), "__items": F.array().cast("array<string>")})
    for p in range(parts):
        mine = listed.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == p).collect()
        items = sorted(("null" if r["item"] is None else r["item"], r["text"].encode("utf-8", "surrogatepass").translate(_CLEAN)) for r in mine)
        rows = _scanned(saved(rows) if p else rows, items, window, name, columns, p == parts - 1)
    return rows
