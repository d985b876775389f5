"""Suffix-array dedup by prefix-free parsing: bytes of every string of a length that occurs at two places or more.

Rolling-hash triggers cut texts into phrases. What repeats is few phrases in many orders, so the suffixes of the distinct
phrases (the dictionary) and of the sequence of phrases (the parse) are sorted, and both orders together are that of the
text: a suffix goes by what is left of its phrase, then by the rank of the parse behind it. Strings of one length that are
the same are then neighbours.

Texts meet where they may repeat: of the rolling hashes in a window the least names the place (its anchor), and equal
windows have equal anchors. Anchors that occur once are known from a bitmap and go nowhere. The others are dealt by Spark
with the bytes of the windows they stand for, and each task orders what it gets, a few megabytes at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ._shared import CHUNK_BYTES, give_back, hot_join, mixed, null_safe, saved, text_slices
from .substring import REMEMBERED, _copy_key, bitmap, gram_hashes, has, sliding_min

#: Bytes of a rolling hash; bytes of a trigger, and bytes of text for each trigger.
GRAM, TRIGGER, SPARSE = 48, 8, 32
#: Bytes of text that are hashed at once, and of contexts that are ordered at once. Anchors with more occurrences are hot:
#: fewer have room in it.
STEP_BYTES, ORDERED_BYTES, HOT_ANCHOR = CHUNK_BYTES // 2, 1 << 20, 6000


def _ranked(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of combined keys (the first weighs most), which are not negative."""
    key = keys[0]
    for k in keys[1:]:
        key = np.unique(key, return_inverse=True)[1].astype(np.int64) * (int(k.max(initial=0)) + 1) + k
    return np.unique(key, return_inverse=True)[1].astype(np.int64)


def _doubled(rank: np.ndarray, left: np.ndarray, step: int, reach: int) -> np.ndarray:
    """Ranks of suffixes by ``reach`` items, from ranks by ``step``; ``left`` items belong to each, its own included."""
    while step < reach and (left > step).any():
        behind = np.zeros(len(rank), np.int64)
        some = np.flatnonzero(left > step)
        behind[some] = rank[some + step] + 1
        rank, step = _ranked(rank * (len(rank) + 1) + behind), step * 2
    return rank


def _slices(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices one after another (8 spare bytes behind), and where each begins and the last ends."""
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    out = np.zeros(int(offsets[-1]) + 8, np.uint8)
    out[: offsets[-1]] = data[np.repeat(starts - offsets[:-1], sizes) + np.arange(int(offsets[-1]))]
    return out, offsets


def _lanes(data: np.ndarray, kind: str = ">u8") -> np.ndarray:
    """The 8 bytes from each place on, as numbers."""
    return np.ndarray(len(data) - 7, kind, data, strides=(1,)).astype(np.uint64)


def parse(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases (begin, end, text of each) of texts: from a trigger to the end of the next one, at the borders from or to those.

    A trigger is 8 bytes whose hash says so, wherever they stand; a phrase has none but at its ends.
    """
    n = int(offsets[-1])
    cut = np.zeros(n + 1, bool)
    cut[:n] = mixed(_lanes(data, "<u8"))[:n] & np.uint64(SPARSE - 1) == 0
    for back in range(1, TRIGGER):  # bytes of two texts are no trigger
        cut[np.maximum(offsets[1:] - back, 0)] = False
    cut[offsets] = True
    begin = np.flatnonzero(cut[:n])
    of = np.searchsorted(offsets, begin, "right") - 1
    end = np.append(begin[1:], n) + TRIGGER
    last = np.append(of[1:] != of[:-1], True)
    return begin, np.where(last, offsets[of + 1], end), of


def suffix_order(data: np.ndarray, offsets: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """Order of ``places`` by the ``length`` bytes from each on, all of which are in its text.

    By what is left of the phrase, then by the parse behind it: no phrase's rest is the beginning of another's, as it ends in
    a trigger and has none before.
    """
    begin, end, of = parse(data, offsets)
    bytes_, at = _slices(data, begin, end - begin)
    phrases = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(at), pa.py_buffer(bytes_)]).dictionary_encode()
    which = np.asarray(phrases.indices).astype(np.int64)
    dictionary = phrases.dictionary
    ranks = np.empty(len(dictionary), np.int64)
    ranks[np.asarray(pc.sort_indices(dictionary))] = np.arange(len(dictionary))
    # the dictionary's suffixes
    first = np.empty(len(dictionary), np.int64)
    first[which[::-1]] = np.arange(len(which))[::-1]
    words, word_at = _slices(data, begin[first], (end - begin)[first])
    left = np.repeat(word_at[1:], np.diff(word_at)) - np.arange(int(word_at[-1]))
    lane = _lanes(words)[: len(left)]
    short = np.flatnonzero(left < 8)
    beyond = (8 * (8 - left[short])).astype(np.uint64)
    lane[short] = lane[short] >> beyond << beyond
    rank = np.unique(lane, return_inverse=True)[1].astype(np.int64)
    if not words[:-8].all():  # a zero byte is not the end
        rank = _ranked(rank, np.minimum(left, 8))
    rank = _doubled(rank, left, 8, length)
    # the parse's suffixes
    behind = np.searchsorted(of, of, "right") - np.arange(len(of))
    parsed = _doubled(ranks[which], behind, 1, length)
    j = np.searchsorted(begin, places, "right") - 1
    following = np.zeros(len(j), np.int64)
    some = np.flatnonzero(behind[j] > 1)
    following[some] = parsed[j[some] + 1] + 1
    return np.lexsort((following, rank[word_at[which[j]] + places - begin[j]]))


def repeated_places(data: np.ndarray, offsets: np.ndarray, number: np.ndarray, length: int) -> np.ndarray:
    """For the first ``number`` places of each text, whether the ``length`` bytes from there on are at another of these places."""
    of = np.repeat(np.arange(len(number)), number)
    places = offsets[:-1][of] + np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number)
    order = suffix_order(data, offsets, places, length)
    lane = _lanes(data)
    same = np.arange(len(order) - 1)
    a, b = places[order[:-1]], places[order[1:]]
    for at in (*range(0, length - 7, 8), *([length - 8] if length % 8 else [])):
        same = same[lane[a[same] + at] == lane[b[same] + at]]
    out = np.zeros(len(places), bool)
    out[order[same]] = out[order[same + 1]] = True
    return out


def _windows(texts: pa.Array, length: int):
    """Yields (row, place, least, at, grams, bytes) for slices of the texts.

    One entry of row, place (its first byte in the row), least (its anchor) and at (its index in ``bytes``) for each window;
    ``grams`` are the hashes at all places. Very long texts come in pieces.
    """
    for first, data, offsets in text_slices(texts, STEP_BYTES):
        size = int(offsets[-1])
        if len(offsets) == 2 and size > STEP_BYTES:
            parts = [(lo, data[lo : min(size, lo + STEP_BYTES + length - 1) + 8]) for lo in range(0, size - length + 1, STEP_BYTES)]
        else:
            parts = [(0, data)]
        for before, piece in parts:
            of = np.array([0, len(piece) - 8]) if len(offsets) == 2 else offsets
            if len(piece) - 8 < length:
                continue
            grams = gram_hashes(piece[:-8].astype(np.uint64) + np.uint64(1), GRAM)
            least = sliding_min(grams, length - GRAM + 1)
            count = np.diff(of)
            fits = np.maximum(count - length + 1, 0)
            row = np.repeat(np.arange(len(count)), fits)
            place = np.arange(len(row)) - np.repeat(np.cumsum(fits) - fits, fits)
            at = of[:-1][row] + place
            if len(at):
                yield first + row, before + place, least[at], at, grams, piece


def _starts(row: np.ndarray, least: np.ndarray, at: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Where windows side by side get another anchor, or another occurrence of it."""
    fresh = np.ones(len(at), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (least[1:] != least[:-1]) | (grams[at[:-1]] == least[:-1])
    return fresh


def repeated_spans(docs: DataFrame, firsts: DataFrame, id_col: str, text: str, length: int) -> DataFrame:
    """(__id, __h, start, stop): spans of first copies that other strings repeat; ``firsts`` as of ``_copies``."""
    context = docs.sparkSession.sparkContext
    first = context.broadcast(bitmap(firsts.withColumnRenamed("key", "anchor")))
    key = _copy_key(F.col(id_col), F.col(text))
    read = docs.select(F.col(id_col).alias("__id"), F.xxhash64(F.col(text)).alias("__h"), F.col(text).alias("t"), key.alias("key")).filter(F.octet_length("t") >= length)
    known = read.schema.fields[:2]

    def kept(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(has(first.value, np.asarray(batch.column(3)).view(np.uint64))))

    def anchors(batches):
        for batch in batches:
            for row, _, least, at, grams, _ in _windows(kept(batch).column(2), length):
                yield pa.RecordBatch.from_arrays([pa.array(least[_starts(row, least, at, grams)].view(np.int64))], names=["anchor"])
        give_back()

    counted = saved(read.mapInArrow(anchors, "anchor long").groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"))
    some, hot = (context.broadcast(bitmap(counted.filter(cond).select("anchor"))) for cond in ("n > 1", f"n > {HOT_ANCHOR}"))
    widest = length - GRAM + 1
    sent = StructType([*StructType.fromDDL("anchor long").fields, *known, *StructType.fromDDL("start long, number int, context binary, inner boolean, one long, two long").fields])

    def occur(batches):
        met: dict[int, tuple | None] = {}
        seen: dict[tuple[int, int], tuple | None] = {}
        for batch in batches:
            batch = kept(batch)
            for row, place, least, at, grams, data in _windows(batch.column(2), length):
                fresh = _starts(row, least, at, grams)
                good = np.flatnonzero(has(some.value, least))
                row, place, least, at, fresh = row[good], place[good], least[good], at[good], fresh[good]
                if not len(at):
                    continue
                cut = np.ones(len(at), bool)
                cut[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1])
                begin = np.flatnonzero(cut)
                begin = np.flatnonzero((np.arange(len(at)) - begin[np.cumsum(cut) - 1]) % widest == 0)
                number = np.diff(np.append(begin, len(at)))
                ids, hs = batch.column(0).take(pa.array(row[begin])).to_pylist(), batch.column(1).take(pa.array(row[begin])).to_pylist()
                heated = has(hot.value, least[begin])
                twice = (np.add.reduceat(fresh, begin) - fresh[begin] > 0).tolist()
                one = two = None
                keys, i_d, h, start, many, bodies, inner, a, b = ([] for _ in range(9))

                def out(k, doc, s, n, body=None, more=None, x=None, y=None):
                    keys.append(k), i_d.append(doc[0]), h.append(doc[1]), start.append(s), many.append(n), bodies.append(body), inner.append(more), a.append(x), b.append(y)

                def repeat(windows):
                    """Windows (document, place) that are known to repeat, those side by side as one."""
                    lo = 0
                    for hi in range(1, len(windows) + 1):
                        if hi == len(windows) or windows[hi] != (*windows[hi - 1][:2], windows[hi - 1][2] + 1):
                            out(hash(windows[lo]) & 0x7FFFFFFFFFFFFFFF, windows[lo][:2], windows[lo][2], hi - lo)
                            lo = hi

                for i, (d, s, n, p, anchor) in enumerate(zip(zip(ids, hs), at[begin].tolist(), number.tolist(), place[begin].tolist(), least[begin].view(np.int64).tolist())):
                    body = data[s : s + n + length - 1].tobytes()
                    name = xxhash.xxh3_128_intdigest(body)
                    if name in met:  # this task has sent these bytes: both places repeat, nothing more to find out
                        before = met[name]
                        if before is not None:
                            out(hash(before) & 0x7FFFFFFFFFFFFFFF, before[:2], before[2], n)
                            met[name] = None
                        out(hash((d, p)) & 0x7FFFFFFFFFFFFFFF, d, p, n)
                        continue
                    if len(met) >= REMEMBERED:
                        met.clear()
                    met[name] = (*d, p)
                    if not heated[i]:
                        out(anchor, d, p, n, body, twice[i])
                        continue
                    if one is None:
                        bytes_ = data[:-8].astype(np.uint64) + np.uint64(1)
                        one, two = gram_hashes(bytes_, length).view(np.int64), gram_hashes(mixed(bytes_), length).view(np.int64)
                    first_ones, mine = [], []
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    for o, window in enumerate(zip(one[s : s + n].tolist(), two[s : s + n].tolist())):
                        if window in seen:
                            if seen[window] is not None:
                                first_ones.append(seen[window])
                                seen[window] = None
                            mine.append((*d, p + o))
                        else:
                            seen[window] = (*d, p + o)
                            out(window[0] & 0x7FFFFFFFFFFFFFFF, d, p + o, 1, None, None, *window)
                    repeat(first_ones)
                    repeat(mine)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(i_d, batch.schema.field(0).type), pa.array(h, pa.int64()), pa.array(start, pa.int64()), pa.array(many, pa.int32()), pa.array(bodies, pa.binary()), pa.array(inner, pa.bool_()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=sent.names
                )
        give_back()

    found = StructType([*known, *StructType.fromDDL("start long, stop long, one long, two long").fields])

    def settled(rows: pa.RecordBatch) -> pa.RecordBatch:
        """Spans of a batch of whole anchors.

        An anchor's only context is not ordered, unless the anchor is in it more than once.
        """
        encoded = rows.column("context").dictionary_encode()
        texts, which = encoded.dictionary, np.asarray(encoded.indices)
        anchor = np.empty(len(texts), np.int64)
        anchor[which] = np.asarray(rows.column("anchor"))
        several = np.zeros(len(texts), bool)
        several[which] = np.asarray(rows.column("inner"))
        _, of, count = np.unique(anchor, return_inverse=True, return_counts=True)
        several |= count[of] > 1
        number = np.asarray(pc.binary_length(texts)).astype(np.int64) - length + 1
        again = np.repeat(np.bincount(which) > 1, number)
        if several.any():
            some = texts.filter(pa.array(several))
            data = np.frombuffer(b"".join(some.to_pylist()) + bytes(8), np.uint8)
            offsets = np.append(0, np.cumsum(number[several] + length - 1))
            again[np.repeat(several, number)] |= repeated_places(data, offsets, number[several], length)
        base = np.cumsum(number) - number
        begins, ends = again.copy(), again.copy()
        begins[1:] &= ~again[:-1]
        ends[:-1] &= ~again[1:]
        begins[base], ends[base + number - 1] = again[base], again[base + number - 1]  # a run ends with its text
        lo, hi = np.flatnonzero(begins), np.flatnonzero(ends)
        of = np.searchsorted(base, lo, "right") - 1
        runs = np.bincount(of, minlength=len(texts))
        each = np.repeat(np.arange(len(which)), runs[which])
        run = (np.cumsum(runs) - runs)[which[each]] + np.arange(len(each)) - np.repeat(np.cumsum(runs[which]) - runs[which], runs[which])
        begin = np.asarray(rows.column("start"))[each]
        at = pa.array(each)
        inside = base[which[each]]
        return pa.RecordBatch.from_arrays([rows.column("__id").take(at), rows.column("__h").take(at), pa.array(begin + lo[run] - inside), pa.array(begin + hi[run] - inside + length), pa.nulls(len(each), pa.int64()), pa.nulls(len(each), pa.int64())], names=found.names)

    def pieces(rows: pa.RecordBatch):
        """Spans of rows in order of anchors, some ``ORDERED_BYTES`` of whole anchors at a time."""
        anchor = np.asarray(rows.column("anchor"))
        begin = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        filled = np.append(0, np.cumsum(np.asarray(pc.binary_length(rows.column("context"))).astype(np.int64)))
        while len(begin):
            last = int(np.searchsorted(filled[np.append(begin[1:], len(anchor))], filled[begin[0]] + ORDERED_BYTES, "right"))
            stop = begin[last] if 0 < last < len(begin) else len(anchor) if last else begin[1] if len(begin) > 1 else len(anchor)
            yield settled(rows.slice(int(begin[0]), int(stop - begin[0])))
            begin = begin[begin >= stop]

    def meet(batches):
        held = None
        for batch in batches:
            bare = pc.is_null(batch.column("context"))
            plain, batch = batch.filter(bare), batch.filter(pc.invert(bare))
            if plain.num_rows:
                start = np.asarray(plain.column("start"))
                yield pa.RecordBatch.from_arrays([plain.column("__id"), plain.column("__h"), plain.column("start"), pa.array(start + np.asarray(plain.column("number")) + length - 1), plain.column("one"), plain.column("two")], names=found.names)
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            anchor = np.asarray(batch.column("anchor"))
            last = int(np.searchsorted(anchor, anchor[-1]))
            if last:
                yield from pieces(batch.slice(0, last))
            held = batch.slice(last)
        if held is not None:
            yield from pieces(held)
        give_back()

    met = saved(read.mapInArrow(occur, sent).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(meet, found))
    spans = met.filter("one is null").select("__id", "__h", "start", "stop")
    alone = met.filter("one is not null")
    if alone.isEmpty():
        return spans
    alone = saved(alone)
    twice = alone.groupBy("one", "two").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    return spans.union(hot_join(alone, twice, ["one", "two"]).select("__id", "__h", "start", "stop"))


def _copies(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(key, __id, __h, n): the first row of each distinct text, and how many rows have it."""
    t = F.col(text)
    least = F.min(F.struct(F.col(id_col).isNotNull().alias("known"), F.col(id_col).alias("id"))).alias("least")
    firsts = docs.filter(t.isNotNull()).groupBy(F.xxhash64(t).alias("a"), F.xxhash64(t, F.lit(1)).alias("b")).agg(least, F.count("*").alias("n"))
    return firsts.select(F.xxhash64("a", "b", "least.id").alias("key"), F.col("least.id").alias("__id"), F.col("a").alias("__h"), "n")


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 200, texts: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, repeats) for every row; with ``texts`` also ``kept`` (bytes).

    Removed is each byte of a ``length``-byte string (UTF-8) that also starts anywhere else, in the same text or another;
    ``repeats`` lists the maximal runs as (first byte, one past the last). Strings are judged on the input. Null and empty
    texts have no bytes; texts under ``length`` keep all. Each row is a document, so repeated rows repeat each other,
    whatever their ids. What is kept may not be whole characters. Other columns are not read.

    Copies of whole texts are known from a first pass over hashes: all their bytes go, and only the first of them is ordered
    with the others. Anchors with over ``HOT_ANCHOR`` occurrences, which would not fit the memory of one task's
    order, are known before anything is dealt: their windows go by 128-bit hashes, which are combined where they are.
    """
    firsts = saved(_copies(docs, id_col, text))
    found = repeated_spans(docs, firsts, id_col, text, length)
    whole = firsts.filter("n > 1").select("__id", "__h", F.lit(0).cast("long").alias("start"), F.lit(1 << 60).alias("stop"))
    spans = found.union(whole).groupBy("__id", "__h").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    read = docs.select(F.col(id_col).alias("__id"), F.when(F.col(text).isNotNull(), F.xxhash64(F.col(text))).alias("__h"), F.col(text).alias("__t"))
    joined = null_safe(read, spans, ["__id", "__h"], "left").select("__id", F.col("__t").cast("binary").alias("__t"), "spans", _copy_key(F.col("__id"), F.col("__t")).alias("key"))
    first = docs.sparkSession.sparkContext.broadcast(bitmap(firsts.withColumnRenamed("key", "anchor")))
    new = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, repeats array<struct<start:long,end:long>>" + ", kept binary" * texts
    schema = StructType([StructField(id_col, read.schema["__id"].dataType), *StructType.fromDDL(new).fields])

    def run(batches):
        for batch in batches:
            n_bytes, n_removed, n_spans, sha, repeats, left = [], [], [], [], [], []
            lists, is_first = batch.column(2), has(first.value, np.asarray(batch.column(3)).view(np.uint64))
            for i, t in enumerate(batch.column(1)):
                body = memoryview(t.as_buffer()) if t.is_valid else memoryview(b"")
                size, runs = len(body), []
                if size >= length and (lists[i].is_valid or not is_first[i]):
                    a, b = (np.minimum(np.asarray(lists[i].values.field(k)), size) for k in (0, 1)) if lists[i].is_valid else (np.zeros(1, int), np.array([size]))
                    reach = np.maximum.accumulate(b)
                    cut = np.flatnonzero(a[1:] > reach[:-1]) + 1
                    runs = list(zip(a[np.r_[0, cut]].tolist(), reach[np.r_[cut - 1, len(a) - 1]].tolist()))
                digest, at, rest = hashlib.sha256(), 0, []
                for s, e in [*runs, (size, size)]:
                    digest.update(body[at:s])
                    if texts:
                        rest.append(bytes(body[at:s]))
                    at = e
                n_bytes.append(size), n_removed.append(sum(e - s for s, e in runs)), n_spans.append(len(runs)), sha.append(digest.hexdigest())
                repeats.append([{"start": s, "end": e} for s, e in runs]), left.append(b"".join(rest))
            out = [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string()), pa.array(repeats, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            yield pa.RecordBatch.from_arrays([*out, *([pa.array(left, pa.binary())] if texts else [])], names=schema.names)
        give_back()

    return joined.mapInArrow(run, schema)
