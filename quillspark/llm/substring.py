"""Substring dedup: texts joined on winnowed anchors, matches extended both ways, maximal repeats over a length."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ._shared import CHUNK_BYTES, hot_join, mixed, null_safe, row_pieces, saved, text_slices, word_bounds, xxh64_slices

#: Words of a seed. With windows of n words, n - SEED + 1 seeds compete for an anchor, so each window has one.
SEED = 8
#: Bits of the bitmap of repeated anchors for each of them, and the most bits it has (32 MB).
BITS_EACH, MOST_BITS = 16, 1 << 28
#: Contexts that a task remembers, so that it sends a common one once; occurrences of an anchor that are met in one task.
REMEMBERED, GROUP_MOST = 1 << 18, 20_000

_B = np.uint64(0x9E3779B97F4A7C15)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_B), n, 1 << 64))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` word hashes (fewer at the end are cut off), by doubling."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out, size, step, width = None, 0, words, 1
        while width <= n:
            if n & width:
                out = step if out is None else out[: len(step) - size] * _power(width) + step[size : size + len(out)][: len(step) - size]
                size += width
            if width * 2 <= n:
                step = step[:-width] * _power(width) + step[width:]
            width *= 2
        return mixed(out[: len(words) - n + 1])


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Least of each run of ``n`` values."""
    step, width = x, 1
    while width * 2 <= n:
        step = np.minimum(step[:-width], step[width:])
        width *= 2
    return np.minimum(step[: len(x) - n + 1], step[n - width :][: len(x) - n + 1])


def _windows(texts: pa.Array, window: int):
    """Yields (row, place, least, seeds, words, bytes, starts, ends) for slices of the texts.

    One entry of row, place (its first word), least (its anchor, the least hash of a seed in it) and first (its index in
    ``words``) for each window of ``window`` words; words are hashes. Very long texts come in pieces.
    """
    for first, data, offsets in text_slices(texts):
        if len(offsets) == 2 and offsets[1] > CHUNK_BYTES:
            parts = ((word, piece, starts, ends, np.array([0, len(starts)])) for _, word, piece, starts, ends in row_pieces(data, int(offsets[1]), overlap=window - 1))
        else:
            starts, ends, of = word_bounds(data, offsets)
            parts = [(0, data, starts, ends, of)]
        for before, piece, starts, ends, of in parts:
            if len(starts) < window:
                continue
            words = xxh64_slices(piece, starts, ends - starts)
            seeds = gram_hashes(words, SEED)
            least = sliding_min(seeds, window - SEED + 1)
            count = np.diff(of)
            row = np.repeat(np.arange(len(count)), count)
            place = np.arange(len(words)) - of[:-1][row]
            good = np.flatnonzero(place[: len(least)] + window <= count[row[: len(least)]])
            if len(good):
                yield first + row[good], before + place[good], least[good], good, seeds, words, piece, starts, ends


def _copy_key(id_col: Column, text: Column) -> Column:
    """Hash of an id and its whole text."""
    return F.xxhash64(F.xxhash64(text), F.xxhash64(text, F.lit(1)), id_col)


def first_copies(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(key) of the first row of each distinct text: the others repeat it from their first word to the last."""
    t = F.col(text)
    least = F.min(F.struct(F.col(id_col).isNotNull().alias("known"), F.col(id_col).alias("id"))).alias("least")
    firsts = docs.filter(t.isNotNull()).groupBy(F.xxhash64(t).alias("a"), F.xxhash64(t, F.lit(1)).alias("b")).agg(least)
    return firsts.select(F.xxhash64("a", "b", "least.id").alias("key"))


def repeated_anchors(docs: DataFrame, text: str, window: int, firsts: Broadcast, key: Column) -> DataFrame:
    """(anchor, n) of the winnowed anchors that occur at two places or more, in one first copy or several."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(has(firsts.value, np.asarray(batch.column(1)).view(np.uint64))))
            for row, place, least, good, seeds, *_ in _windows(batch.column(0), window):
                fresh = np.ones(len(good), bool)
                fresh[1:] = (row[1:] != row[:-1]) | (least[1:] != least[:-1]) | (seeds[good[:-1]] == least[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(least[fresh].view(np.int64))], names=["anchor"])

    anchors = docs.select(F.col(text).alias("t"), key.alias("key")).mapInArrow(run, "anchor long")
    return anchors.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")


def has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether a bitmap has the bits of hashes."""
    at = hashes & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def bitmap(anchors: DataFrame) -> np.ndarray:
    """Bits set at the hashes. Its size has a fixed bound; a fuller one lets more rows through, none less."""
    number = anchors.count()
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(16, (number * BITS_EACH).bit_length()))
    at = F.col("anchor").bitwiseAND(F.lit(bits - 1).cast("long"))
    words = anchors.groupBy(F.shiftrightunsigned(at, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63).cast("long")).cast("int"))).alias("bits"))
    out = np.zeros(bits // 64, np.int64)
    table = words.toArrow()
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    return out.view(np.uint64)


def _alike(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> bool:
    """Whether the slices of ``data`` at ``a`` and at ``b`` hold the same bytes."""
    for lo in range(0, len(a), 4096):
        n = sizes[lo : lo + 4096]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        if not np.array_equal(data[np.repeat(a[lo : lo + 4096], n) + inside], data[np.repeat(b[lo : lo + 4096], n) + inside]):
            return False
    return True


def extend(contexts: pa.Array, number: np.ndarray, doc: np.ndarray, place: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches (occurrence, first word, one past the last) of occurrences that repeat an earlier one, words of a context.

    ``contexts`` holds the words around each occurrence of an anchor, joined by spaces, in order of document and place:
    the anchor and what it may be extended by on both sides, which is ``number`` windows. An occurrence is extended
    left and right as far as an earlier one has the same words; occurrences meet through the hashes of their windows,
    not in pairs, and what they are said to share is compared word by word. Windows of one document (``doc``) at one
    place are the same, not repeats.
    """
    data = np.frombuffer(b" ".join(x.as_py().encode() for x in contexts) + bytes(8), np.uint8)
    starts, ends, _ = word_bounds(data, np.array([0, len(data) - 8]))
    words = xxh64_slices(data, starts, ends - starts)
    size = number + window - 1
    base = np.cumsum(size) - size
    of = np.repeat(np.arange(len(number)), number)
    j = np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number)
    at = base[of] + j
    one, two = gram_hashes(words, window)[at], gram_hashes(mixed(words), window)[at]
    order = np.lexsort((np.arange(len(at)), two, one))
    fresh = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])
    head = np.empty(len(at), np.int64)
    head[order] = order[fresh][np.cumsum(fresh) - 1]
    where = place[of] + j
    later = (head != np.arange(len(at))) & ((doc[of] != doc[of[head]]) | (where != where[head]))
    some = np.flatnonzero(later)
    # windows side by side whose heads are side by side too are one stretch
    cut = np.ones(len(some), bool)
    cut[1:] = (some[1:] != some[:-1] + 1) | (of[some[1:]] != of[some[:-1]]) | (head[some[1:]] != head[some[:-1]] + 1) | (of[head[some[1:]]] != of[head[some[:-1]]])
    begin = some[cut]
    finish = some[np.append(np.flatnonzero(cut)[1:], len(some)) - 1] if len(some) else begin
    n = finish - begin + window
    a, b = at[begin], at[head[begin]]
    lengths = ends[a + n - 1] - starts[a]
    if not (np.array_equal(lengths, ends[b + n - 1] - starts[b]) and _alike(data, starts[a], starts[b], lengths)):
        raise ArithmeticError("two windows of different words have one 128-bit hash")
    return of[begin], j[begin], j[begin] + n


def later_stretches(docs: DataFrame, firsts: Broadcast, id_col: str = "doc_id", text: str = "text", window: int = 20, group_most: int = GROUP_MOST) -> DataFrame:
    """(__id, __h, start, stop): stretches of words of first copies that repeat earlier ones; __h: the text's XXH64.

    Seeds are winnowed anchors: of the 8-word grams in a window that with the least hash. Equal windows choose equal
    anchors, so texts are joined on the anchors that occur twice or more. An occurrence travels with its context, the
    words that the windows it stands for have on both sides, and is extended over them (``extend``): one row an
    occurrence, none a window. The first in order of id, text hash and place stays, whatever the number of others.

    A task sends a context once, and again only if it comes earlier in that order; the others are known for repeats
    where they are read, so a passage that is in every document meets in no one task. Anchors with over ``group_most``
    occurrences are known before anything is dealt: their windows go one by one by 128-bit hashes, each once a task, are
    combined where they are and joined with hot ones split. Rows of one id and text are one document.
    """
    key = _copy_key(F.col(id_col), F.col(text))
    marked = saved(repeated_anchors(docs, text, window, firsts, key))
    sent, hot = (docs.sparkSession.sparkContext.broadcast(bitmap(rows)) for rows in (marked, marked.filter(F.col("n") > group_most)))
    read = docs.select(F.col(id_col).alias("__id"), F.when(F.col(text).isNotNull(), F.xxhash64(F.col(text))).alias("__h"), F.col(text).alias("t"), key.alias("key"))
    fields = read.select("__id", "__h").schema.fields
    widest = window - SEED + 1

    def occur(batches):
        met: dict[tuple[int, int, int], tuple] = {}
        seen: dict[tuple[int, int], tuple] = {}
        for batch in batches:
            batch = batch.filter(pa.array(has(firsts.value, np.asarray(batch.column(3)).view(np.uint64))))
            for row, place, least, good, _, words, data, starts, ends in _windows(batch.column(2), window):
                some = has(sent.value, least)
                row, place, least, good = row[some], place[some], least[some], good[some]
                if not len(good):
                    continue
                # runs of windows side by side with one anchor: an occurrence, at most as many as have room around a seed
                cut = np.ones(len(good), bool)
                cut[1:] = (row[1:] != row[:-1]) | (good[1:] != good[:-1] + 1) | (least[1:] != least[:-1])
                begin = np.flatnonzero(cut)
                inside = np.arange(len(good)) - begin[np.cumsum(cut) - 1]
                begin = np.flatnonzero(inside % widest == 0)
                number = np.diff(np.append(begin, len(good)))
                grams = gram_hashes(words, window)
                lasts = good[begin] + number - 1
                ids, hs = batch.column(0).take(pa.array(row[begin])), batch.column(1).take(pa.array(row[begin]))
                named = zip(ids.to_pylist(), hs.to_pylist(), place[begin].tolist(), zip(grams[good[begin]].tolist(), grams[lasts].tolist(), number.tolist()), starts[good[begin]].tolist(), ends[lasts + window - 1].tolist())
                heated, two = has(hot.value, least[begin]), None
                contexts, keep, keys, shift, many, first, second = [], [], [], [], [], [], []

                def out(i, key, j=0, n=1, context=None, a=None, b=None):
                    keep.append(i), keys.append(key), shift.append(j), many.append(n), contexts.append(context), first.append(a), second.append(b)

                for i, (d, h, p, context, s, e) in enumerate(named):
                    mine = (d is not None, d, h, p)
                    before = met.get(context)
                    if before == mine:
                        continue
                    if before is not None and before < mine:
                        out(i, hash(mine[1:]) & 0x7FFFFFFFFFFFFFFF, 0, context[2])
                        continue
                    if len(met) >= REMEMBERED:
                        met.clear()
                    met[context] = mine
                    if not heated[i]:
                        out(i, int(least[begin[i]].view(np.int64)), 0, context[2], b" ".join(data[s:e].tobytes().split()).decode())
                        continue
                    two = gram_hashes(mixed(words), window) if two is None else two
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    w, n = int(good[begin[i]]), context[2]
                    later = 0  # windows side by side that this task has sent from an earlier place
                    for j, name in enumerate(zip(grams[w : w + n].view(np.int64).tolist(), two[w : w + n].view(np.int64).tolist())):
                        here = (*mine[:3], p + j)
                        if seen.get(name, here) < here:
                            later += 1
                            continue
                        if later:
                            out(i, hash(here) & 0x7FFFFFFFFFFFFFFF, j - later, later)
                            later = 0
                        seen[name] = here
                        out(i, name[0] & 0x7FFFFFFFFFFFFFFF, j, 1, None, *name)
                    if later:
                        out(i, hash(mine) & 0x7FFFFFFFFFFFFFFF, n - later, later)
                at = pa.array(keep, pa.int64())
                places = pa.array((place[begin][keep] + np.array(shift, np.int64)).astype(np.int32)) if keep else pa.array([], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), ids.take(at), hs.take(at), places, pa.array(many, pa.int32()), pa.array(contexts, pa.string()), pa.array(first, pa.int64()), pa.array(second, pa.int64())], names=["anchor", "__id", "__h", "place", "number", "context", "one", "two"])

    seeds = read.mapInArrow(occur, StructType([*StructType.fromDDL("anchor long").fields, *fields, *StructType.fromDDL("place int, number int, context string, one long, two long").fields]))
    made = StructType([*fields, *StructType.fromDDL("start int, stop int, one long, two long").fields])

    def meet(batches):
        def extended(rows: pa.RecordBatch):
            rank = np.asarray(pc.rank(rows.column("__id"), null_placement="at_start", tiebreaker="dense")).astype(np.int64)
            doc = np.unique(np.stack([rank, np.asarray(rows.column("__h"))], axis=1), axis=0, return_inverse=True)[1].ravel()
            place = np.asarray(rows.column("place")).astype(np.int64)
            of, a, b = extend(rows.column("context"), np.asarray(rows.column("number")).astype(np.int64), doc, place, window)
            at, none = pa.array(of, pa.int64()), pa.nulls(len(of), pa.int64())
            return pa.RecordBatch.from_arrays([rows.column("__id").take(at), rows.column("__h").take(at), pa.array((place[of] + a).astype(np.int32)), pa.array((place[of] + b).astype(np.int32)), none, none], names=made.names)

        held = None
        for batch in batches:
            known = pc.is_null(batch.column("context"))
            rows, batch = batch.filter(known), batch.filter(pc.invert(known))
            if rows.num_rows:
                start = np.asarray(rows.column("place"))
                stop = pa.array((start + np.asarray(rows.column("number")) + window - 1).astype(np.int32))
                yield pa.RecordBatch.from_arrays([rows.column("__id"), rows.column("__h"), rows.column("place"), stop, rows.column("one"), rows.column("two")], names=made.names)
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            anchor = np.asarray(batch.column("anchor"))
            last = int(np.searchsorted(anchor, anchor[-1]))
            if last:
                yield extended(batch.slice(0, last))
            held = batch.slice(last)
        if held is not None:
            yield extended(held)

    found = saved(seeds.repartition("anchor").sortWithinPartitions("anchor", "__id", "__h", "place").mapInArrow(meet, made))
    stretches = found.filter("one is null").select("__id", "__h", "start", "stop")
    if found.filter("one is not null").isEmpty():
        return stretches
    alone = saved(found.filter("one is not null"))
    where = F.struct("__id", "__h", "start")
    heads = alone.groupBy("one", "two").agg(F.min(where).alias("head"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return stretches.union(hot_join(alone, heads, ["one", "two"]).filter(~where.eqNullSafe(F.col("head"))).select("__id", "__h", "start", "stop"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 20, texts: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, repeats) for every row; with ``texts`` also ``kept_text``.

    Words are cut at white space and compared as they are. Removed is each word that a window covers which also starts
    earlier; ``repeats`` lists these maximal stretches as (first word, one past the last). Windows are judged on the
    input. Later copies of a whole text are all repeat, and known from a first pass over the texts' hashes: a bitmap of the
    first copies, of bounded size, tells them; where it is too full it takes copies for first ones, which then go the long
    way to the same result. Null, empty and blank texts have no words; texts under ``window`` words keep all. Repeated rows (same id,
    same text) do not make each other repeats. A null id comes before all others.
    """
    firsts = docs.sparkSession.sparkContext.broadcast(bitmap(first_copies(docs, id_col, text).withColumnRenamed("key", "anchor")))
    later = later_stretches(docs, firsts, id_col, text, window)
    spans = later.groupBy("__id", "__h").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    read = docs.select(F.col(id_col).alias("__id"), F.when(F.col(text).isNotNull(), F.xxhash64(F.col(text))).alias("__h"), F.col(text).alias("__t"))
    joined = null_safe(read, spans, ["__id", "__h"], "left").select("__id", "__t", "spans", _copy_key(F.col("__id"), F.col("__t")).alias("key"))
    none = hashlib.sha256(b"").hexdigest()
    new = "n_words long, n_removed long, kept_sha256 string, repeats array<struct<start:int,end:int>>" + ", kept_text string" * texts
    schema = StructType([StructField(id_col, read.schema["__id"].dataType), *StructType.fromDDL(new).fields])

    def run(batches):
        for batch in batches:
            n_words, n_removed, sha, repeats, left = [], [], [], [], []
            lists, first = batch.column(2), has(firsts.value, np.asarray(batch.column(3)).view(np.uint64))
            for i, t in enumerate(batch.column(1).cast(pa.binary())):
                words = (t.as_py() or b"").split()
                removed = np.zeros(len(words), bool)
                stretches = []
                if len(words) >= window and (lists[i].is_valid or not first[i]):
                    a, b = (np.asarray(lists[i].values.field(k)) for k in (0, 1)) if first[i] else (np.zeros(1, int), np.array([len(words)]))
                    reach = np.maximum.accumulate(b)
                    cut = np.flatnonzero(a[1:] > reach[:-1]) + 1
                    for s, e in zip(a[np.r_[0, cut]], reach[np.r_[cut - 1, len(a) - 1]]):
                        removed[s:e] = True
                        stretches.append({"start": int(s), "end": int(e)})
                    words = [w for w, r in zip(words, removed) if not r]
                kept = b" ".join(words)
                n_words.append(len(removed)), n_removed.append(int(removed.sum())), repeats.append(stretches)
                sha.append(hashlib.sha256(kept).hexdigest() if kept else none)
                if texts:
                    left.append(kept.decode())
            out = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(repeats, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
            yield pa.RecordBatch.from_arrays([*out, *([pa.array(left, pa.string())] if texts else [])], names=schema.names)

    return joined.mapInArrow(run, schema)
