"""Fuzzy line dedup: MinHash of character shingles, banding, exact Jaccard, distributed union-find."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ._shared import CHUNK_BYTES, HOT_PART, WHITE, hot_join, mixed, null_safe, salted_join, saved, text_slices
from .substring import bitmap, has
from .verify import verified_components

#: Characters of a shingle; least Jaccard similarity of a link.
SHINGLE, LEAST = 8, 0.8
#: Bands and signature rows of each: lines of similarity 0.8 share a band with probability 0.99, of 0.9 with 0.9999.
BANDS, ROWS = 9, 4
#: Characters of text that are signed at once; lines that a task remembers, so that it signs and sends a common one once.
STEP_CHARS, REMEMBERED = 1 << 17, 1 << 20

_B = np.uint64(0x9E3779B97F4A7C15)
#: White space around a line.
_AROUND = b" \t\r\x0b\x0c"


def shingle_hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of each run of SHINGLE (a power of two) code points, by doubling."""
    with np.errstate(over="ignore"):
        x, width = codes.astype(np.uint64) + np.uint64(1), 1
        while width < SHINGLE:
            x = x[:-width] * np.uint64(pow(int(_B), width, 1 << 64)) + x[width:]
            width *= 2
        return mixed(x)


def line_set(line: str) -> np.ndarray:
    """Distinct shingle hashes of a line; a line under SHINGLE characters is one shingle."""
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) < SHINGLE:
        codes = np.append(codes, np.zeros(SHINGLE - len(codes), np.uint32))
    h = shingle_hashes(codes)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def band_keys(codes: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """BANDS keys of each line, from a one-permutation MinHash signature of BANDS * ROWS places.

    A line is ``sizes`` code points from ``begin``; a short one has zeros behind it up to SHINGLE. A shingle's hash names
    its place and its value there; a place that no shingle names borrows from the next one that has a value, rotated by
    the distance. Shingles go STEP_CHARS at a time, so a very long line costs no more memory than its characters.
    """
    k, most = BANDS * ROWS, np.uint64(np.iinfo(np.uint64).max)
    number = np.maximum(sizes, SHINGLE) - SHINGLE + 1
    ends = np.cumsum(number)
    places = np.full(len(begin) * k, most, np.uint64)
    done = 0
    while done < ends[-1]:  # shingles of all lines one after another, in steps
        upto = min(int(ends[-1]), done + STEP_CHARS)
        lo, hi = np.searchsorted(ends, [done, upto - 1], "right")
        held = np.minimum(ends[lo : hi + 1], upto) - np.maximum((ends - number)[lo : hi + 1], done)
        line = np.repeat(np.arange(lo, hi + 1), held)
        at = np.repeat((begin - ends + number)[lo : hi + 1], held) + np.arange(done, upto)
        low = int(at[0])
        h = shingle_hashes(codes[low : int(at.max()) + SHINGLE])[at - low]
        np.minimum.at(places, line * k + ((h >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64), h)
        done = upto
    sign = places.reshape(-1, k)
    short = np.flatnonzero((sign == most).any(axis=1))
    given, made = sign[short], sign[short].copy()
    for d in range(1, k):
        if not len(short):
            break
        near = np.roll(given, -d, axis=1)
        fill = (made == most) & (near != most)
        made[fill] = mixed(near[fill] + np.uint64(d))
        sign[short] = made
        left = (made == most).any(axis=1)
        if not left.all():
            short, given, made = short[left], given[left], made[left]
    parts = sign.reshape(-1, BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(begin), BANDS))
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            keys = mixed(keys * _B + parts[:, :, r])
    return keys


def line_slices(texts: pa.Array):
    """Yields (row, number, ids, bytes, starts, ends) of the lines of slices of the texts that aren't blank.

    Lines are cut at line feeds, ``number`` counts all of a row from 0; ``starts`` and ``ends`` leave out the white space
    around; ``ids`` is the XXH64 of what they leave. A row over CHUNK_BYTES comes in slices of whole lines.
    """
    for first, data, offsets in text_slices(texts):
        size, begin, base = int(offsets[-1]), 0, 0
        while begin < size:
            end = size
            if len(offsets) == 2 and size - begin > CHUNK_BYTES:
                feeds = np.flatnonzero(data[begin : begin + CHUNK_BYTES] == 10)
                if len(feeds):
                    end = begin + int(feeds[-1]) + 1
                else:
                    rest = np.argmax(data[begin:size] == 10)
                    end = begin + int(rest) + 1 if data[begin + rest] == 10 else size
            part = data[begin : end + 8]
            cuts = offsets if end - begin == size else np.array([0, end - begin])
            feeds = np.flatnonzero(part[: end - begin] == 10)
            row = np.concatenate([np.arange(len(cuts) - 1), np.searchsorted(cuts, feeds, "right") - 1])
            starts, ends = np.concatenate([cuts[:-1], feeds + 1]), np.concatenate([cuts[1:], feeds])
            order, last = np.lexsort((starts, row)), np.lexsort((ends, row))
            row, starts, ends = row[order], starts[order], ends[last]
            number = base + np.arange(len(row)) - np.searchsorted(row, row)
            base, begin = base + len(feeds), end
            if len(starts) == 1 or ends[0] - starts[0] > CHUNK_BYTES:  # one line and at most the empty rest behind its line feed
                raw = part[starts[0] : ends[0]].tobytes()
                bare = raw.strip(_AROUND)
                starts, row, number = starts[:1] + len(raw) - len(raw.lstrip(_AROUND)), row[:1], number[:1]
                ends = starts + len(bare)
                some = ends > starts
            else:
                full = np.flatnonzero(~WHITE[part[: len(part) - 8]])
                lo, hi = np.searchsorted(full, starts), np.searchsorted(full, ends)
                some = hi > lo
                lo, hi = lo[some], hi[some]
                starts, ends, row, number = full[lo], full[hi - 1] + 1, row[some], number[some]
                some = np.ones(len(starts), bool)
            row, number, starts, ends = row[some], number[some], starts[some], ends[some]
            if len(starts):
                raw = part.tobytes()
                ids = np.array([xxhash.xxh64_intdigest(raw[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist())], np.uint64)
                yield first + row, number, ids, raw, starts, ends


def _signed(batches):
    """(key, line) of each line and band; a line comes once a task, or once in REMEMBERED distinct lines of it."""
    met: set[int] = set()
    for batch in batches:
        for _, _, ids, data, starts, ends in line_slices(batch.column(0)):
            _, once = np.unique(ids, return_index=True)
            fresh = once[[i not in met for i in ids[once].tolist()]]
            if len(met) > REMEMBERED:
                met.clear()
            met.update(ids[fresh].tolist())
            fresh.sort()
            done, sizes = 0, np.cumsum(ends[fresh] - starts[fresh])
            while done < len(fresh):
                take = max(done + 1, int(np.searchsorted(sizes, (sizes[done - 1] if done else 0) + STEP_CHARS, "right")))
                some, done = fresh[done:take], take
                lines = [data[a:b].decode() for a, b in zip(starts[some].tolist(), ends[some].tolist())]
                length = np.array([len(x) for x in lines])
                codes = np.frombuffer("".join(x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\0") for x in lines).encode("utf-32-le"), np.uint32)
                whole = np.maximum(length, SHINGLE)
                keys = band_keys(codes, np.cumsum(whole) - whole, length)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(ids[some].view(np.int64), BANDS))], names=["key", "line"])


def _shared(batches):
    """Of rows sorted by key: (key, line, first line of the key) of keys that two lines or more share."""
    key, low, waits = None, None, False
    for batch in batches:
        k, l = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        if not len(k):
            continue
        fresh = np.concatenate([[key is None or k[0] != key], k[1:] != k[:-1]])
        of = np.cumsum(fresh) - 1
        firsts = l[fresh]
        lows = firsts[of] if fresh[0] else np.concatenate([[low], firsts])[of + 1]
        other = l != lows
        keep = other & np.concatenate([[True], (l[1:] != l[:-1]) | fresh[1:]])
        kk, ll, bb = k[keep], l[keep], lows[keep]
        yield pa.RecordBatch.from_arrays([pa.array(kk), pa.array(ll), pa.array(bb)], names=["key", "line", "low"])
        key, low = k[-1], lows[-1]


def line_links(docs: DataFrame, text: str = "text") -> DataFrame:
    """(node, root) of the components of distinct lines by similarity; lines without a link are absent.

    Distinct lines that share a band go in two rounds. First each is compared with one line of its bucket, the same for
    all, which settles families of copies in one comparison a line. Then, where the lines compared with the same line
    are of several components still, those of different components are compared with each other, in blocks of BUCKET,
    and those that a new link joins no more. So every pair that shares a band is either linked through others or
    compared: no cap, and no pairs within a family.
    """
    spark = docs.sparkSession
    signed = docs.select(F.col(text).alias("t")).mapInArrow(_signed, "key long, line long")
    shared = signed.repartition("key").sortWithinPartitions("key").mapInArrow(_shared, "key long, line long, low long")
    pairs = saved(shared.select("line", "low").distinct())
    wanted = saved(pairs.select("line").union(pairs.select(F.col("low").alias("line"))).distinct())
    sent = spark.sparkContext.broadcast(bitmap(wanted.withColumnRenamed("line", "anchor")))

    def rows(batches):
        for batch in batches:
            for _, _, ids, data, starts, ends in line_slices(batch.column(0)):
                _, once = np.unique(ids, return_index=True)
                some = once[has(sent.value, ids[once])]
                lines = [data[a:b].decode() for a, b in zip(starts[some].tolist(), ends[some].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(ids[some].view(np.int64)), pa.array(lines, pa.string())], names=["line", "text"])

    texts = docs.select(F.col(text).alias("t")).mapInArrow(rows, "line long, text string")
    texts = saved(texts.groupBy("line").agg(F.min("text").alias("text")).join(wanted, "line", "left_semi"))
    named = pairs.withColumnRenamed("line", "node")
    return verified_components(named, texts.withColumnRenamed("line", "node"), line_set, LEAST)


def remove_fuzzy_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", texts: bool = False) -> DataFrame:
    """(id, n_lines, n_removed, kept_sha256, removed_lines) for every row; with ``texts`` also ``kept_text``.

    Lines are cut at line feeds and compared without the white space around them; blank lines are never removed. Of
    each component of equal or similar lines (Jaccard of 8-character shingles 0.8 or more) the first stays, by id, text
    hash and line number. ``removed_lines`` lists the numbers from 0 of the lines that go. Kept lines are joined by line feeds.
    Null texts have no lines, an empty text has one blank line. Rows of one id and text are one document: repeated rows
    lose the same lines. A null id comes before all others.
    """
    read = docs.select(F.col(id_col).alias("__id"), F.when(F.col(text).isNotNull(), F.xxhash64(F.col(text))).alias("__h"), F.col(text).alias("__t"))
    roots = line_links(docs, text)

    def occurrences(batches):
        for batch in batches:
            for row, number, ids, *_ in line_slices(batch.column(2)):
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(number.astype(np.int32)), pa.array(ids.view(np.int64))], names=["__id", "__h", "number", "line"])

    held = read.select("__id", "__h").schema.fields
    seen = saved(read.mapInArrow(occurrences, StructType([*held, *StructType.fromDDL("number int, line long").fields])))
    counts = seen.groupBy("line").agg(F.count("*").alias("n"))
    # a line that stands once and is linked with none is alone in its component, so it needs no look at the others
    classed = saved(counts.join(roots, counts["line"] == roots["node"], "left").filter("n > 1 or root is not null").select("line", "n", F.coalesce("root", "line").alias("root")))
    several = saved(classed.groupBy("root").agg(F.sum("n").alias("m")).filter("m > 1"))
    wanted = saved(salted_join(classed, several, ["root"]).select("line", "n", "root", "m"))
    much = HOT_PART * (several.agg(F.sum("m")).first()[0] or 0)
    place = F.struct("__id", "__h", "number")
    repeated = saved(hot_join(seen, wanted.select("line", "root"), ["line"], hot=wanted.filter(F.col("n") > much).select("line")).select("__id", "__h", "number", "root"))
    heads = repeated.groupBy("root").agg(F.min(place).alias("head"))
    gone = hot_join(repeated, heads, ["root"], hot=several.filter(F.col("m") > much).select("root"))
    gone = gone.filter(~place.eqNullSafe(F.col("head"))).groupBy("__id", "__h").agg(F.array_sort(F.collect_set("number")).alias("gone"))
    joined = null_safe(read, gone, ["__id", "__h"], "left").select("__id", "__t", "gone")
    new = "n_lines long, n_removed long, kept_sha256 string, removed_lines array<int>" + ", kept_text string" * texts
    schema = StructType([StructField(id_col, held[0].dataType), *StructType.fromDDL(new).fields])

    def cut(batches):
        for batch in batches:
            out = {f.name: [] for f in schema.fields[1:]}
            for t, g in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                lines, g = t.split("\n") if t is not None else [], g or []
                drop = set(g)
                kept = "\n".join(x for i, x in enumerate(lines) if i not in drop)
                out["n_lines"].append(len(lines)), out["n_removed"].append(len(g)), out["removed_lines"].append(g)
                out["kept_sha256"].append(hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest())
                if texts:
                    out["kept_text"].append(kept)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(out.values(), kinds))], names=schema.names)

    return joined.mapInArrow(cut, schema)
