"""Helpers that several training-data operators use: shared storage, row keys, ranks, hashes of byte slices."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step holds; bounds a Python worker's memory whatever the batch size.
CHUNK_BYTES = 2 << 20


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, or in local mode a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: lineage ends in replicated storage.

    A lost executor then costs a re-read, not a recomputation. The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillspark-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_saved(df: DataFrame) -> None:
    """Deletes the files of a ``saved`` table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/quillspark-" in f}:
        jvm_path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jvm_path, True)


def text_key() -> list[str]:
    """Columns of ``with_text_key``."""
    return ["__h", "__crc", "__size"]


def with_text_key(df: DataFrame, text: str = "text", overhead: int = 0) -> DataFrame:
    """Adds what stands for a whole text without its bytes: XXH64, CRC32 and size.

    Null texts get null hashes, and so a key of their own.
    """
    return df.withColumns(
        {
            "__h": F.when(F.col(text).isNotNull(), F.xxhash64(F.col(text))),
            "__crc": F.crc32(F.col(text)),
            "__size": (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + overhead).cast("long"),
        }
    )


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet null keys; the right side's keys are dropped."""
    other = right.select(*[F.col(c).alias(f"__r_{i}") for i, c in enumerate(keys)], *[c for c in right.columns if c not in keys])
    cond = None
    for i, c in enumerate(keys):
        part = left[c].eqNullSafe(other[f"__r_{i}"])
        cond = part if cond is None else cond & part
    return left.join(other, cond, how).drop(*[f"__r_{i}" for i in range(len(keys))])


def row_tie(df: DataFrame) -> Column:
    """Hash of all columns of a row: tells rows of one id apart the same way in every run."""
    return F.xxhash64(*[F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in df.schema.fields])


def with_row_number(df: DataFrame, key: list[str]) -> DataFrame:
    """Adds ``__n``: 1, 2, ... among rows of one key, which has an id and a hash of all else: they are exact repeats."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*key)))


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], salts: int = 16) -> DataFrame:
    """Inner equi-join of ``left``, any key of which may be hot, with a narrow ``right``, unique in the keys: each right row
    goes to ``salts`` places, and a key's left rows are spread over these."""
    spread = left.withColumn("__salt", F.pmod(F.xxhash64(*[c for c in left.columns]), F.lit(salts)))
    return spread.join(right.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), [*keys, "__salt"]).drop("__salt")


#: A key with over this part of a join's rows is hot: so there are fewer hot keys than its inverse.
HOT_PART = 1 / 500


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """Equi-join of ``left``, any key of which may have a large part of its rows, with ``right``, unique in the keys.

    Hot keys are counted first (combined where the rows are), or given by who has counted them as ``hot``. They number
    under 1 / HOT_PART by definition: their right rows are broadcast, so their left rows stay where they are, and all
    others are joined by a shuffle. ``left`` is read several times, so it should be a saved table. Null keys match nothing.
    """
    if hot is None:
        counts = left.groupBy(*keys).agg(F.count("*").alias("__c"))
        hot = counts.filter(F.col("__c") > max(1.0, left.count() * HOT_PART)).select(*keys).filter(" and ".join(f"{k} is not null" for k in keys))
    hot = saved(hot)
    if hot.isEmpty():
        return left.join(right, keys, how)
    marked = left.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), keys, "left")
    columns = [*keys, *[c for c in left.columns if c not in keys], *[c for c in right.columns if c not in keys]]
    few = right.join(F.broadcast(hot), keys, "left_semi")
    cold = marked.filter("__hot is null").drop("__hot").join(right, keys, how)
    return cold.select(columns).union(marked.filter("__hot").drop("__hot").join(F.broadcast(few), keys, how).select(columns))


def with_global_rank(df: DataFrame, order: list[str], name: str = "__rank") -> DataFrame:
    """Adds a gapless rank from 0 in the total order of unique ``order`` columns, without a single-task sort.

    Range-partitions by the order, ranks within each partition, then adds the counts of the partitions before.
    """
    ordered = [F.col(c).asc_nulls_last() for c in order]
    ranged = saved(df.repartitionByRange(*ordered).withColumn("__pid", F.spark_partition_id()))
    before = ranged.groupBy("__pid").count().withColumn("__before", F.sum("count").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = ranged.withColumn("__at", F.row_number().over(Window.partitionBy("__pid").orderBy(*ordered)))
    joined = ranked.join(before.select("__pid", "__before"), "__pid")
    return joined.withColumn(name, F.col("__at") - 1 + F.coalesce("__before", F.lit(0))).drop("__pid", "__at", "__before")


def tasks_for(rows: int, per_task: int) -> int:
    """Number of parts of about ``per_task`` rows; it follows from the rows alone, never from the cluster."""
    return max(1, -(-rows // per_task))


def give_back() -> None:
    """Returns to the system what the allocators of this Python worker keep after a step; workers live on and are reused."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


# --- bytes -------------------------------------------------------------------------------------------------------

#: Bytes that separate words: space and 0x09 to 0x0D.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def text_slices(texts: pa.Array, limit: int = CHUNK_BYTES):
    """Yields (first row, bytes, offsets) for runs of rows of at most ``limit`` bytes (one row at least).

    ``bytes`` ends in 8 spare zero bytes, so that 8-byte loads stay inside. Nulls count as empty.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        part = np.zeros(offsets[last] - offsets[first] + 8, np.uint8)
        part[:-8] = data[offsets[first] : offsets[last]]
        yield first, part, offsets[first : last + 1] - offsets[first]
        first = last


def row_pieces(data: np.ndarray, size: int, separates: np.ndarray = WHITE, overlap: int = 0, limit: int = CHUNK_BYTES):
    """Yields (first byte, first word, piece, starts, ends) for the ``size`` bytes of one row, about ``limit`` bytes at a time.

    Pieces end between words and repeat the last ``overlap`` words of the piece before; a row of up to ``limit`` bytes is
    one piece. ``piece`` ends in 8 spare bytes. So a very long text costs the memory of a piece, not its own times 50.
    """
    begin, word, reach = 0, 0, limit
    while True:
        end = min(size, begin + reach)
        while end < size and not separates[data[end]]:
            end += 1
        piece = np.zeros(end - begin + 8, np.uint8)
        piece[:-8] = data[begin:end]
        starts, ends, _ = word_bounds(piece, np.array([0, end - begin]), separates)
        again = min(overlap, len(starts))
        back = int(starts[len(starts) - again]) if again else end - begin
        if end < size and not back:  # the piece has no more words than repeat: take a longer one
            reach *= 2
            continue
        yield begin, word, piece, starts, ends
        if end >= size:
            return
        begin, word, reach = begin + back, word + len(starts) - again, limit


def word_bounds(data: np.ndarray, offsets: np.ndarray, separates: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and for each row where its words begin (one more at the end)."""
    n = int(offsets[-1])
    inside = ~separates[data[:n]]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | cut[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | cut[1:n]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words one after another with a space behind each: bytes (8 spare), new starts, new ends."""
    sizes = ends - starts
    new = np.cumsum(sizes + 1) - (sizes + 1)
    out = np.full(int(sizes.sum()) + len(sizes) + 8, 0x20, np.uint8)
    at = np.repeat(new - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
    source = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
    out[at] = data[source]
    return out, new, new + sizes


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))  # fixed values of XXH64


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray | np.uint64, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64_slices(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each slice of ``data`` (which has 8 spare bytes at its end), all slices at once."""
    with np.errstate(over="ignore"):
        n = len(starts)
        lanes = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        words = np.ndarray(len(data) - 3, "<u4", data, strides=(1,))
        at, size, s = starts.astype(np.int64), sizes.astype(np.int64), np.uint64(seed)
        h = np.full(n, s + _P5, np.uint64)
        if len(big := np.flatnonzero(size >= 32)):
            acc = [np.full(len(big), v, np.uint64) for v in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            live, stripes, t = np.arange(len(big)), size[big] // 32, 0
            while len(live):
                for i in range(4):
                    acc[i][live] = _round(acc[i][live], lanes[at[big[live]] + 32 * t + 8 * i])
                t += 1
                live = live[stripes[live] > t]
            total = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for v in acc:
                total = (total ^ _round(np.uint64(0), v)) * _P1 + _P4
            h[big] = total
        h += size.astype(np.uint64)
        at = at + (size // 32) * 32
        left = size % 32
        for _ in range(3):
            if not len(live := np.flatnonzero(left >= 8)):
                break
            h[live] = _rotl(h[live] ^ _round(np.uint64(0), lanes[at[live]]), 27) * _P1 + _P4
            at[live] += 8
            left[live] -= 8
        if len(live := np.flatnonzero(left >= 4)):
            h[live] = _rotl(h[live] ^ (words[at[live]].astype(np.uint64) * _P1), 23) * _P2 + _P3
            at[live] += 4
            left[live] -= 4
        for _ in range(3):
            if not len(live := np.flatnonzero(left > 0)):
                break
            h[live] = _rotl(h[live] ^ (data[at[live]].astype(np.uint64) * _P5), 11) * _P1
            at[live] += 1
            left[live] -= 1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        return h ^ (h >> np.uint64(32))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component under the edges a-b, by hooking and pointer jumping."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if not len(live := np.flatnonzero(low != high)):
            break
        np.minimum.at(root, high[live], low[live])
        a, b = a[live], b[live]
        while not np.array_equal(jump := root[root], root):
            root = jump
    return root
