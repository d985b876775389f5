"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated by temperature."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import CHUNK_BYTES, WHITE, give_back, row_pieces, text_slices, xxh64_slices

#: Words are hashed to so many rows of vectors; their length; index vectors' nonzeros; neighbours counted on each side.
BUCKETS, DIMENSIONS, NONZEROS, SIDE = 1 << 15, 64, 6, 2
#: Labelled rows that the network is fitted on at most; those with the least hash of the id are taken.
MOST_LABELLED = 20_000
#: Bytes of text, and words, whose vectors are held at once; bucket rows in a summed block.
STEP_BYTES, STEP_WORDS, BLOCK = 1 << 19, 1 << 17, 1024
#: Tasks' sums of a block are added in so many lanes before the lanes are.
LANES = 64

# Runs of one class are words: letters (and bytes from 0x80), digits, or one kind of punctuation mark.
_CLASS = np.arange(256, dtype=np.int16) + 3
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[WHITE] = 0


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word, and for each row where its words begin (one more at the end)."""
    n = int(offsets[-1])
    if len(offsets) == 2 and n > CHUNK_BYTES:
        parts = [_words(piece, np.array([0, len(piece) - 8]))[0] for _, _, piece, _, _ in row_pieces(data, n, limit=STEP_BYTES)]
        ids = np.concatenate(parts)
        return ids, np.array([0, len(ids)])
    kind = _CLASS[data[:n]]
    fresh = np.ones(n + 1, bool)
    fresh[1:n] = kind[1:] != kind[:-1]
    fresh[offsets] = True
    edge = np.flatnonzero(fresh)
    starts, ends = edge[:-1], edge[1:]
    inside = kind[starts] != 0
    starts, ends = starts[inside], ends[inside]
    return (xxh64_slices(data, starts, ends - starts) & np.uint64(BUCKETS - 1)).astype(np.int64), np.searchsorted(starts, offsets)


def index_vectors() -> np.ndarray:
    """Sparse random vector of -1, 0 and 1 of each bucket."""
    draw = np.random.default_rng(20240101)
    out = np.zeros((BUCKETS, DIMENSIONS), np.int16)
    at = draw.random((BUCKETS, DIMENSIONS)).argsort(axis=1)[:, :NONZEROS]
    np.put_along_axis(out, at, draw.choice([-1, 1], (BUCKETS, NONZEROS)).astype(np.int16), axis=1)
    return out


def fit_word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Unit vectors of all buckets, scaled by rarity: sums of the index vectors of all neighbours in all ``docs``.

    Every task sums over its texts; the sums, of fixed size, are added by blocks of buckets, first in lanes of tasks, then
    over the lanes, so that no task reads the sums of all. Buckets never met are zero.
    """
    width = DIMENSIONS + 1

    def count(batches):
        index, total = index_vectors(), np.zeros((BUCKETS, width), np.int32)
        for batch in batches:
            for _, data, offsets in text_slices(batch.column(0), STEP_BYTES):
                ids, of = _words(data, offsets)
                if not len(ids):
                    continue
                rows = np.repeat(np.arange(len(of) - 1, dtype=np.int32), np.diff(of))
                for lo in range(0, len(ids), STEP_WORDS):  # with the neighbours of its ends
                    a, b = max(0, lo - SIDE), min(len(ids), lo + STEP_WORDS + SIDE)
                    near, row = index[ids[a:b]], rows[a:b]
                    context = np.zeros((b - a, DIMENSIONS), np.int16)
                    for d in range(1, SIDE + 1):
                        same = (row[d:] == row[:-d]).astype(np.int16)[:, None]
                        context[d:] += near[:-d] * same
                        context[:-d] += near[d:] * same
                    mine = ids[lo : lo + STEP_WORDS]
                    order = np.argsort(mine, kind="stable")
                    mine = mine[order]
                    cut = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
                    total[mine[cut], :DIMENSIONS] += np.add.reduceat(context[lo - a + order], cut, axis=0, dtype=np.int32)
                    total[mine[cut], DIMENSIONS] += np.diff(np.append(cut, len(mine))).astype(np.int32)
        give_back()
        for b in range(0, BUCKETS, BLOCK):
            if total[b : b + BLOCK].any():
                lane = TaskContext.get().partitionId() % LANES
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([lane], pa.int32()), pa.array([total[b : b + BLOCK].astype("<i4").tobytes()])], names=["block", "lane", "sums"])

    def add(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for b, lane, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                raw = s.as_buffer()
                part = np.frombuffer(raw, "<i4" if raw.size == BLOCK * width * 4 else "<i8").astype(np.int64)
                sums[b, lane] = sums[b, lane] + part if (b, lane) in sums else part
        for (b, lane), s in sorted(sums.items()):
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([lane], pa.int32()), pa.array([s.tobytes()])], names=["block", "lane", "sums"])

    schema = "block int, lane int, sums binary"
    lanes = docs.select(text).mapInArrow(count, schema).repartition("block", "lane").mapInArrow(add, schema)
    total = np.zeros((BUCKETS, width), np.float64)
    for r in lanes.withColumn("lane", F.lit(0)).repartition("block").mapInArrow(add, schema).collect():
        total[r["block"] : r["block"] + BLOCK] = np.frombuffer(r["sums"], "<i8").reshape(-1, width)
    vectors, often = total[:, :DIMENSIONS], total[:, DIMENSIONS:] / max(1.0, total[:, DIMENSIONS].sum())
    vectors = vectors - often.T @ vectors  # what all contexts share says nothing
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(size > 0, size, 1) * (1e-3 / (1e-3 + often)) ** 0.5).astype(np.float32)


def _pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of each text; zero for texts without words."""
    out = np.zeros((len(texts), 2 * DIMENSIONS), np.float32)
    for first, data, offsets in text_slices(texts, STEP_BYTES):
        ids, of = _words(data, offsets)
        some = np.flatnonzero(np.diff(of))
        if not len(some):
            continue
        if len(of) == 2 and len(ids) > STEP_WORDS:
            total, square = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
            for k in range(0, len(ids), STEP_WORDS):
                x = vectors[ids[k : k + STEP_WORDS]]
                total, square = total + x.sum(0, dtype=np.float64), square + np.square(x).sum(0, dtype=np.float64)
            mean = total / len(ids)
            out[first] = np.concatenate([mean, np.sqrt(np.maximum(square / len(ids) - mean**2, 0))])
            continue
        x, n = vectors[ids], np.diff(of)[some][:, None]
        mean = np.add.reduceat(x, of[some], axis=0) / n
        np.square(x, out=x)
        spread = np.sqrt(np.maximum(np.add.reduceat(x, of[some], axis=0) / n - mean**2, 0))
        out[first + some] = np.concatenate([mean, spread], axis=1)
    return out


@dataclass
class Network:
    """Two layers over standardised inputs; the score is the sigmoid of the output over ``temperature``."""

    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.shift) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 48, epochs: int = 60, rate: float = 2e-3, decay: float = 1e-4, seed: int = 7) -> Network:
    """Adam on cross entropy over four fifths of the rows; the rest choose the epoch and the temperature.

    Without rows, or with one class only, the score is constant: one half, or the share of that class smoothed.
    """
    d = x.shape[1]
    if len(np.unique(y)) < 2:
        prior = (y.sum() + 1) / (len(y) + 2)
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log(prior / (1 - prior))), 1.0)
    draw = np.random.default_rng(seed)
    order = draw.permutation(len(y))
    kept, seen = (order[len(y) // 5 :], order[: len(y) // 5]) if len(y) >= 50 else (order, order)
    shift, scale = x[kept].mean(0), x[kept].std(0) + 1e-6
    z, t = (x - shift) / scale, y.astype(float)
    p = [draw.normal(0, (2 / d) ** 0.5, (d, hidden)), np.zeros(hidden), draw.normal(0, (1 / hidden) ** 0.5, hidden), np.zeros(1)]
    m, v, step, best = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0, (np.inf, None)
    out = lambda rows: np.maximum(z[rows] @ p[0] + p[1], 0) @ p[2] + p[3]
    loss = lambda f, rows: float(np.mean(np.logaddexp(0, f) - t[rows] * f))
    for _ in range(epochs):
        for rows in np.array_split(draw.permutation(kept), max(1, len(kept) // 128)):
            h = np.maximum(z[rows] @ p[0] + p[1], 0)
            g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - t[rows]) / len(rows)
            back = np.outer(g, p[2]) * (h > 0)
            grads = [z[rows].T @ back + decay * p[0], back.sum(0), h.T @ g + decay * p[2], np.array([g.sum()])]
            step += 1
            for i, a in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * a
                v[i] = 0.999 * v[i] + 0.001 * a * a
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        if (now := loss(out(seen), seen)) < best[0]:
            best = (now, [a.copy() for a in p])
    p = best[1]
    f = out(seen)
    heat = min(np.geomspace(0.25, 8, 101), key=lambda a: loss(f / a, seen))
    return Network(shift, scale, p[0], p[1], p[2], float(p[3][0]), float(heat))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, most: int) -> DataFrame:
    """(text, y) of at most ``most`` labelled rows for learning: ids whose CRC32 mod 3 isn't 1, least hashes first.

    Of several rows of one id the least text is taken. Labels other than 0 and 1 don't count; of several labels of one id the majority does, and none at a tie.
    """
    learn = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.avg(label).alias("share"))
    learn = learn.filter((F.col("share") != 0.5) & F.col("__id").isNotNull() & ~_held_out(F.col("__id")))
    chosen = learn.select("__id", (F.col("share") > 0.5).cast("int").alias("y")).orderBy(F.xxhash64("__id"), "__id").limit(most)
    return docs.select(F.col(id_col).alias("__id"), F.col(text).alias("t")).join(F.broadcast(chosen), "__id").groupBy("__id", "y").agg(F.min("t").alias("t")).select("t", "y")


def _held_out(id_col):
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(3)) == 1, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", most_labelled: int = MOST_LABELLED) -> DataFrame:
    """``docs`` with held_out, score and predicted for every row.

    Word vectors come from all texts; labels are learnt only from rows that aren't held out, at most ``most_labelled``
    of them. Only the text enters a score. Null, empty and blank texts have the zero vector, and so one common score.
    Own columns of these names are replaced; repeated rows stay.
    """
    spark = docs.sparkSession
    vectors = fit_word_vectors(docs, text)
    sent = spark.sparkContext.broadcast(vectors)

    def pool(batches):
        for batch in batches:
            x = _pooled(batch.column(0), sent.value)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1)], names=["x", "y"])

    rows = labelled_sample(docs, labels, id_col, text, label, most_labelled).mapInArrow(pool, "x binary, y int").collect()
    rows.sort(key=lambda r: (r["y"], r["x"]))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows]).reshape(len(rows), 2 * DIMENSIONS).astype(float)
    network = fit_network(x, np.array([r["y"] for r in rows]))
    net = spark.sparkContext.broadcast(network.__dict__)
    columns = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]

    def scores(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Network(**net.value)
        for texts in parts:
            yield pa.array(np.concatenate([np.zeros(0), *(model.score(_pooled(texts.slice(i, 2000), sent.value)) for i in range(0, len(texts), 2000))]))
        give_back()

    # only texts go to Python and only scores come back; not deterministic, so that no filter makes the plan score twice
    score = F.arrow_udf(scores, "double").asNondeterministic()
    scored = docs.select(*columns, _held_out(F.col(id_col)).alias("held_out"), score(F.col(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
