"""Retrieval arms for batches of queries: exact cosine top-k and BM25 over the filtered chunks."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from ..storage import stored
from .lexical_index import temporary_index

#: Queries whose vectors are sent to every task at once; more go block by block.
MOST_QUERIES = 10_000
#: Scores that a task works out at once, and candidates that it holds before it drops those that can't be among the best.
TILE_SCORES, MOST_HELD = 1 << 19, 1 << 18


def top_per_query(rows: DataFrame, k: int, score: str = "score", id_col: str = "memory_id", query: str = "qid") -> DataFrame:
    """First ``k`` rows of each query by score, ties by id, with ``rank`` from 1."""
    w = Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(id_col))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def best_chunk(rows: DataFrame, score: str = "score", query: str | None = "qid") -> DataFrame:
    """Best chunk of each memory (and query): highest score, the first ordinal at a tie."""
    keys = ["memory_id"] if query is None else [query, "memory_id"]
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col("ordinal")).alias("o"))).alias("best")
    return rows.groupBy(*keys).agg(best).select(*keys, F.col("best.s").alias(score), (-F.col("best.o")).alias("ordinal"))


class _Best:
    """The ``k`` best memories so far of each query in a task, with ties at the edge; no more than some MOST_HELD candidates."""

    def __init__(self, queries: int, k: int):
        self.k, self.least, self.full = k, np.full(queries, -np.inf), MOST_HELD
        self.memory = self.ordinal = None
        self.query, self.row, self.score, self.held = [], [], [], 0

    def start(self, memory: pa.Array, ordinal: pa.Array) -> None:
        """Chunks that the next scores are of."""
        self.base = 0 if self.memory is None else len(self.memory)
        member = np.asarray(memory.dictionary_encode().indices.fill_null(-1))
        self.by_memory = np.argsort(member, kind="stable")
        self.starts = np.flatnonzero(np.diff(member[self.by_memory], prepend=-2))
        self.memory, self.ordinal = (memory, ordinal) if self.memory is None else (pa.concat_arrays([self.memory, memory]), pa.concat_arrays([self.ordinal, ordinal]))

    def take(self, first: int, s: np.ndarray) -> None:
        """Scores of queries from number ``first`` on (rows) against the chunks; what isn't a number is left out."""
        s = np.where(np.isnan(s), -np.inf, s)
        least = self.least[first : first + len(s)]
        if np.count_nonzero(s >= least[:, None]) > 4 * self.k * len(s) and len(self.starts) > self.k:
            best = s if len(self.starts) == s.shape[1] else np.maximum.reduceat(s[:, self.by_memory], self.starts, axis=1)
            np.maximum(least, np.partition(best, best.shape[1] - self.k, axis=1)[:, best.shape[1] - self.k], out=least)
        q, row = np.nonzero((s >= least[:, None]) & (s > -np.inf))
        self.query.append((q + first).astype(np.int32)), self.row.append((row + self.base).astype(np.int32)), self.score.append(s[q, row])
        self.held += len(q)
        if self.held > self.full:
            self.settle()

    def settle(self) -> None:
        """Keeps the best chunk of each memory, and of each query the ``k`` best memories; names only chunks still held."""
        q, row, s = (np.concatenate(c) for c in (self.query, self.row, self.score))
        member = np.asarray(self.memory.dictionary_encode().indices)[row]
        order = np.lexsort((np.asarray(self.ordinal)[row], -s, member, q))
        q, row, s, member = q[order], row[order], s[order], member[order]
        one = np.flatnonzero(np.diff(q, prepend=-1) | np.diff(member, prepend=-1))
        q, row, s = q[one], row[one], s[one]
        order = np.lexsort((-s, q))
        q, row, s = q[order], row[order], s[order]
        start = np.flatnonzero(np.diff(q, prepend=-1))
        edge = start + self.k - 1
        full = edge < np.append(start[1:], len(q))
        self.least[q[start[full]]] = s[edge[full]]
        keep = s >= self.least[q]
        q, s = q[keep], s[keep]
        rows, row = np.unique(row[keep], return_inverse=True)
        recent = np.arange(self.base, len(self.memory))  # the batch at work
        rest = rows[rows < self.base]
        place = np.append(rest, recent)
        self.memory, self.ordinal = (c.take(pa.array(place)) for c in (self.memory, self.ordinal))
        row = np.where(rows < self.base, np.searchsorted(rest, rows), len(rest) + rows - self.base)[row]
        self.base = len(rest)
        self.query, self.row, self.score, self.held = [q], [row.astype(np.int32)], [s], len(q)
        self.full = max(MOST_HELD, 2 * len(q))

    def rows(self, qids: pa.Array, schema: StructType):
        """Batches of (qid, memory, score, ordinal)."""
        if not self.held:
            return
        self.settle()
        for lo in range(0, self.held, MOST_HELD):
            q, row, s = (c[0][lo : lo + MOST_HELD] for c in (self.query, self.row, self.score))
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(q)), self.memory.take(pa.array(row)), pa.array(s), self.ordinal.take(pa.array(row))], names=schema.names)


def vector_search(chunks: DataFrame, queries: DataFrame, k: int, digits: int | None = 6) -> DataFrame:
    """(qid, memory_id, score, ordinal, rank) of the ``k`` nearest memories of each query, exactly.

    ``chunks`` has memory_id, ordinal, embedding; ``queries`` has qid and embedding, and more than MOST_QUERIES
    of them are answered block by block. A
    task scores its chunks against all queries by matrix products of TILE_SCORES scores, holds only its k best memories of
    each query so far and passes on those, so neither its memory nor what is shuffled grows with its chunks. Chunks without a vector, or of another length,
    are skipped; a zero vector scores 0.
    """
    asked = queries.select("qid", F.col("embedding").cast("array<double>")).filter("embedding is not null")
    blocks = -(-asked.count() // MOST_QUERIES)
    if blocks > 1:
        asked = stored(asked.withColumn("__block", F.pmod(F.xxhash64("qid"), F.lit(2 * blocks))))
        parts = [vector_search(chunks, asked.filter(F.col("__block") == i).drop("__block"), k, digits) for i in range(2 * blocks)]
        return reduce(DataFrame.union, parts)
    held = asked.collect()
    read = chunks.select("memory_id", F.col("ordinal").cast("int"), F.col("embedding").cast("array<double>").alias("embedding"))
    kind = queries.schema["qid"].dataType
    schema = StructType([StructField("qid", kind), read.schema["memory_id"], *StructType.fromDDL("score double, ordinal int").fields])
    by_size: dict[int, tuple[list, np.ndarray]] = {}
    for size in {len(r["embedding"]) for r in held}:
        same = [r for r in held if len(r["embedding"]) == size]
        by_size[size] = ([r["qid"] for r in same], np.array([r["embedding"] for r in same]))
    sent = chunks.sparkSession.sparkContext.broadcast(by_size)

    qid_type = to_arrow_type(kind)

    def score(batches):
        best = {size: _Best(len(qids), k) for size, (qids, _) in sent.value.items()}
        for batch in batches:
            lists = batch.column(2)
            sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), -1))
            for size, (_, q) in sent.value.items():
                rows = np.flatnonzero(sizes == size)
                if not len(rows) or not size:
                    continue
                part = batch.take(pa.array(rows))
                x = np.asarray(part.column(2).flatten()).reshape(-1, size)
                best[size].start(part.column(0), part.column(1))
                xn, qn = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
                step = max(1, TILE_SCORES // len(x))
                for lo in range(0, len(q), step):
                    norm = qn[lo : lo + step, None] * xn[None, :]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        s = np.where(norm == 0, 0.0, np.clip(q[lo : lo + step] @ x.T / norm, -1, 1))
                    best[size].take(lo, np.round(s, digits) + 0.0 if digits is not None else s)
        for size, (qids, _) in sent.value.items():
            yield from best[size].rows(pa.array(qids, qid_type), schema)

    return top_per_query(best_chunk(read.mapInArrow(score, schema)), k)


def lexical_search(chunks: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(qid, memory_id, score, ordinal, rank) of the ``k`` best memories of each query by BM25; any term may match.

    Number of chunks, mean length and document frequencies are those of ``chunks`` as given, so filter them before. The
    chunks are indexed for this search alone; to ask more than once, keep a ``LexicalIndex`` and give it the filter.
    """
    return temporary_index(chunks).search(queries, k, digits=digits)


def neighbours(memories: DataFrame, chunks: DataFrame, queries: DataFrame, k: int = 64) -> DataFrame:
    """Nearest memories that aren't archived, without the query's own memory (``exclude_id`` of ``queries``)."""
    live = chunks.join(memories.filter("status <> 'archived'").select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
    found = vector_search(live, queries, k + 1).join(queries.select("qid", "exclude_id"), "qid")
    return top_per_query(found.filter("memory_id <> exclude_id or exclude_id is null").drop("rank", "exclude_id"), k)


def sample_embeddings(memories: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """First vector of each memory that isn't archived, in id order."""
    live = memories.filter("status <> 'archived'").select(F.col("id").alias("memory_id"))
    first = chunks.filter("embedding is not null").groupBy("memory_id").agg(F.min_by("embedding", "ordinal").alias("embedding"))
    return first.join(live, "memory_id", "left_semi").orderBy("memory_id").limit(limit)


def candidate_sizes(limit: int, list_all: bool = False, coverage_limit: int = 100, multiplier: int = 6) -> tuple[int, int, int]:
    """(effective limit, rows fetched by an arm, fused rows looked at)."""
    effective = min(max(limit, coverage_limit), 200) if list_all else limit
    return effective, min(effective * max(multiplier, 1), 600), max(32, effective)
