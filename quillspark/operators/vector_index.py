"""A kept vector index: inverted cells with residual codes, exact scores of what they find, probes widened until an audit passes."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ..storage import shared_base, stored
from .bands import _unit_vectors
from .retrieval import best_chunk, top_per_query, vector_search

#: Vectors that the cells' centres are fitted on, most cells, rounds of fitting.
FITTED, CELLS, ROUNDS = 65_536, 1024, 8
#: Rows found by codes for each row asked for; queries of the audit; queries of one unit of work.
OVER, AUDITED, QUERIES_EACH = 4, 64, 1024
#: Share of the audit's rows that must be found.
RECALL = 0.99


def fitted_centres(x: np.ndarray, number: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of ``number`` groups of unit vectors by a few rounds of assignment and mean; the first ones are vectors themselves."""
    centres = x[np.linspace(0, len(x) - 1, number).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([(part @ centres.T).argmax(axis=1) for part in np.array_split(x, max(1, len(x) // 8192))])
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 0, total / np.where(norm > 0, norm, 1), centres)
    return centres


def coded(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Residuals as one byte a component, and the step of each row."""
    rest = x - centre
    step = np.abs(rest).max(axis=1) / 127
    return np.round(rest / np.where(step > 0, step, 1)[:, None]).astype(np.int8), step


@dataclass(frozen=True)
class VectorIndex:
    """Vectors of chunks (memory_id, ordinal, embedding) of one length under a folder that driver and executors share.

    ``codes`` has a row for each vector with its cell, one byte a component of what the cell's centre leaves, and the
    step; ``vectors`` has the vectors themselves. Both are divided by cell. Centres are fitted on a bounded sample of
    FITTED vectors; every vector is indexed.
    """

    spark: SparkSession
    path: str
    centres: np.ndarray

    @staticmethod
    def build(chunks: DataFrame, path: str | None = None) -> VectorIndex:
        """Indexes chunks; those without a vector, or with one of another length than most have, are left out."""
        spark = chunks.sparkSession
        path = path or f"{shared_base(spark)}/vectors-{uuid.uuid4().hex}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
        rows = chunks.select("memory_id", F.col("ordinal").cast("int").alias("ordinal"), F.col("embedding").cast("array<double>").alias("embedding")).filter("size(embedding) > 0 and not exists(embedding, x -> x is null)")
        most = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
        if most is None:
            return VectorIndex(spark, path, np.zeros((0, 0)))
        size, number = most
        rows = rows.filter(F.size("embedding") == size)
        drawn = rows.orderBy(F.xxhash64("memory_id", "ordinal")).limit(FITTED).select("embedding").toArrow()
        sample = _unit_vectors(drawn.column(0).combine_chunks(), size)
        centres = fitted_centres(sample, max(1, min(CELLS, math.isqrt(number), len(sample))))
        sent = spark.sparkContext.broadcast(centres)
        made = StructType([*rows.schema.fields, *StructType.fromDDL("cell int, code binary, step double").fields])

        def place(batches):
            for batch in batches:
                x = _unit_vectors(batch.column("embedding"), size)
                cell = (x @ sent.value.T).argmax(axis=1)
                code, step = coded(x, sent.value[cell])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(step)], names=made.names)

        placed = stored(rows.mapInArrow(place, made)).repartition("cell")
        placed.select("cell", "memory_id", "ordinal", "code", "step").write.partitionBy("cell").parquet(f"{path}/codes")
        placed.select("cell", "memory_id", "ordinal", "embedding").write.partitionBy("cell").parquet(f"{path}/vectors")
        return VectorIndex(spark, path, centres)

    def search(self, queries: DataFrame, k: int, within: DataFrame | None = None, recall: float = RECALL, digits: int = 6) -> tuple[DataFrame, float, int]:
        """((qid, memory_id, score, ordinal, rank), recall found by the audit, cells read for each query).

        The audit takes AUDITED of the queries, answers them exactly under the same filter (``within``: memory_id), and
        doubles the cells of each query until ``recall`` of those rows are found; with all cells, and all rows scored
        exactly, there is nothing left to lose.
        """
        asked = stored(queries.select("qid", F.col("embedding").cast("array<double>").alias("embedding")).filter(F.size("embedding") == self.centres.shape[1]))
        whole = self.spark.read.parquet(f"{self.path}/vectors").drop("cell")
        if within is not None:
            whole = whole.join(within.select("memory_id").distinct(), "memory_id", "left_semi")
        some = stored(asked.orderBy(F.xxhash64("qid"), "qid").limit(AUDITED))
        exact = stored(vector_search(whole, some, k, digits).select("qid", "memory_id"))
        wanted = exact.count()
        probes, every = min(len(self.centres), 8), len(self.centres)
        while True:
            got = self._found(some, k, within, probes, digits)
            hit = exact.join(got.select("qid", "memory_id"), ["qid", "memory_id"], "left_semi").count() if wanted else 0
            reached = hit / wanted if wanted else 1.0
            if reached >= recall:
                return self._found(asked, k, within, probes, digits), reached, probes
            if probes == every:
                return vector_search(whole, asked, k, digits), 1.0, every
            probes = min(every, probes * 2)

    def _found(self, asked: DataFrame, k: int, within: DataFrame | None, probes: int, digits: int) -> DataFrame:
        """The ``k`` best memories of each query among its ``probes`` nearest cells: by codes first, the best of those exactly."""
        size, sent = self.centres.shape[1], self.spark.sparkContext.broadcast(self.centres)
        kind, memory = asked.schema["qid"].dataType, self.spark.read.parquet(f"{self.path}/codes").schema["memory_id"]
        routed = StructType([StructField("qid", kind), *StructType.fromDDL("embedding array<double>, cell int, near double").fields])

        def route(batches):
            for batch in batches:
                q = _unit_vectors(batch.column(1), size)
                near = q @ sent.value.T
                cells = np.argpartition(-near, min(probes, near.shape[1]) - 1, axis=1)[:, :probes]
                row = np.repeat(np.arange(len(q)), cells.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(cells.ravel().astype(np.int32)), pa.array(near[row, cells.ravel()])], names=routed.names)

        going = stored(asked.mapInArrow(route, routed).withColumn("unit", F.pmod(F.xxhash64("qid"), F.lit(max(1, -(-asked.count() // QUERIES_EACH))))))
        codes = self.spark.read.parquet(f"{self.path}/codes")
        if within is not None:
            codes = codes.join(within.select("memory_id").distinct(), "memory_id", "left_semi")
        units = going.select("cell", F.col("unit").alias("u")).distinct()
        out = StructType([StructField("qid", kind), memory, *StructType.fromDDL("cell int, ordinal int").fields, StructField("guess", DoubleType())])
        arrow = to_arrow_schema(out)

        def scored(q: pa.Table, x: pa.Table) -> pa.Table:
            if not q.num_rows or not x.num_rows:
                return arrow.empty_table()
            vectors = _unit_vectors(q.column("embedding").combine_chunks(), size)
            code = np.frombuffer(b"".join(x.column("code").to_pylist()), np.int8).reshape(-1, size).astype(np.float32)
            guess = q.column("near").to_numpy()[:, None] + (vectors.astype(np.float32) @ code.T) * x.column("step").to_numpy()[None, :]
            few = min(OVER * k, guess.shape[1])
            best = np.argpartition(-guess, few - 1, axis=1)[:, :few]
            row, at = np.repeat(np.arange(len(vectors)), few), best.ravel()
            take = lambda t, c, i: t.column(c).take(pa.array(i))
            return pa.Table.from_arrays([take(q, "qid", row), take(x, "memory_id", at), take(x, "cell", at), take(x, "ordinal", at), pa.array(guess[row, at].astype(float))], schema=arrow)

        met = codes.join(units, "cell").withColumnRenamed("u", "unit")
        guessed = going.groupBy("cell", "unit").cogroup(met.groupBy("cell", "unit")).applyInArrow(scored, out)
        first = top_per_query(guessed, OVER * k, "guess").select("qid", "memory_id", "cell", "ordinal")
        vectors = self.spark.read.parquet(f"{self.path}/vectors").withColumnRenamed("embedding", "x")
        rows = first.join(vectors, ["cell", "memory_id", "ordinal"]).join(asked, "qid")
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
        norm = F.sqrt(dot("x", "x")) * F.sqrt(dot("embedding", "embedding"))
        score = F.when(norm == 0, 0.0).otherwise(F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot("x", "embedding") / norm)), digits))
        return top_per_query(best_chunk(rows.select("qid", "memory_id", "ordinal", score.alias("score"))), k)
