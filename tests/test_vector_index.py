"""The kept vector index against exact search, with and without a filter."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import retrieval as S
from quillspark.operators import vector_index as V


@pytest.fixture(scope="module")
def chunks(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(30, 24))
    rows = [(i // 2, i % 2, (centres[i % 30] + draw.normal(scale=0.3, size=24)).tolist()) for i in range(3000)]
    return spark.createDataFrame([*rows, (9000, 0, None), (9001, 0, [1.0, 2.0])], "memory_id long, ordinal int, embedding array<double>")


def share(got, exact):
    want = {(r.qid, r.memory_id) for r in exact.collect()}
    return len(want & {(r.qid, r.memory_id) for r in got.collect()}) / len(want)


def test_recall_and_scores(spark, chunks):
    index = V.VectorIndex.build(chunks)
    assert len(index.centres) == 54 and index.spark.read.parquet(f"{index.path}/codes").count() == 3000
    asked = chunks.filter("ordinal = 0 and memory_id % 11 = 0").select(F.col("memory_id").alias("qid"), "embedding")
    got, reached, probes = index.search(asked, 10)
    exact = S.vector_search(chunks, asked, 10)
    assert reached >= 0.99 and probes < 54 and share(got, exact) >= 0.98
    both = got.join(exact.select("qid", "memory_id", F.col("score").alias("s"), F.col("ordinal").alias("o")), ["qid", "memory_id"])
    assert both.filter("abs(score - s) > 1e-6 or ordinal <> o").count() == 0


def test_filter_widens_the_probes(spark, chunks):
    index = V.VectorIndex.build(chunks)
    asked = chunks.filter("ordinal = 1 and memory_id % 40 = 0").select(F.col("memory_id").alias("qid"), "embedding")
    few = chunks.filter("memory_id % 37 = 5").select("memory_id")
    got, reached, probes = index.search(asked, 10, within=few)
    exact = S.vector_search(chunks.join(few, "memory_id", "left_semi"), asked, 10)
    assert reached >= 0.99 and share(got, exact) >= 0.98 and got.join(few, "memory_id", "left_anti").count() == 0
    none, reached, _ = index.search(asked, 10, within=few.limit(0))
    assert none.count() == 0 and reached == 1.0
