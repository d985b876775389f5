"""Cases beyond the registered tables: copies, shared names, long documents, many queries."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.functions.entities import name_table
from quillspark.operators import retrieval as S
from quillspark.plans import catalogue, oracle


def test_near_duplicates_take_copies(spark, tmp_path):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.9, 0.4]), (50, [0.0, 1.0]), (51, [0.01, 1.0]), (100, [-1.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["new_id"]: (r["old_id"], r["sim"]) for r in catalogue.near_duplicate_pairs(spark, str(tmp_path)).collect()}
    assert got == {0: (1, 1.0), 50: (51, 0.99995)}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_long_documents_push_no_memory_out(spark, kind):
    near = [(1, o, [1.0, o / 1e4]) for o in range(40)] + [(2, o, [1.0, 0.1 + o / 1e4]) for o in range(40)]
    rows = near + [(m, 0, [1.0, float(m)]) for m in range(3, 60)]
    chunks = spark.createDataFrame(rows, "memory_id long, ordinal int, embedding array<double>").coalesce(1).withColumn("memory_id", F.col("memory_id").cast(kind))
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "qid long, embedding array<double>")
    got = S.vector_search(chunks, asked, 5).orderBy("rank").collect()
    assert [(int(r["memory_id"]), r["ordinal"]) for r in got] == [(1, 0), (2, 0), (3, 0), (4, 0), (5, 0)]


def test_associations_take_shared_names(spark, tmp_path):
    texts = {0: "we met Berta Klein at the gate", 1: "the crane belongs to Berta Klein now", 2: "the crane is out of order"}
    rows = [(i, t, f"l{i}", f"s{i}") for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(i, [1.0, 0.5 * i]) for i in texts], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    names = {i: {n for _, n, _, sure in name_table(pd.Series([t])).itertuples(index=False) if sure} for i, t in texts.items()}
    want = {(0, i, len(names[0] & names[i]) + 1) for i in (1, 2) if names[0] & names[i]}
    got = {(r["left_id"], r["right_id"], r["weight"]) for r in catalogue.association_edges(spark, str(tmp_path)).collect()}
    assert got == want == {(0, 1, 2)}


def test_names_count_from_their_floor_up(spark, tmp_path):
    """F2: cosines 0.4, 0.4, 0.44, 0.45 and 0.8 with the first; below 0.45 only tags count, as in the SQL."""
    named, plain = "the crane belongs to Berta Klein now", "the crane is out of order"
    rows = [(0, "we met Berta Klein at the gate", "en"), (1, named, "en"), (2, named, "l2"), (3, plain, "en"), (4, named, "l4"), (5, named, "en")]
    vectors = [(1, 0, 0, 0, 0), (2, 4, 2, 1, 0), (2, 4, 2, 1, 0), (11, 22, 4, 2, 0), (9, 17, 5, 2, 1), (4, 3, 0, 0, 0)]
    spark.createDataFrame([(i, t, g, f"s{i}") for i, t, g in rows], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r["right_id"], r["sim"], r["weight"]) for r in catalogue.association_edges(spark, str(tmp_path)).collect()}
    assert got == {(1, 0.4, 1), (3, 0.44, 1), (4, 0.45, 2), (5, 0.8, 2)}
    far = spark.read.parquet(str(tmp_path / "embeddings.parquet")).filter("vec_id < 4")
    far.write.parquet(str(tmp_path / "far" / "embeddings.parquet"))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        spark.read.parquet(str(tmp_path / f"{t}.parquet")).write.parquet(str(tmp_path / "far" / f"{t}.parquet"))
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/far/{t}.parquet/*.parquet'")
    df = catalogue.association_edges(spark, str(tmp_path / "far"))
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({oracle.oracle_sql()['association_edges']})").fetchall()
    assert sorted(tuple(r) for r in df.collect()) == sorted(want) and len(want) == 2


def test_ties_of_the_last_digit_are_rounded_as_in_the_sql(spark, tmp_path):
    """cosines half way between two values of six digits, which rounding by decimals puts elsewhere than the SQL."""
    con, ties = duckdb.connect(), [0.5000005, 0.5000045, 0.5000085, 0.5000125]
    vectors = [[1.0, 0.0]] + [[x, (1 - x * x) ** 0.5] for x in ties]
    spark.createDataFrame([(i, "the crane is out of order", "en", "a") for i in range(5)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = catalogue.association_edges(spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({oracle.oracle_sql()['association_edges']})").fetchall()
    assert sorted(tuple(r) for r in df.collect()) == sorted(want) and len(want) == 4


@pytest.mark.parametrize("held", [1 << 20, 5])
def test_a_task_passes_on_its_best_only(spark, monkeypatch, held):
    import numpy as np

    monkeypatch.setattr(S, "MOST_HELD", held), monkeypatch.setattr(S, "TILE_SCORES", 64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        x = np.random.default_rng(2).integers(-2, 3, size=(900, 4)).astype(float)
        rows = [(int(i // 3), int(i % 3), v.tolist()) for i, v in enumerate(x)] + [(400, 0, [1.0, 2.0]), (401, 0, None)]
        chunks = spark.createDataFrame(rows, "memory_id long, ordinal int, embedding array<double>").coalesce(1)
        asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:40])] + [(99, [2.0, 1.0])], "qid long, embedding array<double>")
        passed, was = [], S.best_chunk
        monkeypatch.setattr(S, "best_chunk", lambda df: passed.append(df.count()) or was(df))
        got = {(r.qid, r.rank): (r.memory_id, r.score, r.ordinal) for r in S.vector_search(chunks, asked, 5).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    norm = np.linalg.norm(x, axis=1)
    with np.errstate(invalid="ignore"):
        sim = np.round(np.where(norm[:40, None] * norm == 0, 0.0, np.clip(x[:40] @ x.T / (norm[:40, None] * norm), -1, 1)), 6) + 0.0
    edge = 0
    for q in range(40):
        best = sorted((-max(c), m, int(np.argmax(c))) for m, c in enumerate(sim[q].reshape(-1, 3)))
        assert [got[q, r] for r in range(1, 6)] == [(m, -s, o) for s, m, o in best[:5]]
        edge += sum(s <= best[4][0] for s, _, _ in best)
    assert got[99, 1][0] == 400 and passed == [edge + 1]
