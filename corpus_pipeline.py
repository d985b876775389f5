"""From raw documents to shards: quality, near copies, benchmark passages, mixing, sharding.

Null, empty and blank texts go through all stages like others: they have one common quality score; those that the
classifier keeps are one group of near copies, of which one row stays; they have no benchmark words; they weigh nothing
in the mix and 16 bytes in a shard. A null id is an id like any other, a null source a source of its own. Of repeated rows the
near-copy stage keeps one; the mix may repeat a row again, and each repeat has a place of its own in the shards. A very long
text is read in pieces. An empty table stays empty. Further columns are carried along; ``shard`` and ``slot`` of the last stage
take the place of columns of these names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm._shared import saved
from quillspark.llm.decontaminate import scan_contamination
from quillspark.llm.mixing import mix_documents
from quillspark.llm.quality import score_quality
from quillspark.llm.sharding import shard_documents
from quillspark.llm.simhash import drop_near_texts


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    scored = score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.filter("predicted = 1").select(docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return drop_near_texts(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return scan_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("not contaminated").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot."""
    return shard_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_filter),
    ("simhash", simhash_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix_sources),
    ("shard", shard),
]

#: The classifier, fingerprints and draws are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to shared storage and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
