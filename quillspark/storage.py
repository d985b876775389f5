"""Tables written to the folder that driver and executors share, by which loops cut their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_base(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, or in local mode without it a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet under ``spark.checkpoint.dir`` and reads it back; the files go when the driver ends.

    In local mode without that setting a temporary folder is used; on a cluster it must be set.
    """
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_base(spark)}/stored-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.parquet(path.toString())
    return spark.read.schema(df.schema).parquet(path.toString())


def dropped(df: DataFrame) -> None:
    """Deletes the files of a ``stored`` table that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/stored-" in f}:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
