"""Memories kept as Parquet under one folder for each tenant's space: upserts rewrite the spaces they touch, nothing else."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import upsert
from ..storage import stored

PARTS = ["org_id", "space_id"]


@dataclass(frozen=True)
class MemoryStore:
    """A table partitioned by org_id and space_id, so a tenant's filter reads its own files only."""

    spark: SparkSession
    path: str

    def _folder(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path.rstrip("/"), *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        path, files = self._folder()
        return files.exists(path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def upsert(self, rows: DataFrame, keys: list[str] | None = None, order: list[str] | None = None) -> None:
        """Writes rows in place of those of their keys within each space; only the spaces of ``rows`` are read and rewritten."""
        keys = [*PARTS, *(keys or ["id"])]
        rows = stored(rows)
        merged = rows
        if self.exists():
            kind = {f.name: f.dataType for f in rows.schema.fields}
            touched = rows.select(*PARTS).distinct()
            held = self.read()
            held = held.select([F.col(c).cast(kind[c]).alias(c) for c in rows.columns]).join(F.broadcast(touched) if touched.count() <= 10_000 else touched, PARTS, "left_semi")
            merged = upsert(held.select(rows.columns), rows, keys, order)
        else:
            merged = upsert(rows.limit(0), rows, keys, order)
        stored(merged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS).parquet(self.path)

    def delete_space(self, org_id: str, space_id: str) -> bool:
        """Removes a space's folder; whether there was one."""
        path, files = self._folder(f"org_id={org_id}", f"space_id={space_id}")
        return files.delete(path, True)
