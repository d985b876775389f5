"""Memories and relations as an append log with snapshots: a write is there as a whole or not at all, and history stays readable."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..operators.graph import bridge, remove_touching
from ..operators.history import as_of
from ..storage import stored

PARTS = ["org_id", "space_id"]
#: Keys of the two logs within a space.
KEYS = {"memories": ["id"], "edges": ["source_id", "target_id", "type"]}
_MARKS = "__seq long, __at timestamp, __op string"


class ConcurrentCommit(RuntimeError):
    """Another writer has committed since this one read; nothing of this write is there."""


@dataclass(frozen=True)
class SpaceStore:
    """Logs under a folder that driver and executors share.

    Each write adds folders of rows, marked with its number, time and whether they are put or deleted; then a manifest,
    created only if no other has its number, names all folders that count. Readers see the last manifest, or an earlier
    one if they ask for it. Reads merge: the last row of a key counts, unless it is deleted. Rows need ``org_id`` and
    ``space_id``, by which folders are divided, so a space's filter reads its own files only.
    """

    spark: SparkSession
    path: str

    # --- manifests

    def _file(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path.rstrip("/"), *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """Number of the last commit; 0 before the first."""
        path, files = self._file("commits")
        return max([int(s.getPath().getName()[:-5]) for s in files.listStatus(path) if s.getPath().getName().endswith(".json")], default=0) if files.exists(path) else 0

    def manifest(self, version: int | None = None) -> dict:
        """What a snapshot consists of: folders and columns of each log."""
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "at": None, "logs": {}}
        path, files = self._file("commits", f"{version:012d}.json")
        stream = files.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, before: dict, logs: dict, at: datetime) -> int:
        number = before["version"] + 1
        path, files = self._file("commits", f"{number:012d}.json")
        draft, _ = self._file("drafts", f"{uuid.uuid4().hex}.json")
        out = files.create(draft, False)
        out.write(bytearray(json.dumps({"version": number, "at": at.isoformat(), "logs": logs}).encode()))
        out.close()
        files.mkdirs(path.getParent())
        if files.exists(path) or not files.rename(draft, path):
            files.delete(draft, False)
            raise ConcurrentCommit(f"commit {number} is another writer's")
        return number

    # --- logs

    def _log(self, name: str, manifest: dict) -> DataFrame | None:
        """All rows of a log that a manifest names, with their marks and folder."""
        known = manifest["logs"].get(name)
        if not known or not known["folders"]:
            return None
        schema = StructType.fromJson(json.loads(known["schema"]))
        whole = StructType([*[f for f in schema.fields if f.name not in PARTS], *StructType.fromDDL(_MARKS).fields, *StructType.fromDDL("f string, org_id string, space_id string").fields])
        base = "/".join([self.path.rstrip("/"), name])
        return self.spark.read.schema(whole).option("basePath", base).parquet(*[f"{base}/f={x}" for x in known["folders"]])

    def _write(self, name: str, rows: DataFrame) -> str:
        folder = uuid.uuid4().hex
        rows.write.partitionBy(*PARTS).parquet("/".join([self.path.rstrip("/"), name, f"f={folder}"]))
        return folder

    def _append(self, changes: dict[str, list[DataFrame]], at: datetime) -> int:
        """Writes rows (with ``__op``) and commits them under the next number."""
        before = self.manifest()
        logs = json.loads(json.dumps(before["logs"]))
        for name, tables in changes.items():
            for rows in tables:
                kind = StructType([StructField(f.name, f.dataType) for f in rows.schema.fields if f.name != "__op"])
                marked = rows.withColumns({"__seq": F.lit(before["version"] + 1).cast("long"), "__at": F.lit(at).cast("timestamp"), **{c: F.col(c).cast("string") for c in PARTS}})
                log = logs.setdefault(name, {"folders": [], "schema": kind.json()})
                have = StructType.fromJson(json.loads(log["schema"]))
                log["schema"] = StructType([*have.fields, *[f for f in kind.fields if f.name not in have.names]]).json()
                log["folders"].append(self._write(name, marked))
        return self._commit(before, logs, at)

    def put(self, at: datetime, memories: DataFrame | None = None, edges: DataFrame | None = None) -> int:
        """Adds or replaces memories and edges by key; of several rows of one key the one with the highest version, then any one, counts."""
        put = {n: [t.withColumn("__op", F.lit("put"))] for n, t in (("memories", memories), ("edges", edges)) if t is not None}
        return self._append(put, at)

    def _last(self, name: str, version: int | None) -> DataFrame | None:
        """Last row of each key of a log, deleted ones too; combined where the rows are."""
        log = self._log(name, self.manifest(version))
        if log is None:
            return None
        order = [F.col("__seq"), *([F.col("version")] if "version" in log.columns else []), F.xxhash64(*[c for c in log.columns if "variant" not in log.schema[c].dataType.simpleString() and "map<" not in log.schema[c].dataType.simpleString()])]
        keys = [*PARTS, *KEYS[name]]
        rest = [c for c in log.columns if c not in [*keys, "f"]]
        last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*")
        dropped = self._log("drops", self.manifest(version))
        if dropped is None:
            return last
        gone = dropped.groupBy(*PARTS).agg(F.max("__seq").alias("__gone"))
        return last.join(gone, PARTS, "left").filter("__gone is null or __seq > __gone").drop("__gone")

    def _live(self, name: str, version: int | None) -> DataFrame | None:
        last = self._last(name, version)
        return last if last is None else last.filter("__op = 'put'").drop("__seq", "__at", "__op")

    def memories(self, version: int | None = None) -> DataFrame | None:
        """Memories of a snapshot, the last one if not said otherwise; None before the first write."""
        return self._live("memories", version)

    def edges(self, version: int | None = None) -> DataFrame | None:
        """Relations of a snapshot."""
        return self._live("edges", version)

    # --- removal

    def _without(self, ids: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        """(ids with their space, rows for the edges' log): edges that touch the ids deleted, supersession chains over them bridged."""
        ids = stored(ids.select(*PARTS, "id").distinct())
        held = self.edges()
        if held is None:
            return ids, []
        held = stored(held)
        # the space goes with the ids, so that equal ids of two spaces are not one
        named = lambda c: F.to_json(F.struct(*PARTS, F.col(c).alias("id")))
        inside = held.withColumns({"source_id": named("source_id"), "target_id": named("target_id")})
        removed = ids.select(named("id").alias("id"))
        made = bridge(inside, removed)
        fresh = remove_touching(made, removed)
        kind = held.schema
        back = lambda c: F.from_json(c, StructType([*[kind[p] for p in PARTS], StructField("id", kind["source_id"].dataType)]))
        bridged = fresh.select(*[back("source_id")[p].alias(p) for p in PARTS], back("source_id")["id"].alias("source_id"), back("target_id")["id"].alias("target_id"), "type", "confidence", F.lit("put").alias("__op"))
        touched = held.select(*PARTS, "source_id", "target_id", "type", F.explode(F.array("source_id", "target_id")).alias("id")).join(ids, [*PARTS, "id"], "left_semi").drop("id").distinct()
        return ids, [stored(bridged), touched.withColumn("__op", F.lit("delete"))]

    def delete(self, ids: DataFrame, at: datetime) -> int:
        """Deletes memories (org_id, space_id, id): they are no longer there, their history is; their edges go, supersessions are bridged."""
        ids, edges = self._without(ids)
        return self._append({"memories": [ids.withColumn("__op", F.lit("delete"))], **({"edges": edges} if edges else {})}, at)

    def erase(self, ids: DataFrame, at: datetime) -> dict[str, int]:
        """Removes memories and all that was ever written of them, folders that hold them being written anew; counts of rows that go.

        Earlier manifests still name the former folders; ``vacuum`` removes those.
        """
        ids, edges = self._without(ids)
        if edges:
            self._append({"edges": edges}, at)
        before = self.manifest()
        logs, counts = json.loads(json.dumps(before["logs"])), {}
        for name, columns in (("memories", ["id"]), ("edges", ["source_id", "target_id"])):
            log = self._log(name, before)
            if log is None:
                counts[name] = 0
                continue
            hit = None
            for c in columns:
                touched = log.join(ids.withColumnRenamed("id", c), [*PARTS, c], "left_semi")
                hit = touched if hit is None else hit.unionByName(touched)
            folders = [r[0] for r in hit.select("f").distinct().collect()]  # numbers of folders, not rows
            counts[name] = hit.distinct().count() if folders and "variant" not in hit.schema.simpleString() and "map<" not in hit.schema.simpleString() else hit.count()
            if folders:
                left = log.filter(F.col("f").isin(folders))
                for c in columns:
                    left = left.join(ids.withColumnRenamed("id", c), [*PARTS, c], "left_anti")
                logs[name]["folders"] = [f for f in logs[name]["folders"] if f not in folders] + [self._write(name, left.drop("f"))]
        self._commit(before, logs, at)
        return counts

    def drop_space(self, org_id: str, space_id: str, at: datetime) -> bool:
        """Removes a space's memories and edges from the snapshot, history aside; whether there was one."""
        there = [t.filter((F.col("org_id") == org_id) & (F.col("space_id") == space_id)) for t in (self.memories(), self.edges()) if t is not None]
        if all(t.isEmpty() for t in there):
            return False
        self._append({"drops": [self.spark.createDataFrame([(org_id, space_id, "drop")], "org_id string, space_id string, __op string")]}, at)
        return True

    def vacuum(self, keep: int = 1) -> int:
        """Deletes folders that none of the last ``keep`` snapshots names, and the manifests before these; how many folders."""
        last = self.version()
        kept = {f for v in range(max(1, last - keep + 1), last + 1) for log in self.manifest(v)["logs"].values() for f in log["folders"]}
        gone = 0
        for name in [*KEYS, "drops"]:
            path, files = self._file(name)
            for s in files.listStatus(path) if files.exists(path) else []:
                if s.getPath().getName()[2:] not in kept:
                    files.delete(s.getPath(), True)
                    gone += 1
        for v in range(1, last - keep + 1):
            path, files = self._file("commits", f"{v:012d}.json")
            files.delete(path, False)
        return gone

    # --- history

    def history(self) -> DataFrame | None:
        """Versions of all memories as half-open intervals (valid_from, valid_to), dropped spaces' and deleted ones' too.

        A version's last write counts, from its first time on; a version ends with the next one, or a deletion.
        """
        log = self._log("memories", self.manifest())
        if log is None:
            return None
        keys = [*PARTS, "id"]
        rest = [c for c in log.columns if c not in [*keys, "f", "__seq", "__at", "__op", "version"]]
        one = log.filter("__op = 'put'").groupBy(*keys, "version").agg(F.max_by(F.struct(*rest), "__seq").alias("__r"), F.min("__at").alias("valid_from"), F.max("__seq").alias("__seq"))
        ends = log.filter("__op = 'delete'").select(*keys, F.lit(None).cast(log.schema["version"].dataType).alias("version"), F.lit(None).cast(one.schema["__r"].dataType).alias("__r"), F.col("__at").alias("valid_from"), "__seq")
        drops = self._log("drops", self.manifest())
        if drops is not None:
            spaces = drops.select(*PARTS, F.col("__at").alias("valid_from"), "__seq")
            ends = ends.unionByName(one.select(*keys).distinct().join(spaces, PARTS).select(*keys, F.lit(None).cast(log.schema["version"].dataType).alias("version"), F.lit(None).cast(one.schema["__r"].dataType).alias("__r"), "valid_from", "__seq"))
        order = Window.partitionBy(*keys).orderBy("__seq", "version")
        closed = one.unionByName(ends).withColumn("valid_to", F.lead("valid_from").over(order))
        return closed.filter("version is not null").select(*keys, "version", "__r.*", "valid_from", "valid_to")

    def as_of(self, at: Column) -> DataFrame | None:
        """Memories as they were at a time."""
        found = self.history()
        return found if found is None else as_of(found.withColumn("memory_id", F.to_json(F.struct(*PARTS, "id"))), at).drop("memory_id")
