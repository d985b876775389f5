"""A kept inverted index for BM25: postings bucketed by term, added to by batch, read by the buckets of a search's terms only."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructField, StructType

from ..functions.text import analyze_query, counted_words, folded_text, stem
from ..storage import dropped, shared_base, stored

K1, B = 1.2, 0.75
#: Chunks of a shard (more only if one memory has them), and of a block, for which a posting list knows its maxima.
SHARD_CHUNKS, BLOCK_BITS = 1 << 13, 10
#: Tasks that sort postings, at least, for each shard.
TASKS_EACH = 4
#: Chunks from which a shard's scores are pruned by bounds; queries of one unit of work.
PRUNED_FROM, QUERIES_EACH = 4096, 256
#: Buckets of terms if not said otherwise (a folder each, so large corpora take more), and the number of this layout.
BUCKETS, LAYOUT = 16, 2
#: Scores are rounded before they are ranked, so bounds leave room for that.
ROOM = 1e-5

_LISTS = "offs array<int>, tfs array<int>, lens array<int>, mems array<int>"
POSTINGS = f"term string, shard long, df int, {_LISTS}, blocks array<int>, tops array<int>, lows array<int>, bucket int"


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term) of the distinct analysed terms of each query text."""
    return queries.select("qid", F.explode(F.array_distinct(analyze_query(F.col("text")))).alias("term"))


def _lists(groups: np.ndarray, size: int, *columns: np.ndarray) -> list[pa.Array]:
    """Columns as lists by group number, which ascends."""
    ends = pa.array(np.searchsorted(groups, np.arange(size + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(ends, pa.array(c.astype(np.int32))) for c in columns]


def _flat(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return np.asarray(pc.list_flatten(batch.column(column)))


def _shard_rows(number: int, ids: list[pa.Array], ordinals: list[np.ndarray], counted: list[tuple], schema: pa.Schema):
    """A shard's batches: one row with its chunks, then one for each word."""
    memory, ordinal = pa.concat_arrays(ids), np.concatenate(ordinals)
    length = np.concatenate([c[4] for c in counted])
    first = np.ones(len(memory), bool)
    first[1:] = np.asarray(pc.fill_null(pc.not_equal(memory[1:], memory[:-1]), True))
    mem = np.flatnonzero(first)[np.cumsum(first) - 1]
    code, vocabulary = pd.factorize(np.array([w for c in counted for w in c[0]], object))
    at, word, off, tf, base = 0, [], [], [], 0
    for words, row, which, tfs, lengths in counted:
        word.append(code[at : at + len(words)][which]), off.append(base + row), tf.append(tfs)
        at, base = at + len(words), base + len(lengths)
    word, off, tf = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (word, off, tf))
    order = np.lexsort((off, word))
    word, off, tf = word[order], off[order], tf[order]
    empty = pa.array([None], pa.list_(pa.int32()))
    whole = [pa.array([number]), pa.array([None], pa.string()), *_lists(np.zeros(len(memory), int), 1, np.arange(len(memory)))]
    whole += [empty, *_lists(np.zeros(len(memory), int), 1, length, mem), pa.ListArray.from_arrays(pa.array([0, len(memory)], pa.int32()), memory), *_lists(np.zeros(len(memory), int), 1, ordinal)]
    yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(whole, schema)], schema=schema)
    for lo in range(0, len(vocabulary), 4096):
        hi = min(len(vocabulary), lo + 4096)
        s, e = np.searchsorted(word, [lo, hi])
        part = [pa.array(np.full(hi - lo, number)), pa.array(list(vocabulary[lo:hi]), pa.string()), *_lists(word[s:e] - lo, hi - lo, off[s:e], tf[s:e], length[off[s:e]], mem[off[s:e]])]
        part += [pa.nulls(hi - lo, schema.field("ids").type), pa.nulls(hi - lo, schema.field("ordinals").type)]
        yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(part, schema)], schema=schema)


def _built(chunks: DataFrame, parts: int) -> DataFrame:
    """(shard, word, offs, tfs, lens, mems, ids, ordinals): a row for each word of a shard, and one without a word for its chunks.

    A shard is a run of whole memories in order of id, so places in it are in order of id and ordinal.
    """
    read = chunks.select("memory_id", F.col("ordinal").cast("int").alias("ordinal"), folded_text(F.col("text")).alias("text")).repartition(parts, "memory_id").sortWithinPartitions("memory_id", "ordinal")
    made = StructType([*StructType.fromDDL(f"shard long, word string, {_LISTS}").fields, StructField("ids", ArrayType(read.schema["memory_id"].dataType)), StructField("ordinals", StructType.fromDDL("x array<int>")["x"].dataType)])
    arrow = to_arrow_schema(made)

    def run(batches):
        pid, number = TaskContext.get().partitionId(), 0
        ids, ordinals, counted, size = [], [], [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                end = min(batch.num_rows, at + max(1, SHARD_CHUNKS - size))
                if size >= SHARD_CHUNKS:  # full: it ends where the memory does
                    same = pc.fill_null(pc.equal(batch.column(0)[at:], ids[-1][-1]), False).to_numpy(zero_copy_only=False)
                    end = at + (int(np.argmin(same)) if not same.all() else len(same))
                    if end == at:
                        yield from _shard_rows(pid << 20 | number, ids, ordinals, counted, arrow)
                        ids, ordinals, counted, size, number = [], [], [], 0, number + 1
                        continue
                part = batch.slice(at, end - at)
                ids.append(part.column(0)), ordinals.append(np.asarray(part.column(1)))
                counted.extend(counted_words(part.column(2)))
                size, at = size + part.num_rows, end
        if size:
            yield from _shard_rows(pid << 20 | number, ids, ordinals, counted, arrow)

    return read.mapInArrow(run, made)


def _merged(batch: pa.RecordBatch, arrow: pa.Schema) -> pa.RecordBatch:
    """Rows of one term and shard, which lie side by side, as one, with their blocks' maxima."""
    term, shard = batch.column("term"), np.asarray(batch.column("shard"))
    fresh = np.ones(batch.num_rows, bool)
    fresh[1:] = np.asarray(pc.not_equal(term[1:], term[:-1])) | (shard[1:] != shard[:-1])
    group = np.repeat(np.cumsum(fresh) - 1, np.asarray(pc.list_value_length(batch.column("offs"))))
    off, tf, length, mem = (_flat(batch, c).astype(np.int64) for c in ("offs", "tfs", "lens", "mems"))
    order = np.lexsort((off, group))
    group, off, tf, length, mem = (x[order] for x in (group, off, tf, length, mem))
    start = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (off[1:] != off[:-1])]) if len(off) else [])
    tf = np.add.reduceat(tf, start) if len(start) else tf
    group, off, length, mem = (x[start] for x in (group, off, length, mem))
    block = off >> BLOCK_BITS
    cut = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (block[1:] != block[:-1])]) if len(off) else [])
    top, low = (np.maximum.reduceat(tf, cut), np.minimum.reduceat(length, cut)) if len(cut) else (tf, length)
    rows = pa.array(np.flatnonzero(fresh))
    size = len(rows)
    out = [term.take(rows), batch.column("shard").take(rows), pa.array(np.bincount(group, minlength=size)), *_lists(group, size, off, tf, length, mem), *_lists(group[cut], size, block[cut], top, low), batch.column("bucket").take(rows)]
    return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(out, arrow)], schema=arrow)


def _merge_rows(rows: DataFrame) -> DataFrame:
    made = StructType.fromDDL(POSTINGS)
    arrow = to_arrow_schema(made)

    def run(batches):
        held = None
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            shard = np.asarray(batch.column("shard"))
            same = np.asarray(pc.equal(batch.column("term"), batch.column("term")[batch.num_rows - 1])) & (shard == shard[-1])
            last = int(np.argmax(same))
            if last:
                yield _merged(batch.slice(0, last), arrow)
            held = batch.slice(last)
        if held is not None:
            yield _merged(held, arrow)

    return rows.mapInArrow(run, made)


def impact(tf: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    """What a term adds for each unit of its rarity; more with ``tf``, less with ``length``."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def best_of_shard(wanted: list[int], terms: list[tuple], idf: np.ndarray, mean: float, k: int, digits: int, mem: np.ndarray, passing: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and rounded scores of the ``k`` best memories for one query's terms in a shard.

    Terms with the highest bounds go first. Once the bounds of those left cannot lift a chunk over the k-th best memory
    so far, only chunks that the bounds of their own blocks may still lift are looked up in them.
    """
    size = len(mem)
    total = np.zeros(size)
    bound = np.array([idf[t] * impact(terms[t][5], terms[t][6], mean).max() for t in wanted])
    wanted, bound = [wanted[i] for i in np.argsort(-bound, kind="stable")], np.sort(bound)[::-1]
    rest = np.append(np.cumsum(bound[::-1])[::-1], 0.0)
    start = np.flatnonzero(np.concatenate([[True], mem[1:] != mem[:-1]]))
    some = None
    for i, t in enumerate(wanted):
        offs, value = terms[t][0], terms[t][3]
        if some is None and size >= PRUNED_FROM and i and i & (i - 1) == 0:
            best = np.maximum.reduceat(np.where(passing, total, 0.0) if passing is not None else total, start)
            least = np.partition(best, len(best) - k)[len(best) - k] if k < len(best) else 0.0
            if least > rest[i] + ROOM:
                room = np.zeros((size >> BLOCK_BITS) + 1)
                for u in wanted[i:]:
                    room[terms[u][4]] += idf[u] * impact(terms[u][5], terms[u][6], mean)
                some = np.flatnonzero(total + room[np.arange(size) >> BLOCK_BITS] >= least - ROOM)
        if some is None:
            total[offs] += idf[t] * value
        else:
            at = np.minimum(np.searchsorted(offs, some), len(offs) - 1)
            hit = offs[at] == some
            total[some[hit]] += idf[t] * value[at[hit]]
    if passing is not None:
        total = np.where(passing, total, 0.0)
    at = np.flatnonzero(total > 0) if some is None else some[total[some] > 0]
    score = np.round(total[at], digits)
    at, score = at[score > 0], score[score > 0]
    by_memory = np.lexsort((at, -score, mem[at]))
    at, score = at[by_memory], score[by_memory]
    one = np.concatenate([[True], mem[at][1:] != mem[at][:-1]]) if len(at) else np.zeros(0, bool)
    at, score = at[one], score[one]
    first = np.lexsort((at, -score))[:k]
    return at[first], score[first]


@dataclass(frozen=True)
class LexicalIndex:
    """Postings of chunks (memory_id, ordinal, text) under a folder that driver and executors share.

    A batch is there once its mark is written, after all its files; a search reads the batches that are marked when it
    begins. All who open an index give the number of buckets that it was made with. A memory that is added again counts as added last; what it was before is written down as dead, and so are
    removed ones. Counts are those of the living.
    """

    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def _file(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path.rstrip("/"), *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def batches(self) -> list[str]:
        """Names of the batches in order of their marks."""
        path, files = self._file("marks")
        return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []

    def _commit(self, name: str) -> None:
        path, files = self._file("marks", name)
        files.create(path, False).close()

    def _table(self, kind: str, schema: str | StructType | None = None) -> DataFrame | None:
        found = []
        for name in self.batches():
            path, files = self._file(kind, name)
            if files.exists(path):
                found.append(path.toString())
        if not found:
            return None
        read = self.spark.read.option("basePath", "/".join([self.path.rstrip("/"), kind]))
        return (read.schema(schema) if schema else read).parquet(*found)

    def chunks(self) -> DataFrame:
        """(shard, off, memory_id, ordinal, length, batch) of all chunks, dead ones too."""
        return self._table("chunks")

    def dead(self) -> DataFrame | None:
        """(batch, shard, off) of chunks that no search counts."""
        found = self._table("dead", "of string, shard long, off int, batch string")
        return found if found is None else found.select(F.col("of").alias("batch"), "shard", "off")

    def postings(self) -> DataFrame:
        return self._table("postings", StructType([*StructType.fromDDL(POSTINGS).fields[:-1], *StructType.fromDDL("batch string, bucket int").fields]))

    def add(self, chunks: DataFrame) -> str:
        """Indexes a batch of chunks and marks it; memories in it that are known replace what was known of them."""
        known = self.batches()
        name = f"batch={len(known):06d}-{uuid.uuid4().hex[:8]}"
        rows = chunks.count()
        cores = self.spark.sparkContext.defaultParallelism
        parts = max(-(-rows // SHARD_CHUNKS), min(cores, -(-rows // 512)), 1)
        built = stored(_built(chunks, parts))
        whole = built.filter("word is null").select("shard", F.col("offs").alias("off"), F.col("ids").alias("memory_id"), F.col("ordinals").alias("ordinal"), F.col("lens").alias("length"))
        whole.select("shard", F.inline(F.arrays_zip("off", "memory_id", "ordinal", "length"))).write.parquet(f"{self.path}/chunks/{name}")
        termed = built.filter("word is not null").select(stem(F.col("word")).alias("term"), "shard", "offs", "tfs", "lens", "mems")
        termed = termed.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"))
        # a bucket's shards are dealt to as many tasks as the batch is large, so none sorts more of a larger batch
        tasks = max(min(self.buckets, 4 * cores), TASKS_EACH * parts)
        pieces = -(-tasks // self.buckets)
        task = F.col("bucket") * pieces + F.pmod(F.shiftright("shard", 20), F.lit(pieces)).cast("int")
        ordered = termed.repartitionById(tasks if pieces == 1 else self.buckets * pieces, task).sortWithinPartitions("bucket", "term", "shard")
        _merge_rows(ordered).write.partitionBy("bucket").parquet(f"{self.path}/postings/{name}")
        dropped(built)
        if known:
            self._bury(chunks.select("memory_id").distinct(), name)
        self._commit(name)
        return name

    def remove(self, memories: DataFrame) -> str:
        """Marks memories (memory_id) as dead."""
        name = f"batch={len(self.batches()):06d}-{uuid.uuid4().hex[:8]}"
        self._bury(memories.select("memory_id").distinct(), name)
        self._commit(name)
        return name

    def _bury(self, memories: DataFrame, name: str) -> None:
        known = self.chunks()
        if known is None:
            return
        dead = self.dead()
        if dead is not None:
            known = known.withColumn("batch", F.col("batch").cast("string")).join(dead, ["batch", "shard", "off"], "left_anti")
        known.join(memories, "memory_id", "left_semi").select(F.col("batch").cast("string").alias("of"), "shard", "off").write.parquet(f"{self.path}/dead/{name}")

    def living(self, within: DataFrame | None = None) -> DataFrame | None:
        """Chunks that count, with those of ``within`` (memory_id) only; None where all do."""
        dead = self.dead()
        if dead is None and within is None:
            return None
        live = self.chunks().withColumn("batch", F.col("batch").cast("string"))
        if dead is not None:
            live = live.join(dead, ["batch", "shard", "off"], "left_anti")
        return live if within is None else live.join(within.select("memory_id").distinct(), "memory_id", "left_semi")

    def _wanted(self, terms: DataFrame) -> DataFrame:
        """Postings of terms: of their buckets only, whose numbers are all that passes the driver."""
        numbers = [r[0] for r in terms.select(F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")).distinct().collect()]
        return self.postings().withColumn("batch", F.col("batch").cast("string")).filter(F.col("bucket").isin(numbers) if numbers else F.lit(False))

    def search(self, queries: DataFrame, k: int, within: DataFrame | None = None, digits: int = 6) -> DataFrame:
        """(qid, memory_id, score, ordinal, rank) of the ``k`` best memories of each query (qid, text); any term may match.

        Number of chunks, mean length and document frequencies are those of the living chunks in ``within``. Only the
        buckets of the queries' terms are read. Queries are dealt in units of some QUERIES_EACH, postings meet them by
        term; a unit and a shard are one task's work, which passes on ``k`` memories a query.
        """
        kind = queries.schema["qid"].dataType
        out = StructType([StructField("qid", kind), *StructType.fromDDL("batch string, shard long, off int, score double").fields])
        asked = stored(query_terms(queries).filter("qid is not null"))
        units = max(1, -(-asked.select("qid").distinct().count() // QUERIES_EACH))
        dealt = asked.groupBy(F.pmod(F.xxhash64("qid"), F.lit(units)).alias("unit"), "term").agg(F.collect_set("qid").alias("qids"))
        if not self.batches() or self.chunks() is None:
            return self.spark.createDataFrame([], StructType([StructField("qid", kind), *StructType.fromDDL("memory_id long, score double, ordinal int, rank int").fields]))
        postings = self._wanted(asked)
        live = self.living(within)
        place = ["batch", "shard"]
        met = stored(postings.join(asked.select("term").distinct(), "term", "left_semi"))
        if live is None:
            stats = self.chunks().agg(F.count("*"), F.avg("length")).first()
            df = met.groupBy("term").agg(F.sum("df").alias("df"))
            sets = None
        else:
            sets = stored(live.groupBy(*place).agg(F.array_sort(F.collect_list("off")).alias("there"), F.count("*").alias("n"), F.sum("length").alias("words")))
            stats = sets.agg(F.coalesce(F.sum("n"), F.lit(0)), F.sum("words") / F.sum("n")).first()
            df = met.select(*place, "term", "offs").groupBy(*place).cogroup(sets.select(*place, "there").groupBy(*place)).applyInArrow(_frequencies, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
        n, mean = float(stats[0]), float(stats[1] or 0.0) or 1.0
        rarity = df.filter("df > 0").select("term", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
        units_of = met.drop("bucket", "df").join(dealt.join(rarity, "term"), "term")
        arrow = to_arrow_schema(out)

        def scored(rows: pa.Table, there: pa.Table | None = None) -> pa.Table:
            if not rows.num_rows or (there is not None and not there.num_rows):
                return arrow.empty_table()
            size = 1 + max(int(pc.max(pc.list_flatten(rows.column("offs"))).as_py()), int(pc.max(pc.list_flatten(there.column("there"))).as_py()) if there is not None else 0)
            mem, passing = np.full(size, -1), None
            if there is not None:
                passing = np.zeros(size, bool)
                passing[np.asarray(pc.list_flatten(there.column("there")))] = True
            terms, asked_by = [], {}
            lists = {c: rows.column(c).combine_chunks() for c in ("offs", "tfs", "lens", "mems", "blocks", "tops", "lows", "qids")}
            for t in range(rows.num_rows):
                offs, tfs, lens, mems, blocks, tops, lows = (lists[c][t].values.to_numpy() for c in ("offs", "tfs", "lens", "mems", "blocks", "tops", "lows"))
                mem[offs] = mems
                terms.append((offs, tfs, lens, impact(tfs, lens, mean), blocks, tops, lows))
                for q in lists["qids"][t].values.to_pylist():
                    asked_by.setdefault(q, []).append(t)
            idf = rows.column("idf").to_numpy()
            mem = np.maximum(np.maximum.accumulate(mem), 0)  # chunks without any of the terms, which score 0
            parts = []
            for q, wanted in asked_by.items():
                at, score = best_of_shard(wanted, terms, idf, mean, k, digits, mem, passing)
                parts.append((q, at, score))
            qids = pa.array([q for q, at, _ in parts for _ in range(len(at))], arrow.field("qid").type)
            at, score = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
            return pa.Table.from_arrays([qids, pa.array([rows.column("batch")[0].as_py()] * len(at), pa.string()), pa.array([rows.column("shard")[0].as_py()] * len(at), pa.int64()), pa.array(at.astype(np.int32)), pa.array(score)], schema=arrow)

        keys = ["unit", *place]
        if sets is None:
            best = units_of.groupBy(*keys).applyInArrow(lambda rows: scored(rows), out)
        else:
            beside = sets.select(*place, "there", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(units - 1).cast("long"))).alias("unit"))
            best = units_of.groupBy(*keys).cogroup(beside.groupBy(*keys)).applyInArrow(scored, out)
        rank = F.rank().over(Window.partitionBy("qid").orderBy(F.col("score").desc()))
        first = stored(best.withColumn("__r", rank).filter(F.col("__r") <= k).drop("__r"))
        chunks = self.chunks().select(F.col("batch").cast("string").alias("batch"), "shard", "off", "memory_id", "ordinal")
        named = first.join(chunks, ["batch", "shard", "off"]).select("qid", "memory_id", "score", "ordinal")
        place_of = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "memory_id"))
        return named.withColumn("rank", place_of).filter(F.col("rank") <= k)

    def term_counts(self, pool: DataFrame, terms: DataFrame) -> DataFrame:
        """(memory_id, ordinal, term, tf) of terms (term) in the chunks of ``pool`` (memory_id, ordinal), and of each chunk a row with its length and no term."""
        chunks = self.living(pool.select("memory_id")).select("batch", "shard", "off", "memory_id", "ordinal", "length")
        members = stored(chunks.join(pool.select("memory_id", F.col("ordinal").cast("int").alias("ordinal")).distinct(), ["memory_id", "ordinal"], "left_semi"))
        words = self._wanted(terms).join(terms.select("term").distinct(), "term", "left_semi").select("batch", "shard", "term", "offs", "tfs")

        def found(rows: pa.Table, there: pa.Table) -> pa.Table:
            off = there.column("off").to_numpy()
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
            offs, tfs = (rows.column(c).combine_chunks() for c in ("offs", "tfs"))
            for t in range(rows.num_rows if len(off) else 0):
                mine = offs[t].values.to_numpy()
                at = np.minimum(np.searchsorted(mine, off), len(mine) - 1)
                hit = np.flatnonzero(mine[at] == off)
                out.append((np.full(len(hit), t), hit, tfs[t].values.to_numpy()[at[hit]]))
            t, i, tf = (np.concatenate(x) for x in zip(*out))
            return pa.table({"memory_id": there.column("memory_id").take(pa.array(i)), "ordinal": there.column("ordinal").take(pa.array(i)), "term": rows.column("term").take(pa.array(t)), "tf": pa.array(tf.astype(np.int32))})

        kind = StructType([members.schema["memory_id"], *StructType.fromDDL("ordinal int, term string, tf int").fields])
        counts = words.groupBy("batch", "shard").cogroup(members.groupBy("batch", "shard")).applyInArrow(found, kind)
        return counts.unionByName(members.select("memory_id", "ordinal", F.lit(None).cast("string").alias("term"), F.col("length").cast("int").alias("tf")))


def _frequencies(rows: pa.Table, there: pa.Table) -> pa.Table:
    """(term, df) of a shard's terms among the chunks that count."""
    inside = np.asarray(pc.list_flatten(there.column("there"))) if there.num_rows else np.zeros(0, np.int64)
    size = 1 + int(inside.max(initial=0))
    passing = np.zeros(size, bool)
    passing[inside] = True
    offs = pc.list_flatten(rows.column("offs")).to_numpy() if rows.num_rows else np.zeros(0, np.int64)
    row = np.repeat(np.arange(rows.num_rows), pc.list_value_length(rows.column("offs")).to_numpy()) if rows.num_rows else offs
    known = offs < size
    df = np.bincount(row[known][passing[offs[known]]], minlength=rows.num_rows)
    return pa.table({"term": rows.column("term"), "df": pa.array(df.astype(np.int64), pa.int64())})


def temporary_index(chunks: DataFrame, buckets: int = BUCKETS) -> LexicalIndex:
    """An index of chunks for one search, in the shared folder."""
    index = LexicalIndex(chunks.sparkSession, f"{shared_base(chunks.sparkSession)}/index-{uuid.uuid4().hex}", buckets)
    path, files = index._file()
    files.deleteOnExit(path)
    index.add(chunks)
    return index


def kept_index(chunks: DataFrame, buckets: int = BUCKETS) -> LexicalIndex:
    """The index of chunks that are read from files, made at the first call and used again while the files are the same ones."""
    spark = chunks.sparkSession
    name = hashlib.md5(f"{LAYOUT} {buckets} {chunks.columns}".encode())
    for file in sorted(chunks.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        name.update(f"{file} {found.getLen()} {found.getModificationTime()}".encode())
    index = LexicalIndex(spark, f"{shared_base(spark)}/kept-{name.hexdigest()}", buckets)
    path, files = index._file()
    # a former session's removal of its tables may have been cut short: what is not there as a whole is made anew
    if not all(files.exists(index._file(kind, name, "_SUCCESS")[0]) for name in index.batches() for kind in ("chunks", "postings")):
        files.delete(path, True)
    if not index.batches():
        files.deleteOnExit(path)
        index.add(chunks)
    return index
