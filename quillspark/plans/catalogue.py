"""Queries of the engine over the driver's tables, one for each operator or family of operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.chunking import chunk_memories
from ..functions.embed import embed, hash_embedder
from ..functions.entities import entities
from ..functions.questions import date_windows, question_kind
from ..functions.text import content_hash, stem, token_estimate, tokens, word_counts
from ..operators import consolidate as C
from ..operators import filters as P
from ..operators import graph as G
from ..operators import history as H
from ..operators import ranking as R
from ..operators import retrieval as S
from ..operators import synth as Y
from ..operators.lexical_index import LexicalIndex, kept_index, temporary_index
from ..operators.vector_index import VectorIndex
from ..sources import fixtures as X
from ..sources.log_store import SpaceStore
from ..storage import shared_base, stored
from .search import SearchOptions, hybrid_arms, search

UTC = timezone.utc


def _text(column: str) -> Column:
    """Timestamps as text, the same in every engine."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def _by_vector(spark: SparkSession, sf: str, k: int) -> DataFrame:
    vectors = X.chunks_vec(spark, sf)
    asked = vectors.filter("memory_id % 50 = 0").select(F.col("memory_id").alias("qid"), "embedding")
    return S.vector_search(vectors, asked, k)


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages as questions, each with the vector of its number."""
    b, v = X.table(spark, sf, "benchmark"), X.table(spark, sf, "embeddings")
    return b.join(v, b["item_id"] == v["vec_id"], "left").select(F.col("item_id").alias("qid"), "text", "embedding")


def _chunks(memories: DataFrame) -> DataFrame:
    return memories.select(F.col("id").alias("memory_id"), F.lit(0).alias("ordinal"), F.col("content").alias("text"))


def _index(spark: SparkSession, sf: str) -> LexicalIndex:
    """The kept index of all text memories."""
    return kept_index(_chunks(X.memories_text(spark, sf)))


def filter_memories(spark, sf):
    wanted = P.MemoryFilter(frozenset({"active", "stale"}), frozenset({"episodic"}), frozenset({"quality"}), (("quality", 1),), datetime(2024, 1, 3, tzinfo=UTC), datetime(2024, 12, 31, tzinfo=UTC))
    return X.memories_text(spark, sf).filter(wanted.column()).select("id", "space_id", "status", "kind", "source", _text("occurred_at").alias("occurred_at"))


def typed_metadata(spark, sf):
    """Fields of a JSON object by value and type: a number, a text, a boolean and a field that is not there."""
    held = F.to_json(F.struct("quality", F.col("space_id").alias("lang"), (F.length("content") > 1000).alias("long"), F.col("quality").cast("string").alias("said")))
    rows = X.memories_text(spark, sf).select("id", "status", F.parse_json(held).alias("metadata"))
    fields = lambda *pairs: P.MemoryFilter(frozenset(), metadata=pairs, in_variant=True).column()
    asked = [("all", (("quality", 1), ("lang", "en"), ("long", True), ("none", None))), ("text", (("said", "1"), ("quality", None))), ("number", (("said", 1),)), ("said", (("said", "1"),)), ("boolean", (("long", 1),)), ("absent", (("quality", None), ("long", False)))]
    return rows.select("id", *[fields(*pairs).alias(f"is_{name}") for name, pairs in asked])


def limited_closure(spark, sf):
    return G.limited_closure(X.edges(spark, sf), _roots(spark, sf), 5, 3)


def tenant_usage(spark, sf):
    return P.tenant_usage(X.memories_text(spark, sf), F.lit(datetime(2024, 1, 15, tzinfo=UTC)), ["org_id", "space_id"])


def quota_flags(spark, sf):
    usage = P.tenant_usage(X.memories_text(spark, sf), F.lit(datetime(2024, 1, 15, tzinfo=UTC)), ["source"])
    return P.quota_flags(usage, 50, 100_000, 30, 1_000).select("source", "over_memories", "over_bytes", "over_recent")


def keyset_page(spark, sf):
    return P.keyset_page(X.memories_text(spark, sf).filter("status = 'active'").select("id", "space_id", "source"), 25, P.encode_cursor(100))


def exact_dedupe(spark, sf):
    return C.exact_duplicates(X.memories_text(spark, sf), ["space_id"])


def merge_duplicates(spark, sf):
    merged = C.merge_duplicates(X.memories_text(spark, sf), ["space_id"])
    return merged.select("space_id", "content_sha256", "id", _text("occurred_at").alias("occurred_at"), "source", "version", F.array_join("tags", ",").alias("tags"))


def token_counts(spark, sf):
    t = X.table(spark, sf, "documents").select("doc_id", tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


def analyzed_terms(spark, sf):
    words = word_counts(X.table(spark, sf, "documents"), ["doc_id"], "text").select("doc_id", F.inline(F.arrays_zip("words", "tfs")))
    per = words.select("doc_id", F.col("tfs").alias("n"), stem(F.col("words")).alias("term")).groupBy("term", "doc_id").agg(F.sum("n").alias("n"))
    return per.groupBy("term").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))


def token_estimates(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", token_estimate(F.col("text")).alias("tokens"), content_hash(F.col("text")).alias("sha"))


def _passages(spark, sf):
    return X.table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")


def bm25_topk(spark, sf):
    return _index(spark, sf).search(_passages(spark, sf), 10).select("qid", "memory_id", "score", "rank")


def bm25_filtered_topk(spark, sf):
    rows = X.memories_text(spark, sf).filter(P.MemoryFilter(kinds=frozenset({"episodic"})).column() & (F.col("space_id") == "en"))
    return _index(spark, sf).search(_passages(spark, sf), 10, within=rows.select(F.col("id").alias("memory_id"))).select("qid", "memory_id", "score", "rank")


def bm25_added_batch(spark, sf):
    """An index in two batches: of three memories one comes with the second, one is replaced by it; a fourth kind is removed."""
    chunks = _chunks(X.memories_text(spark, sf))
    first = chunks.filter("memory_id % 3 > 0").withColumn("text", F.when(F.col("memory_id") % 3 == 1, F.reverse("text")).otherwise(F.col("text")))
    odd = chunks.filter("memory_id % 7 = 0").select((-F.col("memory_id") - 1).alias("memory_id"), "ordinal", "text")
    index = temporary_index(first.unionByName(odd))
    index.add(chunks.filter("memory_id % 3 < 2"))
    index.remove(odd)
    return index.search(_passages(spark, sf), 10).select("qid", "memory_id", "score", "rank")


def vector_topk(spark, sf):
    vectors = X.chunks_vec(spark, sf)
    return S.vector_search(vectors, vectors.filter("memory_id = 0").select(F.lit(0).alias("qid"), "embedding"), 60).select("memory_id", "score", "rank")


def vector_topk_batch(spark, sf):
    return _by_vector(spark, sf, 10).select("qid", "memory_id", "score", "rank")


def vector_index_topk(spark, sf):
    """Active memories nearest to every 50th vector, by a kept index that widens its probes until the audit finds all."""
    vectors = X.chunks_vec(spark, sf)
    live = X.memories_text(spark, sf).filter("status = 'active'").select(F.col("id").alias("memory_id"))
    asked = vectors.filter("memory_id % 50 = 0").select(F.col("memory_id").alias("qid"), "embedding")
    return VectorIndex.build(vectors).search(asked, 10, within=live, recall=1.0)[0].select("qid", "memory_id", "score", "rank")


def best_chunk_per_memory(spark, sf):
    chunks = X.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("memory_id"), F.col("l_linenumber").alias("ordinal"), F.col("l_extendedprice").alias("score"))
    return S.best_chunk(chunks, query=None)


def hybrid_topk(spark, sf):
    memories = X.memories_text(spark, sf)
    return search(memories, _chunks(memories), X.chunks_vec(spark, sf), _questions(spark, sf), SearchOptions(limit=10, use_decay=False), index=_index(spark, sf)).select("qid", "memory_id", "score", "rank", "source")


def _arms(spark, sf):
    live = X.memories_text(spark, sf).filter("status = 'active'")
    return hybrid_arms(live, _chunks(live), X.chunks_vec(spark, sf), _questions(spark, sf), 60, _index(spark, sf))


def weighted_fusion(spark, sf):
    vector, lexical = _arms(spark, sf)
    return R.score_fusion({"vector": (vector, 1.0), "lexical": (lexical, 1.0)}).filter("rank <= 20").select("qid", "memory_id", "score", "rank")


def heuristic_rerank(spark, sf):
    _, lexical = _arms(spark, sf)
    texts = _chunks(X.memories_text(spark, sf)).select("memory_id", "text")
    pool = lexical.filter("rank <= 32").join(texts, "memory_id").select("qid", "memory_id", "ordinal", "score", "text")
    return R.heuristic_rerank(stored(pool), _questions(spark, sf), index=_index(spark, sf)).select("qid", "memory_id", "prior", "score", "rank")


def recency_decay(spark, sf):
    rows = X.memories_order(spark, sf).select(F.col("space_id").alias("qid"), F.col("id").alias("memory_id"), F.lit(1.0).alias("score"), "occurred_at")
    return R.apply_decay(rows, F.lit(datetime(2001, 8, 2, tzinfo=UTC)), wide=True).select("qid", "memory_id", "recency", "score", "rank")


def access_boost(spark, sf):
    return X.table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", "n", F.round(R.access_factor(F.col("n")), 6).alias("factor"))


_WINDOWS = [("spring", "1996-03-01", "1996-05-31"), ("day", "1998-07-15", "1998-07-15"), ("tail", "2001-01-01", "2001-12-31")]


def temporal_boost(spark, sf):
    windows = F.explode(F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).cast("date").alias("start"), F.lit(c).cast("date").alias("end")) for a, b, c in _WINDOWS])).alias("w")
    rows = X.memories_order(spark, sf).select("id", F.to_date("occurred_at").alias("day"), windows)
    return rows.select("id", F.col("w.label").alias("label"), R.scope_factor(F.col("day"), F.col("w.start"), F.col("w.end")).alias("factor"))


def _scored(spark, sf, qid: Column) -> DataFrame:
    docs = X.table(spark, sf, "documents").select("doc_id", "n_chars")
    return X.memories_text(spark, sf).join(docs, F.col("id") == F.col("doc_id")).select(qid.alias("qid"), F.col("id").alias("memory_id"), F.col("n_chars").cast("double").alias("score"), "source", "kind")


def source_cap(spark, sf):
    return R.source_cap(_scored(spark, sf, F.col("space_id")), 3).select("qid", "memory_id", "source")


def kind_allocation(spark, sf):
    return R.kind_allocation(_scored(spark, sf, F.col("space_id")), 10, "compare").select("qid", "memory_id", "kind", "rank")


def evidence_budget(spark, sf):
    return R.evidence_budget(_by_vector(spark, sf, 20), 0.8, 2).select("qid", "memory_id", "rank")


def mmr_topk(spark, sf):
    vectors = X.chunks_vec(spark, sf).select("memory_id", "embedding")
    return R.mmr(_by_vector(spark, sf, 60).join(vectors, "memory_id"), 10)


def confidence_grade(spark, sf):
    return R.confidence(_by_vector(spark, sf, 10).filter("memory_id <> qid").withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))))


def _results(spark, sf):
    return X.memories_order(spark, sf).select(F.col("space_id").alias("qid"), F.col("id").alias("memory_id"), "status")


def conflict_pairs(spark, sf):
    return R.conflict_pairs(_results(spark, sf), X.edges(spark, sf))


def suppress_superseded(spark, sf):
    return G.suppress_superseded(_results(spark, sf), X.edges(spark, sf)).select("qid", "memory_id")


def _roots(spark, sf):
    return X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("root"))


def lineage_head(spark, sf):
    return G.lineage_heads(X.edges(spark, sf), _roots(spark, sf))


def reachable_superseders(spark, sf):
    return G.reachable_superseders(X.edges(spark, sf), _roots(spark, sf))


def bridge_on_delete(spark, sf):
    gone = X.memories_order(spark, sf).filter("tag = '1-URGENT'").select("id")
    return G.bridge(X.edges(spark, sf), gone).select("source_id", "target_id", F.round("confidence", 6).alias("confidence"))


def stale_propagation(spark, sf):
    m = X.memories_order(spark, sf)
    return G.stale_after(m, X.edges(spark, sf), m.filter("status = 'superseded'").select("id"))


def dependency_closure(spark, sf):
    return G.dependency_closure(X.edges(spark, sf), _roots(spark, sf), 2)


def graph_profile(spark, sf):
    return G.graph_profile(X.memories_order(spark, sf), X.edges(spark, sf))


def node_degrees(spark, sf):
    return G.degrees(X.edges(spark, sf))


def as_of_snapshot(spark, sf):
    return H.as_of(X.versions(spark, sf), F.lit(datetime(2024, 1, 15, tzinfo=UTC))).select("memory_id", "version", "content", _text("valid_from").alias("valid_from"), _text("valid_to").alias("valid_to"))


def as_of_join(spark, sf):
    asked = X.table(spark, sf, "events").select(F.col("event_id").alias("qid"), F.col("user_id").alias("memory_id"), (F.col("ts").cast("timestamp") - F.expr("interval 1 hour")).alias("at"))
    return H.as_of_each(X.versions(spark, sf), asked).select("qid", "memory_id", "version")


def scd2_history(spark, sf):
    v = X.versions(spark, sf).select("memory_id", F.ceil(F.col("version") / 2).cast("int").alias("version"), F.col("valid_from").alias("at"), F.col("version").alias("seq"), "content")
    return H.scd2(v).select("memory_id", "version", "content", _text("valid_from").alias("valid_from"), _text("valid_to").alias("valid_to"))


def _logged(spark, sf) -> SpaceStore:
    """A log of the text memories: all written, some again as a new version or in place, some deleted, some erased."""
    base = f"{shared_base(spark)}/log-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    log, day = SpaceStore(spark, base), lambda d: datetime(2025, 1, d, tzinfo=UTC)
    m = X.memories_text(spark, sf).select("org_id", "space_id", "id", "status", F.lit(1).alias("version"), F.md5("content").alias("content"))
    log.put(day(1), m)
    log.put(day(2), m.filter("id % 3 = 0").withColumns({"version": F.lit(2), "status": F.lit("stale"), "content": F.lit("second")}))
    log.put(day(3), m.filter("id % 6 = 0").withColumns({"version": F.lit(2), "status": F.lit("active"), "content": F.lit("third")}))
    log.delete(m.filter("id % 5 = 0"), day(4))
    log.put(day(5), m.filter("id % 10 = 0").withColumns({"version": F.lit(3), "content": F.lit("fifth")}))
    log.erase(m.filter("id % 7 = 0"), day(6))
    return log


def logged_history(spark, sf):
    h = _logged(spark, sf).history()
    return h.select("space_id", "id", "version", "status", "content", _text("valid_from").alias("valid_from"), _text("valid_to").alias("valid_to"))


def logged_snapshots(spark, sf):
    """Memories of the log's last snapshot, and of that of its second commit, which is before deletions."""
    log = _logged(spark, sf)
    rows = lambda v: log.memories(v).select(F.lit(v or 0).alias("snapshot"), "space_id", "id", "version", "content")
    return rows(None).unionByName(rows(2))


def erase_report(spark, sf):
    m = X.memories_order(spark, sf)
    return H.erase_report(X.versions(spark, sf), X.edges(spark, sf), m, m.filter("tag = '1-URGENT'").select("id"))


def _vectors(spark, sf):
    return X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _pairs(spark, sf, low, high):
    """Pairs of every 50th vector with all."""
    v = _vectors(spark, sf)
    return C.similar_pairs(v.filter("id % 50 = 0"), v, low, high)


def near_duplicate_pairs(spark, sf):
    return C.near_duplicates(_pairs(spark, sf, 0.25, None)).select("new_id", "old_id", C.rounded(F.col("sim")).alias("sim"))


def supersession_proposals(spark, sf):
    """Every memory with every older one that it may replace."""
    v = _vectors(spark, sf)
    return C.vector_supersessions(v, v, X.memories_text(spark, sf), 0.1, 0.97).select("new_id", "old_id", C.rounded(F.col("sim")).alias("sim"), "confidence")


def contradiction_proposals(spark, sf):
    v = _vectors(spark, sf)
    return C.vector_contradictions(v.filter("id % 50 = 0"), v, X.memories_text(spark, sf), 0.1, 0.97).select("left_id", "right_id", C.rounded(F.col("sim")).alias("sim"), "polarity", "figures", "confidence")


def unexplained_pairs(spark, sf):
    v = _vectors(spark, sf)
    return C.vector_unexplained(v.filter("id % 50 = 0"), v, X.memories_text(spark, sf), 0.1, 0.97).select("new_id", "old_id", C.rounded(F.col("sim")).alias("sim"))


def association_edges(spark, sf):
    v, named = _vectors(spark, sf), lambda rows: entities(rows, "content")
    return C.vector_associations(v.filter("id % 50 = 0"), v, X.memories_text(spark, sf), named, low=0.1, tag_low=0.1).select("left_id", "right_id", C.rounded(F.col("sim")).alias("sim"), "weight", "confidence")


#: What is planted by id: text before and after the content, and how much of the reversed vector is added.
PLANTED_TEXTS = [("", ""), ("No longer: ", ""), ("", " 42"), ("not ", "")]
PLANTED_TURNS = [0.0, 0.1, 0.3, 0.5, 0.7]


def _planted(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new vectors, old vectors, memories): every memory again a day later, with a changed text and a turned vector.

    By its id a text is the same, revised, negated or has another figure, and a vector is turned by 0 to 35 degrees, so
    pairs lie in every band of the consolidation rules.
    """
    m, v = X.memories_text(spark, sf), X.table(spark, sf, "embeddings")
    turn = F.element_at(F.array(*[F.lit(t) for t in PLANTED_TURNS]), (F.col("vec_id") % len(PLANTED_TURNS) + 1).cast("int"))
    e = F.col("embedding").cast("array<double>")
    new = v.select((F.col("vec_id") + 1_000_000).alias("id"), F.zip_with(e, F.reverse(e), lambda a, b: a + turn * b).alias("embedding"))
    part = lambda k: F.element_at(F.array(*[F.lit(t[k]) for t in PLANTED_TEXTS]), (F.col("id") % len(PLANTED_TEXTS) + 1).cast("int"))
    again = m.withColumns({"content": F.concat(part(0), F.col("content"), part(1)), "status": F.lit("active"), "occurred_at": F.col("occurred_at") + F.expr("interval 1 day"), "id": F.col("id") + 1_000_000})
    return new, v.select(F.col("vec_id").alias("id"), "embedding"), m.unionByName(again)


def planted_near_duplicates(spark, sf):
    new, old, memories = _planted(spark, sf)
    return C.near_duplicates(C.similar_pairs(new, old, C.DUPLICATE, None), memories).select("new_id", "old_id", C.rounded(F.col("sim")).alias("sim"))


def planted_supersessions(spark, sf):
    new, old, memories = _planted(spark, sf)
    return C.supersessions(C.similar_pairs(new, old, C.SUPERSEDE_LOW, C.DUPLICATE), memories).select("new_id", "old_id", C.rounded(F.col("sim")).alias("sim"), "confidence")


def planted_contradictions(spark, sf):
    new, old, memories = _planted(spark, sf)
    return C.contradictions(C.similar_pairs(new, old, C.CONTRADICT_LOW, C.DUPLICATE), memories).select("left_id", "right_id", C.rounded(F.col("sim")).alias("sim"), "polarity", "figures", "confidence")


def planted_unexplained(spark, sf):
    new, old, memories = _planted(spark, sf)
    return C.unexplained(C.similar_pairs(new, old, C.CONTRADICT_LOW, C.DUPLICATE), memories).select("new_id", "old_id", C.rounded(F.col("sim")).alias("sim"))


def planted_associations(spark, sf):
    new, old, memories = _planted(spark, sf)
    return C.associations(C.similar_pairs(new, old, C.ASSOCIATE_LOW, C.DUPLICATE), memories).select("left_id", "right_id", C.rounded(F.col("sim")).alias("sim"), "weight", "confidence")


def whole_lineage(spark, sf):
    found = G.lineage(X.edges(spark, sf), _roots(spark, sf))
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return found.select("root", listed(F.col("ancestors")).alias("ancestors"), listed(F.col("successors")).alias("successors"), "is_current", "head")


def upserted_memories(spark, sf):
    m = X.memories_text(spark, sf).select("id", "status", F.lit(2).alias("version"))
    new = m.filter("id % 3 = 0").select((F.col("id") * 2).alias("id"), F.lit("stale").alias("status"), (F.col("id") % 4).cast("int").alias("version"))
    return H.upsert(m, new)


def retrieval_by_label(spark, sf):
    labels = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("qid"), F.col("label").alias("category"))
    return M.by_category(retrieval_metrics(spark, sf).join(labels, "qid"))


def benchmark_quotes(spark, sf):
    """Benchmark passages quoted by every document: those that stand in it word by word."""
    docs, quotes = X.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), X.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("quote"))
    return Y.ground_all(quotes, docs).select("item_id", F.col("id").alias("doc_id"))


def entity_lists(spark, sf):
    return entities(X.memories_text(spark, sf).select("id", "content"), "content").select("id", F.array_join("entities", "|").alias("entities"))


def prose_chunks(spark, sf):
    return chunk_memories(X.memories_text(spark, sf)).select("memory_id", "ordinal", "start", "end", "token_estimate", "kind", F.sha2("text", 256).alias("sha"))


def turn_neighbours(spark, sf):
    rows = Y.turn_neighbours(X.turns(spark, sf))
    return rows.select("session_id", "turn", F.size("before").alias("n_before"), F.size("after").alias("n_after"), F.sha2(F.array_join("before", "\n"), 256).alias("before_sha"), F.sha2(F.array_join("after", "\n"), 256).alias("after_sha"))


def hydrate_budget(spark, sf):
    w = Window.partitionBy("session_id").orderBy("turn")
    doc = F.struct(F.col("turn").alias("id"), "text", F.timestamp_seconds("turn").alias("occurred_at"))
    rows = X.turns(spark, sf).withColumns({"before": F.collect_list(doc).over(w.rowsBetween(-2, -1)), "after": F.collect_list(doc).over(w.rowsBetween(1, 2))})
    anchors = rows.filter("turn = 0 or role = 'assistant'").select(F.col("session_id").alias("qid"), F.col("turn").alias("rank"), F.col("turn").alias("id"), "text", F.timestamp_seconds("turn").alias("occurred_at"), "before", "after")
    return Y.hydrate(anchors, 600).select("qid", "id", "anchor")


#: Questions of every kind and way of naming a window, with kind, day of asking and window: hand-computed.
QUESTIONS = [
    ("What should I wear to the wedding?", "advice", "2024-05-10", None, None),
    ("Could you please suggest a few hotels?", "advice", "2024-05-10", None, None),
    ("How many days between the launch and the audit?", "date_arith", "2024-05-10", None, None),
    ("How many invoices did we send in March 2023?", "count", "2024-05-10", "2023-03-01", "2023-03-31"),
    ("Which came first, the move or the promotion?", "order", "2024-05-10", None, None),
    ("Everything we know about the vendor since 2021", "list_all", "2024-05-10", "2021-01-01", "2024-05-10"),
    ("Is the blue one cheaper than the red one?", "compare", "2024-05-10", None, None),
    ("Where does Anna live?", "direct", "2024-05-10", None, None),
    ("Where was I on 15 March 2026?", "direct", "2026-06-01", "2026-03-15", "2026-03-15"),
    ("Where was I on March 15, 2026?", "direct", "2026-06-01", "2026-03-15", "2026-03-15"),
    ("What happened on 2024-02-29?", "direct", "2024-05-10", "2024-02-29", "2024-02-29"),
    ("Trips in 2024-03", "direct", "2024-05-10", "2024-03-01", "2024-03-31"),
    ("Trips in 3/2024", "direct", "2024-05-10", "2024-03-01", "2024-03-31"),
    ("Trips in 2022", "direct", "2024-05-10", "2022-01-01", "2022-12-31"),
    ("Trips over the past 2 weeks", "direct", "2024-05-10", "2024-04-26", "2024-05-10"),
    ("Trips in the past quarter", "direct", "2024-05-10", "2024-02-09", "2024-05-10"),
    ("Trips between November and February", "direct", "2024-05-10", "2024-11-01", "2025-02-28"),
    ("Trips since November", "direct", "2024-05-10", "2023-11-01", "2024-05-10"),
    ("Trips before 2020", "direct", "2024-05-10", "1900-01-01", "2020-12-31"),
    ("Trips after March 2021", "direct", "2024-05-10", "2021-03-01", "2024-05-10"),
    ("Trips, Q1 2024", "direct", "2024-05-10", "2024-01-01", "2024-03-31"),
    ("Trips this summer", "direct", "2024-07-10", "2024-06-01", "2024-07-10"),
    ("Trips this quarter", "direct", "2024-05-10", "2024-04-01", "2024-05-10"),
    ("Trips during August", "direct", "2024-05-10", "2023-08-01", "2023-08-31"),
    ("Trips this month", "direct", "2024-05-10", "2024-05-01", "2024-05-10"),
    ("What did the doctor say I should do?", "direct", "2024-05-10", None, None),
]


def _asked(spark) -> DataFrame:
    rows = [(i, q, date.fromisoformat(d)) for i, (q, _, d, _, _) in enumerate(QUESTIONS)]
    return spark.createDataFrame(rows, "qid int, text string, asked_at date")


def classify_questions(spark, sf):
    return _asked(spark).select("qid", question_kind(F.col("text")).alias("kind"))


def question_windows(spark, sf):
    w = _asked(spark).select("qid", date_windows(F.col("text"), F.col("asked_at")).alias("w"))
    return w.select("qid", F.col("w.start").cast("string").alias("start_day"), F.col("w.end").cast("string").alias("end_day"))


def derive_reduce(spark, sf):
    rows = X.table(spark, sf, "events").select(F.col("user_id").alias("qid"), F.col("event_id").alias("seq"), F.to_date("ts").alias("date"), F.col("event_type").alias("fact"))
    kinds = F.when(F.col("qid") % 4 == 0, "count").when(F.col("qid") % 4 == 1, "order").when(F.col("qid") % 4 == 2, "date_arith").otherwise("list_all")
    texts = F.when(F.col("qid") % 4 == 1, "what came first").otherwise("how many weeks between both")
    q = rows.select("qid").distinct().select("qid", kinds.alias("kind"), texts.alias("text"), F.lit(date(2024, 3, 1)).alias("asked_at"))
    return Y.reduce_rows(rows, q)


def ground_quotes(spark, sf):
    docs = X.table(spark, sf, "documents").select("doc_id", "text")
    quote = F.substring("text", 10, 60)
    own = docs.select(F.col("doc_id").alias("source_id"), F.col("doc_id").alias("quoted_id"), quote.alias("quote"))
    other = docs.select((F.col("doc_id") + 1).alias("source_id"), F.col("doc_id").alias("quoted_id"), quote.alias("quote"))
    return Y.ground(own.union(other), docs.withColumnRenamed("doc_id", "id")).select("source_id", "quoted_id")


def jaccard_dedupe(spark, sf):
    m = X.memories_text(spark, sf).select(F.col("space_id").alias("qid"), F.col("id").alias("seq"), F.to_date("occurred_at").alias("date"), F.col("content").alias("fact"))
    return Y.drop_retellings(m).select("qid", "seq")


def retrieval_metrics(spark, sf):
    labels = X.table(spark, sf, "embeddings").select("vec_id", "label")
    found = _by_vector(spark, sf, 11).filter("memory_id <> qid").groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "memory_id"))), lambda x: x["memory_id"]).alias("found"))
    per = labels.groupBy("label").agg(F.collect_list("vec_id").alias("members"))
    gold = labels.filter("vec_id % 50 = 0").join(per, "label").select(F.col("vec_id").alias("qid"), F.array_remove("members", F.col("vec_id")).alias("gold"))
    f, g = F.col("found"), F.col("gold")
    scored = {"recall": M.recall_at(f, g, 10), "hit": M.hit_at(f, g, 10), "mrr": M.reciprocal_rank(f, g, 10), "ndcg": M.ndcg_at(f, g, 10), "full_recall": M.full_recall_at(f, g, 10)}
    return found.join(gold, "qid").select("qid", *[F.round(v, 6).alias(k) for k, v in scored.items()])


def wilson_by_category(spark, sf):
    t = X.memories_text(spark, sf).filter("quality is not null").groupBy("space_id").agg(F.sum("quality").cast("long").alias("good"), F.count("*").alias("n"))
    low, high = M.wilson(F.col("good"), F.col("n"))
    return t.select("space_id", "good", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def deterministic_embed(spark, sf):
    texts = X.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))  # no label tells of a text, so none are shuffled to meet
    rows = embed(texts, "content", hash_embedder(128))
    return rows.select("id", "embedding")


def search_production(spark, sf):
    memories = X.memories_text(spark, sf)
    options = SearchOptions(limit=10, use_rerank=True, max_per_source=3, question_kind="order", now=datetime(2024, 6, 1, tzinfo=UTC))
    return search(memories, _chunks(memories), X.chunks_vec(spark, sf), _questions(spark, sf), options, index=_index(spark, sf))


def entity_bridge(spark, sf):
    memories = X.memories_text(spark, sf)
    options = SearchOptions(limit=10, use_entities=True, use_decay=False)
    return search(memories, _chunks(memories), X.chunks_vec(spark, sf), _questions(spark, sf), options, index=_index(spark, sf)).select("qid", "memory_id", "score", "rank")


ALL = [
    filter_memories, typed_metadata, limited_closure, tenant_usage, quota_flags, keyset_page, exact_dedupe, merge_duplicates, token_counts, analyzed_terms, token_estimates, bm25_topk, bm25_filtered_topk, bm25_added_batch,
    vector_topk, vector_topk_batch, vector_index_topk, best_chunk_per_memory, hybrid_topk, weighted_fusion, heuristic_rerank, recency_decay, access_boost, temporal_boost, source_cap,
    kind_allocation, evidence_budget, mmr_topk, confidence_grade, conflict_pairs, suppress_superseded, lineage_head, reachable_superseders, bridge_on_delete,
    logged_history, logged_snapshots, stale_propagation, dependency_closure, graph_profile, node_degrees, as_of_snapshot, as_of_join, scd2_history, erase_report, near_duplicate_pairs,
    supersession_proposals, contradiction_proposals, unexplained_pairs, association_edges, planted_near_duplicates, planted_supersessions, planted_contradictions,
    planted_unexplained, planted_associations, whole_lineage, upserted_memories, benchmark_quotes, retrieval_by_label, entity_lists, prose_chunks, turn_neighbours, hydrate_budget,
    classify_questions, question_windows, derive_reduce, ground_quotes, jaccard_dedupe, retrieval_metrics, wilson_by_category, deterministic_embed, search_production, entity_bridge,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to function of (spark, folder of tables)."""
    return {f.__name__: f for f in ALL}
