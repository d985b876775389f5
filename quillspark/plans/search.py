"""Search as one lazy plan for a batch of questions, in the engine's stage order."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.entities import salient
from ..operators import graph as G
from ..operators import ranking as R
from ..operators import retrieval as S
from ..operators.filters import MemoryFilter, source_of
from ..operators.lexical_index import LexicalIndex
from ..storage import stored


@dataclass(frozen=True)
class SearchOptions:
    """Knobs of a search; stages that are off don't enter the plan."""

    limit: int = 10
    question_kind: str = "direct"
    filter: MemoryFilter = MemoryFilter()
    vector_weight: float = 1.0
    lexical_weight: float = 1.0
    rrf_k: int = 60
    tune_by_intent: bool = True
    use_entities: bool = False
    entity_weight: float = 0.6
    entity_budget: int = 6
    use_rerank: bool = False
    use_decay: bool = True
    half_life_days: float = R.HALF_LIFE_DAYS
    use_mmr: bool = False
    mmr_trade: float = 0.7
    max_per_source: int = 0
    route_by_kind: bool = False
    min_score: float = 0.0
    now: datetime | None = None


def hybrid_arms(live: DataFrame, chunks: DataFrame, vectors: DataFrame, questions: DataFrame, fetch: int, index: LexicalIndex | None = None) -> tuple[DataFrame, DataFrame]:
    """Vector and lexical arm over the memories that pass the filter; the filter comes before the scores.

    With an index of all chunks the lexical arm reads its postings, and the ids that pass; else it indexes ``chunks``.

    Both are at most ``fetch`` rows a question and are read by several stages, so they are written once.
    """
    ids = live.select(F.col("id").alias("memory_id"))
    vector = S.vector_search(vectors.join(ids, "memory_id", "left_semi"), questions.select("qid", "embedding"), fetch)
    asked = questions.select("qid", "text")
    return stored(vector), stored(S.lexical_search(chunks, asked, fetch) if index is None else index.search(asked, fetch, within=ids))


def _first_texts(chunks: DataFrame, rows: DataFrame) -> DataFrame:
    """(memory_id, text, ordinal) of the first chunk of the memories in ``rows``; no other texts are sorted."""
    return chunks.join(rows.select("memory_id").distinct(), "memory_id", "left_semi").groupBy("memory_id").agg(F.min_by("text", "ordinal").alias("text"), F.min("ordinal").alias("ordinal"))


def entity_arm(chunks: DataFrame, fused: DataFrame, questions: DataFrame, fetch: int, limit: int, budget: int = 6, seeds: int = 8, index: LexicalIndex | None = None) -> DataFrame:
    """(qid, memory_id, score, rank) of memories that share a salient name with the first fused ones and aren't fused yet.

    Each name of a question is one lexical lookup; all lookups are one batch. A memory counts by its best lookup.
    """
    seeded = fused.filter(F.col("rank") <= seeds).select("qid", "memory_id")
    top = seeded.join(_first_texts(chunks, seeded), "memory_id").select("qid", "text")
    found = stored(salient(top, questions.select("qid", "text"), budget).withColumn("key", F.concat_ws("#", F.col("qid").cast("string"), "entity")))
    named = found.select(F.col("key").alias("qid"), F.col("entity").alias("text"))
    hits = S.lexical_search(chunks, named, max(fetch // 2, limit)) if index is None else index.search(named, max(fetch // 2, limit), within=chunks.select("memory_id"))
    best = hits.withColumnRenamed("qid", "key").join(found.select("key", "qid"), "key").groupBy("qid", "memory_id").agg(F.max("score").alias("score"))
    return R.ranked(best.join(fused.select("qid", "memory_id"), ["qid", "memory_id"], "left_anti"))


def search(memories: DataFrame, chunks: DataFrame, vectors: DataFrame, questions: DataFrame, options: SearchOptions, edges: DataFrame | None = None, index: LexicalIndex | None = None) -> DataFrame:
    """(qid, memory_id, score, rank, vector_score, lexical_score, source, kind, status, explain) of each question's results.

    Order: arms, rank fusion with the weights of the question kind, names as a third arm, pool, rerank, window of ``questions.start``/``end``
    if there, decay, suppression of what a result supersedes, source cap, kind allocation, diversification, cut, floor.

    With a column ``kind`` in ``questions`` each question has the weights, limit and allocation of its own kind;
    otherwise all have those of ``options.question_kind``. ``index`` is a kept index of all chunks.
    """
    own = "kind" in questions.columns
    live = memories.filter(options.filter.column())
    listing = options.question_kind == "list_all" or (own and not questions.filter("kind = 'list_all'").isEmpty())
    limit, fetch, pool_size = S.candidate_sizes(options.limit, listing)
    kinds = questions.select("qid", F.coalesce("kind", F.lit("direct")).alias("kind")) if own else None
    small = S.candidate_sizes(options.limit, False)
    few = lambda wide, narrow: F.when(F.col("__kind") == "list_all", wide).otherwise(narrow)
    ids = live.select(F.col("id").alias("memory_id"))
    vector, lexical = hybrid_arms(live, chunks.join(ids, "memory_id", "left_semi"), vectors, questions, fetch, index)
    wv, wl, k = R.INTENT_WEIGHTS[options.question_kind] if options.tune_by_intent else (1.0, 1.0, options.rrf_k)
    if own and options.tune_by_intent:
        wv = wl = 1.0  # each question's kind weighs below
    arms = {"vector": (vector, options.vector_weight * wv), "lexical": (lexical, options.lexical_weight * wl)}
    fuse = (lambda a: R.intent_fusion(a, kinds)) if own and options.tune_by_intent else (lambda a: R.rank_fusion(a, k))
    fused = fuse(arms)
    if options.use_entities and options.entity_budget > 0:
        third = entity_arm(chunks.join(ids, "memory_id", "left_semi"), stored(fused), questions, fetch, limit, options.entity_budget, index=index)
        fused = fuse(arms | {"entity": (stored(third), options.entity_weight)})
    why = F.transform(F.map_entries("ranks"), lambda e: F.concat(e["key"], F.lit(" rank "), e["value"].cast("string")))
    named = kinds.withColumnRenamed("kind", "__kind") if own else None
    inside = F.col("rank") <= (few(pool_size, small[2]) if own else pool_size)
    pool = (fused.join(named, "qid") if own else fused).filter(inside).select("qid", "memory_id", "score", F.concat(why, F.array(F.concat(F.lit("fused "), F.col("score").cast("string")))).alias("explain"))
    pool = pool.join(vector.select("qid", "memory_id", F.col("score").alias("vector_score")), ["qid", "memory_id"], "left")
    pool = pool.join(lexical.select("qid", "memory_id", F.col("score").alias("lexical_score")), ["qid", "memory_id"], "left")
    if options.use_rerank:
        pool = stored(pool)
    about = live.select(F.col("id").alias("memory_id"), "source", "kind", "status", "occurred_at", source_of(live).alias("__from"))
    rows = pool.join(about, "memory_id")
    if options.use_rerank:
        new = R.heuristic_rerank(stored(pool.join(_first_texts(chunks, pool), "memory_id").select("qid", "memory_id", "score", "text", "ordinal")), questions, index=index)
        rows = rows.drop("score").join(new.select("qid", "memory_id", "score"), ["qid", "memory_id"])
    if "start" in questions.columns:
        rows = rows.join(questions.select("qid", "start", "end"), "qid")
        rows = rows.withColumn("score", F.round(F.col("score") * R.scope_factor(F.to_date("occurred_at"), F.col("start"), F.col("end")), 9)).drop("start", "end")
    if options.use_decay and options.now is not None:
        factor = R.recency_factor(F.col("occurred_at"), F.lit(options.now), options.half_life_days)
        rows = rows.withColumn("score", F.round(F.col("score") * factor, 9))
    if edges is not None:
        rows = G.suppress_superseded(rows, edges)
    rows = R.source_cap(rows, options.max_per_source, "__from").drop("__from")
    if own:
        rows = rows.join(named, "qid")
    if options.route_by_kind:
        rows = R.kind_allocation_each(rows, few(limit, small[0]), F.col("__kind")) if own else R.kind_allocation(rows, limit, options.question_kind)
    if options.use_mmr:
        chosen = R.mmr(rows.join(vectors.select("memory_id", "embedding"), "memory_id", "left"), limit, options.mmr_trade)
        rows = rows.drop("score", "rank").join(chosen.select("qid", "memory_id", "score", "rank"), ["qid", "memory_id"])
        out = rows.filter(F.coalesce("vector_score", "score") >= options.min_score)
        if own:
            out = out.filter(F.col("rank") <= few(limit, small[0]))
    else:
        out = R.cut(rows, few(limit, small[0]) if own else limit, options.min_score, "vector_score")
    return out.select("qid", "memory_id", "score", "rank", "vector_score", "lexical_score", "source", "kind", "status", "explain")


def projected(results: DataFrame, memories: DataFrame, explain: bool = False, chars: int = 280) -> DataFrame:
    """Results as they are shown: scores to 6 digits, the text's first ``chars`` characters, and how they came about if asked for."""
    texts = memories.select(F.col("id").alias("memory_id"), F.substring("content", 1, chars).alias("preview"))
    rows = results.join(texts, "memory_id", "left").withColumns({c: F.round(c, 6) for c in ("score", "vector_score", "lexical_score")})
    return rows if explain else rows.drop("explain")
