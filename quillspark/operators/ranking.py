"""Rank stages: fusion, rerank, decay, boosts, quotas, diversification, confidence, conflicts. All keyed by ``qid``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.text import analyze, stem, word_counts
from ..storage import stored
from .lexical_index import LexicalIndex

# Fixed values -------------------------------------------------------------------------------------------------------

#: Question kind: (vector weight, lexical weight, k of rank fusion).
INTENT_WEIGHTS = {
    "list_all": (1.0, 1.3, 90),
    "count": (1.0, 1.3, 90),
    "order": (1.0, 1.15, 60),
    "date_arith": (1.0, 1.15, 60),
    "direct": (1.15, 1.0, 60),
    "advice": (1.25, 0.9, 60),
    "compare": (1.0, 1.15, 75),
}
#: Question kind: share of episodic rows.
EPISODIC_SHARE = {"order": 0.7, "date_arith": 0.7, "compare": 0.6, "count": 0.5, "direct": 0.5, "list_all": 0.4, "advice": 0.2}

HALF_LIFE_DAYS, DECAY_FLOOR, OLDEST_DAYS = 180.0, 0.25, 36_500.0
IN_SCOPE, NEAR_SCOPE, NEAR_DAYS = 1.25, 1.10, 14
WEAK_TOP, STRONG_TOP, FLAT_MARGIN = 0.30, 0.55, 0.12
PHRASE_BONUS, PRIOR_SHARE, RERANK_K = 1.35, 0.15, 1.2

# --------------------------------------------------------------------------------------------------------------------


def _by_score(score: str = "score", id_col: str = "memory_id") -> Window:
    return Window.partitionBy("qid").orderBy(F.col(score).desc(), F.col(id_col))


def ranked(rows: DataFrame, score: str = "score") -> DataFrame:
    """Rows with ``rank`` from 1 by score, ties by id."""
    return rows.withColumn("rank", F.row_number().over(_by_score(score)))


def ranked_wide(rows: DataFrame, score: str = "score") -> DataFrame:
    """``ranked`` for queries with any number of rows: no task holds a query's rows.

    Rows are dealt by ranges of query, score and id, placed within their range, and moved on by the query's rows in the
    ranges before.
    """
    ranged = stored(rows.repartitionByRange("qid", F.col(score).desc(), F.col("memory_id")).withColumn("__part", F.spark_partition_id()))
    own = F.row_number().over(Window.partitionBy("qid", "__part").orderBy(F.col(score).desc(), F.col("memory_id")))
    earlier = Window.partitionBy("qid").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("qid", "__part").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    before = before.select(F.col("qid").alias("__q"), F.col("__part").alias("__p"), "__before")
    placed = ranged.withColumn("__own", own)
    joined = placed.join(before, placed["qid"].eqNullSafe(before["__q"]) & (placed["__part"] == before["__p"]))
    return joined.withColumn("rank", (F.col("__own") + F.col("__before")).cast("int")).drop("__q", "__p", "__part", "__own", "__before")


def by_kind(kind: Column, values: dict[str, float]) -> Column:
    """Value of a question's kind; that of ``direct`` where the kind is unknown."""
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.element_at(table, kind), F.lit(values["direct"]))


def intent_fusion(arms: dict[str, tuple[DataFrame, float]], kinds: DataFrame, digits: int = 9) -> DataFrame:
    """``rank_fusion`` with the weights and k of each question's own kind; ``kinds`` is (qid, kind), a bounded batch.

    The arms ``vector`` and ``lexical`` are weighed by kind, others by their own weight alone.
    """
    k = by_kind(F.col("kind"), {n: v[2] for n, v in INTENT_WEIGHTS.items()})
    parts = None
    for name, (rows, weight) in arms.items():
        if weight:
            place = {"vector": 0, "lexical": 1}.get(name)
            own = F.lit(1.0) if place is None else by_kind(F.col("kind"), {n: float(v[place]) for n, v in INTENT_WEIGHTS.items()})
            one = rows.join(F.broadcast(kinds), "qid").select("qid", "memory_id", F.lit(name).alias("arm"), F.col("rank").cast("int").alias("r"), (F.lit(float(weight)) * own / (k + F.col("rank"))).alias("part"))
            parts = one if parts is None else parts.unionByName(one)
    if parts is None:
        raise ValueError("no arm has a weight")
    return ranked(parts.groupBy("qid", "memory_id").agg(F.round(F.sum("part"), digits).alias("score"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("arm", "r")))).alias("ranks")))


def rank_fusion(arms: dict[str, tuple[DataFrame, float]], k: int = 60, digits: int = 9) -> DataFrame:
    """(qid, memory_id, score, ranks) by reciprocal ranks; an arm is (rows with qid, memory_id, rank; weight).

    Arms of weight 0 are left out of the plan. ``ranks`` maps the arm's name to the rank there.
    """
    if k < 1 or any(w < 0 for _, w in arms.values()):
        raise ValueError("k must be at least 1 and weights must not be negative")
    parts = None
    for name, (rows, weight) in arms.items():
        if weight:
            one = rows.select("qid", "memory_id", F.lit(name).alias("arm"), F.col("rank").cast("int").alias("r"), (F.lit(float(weight)) / (k + F.col("rank"))).alias("part"))
            parts = one if parts is None else parts.unionByName(one)
    if parts is None:
        raise ValueError("no arm has a weight")
    fused = parts.groupBy("qid", "memory_id").agg(F.round(F.sum("part"), digits).alias("score"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("arm", "r")))).alias("ranks"))
    return ranked(fused)


def score_fusion(arms: dict[str, tuple[DataFrame, float]], digits: int = 6) -> DataFrame:
    """(qid, memory_id, score) by weighted scores, each arm's brought to 0..1 by its range; a flat arm counts 1."""
    parts, total = None, sum(w for _, w in arms.values())
    w = Window.partitionBy("qid")
    for rows, weight in arms.values():
        low, high = F.min("score").over(w), F.max("score").over(w)
        norm = F.when(high == low, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low))
        one = rows.select("qid", "memory_id", (norm * float(weight)).alias("part"))
        parts = one if parts is None else parts.unionByName(one)
    return ranked(parts.groupBy("qid", "memory_id").agg(F.round(F.sum("part") / total, digits).alias("score")))


def heuristic_rerank(pool: DataFrame, queries: DataFrame, digits: int = 6, index: LexicalIndex | None = None) -> DataFrame:
    """Scores replaced by term evidence within the pool; ``pool`` has qid, memory_id, score, text, bounded per query.

    Sum of idf times saturated frequency, by coverage of the query's terms, more where its analysed phrase occurs, plus a
    share of the prior score. Rows without words score 0; a query of stop words keeps the order, ``reranked`` false.

    Where the pool's texts are chunks of an index (``ordinal`` says which), counts are read from its postings; else each text
    is tokenised once, whatever the number of queries that it is in the pool of. A text is analysed whole only if it
    has all terms of a query, as only then it can hold the phrase.
    """
    q = stored(queries.select("qid", F.array_distinct(analyze(F.col("text"))).alias("terms"), F.array_join(analyze(F.col("text")), " ").alias("phrase")))
    asked = q.select("qid", F.explode("terms").alias("i"))
    if index is not None:
        found = stored(index.term_counts(pool, asked.select(F.col("i").alias("term"))))
        held = found.filter("term is not null").select("memory_id", F.col("term").alias("i"), F.col("tf").alias("c"))
        lengths = found.filter("term is null").select("memory_id", F.col("tf").alias("length"))
    else:
        texts = pool.select("memory_id", "text").dropDuplicates(["memory_id"])
        counted = stored(word_counts(texts, ["memory_id"], "text"))
        entries = counted.select("memory_id", F.inline(F.arrays_zip("words", "tfs")))
        known = entries.select("words").distinct().select("words", stem(F.col("words")).alias("i")).join(asked.select("i").distinct(), "i", "left_semi")
        held = entries.join(known, "words").groupBy("memory_id", "i").agg(F.sum("tfs").alias("c"))
        lengths = counted.select("memory_id", "length")
    w = Window.partitionBy("qid")
    rows = pool.select("qid", "memory_id", "score", "text").withColumn("n", F.count("*").over(w)).join(lengths, "memory_id").join(q, "qid")
    spread = rows.select("qid", "memory_id", "n").join(held, "memory_id").join(asked, ["qid", "i"])
    df = spread.groupBy("qid", "i").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") + 1) / (F.col("df") + 1))
    evidence = spread.join(df, ["qid", "i"]).groupBy("qid", "memory_id").agg(F.sum(idf * F.col("c") / (F.col("c") + RERANK_K)).alias("base"), F.count("*").alias("hit"))
    joined = rows.join(evidence, ["qid", "memory_id"], "left").fillna({"base": 0.0, "hit": 0})
    has = F.size("terms") > 0
    score = F.col("base") * (0.5 + 0.5 * F.col("hit") / F.size("terms"))
    phrase = F.when(F.col("hit") == F.size("terms"), F.array_join(analyze(F.col("text")), " ").contains(F.col("phrase"))).otherwise(False)
    score = score * F.when(phrase, PHRASE_BONUS).otherwise(1.0) + PRIOR_SHARE * F.col("score")
    new = F.when(~has, F.col("score")).when(F.col("length") == 0, 0.0).otherwise(F.round(score, digits))
    return ranked(joined.select("qid", "memory_id", F.col("score").alias("prior"), new.alias("score"), has.alias("reranked")))


def recency_factor(occurred_at: Column, now: Column, half_life: float = HALF_LIFE_DAYS, floor: float = DECAY_FLOOR) -> Column:
    """Exponential decay to a floor; the future counts as now, a century and more as the floor."""
    age = F.greatest((F.unix_micros(now) - F.unix_micros(occurred_at)) / 86_400_000_000.0, F.lit(0.0))
    return F.when(age > OLDEST_DAYS, F.lit(floor)).otherwise(floor + (1 - floor) * F.pow(F.lit(0.5), age / half_life))


def apply_decay(rows: DataFrame, now: Column, digits: int = 6, wide: bool = False, **options) -> DataFrame:
    """Scores by recency, ranked anew; ``wide`` for queries that have very many rows, whole spaces for example."""
    return (ranked_wide if wide else ranked)(rows.withColumn("recency", F.round(recency_factor(F.col("occurred_at"), now, **options), digits)).withColumn("score", F.round(F.col("score") * recency_factor(F.col("occurred_at"), now, **options), digits)))


def access_factor(count: Column, strength: float = 0.10, saturation: int = 20) -> Column:
    """Boost by number of reads, logarithmic up to ``saturation``."""
    return F.when(count <= 0, F.lit(1.0)).otherwise(1 + strength * F.least(F.log1p(count.cast("double")) / F.log1p(F.lit(float(saturation))), F.lit(1.0)))


def scope_factor(day: Column, start: Column, end: Column) -> Column:
    """Boost of days in a window, a smaller one up to 14 days outside; other days and null dates stay."""
    out = F.greatest(F.datediff(start, day), F.datediff(day, end))
    return F.when(day.isNull() | start.isNull(), F.lit(1.0)).when(out <= 0, IN_SCOPE).when(out <= NEAR_DAYS, NEAR_SCOPE).otherwise(1.0)


def source_cap(rows: DataFrame, cap: int, source: str = "source") -> DataFrame:
    """Best ``cap`` rows of each source; null sources are each their own; 0 is no cap."""
    if cap <= 0:
        return rows
    own = F.coalesce(F.col(source).cast("string"), F.concat(F.lit("own:"), F.col("memory_id").cast("string")))
    w = Window.partitionBy("qid", "__source").orderBy(F.col("score").desc(), "memory_id")
    return rows.withColumn("__source", own).withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= cap).drop("__n", "__source")


def kind_allocation(rows: DataFrame, limit: int, question_kind: str = "direct") -> DataFrame:
    """``limit`` rows with the question kind's share of episodic ones; free places go to the best of the rest."""
    share = EPISODIC_SHARE[question_kind]
    want = round(limit * share)  # half to even
    floor = min(2, limit // 2)
    episodic = max(floor, min(want, limit - floor)) if limit > 1 else (1 if share >= 0.5 else 0)
    per = Window.partitionBy("qid", "kind").orderBy(F.col("score").desc(), "memory_id")
    first = F.row_number().over(per) <= F.when(F.col("kind") == "episodic", episodic).otherwise(limit - episodic)
    fill = Window.partitionBy("qid").orderBy(F.col("__spare"), F.col("score").desc(), "memory_id")
    chosen = rows.withColumn("__spare", (~first).cast("int")).withColumn("__n", F.row_number().over(fill)).filter(F.col("__n") <= limit)
    return ranked(chosen.drop("__n", "__spare"))


def kind_allocation_each(rows: DataFrame, limit: Column, kind: Column) -> DataFrame:
    """``kind_allocation`` with each row's question kind and limit."""
    share = by_kind(kind, EPISODIC_SHARE)
    least = F.least(F.lit(2), F.floor(limit / 2))
    many = F.greatest(least, F.least(F.bround(limit * share, 0), limit - least))
    episodic = F.when(limit > 1, many).otherwise((share >= 0.5).cast("int"))
    per = Window.partitionBy("qid", "kind").orderBy(F.col("score").desc(), "memory_id")
    first = F.row_number().over(per) <= F.when(F.col("kind") == "episodic", episodic).otherwise(limit - episodic)
    fill = Window.partitionBy("qid").orderBy(F.col("__spare"), F.col("score").desc(), "memory_id")
    chosen = rows.withColumn("__spare", (~first).cast("int")).withColumn("__n", F.row_number().over(fill)).filter(F.col("__n") <= limit)
    return ranked(chosen.drop("__n", "__spare"))


def cut(rows: DataFrame, limit: int | Column, min_score: float = 0.0, vector_score: str | None = None) -> DataFrame:
    """First ``limit`` rows, then those of at least ``min_score`` (by cosine where there is one)."""
    calibrated = F.coalesce(F.col(vector_score), F.col("score")) if vector_score else F.col("score")
    return ranked(rows).filter(F.col("rank") <= limit).filter(calibrated >= min_score)


def mmr(rows: DataFrame, limit: int, trade: float = 0.7) -> DataFrame:
    """Greedy maximal marginal relevance over qid, memory_id, score, embedding; a query's rows are a bounded pool.

    Relevance is the score brought to 0..1 (flat: 1); redundancy is the highest cosine to what is chosen, 0 without a
    vector; ties go to the smaller id.
    """
    read = rows.select("qid", "memory_id", "score", "embedding")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("memory_id", kind="stable").reset_index(drop=True)
        s = pdf["score"].to_numpy(float)
        rel = np.ones(len(s)) if s.max() == s.min() else (s - s.min()) / (s.max() - s.min())
        v = [np.asarray(e, float) if e is not None else None for e in pdf["embedding"]]
        unit = [x / n if x is not None and (n := np.linalg.norm(x)) else None for x in v]
        worst, seen, left, order, marks = np.zeros(len(s)), np.zeros(len(s), bool), list(range(len(s))), [], []
        while left and len(order) < limit:
            value = np.round(trade * rel[left] - (1 - trade) * worst[left], 12)
            at = left.pop(int(np.argmax(value)))
            order.append(at), marks.append(float(value.max()))
            for j in left:
                if unit[at] is not None and unit[j] is not None and len(unit[at]) == len(unit[j]):
                    c = float(unit[at] @ unit[j])
                    worst[j] = max(worst[j], c) if seen[j] else c
                    seen[j] = True
        return pd.DataFrame({"qid": pdf["qid"].iloc[order], "memory_id": pdf["memory_id"].iloc[order], "score": s[order], "mmr": marks, "rank": range(1, len(order) + 1)})

    schema = StructType([*read.schema.fields[:3], StructField("mmr", read.schema["score"].dataType), *StructType.fromDDL("rank int").fields])
    return read.groupBy("qid").applyInPandas(choose, schema)


def conflict_pairs(results: DataFrame, edges: DataFrame) -> DataFrame:
    """(qid, left_id, right_id) of contradictions with both ends among a query's results, each pair once."""
    e = edges.filter("type = 'contradicts'").select("source_id", "target_id")
    one = results.select("qid", F.col("memory_id").alias("source_id"))
    two = results.select("qid", F.col("memory_id").alias("target_id"))
    pairs = e.join(one, "source_id").join(two, ["qid", "target_id"])
    return pairs.select("qid", F.least("source_id", "target_id").alias("left_id"), F.greatest("source_id", "target_id").alias("right_id")).distinct()


def confidence(rows: DataFrame, conflicts: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """(qid, level, top_score, margin, n_results, reason) from calibrated scores in rank order.

    Questions of ``asked`` (qid) without results have the level ``none``.
    """
    top = rows.groupBy("qid").agg(F.max_by("score", -F.col("rank")).alias("top_score"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"), F.count("*").alias("n_results"))
    hit = top.join(conflicts.select("qid", F.lit(True).alias("clash")).distinct(), "qid", "left") if conflicts is not None else top.withColumn("clash", F.lit(None).cast("boolean"))
    margin = F.col("top_score") - F.coalesce("second", F.lit(0.0))
    clash, weak = F.coalesce("clash", F.lit(False)), F.col("top_score") < WEAK_TOP
    flat = (F.col("n_results") > 1) & (margin < FLAT_MARGIN * F.col("top_score"))
    level = F.when(clash | weak | flat, "low").when(F.col("top_score") >= STRONG_TOP, "high").otherwise("medium")
    reason = F.when(clash, "conflict").when(weak, "weak").when(flat, "flat").otherwise("ok")
    graded = hit.select("qid", level.alias("level"), "top_score", F.round(margin, 6).alias("margin"), "n_results", reason.alias("reason"))
    if asked is None:
        return graded
    bare = asked.select("qid").distinct().join(graded, "qid", "left_anti").select("qid", F.lit("none").alias("level"), F.lit(0.0).alias("top_score"), F.lit(0.0).alias("margin"), F.lit(0).cast("long").alias("n_results"), F.lit("nothing").alias("reason"))
    return graded.unionByName(bare)


def evidence_budget(rows: DataFrame, cliff: float, floor: int, ceiling: int = 100) -> DataFrame:
    """Rows down to the first score under ``cliff`` of the top, at least ``floor`` and at most ``ceiling``."""
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    top = F.first("score").over(w)
    unbroken = F.min((F.col("score") >= cliff * top).cast("int")).over(w) == 1
    return rows.withColumn("__keep", unbroken | (F.col("rank") <= floor)).filter(F.col("__keep") & (F.col("rank") <= ceiling)).drop("__keep")
