"""Mixing sources to target weights by pivotal dependent rounding of copy probabilities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ._shared import mixed, row_tie, saved, tasks_for, with_global_rank, with_row_number

#: Rows of a bucket that is rounded at once, buckets whose residual rows a later one combines.
ROWS_PER_BUCKET, FAN_IN = 2_000, 64
#: Fractions nearer than this to 0 or 1 count as integral.
NEAR = 1e-9

WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, size): ``share`` of all sizes by weight, at most ``most`` times each.

    Weights repeat over the sources in code point order, null last. What a capped source can't take is shared among
    the others by weight until none is above; each round is one aggregate over the table of sources.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = with_global_rank(totals, ["source"])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    table = saved(ranked.select("source", "source_size", weight.alias("__w"), (F.col("source_size") * float(most)).alias("__cap")))
    whole = table.agg(F.sum("source_size").alias("s")).first()["s"] or 0
    budget, rate = min(share, most) * whole, 0.0
    while True:
        capped = F.col("__w") * F.lit(rate) >= F.col("__cap")
        row = table.agg(F.sum(F.when(capped, F.col("__cap")).otherwise(0.0)).alias("used"), F.sum(F.when(capped, 0.0).otherwise(F.col("__w"))).alias("w")).first()
        if not row["w"]:
            break
        after = (budget - row["used"]) / row["w"]
        if after <= rate * (1 + 1e-12):
            break
        rate = after
    return table.select("source", "source_size", F.least(F.col("__w") * F.lit(float(rate)), F.col("__cap")).alias("target"))


def pivot(mass: np.ndarray, size: np.ndarray, coin: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounds fractions ``mass`` of ``size`` words, keeping their words' sum: (0 or 1 each, index still fractional or -1).

    Two fractional rows at a time exchange words until one is 0 or 1; which way is drawn so that each expectation stays.
    The last fractional row keeps its fraction.
    """
    out = mass.copy()
    held = -1
    for j in range(len(out)):
        if out[j] <= NEAR or out[j] >= 1 - NEAR:
            out[j] = round(out[j])
            continue
        if held < 0:
            held = j
            continue
        p, q, a, b = out[held], out[j], size[held], size[j]
        up, down = min((1 - p) * a, q * b), min(p * a, (1 - q) * b)
        if coin[j] * (up + down) < down:
            p, q = p + up / a, q - up / b
        else:
            p, q = p - down / a, q + down / b
        p, q = (round(x) if x <= NEAR or x >= 1 - NEAR else x for x in (p, q))
        out[held], out[j] = p, q
        held = held if 0 < p < 1 else j if 0 < q < 1 else -1
    return out, held


def mix_copies(docs: DataFrame, id_col: str = "doc_id", source: str = "source", size: Column | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 0, tie: Column | None = None) -> DataFrame:
    """(id, __tie, __n, source, size, source_size, target, copies) for every row: how often the mix takes it.

    A row's expected copies are target over size of its source, at most ``most``. The whole part is certain; the
    fractions are rounded by pivotal exchange that keeps each source's words: first in buckets of rows by hash (a
    source with any share of the rows is spread over all buckets), largest rows first, then the buckets' residual
    rows in a tree. At its root at most one row a source is left; it goes to the nearer integer, so a source misses
    its target by at most half that row's words. All draws follow from ids, ``tie`` (a hash of what else tells rows of one
    id apart; by default of source and size) and ``seed``, and buckets from the number of rows: reruns agree on any
    cluster.

    Rows without words take no part in the exchange and are drawn singly. Null sources are a source of their own.
    """
    counted = F.coalesce(size, F.lit(0)).cast("long") if size is not None else word_count(F.col("text"))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(source).cast("string").alias("source"), counted.alias("size"), *([tie.alias("__tie")] if tie is not None else []))
    if tie is None:
        rows = rows.withColumn("__tie", F.xxhash64("source", "size"))
    rows = saved(with_row_number(rows, ["__id", "__tie"]))
    targets = source_targets(rows.select("source", "size"), weights, share, most)
    buckets = tasks_for(rows.count(), ROWS_PER_BUCKET)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(float(min(share, most))))
    near = targets.withColumnRenamed("source", "__s")
    joined = (
        rows.join(near, rows["source"].eqNullSafe(near["__s"]), "left").drop("__s")
        .withColumn("__hash", F.xxhash64(F.col("__id"), F.col("__tie"), F.col("__n"), F.lit(seed)))
        .withColumn("__ratio", ratio)
        .withColumn("__whole", F.floor(F.col("__ratio") + NEAR).cast("int"))
        .withColumn("__part", F.greatest(F.col("__ratio") - F.col("__whole"), F.lit(0.0)))
        .withColumn("__bucket", F.pmod(F.col("__hash"), F.lit(buckets)).cast("int"))
    )

    def exchange(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["source", "size", "__hash"], ascending=[True, False, True], na_position="last", kind="stable").reset_index(drop=True)
        part, left = pdf["__part"].to_numpy(float).copy(), np.zeros(len(pdf), bool)
        words, coin = pdf["size"].to_numpy(float), mixed(pdf["__hash"].to_numpy().view(np.uint64)) / 2.0**64
        names = pdf["source"]
        starts = [0, *(np.flatnonzero((names != names.shift()).to_numpy()[1:] & ~(names.isna() & names.shift().isna()).to_numpy()[1:]) + 1), len(pdf)]
        for a, b in zip(starts, starts[1:]):
            empty = a + np.flatnonzero(words[a:b] <= 0)
            part[empty] = coin[empty] < part[empty]
            some = a + np.flatnonzero(words[a:b] > 0)
            part[some], held = pivot(part[some], words[some], coin[some])
            if held >= 0:
                left[some[held]] = True
        return pdf.assign(__part=part, __left=left)

    kept = joined.schema.fields
    schema = StructType([*kept, StructField("__left", BooleanType())])
    done = saved(joined.groupBy("__bucket").applyInPandas(exchange, schema))
    columns = [f.name for f in kept]
    open_rows = done.filter("__left").select(columns)
    finished, width = [], buckets
    while width > 1:
        width = -(-width // FAN_IN)
        level = open_rows.withColumn("__bucket", (F.col("__bucket") / FAN_IN).cast("int"))
        step = saved(level.groupBy("__bucket").applyInPandas(exchange, schema))
        finished.append(step.filter("not __left").select(columns))
        open_rows = step.filter("__left").select(columns)
    settled = open_rows.withColumn("__part", F.round("__part"))
    for more in finished:
        settled = settled.union(more)
    out = done.filter("not __left").select(columns).union(settled)
    return out.select("__id", "__tie", "__n", "source", "size", "source_size", "target", (F.col("__whole") + F.round("__part")).cast("int").alias("copies"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it (none to twice); columns as before."""
    plan = mix_copies(docs, id_col, source, word_count(F.col(text)), tie=row_tie(docs), **options)
    plan = plan.filter("copies > 0").select(F.col("__id").alias("__pid"), F.col("__tie").alias("__pt"), F.col("__n").alias("__pn"), "copies")
    rows = with_row_number(docs.withColumns({"__id": F.col(id_col), "__tie": row_tie(docs)}), ["__id", "__tie"])
    met = rows.join(plan, rows["__id"].eqNullSafe(plan["__pid"]) & (rows["__tie"] == plan["__pt"]) & (rows["__n"] == plan["__pn"]))
    return met.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(docs.columns)
