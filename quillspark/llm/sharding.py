"""Byte-balanced shards by Karmarkar-Karp differencing over indivisible groups of equal texts."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import null_safe, row_tie, saved, tasks_for, text_key, with_text_key

#: Cells a shard's fair share is cut into: what differencing sees is bounded by the shard count, not by the documents.
CELLS_PER_SHARD = 400
#: Rows whose slots one task numbers.
ROWS_PER_LOT = 10_000


def difference(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combines partial partitions, the two with largest spread first, largest bin onto smallest.

    ``parts`` is n x k sums. Returns, for each part and each of its bins, the bin of the whole that it joins, and the
    whole's k sums. Ties fall to the part that came first, so the result depends on the input only.
    """
    n, k = parts.shape
    order = np.argsort(-parts, axis=1, kind="stable")
    sums = np.take_along_axis(parts, order, axis=1)
    heap = [(-int(s[0] - s[-1]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    held: dict[int, np.ndarray] = {i: sums[i] for i in range(n)}
    left, right, perms, at = [], [], [], n
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        total = held.pop(a) + held.pop(b)[::-1]
        perm = np.argsort(-total, kind="stable")
        total = total[perm]
        held[at] = total
        left.append(a), right.append(b), perms.append(perm)
        heapq.heappush(heap, (-int(total[0] - total[-1]), at))
        at += 1
    place = np.empty((at, k), np.int16)
    place[at - 1] = np.arange(k)
    for j in range(len(left) - 1, -1, -1):
        here = np.empty(k, np.int16)
        here[perms[j]] = place[n + j]
        place[left[j]] = here
        place[right[j]] = here[::-1]
    out = np.empty((n, k), np.int16)
    np.put_along_axis(out, order, place[:n], axis=1)
    return out, held[at - 1]


def shard_by_bytes(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``; law ``bytes``.

    Size is UTF-8 bytes of the text plus ``overhead``. Rows of equal text form a group that goes to one shard whole. Only
    a group that weighs more than a whole fair share (there are fewer than ``n_shards``) is cut, into small pieces of
    whole rows by a hash of the id: no shard could hold it and be near equal.

    Groups heavier than 1 / CELLS_PER_SHARD of a fair share are cells of their own; lighter ones are dealt by hash into
    ``CELLS_PER_SHARD * n_shards`` cells, however many there are. So at most ``2 * CELLS_PER_SHARD * n_shards`` weighted
    cells, and the pieces, are differenced, in one task, and the tables that are broadcast to the rows have this bound.
    Rows are shuffled only, as narrow rows, to number the slots, in lots whose number follows from that of the rows.

    Null texts are one group of size ``overhead`` and null CRC; empty texts another. Repeated rows are rows of their
    own, with slots of their own. Empty input gives no rows; fewer groups than shards leave shards empty.
    """
    key = text_key()
    base = saved(with_text_key(docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__t")), "__t", overhead).drop("__t"))
    groups = base.groupBy(*key).agg(F.sum("__size").alias("bytes"), F.count("*").alias("n"))
    seen = groups.agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("rows")).first()
    share = max(1.0, (seen["bytes"] or 0) / n_shards)
    pieces = F.when((F.col("bytes") > share) & (F.col("n") > 1), F.ceil(F.col("bytes") * 10 / share)).otherwise(1)
    # at most CELLS_PER_SHARD * n_shards groups weigh so much, whatever the input
    large = groups.filter(F.col("bytes") > share / CELLS_PER_SHARD).select(*key, pieces.cast("int").alias("__cut"))
    own = F.xxhash64(*key, F.when(F.col("__cut") > 1, F.pmod(F.xxhash64("__id"), F.col("__cut"))).otherwise(F.lit(0)))
    dealt = F.xxhash64(F.pmod(F.xxhash64(*key), F.lit(CELLS_PER_SHARD * n_shards)))
    celled = null_safe(base, F.broadcast(large), key, "left").withColumn("__cell", F.when(F.col("__cut").isNull(), dealt).otherwise(own)).drop("__cut")
    cells = celled.groupBy("__cell").agg(F.sum("__size").alias("bytes"))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "__cell"], ascending=False, kind="stable").reset_index(drop=True)
        parts = np.zeros((len(pdf), n_shards), np.int64)
        parts[:, 0] = pdf["bytes"]
        return pd.DataFrame({"__cell": pdf["__cell"], "shard": difference(parts)[0][:, 0].astype(np.int32)})

    home = saved(cells.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(place, "__cell long, shard int"))
    lots = tasks_for(seen["rows"] or 0, ROWS_PER_LOT)
    put = celled.join(F.broadcast(home), "__cell").withColumn("__lot", F.pmod(F.xxhash64("__id", "__h", F.lit(7)), F.lit(lots)).cast("int"))
    before = put.groupBy("shard", "__lot").count().withColumn("__before", F.sum("count").over(Window.partitionBy("shard").orderBy("__lot").rowsBetween(Window.unboundedPreceding, -1)))
    at = F.row_number().over(Window.partitionBy("shard", "__lot").orderBy("__id", "__h", "__crc", "__size"))
    return (
        put.withColumn("__at", at)
        .join(before.select("shard", "__lot", "__before"), ["shard", "__lot"])
        .select(
            F.col("__id").alias(id_col),
            F.col("__size").alias("size"),
            F.col("__crc").alias("text_crc32"),
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("__at") - 1 + F.coalesce("__before", F.lit(0))).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            F.col("__h").alias("text_xxh64"),
        )
    )


def shard_documents(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``; each row's bytes are shuffled once, to meet its place.

    Rows meet by id and text hash; rows alike in both are told apart by a number in order of all their columns. Own
    columns of these names are replaced.
    """
    places = shard_by_bytes(docs, n_shards, id_col, text, **options).select(F.col(id_col).alias("__id"), F.col("text_xxh64").alias("__h"), "shard", "slot")
    like = Window.partitionBy("__id", "__h")
    places = places.withColumn("__n", F.row_number().over(like.orderBy("shard", "slot")))
    docs = docs.drop("shard", "slot")
    rows = docs.withColumns({"__id": F.col(id_col), "__h": F.when(F.col(text).isNotNull(), F.xxhash64(F.col(text))), "__tie": row_tie(docs)})
    rows = rows.withColumn("__n", F.row_number().over(like.orderBy("__tie"))).drop("__tie")
    return null_safe(rows, places, ["__id", "__h", "__n"]).drop("__id", "__h", "__n")
