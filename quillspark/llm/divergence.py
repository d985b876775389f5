"""Source divergence audit: how the words of each source differ from those of its language and of its other sources.

Integer-dictionary encoding: the kept terms of a chunk are one sorted array, terms become their places in it
(``searchsorted``) and counts are a ``bincount`` for each group. Places keep the order of UTF-8 bytes, so chunk vectors
are dense and ties are broken by the place itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import CHUNK_BYTES, LOWER, give_back, hot_join, row_pieces, saved, text_slices, word_bounds

#: Bytes between terms: all of ASCII but letters.
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Bytes of text that are counted in one step.
STEP_BYTES = 4 * CHUNK_BYTES
#: Terms, and counts (terms times sources), of one chunk, and pairs of sources of one unit of work.
TERMS, CELLS, PAIRS = 2048, 1 << 20, 1 << 20
#: Shares are whole parts of this many.
SCALE = 1_000_000_000


def _strings(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The terms of ``data``, which holds nothing else but the bytes between them."""
    letters = LOWER[data[~BETWEEN[data]]]
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(letters))


def _counted(texts: pa.Array, group: np.ndarray):
    """Yields (group, term, occurrences, documents) of slices of the texts."""
    for first, data, offsets in text_slices(texts, STEP_BYTES):
        if len(offsets) == 2 and offsets[1] > STEP_BYTES:  # one very long text: its pieces are added up before it counts as a document
            held: pa.Table | None = None
            for _, _, piece, starts, ends in row_pieces(data, int(offsets[1]), BETWEEN):
                part = pa.table({"term": _strings(piece[:-8], ends - starts), "n": pa.array(np.ones(len(starts), np.int64))})
                part = part.group_by("term").aggregate([("n", "sum")]).rename_columns(["term", "n"])
                held = part if held is None else pa.concat_tables([held, part]).group_by("term").aggregate([("n", "sum")]).rename_columns(["term", "n"])
            if held is not None and held.num_rows:
                yield np.full(held.num_rows, group[first]), held.column("term").combine_chunks(), held.column("n").to_numpy(), np.ones(held.num_rows, np.int64)
            continue
        starts, ends, of = word_bounds(data, offsets, BETWEEN)
        if not len(starts):
            continue
        encoded = _strings(data[: int(offsets[-1])], ends - starts).dictionary_encode()
        size = len(encoded.dictionary)
        row = np.repeat(np.arange(len(of) - 1), np.diff(of))
        in_row, n = np.unique(row * size + np.asarray(encoded.indices), return_counts=True)
        in_group, at = np.unique(group[first + in_row // size] * size + in_row % size, return_inverse=True)
        yield in_group // size, encoded.dictionary.take(pa.array(in_group % size)), np.bincount(at, n).astype(np.int64), np.bincount(at)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with the term, of every group of ``docs`` (lang, source, text)."""

    def run(batches):
        for batch in batches:
            lang, source = (batch.column(i).dictionary_encode() for i in (0, 1))
            wide = max(1, len(source.dictionary))
            group = np.asarray(lang.indices).astype(np.int64) * wide + np.asarray(source.indices)
            for g, term, n, in_docs in _counted(batch.column(2), group):
                names = [lang.dictionary.take(pa.array(g // wide)), source.dictionary.take(pa.array(g % wide)), term, pa.array(n), pa.array(in_docs.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(names, names=["lang", "source", "term", "n", "docs"])
        give_back()

    counted = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 5) / (total + 5 * kept)), by long division in steps of 1000, which no count overflows."""
    below = total + 5 * kept
    whole, rest = np.divmod(counts + 5, below)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, below)
        whole = whole * 1000 + digit
    return whole + 1


def chunk_parts(rows: pa.Table, groups: pa.Table, ranks: int, block: int, blocks: int) -> tuple[pa.Table, pa.Table]:
    """Partial sums of |p - q| of pairs of sources (the ``block``-th part of them), and each source's first terms, in one chunk.

    ``rows`` (source, term, n) are the chunk's counts; ``groups`` (source, total, lang_total, kept) all sources of the language.
    """
    order = pc.sort_indices(groups.column("source"))
    groups = groups.take(order)
    sources = groups.column("source").combine_chunks()
    total = groups.column("total").to_numpy()
    kept = groups.column("kept")[0].as_py()
    terms = pc.unique(rows.column("term")).take(pc.sort_indices(pc.unique(rows.column("term"))))
    words = np.array(terms.cast(pa.binary()).to_pylist(), object)
    encoded = rows.column("term").combine_chunks().dictionary_encode()
    ids = np.searchsorted(words, np.array(encoded.dictionary.cast(pa.binary()).to_pylist(), object))[np.asarray(encoded.indices)] if len(words) else np.zeros(0, np.int64)
    at = np.asarray(pc.index_in(rows.column("source").combine_chunks(), sources)).astype(np.int64)
    counts = np.zeros((len(sources), len(words)), np.int64)
    n = rows.column("n").to_numpy()
    for g in np.unique(at):
        mine = at == g
        counts[g] = _added(ids[mine], n[mine], len(words))
    p = shares(counts, total[:, None], kept) if len(words) else counts
    q = shares(counts.sum(axis=0), groups.column("lang_total").to_numpy()[:1], kept) if len(words) else np.zeros(0, np.int64)
    a, b, value = [], [], []
    for g in range(block, len(sources), blocks):
        others = np.arange(g + 1, len(sources))
        a.append(np.full(len(others), g)), b.append(others)
        value.append(np.abs(p[g + 1 :] - p[g]).sum(axis=1))
    pairs = pa.table({"source": sources.take(pa.array(np.concatenate(a) if a else [], pa.int64())), "item": sources.take(pa.array(np.concatenate(b) if b else [], pa.int64())), "value": pa.array(np.concatenate(value) if value else [], pa.int64())})
    a, b, value = [], [], []
    for g in range(len(sources) if block == 0 else 0):
        more = p[g] - q
        some = np.flatnonzero((counts[g] > 0) & (more > 0))
        some = some[np.lexsort((some, -more[some]))[:ranks]]
        a.append(np.full(len(some), g)), b.append(some), value.append(more[some])
    tops = pa.table({"source": sources.take(pa.array(np.concatenate(a) if a else [], pa.int64())), "item": terms.take(pa.array(np.concatenate(b) if b else [], pa.int64())), "value": pa.array(np.concatenate(value) if value else [], pa.int64())})
    return pairs, tops


def _added(ids: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Sum of ``n`` for each id; in two halves, as ``bincount`` adds doubles."""
    high, low = np.bincount(ids, n >> 26, size), np.bincount(ids, n & ((1 << 26) - 1), size)
    return (high.astype(np.int64) << 26) + low.astype(np.int64)


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 30, ranks: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): what sets each source of a language apart, in exact whole numbers.

    A language keeps the terms in at least ``least_docs`` of its rows. A group's share of a kept term is
    ``shares(count, sum of its counts, number of kept terms)``. Part ``pair`` has for each other source of the language
    the sum of differences over all kept terms (0 if none is kept), part ``term`` the ``ranks`` terms whose share in the
    source exceeds that in the language most. Ranks go by value downwards, then by UTF-8 bytes of the item.

    Null texts, languages and sources count as empty strings, so they form groups like any other; a group without terms has
    its pairs; no rows give no rows. Each row is a document, repeated rows too. Other columns are not read.

    Work is dealt by chunks of a language's kept terms (by hash), ``TERMS`` of them, or as many as make ``CELLS`` counts; a chunk meets all
    sources of its language, and hands on sums for each pair and ``ranks`` terms a source. So no task holds a
    language, a source or a vocabulary; counts are combined where texts are read, before anything is shuffled.
    """
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    everywhere = Window.partitionBy("lang", "term")
    marked = term_counts(read).withColumns({"in_docs": F.sum("docs").over(everywhere), "head": (F.min("source").over(everywhere) == F.col("source")).cast("long")})
    counts = saved(marked.filter(F.col("in_docs") >= least_docs).select("lang", "source", "term", "n", "head"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("head").alias("kept"))
    groups = saved(read.groupBy("lang", "source").agg(F.count("*").alias("rows")).join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept")))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("kept").alias("kept"), F.count("*").alias("sources"))
    wide = F.greatest(F.lit(1), F.least(F.lit(TERMS), F.floor(F.lit(CELLS) / F.col("sources"))))
    langs = saved(langs.withColumns({"chunks": F.greatest(F.lit(1), F.ceil(F.col("kept") / wide)), "blocks": F.ceil(F.col("sources") / F.greatest(F.lit(1), F.floor(F.lit(PAIRS) / F.col("sources"))))}))
    spread = hot_join(counts.drop("head"), langs.select("lang", "chunks", "blocks"), ["lang"])
    spread = spread.select("lang", F.pmod(F.xxhash64("term"), F.col("chunks")).alias("chunk"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", "term", "n")
    beside = groups.drop("kept").join(langs, "lang").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    beside = beside.select("lang", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", "total", "lang_total", "kept", "blocks")
    keys = ["lang", "chunk", "block"]

    def unit(rows: pa.Table, sources: pa.Table) -> pa.Table:
        pairs, tops = chunk_parts(rows, sources, ranks, sources.column("block")[0].as_py(), sources.column("blocks")[0].as_py())
        both = [t.append_column("part", pa.array([part] * t.num_rows, pa.string())) for t, part in ((pairs, "pair"), (tops, "term"))]
        out = pa.concat_tables(both)
        named = sources.column("lang")[0].as_py()
        return pa.table({"lang": pa.array([named] * out.num_rows, pa.string()), **{c: out.column(c) for c in ("source", "part", "item", "value")}})

    parts = saved(spread.groupBy(*keys).cogroup(beside.groupBy(*keys)).applyInArrow(unit, "lang string, source string, part string, item string, value long"))
    whole = parts.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    both_ways = whole.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("p"), "part", "value").select("lang", "p.source", "part", "p.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = both_ways.withColumn("rank", F.row_number().over(order))
    return ranked.unionByName(parts.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ranks))
