"""SimHash near-duplicates: fingerprints linked through masked upper nodes and Gray-ordered hierarchical indexes."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import CHUNK_BYTES, LOWER, give_back, joined_words, local_roots, mixed, null_safe, row_pieces, row_tie, saved, tasks_for, text_slices, word_bounds, xxh64_slices
from .components import components
from .substring import bitmap, has
from .verify import verified_components

#: Blocks of an upper node's open bits; two fingerprints within 4 bits agree in at least BLOCKS - 4 of them.
BLOCKS = 6
#: Fingerprints of one masked pattern that are indexed at once; more are joined block by block.
NODE_LIMIT = 8192
#: Children of a node of the hierarchical index; node pairs that are expanded at once.
FANOUT, PAIRS_AT_ONCE = 8, 200_000
#: Keyed rows that one task indexes.
ROWS_PER_TASK = 250_000


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set."""
    out = np.zeros(64, np.int64)
    for lo in range(0, len(h), 65536):
        out += np.unpackbits(h[lo : lo + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return out


def shingle_pieces(data: np.ndarray, size: int, shingle: int):
    """Yields the hashes of the word shingles of one text, very long ones piece by piece; fewer words make one shingle."""
    for _, word, piece, starts, ends in row_pieces(data, size, overlap=shingle - 1):
        n = min(shingle, len(starts)) if not word else shingle
        if not len(starts) or len(starts) < n:
            continue
        buffer, starts, ends = joined_words(np.concatenate([LOWER[piece[:-8]], piece[-8:]]), starts, ends)
        yield xxh64_slices(buffer, starts[: len(starts) - n + 1], ends[n - 1 :] - starts[: len(starts) - n + 1])


def fingerprint_rows(data: np.ndarray, offsets: np.ndarray, shingle: int = 4) -> np.ndarray:
    """64-bit SimHash of each row of a slice of texts."""
    data = np.concatenate([LOWER[data[:-8]], data[-8:]])
    starts, ends, of = word_bounds(data, offsets)
    out = np.zeros(len(offsets) - 1, np.uint64)
    if not len(starts):
        return out
    buffer, starts, ends = joined_words(data, starts, ends)
    words = np.diff(of)
    number = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    first = np.cumsum(number) - number
    inside = np.arange(int(number.sum())) - np.repeat(first, number)
    begin = np.repeat(of[:-1], number) + inside
    finish = begin + np.repeat(np.minimum(words, shingle), number) - 1
    h = xxh64_slices(buffer, starts[begin], ends[finish] - starts[begin])
    some = np.flatnonzero(number)
    for lo in range(0, len(some), 4096):
        rows = some[lo : lo + 4096]
        a, b = first[rows[0]], first[rows[-1]] + number[rows[-1]]
        bits = np.unpackbits(h[a:b].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, first[rows] - a, axis=0, dtype=np.int64)
        out[rows] = np.packbits(counts * 2 > number[rows, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """(__id, __h, __fp) of every row: XXH64 of the text as it is, and the SimHash of its word shingles as a signed long."""
    read = docs.select(F.col(id_col).alias("__id"), F.when(F.col(text).isNotNull(), F.xxhash64(F.col(text))).alias("__h"), F.col(text).alias("__t"))

    def run(batches):
        for batch in batches:
            fp = np.zeros(batch.num_rows, np.uint64)
            for first, data, offsets in text_slices(batch.column(2)):
                if len(offsets) == 2 and offsets[1] > CHUNK_BYTES:
                    count, number = np.zeros(64, np.int64), 0
                    for h in shingle_pieces(data, int(offsets[1]), shingle):
                        count, number = count + bit_counts(h), number + len(h)
                    fp[first] = np.packbits(count * 2 > number, bitorder="little").view("<u8")[0]
                else:
                    fp[first : first + len(offsets) - 1] = fingerprint_rows(data, offsets, shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], names=["__id", "__h", "__fp"])

    return read.mapInArrow(run, read.schema.__class__([read.schema["__id"], read.schema["__h"]]).add("__fp", "long"))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code in Gray order; codes that share their top bits stay together."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def near_pairs(codes: np.ndarray, group: np.ndarray, most: int):
    """Yields index pairs (i, j) within a group whose codes differ in at most ``most`` bits.

    ``codes`` are sorted by group and Gray rank. Runs of FANOUT neighbours form nodes, runs of nodes upper nodes; a
    node keeps the bits in which all below agree. Two nodes whose shared bits differ too often are dropped with all
    that is below; the others are opened.
    """
    levels, owner, low, high = [], group, codes, codes
    while True:
        place = np.arange(len(owner))
        begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        inside = place - np.repeat(begin, np.diff(np.append(begin, len(owner))))
        cut = np.flatnonzero(inside % FANOUT == 0)
        low, high, above = np.bitwise_and.reduceat(low, cut), np.bitwise_or.reduceat(high, cut), owner[cut]
        levels.append((low, ~(low ^ high), np.append(cut, len(owner))))
        if len(cut) == len(begin):
            break
        owner = above
    top = np.arange(len(levels[-1][0]))
    stack = [(len(levels) - 1, top, top)]
    while stack:
        level, a, b = stack.pop()
        if len(a) > PAIRS_AT_ONCE:
            half = len(a) // 2
            stack += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
            continue
        value, shared, cut = levels[level]
        near = np.bitwise_count((value[a] ^ value[b]) & shared[a] & shared[b]) <= most
        a, b = a[near], b[near]
        na, nb = cut[a + 1] - cut[a], cut[b + 1] - cut[b]
        number = na * nb
        inside = np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number)
        wide = np.repeat(nb, number)
        i, j = np.repeat(cut[a], number) + inside // wide, np.repeat(cut[b], number) + inside % wide
        keep = (i < j) if level == 0 else (i <= j)
        i, j = i[keep], j[keep]
        if level:
            stack.append((level - 1, i, j))
        else:
            keep = np.bitwise_count(codes[i] ^ codes[j]) <= most
            yield i[keep], j[keep]


def node_masks(blocks: int, same: int) -> list[int]:
    """Masks of the upper nodes: ``same`` of the ``blocks`` runs of the 64 bits."""
    runs = [sum(1 << int(b) for b in part) for part in np.array_split(np.arange(64), blocks)]
    return [sum(c) for c in combinations(runs, same)]


def _keyed(codes: DataFrame, blocks: int, same: int) -> DataFrame:
    """Rows (node, fp): each code under every masked pattern that a near code may share with it."""

    def run(batches):
        for batch in batches:
            fp = np.asarray(batch.column(0)).view(np.uint64)
            for mask in node_masks(blocks, same):
                node = mixed(mixed(fp & np.uint64(mask)) ^ np.uint64(mask))
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), batch.column(0)], names=["node", "fp"])

    return codes.mapInArrow(run, "node long, fp long")


def _linked(keyed: DataFrame, tasks: int, most: int, limit: int | None) -> DataFrame:
    """Rows (a, b, node, fp): links found within nodes, as a forest; or rows of nodes over ``limit``, as they came."""

    def run(batches):
        def out(a, b, over=None):
            none = pa.nulls(len(a) if over is None else len(over[0]), pa.int64())
            left = [pa.array(x.view(np.int64)) for x in (a, b)] + [none] * 2 if over is None else [none] * 2 + [pa.array(x.view(np.int64)) for x in over]
            return pa.RecordBatch.from_arrays(left, names=["a", "b", "node", "fp"])

        def index(node, fp):
            _, group, size = np.unique(node, return_inverse=True, return_counts=True)
            some = size[group] > 1
            group, fp = group[some], fp[some]
            if not len(fp):
                return None
            order = np.lexsort((gray_rank(fp), group))
            group, fp = group[order], fp[order]
            found = [x for x in near_pairs(fp, group, most) if len(x[0])]
            if not found:
                return None
            i, j = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
            root = local_roots(len(fp), i, j)
            member = np.flatnonzero(root != np.arange(len(fp)))
            return out(fp[root[member]], fp[member])

        empty = np.zeros(0, np.uint64)
        held, over = (empty, empty), None
        for batch in batches:
            held = tuple(np.concatenate([h, np.asarray(batch.column(i)).view(np.uint64)]) for i, h in enumerate(held))
            if not len(held[0]):
                continue
            last = held[0][-1]
            cut = int(np.flatnonzero(held[0] != last)[-1]) + 1 if (held[0] != last).any() else 0
            done, held = tuple(x[:cut] for x in held), tuple(x[cut:] for x in held)
            for part, ended in ((done, True), (held, False)):
                if not len(part[0]):
                    continue
                node, group, size = np.unique(part[0], return_inverse=True, return_counts=True)
                big = size > limit if limit else np.zeros(len(size), bool)
                if over is not None:
                    big |= node == over
                if big.any():
                    yield out(None, None, tuple(x[big[group]] for x in part))
                    rest = tuple(x[~big[group]] for x in part)
                    if not ended:
                        over = last
                        held = rest
                    part = rest
                if ended and len(part[0]) and (made := index(part[0], part[1])) is not None:
                    yield made
        if len(held[0]) and (made := index(held[0], held[1])) is not None:
            yield made

    return keyed.repartition(tasks, "node").sortWithinPartitions("node").mapInArrow(run, "a long, b long, node long, fp long")


def near_codes(codes: DataFrame, fp: str = "fp", most: int = 4, limit: int = NODE_LIMIT) -> DataFrame:
    """Edges (a, b) between distinct 64-bit codes, whose closure links all that differ in at most ``most`` bits.

    Each code goes under the masked patterns of the pairs of its six bit blocks: two near codes share at least one.
    The codes of a pattern are sorted by Gray rank, indexed and joined with themselves in one task. The codes of a pattern
    with over ``limit`` are dealt into blocks of half that, each joined with itself and each other: no task holds more
    than the limit, and nothing is dropped. Links come as forests, not as all pairs.
    """
    blocks, same = most + 2, 2
    rows = codes.select(F.col(fp).cast("long").alias("fp")).distinct()
    tasks = tasks_for(rows.count() * blocks * (blocks - 1) // 2, ROWS_PER_TASK)
    step = saved(_linked(_keyed(rows, blocks, same), tasks, most, limit))
    edges, over = step.filter("a is not null").select("a", "b"), step.filter("a is null").select("node", "fp")
    if not over.isEmpty():
        units = saved(_linked(in_blocks(over, "node", "fp", limit), tasks, most, None))
        edges = edges.union(units.select("a", "b"))
    return edges.distinct()


def in_blocks(rows: DataFrame, group: str, member: str, limit: int) -> DataFrame:
    """Rows of too large groups, each in the units of its block with every block: ``group`` then names the unit."""
    sizes = rows.groupBy(group).agg(F.ceil(F.count("*") * 2 / limit).cast("int").alias("__k"))
    own = rows.join(sizes, group).withColumn("__own", F.pmod(F.xxhash64(member), F.col("__k")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("__k") - 1), lambda j: F.xxhash64(group, F.least(j, F.col("__own")), F.greatest(j, F.col("__own"))))
    return own.withColumn("__unit", F.explode(meets)).select(F.col("__unit").alias(group), *[c for c in rows.columns if c != group])


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4, most: int = 4) -> DataFrame:
    """(__id, __h, __fp, component_id) for every row of ``docs``; component_id is the smallest id of its component.

    Texts are lower-cased (A-Z) and cut at white space; fewer words than ``shingle`` make one shingle; null, empty and
    blank texts have fingerprint zero and are linked like any other. Equal fingerprints are one node, so copies in any
    number cost one row. Repeated rows stay. Rows with a null id link, but only known ids name a component.
    """
    marked = saved(fingerprints(docs, id_col, text, shingle))
    codes = saved(marked.groupBy("__fp").agg(F.min("__id").alias("__low")))
    roots = components(near_codes(codes, "__fp", most))
    linked = codes.join(roots, codes["__fp"] == roots["node"]).select("__fp", "__low", "root")
    low = linked.groupBy("root").agg(F.min("__low").alias("__min"))
    named = linked.join(low, "root").select(F.col("__fp").alias("__f"), "__min")
    alone = codes.join(roots, codes["__fp"] == roots["node"], "left_anti").select(F.col("__fp").alias("__f"), F.col("__low").alias("__min"))
    return marked.join(named.union(alone), marked["__fp"] == F.col("__f")).select("__id", "__h", "__fp", F.col("__min").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each near-duplicate group of ``docs``: that with the smallest id (of these, with the smallest text
    hash, then the smallest hash of all columns)."""
    classes = saved(simhash_classes(docs, id_col, text, **options))
    kept = classes.filter(F.col("__id").eqNullSafe(F.col("component_id"))).groupBy("__fp", "component_id").agg(F.min(F.struct("__id", "__h")).alias("k"))
    kept = kept.groupBy("component_id").agg(F.min("k").alias("k")).select(F.col("k.__id").alias("__id"), F.col("k.__h").alias("__h"), F.lit(1).alias("__n"))
    rows = docs.withColumns({"__id": F.col(id_col), "__h": F.when(F.col(text).isNotNull(), F.xxhash64(F.col(text)))})
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("__id", "__h").orderBy(row_tie(docs)))).filter("__n = 1")
    return null_safe(rows, kept, ["__id", "__h"]).select(docs.columns)


# --- texts by similarity: a wide fingerprint finds, exact similarity decides ---------------------------------------

#: Words of a wide fingerprint; most bits of all 256, and of the first 64, in which texts of similarity 0.8 are looked for: 39
#: differ on average, 48 in short texts, with a deviation of 6. Texts without likeness differ in 128, deviation 8: none of them comes so near.
WIDE_WORDS, WIDE_MOST, WIDE_FIRST = 4, 70, 24
#: Share of the bits that differ, for which masks are counted, and what part of such pairs they must find, whatever the number of bits in a mask.
WIDE_SHARE, WIDE_RECALL = 0.17, 0.99


def _shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; fewer words make one."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_pieces(np.frombuffer(text + bytes(8), np.uint8), len(text), size)]))


def wide_fingerprints(texts, size: int) -> np.ndarray:
    """SimHash of WIDE_WORDS words of the distinct shingles of each text; zero without words."""
    out = np.zeros((len(texts), WIDE_WORDS), np.uint64)
    for i, t in enumerate(texts):
        x = h = _shingles(t, size)
        for k in range(WIDE_WORDS):
            if len(h):
                out[i, k] = np.packbits(bit_counts(x) * 2 > len(h), bitorder="little").view("<u8")[0]
                x = mixed(x ^ np.uint64(0x5851F42D4C957F2D))
    return out


def wide_masks(number: int) -> list[tuple[int, int]]:
    """Masks of random bits: as many bits as leave few codes a pattern, as many masks as give the recall."""
    bits = min(28, max(12, int(number).bit_length() - 10))
    share = np.array([comb(128, d) * WIDE_SHARE**d * (1 - WIDE_SHARE) ** (128 - d) for d in range(129 - bits)])
    apart = 1 - np.array([comb(128 - d, bits) / comb(128, bits) for d in range(129 - bits)])
    masks = 1
    while (share * (1 - apart**masks)).sum() < WIDE_RECALL:
        masks += 1
    draw = np.random.default_rng(1234)
    out = []
    for _ in range(masks):
        chosen = draw.permutation(128)[:bits]
        out.append((sum(1 << int(b) for b in chosen if b < 64), sum(1 << int(b - 64) for b in chosen if b >= 64)))
    return out


def near_text_classes(docs: DataFrame, text: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """(node, root) of texts with others of Jaccard similarity ``least`` or more, over lower-cased word shingles.

    A node is a text's XXH64; texts without words are node 0. Distinct texts get 256-bit fingerprints and go under
    masked patterns of random bits of the first 128 (two texts of similarity 0.8 share one with probability WIDE_RECALL).
    The codes of a pattern are sorted by Gray rank and joined with themselves through their hierarchical index; a pattern
    with over NODE_LIMIT codes goes on in blocks, each with each. What differs in few enough bits is verified exactly.
    """
    t = F.col(text)
    read = docs.filter(t.isNotNull()).select(F.xxhash64(t).alias("node"), t.alias("t"))

    def sign(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                code = wide_fingerprints([x.as_py() for x in part.column(1).cast(pa.binary())], shingle)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(np.ascontiguousarray(code[:, k]).view(np.int64)) for k in range(WIDE_WORDS))], names=["node", *names])
        give_back()

    names = [f"w{k}" for k in range(WIDE_WORDS)]
    words = ", ".join(f"{c} long" for c in names)
    codes = saved(read.mapInArrow(sign, f"node long, {words}").filter(" or ".join(f"{c} <> 0" for c in names)).distinct())
    number = codes.count()
    masks = wide_masks(number)

    def keyed(batches):
        for batch in batches:
            one, two = (np.asarray(batch.column(i)).view(np.uint64) for i in (1, 2))
            for i, (a, b) in enumerate(masks):
                key = mixed(mixed(np.uint64(i + 1) ^ (one & np.uint64(a))) ^ (two & np.uint64(b)))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *batch.columns], names=["up", *batch.schema.names])

    shape = f"up long, node long, {words}"
    tasks = tasks_for(number * len(masks), ROWS_PER_TASK)
    step = saved(codes.select("node", *names).mapInArrow(keyed, shape).repartition(tasks, "up").sortWithinPartitions("up").mapInArrow(_wide_links(NODE_LIMIT), "a long, b long, " + shape).distinct())
    pairs = step.filter("a is not null").select(F.col("a").alias("node"), F.col("b").alias("low"))
    over = step.filter("a is null").select("up", "node", *names)
    if not over.isEmpty():
        units = in_blocks(over, "up", "node", NODE_LIMIT)
        blocks = saved(units.repartition("up").sortWithinPartitions("up").mapInArrow(_wide_links(None), "a long, b long, " + shape).distinct())
        pairs = pairs.union(blocks.select(F.col("a").alias("node"), F.col("b").alias("low")))
    # one row a node: its family's least node stands for all that it met under the masks
    family = components(pairs.select(F.col("node").alias("a"), F.col("low").alias("b")))
    pairs = saved(family.filter("node <> root").select("node", F.col("root").alias("low")))
    wanted = saved(pairs.select("node").union(pairs.select("low")).distinct())
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.withColumnRenamed("node", "anchor")))

    def some(batches):
        for batch in batches:
            yield batch.filter(pa.array(has(sent.value, np.asarray(batch.column(0)).view(np.uint64))))

    texts = read.mapInArrow(some, read.schema).join(wanted, "node", "left_semi").groupBy("node").agg(F.min("t").alias("text"))
    return verified_components(pairs, saved(texts), lambda x: _shingles(x.encode(), shingle), least)


def _wide_links(limit: int | None):
    """Of rows sorted by pattern: (a, b) links of codes within WIDE_MOST bits, b the least node of those linked; or rows of
    patterns over the limit, as they came."""

    def out(a, b, over=None):
        none = pa.nulls(len(a) if over is None else len(over[0]), pa.int64())
        left = [pa.array(x.view(np.int64)) for x in (a, b)] + [none] * (2 + WIDE_WORDS) if over is None else [none] * 2 + [pa.array(x.view(np.int64)) for x in over]
        return pa.RecordBatch.from_arrays(left, names=["a", "b", "up", "node", *(f"w{k}" for k in range(WIDE_WORDS))])

    def index(up, node, *words):
        one = words[0]
        _, group, size = np.unique(up, return_inverse=True, return_counts=True)
        order = np.lexsort((gray_rank(one), group))
        order = order[size[group[order]] > 1]
        if not len(order):
            return None
        group, node, words = group[order], node[order], [w[order] for w in words]
        found = []
        for i, j in near_pairs(words[0], group, WIDE_FIRST):
            close = sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int64) for w in words) <= WIDE_MOST
            found.append((i[close], j[close]))
        i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        if not len(i):
            return None
        root = local_roots(len(node), i, j)
        low = np.full(len(node), np.iinfo(np.int64).max, np.int64)
        np.minimum.at(low, root, node.view(np.int64))
        member = np.flatnonzero((low[root] != node.view(np.int64)) & (np.bincount(root, minlength=len(node))[root] > 1))
        return out(node[member], low[root[member]].view(np.uint64))

    def run(batches):
        empty = np.zeros(0, np.uint64)
        held, over = (empty,) * (2 + WIDE_WORDS), None
        for batch in batches:
            held = tuple(np.concatenate([h, np.asarray(batch.column(i)).view(np.uint64)]) for i, h in enumerate(held))
            if not len(held[0]):
                continue
            last = held[0][-1]
            cut = int(np.flatnonzero(held[0] != last)[-1]) + 1 if (held[0] != last).any() else 0
            done, held = tuple(x[:cut] for x in held), tuple(x[cut:] for x in held)
            for part, ended in ((done, True), (held, False)):
                if not len(part[0]):
                    continue
                _, group, size = np.unique(part[0], return_inverse=True, return_counts=True)
                big = (size > limit)[group] if limit else np.zeros(len(group), bool)
                if over is not None:
                    big |= part[0] == over
                if big.any():
                    yield out(None, None, tuple(x[big] for x in part))
                    part = tuple(x[~big] for x in part)
                    if not ended:
                        over, held = last, part
                if ended and len(part[0]) and (made := index(*part)) is not None:
                    yield made
        if len(held[0]) and (made := index(*held)) is not None:
            yield made
        give_back()

    return run


def drop_near_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """One row of each group of near-duplicate texts of ``docs``: that with the smallest id (null last), then text hash,
    then hash of all columns.

    Texts count as near by ``near_text_classes``; all texts without words, null ones too, are one group.
    """
    t = F.col(text)
    blank = F.coalesce(F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]")), F.lit(0)) == 0
    h = F.when(t.isNotNull(), F.xxhash64(t))
    marked = docs.select(F.col(id_col).alias("__id"), h.alias("__h"), F.when(blank, F.lit(0)).otherwise(F.xxhash64(t)).cast("long").alias("__node"))
    firsts = saved(marked.groupBy("__node").agg(F.min(F.struct(F.col("__id").isNull().alias("no"), "__id", "__h")).alias("k")))
    roots = near_text_classes(docs.filter(~blank), text, shingle, least)
    classed = firsts.join(roots, firsts["__node"] == roots["node"], "left").select(F.coalesce("root", "__node").alias("root"), "k")
    kept = classed.groupBy("root").agg(F.min("k").alias("k")).select(F.col("k.__id").alias("__id"), F.col("k.__h").alias("__h"), F.lit(1).alias("__n"))
    rows = docs.withColumns({"__id": F.col(id_col), "__h": h})
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("__id", "__h").orderBy(row_tie(docs)))).filter("__n = 1")
    return null_safe(rows, kept, ["__id", "__h"]).select(docs.columns)
