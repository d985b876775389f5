"""Embedding near-duplicates: an HNSW graph per shard, every shard queried, beams widened until audits pass."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import local_roots, mixed, saved
from .components import components

#: Shards at least; vectors of a shard at most (more vectors make more shards).
SHARDS, SHARD_ROWS = 4, 25_000
#: Links of a node on upper layers and on the ground layer; beam while building; first beam of a query.
M, M_GROUND, EF_BUILD, EF_QUERY = 12, 24, 48, 32
#: A query whose beam of this width is full of links stands in a dense group: its links are counted by matrix product.
DENSE = 256
#: Rows that move through a graph together; beam nodes opened in one step.
LOCKSTEP, OPENED = 512, 4
#: Queries whose links are held at once; dense ones; room for single precision around the threshold.
QUERIES_AT_ONCE, DENSE_AT_ONCE, SLACK = 2048, 64, 1e-5
#: Audited queries of a unit, and the share of a query's true links that a beam must find on average.
AUDITED, RECALL = 256, 0.995


class Graph:
    """Hierarchical navigable small-world graph over unit vectors, built and searched for many rows in lockstep."""

    def __init__(self, x: np.ndarray, seed: int = 1):
        self.x = x
        n = len(x)
        order = np.argsort(mixed(np.arange(n, dtype=np.uint64) + np.uint64(seed)), kind="stable")
        draw = (mixed(np.arange(n, dtype=np.uint64) ^ np.uint64(0xABCDEF)) >> np.uint64(11)).astype(float) / 2.0**53
        level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(M)).astype(int), 6)
        level[order[0]] = top = int(level.max(initial=0))
        self.level, self.entry = level, int(order[0])
        self.links = [np.full((n, M if l else M_GROUND), -1, np.int32) for l in range(top + 1)]
        done = 1
        while done < n:
            batch = order[done : done + min(max(64, done), 1024)]
            self._insert(batch)
            done += len(batch)

    def _insert(self, batch: np.ndarray) -> None:
        q = self.x[batch]
        start = np.full((len(batch), 1), self.entry, np.int32)
        near = q @ q.T
        np.fill_diagonal(near, -np.inf)
        for l in range(len(self.links) - 1, -1, -1):
            ids, _ = self.beam(q, start, EF_BUILD if l == 0 or (self.level[batch] >= l).any() else 1, l)
            start = ids[:, : min(8, ids.shape[1])]
            rows = np.flatnonzero(self.level[batch] >= l)
            if not len(rows):
                continue
            peers = rows[np.argsort(-near[np.ix_(rows, rows)], axis=1)[:, : min(16, len(rows) - 1)]] if len(rows) > 1 else np.zeros((len(rows), 0), int)
            found = np.concatenate([ids[rows], batch[peers].astype(np.int32)], axis=1)
            found = np.where(self.level[np.maximum(found, 0)] >= l, found, -1)
            self.links[l][batch[rows]] = chosen = self._select(batch[rows], found, self.links[l].shape[1])
            a, b = np.repeat(batch[rows], chosen.shape[1]), chosen.ravel()
            self._link_back(l, b[b >= 0], a[b >= 0])

    def _link_back(self, l: int, to: np.ndarray, new: np.ndarray) -> None:
        order = np.argsort(to, kind="stable")
        to, new = to[order], new[order]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        wide = int(count.max(initial=0))
        if not wide:
            return
        more = np.full((len(nodes), wide), -1, np.int32)
        more[np.repeat(np.arange(len(nodes)), count), np.arange(len(to)) - np.repeat(first, count)] = new
        self.links[l][nodes] = self._select(nodes, np.concatenate([self.links[l][nodes], more], axis=1), self.links[l].shape[1])

    def _select(self, nodes: np.ndarray, found: np.ndarray, m: int) -> np.ndarray:
        """Diverse neighbours: a candidate nearer to the node than to those taken; then the nearest of the rest."""
        out = np.full((len(nodes), m), -1, np.int32)
        for lo in range(0, len(nodes), 256):
            node, cand = nodes[lo : lo + 256], found[lo : lo + 256]
            cand = np.sort(cand, axis=1)
            cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
            cand[cand == node[:, None]] = -1
            v = self.x[np.maximum(cand, 0)]
            s = np.where(cand >= 0, np.matmul(v, self.x[node][:, :, None])[:, :, 0], -np.inf)
            order = np.argsort(-s, axis=1, kind="stable")[:, : 4 * m]
            cand, s = np.take_along_axis(cand, order, 1), np.take_along_axis(s, order, 1)
            v = np.take_along_axis(v, order[:, :, None], 1)
            between = np.matmul(v, v.transpose(0, 2, 1))
            taken, closest = np.zeros(cand.shape, bool), np.full(cand.shape, -np.inf)
            for c in range(cand.shape[1]):
                good = (cand[:, c] >= 0) & (s[:, c] > closest[:, c]) & (taken.sum(1) < m)
                taken[:, c] = good
                closest[good] = np.maximum(closest[good], between[good, c])
            rank = np.argsort(np.where(cand < 0, 2, np.where(taken, 0, 1)), axis=1, kind="stable")[:, :m]
            kept = np.take_along_axis(cand, rank, 1)
            out[lo : lo + 256, : kept.shape[1]] = kept
        return out

    def beam(self, q: np.ndarray, start: np.ndarray, ef: int, l: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the ``ef`` nearest nodes found from ``start`` on a layer, best first; -1 pads."""
        ids, sims = np.full((len(q), ef), -1, np.int32), np.full((len(q), ef), -np.inf, np.float32)
        step = max(1, min(LOCKSTEP, (16 << 20) // max(1, len(self.x))))
        for lo in range(0, len(q), step):
            ids[lo : lo + step], sims[lo : lo + step] = self._beam(q[lo : lo + step], start[lo : lo + step], ef, l)
        return ids, sims

    def _beam(self, q, start, ef, l):
        b, links = len(q), self.links[l]
        met = np.zeros((b, len(self.x)), np.int32)
        ids, sims, opened = np.full((b, ef), -1, np.int32), np.full((b, ef), -np.inf, np.float32), np.ones((b, ef), bool)
        row, node = np.nonzero(start >= 0)
        node = start[row, node]
        while len(row):
            fresh = met[row, node] == 0
            row, node = row[fresh], node[fresh]
            turn = np.arange(1, len(row) + 1, dtype=np.int32)
            met[row, node] = turn  # of a node that came twice one stays
            fresh = met[row, node] == turn
            row, node = row[fresh], node[fresh]
            s = np.einsum("ij,ij->i", q[row], self.x[node])
            better = s > sims[row, -1]
            row, node, s = row[better], node[better], s[better]
            if len(row):
                rows, first, count = np.unique(row, return_index=True, return_counts=True)
                at, inside = np.repeat(np.arange(len(rows)), count), np.arange(len(row)) - np.repeat(first, count)
                more_i, more_s = np.full((len(rows), int(count.max())), -1, np.int32), np.full((len(rows), int(count.max())), -np.inf, np.float32)
                more_i[at, inside], more_s[at, inside] = node, s
                all_s = np.concatenate([sims[rows], more_s], axis=1)
                best = np.argsort(-all_s, axis=1, kind="stable")[:, :ef]
                sims[rows] = np.take_along_axis(all_s, best, 1)
                ids[rows] = np.take_along_axis(np.concatenate([ids[rows], more_i], axis=1), best, 1)
                opened[rows] = np.take_along_axis(np.concatenate([opened[rows], more_i < 0], axis=1), best, 1)
            todo = ~opened
            pick = todo & (np.cumsum(todo, axis=1) <= OPENED)
            row, col = np.nonzero(pick)
            opened[row, col] = True
            near = links[ids[row, col]]
            row, node = np.repeat(row, near.shape[1]), near.ravel()
            row, node = row[node >= 0], node[node >= 0]
        return ids, sims

    def within(self, q: np.ndarray, least: float, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (row, node) of similarity ``least`` or more, and the rows that are dense.

        A beam that is full of links is widened; where even one of DENSE is full, the row is dense and gives no pairs.
        """
        start = np.full((len(q), 1), self.entry, np.int32)
        for l in range(len(self.links) - 1, 0, -1):
            start = self.beam(q, start, 4, l)[0]
        out_r, out_n, rows = [], [], np.arange(len(q))
        while len(rows):
            ids, sims = self.beam(q[rows], start[rows], min(ef, len(self.x)), 0)
            full = (sims[:, -1] >= least) & (ids.shape[1] < len(self.x))
            r, c = np.nonzero((sims >= least) & ~full[:, None])
            out_r.append(rows[r]), out_n.append(ids[r, c])
            rows = rows[full]
            if ef >= DENSE:
                break
            ef = min(ef * 4, DENSE)
        return np.concatenate([[], *out_r]).astype(np.int64), np.concatenate([[], *out_n]).astype(np.int64), rows


def planted(graph: Graph, queries: np.ndarray, least: float, seed: int = 7) -> np.ndarray:
    """Queries at cosine ``least`` of AUDITED nodes, each towards the nearest of ``queries`` that isn't linked with its node."""
    base = graph.x[np.argsort(mixed(np.arange(len(graph.x), dtype=np.uint64) ^ np.uint64(seed)))[:AUDITED]]
    s = base @ queries.T
    s[np.abs(s) >= least] = -np.inf
    some = np.flatnonzero(s.max(axis=1, initial=-np.inf) > -np.inf)
    base = base[some].astype(np.float64)
    aside = queries[s[some].argmax(axis=1)] if len(some) else base
    aside = aside - (aside * base).sum(1, keepdims=True) * base
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    return (least * base + np.sqrt(1 - least * least) * aside).astype(np.float32)


def audited_beam(graph: Graph, queries: np.ndarray, least: float, seed: int = 3) -> tuple[int, float]:
    """(beam, recall): the narrowest beam, doubled from EF_QUERY, that finds RECALL of what brute force finds.

    Audited are links of a sample of the queries, those with few, for which no beam widens, and those with more apart from
    them, and links planted at ``least`` between nodes and directions towards queries, which every unit has: neither a large
    group nor a sample without links hides what small families lose. Recall is that of a query, averaged. A beam of DENSE
    is the widest; the recall that it reaches is returned, and where that is too low the unit is done without the graph.
    """
    slack, ef = least - SLACK, EF_QUERY
    sample = queries[np.argsort(mixed(np.arange(len(queries), dtype=np.uint64) ^ np.uint64(seed)))[:AUDITED]]
    audits = []
    for q in (sample, planted(graph, sample, least)):
        links = (q @ graph.x.T >= slack).sum(axis=1) if len(q) else np.zeros(0, np.int64)
        for some in (np.flatnonzero((links > 0) & (links <= EF_QUERY)), np.flatnonzero((links > EF_QUERY) & (links < DENSE))):
            if len(some):
                audits.append((q[some], links[some]))

    def recall(q, truth) -> float:
        row, _, dense = graph.within(q, slack, ef)
        found = np.bincount(row, minlength=len(q))
        found[dense] = truth[dense]
        return float(np.minimum(found / truth, 1.0).mean())

    while True:
        reached = min((recall(*a) for a in audits), default=1.0)
        if reached >= RECALL or ef >= min(DENSE, len(graph.x)):
            return ef, reached
        ef *= 2


class Links:
    """Counts of links and their components for the nodes of two shards, or of one with itself, filled block by block."""

    def __init__(self, exact: np.ndarray, weights: np.ndarray, q_exact: np.ndarray, q_weights: np.ndarray, own: bool, least: float):
        self.x, self.q, self.own, self.least = exact, q_exact, own, least
        self.w, self.qw, self.shift = weights, q_weights, 0 if own else len(q_exact)
        self.count = np.zeros(self.shift + len(exact), np.int64)
        self.root = np.arange(len(self.count))

    def _union(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins a's and b's components: only their roots and these edges are looked at."""
        a, b = self.root[a], self.root[b]
        some = a != b
        if some.any():
            names, at = np.unique(np.concatenate([a[some], b[some]]), return_inverse=True)
            half = len(at) // 2
            over = np.arange(len(self.root))
            over[names] = names[local_roots(len(names), at[:half], at[half:])]
            self.root = over[self.root]

    def pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links found for queries ``a`` with nodes ``b``, verified in double precision; each pair is given once."""
        good = np.concatenate([np.zeros(0, bool), *(np.einsum("ij,ij->i", self.q[a[k : k + 65536]], self.x[b[k : k + 65536]]) >= self.least for k in range(0, len(a), 65536))])
        a, b = a[good], b[good]
        np.add.at(self.count, a, self.w[b])
        np.add.at(self.count, b + self.shift, self.qw[a])
        self._union(a, b + self.shift)

    def dense(self, rows: np.ndarray, near: np.ndarray, q32: np.ndarray, x32: np.ndarray) -> None:
        """All links of dense queries, by products of a few rows with all nodes; ``near`` marks dense nodes of one shard."""
        for lo in range(0, len(rows), DENSE_AT_ONCE):
            some = rows[lo : lo + DENSE_AT_ONCE]
            s = q32[some] @ x32.T
            link = s >= self.least
            r, c = np.nonzero(np.abs(s - self.least) < SLACK)
            link[r, c] = np.einsum("ij,ij->i", self.q[some[r]], self.x[c]) >= self.least
            if self.own:
                link[np.arange(len(some)), some] = False
            self.count[some] += link @ self.w
            back = link & ~near[None, :] if self.own else link  # dense nodes of the same shard count their own rows
            self.count[self.shift :] += self.qw[some] @ back
            for k, row in enumerate(some):
                to = np.unique(self.root[np.flatnonzero(link[k]) + self.shift])
                self._union(np.full(len(to), row), to)


def _unit(blob: bytes, dim: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    v = np.frombuffer(blob, kind).reshape(-1, dim).astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    return u, u.astype(np.float32)


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", embedding: str = "embedding", least: float = 0.95, shards: int = SHARDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``vectors``, by cosine of ``least`` or more.

    Equal vectors are one node with a weight. Nodes are dealt by hash to shards, each with an HNSW graph; every pair of
    shards is one unit of work, in which all vectors of one query the graph of the other, and candidates are verified
    in double precision. Beams widen where a query's links fill them (in the end its links are counted by products of
    a few queries with the shard, so a large group makes no pairs), and where the audit by brute force over a sample of
    a unit's queries and over links planted at ``least`` finds less than RECALL; a unit whose widest beam finds less is done by
    products of all its queries with all nodes. A unit returns a count for each node
    and a forest of its links, not its pairs. Work is the number of vectors times that of shards, and so grows with the
    square of the vectors past ``shards * shard_rows`` of them: every shard is queried.

    Null, empty and zero vectors, and those with null or non-finite components, link with nothing: no links, their own
    component, kept. Vectors of different length don't link. Repeated rows count as vectors of their own; a component's
    id is its least known one. Vectors are compared as they are stored, in single or double precision. Only the two
    named columns are read; others may have any names.
    """
    e = F.col("__e")
    fine = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    single = vectors.schema[embedding].dataType.elementType.typeName() in ("float", "byte", "short")
    held, kind = ("float", "<f4") if single else ("double", "<f8")
    rows = vectors.select(F.col(id_col).alias("__id"), F.col(embedding).cast(f"array<{held}>").alias("__e"))
    rows = rows.withColumn("__ok", F.coalesce(fine, F.lit(False)))
    key = {"__k1": F.when(F.col("__ok"), F.xxhash64("__e")), "__k2": F.when(F.col("__ok"), F.xxhash64("__e", F.lit(1)))}
    marked = rows.withColumns(key)
    nodes = saved(marked.filter("__ok").groupBy("__k1", "__k2").agg(F.min("__id").alias("rep"), F.count("*").alias("weight"), F.first("__e").alias("v")).withColumn("node", F.xxhash64("__k1", "__k2")))
    n_shards = max(shards, -(-nodes.count() // shard_rows))
    dealt = nodes.select("node", "weight", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64(F.col("node"), F.lit(5)), F.lit(n_shards)).cast("int").alias("shard"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", kind="stable")
        v = np.stack(pdf["v"].to_numpy()).astype(kind)
        graph = Graph(_unit(v.tobytes(), v.shape[1], kind)[1])
        kept = {"entry": graph.entry, "top": len(graph.links)}
        row = {"dim": v.shape[1], "shard": pdf["shard"].iloc[0], "ids": pdf["node"].to_numpy(np.int64).tobytes(), "weights": pdf["weight"].to_numpy(np.int64).tobytes(), "vectors": v.tobytes(), "entry": kept["entry"], "ground": graph.links[0].tobytes()}
        upper = [(l, np.flatnonzero(graph.level >= l).astype(np.int32)) for l in range(1, kept["top"])]
        row["upper"] = [{"ids": i.tobytes(), "links": graph.links[l][i].tobytes()} for l, i in upper]
        return pd.DataFrame([row])

    graphs = "dim int, shard int, ids binary, weights binary, vectors binary, entry int, ground binary, upper array<struct<ids:binary,links:binary>>"
    built = saved(dealt.groupBy("dim", "shard").applyInPandas(build, graphs))
    left = built.select("dim", F.col("shard").alias("i"), F.explode(F.sequence(F.col("shard"), F.lit(n_shards - 1))).alias("j"), F.col("ids").alias("q_ids"), F.col("weights").alias("q_weights"), F.col("vectors").alias("q_vectors"))
    right = built.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("shard")))).withColumnRenamed("shard", "j")
    units = left.repartition(n_shards * (n_shards + 1) // 2, "dim", "i", "j").join(right, ["dim", "i", "j"])

    def search(batches):
        for pdf in batches:
            for u in pdf.itertuples():
                exact, x = _unit(u.vectors, u.dim, kind)
                graph = Graph.__new__(Graph)
                graph.x, graph.entry, graph.links = x, u.entry, [np.frombuffer(u.ground, np.int32).reshape(-1, M_GROUND)]
                for layer in u.upper:
                    at = np.frombuffer(layer["ids"], np.int32)
                    full = np.full((len(x), M), -1, np.int32)
                    full[at] = np.frombuffer(layer["links"], np.int32).reshape(-1, M)
                    graph.links.append(full)
                own = u.i == u.j
                q_exact, q = (exact, x) if own else _unit(u.q_vectors, u.dim, kind)
                ids, weights = np.frombuffer(u.ids, np.int64), np.frombuffer(u.weights, np.int64)
                q_ids, q_weights = (ids, weights) if own else (np.frombuffer(u.q_ids, np.int64), np.frombuffer(u.q_weights, np.int64))
                ef, reached = audited_beam(graph, q, least)
                made, dense, first, second = Links(exact, weights, q_exact, q_weights, own, least), [], [], []
                if reached < RECALL:  # the graph loses links at any beam: all queries meet all nodes by products
                    dense.append(np.arange(len(q)))
                for lo in range(0, len(q) if reached >= RECALL else 0, QUERIES_AT_ONCE):
                    a, b, full = graph.within(q[lo : lo + QUERIES_AT_ONCE], least - SLACK, ef)
                    dense.append(full + lo)
                    if own:
                        first.append(a + lo), second.append(b)
                    else:
                        made.pairs(a + lo, b)
                dense, near = np.concatenate(dense), np.zeros(len(x), bool)
                if own:  # found from both ends, or from one; what a dense end has is counted there
                    near[dense] = True
                    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (first, second))
                    some = (a != b) & ~near[a] & ~near[b]
                    key = np.unique(np.minimum(a[some], b[some]) * len(x) + np.maximum(a[some], b[some]))
                    made.pairs(key // len(x), key % len(x))
                made.dense(dense, near, q, x)
                all_ids = ids if own else np.concatenate([q_ids, ids])
                some = np.flatnonzero(made.count)
                yield pd.DataFrame({"node": all_ids[some], "links": made.count[some], "other": all_ids[made.root[some]]})

    found = saved(units.mapInPandas(search, "node long, links long, other long"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    whole = nodes.select("__k1", "__k2", "node", "rep", "weight").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    low = whole.groupBy("root").agg(F.min("rep").alias("low"))
    named = whole.join(low, "root").select(F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n"), "low")
    joined = marked.select("__id", "__k1", "__k2").join(named, (F.col("__k1") == F.col("k1")) & (F.col("__k2") == F.col("k2")), "left")
    component = F.when(F.col("k1").isNull(), F.col("__id")).otherwise(F.col("low"))
    return joined.select(F.col("__id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("__id").eqNullSafe(component).alias("kept"))
