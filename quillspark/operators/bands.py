"""Similarity join in a band of cosines: cells around pivots meet only where the triangle inequality of angles allows it."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ..storage import stored

#: Most pivots (a sample of the old vectors, all that passes the driver beside their cells' counts).
PIVOTS = 512
#: Most rows of a side in one unit of work; parts of a side that has fewer, if each gets some rows; rows by rows of one product.
UNIT_ROWS, PARTS, PART_ROWS, TILE_ROWS = 1 << 16, 8, 2048, 1024
#: Room for rounding, in radians.
SLACK = 1e-4


@dataclass(frozen=True)
class Rule:
    """What a unit of work decides about its pairs, so that pairs that nobody wants never leave it.

    ``columns`` are further columns of both sides, ``fields`` the DDL of further columns of a pair. ``judge`` takes both sides
    of a unit as tables and gives a function that is called for each tile in turn: from rows of the one side, rows of
    the other and cosines to the pairs that stay (a mask) and the further columns of these.
    """

    columns: tuple[str, ...]
    fields: str
    judge: Callable[[pa.Table, pa.Table], Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, list[np.ndarray]]]]


class SetPairs:
    """Lists of strings of both sides of a unit; tells of pairs whether their lists share one."""

    def __init__(self, one: pa.ChunkedArray, two: pa.ChunkedArray):
        flat = [pc.list_flatten(c).combine_chunks() for c in (one, two)]
        codes = pa.concat_arrays([f.cast(pa.string()) for f in flat]).dictionary_encode().indices.to_numpy()
        self.codes = codes[: len(flat[0])], codes[len(flat[0]) :]
        self.sizes = tuple(pc.fill_null(pc.list_value_length(c), 0).to_numpy() for c in (one, two))
        self.starts = tuple(np.cumsum(n) - n for n in self.sizes)

    def _of(self, side: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.sizes[side][rows]
        row = np.repeat(np.arange(len(rows)), n)
        return row, self.codes[side][np.arange(len(row)) + np.repeat(self.starts[side][rows] - (np.cumsum(n) - n), n)]

    def shared(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """For pairs of rows of one tile whether both lists have a string in common."""
        (rows, i), (cols, j) = (np.unique(x, return_inverse=True) for x in (u, v))
        (r, a), (c, b) = self._of(0, rows), self._of(1, cols)
        common = np.intersect1d(a, b)
        met = np.zeros((len(rows), len(cols)), bool)
        for lo in range(0, len(common), TILE_ROWS):
            part, sides = common[lo : lo + TILE_ROWS], []
            for row, code, n in ((r, a, len(rows)), (c, b, len(cols))):
                at = np.minimum(np.searchsorted(part, code), len(part) - 1)
                hit = part[at] == code
                has = np.zeros((n, len(part)), np.float32)
                has[row[hit], at[hit]] = 1
                sides.append(has)
            met |= sides[0] @ sides[1].T > 0
        return met[i, j]


def _unit_vectors(lists: pa.Array, size: int) -> np.ndarray:
    x = np.asarray(lists.flatten(), float).reshape(-1, size)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _pivots(old: DataFrame, most: int) -> dict[int, np.ndarray]:
    """Some of the old vectors for each length, by hash of the id: about the root of their number, ``most`` at most."""
    counts = old.groupBy("size").count().orderBy(F.desc("count"), "size").limit(16).collect()
    out = {}
    for size, count in counts:
        wanted = max(1, min(most, math.isqrt(count)))
        drawn = old.filter(F.col("size") == size).select("embedding").orderBy(F.xxhash64("id"), "id").limit(wanted).toArrow()
        p = _unit_vectors(drawn.column(0).combine_chunks(), size)
        p = p[np.linalg.norm(p, axis=1) > 0]
        if len(p):
            out[size] = p
    return out


def _angles(batch: pa.RecordBatch, pivots: dict[int, np.ndarray]):
    """Yields (size, rows, angles to the pivots), TILE_ROWS rows at a time, for each length of vectors; None for angles where it has no pivots."""
    sizes = batch.column("size").to_numpy()
    for size in np.unique(sizes).tolist():
        every = np.flatnonzero(sizes == size)
        for lo in range(0, len(every), TILE_ROWS):
            at = every[lo : lo + TILE_ROWS]
            if size not in pivots:
                yield size, at, None
                continue
            x = _unit_vectors(batch.column("embedding").take(pa.array(at)), size)
            yield size, at, np.arccos(np.clip(x @ pivots[size].T, -1, 1))


def _parts(rows: int) -> int:
    return max(-(-rows // UNIT_ROWS), min(PARTS, -(-rows // PART_ROWS)), 1)


def _in_chain(pivots: np.ndarray, cells: list[int]) -> list[int]:
    """Cells in an order in which near pivots follow each other."""
    left, chain = set(cells[1:]), cells[:1]
    while left:
        rest = sorted(left)
        chain.append(rest[int(np.argmax(pivots[rest] @ pivots[chain[-1]]))])
        left.remove(chain[-1])
    return chain


class _Layout:
    """Cells of the old vectors by length: numbers, inner and outer angle, rows, first column and number of columns.

    A column is a run of near cells, or a share of one large cell; it is one side of a unit of work.
    """

    def __init__(self, rings: list, pivots: dict[int, np.ndarray], widest: float):
        self.pivots, self.widest, self.cells, column = pivots, widest, {}, 0
        by_size: dict[int, dict] = {}
        for size, cell, inner, outer, olds in rings:
            by_size.setdefault(size, {})[cell] = (inner, outer, olds)
        for size, held in sorted(by_size.items()):
            most = -(-sum(o for _, _, o in held.values()) // _parts(sum(o for _, _, o in held.values())))
            order = _in_chain(pivots[size], sorted(held)) if -1 not in held else [-1]
            rows, filled = [], 0
            for cell in order:
                inner, outer, olds = held[cell]
                shares = -(-olds // most)
                if filled and (shares > 1 or filled + olds > most):
                    column, filled = column + 1, 0
                rows.append((cell, inner, outer, olds, column, shares))
                column, filled = (column + shares, 0) if shares > 1 else (column, filled + olds)
            column += bool(filled)
            self.cells[size] = [np.array(c) for c in zip(*rows)]

    def met(self, size: int, at: np.ndarray, angle: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(angle to the nearest pivot, mask of rows by cells that may hold a partner)."""
        cell, inner, outer = self.cells[size][:3]
        if angle is None or self.widest == math.inf:
            return np.zeros(len(at)), np.ones((len(at), len(cell)), bool)
        near = angle.min(axis=1)
        return near, self.inside(angle[:, cell], near[:, None], inner, outer)

    def inside(self, angle, near, inner, outer) -> np.ndarray:
        t = self.widest
        return (angle <= near + 2 * t) & (angle >= inner - t) & (angle <= outer + t)


def _dealt(new: DataFrame, old: DataFrame, low: float, more: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, _Layout]:
    """(new vectors, old vectors with the cell of their nearest pivot, layout of the cells).

    With t the widest angle of a pair: a partner of y in the cell of p is no farther from p than from any other pivot, so
    y is no farther from p than from its own nearest pivot plus 2 t; and its angle to p is within t of those in the
    cell. Vectors of a length without pivots, and all if ``low`` allows right angles (zero vectors), meet in one cell.
    """
    fine = lambda df: df.select("id", F.col("embedding").cast("array<double>").alias("embedding"), *more).filter("size(embedding) > 0 and not exists(embedding, x -> x is null)").withColumn("size", F.size("embedding"))
    one, two = stored(fine(new)), stored(fine(old))
    widest = math.acos(min(1.0, low)) + SLACK if low > 0 else math.inf
    pivots = _pivots(two, PIVOTS)
    sent = old.sparkSession.sparkContext.broadcast(pivots)
    dealt = StructType([*two.schema.fields, *StructType.fromDDL("cell int, angle double").fields])

    def place(batches):
        for batch in batches:
            for _, at, angle in _angles(batch, sent.value):
                part = batch.take(pa.array(at))
                cell, a = (np.full(len(at), -1), np.zeros(len(at))) if angle is None or widest == math.inf else (angle.argmin(axis=1), angle.min(axis=1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(a)], names=dealt.names)

    held = stored(two.mapInArrow(place, dealt))
    rings = held.groupBy("size", "cell").agg(F.min("angle"), F.max("angle"), F.count("*")).collect()
    return one, held, _Layout([tuple(r) for r in rings], pivots, widest)


def compared(new: DataFrame, old: DataFrame, low: float) -> tuple[int, int]:
    """(pairs that ``similar_pairs`` compares, all pairs)."""
    one, _, layout = _dealt(new, old, low)

    def count(batches):
        for batch in batches:
            for size, at, angle in _angles(batch, layout.pivots):
                if size in layout.cells:
                    yield pa.RecordBatch.from_pydict({"n": pa.array([int((layout.met(size, at, angle)[1] @ layout.cells[size][3]).sum())])})

    return int(one.mapInArrow(count, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]), new.count() * old.count()


def similar_pairs(new: DataFrame, old: DataFrame, low: float, high: float | None, digits: int = 9, rule: Rule | None = None) -> DataFrame:
    """(new_id, old_id, sim, fields of the rule) of vectors with cosine in [low, high), or from ``low`` up where ``high`` is None; another id each.

    Both sides are tables of any size: old vectors lie in cells around pivots, and near cells in columns of UNIT_ROWS rows
    at most. A new vector goes once to each column in which the band allows a cell, whatever the number of such cells, so
    what is shuffled follows the columns, not the pivots. A unit of work is a column and as many new rows; in it a
    cell meets the rows that the band allows by tiles. Single precision finds the pairs that may lie in the band, double
    precision decides.
    Vectors of other lengths, null and empty ones, and those with null components give none; a zero vector has cosine 0.
    Both sides' ids have one type. Of a ``rule`` both sides have the columns, and only pairs that it keeps come out.
    """
    more = rule.columns if rule else ()
    one, held, layout = _dealt(new, old, low, more)
    spark = held.sparkSession
    routed = StructType([*one.schema.fields, *StructType.fromDDL("near double, columns array<int>").fields])

    def route(batches):
        for batch in batches:
            for size, at, angle in _angles(batch, layout.pivots):
                if size not in layout.cells:
                    continue
                near, mask = layout.met(size, at, angle)
                first, shares = layout.cells[size][4:]
                wide = np.zeros((len(at), int((first + shares).max() - first[0])), bool)
                for c in range(len(first)):
                    wide[:, first[c] - first[0] : first[c] - first[0] + shares[c]] |= mask[:, c : c + 1]
                row, column = np.nonzero(wide)
                ends = pa.array(np.searchsorted(row, np.arange(len(at) + 1)).astype(np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array((column + first[0]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, pa.array(near), lists], names=routed.names)

    met = stored(one.mapInArrow(route, routed))
    # as many rows as columns of the layout, and as cells
    counts = met.select(F.explode("columns").alias("column")).groupBy("column").count().collect()
    grid = spark.createDataFrame([(c, _parts(n)) for c, n in counts], "column int, rows long")
    spots = spark.createDataFrame([(size, *map(int, r)) for size, c in layout.cells.items() for r in zip(c[0], c[4], c[5])], "size int, cell int, first int, shares int")
    left = met.select("id", "embedding", "size", *more, "near", F.explode("columns").alias("column")).join(F.broadcast(grid), "column").withColumn("row", F.pmod(F.xxhash64("id"), F.col("rows"))).drop("rows")
    right = held.join(F.broadcast(spots), ["size", "cell"]).withColumn("column", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("shares"))).cast("int"))
    right = right.join(F.broadcast(grid), "column").select("id", "embedding", "size", *more, "cell", "column", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("row"))
    schema = StructType([StructField("new_id", one.schema["id"].dataType), StructField("old_id", held.schema["id"].dataType), StructField("sim", DoubleType()), *(StructType.fromDDL(rule.fields).fields if rule and rule.fields else [])])
    arrow = to_arrow_schema(schema)

    def exact(dot: np.ndarray, norm: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.round(np.where(norm == 0, 0.0, np.clip(dot / norm, -1, 1)), digits) + 0.0

    def within(sim: np.ndarray, room: float = 0.0) -> np.ndarray:
        return sim >= low - room if high is None else (sim >= low - room) & (sim < high + room)

    def meet(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(rows)
        a, b = both.filter(pc.is_null(both.column("cell"))), both.filter(pc.is_valid(both.column("cell")))
        del both
        if not a.num_rows or not b.num_rows:
            return
        size = a.column("size")[0].as_py()
        x, y = (np.asarray(pc.list_flatten(t.column("embedding")), float).reshape(-1, size) for t in (a, b))
        a, b = a.drop_columns("embedding"), b.drop_columns("embedding")
        xn, yn = (np.linalg.norm(v, axis=1) for v in (x, y))
        with np.errstate(divide="ignore", invalid="ignore"):
            xf, yf = (np.where(n[:, None] > 0, v / n[:, None], 0.0).astype(np.float32) for v, n in ((x, xn), (y, yn)))
        room = (size + 8) * 2.0**-23 + 10.0**-digits
        cell, near, pivots = b.column("cell").to_numpy(), a.column("near").to_numpy(), layout.pivots.get(size)
        judge = rule.judge(a, b) if rule else None
        new_id, old_id = (t.column("id").combine_chunks() for t in (a, b))
        known = pa.chunked_array([new_id, old_id]).combine_chunks().dictionary_encode().indices.to_numpy()
        ids = known[: len(new_id)], known[len(new_id) :]
        rings = {int(c): (i, o) for c, i, o in zip(*layout.cells[size][:3])}
        order = np.argsort(cell, kind="stable")
        cuts = [0, *(np.flatnonzero(np.diff(cell[order])) + 1).tolist(), len(order)]
        out, held = [], 0
        for s, e in zip(cuts, cuts[1:]):
            c, mine = int(cell[order[s]]), np.arange(len(x))
            if c >= 0:
                angle = np.arccos(np.clip(xf @ pivots[c].astype(np.float32), -1, 1))
                # single precision: near 0 and pi an angle is off by up to some thousandths
                mine = np.flatnonzero(layout.inside(angle, near + 0.01, rings[c][0] - 0.01, rings[c][1] + 0.01))
            for p in range(0, len(mine), TILE_ROWS):
                i = mine[p : p + TILE_ROWS]
                for q in range(s, e, TILE_ROWS):
                    j = order[q : min(e, q + TILE_ROWS)]
                    u, v = np.nonzero(within(xf[i] @ yf[j].T, room))
                    if len(u) * 8 > len(i) * len(j):
                        dot = (x[i] @ y[j].T)[u, v]
                    else:
                        dot = np.einsum("ij,ij->i", x[i[u]], y[j[v]])
                    u, v = i[u], j[v]
                    sim = exact(dot, xn[u] * yn[v])
                    keep = within(sim)
                    if judge is None:
                        out.append((u[keep], v[keep], sim[keep]))
                    else:
                        keep &= ids[0][u] != ids[1][v]
                        u, v, sim = u[keep], v[keep], sim[keep]
                        stay, fields = judge(u, v, sim)
                        out.append((u[stay], v[stay], sim[stay], *fields))
                    held += len(out[-1][0])
                    if held > TILE_ROWS * TILE_ROWS:
                        yield named(out, new_id, old_id)
                        out, held = [], 0
        if held:
            yield named(out, new_id, old_id)

    def named(out: list, new_id: pa.Array, old_id: pa.Array) -> pa.RecordBatch:
        i, j, *rest = (np.concatenate(c) for c in zip(*out))
        return pa.RecordBatch.from_arrays([new_id.take(pa.array(i)), old_id.take(pa.array(j)), *map(pa.array, rest)], schema=arrow)

    units = left.withColumn("cell", F.lit(None).cast("int")).unionByName(right, allowMissingColumns=True)
    return units.groupBy("column", "row").applyInArrow(meet, schema).filter("new_id <> old_id")
