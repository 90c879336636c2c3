"""Exact nearest neighbours through pivots (2.12.1, 2.12.11).

Points are dealt to the cells of pivots (each to its nearest one). A query skips every cell
that the triangle inequality puts farther away than what it has found: no point of a cell
is nearer than the pivot less the cell's radius, nor nearer than the plane between the cell's
pivot and the query's own. What is left is compared as products of matrices, a block of
points by a chunk of queries at a time, and the distances that matter are computed again
from the differences, so that a distance does not depend on where it was computed.

``space`` keeps several sets of points apart (projections of one set to fewer coordinates,
say), which are all done by the same jobs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veinstone.session import cut_lineage

#: Points in a block and queries in a chunk: what one task compares at once.
BLOCK, CHUNK = 4096, 2048
#: Tasks to which pairs are dealt at most. The number is given, as Spark would put pairs of few MB,
#: which take long, into one task.
TASKS = 1024
DIGITS = 12


@dataclass(frozen=True)
class Cells:
    """points (space, node, v, cell) and what is known of each space's cells: pivots, radius
    and members, at most ``most`` of each."""

    points: DataFrame
    pivots: dict[int, np.ndarray]
    radius: dict[int, np.ndarray]
    members: dict[int, np.ndarray]

    def total(self, space: int) -> int:
        return int(self.members[space].sum())


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column without nulls, as rows."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b, to rounding."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0.0)


def exact(a: np.ndarray, b: np.ndarray, digits: int = DIGITS) -> np.ndarray:
    """Distances of the rows of a and b side by side, rounded."""
    gap = np.ascontiguousarray(a - b)
    return np.round(np.sqrt(np.einsum("ij,ij->i", gap, gap)), digits)


def slack(a: np.ndarray, b: np.ndarray) -> float:
    """How far a squared distance by products may be off."""
    return 1e-12 * (1.0 + float((a * a).sum(1).max(initial=0.0)) + float((b * b).sum(1).max(initial=0.0)))


def in_cells(points: DataFrame, per_cell: int = 1000, most: int = 512) -> Cells:
    """Cells of ``points`` (space int, node long, v array<double>, none null). The pivots are a
    sample by hash, one for ``per_cell`` points and at most ``most`` a space; every point is
    dealt to one. Other columns are kept."""
    sizes = {r.space: r.n for r in points.groupBy("space").agg(F.count("*").alias("n")).collect()}
    want = {s: min(most, -(-n // per_cell)) for s, n in sizes.items()}
    hashed = points.withColumn("_h", F.xxhash64("node"))
    drawn = F.lit(False)
    for s, n in sizes.items():
        drawn = drawn | ((F.col("space") == s) & (F.pmod(F.col("_h"), F.lit(n)) < 4 * want[s] + 16))
    pivots: dict[int, np.ndarray] = {}
    for s in sizes:
        rows = sorted(((r["_h"], tuple(r.v)) for r in hashed.where(drawn & (F.col("space") == s)).select("_h", "v").collect()), key=lambda r: r[0])
        found = list(dict.fromkeys(v for _, v in rows))[: want[s]] or [tuple(points.where(F.col("space") == s).select("v").first().v)]
        pivots[s] = np.array(found)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            space, v = batch.column("space").to_numpy(), batch.column("v")
            cell, far = np.zeros(len(space), np.int32), np.zeros(len(space))
            for s in np.unique(space):
                at = np.flatnonzero(space == s)
                x = matrix(v.take(pa.array(at)))
                cell[at] = squares(x, pivots[s]).argmin(1)
                far[at] = exact(x, pivots[s][cell[at]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    schema = ", ".join(f"`{c}` {t}" for c, t in points.dtypes)
    dealt = cut_lineage(points.mapInArrow(deal, f"{schema}, cell int, far double"))
    radius = {s: np.zeros(len(p)) for s, p in pivots.items()}
    members = {s: np.zeros(len(p), np.int64) for s, p in pivots.items()}
    for r in dealt.groupBy("space", "cell").agg(F.count("*").alias("n"), F.max("far").alias("r")).collect():
        radius[r.space][r.cell], members[r.space][r.cell] = r.r, r.n
    return Cells(dealt.drop("far"), pivots, radius, members)


def bounds(x: np.ndarray, pivots: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of the rows of x to the pivots, and what a point of each cell is away at least."""
    d = np.sqrt(squares(x, pivots))
    home = d.argmin(1)
    apart = np.sqrt(squares(pivots, pivots))[home]
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = np.where(apart > 0, (d * d - (d.min(1) ** 2)[:, None]) / (2 * apart), 0.0)
    least = np.maximum(np.maximum(d - radius, plane), 0.0)
    return d, least * (1 - 1e-9) - 1e-7  # products are exact to about 1e-8


def tiles(visits: DataFrame, points: DataFrame, cells: Cells, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> tuple[DataFrame, int]:
    """``run`` over every (chunk of visits, block of points) of each cell, and how many pairs
    these are. visits: space, cell, q and what run needs; points: space, cell, node and so on."""
    counts = {(r.space, r.cell): r.n for r in visits.groupBy("space", "cell").agg(F.count("*").alias("n")).collect()}
    plan = [(s, c, -(-n // CHUNK), -(-int(cells.members[s][c]) // BLOCK)) for (s, c), n in counts.items()]
    pairs = sum(n * int(cells.members[s][c]) for (s, c), n in counts.items())
    sizes = lambda: F.broadcast(visits.sparkSession.createDataFrame(plan, "space int, cell int, chunks long, blocks long"))  # noqa: E731  a row a cell
    part = F.pmod(F.xxhash64("q"), F.col("chunks"))
    left = visits.join(sizes(), ["space", "cell"]).withColumns({"chunk": part, "block": F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))})
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    right = points.join(sizes(), ["space", "cell"]).withColumns({"block": block, "chunk": F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))})
    key = ["space", "cell", "chunk", "block"]
    tasks = max(1, min(sum(chunks * blocks for *_, chunks, blocks in plan), TASKS))
    left, right = left.repartition(tasks, *key), right.repartition(tasks, *key)
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, schema), pairs


def nearest(queries: DataFrame, cells: Cells, k: int, with_self: bool = False, digits: int = DIGITS) -> tuple[DataFrame, float]:
    """(space, q, node, d, rank) of the k nearest points of each query (space, q, qv), by
    distances of so many digits, ties to the smaller node, and the share of all pairs that was compared. A point is no neighbour of
    a query of its own number, unless ``with_self``.

    First each query visits the nearest cells that hold k points at least, then, with what it
    found as its limit, all other cells that may hold a nearer one."""
    pivots, radius, members = cells.pivots, cells.radius, cells.members
    need = k + (not with_self)

    def plan(second: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                space, limit = batch.column("space").to_numpy(), batch.column("u").to_numpy()
                for s in np.unique(space):
                    at = np.flatnonzero(space == s)
                    d, least = bounds(matrix(batch.column("qv").take(pa.array(at))), pivots[s], radius[s])
                    order = d.argsort(1, kind="stable")
                    before = np.cumsum(members[s][order], 1) - members[s][order]
                    first = np.zeros_like(d, dtype=bool)
                    np.put_along_axis(first, order, before < need, 1)
                    first &= members[s] > 0
                    sure = np.where(first, d + radius[s], 0.0).max(1) * (1 + 1e-9) + 1e-7 if members[s].sum() >= need else np.full(len(at), np.inf)
                    go = ~first & (members[s] > 0) & (least <= limit[at][:, None]) if second else first
                    i, c = np.nonzero(go)
                    u = limit[at] if second else sure
                    rows = batch.take(pa.array(at[i]))
                    yield pa.RecordBatch.from_arrays([rows.column("space"), pa.array(c.astype(np.int32)), rows.column("q"), rows.column("qv"), pa.array(u[i])], names=["space", "cell", "q", "qv", "u"])

        return run

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y = matrix(left["qv"]), matrix(right["v"])
        q, node, u, s = (t[c].to_numpy() for t, c in ((left, "q"), (right, "node"), (left, "u"), (left, "space")))
        if not len(q) or not len(node):
            return pa.table({"space": pa.array([], pa.int32()), "q": pa.array([], pa.int64()), "node": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
        found = squares(x, y)
        if not with_self:
            found[q[:, None] == node[None, :]] = np.inf
        top = min(k, len(node)) - 1
        most = np.minimum(np.partition(found, top, axis=1)[:, top], u * u) + 2 * slack(x, y)
        i, j = np.nonzero(found <= ((np.sqrt(most) + 2 * 10.0**-digits) ** 2)[:, None])  # what rounding may make equal is looked at
        d = exact(x[i], y[j], digits)
        order = np.lexsort((node[j], d, i))
        i, j, d = i[order], j[order], d[order]
        starts = np.searchsorted(i, np.arange(len(q)))
        keep = np.arange(len(i)) - starts[i] < k
        i, j, d = i[keep], j[keep], d[keep]
        return pa.table({"space": pa.array(s[i], pa.int32()), "q": pa.array(q[i], pa.int64()), "node": pa.array(node[j], pa.int64()), "d": d})

    visit, out = "space int, cell int, q long, qv array<double>, u double", "space int, q long, node long, d double"
    best = Window.partitionBy("space", "q").orderBy("d", "node")
    asked = queries.select(F.col("space").cast("int").alias("space"), F.col("q").cast("long").alias("q"), F.col("qv").cast("array<double>").alias("qv"))
    total = sum(r.n * cells.total(r.space) for r in asked.groupBy("space").agg(F.count("*").alias("n")).collect())
    if not total:
        return asked.select("space", "q", F.col("q").alias("node"), F.lit(0.0).alias("d"), F.lit(0).alias("rank")).limit(0), 0.0
    points = cells.points.select("space", "cell", "node", "v")
    first, pairs = tiles(asked.withColumn("u", F.lit(0.0)).mapInArrow(plan(False), visit), points, cells, compare, out)
    first = cut_lineage(first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
    limit = first.groupBy("space", "q").agg(F.max("d").alias("u"), F.count("*").alias("n"))
    limit = limit.select("space", "q", F.when(F.col("n") < k, F.lit(float("inf"))).otherwise(F.col("u") + 2 * 10.0**-digits).alias("u"))
    again = asked.join(limit, ["space", "q"], "left").withColumn("u", F.coalesce("u", F.lit(float("inf"))))
    second, more = tiles(cut_lineage(again.select("space", "q", "qv", "u").mapInArrow(plan(True), visit)), points, cells, compare, out)
    both = first.drop("rank").unionByName(second).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return cut_lineage(both, first), (pairs + more) / total


#: Points in a part, at least and at most; in between so many that each space has about ``PARTS``.
PART, PARTS = (2048, 32768), 16
#: Distances that a task looks at together.
AT_ONCE = 1 << 21


@dataclass(frozen=True)
class Parts:
    """points (space, id, v, cell, part) of cells in pieces; first: each cell's first part, and how
    many it has."""

    points: DataFrame
    pivots: dict[int, np.ndarray]
    radius: dict[int, np.ndarray]
    first: dict[int, tuple[np.ndarray, np.ndarray]]

    def only(self, ids: DataFrame) -> Parts:
        """The points of some ids (id)."""
        return Parts(self.points.join(ids, "id", "left_semi"), self.pivots, self.radius, self.first)

    def meet(self, eps: float) -> DataFrame:
        """(lo, hi, part, id, v): every point once for each pair of parts, one being its own, in
        which another point may be within ``eps`` of it."""
        pivots, radius, first = self.pivots, self.radius, self.first

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                space, own = batch.column("space").to_numpy(), batch.column("part").to_numpy()
                for s in np.unique(space):
                    at = np.flatnonzero(space == s)
                    _, least = bounds(matrix(batch.column("v").take(pa.array(at))), pivots[s], radius[s])
                    start, pieces = first[s]
                    for c in np.flatnonzero(pieces):
                        here = at[least[:, c] <= eps]
                        rows = batch.select(["part", "id", "v"]).take(pa.array(here))
                        for other in range(start[c], start[c] + pieces[c]) if len(here) else ():
                            ends = [pa.array(f(own[here], other), pa.int32()) for f in (np.minimum, np.maximum)]
                            yield pa.RecordBatch.from_arrays([*ends, *rows.columns], names=["lo", "hi", *rows.schema.names])

        types = dict(self.points.dtypes)
        met = self.points.select("space", "part", "id", "v").mapInArrow(run, f"lo int, hi int, part int, id {types['id']}, v {types['v']}")
        n = sum(int(pieces.sum()) for _, pieces in first.values())
        return met.repartition(min(n * (n + 1) // 2, TASKS), "lo", "hi")


def in_parts(points: DataFrame) -> Parts | None:
    """Parts of ``points`` (space int, node long, id, v), which no two points share that are not of one cell."""
    sizes = [r.n for r in points.groupBy("space").agg(F.count("*").alias("n")).collect()]
    if not sizes:
        return None
    side = min(max(-(-max(sizes) // PARTS), PART[0]), PART[1])
    cells = in_cells(points, side)
    first, so_far = {}, 0
    for s, n in cells.members.items():
        pieces = -(-n // side)
        first[s] = (so_far + np.cumsum(pieces) - pieces, pieces)
        so_far += int(pieces.sum())
    plan = [(int(s), c, int(a), int(k)) for s, (start, pieces) in first.items() for c, (a, k) in enumerate(zip(start, pieces, strict=True)) if k]
    places = points.sparkSession.createDataFrame(plan, "space int, cell int, start int, pieces int")
    part = F.col("start") + F.pmod(F.xxhash64("node", F.lit(1)), F.col("pieces")).cast("int")
    return Parts(cells.points.join(F.broadcast(places), ["space", "cell"]).select("space", "id", "v", part.alias("part")), cells.pivots, cells.radius, first)


def sides(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """The two parts that have met, or twice the one that met itself."""
    lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
    if lo == hi:
        return table, table
    own = table["part"].to_numpy() == lo
    return table.filter(pa.array(own)), table.filter(pa.array(~own))


def close(x: np.ndarray, y: np.ndarray, eps: float) -> Iterator[tuple[slice, np.ndarray]]:
    """Rows of x, some at a time, and which rows of y are within ``eps`` of them. Where the
    products leave it open, the differences are squared and added in their order."""
    if not len(x) or not len(y):
        return
    yy, step = (y * y).sum(1), max(1, AT_ONCE // len(y))
    for start in range(0, len(x), step):
        at = slice(start, min(start + step, len(x)))
        both = (x[at] * x[at]).sum(1)[:, None] + yy[None, :]
        over = both - 2 * (x[at] @ y.T) - eps * eps
        off = 1e-12 * (1.0 + both)
        near = over < -off
        i, j = np.nonzero(np.abs(over) <= off)
        for k in range(0, len(i), 1 << 15):
            a, b = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
            gap, total = x[at][a] - y[b], np.zeros(len(a))
            for c in range(gap.shape[1]):
                total += gap[:, c] * gap[:, c]
            near[a, b] = np.sqrt(total) <= eps
        yield at, near


def unite(low: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the ends of edges: ``low`` names a smallest member for each node and stays flat."""
    while len(a):
        x, y = low[a], low[b]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low[low] != low).any():
            low[:] = low[low]
        open_ = low[a] != low[b]
        a, b = a[open_], b[open_]
