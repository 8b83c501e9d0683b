"""Exact nearest neighbours by an index of cells, or of all pairs.

Pivots drawn by a hash cut space into cells; a cell has a radius. Near cells are put together to parts of bounded size, and a
part's points go to a few tasks, which the queries that have to see the part stream through. So a row travels once for each
part that it is due, not for each cell, and a task holds one part and a batch of queries. Inside a part a batch visits the
cells by their distance and leaves out those that the triangle inequality puts beyond the neighbours found so far. Where there
are several parts, a first pass over a query's own part bounds the distance of its k-th neighbour, and the second one sends it
to those parts only that reach into the bound. On points without clusters the bound leaves most cells, and the work is that of
all pairs. Where at least half of the rows are copies of others, distinct vectors meet in their place (`of_distinct`).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.storage import materialized

#: Cells (their pivots are what the driver and every task hold), rows and bytes of a part.
MOST_CELLS, PART_ROWS, PART_BYTES = 1024, 500_000, 256 << 20
#: Points and queries that are compared at once, and pairs whose numbers are held for a true distance.
TILE, BATCH, TRUE = 2048, 256, 2_000_000
#: A batch's candidates are put in order when there are a MERGED-th of its neighbours.
MERGED = 4
#: Rows for each distinct vector from which on distinct vectors meet.
COPIES = 2


def cells_for(n: int) -> int:
    return max(1, min(MOST_CELLS, round(math.sqrt(n) / 2)))


def part_rows(dim: int) -> int:
    return max(1, min(PART_ROWS, PART_BYTES // (8 * max(dim, 1))))


class Cells:
    """Pivots, and each cell's points and radius."""

    def __init__(self, points: DataFrame, cells: int) -> None:
        some = points.orderBy(F.xxhash64(F.lit(3), "sample_id"), "sample_id").limit(cells).collect()
        self.pivots = np.array([r.v for r in some], float)
        self.counts, self.radius, self.inner = (np.zeros(len(some)) for _ in range(3))

    def distances(self, x: np.ndarray) -> np.ndarray:
        d = (x * x).sum(1)[:, None] + (self.pivots * self.pivots).sum(1) - 2 * x @ self.pivots.T
        return np.sqrt(np.maximum(d, 0.0))

    def slack(self, x: np.ndarray) -> np.ndarray:
        """Distances from products are right within this."""
        size = (x * x).sum(1)[:, None] + (self.pivots * self.pivots).sum(1).max(initial=0.0)
        return np.sqrt(8 * (x.shape[1] + 4) * np.finfo(float).eps * size)

    def placed(self, points: DataFrame) -> DataFrame:
        """Adds the nearest pivot's cell and the distance from it."""
        kind, v = (points.schema[x].dataType.simpleString() for x in ("sample_id", "v"))

        def run(batches):
            for b in batches:
                if b.num_rows:
                    d = self.distances(vectors(b))
                    cell = d.argmin(1)
                    yield pa.RecordBatch.from_arrays([b.column("sample_id"), b.column("v"), pa.array(cell, pa.int64()), pa.array(d[np.arange(len(d)), cell])], names=["sample_id", "v", "cell", "r"])

        out = materialized(points.mapInArrow(run, f"sample_id {kind}, v {v}, cell long, r double"), "cells")
        for r in out.groupBy("cell").agg(F.count("*").alias("n"), F.max("r").alias("far"), F.min("r").alias("near")).collect():
            self.counts[r.cell], self.radius[r.cell], self.inner[r.cell] = r.n, r.far, r.near
        self._cut(part_rows(self.pivots.shape[1]))
        return out

    def _cut(self, rows: int) -> None:
        """Cells in a chain of near ones, put together to parts of up to `rows` points; a cell of more is cut into parts."""
        n = len(self.pivots)
        d, left, at, last, filled = self.distances(self.pivots), np.ones(n, bool), 0, -1, rows + 1
        self.first, self.parts, self.chain = np.zeros(n, np.int64), np.ones(n, np.int64), np.zeros(n, np.int64)
        for i in range(n):
            self.chain[at] = i
            left[at], size = False, int(self.counts[at])
            if size > rows:
                self.first[at], self.parts[at] = last + 1, -(-size // rows)
                last, filled = last + int(self.parts[at]), rows + 1
            else:
                if filled + size > rows:
                    last, filled = last + 1, 0
                self.first[at], filled = last, filled + size
            at = int(np.argmin(np.where(left, d[at], np.inf)))
        self.all = last + 1
        self.member = np.zeros((n, self.all), np.float32)
        for c in range(n):
            self.member[c, self.first[c] : self.first[c] + self.parts[c]] = 1

    def part(self) -> Column:
        """The part of a placed point."""
        at = lambda x: F.element_at(F.array(*(F.lit(int(y)) for y in x)), (F.col("cell") + 1).cast("int"))
        return (at(self.first) + F.pmod(F.xxhash64("sample_id"), at(self.parts).cast("long"))).cast("int")


def vectors(b: pa.RecordBatch) -> np.ndarray:
    return np.asarray(b.column("v").flatten(), float).reshape(b.num_rows, -1)


def due(queries: DataFrame, cells: Cells, k: int, local: bool) -> DataFrame:
    """Queries (sample_id, v, bound) with every part (key) that they have to see, and their own cell's place in the chain of near cells (near). The local pass takes
    the part of that cell; the other one all parts with cells that reach into the bound."""
    kind, v = (queries.schema[x].dataType.simpleString() for x in ("sample_id", "v"))

    def run(batches):
        for batch in batches:
            for b in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                x = vectors(b)
                d = cells.distances(x)
                near = d.argmin(1)
                if local:
                    q, part = np.arange(len(x)), cells.first[near]
                else:
                    bound = np.asarray(b.column("bound"), float)[:, None] * (1 + 1e-12) + 2 * cells.slack(x)
                    wanted = (d - cells.radius <= bound) & (cells.inner - d <= bound) & (cells.counts > 0)
                    q, part = np.nonzero(wanted.astype(np.float32) @ cells.member)
                for i in range(0, len(q), 1 << 13):
                    at = b.take(pa.array(q[i : i + (1 << 13)]))
                    yield pa.RecordBatch.from_arrays([pa.array(part[i : i + (1 << 13)], pa.int32()), at.column("sample_id"), at.column("v"), at.column("bound"), pa.array(cells.chain[near[q[i : i + (1 << 13)]]], pa.int64())], names=["key", "sample_id", "v", "bound", "near"])

    return queries.mapInArrow(run, f"key int, sample_id {kind}, v {v}, bound double, near long")


class Part:
    """Points of one part by cell, met by batches of queries. Of equal points only the k + 1 with the smallest ids can be among
    anyone's neighbours, so the others are left out."""

    def __init__(self, held: list[pa.RecordBatch], k: int, same: bool, cells: Cells | None) -> None:
        self.ids = pa.concat_arrays([b.column("point_id") for b in held])
        y, cell = np.concatenate([vectors(b) for b in held]), np.concatenate([b.column("near").to_numpy() for b in held])
        held.clear()
        rank = np.empty(len(y), np.int64)
        rank[pc.sort_indices(self.ids).to_numpy()] = np.arange(len(y))
        keep = np.flatnonzero(early_copies(y, rank, k + 1))
        if len(keep) < len(y):
            y, cell, rank, self.ids = y[keep], cell[keep], rank[keep], self.ids.take(pa.array(keep))
        self.y, self.rank, self.k, self.cells = y, rank, k, cells
        self.at = {v: i for i, v in enumerate(self.ids.to_pylist())} if same else {}
        # runs of one cell, of at most a tile
        cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(y)]
        runs = [(a, min(a + TILE, z), cell[i]) for i, z in zip(cuts, cuts[1:]) for a in range(i, z, TILE)]
        self.start, self.stop, self.cell = (np.array(x, np.int64) for x in zip(*runs))

    def tiles(self, z: np.ndarray, limit: np.ndarray):
        """Places of points, by tiles, and the queries of the batch that have to see them; `limit` may fall meanwhile. Cells near
        to any query come first."""
        order, look, c = np.arange(len(self.start)), 1, self.cells
        if c is not None:
            d, slack = c.distances(z), c.slack(z)
            order = np.argsort(d.min(0)[self.cell], kind="stable")
        while len(order):
            some, order, look = order[:look], order[look:], min(2 * look, 32)
            due = np.ones((len(z), len(some)), bool)
            if c is not None:
                at, reach = self.cell[some], limit[:, None] * (1 + 1e-12) + 2 * slack
                due = (d[:, at] - c.radius[at] <= reach) & (c.inner[at] - d[:, at] <= reach)
                some, due = some[due.any(0)], due[:, due.any(0)]
            size = np.cumsum(self.stop[some] - self.start[some])
            for tile in np.split(np.arange(len(some)), np.flatnonzero(np.diff(size // (TILE + 1))) + 1) if len(some) else []:
                yield np.concatenate([np.arange(self.start[r], self.stop[r]) for r in some[tile]]), np.flatnonzero(due[:, tile].any(1))

    def met(self, b: pa.RecordBatch, local: bool):
        """(distances, places) of the k nearest within the bound of each query: which may be, by products in single precision
        whose rounding error is bounded; then their true distances. A local meeting ends when k points are found."""
        z, limit, k = vectors(b), np.array(b.column("bound"), float), self.k
        own = np.array([self.at.get(v, -1) for v in b.column("sample_id").to_pylist()]) if self.at else np.full(len(z), -1)
        best, place = np.full((len(z), k), np.inf), np.full((len(z), k), -1)
        middle = z.mean(0)
        zc = z - middle
        zz = (zc * zc).sum(1)
        waiting: list[tuple[np.ndarray, ...]] = []

        def merge():
            r, j, dist = (np.concatenate(x) for x in zip(*waiting))
            waiting.clear()
            x = dist <= limit[r]
            r, j, dist = r[x], j[x], dist[x]
            if len(r):
                rows = np.unique(r)
                r, j, dist = np.concatenate([r, np.repeat(rows, k)]), np.concatenate([j, place[rows].reshape(-1)]), np.concatenate([dist, best[rows].reshape(-1)])
                o = np.lexsort((self.rank[j], dist, r))
                r, j, dist = r[o], j[o], dist[o]
                slot = np.arange(len(r)) - np.searchsorted(r, r)
                top = slot < k
                best[r[top], slot[top]], place[r[top], slot[top]] = dist[top], j[top]
                limit[rows] = np.minimum(limit[rows], best[rows, k - 1])

        for at, q in self.tiles(z, limit):
            if local and np.isfinite(limit).all():
                break
            near = candidates(zc[q], zz[q], self.y[at] - middle, limit[q], k)
            r, j = q[near // len(at)], at[near % len(at)]
            r, j = r[j != own[r]], j[j != own[r]]
            step = max(1, TRUE // z.shape[1])
            dist = np.sqrt(np.concatenate([np.zeros(0), *(((z[r[a : a + step]] - self.y[j[a : a + step]]) ** 2).sum(axis=1) for a in range(0, len(r), step))]))
            waiting.append((r, j, dist))
            # sorting costs more than a few candidates too many: the found are put in order when they are many
            if local or sum(len(x[0]) for x in waiting) >= len(z) * k // MERGED or not np.isfinite(limit).all():
                merge()
        if waiting:
            merge()
        return best, place


def early_copies(y: np.ndarray, rank: np.ndarray, n: int) -> np.ndarray:
    """Which rows are among the first n, by rank, of those equal to them (sure to be true for these, mostly false for others)."""
    odd = np.random.default_rng(5).integers(0, 1 << 62, y.shape[1]).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    mixed = np.einsum("ij,j->i", y.view(np.uint64), odd)
    by = np.lexsort((rank, mixed))
    again = np.zeros(len(y), bool)
    i = np.flatnonzero(mixed[by[1:]] == mixed[by[:-1]]) + 1
    again[i] = np.concatenate([np.zeros(0, bool), *((y[by[x]] == y[by[x - 1]]).all(axis=1) for x in np.array_split(i, 1 + len(i) // 10_000))])
    place = np.arange(len(y))
    out = np.ones(len(y), bool)
    out[by] = place - np.maximum.accumulate(np.where(again, 0, place)) < n
    return out


def candidates(z: np.ndarray, zz: np.ndarray, y: np.ndarray, limit: np.ndarray, k: int) -> np.ndarray:
    """Flat places of the pairs that may be within the limit, or among the k nearest others where there is none yet: a pair's
    z y - y y / 2, made larger by a bound of its rounding error, is compared with what the limit needs."""
    yy, dim = np.einsum("ij,ij->i", y, y), y.shape[1]
    most, size = max(yy.max(), zz.max()), np.sqrt(zz.max())
    kind = np.float32 if 1e-18 < most < 1e30 else np.float64
    eps = 2 * (dim + 8) * np.finfo(kind).eps
    slack = eps * (size * np.sqrt(yy) + yy)
    left, right = np.empty((len(z), dim + 1), kind), np.empty((len(y), dim + 1), kind)
    left[:, :-1], left[:, -1], right[:, :-1], right[:, -1] = z, 1, y, slack - yy / 2
    s = left @ right.T
    bound = np.minimum(limit * limit * (1 + 1e-12), 4 * (zz + yy.max()) + 1)
    least = (zz - bound) / 2 - eps * (zz + bound)
    free = np.flatnonzero(~np.isfinite(limit))
    if len(free):
        least[free] = np.partition(s[free], len(y) - k - 1, axis=1)[:, len(y) - k - 1] - 3 * slack.max() - eps * zz[free] if len(y) > k + 1 else -np.inf
    least = least.astype(kind)
    # most queries have no candidate in most tiles: their rows are looked at once
    rows = np.flatnonzero(s.max(axis=1) >= least)
    if 2 * len(rows) > len(s):
        return np.flatnonzero(s >= least[:, None])
    near = np.flatnonzero(s[rows] >= least[rows, None])
    return rows[near // len(y)] * len(y) + near % len(y)


def shares_for(spark, parts: int, n: int) -> int:
    """Tasks that a part's points go to: about one for each core over all parts, if there are queries enough. Points are sent
    once for each task, so more tasks than cores would cost more than they balance."""
    return max(1, min(-(-spark.sparkContext.defaultParallelism // parts), -(-n // (2 * BATCH))))


def dealt(points: DataFrame, queries: DataFrame, parts: int, shares: int) -> DataFrame:
    """Points (part, sample_id, v, cell) and then queries (key, sample_id, v, bound, near) of one part and share in one task."""
    kind_q, kind_p = (x.schema["sample_id"].dataType.simpleString() for x in (queries, points))
    p = points.select(F.explode(F.sequence(F.col("part") * shares, F.col("part") * shares + (shares - 1))).alias("key"), F.lit(0).alias("kind"), F.col("sample_id").alias("point_id"), F.lit(None).cast(kind_q).alias("sample_id"), "v", F.lit(None).cast("double").alias("bound"), F.col("cell").cast("long").alias("near"))
    q = queries.select((F.col("key") * shares + F.pmod(F.xxhash64("sample_id"), F.lit(shares)).cast("int")).alias("key"), F.lit(1).alias("kind"), F.lit(None).cast(kind_p).alias("point_id"), "sample_id", "v", "bound", "near")
    return p.unionByName(q).repartitionById(parts * shares, "key").sortWithinPartitions("key", "kind", "near", "point_id")


def meetings(batches, part, size: int):
    """(part(its points), a batch of its queries) over a task's rows, by key; queries of parts without points are left out."""
    key = now = None
    held: list[pa.RecordBatch] = []
    for b in batches:
        keys, kinds = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "kind"))
        cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1]), True]).tolist() if b.num_rows else []
        for x, y in zip(cuts, cuts[1:]):
            if keys[x] != key:
                key, held, now = keys[x], [], None
            if kinds[x] == 0:
                held.append(b.slice(x, y - x))
            elif held or now is not None:
                if now is None:
                    now, held = part(held), []
                for i in range(x, y, size):
                    yield now, b.slice(i, min(size, y - i))


def met(points: DataFrame, queries: DataFrame, parts: int, shares: int, k: int, same: bool, cells: Cells | None = None, local: bool = False) -> DataFrame:
    """(query_id, point_id, dist, rank) of the queries with their parts; of a local pass the queries (sample_id, v, bound)."""
    kind_q, kind_p = (x.schema["sample_id"].dataType.simpleString() for x in (queries, points))

    def run(batches):
        for part, b in meetings(batches, lambda held: Part(held, k, same, cells), BATCH):
            best, place = part.met(b, local)
            if local:
                yield pa.RecordBatch.from_arrays([b.column("sample_id"), b.column("v"), pa.array(best[:, k - 1])], names=["sample_id", "v", "bound"])
            else:
                r, slot = np.nonzero(place >= 0)
                yield pa.RecordBatch.from_arrays([b.column("sample_id").take(pa.array(r)), part.ids.take(pa.array(place[r, slot])), pa.array(best[r, slot]), pa.array(slot + 1, pa.int32())], names=["query_id", "point_id", "dist", "rank"])

    found = dealt(points, queries, parts, shares).mapInArrow(run, f"sample_id {kind_q}, v {queries.schema['v'].dataType.simpleString()}, bound double" if local else f"query_id {kind_q}, point_id {kind_p}, dist double, rank int")
    if local or parts == 1:
        return found
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "point_id"))).where(F.col("rank") <= k)


def narrow(*frames: DataFrame) -> list[DataFrame]:
    """Frames (sample_id, v), as single precision where that is what all numbers are: rows travel with half the bytes, and are
    compared as doubles again."""
    double = [x.select("sample_id", F.col("v").cast("array<double>").alias("v")) for x in frames]
    every = double[0].select("v")
    for x in double[1:]:
        every = every.unionAll(x.select("v"))
    exact = F.forall("v", lambda x: x == x.cast("float").cast("double"))
    if every.select(exact.alias("e")).where("not e").limit(1).count():
        return double
    return [x.select("sample_id", F.col("v").cast("array<float>").alias("v")) for x in double]


def narrowed(queries: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries (sample_id, v, bound) and points (sample_id, v), narrow."""
    q, p = narrow(queries, points)
    return q.withColumn("bound", F.lit(float("inf"))), p


def nothing(queries: DataFrame, points: DataFrame) -> DataFrame:
    kind_q, kind_p = (x.schema["sample_id"].dataType.simpleString() for x in (queries, points))
    return points.sparkSession.createDataFrame([], f"query_id {kind_q}, point_id {kind_p}, dist double, rank int")


def nearest_by_cells(queries: DataFrame, points: DataFrame, k: int, same: bool = False, cells: int | None = None) -> DataFrame:
    """(query_id, point_id, dist, rank): the k nearest points (Euclidean, ties by id) of each query, itself left out if
    `same`; the same rows as by comparing all pairs. Ids must be unique."""
    q, points = narrowed(queries, points)
    index = Cells(points, cells or cells_for(points.count()))
    if not len(index.pivots):
        return nothing(queries, points)
    placed = index.placed(points).withColumn("part", index.part())
    shares = shares_for(points.sparkSession, index.all, queries.count())
    if index.all > 1:
        q = materialized(met(placed, due(q, index, k, True), index.all, shares, k, same, index, True), "bounds")
    return met(placed, due(q, index, k, False), index.all, shares, k, same, index)


def nearest(queries: DataFrame, points: DataFrame, k: int, same: bool = False, rows: int | None = None) -> DataFrame:
    """The same by comparing all pairs: every query meets every part (of about `rows` points, if given), and each meeting hands
    on k rows a query only."""
    q, points = narrowed(queries, points)
    n, one = points.count(), points.select(F.size("v")).first()
    if one is None:
        return nothing(queries, points)
    parts = -(-n // (rows or part_rows(one[0])))
    placed = points.withColumn("part", F.pmod(F.xxhash64("sample_id"), F.lit(parts)).cast("int")).withColumn("cell", F.lit(0))
    q = q.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("key"), "sample_id", "v", "bound", F.lit(0).cast("long").alias("near"))
    return met(placed, q, parts, shares_for(points.sparkSession, parts, queries.count()), k, same)


def copied(rows: DataFrame) -> bool:
    """Whether there are about COPIES rows or more for each distinct vector."""
    n, distinct = rows.agg(F.count("*"), F.approx_count_distinct(F.xxhash64("v"))).first()
    return n > 0 and n >= COPIES * distinct


def classed(rows: DataFrame) -> DataFrame:
    """(sample_id, rep, nth, v): the smallest id with the same vector, the place among these, and the vector for the first only.
    Vectors are sorted by a digest of 256 bits: as arrays of numbers they would be normalised again at each comparison."""
    rows, = narrow(rows)
    kind, v = (rows.schema[x].dataType.simpleString() for x in ("sample_id", "v"))

    def run(batches):
        for b in (whole.slice(i, 1024) for whole in batches for i in range(0, whole.num_rows, 1024)):
            keys = [blake2b(x.data, digest_size=32).digest() for x in vectors(b) + 0.0]
            yield pa.RecordBatch.from_arrays([b.column("sample_id"), b.column("v"), pa.array(keys, pa.binary())], names=["sample_id", "v", "key"])

    w = Window.partitionBy("key").orderBy("sample_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.mapInArrow(run, f"sample_id {kind}, v {v}, key binary").select("sample_id", F.first("sample_id").over(w).alias("rep"), F.row_number().over(w).alias("nth"), "v")
    return materialized(out.withColumn("v", F.when(F.col("nth") == 1, F.col("v"))), "classes")


@dataclass(frozen=True)
class Distinct:
    """Rows as `classed` gives them; where few are copies each row is a class by itself."""

    rows: DataFrame
    copies: bool

    @staticmethod
    def of(rows: DataFrame) -> "Distinct":
        copies = copied(rows)
        return Distinct(classed(rows) if copies else rows.select("sample_id", F.col("sample_id").alias("rep"), F.lit(1).alias("nth"), "v"), copies)

    @property
    def first(self) -> DataFrame:
        return self.rows.where("nth = 1").select("sample_id", "v")


def of_distinct(queries: DataFrame, points: DataFrame, k: int, same: bool, find, known: Distinct | None = None) -> DataFrame:
    """What find(queries, points, k, same) gives, by distinct vectors where queries or points have many copies: of the k + 1
    nearest points of a vector each has its class among the k + 1 nearest (ties by the smallest id), and is among the
    first k + 1 ids of it; a query's own row is left out at the end. `known`: the points' distinct vectors, if they were found before."""
    p = known or Distinct.of(points)
    q = p if queries is points else Distinct.of(queries)
    if not (p.copies or q.copies):
        return find(queries, points, k, same)
    more = k + 1 if same else k
    met = find(q.first, p.first, more, False)
    ids = p.rows.where(F.col("nth") <= more).select(F.col("rep").alias("point_id"), F.col("sample_id").alias("id"))
    first = Window.partitionBy("query_id").orderBy("dist", "id")
    found = met.join(ids, "point_id").select("query_id", "id", "dist", F.row_number().over(first).alias("i")).where(F.col("i") <= more)
    lists = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("i", "id", "dist"))).alias("near"))
    near = F.slice(F.filter("near", lambda x: x["id"] != F.col("sample_id")) if same else F.col("near"), 1, k)
    # lists are few and short, what they become is not: the join is dealt to all cores
    tasks = max(points.sparkSession.sparkContext.defaultParallelism, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    each = q.rows.select("sample_id", F.col("rep").alias("query_id")).repartition(tasks, "query_id").join(lists, "query_id").select("sample_id", F.posexplode(near).alias("at", "n"))
    return each.select(F.col("sample_id").alias("query_id"), F.col("n.id").alias("point_id"), F.col("n.dist").alias("dist"), (F.col("at") + 1).alias("rank"))
