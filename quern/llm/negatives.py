"""Hard-negative mining over a pivot table.

Each vector x gets one coordinate more, sqrt(M * M - |x| * |x|) with M the largest length, and a query one of 0: then the
distance from a query falls as the inner product rises, score = (|q|^2 + M^2 - distance^2) / 2. A few pivots are chosen far
apart in a bounded sample; every row stores its distances from them. Rows are grouped by label and nearest pivot, and groups
cut into chunks of bounded size. By the triangle inequality the pivot distances bracket scores twice: those of a group, from
its ranges, say which groups an anchor is sent to; those of a row, in the chunk, which rows are checked exactly.

A first visit to the chunk that promises most gives each anchor a floor for its positives; then all groups that reach the
floor are visited; then, for the negatives, all groups that reach a band [80 %, 100 %] of a positive's score. Chunks are
hashed and streamed against the anchors that they are due, so a task holds one chunk and a batch of anchors.

Defined results: a row without an id takes no part, like those without a label or with a null or non-finite component; an
empty vector scores 0, of vectors of different lengths the shorter has zeros behind. Rows equal in id, label and vector
count once. An anchor's other rows are those of another vec_id. An anchor without positives, or a positive without
negatives in its band, has no rows. Other columns, also ones named like the results, are ignored. An empty table gives an
empty result. Squared lengths of 2^60 or more (of whole numbers, so components of some millions) are an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import tidy, written

PIVOTS, SAMPLE, BUCKETS = 8, 256, 8
CHUNK_ROWS, TILE, BATCH = 1 << 17, 1 << 13, 256
MOST = 5
SCALE, ANCHORS, MOVED = 256, 100, 7
ROWS = "row long, vec_id long, label int, grp int, v binary, d array<double>"
FOUND = "a long, band int, score long, vec_id long"


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v as whole numbers and its squared length, of the rows that take part."""
    fit = "vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    v = vectors.where(fit).selectExpr("cast(vec_id AS long) AS vec_id", f"cast(if(vec_id % {MOVED} = 0, (label + 1) % 10, label) AS int) AS label", f"transform(embedding, x -> floor({SCALE} * cast(x AS double))) AS v")
    return v.selectExpr("*", "aggregate(v, 0D, (s, x) -> s + cast(x AS double) * cast(x AS double)) AS n2")


class Space:
    """What the whole table shares: width of vectors, largest squared length, pivots. At most SAMPLE rows come to the driver."""

    def __init__(self, rows: DataFrame) -> None:
        x = rows.agg(F.max(F.size("v")).alias("width"), F.max("n2").alias("m2")).first()
        self.width, self.m2 = max(x.width or 0, 1), x.m2 or 0.0
        if self.m2 >= 2.0**60:
            raise ValueError("inner products of these vectors don't fit a long")
        self.kind = np.int16 if self.m2 < 2.0**30 else np.int32
        sample = rows.orderBy(F.xxhash64(F.lit(12), "vec_id"), "vec_id", "label", "v").limit(SAMPLE).select("v").collect()
        self.pivots = self.far_apart(self.raised(self.matrix([r.v for r in sample])))
        #: Distances are right within this.
        self.slack = 1e-6 * np.sqrt(self.m2) + 1e-9

    def matrix(self, vectors: list[list[int]]) -> np.ndarray:
        out = np.zeros((len(vectors), self.width), np.int64)
        for k, v in enumerate(vectors):
            out[k, : len(v)] = v
        return out

    def raised(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.c_[x, np.sqrt(np.maximum(self.m2 - (x * x).sum(1), 0.0))]

    def far_apart(self, x: np.ndarray) -> np.ndarray:
        """Starts with the first row; each time the row that is farthest from those chosen is next."""
        if not len(x):
            return np.zeros((1, self.width + 1))
        at, near = [0], np.full(len(x), np.inf)
        while len(at) < min(PIVOTS, len(x)):
            near = np.minimum(near, ((x - x[at[-1]]) ** 2).sum(1))
            at.append(int(near.argmax()))
        return x[at]

    def distances(self, raised: np.ndarray) -> np.ndarray:
        """Of points from the pivots, which all have length M."""
        return np.sqrt(np.maximum((raised**2).sum(1)[:, None] + self.m2 - 2 * raised @ self.pivots.T, 0.0))

    def query_distances(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return self.distances(np.c_[x, np.zeros(len(x))])

    def unpacked(self, column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), self.kind).reshape(len(column), self.width)

    def scores(self, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact inner products: in doubles while every sum is below 2^53, else in long integers."""
        if self.m2 < 2.0**53:
            return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
        return queries.astype(np.int64) @ rows.astype(np.int64).T

    def most(self, n2: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """The score at a distance of at least `gap`."""
        return (n2 + self.m2 - np.maximum(gap - 2 * self.slack, 0.0) ** 2) / 2 + 1e-9 * self.m2 + 0.5

    def least(self, n2: np.ndarray, far: np.ndarray) -> np.ndarray:
        """The score at a distance of at most `far`."""
        return (n2 + self.m2 - (far + 2 * self.slack) ** 2) / 2 - 1e-9 * self.m2 - 0.5


def pivot_table(rows: DataFrame, space: Space) -> DataFrame:
    """Every row with its distances from the pivots, its group of label and nearest pivot, and a number of its own."""

    def run(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 40
        for b in batches:
            for part in (b.slice(k, TILE) for k in range(0, b.num_rows, TILE)):
                v = part.column("v")
                sizes = v.value_lengths().to_numpy(zero_copy_only=False)
                x = np.zeros((part.num_rows, space.width), np.int64)
                x[np.arange(space.width) < sizes[:, None]] = v.flatten().to_numpy(zero_copy_only=False)
                d = space.distances(space.raised(x))
                group = np.mod(part.column("label").to_numpy(zero_copy_only=False), BUCKETS) * PIVOTS + d.argmin(1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * d.shape[1], pa.int32()), pa.array(d.ravel()))
                packed = pa.array([r.tobytes() for r in x.astype(space.kind)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(at + np.arange(len(d))), part.column("vec_id"), part.column("label"), pa.array(group, pa.int32()), packed, lists], names=[c.split()[0] for c in ROWS.split(", ")])
                at += len(d)

    return written(rows.select("vec_id", "label", "v").mapInArrow(tidy(run), ROWS), "op12-pivots")


class Groups:
    """Of each group (BUCKETS * PIVOTS at most) the number of chunks and the range of distances from each pivot."""

    def __init__(self, table: DataFrame, space: Space) -> None:
        n = len(space.pivots)
        got = table.groupBy("grp").agg(F.count("*").alias("n"), *(f(F.get("d", F.lit(p))).alias(f"{f.__name__}{p}") for p in range(n) for f in (F.min, F.max))).orderBy("grp").collect()
        self.space, self.ids = space, np.array([r.grp for r in got], np.int64)
        self.chunks = np.array([-(-r.n // CHUNK_ROWS) for r in got], np.int64)
        self.low, self.high = (np.array([[r[f"{f}{p}"] for p in range(n)] for r in got]).reshape(len(got), n) for f in ("min", "max"))

    def bracket(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, most) score that each query can have with any row of each group."""
        d, n2 = self.space.query_distances(queries)[:, None, :], (queries.astype(np.float64) ** 2).sum(1)[:, None]
        gap = np.maximum(np.maximum(d - self.high, self.low - d), 0.0).max(2)
        return self.space.least(n2, (d + self.high).min(2)), self.space.most(n2, gap)


def visits(anchors: DataFrame, groups: Groups, same: bool, first: bool = False) -> DataFrame:
    """Each anchor (a, vec_id, label, v, low, high: its bands) with every chunk (key) that it has to see; with `first`, only
    one chunk of the group that promises most."""
    space = groups.space

    def run(batches):
        for b in batches:
            for part in (b.slice(k, BATCH) for k in range(0, b.num_rows, BATCH)):
                least, most = groups.bracket(space.unpacked(part.column("v")))
                label = part.column("label").to_numpy(zero_copy_only=False)
                due = np.ones(most.shape, bool)
                if same:
                    due &= np.mod(label, BUCKETS)[:, None] == groups.ids // PIVOTS
                if first:
                    best = np.where(due, most, -np.inf).argmax(1)
                    due &= np.arange(len(groups.ids)) == best[:, None]
                else:
                    low = np.array([min(x) for x in part.column("low").to_pylist()], np.float64)[:, None]
                    high = np.array([max(x) for x in part.column("high").to_pylist()], np.float64)[:, None]
                    due &= (most >= low) & (least <= high)
                at, g = np.nonzero(due)
                n = groups.chunks[g]
                a = part.column("a").to_numpy(zero_copy_only=False)[at]
                if first:
                    chunk = a % n
                else:
                    at, g = np.repeat(at, n), np.repeat(g, n)
                    chunk = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                keys = groups.ids[g] << 32 | chunk
                for k in range(0, len(at), 1 << 14):
                    rows = part.take(pa.array(at[k : k + (1 << 14)]))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + (1 << 14)]), *rows.columns], names=["key", *rows.schema.names])

    return anchors.mapInArrow(run, "key long, a long, vec_id long, label int, v binary, low array<long>, high array<long>")


def best_of(scores: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the places `at`, those of the MOST highest scores, equal ones by id."""
    if len(at) > MOST:
        s = scores[at]
        at = at[s >= np.partition(s, len(s) - MOST)[len(s) - MOST]]
    return at[np.lexsort((ids[at], -scores[at]))[:MOST]]


class Chunk:
    """The rows of a chunk, met by batches of anchors."""

    def __init__(self, space: Space, parts: list[pa.RecordBatch], same: bool) -> None:
        self.space, self.same = space, same
        t = pa.Table.from_batches(parts)
        v = np.frombuffer(b"".join(t.column("v").to_pylist()), space.kind).reshape(t.num_rows, space.width)
        ids, label = (t.column(c).to_numpy() for c in ("vec_id", "label"))
        d = t.column("d").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        fresh = np.ones(len(ids), bool)  # rows come sorted, so copies are neighbours
        fresh[1:] = (ids[1:] != ids[:-1]) | (label[1:] != label[:-1]) | (v[1:] != v[:-1]).any(1)
        self.ids, self.label, self.v, self.d = ids[fresh], label[fresh], v[fresh], d[fresh]

    def met(self, anchors: pa.RecordBatch):
        """The best rows of each anchor and band in this chunk."""
        space, q = self.space, self.space.unpacked(anchors.column("v"))
        a, ids, label = (anchors.column(c).to_numpy(zero_copy_only=False) for c in ("a", "vec_id", "label"))
        low, high = (anchors.column(c).to_pylist() for c in ("low", "high"))
        floor, top = np.array([min(x) for x in low])[:, None], np.array([max(x) for x in high])[:, None]
        dq, n2 = space.query_distances(q), (q.astype(np.float64) ** 2).sum(1)[:, None]
        out = []
        for k in range(0, len(self.ids), TILE):
            d = self.d[k : k + TILE]
            ok = ((self.label[k : k + TILE] == label[:, None]) == self.same) & (self.ids[k : k + TILE] != ids[:, None])
            gap, far = np.zeros(ok.shape), np.full(ok.shape, np.inf)
            for p in range(d.shape[1]):
                gap = np.maximum(gap, np.abs(dq[:, p, None] - d[:, p]))
                far = np.minimum(far, dq[:, p, None] + d[:, p])
            ok &= (space.most(n2, gap) >= floor) & (space.least(n2, far) <= top)
            rows, asking = np.flatnonzero(ok.any(0)), np.flatnonzero(ok.any(1))
            if not len(rows):
                continue
            scores, left = space.scores(q[asking], self.v[k + rows]), ok[np.ix_(asking, rows)]
            there = self.ids[k + rows]
            for s, mine, i in zip(scores, left, asking):
                for band, (x, y) in enumerate(zip(low[i], high[i])):
                    at = best_of(s, there, np.flatnonzero(mine & (s >= x) & (s <= y)))
                    out += [(int(a[i]), band, int(s[j]), int(there[j])) for j in at]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=[c.split()[0] for c in FOUND.split(", ")])


def met(table: DataFrame, due: DataFrame, groups: Groups, same: bool) -> DataFrame:
    """a, band, rank, score, vec_id: the best rows of each band. Rows of a chunk come first, then the anchors due to it."""
    space = groups.space
    chunks = F.element_at(F.array(*(F.lit(int(n)) for n in groups.chunks)), F.array_position(F.array(*(F.lit(int(g)) for g in groups.ids)), F.col("grp").cast("long")).cast("int"))
    key = F.shiftleft(F.col("grp").cast("long"), 32).bitwiseOR(F.pmod(F.xxhash64("row"), chunks.cast("long")))
    none = F.lit(None).cast("array<long>")
    rows = table.select(key.alias("key"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("a"), "vec_id", "label", "v", "d", none.alias("low"), none.alias("high"))
    asks = due.select("key", F.lit(1).alias("kind"), "a", "vec_id", "label", "v", F.lit(None).cast("array<double>").alias("d"), "low", "high")

    def run(batches):
        key = kind = chunk = None
        held: list[pa.RecordBatch] = []
        for b in batches:
            keys, kinds = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "kind"))
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1]), True]) if b.num_rows else []
            for x, y in zip(cuts, cuts[1:]):
                if keys[x] != key:
                    key, held, chunk = keys[x], [], None
                if kinds[x] == 0:
                    held.append(b.slice(x, y - x))
                elif held or chunk is not None:
                    if chunk is None:
                        chunk, held = Chunk(space, held, same), []
                    for k in range(x, y, BATCH):
                        yield from chunk.met(b.slice(k, min(BATCH, y - k)))

    n = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.unionByName(asks).repartition(n, "key").sortWithinPartitions("key", "kind", "vec_id", "label", "v").mapInArrow(tidy(run), FOUND)
    place = F.dense_rank().over(Window.partitionBy("a", "band").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= MOST).distinct()


def mined(vectors: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = whole_numbers(vectors)
    space = Space(rows)
    table = pivot_table(rows, space)
    groups = Groups(table, space)
    if not len(groups.ids):
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    few = written(table.where(F.col("vec_id") % ANCHORS == 0).groupBy("vec_id", "label", "v").agg(F.min("row").alias("a")), "op12-anchors")
    open_ = [F.array(F.lit(x).cast("long")).alias(n) for x, n in ((-(2**62), "low"), (2**62, "high"))]
    asks = few.select("a", "vec_id", "label", "v", *open_)
    seeds = written(met(table, visits(asks, groups, True, True), groups, True).groupBy("a").agg(F.count("*").alias("n"), F.min("score").alias("floor")), "op12-floors")
    floor = F.array(F.when(F.col("n") >= MOST, F.col("floor")).otherwise(F.lit(-(2**62)))).alias("low")
    asks = few.join(seeds, "a", "left").select("a", "vec_id", "label", "v", floor, open_[1])
    positives = written(met(table, visits(asks, groups, True), groups, True).groupBy("a").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))).alias("p")), "op12-positives")
    # 80 % of a score, rounded up: a negative's least whole score.
    bands = [F.expr("transform(p, x -> (4 * x.positive_score + pmod(-4 * x.positive_score, 5L)) div 5) AS low"), F.col("p.positive_score").alias("high")]
    asks = few.join(positives, "a").select("a", "vec_id", "label", "v", *bands)
    found = met(table, visits(asks, groups, False), groups, False)
    pairs = few.join(positives, "a").select("a", F.col("vec_id").alias("anchor_id"), F.posexplode("p").alias("band", "x")).select("a", "band", "anchor_id", "x.positive_id", "x.positive_score")
    return found.join(pairs, ["a", "band"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
