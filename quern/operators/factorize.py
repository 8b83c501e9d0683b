"""Nonnegative matrix factorisation and projections onto it.

W (features x k) is small and lives on the driver; each round is one pass over the samples, which solves every sample's
scores and sums what the next W needs. H is formed once, at the end.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import linalg
from ..functions.storage import materialized
from ..model import BROADCAST_ROWS, CountMatrix, Factorization, bounded, few

INITS, LOSSES = ("ica", "nnsvd", "random"), ("mse", "mkl")
#: Cells for each stored entry up to which scores by KL are found on dense rows.
DENSE = 10


def kl_divergence(x: Column, y: Column, pseudocount: float = 1e-12) -> Column:
    """x ln(x / y) - x + y, elementwise."""
    a, b = x + F.lit(pseudocount), y + F.lit(pseudocount)
    return a * F.log(a / b) - a + b


def _check(m: CountMatrix, k: int, init: str, loss: str) -> None:
    if k < 3:
        raise ValueError("k must be 3 or more")
    if init not in INITS:
        raise ValueError(f"init must be one of {INITS}")
    if loss not in LOSSES:
        raise ValueError(f"loss must be one of {LOSSES}")
    if m.entries.where("value < 0").limit(1).count():
        raise ValueError("the matrix has negative values")


def nnsvd_init(pk: linalg.Packed, k: int, seed: int = 1) -> np.ndarray:
    """W of the nonnegative double SVD: of each singular triplet the sign part with the larger product of norms. The norms
    of the samples' parts are sums over one pass."""
    u, d, _ = linalg.truncated_svd(pk, k, center=False, seed=seed)
    k = u.shape[1]
    inv = np.where(d > 0, 1 / np.maximum(d, 1e-300), 0)

    def norms(x):
        v = x @ u * inv
        return None, np.concatenate([(np.maximum(v, 0) ** 2).sum(axis=0), (np.maximum(-v, 0) ** 2).sum(axis=0)])

    sums = linalg.summed(pk, norms, 1, 2 * k)[1]
    w = np.zeros((pk.p, k))
    for i in range(k):
        up, un = np.maximum(u[:, i], 0), np.maximum(-u[:, i], 0)
        tp, tn = np.linalg.norm(up) * np.sqrt(sums[i]), np.linalg.norm(un) * np.sqrt(sums[k + i])
        if i == 0:
            w[:, 0] = np.sqrt(d[0]) * np.abs(u[:, 0])
        else:
            part, t = (up, tp) if tp >= tn else (un, tn)
            w[:, i] = np.sqrt(d[i] * t) * part / (np.linalg.norm(part) or 1)
    return w


def fast_ica(coords: DataFrame, r: int, k: int, n: int, rounds: int = 50, tol: float = 1e-4, seed: int = 1) -> np.ndarray:
    """Rotation (r x k) to independent components of whitened coordinates, symmetric FastICA with the log-cosh contrast;
    one pass a round."""
    rot = np.linalg.qr(np.random.default_rng(seed).normal(size=(r, k)))[0]
    root = np.sqrt(max(n, 1))
    for _ in range(rounds):
        def run(batches, rot=rot):
            total, more = np.zeros((k, r)), np.zeros(k)
            for b in batches:
                if b.num_rows:
                    x = b.column("v").values.to_numpy().reshape(b.num_rows, -1)[:, :r] * root
                    g = np.tanh(x @ rot)
                    total += g.T @ x
                    more += (1 - g * g).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), *(pa.array(c) for c in np.column_stack([total, more]).T)], names=["j", *(f"c{i}" for i in range(r + 1))])

        rows = coords.mapInArrow(run, "j int, " + ", ".join(f"c{i} double" for i in range(r + 1))).groupBy("j").agg(*(F.sum(f"c{i}") for i in range(r + 1))).collect()
        s = np.array([x[1:] for x in sorted(rows)]) / max(n, 1)
        new = s[:, :r].T - rot * s[:, r]
        a, _, b = np.linalg.svd(new, full_matrices=False)
        new = a @ b
        moved = np.max(np.abs(np.abs((new * rot).sum(axis=0)) - 1))
        rot = new
        if moved < tol:
            break
    return rot


def ica_init(pk: linalg.Packed, k: int, fast: bool = False, seed: int = 1) -> np.ndarray:
    """W from independent components of the samples: after reduction to 50 components if fast, else to k."""
    u, d, mu = linalg.truncated_svd(pk, 50 if fast else k, seed=seed)
    r = u.shape[1]
    inv = np.where(d > 1e-10 * max(d.max(), 1e-300), 1 / np.maximum(d, 1e-300), 0)
    at = mu @ (u * inv)
    coords = materialized(linalg.each(pk, lambda x: x @ (u * inv) - at, "v"), "ica")
    rot = fast_ica(coords, r, min(k, r), pk.n, seed=seed)
    w = linalg.signs((u * d) @ rot)
    return np.pad(w, ((0, 0), (0, k - w.shape[1])))


def _start(pk: linalg.Packed, k: int, init: str, fast: bool, seed: int, mean: float) -> np.ndarray:
    r = np.random.default_rng(seed)
    if init == "random":
        return r.random((pk.p, k)) * max(mean, 1e-12)
    w = ica_init(pk, k, fast, seed) if init == "ica" else nnsvd_init(pk, k, seed)
    w = np.pad(w, ((0, 0), (0, k - w.shape[1])))
    w = np.where(w < 1e-6, 0, w)
    return np.where(w == 0, r.random(w.shape) * mean / 100, w)


def penalty(x: np.ndarray, alpha: tuple[float, float, float]) -> np.ndarray:
    """What the L2, the angular and the L1 penalty add to the denominator of a multiplicative update."""
    return alpha[0] * x + alpha[1] * (x.sum(axis=-1, keepdims=True) - x) + alpha[2]


def kl_scores(x: linalg.Rows, w: np.ndarray, alpha: tuple[float, float, float] = (0.0, 0.0, 0.0), rounds: int = 30, tol: float = 0.0) -> np.ndarray:
    """Scores that lower the KL divergence of the rows, by multiplicative updates on stored entries; until no score moves by
    more than tol of the largest, if that is given."""
    down = w.sum(axis=0) + 1e-300
    h = np.full((x.n, w.shape[1]), 1.0) * (x.sums() / down.sum())[:, None]
    # where at least a tenth of the cells is stored, whole products are faster than gathered ones; a step's cells stay few
    full = x.dense() if len(x.val) and x.n * x.p <= DENSE * len(x.val) else None
    for _ in range(rounds):
        if full is None:
            up = linalg.Rows(x.idx, x.val / (x.products(h, w) + 1e-12), x.counts, x.p) @ w
        else:
            up = np.concatenate([full[a : a + 1024] / (h[a : a + 1024] @ w.T + 1e-12) @ w for a in range(0, x.n, 1024)])
        new = h * up / (down + penalty(h, alpha))
        done = tol > 0 and np.abs(new - h).max(initial=0) <= tol * max(new.max(initial=0), 1e-300)
        h = new
        if done:
            break
    return h


def run_nmf(m: CountMatrix, k: int, alpha: tuple[float, float, float] = (0.0, 0.0, 0.0), init: str = "ica", loss: str = "mse", max_iter: int = 500, ica_fast: bool = False, tol: float = 1e-4, seed: int = 1, pk: linalg.Packed | None = None) -> Factorization:
    """A ~ W H with W, H >= 0. Each round solves H exactly for W and then W for H, so the error never rises; it ends when
    the error falls by less than `tol` of itself, or after max_iter rounds. A factor that no sample uses would stay zero: once,
    it starts again from what the others leave of the features' sums."""
    _check(m, k, init, loss)
    return _factorized(linalg.packed(m) if pk is None else pk, k, alpha, init, loss, max_iter, ica_fast, tol, seed)


class Fit:
    """The rounds of one factorisation: what a pass has to sum for the next W, and W from those sums."""

    def __init__(self, w: np.ndarray, loss: str, alpha, tol: float, cells: int, sums: np.ndarray, squares: float) -> None:
        self.w, self.loss, self.alpha, self.tol, self.cells, self.sums, self.squares = w, loss, alpha, tol, cells, sums, squares
        self.errors: list[float] = []
        self.again: set[int] = set()
        k = w.shape[1]
        self.k, self.extra = k, k * k + 1 + k if loss == "mse" else k + 1

    def visit(self):
        """Rows (and their products with W, if known) to the p x k sums and the `extra` others. It holds this round's W only."""
        w, alpha = self.w, self.alpha
        if self.loss == "mse":
            gram = w.T @ w

            def visit(x, b=None):
                b = x.times(w) if b is None else b
                h = linalg.nnls(gram, b, alpha=alpha)
                return x.across(h), np.concatenate([(h.T @ h).reshape(-1), [(h * b).sum()], h.sum(axis=0)])
        else:
            total = w.sum(axis=0)

            def visit(x, b=None):
                h = kl_scores(x, w, alpha)
                y = x.products(h, w) + 1e-12
                # stored entries, and the sum of all of h w' for those that aren't stored
                return x.across(h, x.val / y), np.concatenate([h.sum(axis=0), [float((x.val * np.log(np.maximum(x.val, 1e-300) / y) - x.val).sum() + (h.sum(axis=0) * total).sum())]])

        return visit

    def step(self, b: np.ndarray, more: np.ndarray) -> bool:
        """The next W; whether the fit is done."""
        w, k, errors, lost = self.w, self.k, self.errors, []
        if self.loss == "mse":
            hh = more[: k * k].reshape(k, k)
            errors.append(float((self.squares - 2 * more[k * k] + (w.T @ w * hh).sum()) / self.cells))
            rest = np.maximum(self.sums - w @ more[-k:], 0)
            w = linalg.nnls(hh, b, alpha=self.alpha)
            lost = [j for j in np.flatnonzero(~w.any(axis=0)).tolist() if j not in self.again][:1] if rest.max(initial=0) > 1e-9 * self.sums.max(initial=0) else []
            for j in lost:
                w[:, j] = rest / np.linalg.norm(rest)
                self.again.add(j)
        else:
            errors.append(float(more[-1] / self.cells))
            w = w * b / np.maximum(more[:-1] + penalty(w, self.alpha), 1e-300)
        self.w = w
        return not lost and len(errors) > 1 and abs(errors[-2] - errors[-1]) <= self.tol * max(abs(errors[-2]), 1e-300)


def _fitted(pk: linalg.Packed, ks: list[int], alpha, init, loss, max_iter, fast, tol, seed) -> list[Fit]:
    """Fits of several numbers of factors. A pass serves all that aren't done: it reads the samples once for them."""
    cells = max(1, pk.p * pk.n)
    sums, s = linalg.summed(pk, lambda x: (np.bincount(x.idx, x.val, x.p)[:, None], np.array([x.val.sum(), (x.val * x.val).sum()])), 1, 2)
    fits = [Fit(_start(pk, k, init, fast, seed, s[0] / cells), loss, alpha, tol, cells, sums[:, 0], s[1]) for k in ks]
    going = list(fits)
    for _ in range(max_iter):
        # fits whose sums together are too many for one pass take several
        for some in _together(going, linalg.MAX_CELLS // max(1, pk.p)):
            visits, ends = [f.visit() for f in some], np.cumsum([f.k for f in some])
            whole = np.hstack([f.w for f in some]) if loss == "mse" and len(some) > 1 else None

            def visit(x, visits=visits, ends=ends, whole=whole):
                b = [None] * len(visits) if whole is None else np.split(x.times(whole), ends[:-1], axis=1)
                got = [v(x, y) for v, y in zip(visits, b)]
                return np.hstack([g[0] for g in got]), np.concatenate([g[1] for g in got])

            b, more = linalg.summed(pk, visit, int(ends[-1]), sum(f.extra for f in some))
            more = np.split(more, np.cumsum([f.extra for f in some])[:-1])
            ended = [f for f, x, y in zip(some, np.split(b, ends[:-1], axis=1), more) if f.step(x, y)]
            going = [f for f in going if f not in ended]
        if not going:
            break
    return fits


def _together(fits: list[Fit], most: int) -> list[list[Fit]]:
    out: list[list[Fit]] = []
    for f in fits:
        if out and sum(x.k for x in out[-1]) + f.k <= most:
            out[-1].append(f)
        else:
            out.append([f])
    return out


def _factorized(pk, k, alpha, init, loss, max_iter, ica_fast, tol, seed) -> Factorization:
    fit, = _fitted(pk, [k], alpha, init, loss, max_iter, ica_fast, tol, seed)
    w, gram = fit.w, fit.w.T @ fit.w
    solve = (lambda x: linalg.nnls(gram, x @ w, alpha=alpha)) if loss == "mse" else (lambda x: kl_scores(x, w, alpha))
    h = materialized(linalg.each(pk, solve, "h"), "h")
    spark = h.sparkSession
    kind = "string" if not pk.features or isinstance(pk.features[0], str) else "long"
    wd = spark.createDataFrame([(f, [float(v) for v in row]) for f, row in zip(pk.features, w)], f"feature_id {kind}, w array<double>")
    return Factorization(wd, h, k, tuple(fit.errors))


def gram_of(df: DataFrame, column: str, k: int) -> np.ndarray:
    """Sum of outer products of an array column: k (k + 1) / 2 sums, partial in each task."""
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = df.agg(*(F.sum(F.col(column)[i] * F.col(column)[j]) for i, j in pairs)).first()
    g = np.zeros((k, k))
    for (i, j), v in zip(pairs, row):
        g[i, j] = g[j, i] = v or 0.0
    return g


def products(entries: DataFrame, loadings: DataFrame, key: str, out: str, column: str, k: int) -> DataFrame:
    """(out, b array<double>): for each `out` the sum of value * loading over its stored entries."""
    other = loadings.select(key, F.col(column).alias("__l"))
    sums = entries.join(other, key).groupBy(out).agg(*(F.sum(F.col("value") * F.col("__l")[i]).alias(f"b{i}") for i in range(k)))
    return sums.select(out, F.array(*(F.coalesce(f"b{i}", F.lit(0.0)) for i in range(k))).alias("b"))


def solved(rhs: DataFrame, gram: np.ndarray, key: str, name: str, alpha: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Nonnegative least squares of every row of (key, b)."""
    kind = dict(rhs.dtypes)[key]
    k = len(gram)

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = linalg.nnls(gram, b.column("b").values.to_numpy().reshape(b.num_rows, k), alpha=alpha)
                yield pa.RecordBatch.from_arrays([b.column(key), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(x.reshape(-1)))], names=[key, name])

    return rhs.select(key, "b").mapInArrow(run, f"{key} {kind}, {name} array<double>")


def _completed(found: DataFrame, ids: DataFrame, key: str, name: str, k: int) -> DataFrame:
    zero = F.array(*(F.lit(0.0) for _ in range(k)))
    return ids.select(key).distinct().join(found, key, "left").select(key, F.coalesce(name, zero).alias(name))


def kl_projected(entries: DataFrame, other: DataFrame, key: str, on: str, column: str, k: int, name: str, alpha: tuple[float, float, float], rounds: int = 200, tol: float = 1e-6) -> DataFrame:
    """Of each `key` the k numbers that lower the KL divergence of its entries from their products with other(on, column):
    multiplicative updates, each one join with the numbers so far and one aggregate, so no task gathers a key's entries."""
    total = other.agg(*(F.sum(F.col(column)[i]) for i in range(k))).first()
    down = np.array([x or 0.0 for x in total]) + 1e-300
    rows = materialized(entries.join(other.select(on, F.col(column).alias("__l")), on).select(key, "value", "__l"), "products")
    now = rows.groupBy(key).agg(F.sum("value").alias("__s")).select(key, F.array(*(F.col("__s") / F.lit(float(down.sum())) for _ in range(k))).alias("__x"))
    for _ in range(rounds):
        dot = sum((F.col("__l")[i] * F.col("__x")[i] for i in range(1, k)), F.col("__l")[0] * F.col("__x")[0]) + F.lit(1e-12)
        up = rows.join(now, key).groupBy(key).agg(F.first("__x").alias("__x"), *(F.sum(F.col("value") / dot * F.col("__l")[i]).alias(f"u{i}") for i in range(k)))
        whole = F.aggregate("__x", F.lit(0.0), lambda a, v: a + v)
        new = F.array(*(F.col("__x")[i] * F.col(f"u{i}") / (F.lit(float(down[i])) + alpha[0] * F.col("__x")[i] + alpha[1] * (whole - F.col("__x")[i]) + alpha[2]) for i in range(k)))
        up = materialized(up.select(key, new.alias("__x"), F.array_max(F.zip_with(new, "__x", lambda a, b: F.abs(a - b))).alias("__d")), "kl")
        moved, top = up.agg(F.max("__d"), F.max(F.array_max("__x"))).first()
        now = up.drop("__d")
        if (moved or 0.0) <= tol * (top or 0.0):
            break
    return now.withColumnRenamed("__x", name)


def _check_loss(loss: str) -> None:
    if loss not in LOSSES:
        raise ValueError(f"loss must be one of {LOSSES}")


def project_features(m: CountMatrix, h: DataFrame, k: int, alpha: tuple[float, float, float] = (0.0, 0.0, 0.0), loss: str = "mse") -> DataFrame:
    """(feature_id, w): loadings of all features of `m` on frozen scores."""
    _check_loss(loss)
    if loss == "mkl":
        return _completed(kl_projected(m.entries, h, "feature_id", "sample_id", "h", k, "w", alpha), m.features, "feature_id", "w", k)
    b = products(m.entries, h, "sample_id", "feature_id", "h", k)
    return _completed(solved(b, gram_of(h, "h", k), "feature_id", "w", alpha), m.features, "feature_id", "w", k)


def project_samples(m: CountMatrix, w: DataFrame, k: int, features: DataFrame | None = None, alpha: tuple[float, float, float] = (0.0, 0.0, 0.0), loss: str = "mse") -> DataFrame:
    """(sample_id, h): scores of new samples on frozen loadings, on the features that both have."""
    _check_loss(loss)
    shared = w.join(m.features, "feature_id", "left_semi")
    if features is not None:
        shared = shared.join(features.select("feature_id"), "feature_id", "left_semi")
    if loss == "mkl":
        return _completed(kl_projected(m.entries, bounded(shared), "sample_id", "feature_id", "w", k, "h", alpha), m.samples, "sample_id", "h", k)
    b = products(m.entries, bounded(shared), "feature_id", "sample_id", "w", k)
    return _completed(solved(b, gram_of(shared, "w", k), "sample_id", "h", alpha), m.samples, "sample_id", "h", k)


def shuffled(m: CountMatrix, seed: int = 1) -> CountMatrix:
    """Every stored entry moved to another cell of the whole grid by one keyed permutation of the cells (a Feistel network
    with cycle walking), so absent entries are shuffled too, without sorting."""
    spark = m.entries.sparkSession
    fs = sorted(r[0] for r in few(m.features.select("feature_id").distinct(), linalg.MAX_CELLS, "features"))
    names = spark.createDataFrame([(f, i) for i, f in enumerate(fs)], f"feature_id {dict(m.features.dtypes)['feature_id']}, f long")
    from .ranking import dense_index

    ids = materialized(dense_index(m.samples.select("sample_id").distinct(), "sample_id", "s"), "cells")
    p, n = len(fs), ids.count()
    half = max(1, (max(2, p * n) - 1).bit_length() + 1 >> 1)
    mask, total = (1 << half) - 1, p * n
    keys = [int(x) for x in np.random.default_rng(seed).integers(1, 1 << 31, 4)]

    def moved(c: np.ndarray) -> np.ndarray:
        todo = np.arange(len(c))
        c = c.copy()
        while len(todo):
            x = c[todo]
            left, right = x >> half, x & mask
            for key in keys:
                z = (right.astype(np.uint64) + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
                z ^= z >> np.uint64(29)
                z *= np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, left ^ (z >> np.uint64(33)).astype(np.int64) & mask
            c[todo] = left << half | right
            todo = todo[c[todo] >= total]
        return c

    def run(batches):
        for b in batches:
            c = moved(b.column("c").to_numpy().astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c // n), pa.array(c % n), b.column("value")], names=["f", "s", "value"])

    names = F.broadcast(names) if len(fs) <= BROADCAST_ROWS else names
    cells = m.entries.join(names, "feature_id").join(ids, "sample_id").select((F.col("f") * n + F.col("s")).alias("c"), "value")
    out = cells.mapInArrow(run, "f long, s long, value double").join(names, "f").join(ids, "s")
    return m.with_entries(out.select("feature_id", "sample_id", "value"))


def choose_k(errors: DataFrame) -> int:
    """The rule on (k, err, err_rand), ordered by k: the first k after which the error falls less than that of the shuffled
    matrix, else the k after the smallest difference. One row per k."""
    rows = factor_number_table(errors).orderBy("k").collect()
    ks = [r.k for r in errors.orderBy("k").collect()]
    d = [r["diff"] for r in rows if r["diff"] is not None]
    for i, x in enumerate(d):
        if x < 0:
            return ks[i]
    return ks[int(np.argmin(d)) + 1]


def factor_number_table(errors: DataFrame) -> DataFrame:
    """diff: the fall of the error to the next k beyond that of the shuffled matrix; null for the last k."""
    w = Window.orderBy("k")
    return errors.select("k", "err", "err_rand", ((F.col("err") - F.lead("err").over(w)) - (F.col("err_rand") - F.lead("err_rand").over(w))).alias("diff"))


def find_num_factors(m: CountMatrix, k_range=range(2, 13, 2), loss: str = "mse", max_iter: int = 250, seed: int = 1) -> tuple[int, DataFrame]:
    """(k, table of errors). Fits are by squared error with random starts, as `loss` is the measure of the error only."""
    ks = list(k_range)
    if len(ks) < 3:
        raise ValueError("at least three values of k are needed")
    if loss not in LOSSES:
        raise ValueError(f"loss must be one of {LOSSES}")
    if m.n_samples() > 20_000:
        warnings.warn("the search takes a pass over all samples for each round of each k")
    one, two = linalg.packed(m), linalg.packed(shuffled(m, seed))

    def error(pk, f):
        if loss == "mse":
            return f.errors[-1]
        w = f.w
        gram, eps = w.T @ w, 1e-12

        def visit(x):
            # every cell's y, once for cells without an entry (z is eps there), then mended at the stored ones
            h = linalg.nnls(gram, x @ w)
            at, z = x.products(h, w) + eps, x.val + eps
            out = float((at * np.log(eps / z) + z - eps).sum())
            step = max(1, 4_000_000 // max(x.n, 1))
            for a in range(0, x.p, step):
                y = h @ w[a : a + step].T + eps
                out += float((y * np.log(y / eps) - y + eps).sum())
            return None, np.array([out])

        return float(linalg.summed(pk, visit, 1, 1)[1][0] / max(1, pk.p * pk.n))

    fits = [_fitted(pk, ks, (0.0, 0.0, 0.0), "random", "mse", max_iter, False, 1e-4, seed) for pk in (one, two)]
    rows = [(int(k), float(error(one, a)), float(error(two, b))) for k, a, b in zip(ks, *fits)]
    table = m.entries.sparkSession.createDataFrame(rows, "k int, err double, err_rand double")
    return choose_k(table), table
