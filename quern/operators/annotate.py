"""Associations of features and feature sets with factors."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import linalg, scans
from ..functions.storage import materialized
from ..model import CountMatrix, bounded, few
from .enrichment import run_gsea  # noqa: F401  beside the other annotations
from .factorize import _check_loss, _completed, gram_of, kl_scores, products, project_samples, solved
from .groups import flatten_groups, unflatten_groups  # noqa: F401  one import for both kinds of sets


def genesets_indicator(genesets: DataFrame, inverse: bool = False) -> DataFrame:
    """(feature_id, geneset) of members, or of all other pairs of members' union and sets."""
    long = genesets.select(F.explode("members").alias("feature_id"), "geneset").distinct()
    if not inverse:
        return long
    grid = long.select("feature_id").distinct().crossJoin(bounded(genesets.select("geneset").distinct()))
    return grid.join(long, ["feature_id", "geneset"], "left_anti")


def cluster_indicator(groups: DataFrame) -> DataFrame:
    """(grp, sample_id, value): 1 for members; absent pairs are 0."""
    return groups.where("grp is not null").select("grp", "sample_id", F.lit(1.0).alias("value")).distinct()


def associate_pearson(m: CountMatrix, h: DataFrame, k: int) -> DataFrame:
    """(feature_id, factor_idx, assoc): correlations over all samples from sums on stored entries, zeros included; null where
    a side is constant, as for features without entries."""
    n = h.count()
    tot = h.agg(*(F.sum(F.col("h")[i]).alias(f"s{i}") for i in range(k)), *(F.sum(F.col("h")[i] * F.col("h")[i]).alias(f"q{i}") for i in range(k))).first()
    sums = m.entries.join(h, "sample_id").groupBy("feature_id").agg(F.sum("value").alias("a"), F.sum(F.col("value") * F.col("value")).alias("aa"), *(F.sum(F.col("value") * F.col("h")[i]).alias(f"p{i}") for i in range(k)))
    cols = []
    for i in range(k):
        s, q = tot[f"s{i}"] or 0.0, tot[f"q{i}"] or 0.0
        up = F.col(f"p{i}") - F.col("a") * F.lit(s / n)
        down = F.sqrt((F.col("aa") - F.col("a") * F.col("a") / F.lit(float(n))) * F.lit(max(q - s * s / n, 0.0)))
        cols.append(F.struct(F.lit(i + 1).alias("factor_idx"), F.when(down > 0, up / down).alias("assoc")))
    return m.features.join(sums, "feature_id", "left").select("feature_id", F.explode(F.array(*cols)).alias("c")).select("feature_id", "c.*")


def associate_spearman(m: CountMatrix, h: DataFrame, k: int) -> DataFrame:
    """Rank correlations. Absent entries are one tie block of zeros below the stored ones (values must not be negative),
    so only stored entries are ranked: their rank is shifted by the block, and the block's share is summed in closed form."""
    n = h.count()
    long = h.select("sample_id", F.posexplode("h").alias("i", "s"))
    r = scans.average_ranks(long, ["i"], "s", "r").groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("i", "r"))).alias("e")).select("sample_id", F.transform("e", lambda x: x["r"]).alias("h"))
    qs = r.agg(*(F.sum(F.col("h")[i] * F.col("h")[i]).alias(f"q{i}") for i in range(k))).first()
    e = scans.average_ranks(m.entries, ["feature_id"], "value", "a")
    e = scans.beside(e, m.entries.groupBy("feature_id").agg((F.lit(n) - F.count("*")).alias("z")), ["feature_id"])
    e = e.withColumn("a", F.col("a") + F.col("z"))
    mean = (n + 1) / 2.0
    # sums of rank * rank: the zero block has rank (z + 1) / 2, and score ranks that add up to n * mean less the stored ones'
    sums = e.join(r, "sample_id").groupBy("feature_id").agg(F.first("z").alias("z"), F.sum(F.col("a") * F.col("a")).alias("aa"), *(F.sum(F.col("a") * F.col("h")[i]).alias(f"p{i}") for i in range(k)), *(F.sum(F.col("h")[i]).alias(f"s{i}") for i in range(k)))
    zr = (F.col("z") + 1) / F.lit(2.0)
    cols = []
    for i in range(k):
        up = F.col(f"p{i}") + zr * (F.lit(n * mean) - F.col(f"s{i}")) - F.lit(n * mean * mean)
        down = F.sqrt((F.col("aa") + zr * zr * F.col("z") - F.lit(n * mean * mean)) * F.lit(max((qs[i] or 0.0) - n * mean * mean, 0.0)))
        cols.append(F.struct(F.lit(i + 1).alias("factor_idx"), F.when(down > 0, up / down).alias("assoc")))
    return sums.select("feature_id", F.explode(F.array(*cols)).alias("c")).select("feature_id", "c.*")


def bcv_bandwidth(x: np.ndarray, bins: int = 1000) -> float:
    """Bandwidth by biased cross-validation of a Gaussian kernel density estimate, on binned distances."""
    n = len(x)
    sd = min(np.std(x, ddof=1), (np.quantile(x, 0.75) - np.quantile(x, 0.25)) / 1.34) or np.std(x, ddof=1)
    if not sd > 0:
        return 1e-6
    low, high = x.min(), x.max()
    width = (high - low) * 1.01 / bins
    c = np.bincount(np.minimum(((x - low) / width).astype(int), bins - 1), minlength=bins).astype(float)
    return binned_bandwidth(c, width, np.std(x, ddof=1))


def binned_bandwidth(c: np.ndarray, width: float, sd: float) -> float:
    """The same from counts in bins of a width, and the standard deviation."""
    n, bins = c.sum(), len(c)
    top = 1.144 * sd * n ** -0.2
    size = 1 << (2 * bins - 1).bit_length()
    f = np.fft.rfft(c, size)
    pairs = np.rint(np.fft.irfft(f * np.conj(f), size)[:bins])
    pairs[0] = (c * (c - 1)).sum() / 2
    d2 = (np.arange(bins) * width) ** 2

    def score(h):
        t = d2 / (h * h)
        keep = t < 1000
        t = t[keep]
        s = (np.exp(-t / 4) * (t * t - 12 * t + 12) * pairs[keep]).sum()
        return (1 + s / (32.0 * n)) / (2 * n * h * np.sqrt(np.pi))

    # golden section between a tenth of the largest bandwidth and it
    a, b = 0.1 * top, top
    g = (np.sqrt(5) - 1) / 2
    while b - a > 0.1 * 0.1 * top * 0.1:
        p, q = b - g * (b - a), a + g * (b - a)
        if score(p) < score(q):
            b = q
        else:
            a = p
    return 4 * (a + b) / 2


def information_coefficient(x: np.ndarray, y: np.ndarray, n_grid: int = 25, seed: int = 1) -> float:
    """sign(r) sqrt(1 - exp(-2 MI)) of the pairs without nulls, MI from a Gaussian density estimate on a grid whose
    bandwidths shrink with the correlation. Two pairs or fewer, or no variance, give 0."""
    ok = ~(np.isnan(x) | np.isnan(y))
    x, y = x[ok], y[ok]
    n = len(x)
    if n <= 2 or np.ptp(x) == 0 or np.ptp(y) == 0:
        return 0.0
    r = np.random.default_rng(seed)
    x, y = x + 1e-9 * r.random(n), y + 1e-9 * r.random(n)
    rho = np.corrcoef(x, y)[0, 1]
    if not np.isfinite(rho):
        return 0.0
    hx, hy = (bcv_bandwidth(v) * (1 - 0.75 * abs(rho)) / 4 for v in (x, y))
    hx, hy = max(hx, 1e-12), max(hy, 1e-12)
    gx, gy = np.linspace(x.min(), x.max(), n_grid), np.linspace(y.min(), y.max(), n_grid)
    ax = np.exp(-0.5 * ((gx[:, None] - x) / hx) ** 2) / np.sqrt(2 * np.pi)
    ay = np.exp(-0.5 * ((gy[:, None] - y) / hy) ** 2) / np.sqrt(2 * np.pi)
    f = ax @ ay.T / (n * hx * hy) + np.finfo(float).eps
    return density_coefficient(f, gx, gy, rho)


def density_coefficient(f: np.ndarray, gx: np.ndarray, gy: np.ndarray, rho: float) -> float:
    """The coefficient from a density on a grid."""
    dx, dy = gx[1] - gx[0], gy[1] - gy[0]
    p = f / (f.sum() * dx * dy)
    px, py = p.sum(axis=1) * dy, p.sum(axis=0) * dx
    mi = (p * np.log(p / np.outer(px, py))).sum() * dx * dy
    ic = np.sign(rho) * np.sqrt(max(0.0, 1 - np.exp(-2 * mi)))
    return float(ic) if np.isfinite(ic) else 0.0


BINS, GRID, EPS = 1000, 25, np.finfo(float).eps


def score_summaries(h: DataFrame, k: int) -> dict:
    """n, and of each factor's scores: low, high, mean, sd, and bandwidth before it shrinks with a correlation."""
    c = [F.col("h")[j] for j in range(k)]
    row = h.agg(F.count("*"), *(f(x) for x in c for f in (F.min, F.max, F.avg)), *(F.sum((x.isNull() | F.isnan(x)).cast("int")) for x in c)).first()
    n = row[0]
    if n and any(row[1 + 3 * k :]):
        raise ValueError("scores must be numbers")
    low, high, mean = (np.array([row[1 + 3 * j + i] or 0.0 for j in range(k)]) for i in range(3))
    sd = np.sqrt(np.array([x or 0.0 for x in h.agg(*(F.sum((x - float(m)) * (x - float(m))) for x, m in zip(c, mean))).first()]) / max(n - 1, 1))
    width = (high - low) * 1.01 / BINS
    b = [F.least(F.floor((x - float(low[j])) / float(width[j])), F.lit(BINS - 1)) if width[j] > 0 else F.lit(0) for j, x in enumerate(c)]
    counts = np.zeros((k, BINS))
    for r in h.select(F.posexplode(F.array(*(x.cast("int") for x in b))).alias("j", "b")).groupBy("j", "b").count().collect():
        counts[r[0], r[1]] = r[2]
    band = np.array([binned_bandwidth(counts[j], width[j], sd[j]) if sd[j] > 0 else 0.0 for j in range(k)])
    return {"n": n, "low": low, "high": high, "mean": mean, "sd": sd, "band": band}


def kernels(grid: np.ndarray, x: np.ndarray, width: float) -> np.ndarray:
    return np.exp(-0.5 * ((grid[:, None] - x) / width) ** 2) / np.sqrt(2 * np.pi)


def shrunk(band: float, rho: float) -> float:
    return max(band * (1 - 0.75 * abs(rho)) / 4, 1e-12)


def kernel_sums(h: DataFrame, wanted: list[tuple], size: int, one) -> np.ndarray:
    """one(scores, what) -> vector of `size`, for each wanted and summed over all samples: in a task, then by groups."""
    def run(batches):
        total = np.zeros((len(wanted), size))
        for b in batches:
            if b.num_rows:
                y = b.column("h").values.to_numpy().reshape(b.num_rows, -1)
                for i, w in enumerate(wanted):
                    total[i] += one(y, w)
        at = np.arange(len(wanted))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(at, size), pa.int32()), pa.array(np.tile(np.arange(size), len(at)), pa.int32()), pa.array(total.reshape(-1))], names=["i", "c", "v"])

    out = np.zeros((len(wanted), size))
    for r in h.select("h").mapInArrow(run, "i int, c int, v double").groupBy("i", "c").agg(F.sum("v")).collect():
        out[r[0], r[1]] = r[2]
    return out


def information_matrix(h: DataFrame, k: int) -> np.ndarray:
    """Coefficients between factors, over all samples: the density grids of all pairs are sums of one pass."""
    h = materialized(h.select("h"), "scores")
    s = score_summaries(h, k)
    out = np.eye(k)
    n, pairs = s["n"], [(i, j) for i in range(k) for j in range(i + 1, k) if s["sd"][i] > 0 and s["sd"][j] > 0]
    if n <= 2 or not pairs:
        return out
    row = h.agg(*(F.sum((F.col("h")[i] - float(s["mean"][i])) * (F.col("h")[j] - float(s["mean"][j]))) for i, j in pairs)).first()
    rho = [float(np.clip(c / ((n - 1) * s["sd"][i] * s["sd"][j]), -1, 1)) for c, (i, j) in zip(row, pairs)]
    grid = [np.linspace(a, b, GRID) for a, b in zip(s["low"], s["high"])]
    wanted = [(i, j, shrunk(s["band"][i], r), shrunk(s["band"][j], r)) for (i, j), r in zip(pairs, rho)]
    sums = kernel_sums(h, wanted, GRID * GRID, lambda y, w: (kernels(grid[w[0]], y[:, w[0]], w[2]) @ kernels(grid[w[1]], y[:, w[1]], w[3]).T).reshape(-1))
    for (i, j, hx, hy), r, f in zip(wanted, rho, sums):
        out[i, j] = out[j, i] = density_coefficient(f.reshape(GRID, GRID) / (n * hx * hy) + EPS, grid[i], grid[j], r)
    return out


def numbers(m: CountMatrix) -> CountMatrix:
    """The matrix with null and NaN values as zeros; their features stay."""
    v = F.col("value").cast("double")
    return m.with_entries(m.entries.withColumn("value", F.when(v.isNull() | F.isnan(v), F.lit(0.0)).otherwise(v)))


def associate_ic_passes(m: CountMatrix, h: DataFrame, k: int, features: int = 2000) -> DataFrame:
    """As associate_ic for any number of samples: bandwidths from distances in bins, then kernel sums on the grid. Only
    stored entries are visited with their sample's scores; the block of zeros is the kernel at zero times what the sum over
    all samples has beyond the stored ones. Features are taken by their hash, about `features` at a time."""
    m = numbers(m)
    h = materialized(h.select("sample_id", "h"), "scores")
    e = materialized(m.entries.join(h, "sample_id").select("feature_id", "sample_id", F.col("value").cast("double").alias("value"), "h"), "scored")
    s = score_summaries(h, k)
    names = materialized(m.entries.select("feature_id").distinct(), "features")
    kind = dict(m.entries.dtypes)["feature_id"]
    parts = 1 + names.count() // features
    out = None
    for part in range(parts):
        mine = F.pmod(F.xxhash64("feature_id"), F.lit(parts)) == part
        one = names.where(mine).join(_ic_part(e.where(mine), h, k, s, kind), "feature_id", "left") if s["n"] > 2 else names.where(mine).withColumn("ic", F.lit(None).cast("array<double>"))
        out = one if out is None else out.unionByName(one)
    zero = F.array(*(F.lit(0.0) for _ in range(k)))
    return out.select("feature_id", F.posexplode(F.coalesce("ic", zero)).alias("i", "assoc")).select("feature_id", (F.col("i") + 1).alias("factor_idx"), "assoc")


def _ic_part(e: DataFrame, h: DataFrame, k: int, s: dict, kind: str) -> DataFrame:
    """(feature_id, ic array<double>) of the features in e(feature_id, sample_id, value, h)."""
    spark, n = e.sparkSession, s["n"]
    v = F.col("value")
    rows = e.groupBy("feature_id").agg(F.count("*").alias("m"), F.min("value").alias("low"), F.max("value").alias("high"), F.sum(v).alias("s"), F.array(*(F.sum(v * (F.col("h")[j] - float(s["mean"][j]))) for j in range(k))).alias("p")).collect()
    at = {r.feature_id: i for i, r in enumerate(rows)}
    stored = np.array([r.m for r in rows])
    low = np.array([min(r.low, 0.0) if r.m < n else r.low for r in rows])
    high = np.array([max(r.high, 0.0) if r.m < n else r.high for r in rows])
    mean = np.array([r.s / n for r in rows])
    width = (high - low) * 1.01 / BINS
    dim = F.broadcast(spark.createDataFrame([(r.feature_id, float(low[i]), float(width[i]), float(mean[i])) for i, r in enumerate(rows) if width[i] > 0], f"feature_id {kind}, low double, width double, mean double"))
    b = e.join(dim, "feature_id").groupBy("feature_id", F.least(F.floor((v - F.col("low")) / F.col("width")), F.lit(BINS - 1)).cast("int").alias("b")).agg(F.count("*").alias("c"), F.sum((v - F.col("mean")) * (v - F.col("mean"))).alias("q"))

    def banded(g: pd.DataFrame) -> pd.DataFrame:
        i = at[g.feature_id.iloc[0]]
        c = np.bincount(g.b, weights=g.c, minlength=BINS)
        c[min(int((0 - low[i]) / width[i]), BINS - 1) if stored[i] < n else 0] += n - stored[i]
        sd = np.sqrt((g.q.sum() + (n - stored[i]) * mean[i] ** 2) / (n - 1))
        return pd.DataFrame({"i": [i], "sd": [sd], "band": [binned_bandwidth(c, width[i], sd)]})

    known = {r.i: (r.sd, r.band) for r in b.groupBy("feature_id").applyInPandas(banded, "i int, sd double, band double").collect()}
    wanted = []  # (feature, factor, correlation, bandwidths)
    for i, r in enumerate(rows):
        for j in range(k):
            if i in known and s["sd"][j] > 0:
                rho = float(np.clip(r.p[j] / ((n - 1) * known[i][0] * s["sd"][j]), -1, 1))
                wanted.append((i, j, rho, shrunk(known[i][1], rho), shrunk(s["band"][j], rho)))
    gx = [np.linspace(a, z, GRID) for a, z in zip(low, high)]
    gy = [np.linspace(a, z, GRID) for a, z in zip(s["low"], s["high"])]
    whole = kernel_sums(h, wanted, GRID, lambda y, w: kernels(gy[w[1]], y[:, w[1]], w[4]).sum(axis=1))
    by = {}
    for w, total in zip(wanted, whole):
        by.setdefault(w[0], []).append((w, total))

    def visited(batches):
        grids, now = {}, None

        def done():
            ws = by.get(now, [])
            if grids:
                yield pa.RecordBatch.from_arrays([pa.array([now] * len(ws), pa.int32()), pa.array([w[1] for w, _ in ws], pa.int32()), pa.array([np.concatenate([grids[w[1]][0].reshape(-1), grids[w[1]][1]]).tolist() for w, _ in ws], pa.list_(pa.float64()))], names=["i", "j", "g"])

        for b in batches:
            if not b.num_rows:
                continue
            i = np.array([at[f] for f in b.column("feature_id").to_pylist()])
            x, y = b.column("value").to_numpy(), b.column("h").values.to_numpy().reshape(b.num_rows, k)
            cuts = [0, *(np.flatnonzero(np.diff(i)) + 1).tolist(), len(i)]
            for a, z in zip(cuts, cuts[1:]):
                if i[a] != now:
                    yield from done()
                    grids, now = {}, int(i[a])
                for (f, j, _, hx, hy), _ in by.get(now, []):
                    ky = kernels(gy[j], y[a:z, j], hy)
                    g, t = grids.get(j, (0.0, 0.0))
                    grids[j] = g + kernels(gx[f], x[a:z], hx) @ ky.T, t + ky.sum(axis=1)
        yield from done()

    # a feature's entries are dealt to tasks by about a million, so none of them holds a frequent feature alone
    spread = F.pmod(F.xxhash64("sample_id"), F.lit(1 + n // 1_000_000))
    sums = e.repartition(F.col("feature_id"), spread).sortWithinPartitions("feature_id").select("feature_id", "value", "h").mapInArrow(visited, "i int, j int, g array<double>")
    names = [r.feature_id for r in rows]

    def one(g: pd.DataFrame) -> pd.DataFrame:
        i = int(g.i.iloc[0])
        ic = [0.0] * k
        for (_, j, rho, hx, hy), total in by[i]:
            got = np.sum(np.stack(g.g[g.j == j].to_list()), axis=0)
            f, t = got[: GRID * GRID].reshape(GRID, GRID), got[GRID * GRID :]
            if stored[i] < n:
                f = f + np.outer(kernels(gx[i], np.zeros(1), hx)[:, 0], np.maximum(total - t, 0))
            ic[j] = density_coefficient(f / (n * hx * hy) + EPS, gx[i], gy[j], rho)
        return pd.DataFrame({"feature_id": [names[i]], "ic": [ic]})

    return sums.groupBy("i").applyInPandas(one, f"feature_id {kind}, ic array<double>")


def associate_ic(m: CountMatrix, h: DataFrame, k: int, most: int = 2_000_000) -> DataFrame:
    """Information coefficients of every feature with every factor; absent entries, nulls and NaN are zeros. Up to `most`
    numbers the scores are the broadcast side and a feature's stored entries one group; beyond, passes sum the kernels."""
    m = numbers(m)
    if h.limit(most // max(k, 1) + 1).count() * k > most:
        return associate_ic_passes(m, h, k)
    rows = h.orderBy("sample_id").collect()
    at = {r.sample_id: i for i, r in enumerate(rows)}
    scores = np.array([r.h for r in rows])
    kind = dict(m.entries.dtypes)["feature_id"]

    def one(g: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(len(scores))
        for s, v in zip(g.sample_id, g.value):
            if s in at:
                x[at[s]] = v
        return pd.DataFrame({"feature_id": [g.feature_id.iloc[0]] * k, "factor_idx": np.arange(1, k + 1), "assoc": [information_coefficient(x, scores[:, j]) for j in range(k)]})

    return m.entries.groupBy("feature_id").applyInPandas(one, f"feature_id {kind}, factor_idx int, assoc double")


def factor_association(m: CountMatrix, h: DataFrame, k: int, metric: str = "IC") -> DataFrame:
    """(feature_id, factor_idx, assoc)."""
    f = {"pearson": associate_pearson, "spearman": associate_spearman, "ic": associate_ic}.get(metric.lower())
    if f is None:
        raise ValueError(f"unknown metric {metric}")
    return f(m, h, k)


def summarize_assoc(assoc: DataFrame, n: int = 10, features: DataFrame | None = None) -> DataFrame:
    """The n features most associated with each factor: (assoc, feature_id, factor_idx)."""
    a = assoc if features is None else assoc.join(features.select("feature_id"), "feature_id", "left_semi")
    w = Window.partitionBy("factor_idx").orderBy(F.col("assoc").desc_nulls_last(), "feature_id")
    return a.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).select("assoc", "feature_id", "factor_idx")


def geneset_sums(m: CountMatrix, genesets: DataFrame) -> DataFrame:
    """(geneset, sample_id, total): sums of members' values, the right-hand side of the projection on sets."""
    long = bounded(genesets_indicator(genesets))
    return m.entries.join(long, "feature_id").groupBy("geneset", "sample_id").agg(F.sum("value").alias("total"))


def project_genesets(m: CountMatrix, genesets: DataFrame, method: str = "lm", max_iter: int = 20, loss: str = "mse") -> tuple[list[str], DataFrame, DataFrame]:
    """(names, w(feature_id, w), h(sample_id, h)): scores of sets. lm: least squares (or, with the loss "mkl", least KL
    divergence) on membership; mf: factorisation whose loadings stay 0 outside of the sets."""
    names = sorted(r[0] for r in few(genesets.select("geneset").distinct(), 10_000, "sets"))
    k = len(names)
    at = F.create_map(*(x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))))
    member = genesets_indicator(genesets).join(m.features, "feature_id", "left_semi").withColumn("i", at[F.col("geneset")])
    w = member.groupBy("feature_id").agg(F.collect_set("i").alias("s")).select("feature_id", F.array(*(F.when(F.array_contains("s", i), 1.0).otherwise(0.0) for i in range(k))).alias("w"))
    if method == "lm" and loss == "mkl":
        return names, w, project_samples(m, w, k, loss=loss)
    _check_loss(loss)
    if method == "lm":
        return names, w, _completed(solved(products(m.entries, bounded(w), "feature_id", "sample_id", "w", k), gram_of(w, "w", k), "sample_id", "h"), m.samples, "sample_id", "h", k)
    if method != "mf":
        raise ValueError(f"unknown method {method}")
    pk = linalg.packed(m.subset(features=w.select("feature_id")))
    mask = np.zeros((pk.p, k))
    index = {f: i for i, f in enumerate(pk.features)}
    for r in w.collect():
        mask[index[r.feature_id]] = r.w
    x = mask.copy()
    if loss == "mkl":
        for _ in range(max_iter):  # a zero stays a zero under multiplicative updates
            def visit(a, x=x):
                h = kl_scores(a, x)
                return a.across(h, a.val / (a.products(h, x) + 1e-12)), h.sum(axis=0)

            up, down = linalg.summed(pk, visit, k, k)
            x = x * up / np.maximum(down, 1e-300)
        h = linalg.each(pk, lambda a: kl_scores(a, x), "h")
    else:
        for _ in range(max_iter):
            g = x.T @ x

            def visit(a, x=x, g=g):
                h = linalg.nnls(g, a @ x)
                return a.across(h), (h.T @ h).reshape(-1)

            b, hh = linalg.summed(pk, visit, k, k * k)
            hh = hh.reshape(k, k)
            new = np.zeros_like(x)
            for pattern in {tuple(r) for r in mask.astype(bool).tolist()}:
                cols = np.flatnonzero(pattern)
                rows = np.flatnonzero((mask.astype(bool) == np.array(pattern)).all(axis=1))
                if len(cols):
                    new[np.ix_(rows, cols)] = linalg.nnls(hh[np.ix_(cols, cols)], b[np.ix_(rows, cols)])
            x = new
        g = x.T @ x
        h = linalg.each(pk, lambda a: linalg.nnls(g, a @ x), "h")
    spark = m.entries.sparkSession
    kind = dict(m.features.dtypes)["feature_id"]
    return names, spark.createDataFrame([(f, [float(v) for v in row]) for f, row in zip(pk.features, x)], f"feature_id {kind}, w array<double>"), h


def geneset_loadings(w: DataFrame, weights: DataFrame, genesets: DataFrame) -> DataFrame:
    """(geneset, factor_idx, loading): mean over a set's members of loading * weight. weights: (feature_id, geneset, weight)."""
    long = w.select("feature_id", F.posexplode("w").alias("i", "x"))
    j = long.join(genesets_indicator(genesets), "feature_id").join(weights, ["feature_id", "geneset"])
    return j.groupBy("geneset", (F.col("i") + 1).alias("factor_idx")).agg(F.avg(F.col("x") * F.col("weight")).alias("loading"))


def select_genesets(m: CountMatrix, h: DataFrame, k: int, genesets: DataFrame, metric: str = "pearson", method: str = "lm", n: int = 5) -> DataFrame:
    """The sets most associated with each factor: project, associate, summarise."""
    names, _, scores = project_genesets(m, genesets, method)
    label = F.array(*(F.lit(x) for x in names))
    long = scores.select("sample_id", F.posexplode("h").alias("i", "value")).select(F.element_at(label, F.col("i") + 1).alias("feature_id"), "sample_id", "value")
    sets = CountMatrix(long.where("value != 0"), m.entries.sparkSession.createDataFrame([(x,) for x in names], "feature_id string"), m.samples)
    return summarize_assoc(factor_association(sets, h, k, metric), n)


def check_gene_embedding(w: DataFrame, k: int, m: CountMatrix, groups: DataFrame, embedded: DataFrame, min_cluster_logfc: float = 1.5, min_factor_logfc: float = 1.5, eps: float = 1e-4, compat: bool = False) -> DataFrame:
    """(feature_id, cluster, cluster_logfc, factor_logfc, embedded, weak): how specific a feature is to its strongest
    cluster and factor. Loadings are scaled by factor; with compat by the factor sums recycled down the features."""
    sums = [x or 0.0 for x in w.agg(*(F.sum(F.col("w")[i]) for i in range(k))).first()]
    tot = F.array(*(F.lit(float(s)) for s in sums))
    if compat:
        from .ranking import dense_index

        d = dense_index(w, "feature_id", "j")
        p = d.count()
        scaled = d.select("feature_id", F.transform("w", lambda x, i: x / F.element_at(tot, ((F.col("j") + i * p) % k + 1).cast("int"))).alias("w"))
    else:
        scaled = w.select("feature_id", F.transform("w", lambda x, i: x / F.nullif(F.element_at(tot, i + 1), F.lit(0.0))).alias("w"))
    top = F.array_max("w")
    rest = (F.aggregate("w", F.lit(0.0), lambda a, x: a + x) - top) / F.lit(float(k - 1))
    fac = scaled.select("feature_id", F.log2((top + eps) / (rest + eps)).alias("factor_logfc"))
    g = groups.where("grp is not null")
    sizes = bounded(g.groupBy("grp").agg(F.count("*").alias("size")))
    n = g.count()
    per = m.entries.join(g, "sample_id").groupBy("feature_id", "grp").agg(F.sum("value").alias("t")).join(sizes, "grp")
    best = per.withColumn("all", F.sum("t").over(Window.partitionBy("feature_id"))).withColumn("mean", F.col("t") / F.col("size"))
    best = best.groupBy("feature_id").agg(F.max(F.struct("mean", "grp", "t", "size", "all")).alias("b"))
    others = (F.col("b.all") - F.col("b.t")) / F.nullif(F.lit(n) - F.col("b.size"), F.lit(0))
    clu = best.select("feature_id", F.col("b.grp").alias("cluster"), F.log2((F.col("b.mean") + eps) / (F.coalesce(others, F.lit(0.0)) + eps)).alias("cluster_logfc"))
    e = embedded.select("feature_id").distinct().withColumn("__e", F.lit(True))
    out = clu.join(fac, "feature_id").join(e, "feature_id", "left").withColumn("embedded", F.coalesce("__e", F.lit(False))).drop("__e")
    return out.withColumn("weak", F.col("embedded") & ((F.col("cluster_logfc") < min_cluster_logfc) | (F.col("factor_logfc") < min_factor_logfc)))
