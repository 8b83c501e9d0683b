"""Placing factors, samples and features in one plane."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..model import Embedding, Twinned, bounded

#: Names of distances, lower case, to the measure that they mean.
DISTANCES = {"pearson": "pearson", "cor": "pearson", "correlation": "pearson", "ic": "ic", "mutual": "ic", "information": "ic", "mutual information": "ic", "cosine": "cosine", "euclidean": "euclidean"}


def factor_distance_table(h: DataFrame, k: int, dist: str = "cosine") -> DataFrame:
    """(f1, f2, dist) of the pairs f1 < f2 of factors over all samples: sums in one aggregate, but for the information distance,
    which takes passes."""
    kind = DISTANCES.get(dist.lower())
    if kind is None:
        raise ValueError(f"unknown distance {dist}")
    names = [(i, j) for i in range(k) for j in range(i + 1, k)]
    if kind == "ic":
        from .annotate import information_matrix

        r = information_matrix(h, k)
        return h.sparkSession.createDataFrame([(i + 1, j + 1, float(np.sqrt(max(0.0, 2 * (1 - r[i, j]))))) for i, j in names], "f1 int, f2 int, dist double")
    c, total = (lambda i: F.col("h")[i]), (lambda x: F.coalesce(F.sum(x), F.lit(0.0)))
    sums = [F.count("*").alias("n"), *(total(c(i)).alias(f"s{i}") for i in range(k)), *(total(c(i) * c(i)).alias(f"q{i}") for i in range(k)), *(total(c(i) * c(j)).alias(f"g{i}_{j}") for i, j in names)]
    least = F.lit(1e-300)

    def value(i, j):
        g, qi, qj, si, sj, n = (F.col(x) for x in (f"g{i}_{j}", f"q{i}", f"q{j}", f"s{i}", f"s{j}", "n"))
        if kind == "euclidean":
            return F.sqrt(F.greatest(F.lit(0.0), qi + qj - 2 * g))
        if kind == "cosine":
            return 1 - g / F.sqrt(F.greatest(qi * qj, least))
        n = F.greatest(n, F.lit(1))
        vi, vj = F.greatest(qi - si * si / n, least), F.greatest(qj - sj * sj / n, least)
        return F.sqrt(F.greatest(F.lit(0.0), 2 * (1 - (g - si * sj / n) / (F.sqrt(vi) * F.sqrt(vj)))))

    pairs = F.explode(F.array(*(F.struct(F.lit(i + 1).alias("f1"), F.lit(j + 1).alias("f2"), value(i, j).alias("dist")) for i, j in names))).alias("p")
    return h.agg(*sums).select(pairs).select("p.*")


def factor_distances(h: DataFrame, k: int, dist: str = "cosine") -> np.ndarray:
    """The same as a k x k array."""
    d = np.zeros((k, k))
    for r in factor_distance_table(h, k, dist).collect():
        d[r.f1 - 1, r.f2 - 1] = d[r.f2 - 1, r.f1 - 1] = r.dist
    return d


def classical_mds(d: np.ndarray) -> np.ndarray:
    n = len(d)
    j = np.eye(n) - 1.0 / n
    b = -j @ (d * d) @ j / 2
    values, vectors = np.linalg.eigh((b + b.T) / 2)
    order = np.argsort(-values)[:2]
    xy = vectors[:, order] * np.sqrt(np.maximum(values[order], 0))
    return np.pad(xy, ((0, 0), (0, 2 - xy.shape[1])))


def sammon(d: np.ndarray, rounds: int = 250, magic: float = 0.2, tol: float = 1e-4, floor: float = 1e-12) -> tuple[np.ndarray, float]:
    """(k x 2 coordinates, stress) of Sammon's mapping: from classical scaling, second-order steps that are halved while
    the stress rises. Equal factors get a tiny distance. Axes are turned so that their largest entry is positive."""
    n = len(d)
    d = np.maximum(d, floor)
    np.fill_diagonal(d, 1.0)
    off = ~np.eye(n, dtype=bool)
    y = classical_mds(np.where(off, d, 0))
    if not np.ptp(y[:, 1]) > 0:
        y[:, 1] += 1e-6 * np.arange(n)
    c = d[off].sum()

    def stress(y):
        e = np.sqrt(((y[:, None] - y[None]) ** 2).sum(axis=2))
        return float((((d - e) ** 2 / d)[off]).sum() / c)

    now = stress(y)
    for _ in range(rounds):
        diff = y[:, None] - y[None]
        e = np.maximum(np.sqrt((diff**2).sum(axis=2)), floor)
        np.fill_diagonal(e, 1.0)
        gap = np.where(off, (d - e) / (d * e), 0.0)
        first = -2 / c * (gap[..., None] * diff).sum(axis=1)
        second = -2 / c * np.where(off[..., None], (1 / (d * e))[..., None] * ((d - e)[..., None] - diff**2 / e[..., None] * (1 + (d - e) / e)[..., None]), 0).sum(axis=1)
        step, size = first / np.maximum(np.abs(second), floor), magic
        for _ in range(20):
            new = y - size * step
            s = stress(new)
            if s < now:
                break
            size /= 2
        if not s < now:
            break
        done = now - s < tol * now * 1e-2
        y, now = new, s
        magic = min(1.0, size * 1.5)
        if done:
            break
    for a in range(2):
        if y[np.abs(y[:, a] - y[:, a].mean()).argmax(), a] < y[:, a].mean():
            y[:, a] = -y[:, a]
    return y, now


def unit(y: np.ndarray) -> np.ndarray:
    span = np.ptp(y, axis=0)
    return (y - y.min(axis=0)) / np.where(span > 0, span, 1)


def factor_coordinates(h: DataFrame, k: int, method: str = "sammon", dist: str = "cosine") -> DataFrame:
    """(factor, factor_idx, x, y, name): one row per factor."""
    if method != "sammon":
        raise ValueError("only the Sammon projection is available")
    xy = unit(sammon(factor_distances(h, k, dist))[0])
    return h.sparkSession.createDataFrame([(f"factor_{i + 1}", i + 1, float(xy[i, 0]), float(xy[i, 1]), f"factor_{i + 1}") for i in range(k)], "factor string, factor_idx int, x double, y double, name string")


def pulled(scores: DataFrame, factors: DataFrame, key: str, column: str, alpha: float = 1.0, n_pull: int | None = None) -> DataFrame:
    """(key, x, y): mean of the coordinates of the n_pull strongest factors (at least 3, at most all; ties: lower index),
    weighed by score ** alpha. Array functions only: each row is placed by itself, without a shuffle."""
    xy = sorted((r.factor_idx, r.x, r.y) for r in factors.select("factor_idx", "x", "y").collect())
    k = len(xy)
    n = k if n_pull is None else min(k, max(3, n_pull))
    s = F.transform(F.col(column), lambda v, i: F.struct((-v).alias("m"), i.alias("i")))
    xs, ys = (F.array(*(F.lit(float(r[a])) for r in xy)) for a in (1, 2))
    top = F.slice(F.array_sort(s), 1, n)
    d = scores.select(key, top.alias("t"))
    weight = lambda e: F.pow(-e["m"], F.lit(float(alpha)))
    total = lambda f: F.aggregate("t", F.lit(0.0), lambda a, e: a + f(e))
    d = d.select(key, total(weight).alias("w"), total(lambda e: weight(e) * F.element_at(xs, e["i"] + 1)).alias("sx"), total(lambda e: weight(e) * F.element_at(ys, e["i"] + 1)).alias("sy"))
    return d.select(key, (F.col("sx") / F.nullif(F.col("w"), F.lit(0.0))).alias("x"), (F.col("sy") / F.nullif(F.col("w"), F.lit(0.0))).alias("y"))


def averaged(rows: DataFrame, g: Twinned, columns: list[str], exp: float) -> DataFrame:
    """(sample_id, columns): means over a graph's links, weighed by weight ** exp. Classes are summed first; a sample's own class
    counts without it."""
    m = g.members.join(rows, "sample_id")
    sums = m.groupBy("cls").agg(F.count("*").alias("__n"), *(F.sum(c).alias(f"__s{i}") for i, c in enumerate(columns)))
    w = F.pow("weight", F.lit(float(exp)))
    far = g.links.where("src != dst").select("src", F.col("dst").alias("cls"), w.alias("__w")).join(sums, "cls")
    far = far.groupBy(F.col("src").alias("cls")).agg(F.sum(F.col("__w") * F.col("__n")).alias("__t"), *(F.sum(F.col("__w") * F.col(f"__s{i}")).alias(f"__f{i}") for i in range(len(columns))))
    each = m.join(sums.join(far, "cls", "left"), "cls")
    twin = F.coalesce(F.pow("twin", F.lit(float(exp))), F.lit(0.0))
    none = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    total = F.lit(1.0) + twin * (F.col("__n") - 1) + none("__t")
    return each.select("sample_id", *(((F.col(c) + twin * (F.col(f"__s{i}") - F.col(c)) + none(f"__f{i}")) / total).alias(c) for i, c in enumerate(columns)))


def smoothed(coords: DataFrame, edges: DataFrame | Twinned, exp: float = 1.0) -> DataFrame:
    """Mean of the neighbours' coordinates, weighed by weight ** exp: (sample_id, x, y)."""
    if isinstance(edges, Twinned):
        return averaged(coords, edges, ["x", "y"], exp)
    e = edges.withColumn("w", F.pow("weight", F.lit(float(exp)))).join(coords.withColumnRenamed("sample_id", "dst"), "dst")
    return e.groupBy("src").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("y")).withColumnRenamed("src", "sample_id")


def smoothed_scores(h: DataFrame, edges: DataFrame | Twinned, k: int, exp: float = 1.0) -> DataFrame:
    """Scores averaged over a row-normalised graph: (sample_id, h)."""
    if isinstance(edges, Twinned):
        wide = averaged(h.select("sample_id", *(F.col("h")[i].alias(f"c{i}") for i in range(k))), edges, [f"c{i}" for i in range(k)], exp)
        return wide.select("sample_id", F.array(*(f"c{i}" for i in range(k))).alias("h"))
    e = edges.withColumn("w", F.pow("weight", F.lit(float(exp)))).join(h.withColumnRenamed("sample_id", "dst"), "dst")
    sums = e.groupBy("src").agg(F.sum("w").alias("t"), *(F.sum(F.col("w") * F.col("h")[i]).alias(f"c{i}") for i in range(k)))
    return sums.select(F.col("src").alias("sample_id"), F.array(*(F.col(f"c{i}") / F.col("t") for i in range(k))).alias("h"))


def embed_samples(h: DataFrame, k: int, snn: DataFrame | Twinned | None = None, alpha_exp: float = 1.0, snn_exp: float = 1.0, n_pull: int | None = None, method: str = "sammon", dist: str = "cosine", snn_factor_proj: bool = True) -> Embedding:
    """Samples without factor mass are dropped; factors are placed by Sammon's mapping of their distances (over smoothed
    scores if there is a graph), samples by their strongest factors, then smoothed by the graph."""
    from .filtering import drop_empty_samples

    if isinstance(snn, Twinned):
        h, _ = drop_empty_samples(h)
    else:
        h, snn = drop_empty_samples(h, snn)
    base = smoothed_scores(h, snn, k, snn_exp) if snn is not None and snn_factor_proj else h
    factors = factor_coordinates(base, k, method, dist)
    coords = pulled(h, factors, "sample_id", "h", alpha_exp, n_pull)
    return Embedding(factors, coords if snn is None else smoothed(coords, snn, snn_exp))


def scaled_rows(assoc: DataFrame, key: str, column: str) -> DataFrame:
    """Each row's min-max across factors; a constant row becomes ones."""
    low, high = F.array_min(column), F.array_max(column)
    return assoc.select(key, F.when(high == low, F.transform(column, lambda _: F.lit(1.0))).otherwise(F.transform(column, lambda v: (v - low) / (high - low))).alias(column))


def embed_features(emb: Embedding, assoc: DataFrame, features: DataFrame | None = None, alpha_exp: float = 1.0, n_pull: int | None = None, scale_cols: bool = True, overwrite: bool = True) -> Embedding:
    """Places features (all, if none are named) by their association (feature_id, a array) with the factors."""
    a = assoc if features is None else assoc.join(features.select("feature_id"), "feature_id", "left_semi")
    coords = pulled(scaled_rows(a, "feature_id", "a") if scale_cols else a, emb.factors, "feature_id", "a", alpha_exp, n_pull)
    if not overwrite and emb.features is not None:
        coords = emb.features.unionByName(coords)
    return Embedding(emb.factors, emb.samples, coords)


def project_embedding(emb: Embedding, h_test: DataFrame, snn: DataFrame | None = None, alpha_exp: float = 1.0, snn_exp: float = 1.0, n_pull: int | None = None, copies: DataFrame | None = None) -> DataFrame:
    """(sample_id, x, y) of new samples in a frozen embedding: by factors, then averaged with the training samples that
    (test_id, train_id, weight) links them to, their own place weighing 1. `copies`: (sample_id, test_id) of all new samples, where
    several have the links of one."""
    own = pulled(h_test, emb.factors, "sample_id", "h", alpha_exp, n_pull)
    if snn is None:
        return own
    e = snn.join(emb.samples.withColumnRenamed("sample_id", "train_id"), "train_id").withColumn("w", F.pow("weight", F.lit(float(snn_exp))))
    sums = e.groupBy("test_id").agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("x")).alias("sx"), F.sum(F.col("w") * F.col("y")).alias("sy"))
    own = own.withColumn("test_id", F.col("sample_id")) if copies is None else own.join(copies, "sample_id", "left")
    none = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    mean = lambda x: (F.when(F.col(x).isNotNull() | F.col(f"s{x}").isNotNull(), none(x) + none(f"s{x}")) / (F.lit(1.0) + none("sw"))).alias(x)
    return own.join(sums, "test_id", "left").select("sample_id", mean("x"), mean("y"))


def rename_factors(factors: DataFrame, mapping: DataFrame, set_empty: bool = True) -> DataFrame:
    """`name` by (old, new); with set_empty a name that didn't change becomes empty."""
    j = factors.join(bounded(mapping.select(F.col("old").alias("__o"), "new")), F.col("name") == F.col("__o"), "left")
    new = F.coalesce("new", "name")
    return j.withColumn("name", F.when(F.lit(set_empty) & (new == F.col("name")), F.lit("")).otherwise(new)).drop("__o", "new")


def region_scores(regions: DataFrame, genes: DataFrame, promoter_only: bool = True) -> DataFrame:
    """(feature_id, a): mean region scores by gene, of regions annotated as promoters (or also introns and exons). regions:
    (region_id, symbol, annotation, a array). Raises if no region is left."""
    pattern = "Promoter" if promoter_only else "Promoter|Intron|Exon"
    r = regions.where(F.col("annotation").rlike(pattern)).join(genes.select(F.col("feature_id").alias("symbol")), "symbol", "left_semi")
    k = r.select(F.size("a")).limit(1).collect()
    if not k:
        raise ValueError("no region of these genes has such an annotation")
    means = r.groupBy("symbol").agg(*(F.avg(F.col("a")[i]).alias(f"c{i}") for i in range(k[0][0])))
    return means.select(F.concat("symbol", F.lit("-pr")).alias("feature_id"), F.array(*(f"c{i}" for i in range(k[0][0]))).alias("a"))


def missing_genes(regions: DataFrame, genes: DataFrame) -> DataFrame:
    return genes.select("feature_id").join(regions.select(F.col("symbol").alias("feature_id")), "feature_id", "left_anti")


def embed_promoters(emb: Embedding, regions: DataFrame, genes: DataFrame, alpha_exp: float = 1.0, n_pull: int = 3, scale_cols: bool = True, overwrite: bool = True, promoter_only: bool = True) -> Embedding:
    return embed_features(emb, region_scores(regions, genes, promoter_only), None, alpha_exp, n_pull, scale_cols, overwrite)


def tfbs_scores(regions: DataFrame, motifs: DataFrame) -> DataFrame:
    """(feature_id, a): for each factor the sum of scores of the regions that hold its motif. motifs: (region_id, tf, hit)."""
    k = regions.select(F.size("a")).first()[0]
    s = motifs.where("hit != 0").join(regions.select("region_id", "a"), "region_id").groupBy("tf").agg(*(F.sum(F.col("hit") * F.col("a")[i]).alias(f"c{i}") for i in range(k)))
    return s.select(F.concat("tf", F.lit("-tfbs")).alias("feature_id"), F.array(*(f"c{i}" for i in range(k))).alias("a"))


def deviation_scores(dev: DataFrame, h: DataFrame, k: int) -> DataFrame:
    """(feature_id, a): Pearson correlation of deviations (tf, sample_id, dev) with each factor's scores."""
    j = dev.join(h, "sample_id").groupBy("tf").agg(*(F.corr("dev", F.col("h")[i]).alias(f"c{i}") for i in range(k)))
    return j.select(F.concat("tf", F.lit("-tfbs")).alias("feature_id"), F.array(*(f"c{i}" for i in range(k))).alias("a"))


def embed_tfbs(emb: Embedding, regions: DataFrame | None = None, motifs: DataFrame | None = None, dev: DataFrame | None = None, h: DataFrame | None = None, k: int | None = None, genes: DataFrame | None = None, alpha_exp: float = 1.0, n_pull: int = 3, scale_cols: bool = True, overwrite: bool = True) -> Embedding:
    if dev is not None:
        a = deviation_scores(dev, h, k)
    elif motifs is not None:
        a = tfbs_scores(regions, motifs)
    else:
        raise ValueError("either deviations or motif hits are needed")
    if genes is not None:
        a = a.join(genes.select(F.concat("feature_id", F.lit("-tfbs")).alias("feature_id")), "feature_id", "left_semi")
    return embed_features(emb, a, None, alpha_exp, n_pull, scale_cols, overwrite)
