"""The tables behind plots; drawing them is left to the caller."""

from __future__ import annotations

import colorsys
import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import scans
from ..model import Embedding


def grouped_points(coords: DataFrame, groups: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """(sample_id, x, y, grp): coordinates with their group, null where there is none; named samples only, if given."""
    c = coords if samples is None else coords.join(samples.select("sample_id"), "sample_id", "left_semi")
    return c.join(groups, "sample_id", "left").select("sample_id", "x", "y", "grp")


def group_medians(points: DataFrame) -> DataFrame:
    """(label, x, y): where a group's name stands."""
    p = points.where("grp is not null")
    x, y = (scans.percentiles(p, ["grp"], c, {c: 0.5}) for c in ("x", "y"))
    return x.join(y, "grp").select(F.col("grp").cast("string").alias("label"), "x", "y")


def embedding_labels(emb: Embedding, points: DataFrame) -> DataFrame:
    """(kind, label, x, y): groups, visible factors and features."""
    out = group_medians(points).select(F.lit("group").alias("kind"), "label", "x", "y")
    out = out.unionByName(emb.factors.where("name != ''").select(F.lit("factor").alias("kind"), F.col("name").alias("label"), "x", "y"))
    if emb.features is not None:
        out = out.unionByName(emb.features.select(F.lit("feature").alias("kind"), F.col("feature_id").cast("string").alias("label"), "x", "y"))
    return out


def clipped_scores(points: DataFrame, scores: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(sample_id, x, y, score): scores clipped to quantiles and min-maxed; null scores stay null; to be drawn in rising
    order of score."""
    q = scans.percentiles(scores, [], "score", {"lo": low, "hi": high})
    c = points.join(scores, "sample_id", "left").crossJoin(F.broadcast(q))
    v = F.least(F.greatest("score", "lo"), "hi")
    unit = F.when(F.col("hi") > F.col("lo"), (v - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.when(F.col("score").isNotNull(), F.lit(0.0)))
    return c.select("sample_id", "x", "y", F.when(F.col("score").isNotNull(), unit).alias("score"))


def heat_table(entries: DataFrame, rescaling: str | None = "row", cutoff: float | None = None) -> DataFrame:
    """(feature_id, sample_id, value, highlight): z-scores by row or column (sample deviation; 0 if there is none), or as
    they are; a callable gets the frame. highlight: above the cutoff."""
    if callable(rescaling):
        d = rescaling(entries)
    elif rescaling in ("row", "column"):
        w = Window.partitionBy("feature_id" if rescaling == "row" else "sample_id")
        sd = F.stddev_samp("value").over(w)
        d = entries.select("feature_id", "sample_id", F.when(sd > 0, (F.col("value") - F.avg("value").over(w)) / sd).otherwise(F.lit(0.0)).alias("value"))
    elif rescaling in (None, "none"):
        d = entries
    else:
        raise ValueError(f"unknown rescaling {rescaling}")
    return d.withColumn("highlight", F.lit(False) if cutoff is None else F.col("value") > cutoff)


def heat_order(entries: DataFrame, clustering: str | None = "both", most: int = 2000) -> tuple[list, list]:
    """Order of rows and columns by complete-linkage clustering on the driver, for up to `most` of each."""
    if clustering not in ("row", "column", "both", None, "none") and not callable(clustering):
        raise ValueError(f"unknown clustering {clustering}")
    rows = entries.limit(most * most + 1).collect()
    fs, ss = sorted({r.feature_id for r in rows}), sorted({r.sample_id for r in rows})
    if len(fs) > most or len(ss) > most:
        raise ValueError("too many rows or columns to be ordered")
    m = np.zeros((len(fs), len(ss)))
    fi, si = {v: i for i, v in enumerate(fs)}, {v: i for i, v in enumerate(ss)}
    for r in rows:
        m[fi[r.feature_id], si[r.sample_id]] = r.value
    order = clustering if callable(clustering) else complete_linkage_order
    return ([fs[i] for i in order(m)] if callable(clustering) or clustering in ("row", "both") else fs), ([ss[i] for i in order(m.T)] if callable(clustering) or clustering in ("column", "both") else ss)


def complete_linkage_order(m: np.ndarray) -> list[int]:
    """Leaves of a complete-linkage tree on Euclidean distances, in merging order."""
    n = len(m)
    d = np.sqrt(np.maximum(((m[:, None] - m[None]) ** 2).sum(axis=2), 0)) if n else np.zeros((0, 0))
    np.fill_diagonal(d, np.inf)
    leaves = [[i] for i in range(n)]
    alive = list(range(n))
    while len(alive) > 1:
        sub = d[np.ix_(alive, alive)]
        i, j = divmod(int(sub.argmin()), len(alive))
        a, b = sorted((alive[i], alive[j]))
        leaves[a] += leaves[b]
        d[a] = np.maximum(d[a], d[b])
        d[:, a] = d[a]
        d[a, a] = np.inf
        alive.remove(b)
    return leaves[alive[0]] if alive else []


def bar_table(names: DataFrame) -> DataFrame:
    """(idx, name, value) of a named vector, kept in its given order."""
    return names.select("idx", "name", "value")


def factor_selection(errors: DataFrame) -> DataFrame:
    """(k, diff) series of the search for the number of factors."""
    from .factorize import factor_number_table

    return factor_number_table(errors).where("diff is not null").select("k", "diff")


def palette(groups: DataFrame, seed: int = 42) -> DataFrame:
    """(grp, color): evenly spaced hues, dealt to groups in the order of a seeded hash."""
    names = sorted({str(r[0]) for r in groups.where("grp is not null").select("grp").distinct().limit(10_001).collect()})
    if len(names) > 10_000:
        raise ValueError("more than 10,000 groups to colour")
    names.sort(key=lambda x: hashlib.sha256(f"{seed}:{x}".encode()).hexdigest())
    out = [(x, "#%02x%02x%02x" % tuple(round(255 * c) for c in colorsys.hls_to_rgb(i / max(1, len(names)), 0.55, 0.65))) for i, x in enumerate(names)]
    return groups.sparkSession.createDataFrame(out, "grp string, color string")


def ellipse_moments(points: DataFrame) -> DataFrame:
    """(grp, n, mx, my, vxx, vyy, vxy): what a confidence ellipse is drawn from."""
    return points.where("grp is not null").groupBy("grp").agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_samp("x").alias("vxx"), F.var_samp("y").alias("vyy"), F.covar_samp("x", "y").alias("vxy"))


def ellipse(moments: tuple, level: float = 0.95, points: int = 51) -> np.ndarray:
    """Points of the t-based confidence ellipse of (n, mx, my, vxx, vyy, vxy)."""
    from ..functions.stats import f_upper

    n, mx, my, vxx, vyy, vxy = moments
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if float(f_upper(mid, 2, n - 1)) > 1 - level else (low, mid)
    half = np.linalg.cholesky(np.array([[vxx, vxy], [vxy, vyy]]) + 1e-15 * np.eye(2))
    t = np.linspace(0, 2 * np.pi, points)
    return np.array([mx, my]) + np.sqrt(2 * high) * np.column_stack([np.cos(t), np.sin(t)]) @ half.T
