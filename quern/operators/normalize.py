"""Depth normalisation, batch correction, variance model and scaling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scans, smooth, stats
from ..functions.storage import materialized
from ..model import CountMatrix, bounded


def normalize_counts(m: CountMatrix, depth_scale: float = 1e3, batch: DataFrame | None = None) -> CountMatrix:
    """value / (sample depth / depth_scale). With batch(sample_id, batch) each value is first divided by its feature's
    batch effect, the smoothed ratio of the feature's share in the batch to its share overall; the depth stays that of
    the raw counts. Raises if a sample has no batch."""
    e = m.entries.join(m.depths(), "sample_id")
    value = F.col("value")
    if batch is not None:
        b = batch.select("sample_id", "batch")
        if m.samples.join(b.where("batch is not null"), "sample_id", "left_anti").limit(1).count():
            raise ValueError("every sample needs a batch")
        e = e.join(b, "sample_id")
        n = b.join(m.samples, "sample_id", "left_semi").select("batch").distinct().count()
        total = m.entries.agg(F.sum("value")).first()[0] or 0.0
        share = m.entries.groupBy("feature_id").agg(((F.sum("value") + n) / F.lit(total + n)).alias("share"))
        sums = e.groupBy("feature_id", "batch").agg(F.sum("value").alias("t"))
        depth = e.groupBy("batch").agg(F.sum("value").alias("d"))
        effect = sums.join(depth, "batch").join(share, "feature_id").select("feature_id", "batch", F.exp(F.log(F.col("t") + 1) - F.log(F.col("d") + 1) - F.log("share")).alias("bc"))
        e = e.join(effect, ["feature_id", "batch"])
        value = value / F.col("bc")
    return m.with_entries(e.withColumn("value", value / (F.col("depth") / F.lit(float(depth_scale)))))


def col_sum_by_group(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """Sums of each feature per group; samples without a group are the null group."""
    return entries.join(groups, "sample_id", "left").groupBy("feature_id", "grp").agg(F.sum("value").alias("total"))


def col_mean_var(m: CountMatrix, n: int | None = None) -> DataFrame:
    """Mean and population variance of each feature over all samples, zeros included, and the number of stored entries.
    Two passes: deviations from the mean, then the share of the absent entries."""
    n = m.n_samples() if n is None else n
    one = m.entries.groupBy("feature_id").agg((F.sum("value") / F.lit(n)).alias("m"), F.count("*").alias("nobs"))
    two = m.entries.join(one, "feature_id").groupBy("feature_id").agg(F.first("m").alias("m"), F.first("nobs").alias("nobs"), F.sum(F.pow(F.col("value") - F.col("m"), 2)).alias("ss"))
    var = (F.col("ss") + F.col("m") * F.col("m") * (F.lit(n) - F.col("nobs"))) / F.lit(n)
    return m.features.join(two, "feature_id", "left").select("feature_id", F.coalesce("m", F.lit(0.0)).alias("m"), F.coalesce(var, F.lit(0.0)).alias("v"), F.coalesce("nobs", F.lit(0)).alias("nobs"))


def adjust_variance(m: CountMatrix, gam_k: int = 10, max_adj: float = 1e3, min_adj: float = 1e-3, q_val: float = 0.05) -> DataFrame:
    """feature_id, m, v (logarithms), nobs, res, lp (a plain p-value), lpa (BH), qv, gsf, overdispersed. The trend of v on
    m is a thin-plate regression spline, or a line with under 1.5 * gam_k finite features. Features stay on the cluster."""
    n = m.n_samples()
    logs = "CASE WHEN {0} > 0 THEN ln({0}) ELSE double('-infinity') END AS {0}"
    t = materialized(col_mean_var(m, n).selectExpr("cast(feature_id AS string) AS feature_id", logs.format("m"), logs.format("v"), "cast(nobs AS long) AS nobs"), "variances")
    ok = t.where("m > double('-infinity') AND v > double('-infinity') AND NOT isnan(m) AND NOT isnan(v)").select("m", "v")
    count = ok.count()
    if count >= 1.5 * gam_k:
        plate, b = smooth.fitted(ok, "m", "v", gam_k)

        def trend(x):
            return plate.basis(x) @ b
    else:
        line = ok.agg(F.regr_slope("v", "m").alias("slope"), F.regr_intercept("v", "m").alias("at"), F.avg("v").alias("mean")).first()
        slope, at = (0.0, line["mean"] or 0.0) if line.slope is None else (line.slope, line["at"])

        def trend(x):
            return at + slope * x

    schema = "feature_id string, m double, v double, nobs long, res double, lp double, qv double, gsf double"

    def run(batches):
        for b in batches:
            for part in (b.slice(i, 1 << 12) for i in range(0, b.num_rows, 1 << 12)):
                mean, var, nobs = (smooth.batch(part, c) for c in ("m", "v", "nobs"))
                with np.errstate(all="ignore"):
                    fine = np.isfinite(mean) & np.isfinite(var)
                    res = np.full(len(mean), -np.inf)
                    res[fine] = var[fine] - trend(mean[fine])
                    seen = fine & (nobs > 0)
                    lp = np.where(seen, stats.f_upper(np.exp(np.where(seen, res, 0)), np.maximum(nobs, 1), np.maximum(nobs, 1)), 1.0)
                    qv = stats.chi2_quantile(1 - lp, max(n - 1, 1)) / n
                    gsf = np.sqrt(np.clip(qv, min_adj, max_adj) / np.exp(var))
                    gsf[~np.isfinite(gsf)] = 0
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("feature_id", "m", "v", "nobs")] + [pa.array(x, pa.float64()) for x in (res, lp, qv, gsf)], names=[x.split()[0] for x in schema.split(", ")])

    out = stats.adjusted(materialized(t.mapInArrow(run, schema), "tested"), "lp", ["feature_id"], stats.bh, "lpa")
    return out.select("feature_id", "m", "v", "nobs", "res", "lp", "lpa", "qv", "gsf", (F.col("lpa") < q_val).alias("overdispersed"))


def median_depth(m: CountMatrix) -> float:
    return scans.percentiles(m.depths(), [], "depth", {"mid": 0.5}).first()[0] or 0.0


def select_features(m: CountMatrix, batch: DataFrame | None = None, n_features: int = 3000, gam_k: int = 10) -> DataFrame:
    """The most over-dispersed features (all, if there are fewer), best first."""
    v = adjust_variance(normalize_counts(m, median_depth(m), batch), gam_k)
    return v.orderBy("lp", "feature_id").limit(n_features).select("feature_id", "lp")


def transform(value: Column, method: str) -> Column:
    if method == "log":
        return F.log1p(value)
    if method == "ft":
        return F.sqrt(value) + F.sqrt(value + 1)
    if method == "none":
        return value
    raise ValueError(f"unknown method {method}")


def log_rank(m: CountMatrix, raw: CountMatrix) -> DataFrame:
    """Average rank of a sample's stored entries, over the number of features, times the median number of entries."""
    by_value = Window.partitionBy("sample_id").orderBy("value")
    peers = Window.partitionBy("sample_id", "value")
    mid = scans.percentiles(raw.entries.groupBy("sample_id").agg(F.count("*").alias("c")), [], "c", {"mid": 0.5}).first()[0] or 0.0
    return m.entries.withColumn("value", (F.rank().over(by_value) + (F.count("*").over(peers) - 1) / F.lit(2.0)) / F.lit(float(m.n_features())) * F.lit(float(mid)))


def scale_counts(m: CountMatrix, batch: DataFrame | None = None, method: str = "log", adj_var: bool = True, gam_k: int = 10, scale_factor: float | None = None) -> CountMatrix:
    """Normalise to the median depth, weigh features by their variance adjustment, then log, ft, logrank or none. All work
    on stored entries only: an absent entry stays absent."""
    if method not in ("log", "ft", "logrank", "none"):
        raise ValueError(f"unknown method {method}")
    norm = normalize_counts(m, median_depth(m) if scale_factor is None else scale_factor, batch)
    if adj_var:
        gsf = bounded(adjust_variance(norm, gam_k).select("feature_id", "gsf"))
        norm = norm.with_entries(norm.entries.withColumn("feature_id", F.col("feature_id").cast("string")).join(gsf, "feature_id").withColumn("value", F.col("value") * F.col("gsf")))
    if method == "logrank":
        return norm.with_entries(log_rank(norm, m))
    return norm.with_entries(norm.entries.withColumn("value", transform(F.col("value"), method)))


def normalize_vector(df: DataFrame, value: str, method: str, by: list[str] | None = None, n_ranks: int = 10_000, out: str = "value") -> DataFrame:
    """scale: z-score with the sample deviation; rank: average rank / length * n_ranks; bounded: min-max. A constant vector
    gives NaN (scale, bounded). `by` names the columns that identify a vector."""
    by, x = by or [], F.col(value)
    if method == "scale":
        one = df.groupBy(*by).agg(F.avg(x).alias("__mean"), F.stddev_samp(x).alias("__sd"))
        y = F.when((F.col("__sd") == 0) | F.col("__sd").isNull(), F.lit(float("nan"))).otherwise((x - F.col("__mean")) / F.col("__sd"))
    elif method == "rank":
        one = df.groupBy(*by).agg(F.count(x).alias("__n"))
        df, y = scans.average_ranks(df, by, value, "__rank"), F.col("__rank") / F.col("__n") * n_ranks
    elif method == "bounded":
        one = df.groupBy(*by).agg(F.min(x).alias("__low"), F.max(x).alias("__high"))
        y = F.when(F.col("__high") == F.col("__low"), F.lit(float("nan"))).otherwise((x - F.col("__low")) / (F.col("__high") - F.col("__low")))
    else:
        raise ValueError(f"unknown method {method}")
    return scans.beside(df, one, by).withColumn(out, y).drop("__mean", "__sd", "__n", "__rank", "__low", "__high")


def minmax_by_feature(entries: DataFrame) -> DataFrame:
    """Per-feature min-max of dense scaled data (integrated assays)."""
    r = entries.groupBy("feature_id").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    y = F.when(F.col("high") == F.col("low"), F.lit(float("nan"))).otherwise((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")))
    return entries.join(r, "feature_id").select("feature_id", "sample_id", y.alias("value"))


def extract_norm_counts(m: CountMatrix, assay: str = "raw", method: str = "log", batch: DataFrame | None = None) -> CountMatrix:
    """Counts of an external object: raw ones are scaled, "integrated" ones min-maxed per feature."""
    if assay == "integrated":
        return m.with_entries(minmax_by_feature(m.entries))
    return scale_counts(m, batch, method)
