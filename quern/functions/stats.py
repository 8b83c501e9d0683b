"""Distribution tails in numpy, for batches of values, and p-value adjustment over any number of rows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .storage import materialized


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / np.where(np.abs(c) < tiny, tiny, c)
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    return h


_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def beta_inc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(np.clip(x, 1e-300, 1)) + b * np.log(np.clip(1 - x, 1e-300, 1)))
    low = x < (a + 1) / (a + b + 2)
    out = np.where(low, front * _beta_fraction(a, b, np.where(low, x, 0.1)) / a, 1 - front * _beta_fraction(b, a, np.where(low, 0.1, 1 - x)) / b)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def f_upper(x, d1, d2) -> np.ndarray:
    """P(F > x)."""
    x, d1, d2 = (np.asarray(v, float) for v in (x, d1, d2))
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * np.maximum(x, 0)))


def gamma_lower(a, x) -> np.ndarray:
    """Regularised lower incomplete gamma function P(a, x)."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    with np.errstate(all="ignore"):
        front = np.exp(-x + a * np.log(np.maximum(x, 1e-300)) - _lgamma(a))
        term, total = 1 / a, 1 / a
        for n in range(1, 2000):
            term = term * x / (a + n)
            total = total + term
            if np.all(np.abs(np.where(x < a + 1, term, 0)) <= np.abs(total) * 1e-16):
                break
        series = front * total
        b = x + 1 - a
        c, d = np.full_like(b, 1e300), 1 / np.where(b == 0, 1e-300, b)
        h = d.copy()
        for n in range(1, 2000):
            an = -n * (n - a)
            b = b + 2
            d = 1 / np.where(np.abs(an * d + b) < 1e-300, 1e-300, an * d + b)
            c = np.where(np.abs(b + an / c) < 1e-300, 1e-300, b + an / c)
            delta = d * c
            h = h * delta
            if np.all(np.abs(np.where(x < a + 1, 1, delta) - 1) < 1e-15):
                break
    return np.where(x <= 0, 0.0, np.where(x < a + 1, series, 1 - front * h))


def chi2_quantile(p, df) -> np.ndarray:
    """Inverse of the chi-square distribution, by bisection in logarithms."""
    p = np.asarray(p, float)
    low, high = np.full(p.shape, -60.0), np.full(p.shape, math.log(max(df, 1.0)) + 10)
    for _ in range(200):
        mid = (low + high) / 2
        below = gamma_lower(df / 2, np.exp(mid) / 2) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return np.where(p <= 0, 0.0, np.where(p >= 1, np.inf, np.exp((low + high) / 2)))


def normal_upper(x, mean=0.0, sd=1.0) -> np.ndarray:
    """P(N(mean, sd) > x)."""
    with np.errstate(all="ignore"):
        return 0.5 * _erfc((np.asarray(x, float) - mean) / (np.asarray(sd, float) * math.sqrt(2)))


def bh(p) -> np.ndarray:
    """Benjamini-Hochberg."""
    p = np.asarray(p, float)
    order = np.argsort(-p, kind="stable")
    out = np.empty_like(p)
    out[order] = np.minimum(1, np.minimum.accumulate(p[order] * len(p) / np.arange(len(p), 0, -1)))
    return out


def holm(p) -> np.ndarray:
    p = np.asarray(p, float)
    order = np.argsort(p, kind="stable")
    out = np.empty_like(p)
    out[order] = np.minimum(1, np.maximum.accumulate(p[order] * np.arange(len(p), 0, -1)))
    return out


def adjusted(df: DataFrame, p: str, keys: list[str], method, out: str = "p_adj", by: list[str] = ()) -> DataFrame:
    """The rows with p adjusted by `bh` or `holm` over all of them, or within groups; a null p stays null and isn't counted.
    Sorted by range over the cluster; ranks and the running extreme are scans. `keys` tell rows apart and spread equal p."""
    from . import scans

    if method not in (bh, holm):
        raise ValueError("p-values are adjusted by bh or holm")
    order = [*by, p, *keys]
    t = materialized(scans.scanned(scans.ranged(df.where(F.col(p).isNotNull()), order), order, F.lit(1), "sum", "__rank"), "p-ranks")
    if by:
        t = scans.beside(t, t.groupBy(*by).agg((F.min("__rank") - 1).alias("__start"), F.count("*").alias("__m")), [*by])
        rank, m = F.col("__rank") - F.col("__start"), F.col("__m")
    else:
        rank, m = F.col("__rank"), F.lit(t.count())
    # Groups come one after the other, so an extreme of (group, value) never looks beyond the row's own group.
    value = F.struct(*by, (F.col(p) * m / rank if method is bh else F.col(p) * (m - rank + 1)).alias("__v"))
    t = scans.scanned(t, order, value, "min", out, backwards=True) if method is bh else scans.scanned(t, order, value, "max", out)
    t = t.withColumn(out, F.least(F.col(f"{out}.__v"), F.lit(1.0))).drop(scans.PART, "__rank", "__start", "__m")
    return t.unionByName(df.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double")))
