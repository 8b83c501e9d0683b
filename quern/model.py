"""Data model: sparse nonnegative matrices, factorisations, graphs and embeddings as plain DataFrames.

A matrix is `entries(feature_id, sample_id, value)` without zero rows plus the dimension tables `features(feature_id)` and
`samples(sample_id)`: features and samples without a stored entry still count in every mean, variance and threshold.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

#: Small sides are broadcast only below this many rows, counted before; otherwise the join shuffles.
BROADCAST_ROWS = 200_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it has at most `rows` rows, else unchanged. Counts at most rows + 1 of them."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def few(df: DataFrame, rows: int, what: str) -> list:
    """The rows of a frame of which at most `rows` fit on the driver; raises if there are more."""
    out = df.limit(rows + 1).collect()
    if len(out) > rows:
        raise ValueError(f"more than {rows} {what}")
    return out


@dataclass(frozen=True)
class CountMatrix:
    entries: DataFrame
    features: DataFrame
    samples: DataFrame

    @staticmethod
    def of(entries: DataFrame, features: DataFrame | None = None, samples: DataFrame | None = None) -> "CountMatrix":
        e = entries.where("value != 0").select("feature_id", "sample_id", F.col("value").cast("double").alias("value"))
        return CountMatrix(e, features if features is not None else e.select("feature_id").distinct(), samples if samples is not None else e.select("sample_id").distinct())

    def with_entries(self, entries: DataFrame) -> "CountMatrix":
        return replace(self, entries=entries.select("feature_id", "sample_id", "value"))

    def subset(self, features: DataFrame | None = None, samples: DataFrame | None = None) -> "CountMatrix":
        """Features and samples by name: left semi joins."""
        e, f, s = self.entries, self.features, self.samples
        if features is not None:
            e, f = e.join(features.select("feature_id"), "feature_id", "left_semi"), f.join(features.select("feature_id"), "feature_id", "left_semi")
        if samples is not None:
            e, s = e.join(samples.select("sample_id"), "sample_id", "left_semi"), s.join(samples.select("sample_id"), "sample_id", "left_semi")
        return CountMatrix(e, f, s)

    def n_samples(self) -> int:
        return self.samples.count()

    def n_features(self) -> int:
        return self.features.count()

    def depths(self) -> DataFrame:
        return self.entries.groupBy("sample_id").agg(F.sum("value").alias("depth"))


@dataclass(frozen=True)
class Factorization:
    """w(feature_id, w array<double>), h(sample_id, h array<double>); factors are named factor_1 .. factor_k."""

    w: DataFrame
    h: DataFrame
    k: int
    errors: tuple[float, ...] = ()

    @property
    def names(self) -> list[str]:
        return [f"factor_{i + 1}" for i in range(self.k)]


@dataclass(frozen=True)
class Twinned:
    """A graph of samples in which those with the same links are one class: members(sample_id, cls, twin), links(src, dst,
    weight) between classes, which all their members have. Two members of a class are linked by the weight `twin`, if it isn't
    null; a sample links itself by 1."""

    links: DataFrame
    members: DataFrame

    def pairs(self) -> DataFrame:
        """(src, dst, weight) of all samples; as many rows as the square of a class's members."""
        a, b = (self.members.select(F.col("sample_id").alias(x), F.col("cls").alias(f"{x}_cls"), "twin") for x in ("src", "dst"))
        links = self.links.where("src != dst").select(F.col("src").alias("src_cls"), F.col("dst").alias("dst_cls"), "weight")
        between = links.join(a.drop("twin"), "src_cls").join(b.drop("twin"), "dst_cls").select("src", "dst", "weight")
        weight = F.when(F.col("src") == F.col("dst"), F.lit(1.0)).otherwise(F.col("twin"))
        inside = a.join(b.select("dst", F.col("dst_cls").alias("src_cls")), "src_cls").select("src", "dst", weight.alias("weight"))
        return between.unionByName(inside.where("weight is not null"))


@dataclass(frozen=True)
class Embedding:
    """factors(factor, factor_idx, x, y, name), samples(sample_id, x, y), features(feature_id, x, y) or None. A factor
    with an empty name is hidden in plots."""

    factors: DataFrame
    samples: DataFrame
    features: DataFrame | None = None
