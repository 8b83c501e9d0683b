"""Connected components of a link table, by alternating large-star and small-star steps.

Every step joins a table with its own minima per node and writes the links anew in the shared folder, so nothing but
counts reaches the driver and lost executors cost one step at most. Hubs are pre-aggregated by min(), and the minima are
a table of their own, so that adaptive execution can split the join of a hub's links with its minimum.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning star for each component of the links a-b: (node, smallest node) of all but the smallest."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            break
    out = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[out], nodes[label[out]]


def components(links: DataFrame, tag: str) -> DataFrame:
    """links (a, b) -> (node, root): root is the smallest node reachable; nodes without links don't appear."""
    e = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), f"{tag}-links")
    last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m")), f"{tag}-low")
        large = both.join(low, both["u"] == low["n"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        e = written(large, f"{tag}-large")
        low = written(e.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n"), f"{tag}-low")
        small = e.join(low, e["u"] == low["n"]).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p")).select("p.*").where("u != v").distinct()
        e = written(small, f"{tag}-small")
        now = tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if now == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = now
