"""Enrichment of feature sets along factors: running-sum scores, shared null scores, and small p-values by splitting."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scans, stats
from ..functions.storage import materialized

#: Null sets of a task, particles of a chain, rounds of moves at a level, scores this close are equal.
BATCH, PARTICLES, MOVES, SAME = 100, 500, 60, 1e-12


def ranked(assoc: DataFrame, power: float) -> DataFrame:
    """(factor_idx, feature_id, pos, weight): places from 0 in falling order of assoc, equal ones by feature_id, and
    |assoc|^power. Null and NaN associations are left out."""
    a = assoc.where("assoc is not null and not isnan(assoc)").select("factor_idx", "feature_id", F.col("assoc").cast("double").alias("assoc"), (-F.col("assoc")).cast("double").alias("down"))
    order = ["factor_idx", "down", "feature_id"]
    t = scans.scanned(scans.ranged(a, order), order, F.lit(1), "sum", "at")
    t = scans.beside(t, t.groupBy("factor_idx").agg(F.min("at").alias("start")), ["factor_idx"])
    return t.select("factor_idx", "feature_id", (F.col("at") - F.col("start")).alias("pos"), F.pow(F.abs("assoc"), F.lit(float(power))).alias("weight"))


def farther(high: Column, low: Column) -> Column:
    return F.when(F.round(high, 9) >= F.round(-low, 9), high).otherwise(low)


def observed(places: DataFrame, genesets: DataFrame) -> DataFrame:
    """(factor_idx, geneset, m, n, es): the weighted running sum is farthest from zero at a member or just before one, so only
    members are visited. Sets without a member, or with all features, have no row; one whose members weigh nothing has 0."""
    members = genesets.select("geneset", F.explode("members").alias("feature_id")).distinct()
    all_ = places.groupBy("factor_idx").agg(F.count("*").alias("n"))
    j = scans.beside(places.join(members, "feature_id"), all_, ["factor_idx"])
    whole = Window.partitionBy("factor_idx", "geneset")
    run = whole.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    j = j.select("factor_idx", "geneset", "pos", "n", "weight", F.sum("weight").over(whole).alias("total"), F.count("*").over(whole).alias("m"), F.sum("weight").over(run).alias("sum"), F.count("*").over(run).alias("j"))
    missed = (F.col("pos") - F.col("j") + 1) / (F.col("n") - F.col("m"))
    high, low = F.greatest(F.max(F.col("sum") / F.col("total") - missed), F.lit(0.0)), F.least(F.min((F.col("sum") - F.col("weight")) / F.col("total") - missed), F.lit(0.0))
    e = j.where("m < n").groupBy("factor_idx", "geneset", "m", "n").agg(F.max("total").alias("total"), high.alias("high"), low.alias("low"))
    return e.select("factor_idx", "geneset", F.col("m").cast("int").alias("m"), F.col("n").cast("int").alias("n"), F.when(F.col("total") > 0, farther(F.col("high"), F.col("low"))).otherwise(0.0).alias("es"))


def scores(weight: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Scores of many sets of one size, a row of places each."""
    places = np.sort(places, axis=1)
    m = places.shape[1]
    w = weight[places]
    run, total = np.cumsum(w, axis=1), w.sum(axis=1, keepdims=True)
    total[total == 0] = np.inf
    missed = (places - np.arange(m)) / (len(weight) - m)
    high = np.maximum((run / total - missed).max(axis=1), 0)
    low = np.minimum(((run - w) / total - missed).min(axis=1), 0)
    return np.where(np.isinf(total[:, 0]), 0.0, np.where(np.round(high, 9) >= np.round(-low, 9), high, low))


def drawn(r: np.random.Generator, n: int, m: int, rows: int) -> np.ndarray:
    return np.stack([r.choice(n, m, replace=False, shuffle=False) for _ in range(rows)])


def moved(r: np.random.Generator, places: np.ndarray, n: int, many: int) -> np.ndarray:
    """Each row with `many` random members exchanged for places outside it, as far as the draws fall outside and differ: a
    symmetric move."""
    rows, m = places.shape
    out = places.copy()
    at = np.argsort(r.random((rows, m)), axis=1)[:, :many]
    new = r.integers(0, n, (rows, many))
    taken = np.zeros((rows, n), bool)
    np.put_along_axis(taken, places, True, 1)
    good = ~np.take_along_axis(taken, new, 1).any(axis=1)
    if many > 1:
        s = np.sort(new, axis=1)
        good &= (s[:, 1:] != s[:, :-1]).all(axis=1)
    np.put_along_axis(out, at, new, 1)
    return np.where(good[:, None], out, places)


def levels(weight: np.ndarray, m: int, sign: int, top: float, r: np.random.Generator, particles: int = PARTICLES, moves: int = MOVES) -> list[tuple[float, float, np.ndarray]]:
    """Multilevel splitting: (floor, probability of a score of at least the floor, scores of sets drawn among those), with
    floors that rise by medians until `top` is passed. Scores are turned by `sign`. Sets below a floor give way to copies of
    the others, which exchanges that stay above it then move apart."""
    n = len(weight)
    places = drawn(r, n, m, particles)
    value = sign * scores(weight, places)
    out, prob, floor = [(-np.inf, 1.0, value)], 1.0, -np.inf
    sizes = sorted({1, *(max(1, min(m, n - m) // d) for d in (2, 4, 8, 16))})
    while True:
        mid = float(np.median(value))
        if mid <= floor + SAME:
            above = value[value > floor + SAME]
            if not len(above):
                return out
            mid = float(above.min())
        if mid > top + SAME:
            return out
        live = np.flatnonzero(value >= mid - SAME)
        prob, floor = prob * len(live) / particles, mid
        take = np.concatenate([live, r.choice(live, particles - len(live))]) if len(live) < particles else live
        places, value = places[take], value[take]
        for k in range(moves):
            to = moved(r, places, n, sizes[0] if k % 2 else int(r.choice(sizes)))
            v = sign * scores(weight, to)
            ok = v >= floor - SAME
            places, value = np.where(ok[:, None], to, places), np.where(ok, v, value)
        out.append((floor, prob, value))


def dealt(tasks: DataFrame, places: DataFrame, most: int, work, schema: str) -> DataFrame:
    """`work(weights of a factor, its tasks)` for tasks (factor_idx, slot, ...), a factor's tasks spread over as many slots as
    `most` tasks of a factor ask for. Every slot gets the factor's weights: p numbers."""
    slots = max(1, min(int(places.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(most / 4)))
    t = tasks.withColumn("slot", F.pmod(F.xxhash64(*tasks.columns), F.lit(slots)))
    w = places.select("factor_idx", "pos", "weight", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))).alias("slot"))

    def one(mine: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        return work(x.sort_values("pos")["weight"].to_numpy(float), mine)

    return t.groupBy("factor_idx", "slot").cogroup(w.groupBy("factor_idx", "slot")).applyInPandas(one, schema)


def null_scores(es: DataFrame, places: DataFrame, n_rand: int, seed: int) -> DataFrame:
    """(factor_idx, m, nulls): scores of n_rand random sets for each size of a set, shared by all sets of that size."""
    sizes = materialized(es.select("factor_idx", "m").distinct(), "sizes")
    batches = math.ceil(n_rand / BATCH)
    tasks = sizes.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
    most = (sizes.groupBy("factor_idx").count().agg(F.max("count")).first()[0] or 0) * batches

    def work(weight: np.ndarray, mine: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for f, m, b in mine[["factor_idx", "m", "batch"]].itertuples(index=False):
            r = np.random.default_rng([seed, int(f), int(m), int(b)])
            rows.append((f, m, scores(weight, drawn(r, len(weight), int(m), min(BATCH, n_rand - int(b) * BATCH)))))
        return pd.DataFrame(rows, columns=["factor_idx", "m", "nulls"])

    got = dealt(tasks, places, most, work, "factor_idx int, m int, nulls array<double>")
    return got.groupBy("factor_idx", "m").agg(F.flatten(F.collect_list("nulls")).alias("nulls"))


def split(rare: DataFrame, places: DataFrame, seed: int) -> DataFrame:
    """(factor_idx, geneset, tail): probability that a random set of the size scores at least as far on the side of the set.
    One chain of levels serves all sets of a size and side."""
    chains = materialized(rare.groupBy("factor_idx", "m", "sign").agg(F.max(F.abs("es")).alias("top")), "chains")
    most = chains.groupBy("factor_idx").count().agg(F.max("count")).first()[0] or 0

    def work(weight: np.ndarray, mine: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for f, m, sign, top in mine[["factor_idx", "m", "sign", "top"]].itertuples(index=False):
            r = np.random.default_rng([seed, int(f), int(m), 1 + int(sign)])
            rows += [(f, m, sign, k, *x) for k, x in enumerate(levels(weight, int(m), int(sign), float(top), r))]
        return pd.DataFrame(rows, columns=["factor_idx", "m", "sign", "level", "floor", "prob", "values"])

    got = dealt(chains, places, most, work, "factor_idx int, m int, sign int, level int, floor double, prob double, values array<double>")
    reached = rare.join(got, ["factor_idx", "m", "sign"]).where(F.col("floor") <= F.abs("es") + SAME)
    best = reached.groupBy("factor_idx", "geneset").agg(F.max_by(F.struct("es", "prob", "values"), "level").alias("b"))
    far = F.size(F.filter("b.values", lambda x: x >= F.abs("b.es") - SAME))
    # no particle so far out: what one more would have been
    share = F.when(far > 0, far / F.size("b.values")).otherwise(1 / (F.size("b.values") + F.lit(1)))
    return best.select("factor_idx", "geneset", (F.col("b.prob") * share).alias("tail"))


def run_gsea(assoc: DataFrame, genesets: DataFrame, power: float = 1.0, n_rand: int = 1000, seed: int = 1, few: int = 10) -> DataFrame:
    """(factor_idx, geneset, es, p, q). p: share of n_rand random sets of the same size and side that score as far; where fewer
    than `few` do, multilevel splitting takes over, so that p goes below 1 / n_rand (few = 0: never). q by BH within a factor.
    Without random sets (n_rand = 0) p and q are 1. Repeated members and repeated rows of a set count once; null and NaN
    associations are left out; sets without members among the features, or with all of them, have no row."""
    places = materialized(ranked(assoc.withColumn("factor_idx", F.col("factor_idx").cast("int")), power), "places")
    es = materialized(observed(places, genesets), "es")
    if not n_rand:
        return es.select("factor_idx", "geneset", "es", F.lit(1.0).alias("p"), F.lit(1.0).alias("q"))
    e = es.join(null_scores(es, places, n_rand, seed), ["factor_idx", "m"]).withColumn("sign", F.when(F.col("es") >= 0, 1).otherwise(-1))
    same = F.filter("nulls", lambda x: (x >= 0) == (F.col("sign") == 1))
    e = e.withColumn("same", F.size(same)).withColumn("far", F.size(F.filter(same, lambda x: F.abs(x) >= F.abs("es") - SAME))).drop("nulls")
    e = materialized(e.withColumn("p", (F.col("far") + 1) / (F.col("same") + 1)), "tested")
    rare = e.where((F.col("far") < few) & (F.col("same") > 0) & (F.col("es") != 0))
    tail = split(rare, places, seed)
    e = e.join(tail, ["factor_idx", "geneset"], "left")
    e = e.withColumn("p", F.least(F.coalesce(F.col("tail") * n_rand / F.col("same"), F.col("p")), F.lit(1.0)))
    return stats.adjusted(e.select("factor_idx", "geneset", "es", "p"), "p", ["geneset"], stats.bh, "q", by=["factor_idx"])
