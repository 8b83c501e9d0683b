"""Running sums, minima and maxima over a global order, and ranks, without a sort in one task.

Rows are sorted by range over the cluster and written with their partition's number; within partitions a window does the
work, and one row for each partition carries what comes before it (or, backwards, after it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .storage import materialized

PART = "__part"
KINDS = {"sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), "min": (F.min, F.least), "max": (F.max, F.greatest)}


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows as a table in the order of some columns, with their partition. More columns in the order spread ties."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialized(df.repartitionByRange(n, *order).withColumn(PART, F.spark_partition_id()), "ranges")


def scanned(t: DataFrame, order: list[str], value: Column, kind: str, out: str, backwards: bool = False, own: bool = True) -> DataFrame:
    """Adds the running sum, min or max of `value` in the order that `t` was ranged by (backwards: from its end), with the
    row's own value or without."""
    f, both = KINDS[kind]
    t = t.withColumn("__value", value)
    turned = [F.col(c).desc() if backwards else F.col(c).asc() for c in order]
    inside = f("__value").over(Window.partitionBy(PART).orderBy(*turned).rowsBetween(Window.unboundedPreceding, 0 if own else -1))
    each = materialized(t.groupBy(F.col(PART).alias("__of")).agg(f("__value").alias("__total")), "totals")
    # A row for each partition: this window is as long as their number.
    earlier = Window.orderBy(F.col("__of").desc() if backwards else F.col("__of").asc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = F.broadcast(each.select("__of", f("__total").over(earlier).alias("__carried")))
    return t.withColumn("__inside", inside).join(carried, F.col(PART) == F.col("__of")).withColumn(out, both(F.col("__inside"), F.col("__carried"))).drop("__value", "__inside", "__of", "__carried")


def beside(df: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """Each row with the row of its group (null is a group), or with the only one."""
    if not by:
        return df.crossJoin(F.broadcast(stats))
    s = stats.withColumnsRenamed({b: f"__{b}" for b in by})
    on = F.lit(True)
    for b in by:
        on = on & df[b].eqNullSafe(s[f"__{b}"])
    return df.join(s, on).drop(*(f"__{b}" for b in by))


def average_ranks(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Adds the rank of `value` within its group, equal values sharing the mean of their ranks; a null value has none. Equal
    values are counted first, so that ties are one row of the scan however many there are."""
    # a name of its own for each copy, as the frame meets its own counts again
    n = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__x")).agg(F.count("*").alias("__n"))
    order = [*by, "__x"]
    t = materialized(scanned(ranged(n, order), order, F.col("__n"), "sum", "__before", own=False).drop(PART), "ranks")
    if by:
        t = beside(t, t.groupBy(*by).agg(F.min("__before").alias("__start")), by)
    else:
        t = t.withColumn("__start", F.lit(0))
    t = t.select(*(F.col(b).alias(f"__{b}") for b in by), "__x", (F.col("__before") - F.col("__start") + (F.col("__n") + 1) / F.lit(2.0)).alias(out))
    on = F.col(value) == F.col("__x")
    for b in by:
        on = on & df[b].eqNullSafe(t[f"__{b}"])
    return df.join(t, on, "left").drop("__x", *(f"__{b}" for b in by))


def percentiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """Exact percentiles (between two values a line) of each group, or of all rows, as columns by name: the values at the
    places that they fall on, found among the counted distinct values in their order. A null value isn't counted."""
    n = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__x")).agg(F.count("*").alias("__n"))
    order = [*by, "__x"]
    t = materialized(scanned(ranged(n, order), order, F.col("__n"), "sum", "__before", own=False).drop(PART), "ranks")
    t = beside(t, t.groupBy(*by).agg(F.min("__before").alias("__start"), F.sum("__n").alias("__all")), by)
    first = F.col("__before") - F.col("__start")

    def at(place: Column) -> Column:
        return F.max(F.when((first <= place) & (place < first + F.col("__n")), F.col("__x")))

    places = {k: F.lit(float(q)) * (F.col("__all") - 1) for k, q in wanted.items()}
    t = t.groupBy(*by).agg(*(f(x).alias(f"__{w}{i}") for i, x in enumerate(places.values()) for w, f in (("low", lambda x: at(F.floor(x))), ("high", lambda x: at(F.ceil(x))), ("part", lambda x: F.max(x - F.floor(x))))))
    return t.select(*by, *((F.col(f"__low{i}") + (F.col(f"__high{i}") - F.col(f"__low{i}")) * F.col(f"__part{i}")).alias(k) for i, k in enumerate(places)))
