"""Dense indexes without a one-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.storage import materialized
from ..model import bounded


def dense_index(df: DataFrame, key: str, out: str) -> DataFrame:
    """`out`: 0, 1, 2, ... in the order of `key`. Sorted by range; ranks within partitions; one row per partition is summed
    up and joined back."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = materialized(df.repartitionByRange(n, key).withColumn("__p", F.spark_partition_id()), "ranges")
    sizes = t.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(key)) - 1
    return t.withColumn("__i", inside).join(bounded(materialized(before, "before")), "__p").withColumn(out, (F.col("__i") + F.col("__b")).cast("long")).drop("__p", "__i", "__b")
