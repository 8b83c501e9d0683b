"""Groups of samples: flat, nested and wide forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..model import bounded


#: Members that one row of a nested table holds.
MEMBERS = 10_000


def nest_groups(flat: DataFrame) -> DataFrame:
    """(sample_id, grp) -> (grp, members) with several rows for a group of many, dealt by a hash, so that no row grows with the
    table."""
    share = F.pmod(F.xxhash64("sample_id"), F.lit(max(1, -(-flat.count() // MEMBERS))))
    return flat.groupBy("grp", share.alias("__share")).agg(F.collect_list("sample_id").alias("members")).select("grp", "members")


def flatten_groups(nested: DataFrame) -> DataFrame:
    """(grp, members) -> (sample_id, grp), without samples that are in more than one group. A group may have several rows."""
    long = nested.select("grp", F.explode("members").alias("sample_id")).distinct()
    return long.groupBy("sample_id").agg(F.count("*").alias("n"), F.first("grp").alias("grp")).where("n = 1").select("sample_id", "grp")


def unflatten_groups(flat: DataFrame) -> DataFrame:
    """(sample_id, grp) -> (grp, members in order)."""
    return flat.where("grp is not null").groupBy("grp").agg(F.sort_array(F.collect_list("sample_id")).alias("members"))


def unflatten_dataframe(df: DataFrame, output: str, row: str = "Gene", col: str = "Group", columns: list | None = None) -> DataFrame:
    """Long to wide: one row per `row`, one column per `col`; giving the columns saves a pass."""
    g = df.groupBy(row)
    return (g.pivot(col, columns) if columns else g.pivot(col)).agg(F.first(output, ignorenulls=True))


def recode(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Labels by (old, new), many to one; others stay."""
    m = bounded(mapping.select(F.col("old").alias("__o"), F.col("new").alias("__n")))
    return df.join(m, F.col(column) == F.col("__o"), "left").withColumn(column, F.coalesce("__n", column)).drop("__o", "__n")


def multi_label(scores: DataFrame, cutoffs: DataFrame, samples: DataFrame) -> DataFrame:
    """(sample_id, label): the only label whose score (sample_id, label, score) reaches its cutoff, else null."""
    hit = scores.join(bounded(cutoffs), "label").where("score >= cutoff").groupBy("sample_id").agg(F.count("*").alias("n"), F.first("label").alias("label")).where("n = 1")
    return samples.select("sample_id").join(hit.select("sample_id", "label"), "sample_id", "left")
