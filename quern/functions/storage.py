"""Tables that cut the lineage of iterative jobs."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, tag: str) -> str:
    """A new folder below spark.checkpoint.dir, which executors share. Where that is unset a session of one machine gets a
    folder of it; any other is refused, as its executors would write each to a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"


def materialized(df: DataFrame, tag: str = "table") -> DataFrame:
    """The rows written once to the shared folder and read back."""
    path = folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
