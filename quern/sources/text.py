"""Readers and writers of text formats, and helpers for names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.storage import materialized
from ..model import CountMatrix, bounded
from ..operators.ranking import dense_index


def extract_field(s: Column, field: int | str = 1, delim: str = "_") -> Column:
    """The field-th token between matches of the regex `delim`; "1,3" gives several, joined by delim again. Out of range:
    null."""
    parts = F.split(s, delim, -1)
    wanted = [int(x) for x in str(field).split(",")]
    if len(wanted) == 1:
        return F.get(parts, F.lit(wanted[0] - 1))
    return F.array_join(F.array(*(F.get(parts, F.lit(i - 1)) for i in wanted)), delim)


def make_names(s: Column) -> Column:
    """Syntactic names: other characters become dots; X is put before a name that doesn't start with a letter, or a dot
    that no digit follows."""
    t = F.regexp_replace(s, r"[^\p{L}\p{N}._]", ".")
    return F.when(t.rlike(r"^(\p{L}|\.(?![0-9]))"), t).when(t == "", F.lit("X")).otherwise(F.concat(F.lit("X"), t))


def make_unique(df: DataFrame, column: str, order: str) -> DataFrame:
    """Repeated names get .1, .2, ... in their original order."""
    n = F.row_number().over(Window.partitionBy(column).orderBy(order)) - 1
    return df.withColumn(column, F.when(n == 0, F.col(column)).otherwise(F.concat(column, F.lit("."), n.cast("string"))))


def _status(spark: SparkSession, path: str):
    """Hadoop's file status, or None."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getFileStatus(p) if fs.exists(p) else None


def _found(spark: SparkSession, folder: str, *names: str) -> str:
    for n in names:
        for path in (f"{folder}/{n}.gz", f"{folder}/{n}"):
            if _status(spark, path) is not None:
                return path
    raise FileNotFoundError(f"none of {names} in {folder}")


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """(value, at): the lines of a file, or of a folder's files in the order of their names, and a place that sorts as they
    stand. Files are read as they are split, in any order of tasks."""
    t = spark.read.text(path).select("value", "_metadata.file_name", "_metadata.file_block_start")
    return t.select("value", F.struct("file_name", "file_block_start", F.monotonically_increasing_id().alias("k")).alias("at"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) in the order of the file, or of a folder's files by name. Lines are numbered by range."""
    return dense_index(_placed(spark, path), "at", "line").select((F.col("line") + 1).alias("line"), "value")


def read_matrix_dir(spark: SparkSession, folder: str) -> CountMatrix:
    """MatrixMarket counts with barcodes and features beside them, gzip preferred, each a file or a folder of files. Names: the second field of features, made
    unique; barcodes without -1 if all end so, as syntactic names."""
    mtx = _found(spark, folder, "matrix.mtx")
    bar, feat = _found(spark, folder, "barcodes.tsv"), _found(spark, folder, "features.tsv", "genes.tsv")
    f = F.split("value", "\t")
    features = make_unique(_lines(spark, feat).select("line", F.coalesce(F.get(f, F.lit(1)), F.get(f, F.lit(0))).alias("feature_id")), "feature_id", "line")
    b = materialized(_lines(spark, bar).select("line", F.get(f, F.lit(0)).alias("sample_id")), "barcodes")
    if not b.where(~F.col("sample_id").rlike("-1$")).limit(1).count():
        b = b.withColumn("sample_id", F.regexp_replace("sample_id", "-.*$", ""))
    b = b.withColumn("sample_id", make_names(F.col("sample_id")))
    t = _placed(spark, mtx).where("value not like '\\%%'")
    head, at = t.agg(F.min_by("value", "at"), F.min("at")).first()
    if head is None:
        raise ValueError(f"{mtx} has no line of its size")
    size = tuple(int(x) for x in head.split())
    cells = t.where(F.col("at") > F.struct(*(F.lit(x).alias(n) for n, x in at.asDict().items()))).select(F.split(F.trim("value"), r"\s+").alias("p")).select(F.col("p")[0].cast("long").alias("i"), F.col("p")[1].cast("long").alias("j"), F.col("p")[2].cast("double").alias("value"))
    m = CountMatrix.of(cells.join(features.withColumnRenamed("line", "i"), "i").join(b.withColumnRenamed("line", "j"), "j"), features.select("feature_id"), b.select("sample_id"))
    if size[0] != features.count() or size[1] != b.count():
        raise ValueError(f"the matrix is {size[0]} x {size[1]}, its names are not")
    return m


def _ordered(df: DataFrame, order: list[str], path: str) -> None:
    """The column `value` as text files, whose lines are in order when the files are taken by name."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, *order).sortWithinPartitions(*order).select("value").write.text(path)


def write_matrix_dir(m: CountMatrix, path: str) -> None:
    """A new folder with matrix.mtx, features.tsv and barcodes.tsv as folders of text files, each written by many tasks. Taken
    by name their lines are in order (cells by sample, then feature, behind the line of the size), so the files of a folder
    put together are the plain format; read_matrix_dir reads them as they are. Null names and names with a tab or a line end
    are an error; entries of a name outside the matrix, and zeros, aren't written; repeated entries are written as they are."""
    names = {"features.tsv": ("feature_id", m.features), "barcodes.tsv": ("sample_id", m.samples)}
    held = {}
    for file, (key, df) in names.items():
        d = df.select(F.col(key).cast("string").alias(key)).distinct()
        if d.where(F.col(key).isNull() | F.col(key).rlike("[\t\r\n]")).limit(1).count():
            raise ValueError(f"null, a tab or a line end in {key}")
        held[key] = materialized(dense_index(d, key, "n"), "names")
        line = F.col(key) if key == "sample_id" else F.concat_ws("\t", key, key)
        _ordered(held[key].select("n", line.alias("value")), ["n"], f"{path}/{file}")
    f, s = (held[k].select(k, (F.col("n") + 1).alias(n)) for k, n in (("feature_id", "i"), ("sample_id", "j")))
    e = m.entries.where("value != 0").select(F.col("feature_id").cast("string").alias("feature_id"), F.col("sample_id").cast("string").alias("sample_id"), F.col("value").cast("double").alias("value"))
    cells = materialized(e.join(bounded(f), "feature_id").join(bounded(s), "sample_id").select("j", "i", F.concat_ws(" ", F.col("i").cast("string"), F.col("j").cast("string"), F.col("value").cast("string")).alias("value")), "cells")
    size = f"{f.count()} {s.count()} {cells.count()}"
    head = m.entries.sparkSession.createDataFrame([(-2, 0, "%%MatrixMarket matrix coordinate real general"), (-1, 0, size)], "j long, i long, value string")
    _ordered(head.unionByName(cells), ["j", "i"], f"{path}/matrix.mtx")


def read_wide(spark: SparkSession, path: str, sep: str = "\t") -> CountMatrix:
    """A table with sample names in the header and feature names in the first column; zeros are not stored."""
    t = spark.read.csv(path, sep=sep, header=True, quote="")
    key, *cols = t.columns
    renamed = t.toDF("feature_id", *(f"c{i}" for i in range(len(cols))))
    long = renamed.select("feature_id", *(F.col(f"c{i}").cast("double").alias(f"c{i}") for i in range(len(cols)))).unpivot("feature_id", [f"c{i}" for i in range(len(cols))], "c", "value")
    names = spark.createDataFrame([(f"c{i}", c) for i, c in enumerate(cols)], "c string, sample_id string").withColumn("sample_id", make_names(F.col("sample_id")))
    return CountMatrix.of(long.join(bounded(names), "c"), renamed.select("feature_id").distinct(), names.select("sample_id"))


def read_data(spark: SparkSession, path: str) -> CountMatrix:
    """A directory is a sparse matrix with names, a file a wide table."""
    status = _status(spark, path)
    if status is None:
        raise FileNotFoundError(path)
    return read_matrix_dir(spark, path) if status.isDirectory() else read_wide(spark, path)


def filter_species(m: CountMatrix, classes: DataFrame, species: str = "hg19") -> CountMatrix:
    """Samples called as the species (barcode, call), features whose name holds it; of a feature name the second token."""
    ids = classes.where(F.col("call") == species).select(make_names(F.regexp_replace("barcode", "-1$", "")).alias("sample_id"))
    f = m.features.where(F.col("feature_id").contains(species))
    c = m.subset(f, ids)
    name = extract_field(F.col("feature_id"), 2, "_")
    return CountMatrix(c.entries.withColumn("feature_id", name), c.features.select(name.alias("feature_id")), c.samples)


def read_10x_species(spark: SparkSession, folder: str, class_file: str, species: str = "hg19") -> CountMatrix:
    return filter_species(read_matrix_dir(spark, folder), spark.read.csv(class_file, header=True), species)


def read_genesets(spark: SparkSession, path: str) -> DataFrame:
    """(geneset, members) of a GMT file: name with underscores for spaces, a description that is left out, members. A line
    without members is dropped."""
    p = F.split("value", "\t")
    return spark.read.text(path).select(F.regexp_replace(p[0], " ", "_").alias("geneset"), F.when(F.size(p) > 2, F.slice(p, F.lit(3), F.greatest(F.size(p) - 2, F.lit(0)))).alias("members")).where("members is not null").withColumn("members", F.filter("members", lambda x: x != ""))


def write_genesets(genesets: DataFrame, path: str) -> None:
    """GMT with the name also as description: a folder of files whose lines, taken by name, are in order."""
    genesets.orderBy("geneset").select(F.concat_ws("\t", "geneset", "geneset", F.array_join("members", "\t")).alias("value")).write.mode("overwrite").text(path)


def read_groups(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(grp, members) of a file without header: group, and quoted a list of samples, trimmed, as syntactic names."""
    t = spark.read.csv(path, sep=sep, header=False, quote='"', schema="grp string, s string")
    return t.select("grp", F.transform(F.split("s", ","), lambda x: make_names(F.trim(x))).alias("members"))


def write_groups(groups: DataFrame, path: str) -> None:
    """group,"a, b, c" by line: a folder of files whose lines, taken by name, are in order."""
    groups.orderBy("grp").select(F.concat(F.col("grp"), F.lit(',"'), F.array_join("members", ", "), F.lit('"')).alias("value")).write.mode("overwrite").text(path)
