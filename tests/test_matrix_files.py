"""Matrix folders written by many tasks and read back."""

import pytest
from pyspark.sql import functions as F

from quern.model import CountMatrix
from quern.sources import text


def test_matrix_folder_of_many_files(spark, tmp_path):
    cells = [(f"g{k % 37:02}", f"s{k % 101:03}", float(k % 7) / 2) for k in range(3000)]
    e = spark.createDataFrame(cells, "feature_id string, sample_id string, value double").groupBy("feature_id", "sample_id").agg(F.sum("value").alias("value"))
    m = CountMatrix.of(e.unionByName(spark.createDataFrame([("elsewhere", "s000", 3.0)], e.schema)), spark.createDataFrame([(f"g{k:02}",) for k in range(40)], "feature_id string"), spark.createDataFrame([(f"s{k:03}",) for k in range(105)], "sample_id string"))
    at = f"{tmp_path}/m"
    text.write_matrix_dir(m, at)
    files = sorted((tmp_path / "m" / "matrix.mtx").glob("part-*"))
    lines = [x for f in files for x in f.read_text().splitlines()]
    want = {(r.feature_id, r.sample_id): r.value for r in e.collect() if r.value}
    assert len(files) > 1 and lines[0].startswith("%%MatrixMarket") and lines[1] == f"40 105 {len(want)}"
    places = [tuple(int(x) for x in line.split()[1::-1]) for line in lines[2:]]
    assert places == sorted(places) and len(places) == len(want)
    assert [x for f in sorted((tmp_path / "m" / "barcodes.tsv").glob("part-*")) for x in f.read_text().splitlines()] == [f"s{k:03}" for k in range(105)]
    for parts in ("128m", "64"):  # files whole, and cut into many splits
        spark.conf.set("spark.sql.files.maxPartitionBytes", parts)
        try:
            back = text.read_data(spark, at)
            assert {(r.feature_id, r.sample_id): r.value for r in back.entries.collect()} == want
            assert back.features.count() == 40 and back.samples.count() == 105
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    one = tmp_path / "plain"
    one.mkdir()
    for name in ("matrix.mtx", "features.tsv", "barcodes.tsv"):
        (one / name).write_text("".join(f.read_text() for f in sorted((tmp_path / "m" / name).glob("part-*"))))
    assert {(r.feature_id, r.sample_id): r.value for r in text.read_data(spark, str(one)).entries.collect()} == want


def test_matrix_folder_edges(spark, tmp_path):
    none = CountMatrix(spark.createDataFrame([], "feature_id string, sample_id string, value double"), spark.createDataFrame([("a",)], "feature_id string"), spark.createDataFrame([("b",)], "sample_id string"))
    text.write_matrix_dir(none, f"{tmp_path}/none")
    back = text.read_data(spark, f"{tmp_path}/none")
    assert back.entries.count() == 0 and back.features.count() == back.samples.count() == 1
    for bad in ("a\tb", "a\nb", None):
        with pytest.raises(ValueError):
            text.write_matrix_dir(CountMatrix(none.entries, spark.createDataFrame([(bad,)], "feature_id string"), none.samples), f"{tmp_path}/bad")
