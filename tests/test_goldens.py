"""Hand-sized cases with known values."""

import numpy as np
import pytest

from quern.functions import stats
from quern.model import CountMatrix, Embedding
from quern.operators import embed, evaluate, filtering, graph, groups, normalize


@pytest.fixture(scope="module")
def g1(spark):
    e = [("g1", "s1", 1.0), ("g1", "s3", 2.0), ("g2", "s2", 3.0), ("g2", "s3", 1.0), ("g2", "s4", 4.0), ("g3", "s1", 5.0), ("g3", "s2", 5.0), ("g3", "s4", 2.0), ("g4", "s4", 1.0)]
    return CountMatrix.of(spark.createDataFrame(e, "feature_id string, sample_id string, value double"))


def cells(m):
    return {(r.feature_id, r.sample_id): r.value for r in m.entries.collect()}


def test_normalize(g1):
    got = cells(normalize.normalize_counts(g1, 6.5))
    assert got["g1", "s1"] == pytest.approx(1.08333333) and got["g2", "s4"] == pytest.approx(3.71428571) and got["g4", "s4"] == pytest.approx(0.92857143)
    assert normalize.median_depth(g1) == 6.5


def test_batch(spark, g1):
    b = spark.createDataFrame([("s1", "A"), ("s2", "A"), ("s3", "B"), ("s4", "B")], "sample_id string, batch string")
    got = cells(normalize.normalize_counts(g1, 6.5, b))
    assert got["g1", "s3"] == pytest.approx(3.05555556) and got["g3", "s1"] == pytest.approx(3.97727273) and got["g4", "s4"] == pytest.approx(0.58928571)
    with pytest.raises(ValueError):
        normalize.normalize_counts(g1, 6.5, b.where("sample_id != 's2'"))


def test_variance(g1):
    rows = {r.feature_id: r for r in normalize.adjust_variance(normalize.normalize_counts(g1, 6.5)).collect()}
    assert rows["g1"].res == pytest.approx(0.62000314, abs=1e-7) and rows["g1"].lp == pytest.approx(0.34978074, abs=1e-7)
    assert rows["g3"].qv == pytest.approx(0.58918840, abs=1e-7) and rows["g4"].gsf == pytest.approx(1.87115505, abs=1e-7)
    assert rows["g2"].lpa == pytest.approx(0.65216007, abs=1e-7)


def test_scale(g1):
    got = cells(normalize.scale_counts(g1))
    assert got["g1", "s3"] == pytest.approx(1.16660380, abs=1e-7) and got["g4", "s4"] == pytest.approx(1.00704550, abs=1e-7)
    with pytest.raises(ValueError):
        normalize.scale_counts(g1, method="T")


def test_coordinates(spark):
    f = spark.createDataFrame([(f"factor_{i + 1}", i + 1, float(x), float(y), "") for i, (x, y) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])], "factor string, factor_idx int, x double, y double, name string")
    h = spark.createDataFrame([(1, [4.0, 2.0, 1.0, 0.0]), (2, [1.0] * 4), (3, [0.0] * 4)], "sample_id long, h array<double>")
    for alpha, xy in ((1.0, (0.42857143, 0.14285714)), (2.0, (0.23809524, 0.04761905))):
        got = {r.sample_id: (r.x, r.y) for r in embed.pulled(h, f, "sample_id", "h", alpha, 3).collect()}
        assert got[1] == pytest.approx(xy) and got[2] == pytest.approx((0.66666667, 0.33333333)) and got[3] == (None, None)
    one = embed.embed_features(Embedding(f, h), spark.createDataFrame([("a", [4.0, 2.0, 1.0, 0.0])], "feature_id string, a array<double>"))
    assert one.features.count() == 1


def test_snn(spark):
    p = spark.createDataFrame([(i + 1, [float(x)]) for i, x in enumerate((0, 1, 3, 7))], "sample_id long, v array<double>")
    got = {(r.src, r.dst): r.weight for r in graph.calc_snn(p, 3).collect()}
    assert all(got[a, b] == 1 for a in (1, 2, 3) for b in (1, 2, 3)) and got[4, 4] == 1
    assert all(got[4, b] == pytest.approx(0.5) and got[b, 4] == pytest.approx(0.5) for b in (1, 2, 3))
    with pytest.raises(ValueError):
        graph.calc_knn(p, 5)


def test_partitions(spark):
    links = {(1, 2): 40.0, (1, 3): 1.0, (2, 3): 2.0}
    rows = [(a, b, links.get((min(a, b), max(a, b)), 0.0)) for a in (1, 2, 3) for b in (1, 2, 3)]
    got = {(r.c1, r.c2): r for r in graph.compute_partitions(spark.createDataFrame(rows, "c1 int, c2 int, links double"), 1e-3).collect()}
    assert got[1, 3].p == pytest.approx(0.64161484, abs=1e-7) and got[2, 3].p == pytest.approx(0.32790255, abs=1e-7)
    assert got[1, 2].p_adj == pytest.approx(1.55e-6, rel=0.02) and {k for k, r in got.items() if r.significant} == {(1, 2), (2, 1)}


def test_winsorize(spark):
    e = spark.createDataFrame([(f"g{i}", "s", float(v)) for i, v in enumerate((9, 7, 7, 3, 1))], "feature_id string, sample_id string, value double")
    assert sorted((r.value for r in filtering.winsorize(e, 1).collect()), reverse=True) == [7, 7, 7, 3, 1]
    assert sorted((r.value for r in filtering.winsorize(e, 4).collect()), reverse=True) == [9, 7, 7, 3, 1]


def test_tails():
    assert float(stats.f_upper(1.0, 7, 7)) == pytest.approx(0.5)
    assert float(stats.chi2_quantile(0.95, 3)) == pytest.approx(7.814727903, abs=1e-6)
    assert float(stats.normal_upper(1.959963985)) == pytest.approx(0.025, abs=1e-9)
    p = np.array([0.01, 0.02, 0.03, 0.9])
    assert stats.bh(p) == pytest.approx([0.04, 0.04, 0.04, 0.9]) and stats.holm(p) == pytest.approx([0.04, 0.06, 0.06, 0.9])


def test_groups(spark):
    g = spark.createDataFrame([("a", ["x", "y"]), ("b", ["y", "z"])], "grp string, members array<string>")
    assert sorted(map(tuple, groups.flatten_groups(g).collect())) == [("x", "a"), ("z", "b")]
    m = spark.createDataFrame([("s", "a", 1.0), ("s", "b", 2.0), ("t", "a", 0.5)], "sample_id string, label string, score double")
    cut = spark.createDataFrame([("a", 0.4), ("b", 1.0)], "label string, cutoff double")
    assert sorted(map(tuple, groups.multi_label(m, cut, m.select("sample_id").distinct()).collect())) == [("s", None), ("t", "a")]


def test_rename(spark):
    f = spark.createDataFrame([("factor_1", 1, 0.0, 0.0, "factor_1"), ("factor_2", 2, 0.0, 0.0, "factor_2")], "factor string, factor_idx int, x double, y double, name string")
    m = spark.createDataFrame([("factor_1", "n")], "old string, new string")
    assert sorted(r.name for r in embed.rename_factors(f, m).collect()) == ["", "n"]
    assert sorted(r.name for r in embed.rename_factors(f, m, set_empty=False).collect()) == ["factor_2", "n"]


def test_jaccard(spark):
    a = spark.createDataFrame([(1, 2), (1, 3)], "src int, dst int")
    b = spark.createDataFrame([(1, 3), (1, 4)], "src int, dst int")
    assert evaluate.jaccard_score(a, b).first().jaccard == pytest.approx(1 / 3)
