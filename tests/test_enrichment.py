"""Enrichment scores against a plain running sum, p-values against all sets of a size."""

import itertools

import numpy as np
import pytest

from quern.functions import stats
from quern.model import CountMatrix
from quern.operators import annotate, enrichment


def plain(x, member):
    """Running sum over features in falling order."""
    total, miss, run, high, low = sum(abs(a) for a, y in zip(x, member) if y), sum(not y for y in member), 0.0, 0.0, 0.0
    for a, y in zip(x, member):
        run += (abs(a) / total if total else 0.0) if y else -1.0 / miss
        high, low = max(high, run), min(low, run)
    return 0.0 if not total else high if round(high, 9) >= round(-low, 9) else low


def test_scores_of_places():
    r = np.random.default_rng(1)
    x = np.sort(r.normal(size=30))[::-1]
    places = enrichment.drawn(r, 30, 7, 200)
    got = enrichment.scores(np.abs(x), places)
    assert got == pytest.approx([plain(x, [k in set(p) for k in range(30)]) for p in places.tolist()])
    for many in (1, 2, 5):
        to = enrichment.moved(r, places, 30, many)
        assert all(len(set(p)) == 7 for p in to.tolist()) and (to != places).any()
    assert enrichment.scores(np.zeros(5), np.array([[0, 1]])).tolist() == [0.0]


@pytest.mark.parametrize("sign", [1, -1])
def test_splitting_against_all_sets(sign):
    """Tails far below one in a thousand, of every set of 5 among 22."""
    x = np.sort(np.random.default_rng(2).normal(size=22))[::-1]
    weight = np.abs(x)
    every = sign * enrichment.scores(weight, np.array(list(itertools.combinations(range(22), 5))))
    for share in (2e-2, 1e-3, 1e-4):
        es = float(np.sort(every)[::-1][int(share * len(every))])
        true = float(np.mean(every >= es - 1e-12))
        found = []
        for seed in range(8):
            steps = enrichment.levels(weight, 5, sign, es, np.random.default_rng(seed))
            _, prob, value = [s for s in steps if s[0] <= es + 1e-12][-1]
            found.append(prob * np.mean(value >= es - 1e-12))
        assert abs(np.log(np.mean(found) / true)) < 0.25 and max(abs(np.log(f / true)) for f in found) < 1.0, (share, true, found)


def test_run_gsea(spark):
    r = np.random.default_rng(3)
    x = {(f, k): float(v) for f in (1, 2) for k, v in enumerate(np.round(r.normal(size=22), 2))}
    order = sorted(range(22), key=lambda k: (-x[1, k], f"g{k:02}"))
    sets = {"top": order[:5], "bottom": order[-5:], "mixed": order[::5], "one": [4], "all": list(range(22)), "none": [99], "null": []}
    assoc = spark.createDataFrame([(f, f"g{k:02}", v) for (f, k), v in x.items()] + [(1, "gone", None), (2, "nan", float("nan"))], "factor_idx int, feature_id string, assoc double")
    genesets = spark.createDataFrame([(n, [f"g{k:02}" for k in m + m[:1]]) for n, m in sets.items()] + [("empty", None)], "geneset string, members array<string>")
    rows = {(a.factor_idx, a.geneset): a for a in enrichment.run_gsea(assoc, genesets, n_rand=300).collect()}
    assert set(rows) == {(f, n) for f in (1, 2) for n in ("top", "bottom", "mixed", "one")}
    for (f, n), a in rows.items():
        order = sorted(range(22), key=lambda k: (-x[f, k], f"g{k:02}"))
        values = np.array([x[f, k] for k in order])
        assert a.es == pytest.approx(plain(values, [k in sets[n] for k in order]))
        every = enrichment.scores(np.abs(values), np.array(list(itertools.combinations(range(22), len(sets[n])))))
        same = every[(every >= 0) == (a.es >= 0)]
        true = float(np.mean(np.abs(same) >= abs(a.es) - 1e-12))
        assert abs(np.log(a.p / true)) < 0.8, (f, n, a.p, true)
    assert rows[1, "top"].p < 1 / 1000
    for f in (1, 2):
        names = [n for g, n in rows if g == f]
        assert [rows[f, n].q for n in names] == pytest.approx(stats.bh([rows[f, n].p for n in names]))
    again = {(a.factor_idx, a.geneset): a for a in enrichment.run_gsea(assoc, genesets, n_rand=300).collect()}
    assert again == rows
    coarse = enrichment.run_gsea(assoc, genesets, n_rand=50, few=0).collect()
    assert min(a.p for a in coarse) >= 1 / 51
    assert {(a.p, a.q) for a in enrichment.run_gsea(assoc, genesets, n_rand=0).collect()} == {(1.0, 1.0)}
    assert enrichment.run_gsea(assoc.limit(0), genesets).count() == enrichment.run_gsea(assoc, genesets.limit(0)).count() == 0


def test_adjusted_within_groups(spark):
    r = np.random.default_rng(4)
    rows = [(int(g), k, float(round(p, 2))) for k, (g, p) in enumerate(zip(r.integers(0, 4, 200), r.random(200)))]
    df = spark.createDataFrame(rows + [(1, 999, None)], "g int, k int, p double")
    for method in (stats.bh, stats.holm):
        got = {a.k: a.a for a in stats.adjusted(df, "p", ["k"], method, "a", by=["g"]).collect()}
        for g in range(4):
            mine = [(k, p) for h, k, p in rows if h == g]
            assert [got[k] for k, _ in mine] == pytest.approx(method([p for _, p in mine]))
        assert got[999] is None


def test_ic_with_nulls_on_both_ways(spark):
    """The scores in memory and the passes over them agree, a null or NaN value being a zero on either."""
    r = np.random.default_rng(6)
    h = spark.createDataFrame([(k, [float(x) for x in r.random(2)]) for k in range(60)], "sample_id long, h array<double>")
    cells = [(f"f{f}", k, float(r.integers(1, 9))) for f in range(3) for k in range(60) if r.random() < 0.6]
    holes = [(a, k, None if n % 7 == 0 else float("nan") if n % 7 == 1 else v) for n, (a, k, v) in enumerate(cells)] + [("hollow", 1, None)]
    schema = "feature_id string, sample_id long, value double"
    got = []
    for rows in (holes, [(a, k, v if v == v and v is not None else 0.0) for a, k, v in holes]):
        e = spark.createDataFrame(rows, schema)
        m = CountMatrix(e, e.select("feature_id").distinct(), h.select("sample_id"))
        for most in (1_000_000, 119):
            got.append({(a.feature_id, a.factor_idx): a.assoc for a in annotate.associate_ic(m, h, 2, most).collect()})
    assert len(got[0]) == 8 and all(x.keys() == got[0].keys() for x in got)
    for x in got[1:]:
        assert all(x[k] == pytest.approx(got[0][k], abs=1e-6) for k in x), (x, got[0])
