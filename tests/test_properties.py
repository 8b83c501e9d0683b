"""Properties of iterative operators."""

import gzip

import numpy as np
import pandas as pd
import pytest

from quern.functions import linalg
from quern.functions.storage import materialized
from quern.model import CountMatrix, Factorization
from quern.operators import annotate, embed, factorize, graph, plotdata
from quern.plans import pipeline
from quern.sources import text


@pytest.fixture(scope="module")
def planted(spark):
    """Three groups of samples, each with its own features."""
    r = np.random.default_rng(0)
    rows = []
    for s in range(60):
        for f in range(15):
            v = r.poisson(6.0 if f // 5 == s % 3 else 0.4)
            if v:
                rows.append((f"g{f:02d}", s, float(v)))
    m = CountMatrix.of(spark.createDataFrame(rows, "feature_id string, sample_id long, value double"))
    return CountMatrix(materialized(m.entries), materialized(m.features), materialized(m.samples))


@pytest.fixture(scope="module")
def fit(planted):
    return factorize.run_nmf(planted, 3, init="nnsvd", max_iter=20)


def arrays(df, key, col):
    return {r[key]: np.array(r[col]) for r in df.collect()}


@pytest.mark.parametrize("init", ["random", "ica"])
def test_nmf(planted, init):
    f = factorize.run_nmf(planted, 3, init=init, max_iter=10)
    assert all(b <= a + 1e-9 for a, b in zip(f.errors, f.errors[1:]))
    assert all((v >= 0).all() for v in arrays(f.w, "feature_id", "w").values()) and all((v >= 0).all() for v in arrays(f.h, "sample_id", "h").values())


def test_kl(planted):
    f = factorize.run_nmf(planted, 3, init="random", loss="mkl", max_iter=6)
    assert all(b <= a + 1e-9 for a, b in zip(f.errors, f.errors[1:]))


@pytest.mark.parametrize("name", ["run_nmf", "run_nmf_kl", "nnsvd_init", "ica_init", "project_samples", "find_num_factors", "run_embedding", "project_embedding"])
def test_registered_fits_have_all_rounds(spark, planted, monkeypatch, name):
    """Registered fits may take as many rounds as the reference's, and only the tolerance ends them sooner."""
    from quern.plans import queries

    class Seen(Exception):
        pass

    fits, whole = [], factorize._factorized

    def spy(pk, k, alpha, init, loss, max_iter, ica_fast, tol, seed):
        fits.append((k, max_iter, tol))
        f = whole(pk, k, alpha, init, loss, max_iter, ica_fast, tol, seed) if name in ("nnsvd_init", "ica_init") else Factorization(None, None, k, (1.0 / k,))
        if name in ("nnsvd_init", "ica_init"):
            assert abs(f.errors[-2] - f.errors[-1]) <= tol * f.errors[-2]
        elif name != "find_num_factors":
            raise Seen
        return f

    monkeypatch.setattr(factorize, "_factorized", spy)
    monkeypatch.setattr(queries, "_norm", lambda spark, d: planted)
    monkeypatch.setattr(queries, "batches", lambda spark, d: planted.samples.selectExpr("sample_id", "string(sample_id % 3) AS batch"))
    try:
        queries.Q[name](spark, "")
    except Seen:
        pass
    if name == "find_num_factors":
        assert fits == [(k, 250, 1e-4) for k in range(2, 13, 2) for _ in range(2)]
    else:
        assert [x[1:] for x in fits] == [(500, 1e-4)]


def test_registered_gsea_has_all_permutations(spark, monkeypatch):
    from quern.plans import queries

    said = {}
    monkeypatch.setattr(annotate, "run_gsea", lambda *a, **b: said.update(b))
    monkeypatch.setattr(queries, "_assoc", lambda spark, d: None)
    monkeypatch.setattr(queries, "_brandsets", lambda spark, d: None)
    queries.Q["run_gsea"](spark, "")
    assert said.get("n_rand", 1000) >= 1000


def test_refusals(spark, planted):
    for bad in (dict(k=2), dict(k=3, init="x"), dict(k=3, loss="x")):
        with pytest.raises(ValueError):
            factorize.run_nmf(planted, **bad)
    neg = CountMatrix.of(spark.createDataFrame([("a", 1, -1.0)], "feature_id string, sample_id long, value double"))
    with pytest.raises(ValueError):
        factorize.run_nmf(neg, 3)


def test_projecting_training_samples(planted, fit):
    a, b = arrays(fit.h, "sample_id", "h"), arrays(factorize.project_samples(planted, fit.w, 3), "sample_id", "h")
    assert max(np.abs(a[k] - b[k]).max() for k in a) < 1e-6


def test_kkt(planted, fit):
    w = arrays(factorize.project_features(planted, fit.h, 3), "feature_id", "w")
    g = factorize.gram_of(fit.h, "h", 3)
    b = arrays(factorize.products(planted.entries, fit.h, "sample_id", "feature_id", "h", 3), "feature_id", "b")
    for k, x in w.items():
        grad = g @ x - b[k]
        assert (grad > -1e-5 * np.abs(b[k]).max()).all() and abs(x @ grad) < 1e-5 * max(1, x @ b[k])


def test_shuffle_keeps_values(planted):
    a, b = planted.entries, factorize.shuffled(planted).entries
    assert sorted(r.value for r in a.collect()) == sorted(r.value for r in b.collect())
    assert b.select("feature_id", "sample_id").distinct().count() == b.count()


def test_factor_rule(spark):
    e = spark.createDataFrame([(2, 9.0, 9.0), (4, 5.0, 8.5), (6, 4.9, 8.0), (8, 4.8, 7.5)], "k int, err double, err_rand double")
    assert factorize.choose_k(e) == 4
    up = spark.createDataFrame([(2, 9.0, 9.0), (4, 6.0, 8.9), (6, 4.0, 8.8)], "k int, err double, err_rand double")
    assert factorize.choose_k(up) == 6


def test_svd(planted):
    pk = linalg.packed(planted)
    u, d, mu = linalg.truncated_svd(pk, 4, rounds=60)
    x = np.zeros((pk.n, pk.p))
    for r in pk.rows.orderBy("sample_id").collect():
        x[r.sample_id, r.idx] = r.val
    assert d == pytest.approx(np.linalg.svd(x - x.mean(axis=0), compute_uv=False)[:4], rel=1e-4)
    assert np.allclose(u.T @ u, np.eye(4), atol=1e-8) and mu == pytest.approx(x.mean(axis=0))


def test_sammon():
    xy = np.random.default_rng(1).normal(size=(6, 2))
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    y, stress = embed.sammon(d)
    assert stress < 1e-6 and np.abs(np.sqrt(((y[:, None] - y[None]) ** 2).sum(axis=2)) - d).max() < 1e-3
    embed.sammon(np.zeros((3, 3)))


def test_information():
    r = np.random.default_rng(0)
    x = r.normal(size=400)
    assert annotate.information_coefficient(x, x + 0.01 * r.normal(size=400)) > 0.9
    assert annotate.information_coefficient(x, -x) < -0.9 and abs(annotate.information_coefficient(x, r.normal(size=400))) < 0.6
    assert annotate.information_coefficient(x[:2], x[:2]) == 0 and annotate.information_coefficient(x, np.full(400, np.nan)) == 0


def test_information_of_any_number_of_samples(spark, planted, fit):
    """Passes over all samples give what the pairs at hand give, where the scores are too many for the driver too."""
    want = {(r.feature_id, r.factor_idx): r.assoc for r in annotate.associate_ic(planted, fit.h, 3).collect()}
    extra = planted.with_entries(planted.entries.unionByName(spark.createDataFrame([("other", 10_000, 1.0)], planted.entries.schema)))
    got = {(r.feature_id, r.factor_idx): r.assoc for r in annotate.associate_ic(extra, fit.h, 3, most=30).collect()}
    assert [got.pop(("other", j)) for j in (1, 2, 3)] == [0, 0, 0] and got == pytest.approx(want, abs=1e-5) and len(want) == 45
    parts = {(r.feature_id, r.factor_idx): r.assoc for r in annotate.associate_ic_passes(planted, fit.h, 3, features=6).collect()}
    assert parts == pytest.approx(want, abs=1e-5)


def test_information_matrix_takes_all_samples(spark):
    r = np.random.default_rng(4)
    x = r.gamma(1.0, size=(230_000, 2))
    x[:, 1] += x[:, 0]
    h = spark.createDataFrame(pd.DataFrame({"sample_id": range(len(x)), "h": list(x)}), "sample_id long, h array<double>")
    want = annotate.information_coefficient(x[:, 0], x[:, 1])
    assert annotate.information_matrix(h, 2) == pytest.approx(np.array([[1, want], [want, 1]]), abs=1e-6)


def test_louvain(spark):
    e = [(a, b) for g in range(3) for a in range(5 * g, 5 * g + 5) for b in range(5 * g, a)] + [(0, 5), (5, 10)]
    df = spark.createDataFrame(e, "src long, dst long")
    got = {r.sample_id: r.grp for r in graph.louvain(df).collect()}
    assert len(set(got.values())) == 3 and all(got[5 * g] == got[5 * g + i] for g in range(3) for i in range(5))
    assert graph.label_propagation(df, 3).count() == 15


def test_end_to_end(spark, planted):
    fit = pipeline.run_embedding(planted, 3, init="nnsvd", max_iter=10, snn_k=8, groups=planted.samples.withColumn("grp", planted.samples.sample_id % 3), genes_embed=planted.features)
    xy = {r.sample_id: (r.x, r.y) for r in fit.embedding.samples.collect()}
    f = [(r.x, r.y) for r in fit.embedding.factors.collect()]
    assert len(xy) == 60 and all(min(p[i] for p in f) - 1e-9 <= v[i] <= max(p[i] for p in f) + 1e-9 for v in xy.values() for i in (0, 1))
    c = {g: np.mean([xy[s] for s in xy if s % 3 == g], axis=0) for g in range(3)}
    assert min(np.linalg.norm(c[a] - c[b]) for a, b in ((0, 1), (0, 2), (1, 2))) > 0.2
    assert fit.embedding.features.count() == 15
    test = CountMatrix(planted.entries.where("sample_id < 12"), planted.features, planted.samples.where("sample_id < 12"))
    assert pipeline.project_samples(fit, test, snn_k=5, k_scale=3).count() == 12


def test_genesets_mf(spark, planted):
    g = spark.createDataFrame([("a", [f"g{i:02d}" for i in range(5)]), ("b", [f"g{i:02d}" for i in range(5, 10)])], "geneset string, members array<string>")
    names, w, h = annotate.project_genesets(planted, g, "mf", 5)
    assert names == ["a", "b"] and all((v[1] == 0) == (k < "g05") or v.sum() == 0 for k, v in arrays(w, "feature_id", "w").items())
    assert h.count() == 60


def test_stream(spark, planted, fit, tmp_path):
    from pyspark.sql import functions as F

    from quern.streaming.project import project_stream

    emb = embed.embed_samples(fit.h, 3)
    rows = planted.entries.groupBy("sample_id").agg(F.collect_list("feature_id").alias("features"), F.collect_list("value").alias("vals"))
    rows.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = project_stream(s, fit, emb).writeStream.format("memory").queryName("placed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got, want = arrays(spark.table("placed"), "sample_id", "h"), arrays(fit.h, "sample_id", "h")
    assert len(got) == 60 and max(np.abs(got[k] - want[k]).max() for k in got) < 1e-6


def test_files(spark, tmp_path):
    d = tmp_path / "m"
    d.mkdir()
    with gzip.open(d / "matrix.mtx.gz", "wt") as f:
        f.write("%%MatrixMarket matrix coordinate integer general\n%\n2 3 3\n1 1 5\n2 2 7\n1 3 1\n")
    (d / "barcodes.tsv").write_text("AA-1\n1B-1\nCC-1\n")
    (d / "genes.tsv").write_text("id1\tg\nid2\tg\n")
    m = text.read_data(spark, str(d))
    assert sorted(map(tuple, m.entries.collect())) == [("g", "AA", 5.0), ("g", "CC", 1.0), ("g.1", "X1B", 7.0)] and m.n_samples() == 3
    w = tmp_path / "wide.tsv"
    w.write_text("id\ts 1\ts2\nf1\t0\t2\nf2\t3\t0\n")
    m = text.read_data(spark, str(w))
    assert sorted(map(tuple, m.entries.collect())) == [("f1", "s2", 2.0), ("f2", "s.1", 3.0)]
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        text.read_data(spark, str(tmp_path / "none"))
    g = spark.createDataFrame([("a b", ["x", "y"]), ("c", ["z"])], "geneset string, members array<string>")
    text.write_genesets(g, str(tmp_path / "gmt"))
    assert sorted((r.geneset, tuple(r.members)) for r in text.read_genesets(spark, str(tmp_path / "gmt")).collect()) == [("a_b", ("x", "y")), ("c", ("z",))]
    (tmp_path / "short.gmt").write_text("only\tdescription\nfull\td\tm\n")
    assert [r.geneset for r in text.read_genesets(spark, str(tmp_path / "short.gmt")).collect()] == ["full"]
    text.write_groups(spark.createDataFrame([("g", ["a", "b c"])], "grp string, members array<string>"), str(tmp_path / "grp"))
    assert [(r.grp, list(r.members)) for r in text.read_groups(spark, str(tmp_path / "grp")).collect()] == [("g", ["a", "b.c"])]


def test_plots(spark):
    e = spark.createDataFrame([(f, s, float((f * 7 + s * 3) % 5)) for f in range(4) for s in range(3)], "feature_id int, sample_id int, value double")
    rows, cols = plotdata.heat_order(e)
    assert sorted(rows) == [0, 1, 2, 3] and sorted(cols) == [0, 1, 2]
    with pytest.raises(ValueError):
        plotdata.heat_table(e, "T")
    g = spark.createDataFrame([("s", "a"), ("t", "b"), ("u", None)], "sample_id string, grp string")
    assert plotdata.palette(g, 1).count() == 2 and plotdata.palette(g, 1).collect() == plotdata.palette(g, 1).collect()
    assert plotdata.ellipse((20, 0.0, 0.0, 1.0, 1.0, 0.0)).shape == (51, 2)


def test_penalised_kl(planted):
    """Penalties lower the fit of KL factorisations, which still never worsens; wrong losses are refused."""
    plain = factorize.run_nmf(planted, 3, init="random", loss="mkl", max_iter=6)
    some = factorize.run_nmf(planted, 3, init="random", loss="mkl", max_iter=6, alpha=(0.5, 0.1, 2.0))

    def total(df, key, col):
        return sum(v.sum() for v in arrays(df, key, col).values())

    assert total(some.h, "sample_id", "h") < total(plain.h, "sample_id", "h") and some.errors[-1] > plain.errors[-1]
    with pytest.raises(ValueError):
        factorize.project_samples(planted, plain.w, 3, loss="x")
    with pytest.raises(ValueError):
        factorize.project_features(planted, plain.h, 3, loss="x")


def test_kl_projections(planted, fit):
    """The joins' multiplicative updates come to a point where none of them lowers the divergence any more."""
    h = arrays(factorize.project_samples(planted, fit.w, 3, loss="mkl"), "sample_id", "h")
    w = arrays(fit.w, "feature_id", "w")
    names = sorted(w)
    big = np.array([w[f] for f in names])
    x = {s: np.zeros(len(names)) for s in h}
    for r in planted.entries.collect():
        x[r.sample_id][names.index(r.feature_id)] = r.value

    def loss(v, y):
        z = big @ y + 1e-12
        return (np.where(v > 0, v * np.log(np.maximum(v, 1e-300) / z), 0) - v + z).sum()

    for s, y in h.items():
        best = loss(x[s], y)
        for j in range(3):
            for step in (-1e-3, 1e-3):
                moved = y.copy()
                moved[j] = max(0.0, moved[j] * (1 + step))
                assert loss(x[s], moved) >= best - 1e-6
    back = arrays(factorize.project_features(planted, fit.h, 3, loss="mkl"), "feature_id", "w")
    assert set(back) == set(names) and all((v >= 0).all() for v in back.values())
    _, _, scores = annotate.project_genesets(planted, planted.entries.sparkSession.createDataFrame([("a", names[:5]), ("b", names[5:10])], "geneset string, members array<string>"), "mf", 5, "mkl")
    assert scores.count() == planted.n_samples()


def test_sparse_passes_against_dense(planted):
    pk = linalg.packed(planted)
    rows = sorted(pk.rows.collect(), key=lambda r: r.sample_id)
    a = np.zeros((len(rows), pk.p))
    for i, r in enumerate(rows):
        a[i, r.idx] = r.val
    counts = np.array([len(r.idx) for r in rows])
    x = linalg.Rows(np.concatenate([r.idx for r in rows]).astype(int), np.concatenate([r.val for r in rows]), counts, pk.p)
    g = np.random.default_rng(0)
    q, h = g.random((pk.p, 4)), g.random((len(rows), 4))
    assert np.allclose(x @ q, a @ q) and np.allclose(x.across(h), a.T @ h) and np.allclose(x.dense(), a) and np.allclose(x.sums(), a.sum(axis=1))
    assert np.allclose(x.products(h, q), (h @ q.T)[x.row, x.idx])
    empty = linalg.Rows(np.zeros(0, int), np.zeros(0), np.zeros(3, int), pk.p)
    assert not (empty @ q).any() and not empty.across(h[:3]).any()
    _, d, mu = linalg.truncated_svd(pk, 3)
    assert np.allclose(d, np.linalg.svd(a - a.mean(axis=0), compute_uv=False)[:3], rtol=1e-5) and np.allclose(mu, a.mean(axis=0))


def test_many_features(spark):
    """200,000 features: a pass needs room for features times factors, not for samples times features."""
    import resource

    n, p = 3000, 200_000
    e = spark.range(n * 40).selectExpr(f"cast(pmod(xxhash64(id), {p}) as long) feature_id", f"id % {n} sample_id", "1.0 + id % 3 value").groupBy("feature_id", "sample_id").agg({"value": "max"}).withColumnRenamed("max(value)", "value")
    m = CountMatrix(materialized(e), spark.range(p).withColumnRenamed("id", "feature_id"), spark.range(n).withColumnRenamed("id", "sample_id"))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    f = factorize.run_nmf(m, 3, init="random", max_iter=2)
    assert f.w.count() == p and f.errors[1] <= f.errors[0]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 2 << 20  # kilobytes on the driver


def test_hub(spark, monkeypatch):
    """A neighbour of everybody: dealt to several tasks, the same graph."""
    r = np.random.default_rng(5)
    rows = [(i, j) for i in range(200) for j in {0, i, *map(int, r.integers(0, 200, 3))}]
    nn = spark.createDataFrame(rows, "src long, dst long")
    want = {(x.src, x.dst): x.weight for x in graph.shared_neighbours(nn, 5).collect()}
    monkeypatch.setattr(graph, "HUB", 7)
    got = {(x.src, x.dst): x.weight for x in graph.shared_neighbours(nn, 5).collect()}
    assert got == want and len(got) > 200


def test_lsh_recall(spark):
    """At least nine tenths of the true neighbours, and k for every sample."""
    r = np.random.default_rng(6)
    centres = r.normal(size=(12, 16)) * 4
    pts = [(i, (centres[i % 12] + r.normal(size=16)).tolist()) for i in range(600)] + [(1000, [50.0] * 16)]
    p = spark.createDataFrame(pts, "sample_id long, v array<double>")
    true = {(x.query_id, x.point_id) for x in graph.nearest(p, p, 10, same=True).collect()}
    got = {(x.query_id, x.point_id) for x in graph.nearest_lsh(p, 10).collect()}
    assert len(got) == len(true) and len(got & true) >= 0.9 * len(true)


def test_nearest_is_one_formula(spark):
    """Equal distances stay ties however the blocks are cut."""
    p = spark.createDataFrame([(i, [1e6 + (i % 7) * 0.5] * 3) for i in range(60)], "sample_id long, v array<double>")
    a, b = ({(x.query_id, x.point_id, x.dist) for x in graph.nearest(p, p, 9, same=True, rows=n).collect()} for n in (2000, 7))
    assert a == b


def test_topics(spark, planted, fit):
    """Scores of another model in place of factors."""
    coords = materialized(linalg.pca(linalg.packed(planted), 5))
    emb = pipeline.embed_topics(fit.h, 3, coords, snn_k=8, groups=planted.samples.selectExpr("sample_id", "string(sample_id % 3) AS grp"))
    assert emb.samples.count() == 60 and emb.factors.where("name != ''").count() == 0


def test_frozen_graph_with_itself(spark):
    """With compat a test sample's own position counts as one of its neighbours."""
    r = np.random.default_rng(7)
    train = spark.createDataFrame([(f"t{i:03d}", r.normal(size=3).tolist()) for i in range(80)], "sample_id string, v array<double>")
    test = spark.createDataFrame([(f"n{i:03d}", r.normal(size=3).tolist()) for i in range(6)], "sample_id string, v array<double>")
    a, b = ({(x.test_id, x.train_id): x.weight for x in graph.project_snn(test, train, 6, 4, compat=c).collect()} for c in (False, True))
    assert a and b and a != b and all(0 < w <= 1 for w in (*a.values(), *b.values()))


def test_shared_folder_is_asked_for():
    from quern.functions import storage
    from types import SimpleNamespace

    with pytest.raises(ValueError):
        storage.folder(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="yarn")), "x")


def test_lost_factors_start_again(spark, monkeypatch):
    """A start with two equal columns leaves one factor unused and a block of the matrix without any."""
    import numpy as np

    from quern.model import CountMatrix
    from quern.operators import factorize

    cells = [(f"f{i}", j, float((i + 1) * (j % 5 + 1))) for i in range(9) for j in range(30) if i % 3 == j % 3]
    m = CountMatrix.of(spark.createDataFrame(cells, "feature_id string, sample_id long, value double"))
    at = np.arange(9)
    start = np.column_stack([at % 3 == 0, at % 3 == 0, at % 3 == 1]) * (at + 1.0)[:, None]
    monkeypatch.setattr(factorize, "_start", lambda *a: start.copy())
    fit = factorize.run_nmf(m, 3, tol=1e-9)
    assert fit.errors[-1] < 1e-9 * fit.errors[0] and all(b <= a + 1e-9 for a, b in zip(fit.errors, fit.errors[1:]))


def test_kl_scores_dense_and_gathered(monkeypatch):
    """Filled rows go the dense way, with the scores of the other one."""
    import numpy as np

    from quern.functions import linalg
    from quern.operators import factorize

    r = np.random.default_rng(2)
    counts = r.integers(0, 12, 40)
    idx = np.concatenate([np.sort(r.choice(20, c, replace=False)) for c in counts]).astype(np.int32)
    x, w = linalg.Rows(idx, r.random(len(idx)) + 0.1, counts, 20), r.random((20, 3))
    seen = []
    plain = linalg.Rows.products
    monkeypatch.setattr(linalg.Rows, "products", lambda *a: seen.append(1) or plain(*a))
    dense = factorize.kl_scores(x, w)
    assert not seen
    monkeypatch.setattr(factorize, "DENSE", 0)
    assert np.allclose(dense, factorize.kl_scores(x, w), rtol=1e-10, atol=0) and seen


def test_fits_share_passes(planted, monkeypatch):
    """Fits of several numbers of factors take as many passes as the longest of them, with the errors that each has alone."""
    pk, none = linalg.packed(planted), (0.0, 0.0, 0.0)
    passes, plain = [], linalg.summed
    monkeypatch.setattr(linalg, "summed", lambda *a: passes.append(1) or plain(*a))
    fits = factorize._fitted(pk, [2, 4], none, "random", "mse", 5, False, 1e-4, 1)
    assert len(passes) == 1 + max(len(f.errors) for f in fits)
    for k, f in zip((2, 4), fits):
        assert np.allclose(f.errors, factorize._fitted(pk, [k], none, "random", "mse", 5, False, 1e-4, 1)[0].errors, rtol=1e-9)
