"""Indexes, scans, communities and smooths that work on the cluster, against plain Python."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.functions import scans, smooth, stats
from quern.operators import graph, louvain, neighbours, normalize


def points(spark, x):
    return spark.createDataFrame([(int(i), [float(y) for y in v]) for i, v in enumerate(x)], "sample_id long, v array<double>").repartition(3)


def plain_knn(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return {(i, r + 1, int(j)) for i in range(len(x)) for r, j in enumerate(np.lexsort((np.arange(len(x)), d[i]))[:k])}


@pytest.mark.parametrize("cells", [1, 7, 60])
def test_cells_find_the_same_neighbours(spark, monkeypatch, cells):
    """With ties, a third of all points equal, cells of one point, and cells cut into parts."""
    monkeypatch.setattr(neighbours, "PART_ROWS", 15)
    r = np.random.default_rng(2)
    x = np.r_[r.integers(0, 4, (60, 3)), np.tile([1, 2, 3], (50, 1)), 50 + r.normal(size=(30, 3)).round(2), [[900, 0, 0]]].astype(float)
    got = neighbours.nearest_by_cells(points(spark, x), points(spark, x), 6, True, cells).collect()
    assert {(g.query_id, g.rank, g.point_id) for g in got} == plain_knn(x, 6) and len(got) == 6 * len(x)
    few = neighbours.nearest_by_cells(points(spark, x[:2]), points(spark, x[:3]), 6, False, cells).collect()
    assert len(few) == 6
    assert neighbours.nearest_by_cells(points(spark, x), points(spark, x).limit(0), 6).count() == 0


def test_cells_visited_on_clusters(spark):
    """Queries of clustered points see a small part of the cells, and so of the pairs."""
    r = np.random.default_rng(4)
    centres = r.normal(size=(40, 8)) * 30
    x = centres[r.integers(0, 40, 2000)] + r.normal(size=(2000, 8))
    p = points(spark, x)
    index = neighbours.Cells(p, 64)
    index.placed(p)
    exact = neighbours.nearest_by_cells(p, p, 5, True, 64)
    bound = exact.where("rank = 5").select(F.col("query_id").alias("sample_id"), F.col("dist").alias("bound"))
    seen = neighbours.due(p.join(bound, "sample_id").select("sample_id", "v", "bound"), index, 5, False).groupBy("sample_id").count().agg(F.avg("count")).first()[0]
    assert 1 <= seen < 8
    assert exact.count() == 5 * 2000 and exact.agg(F.sum("dist")).first()[0] == pytest.approx(graph.nearest(p, p, 5, True).agg(F.sum("dist")).first()[0], rel=1e-12)


def test_a_query_travels_once_for_each_part(spark, monkeypatch):
    """Points without clusters: all cells are in reach, but a query goes to the few parts that they are put together to."""
    monkeypatch.setattr(neighbours, "PART_ROWS", 150)
    p = points(spark, np.random.default_rng(8).normal(size=(400, 12)))
    index = neighbours.Cells(p, 40)
    index.placed(p)
    sent = neighbours.due(p.withColumn("bound", F.lit(100.0)), index, 5, False).groupBy("sample_id").count().agg(F.max("count")).first()[0]
    assert sent == index.all <= 5
    assert {(g.query_id, g.rank, g.point_id) for g in neighbours.nearest_by_cells(p, p, 5, True, 40).collect()} == plain_knn(np.array([r.v for r in p.orderBy("sample_id").collect()]), 5)


def test_copies_beyond_k_are_left_out():
    """Of equal rows only the first by rank can be neighbours; other rows stay."""
    y = np.r_[np.ones((50, 3)), np.arange(12.0).reshape(4, 3)]
    rank = np.random.default_rng(1).permutation(len(y))
    kept = neighbours.early_copies(y, rank, 4)
    assert kept[50:].all() and set(np.flatnonzero(kept[:50])) == set(np.argsort(rank[:50])[:4])


def test_graphs_find_neighbours_once(spark):
    """Links and their statistics read neighbours several times; they are found before, not in each of these plans."""
    p = points(spark, np.random.default_rng(3).normal(size=(60, 4)))
    g = spark.createDataFrame([(i, i % 3) for i in range(60)], "sample_id long, grp int")
    links = graph.link_statistics(graph.cluster_links(graph.calc_knn(p, 5), g))
    assert links.count() == 9 and "MapInArrow" not in links._jdf.queryExecution().toString()


@pytest.mark.parametrize("hub", [1000, 9])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_shared_neighbours_travel_packed(spark, monkeypatch, hub, kind):
    """Pairs with a neighbour in common are counted from lists that are sent to one of the two; no aggregate of pairs, the same
    weights."""
    monkeypatch.setattr(graph, "HUB", hub)
    r = np.random.default_rng(9)
    sets = {i: {0, i, *map(int, r.integers(0, 60, 3))} for i in range(60)}
    got = graph.shared_neighbours(spark.createDataFrame([(i, j) for i, s in sets.items() for j in s], "src long, dst long").selectExpr(f"cast(src as {kind}) src", f"cast(dst as {kind}) dst"), 5, 0.15)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "count(1) AS s" not in plan
    want = {(i, j): 1.0 if i == j else len(a & b) / (10 - len(a & b)) for i, a in sets.items() for j, b in sets.items()}
    rows = got.collect()
    assert {(int(x.src), int(x.dst)): x.weight for x in rows} == {x: w for x, w in want.items() if w >= 0.15 or x[0] == x[1]} and len(rows) == len({(x.src, x.dst) for x in rows})


def test_single_precision_travels_as_such(spark):
    """Numbers that are single precision go as that, if all are; the rows are those of doubles."""
    x = np.random.default_rng(4).normal(size=(80, 6)).astype(np.float32)
    one, two = points(spark, x), points(spark, x.astype(float) + 1e-9)
    assert [y.schema["v"].dataType.simpleString() for y in neighbours.narrowed(one, one)] == ["array<float>"] * 2
    assert [y.schema["v"].dataType.simpleString() for y in neighbours.narrowed(one, two)] == ["array<double>"] * 2
    for method in ("cells", "blocks"):
        assert {(g.query_id, g.rank, g.point_id) for g in graph.neighbours(one, one, 7, True, method).collect()} == plain_knn(x.astype(float), 7)


def test_method(spark):
    p = points(spark, np.random.default_rng(1).normal(size=(40, 3)))
    one, two, three = (sorted(map(tuple, graph.calc_knn(p, 5, m).collect())) for m in (None, "cells", "blocks"))
    assert one == two == three
    with pytest.raises(ValueError):
        graph.calc_knn(p, 5, "trees")


def test_communities(spark):
    """Planted groups are found; modularity is DuckDB's, and about that of the algorithm in memory; no links, no groups."""
    import duckdb

    r = np.random.default_rng(6)
    of = r.integers(0, 6, 240)
    edges = pd.DataFrame([(int(a), int(b)) for a, b in r.integers(0, 240, (9000, 2)) if a != b and (of[a] == of[b] or r.random() < 0.05)], columns=["src", "dst"])
    df = spark.createDataFrame(edges)
    got = louvain.communities(df)
    groups = got.toPandas()
    assert len(groups) == len(set(edges.src) | set(edges.dst)) and groups.grp.nunique() == 6
    assert groups.assign(of=of[groups.sample_id]).groupby("grp").of.nunique().max() == 1
    q = louvain.modularity(df, got)
    sql = """WITH u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src != dst), e AS (SELECT a, b FROM u UNION ALL SELECT b, a FROM u),
      c AS (SELECT x.grp, count(*) AS t, count(*) FILTER (x.grp = y.grp) AS i FROM e JOIN groups x ON a = x.sample_id JOIN groups y ON b = y.sample_id GROUP BY 1)
      SELECT sum(i / m - (t / m) ** 2) FROM c, (SELECT sum(t) AS m FROM c)"""
    assert q == pytest.approx(duckdb.sql(sql).fetchall()[0][0], abs=1e-9)
    assert q >= 0.99 * louvain.modularity(df, graph.louvain(df))
    assert louvain.modularity(df, louvain.communities(df, finish=0)) >= 0.98 * q
    assert louvain.communities(df.limit(0)).count() == 0


@pytest.fixture
def numbers(spark):
    r = np.random.default_rng(3)
    return pd.DataFrame({"k": np.arange(400), "g": r.choice(["a", "b", None], 400), "p": np.where(r.random(400) < 0.4, 0.25, r.random(400).round(2))})


def test_adjusted(spark, numbers):
    """Ties of a third of all rows, nulls, and orders that span partitions."""
    rows = [(int(k), None if k % 50 == 0 else float(p)) for k, p in zip(numbers.k, numbers.p)]
    df = spark.createDataFrame(rows, "k long, p double").repartition(5)
    some = [p for _, p in rows if p is not None]
    for method in (stats.bh, stats.holm):
        want = dict(zip([k for k, p in rows if p is not None], method(some)))
        got = {r.k: r.p_adj for r in stats.adjusted(df, "p", ["k"], method).collect()}
        assert len(got) == 400 and all(got[k] == pytest.approx(v, rel=1e-12) for k, v in want.items()) and got[0] is None
    assert stats.adjusted(df.limit(0), "p", ["k"], stats.bh).count() == 0
    with pytest.raises(ValueError):
        stats.adjusted(df, "p", ["k"], sorted)


def test_ranks_and_scans(spark, numbers):
    df = spark.createDataFrame([(int(k), g, float(p) if k % 40 else None) for k, g, p in zip(numbers.k, numbers.g, numbers.p)], "k long, g string, p double").repartition(4)
    t = df.toPandas()
    for by in ([], ["g"]):
        want = (t.groupby(t.g.fillna("-")).p if by else t.p).rank()
        got = {r.k: r.r for r in scans.average_ranks(df, by, "p", "r").collect()}
        assert len(got) == 400 and all(got[k] is None if np.isnan(v) else got[k] == v for k, v in zip(t.k, want))
    x = scans.ranged(df, ["k"])
    for kind, f in (("sum", "cumsum"), ("min", "cummin"), ("max", "cummax")):
        for back in (False, True):
            s = t.sort_values("k", ascending=not back).k.mod(17)
            got = scans.scanned(x, ["k"], F.col("k") % 17, kind, "s", back).orderBy(F.col("k").desc() if back else "k").toPandas().s
            assert list(got) == list(getattr(s, f)())
    got = normalize.normalize_vector(df, "p", "scale", ["g"], out="z").toPandas()
    assert got.groupby(got.g.fillna("-")).z.std().round(9).eq(1).all()


def test_thin_plate():
    """With a basis for every value and a fixed penalty it is the natural cubic smoothing spline; lines are kept as they are."""
    r = np.random.default_rng(5)
    x = np.sort(r.random(30))
    y = np.sin(6 * x) + r.normal(0, 0.1, 30)
    plate = smooth.ThinPlate(x, 30)
    u = (x - plate.low) / plate.width
    h = np.diff(u)
    q, g = np.zeros((30, 28)), np.zeros((28, 28))
    for j in range(28):
        q[j, j], q[j + 1, j], q[j + 2, j] = 1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]
        g[j, j] = (h[j] + h[j + 1]) / 3
        if j < 27:
            g[j, j + 1] = g[j + 1, j] = h[j + 1] / 6
    b = plate.basis(x)
    for strength in (1e-4, 1e-2):
        got = b @ plate.solved(b.T @ b, b.T @ y, y @ y, 30, strength)
        want = np.linalg.solve(np.eye(30) + strength * q @ np.linalg.solve(g, q.T), y)
        assert np.abs(got - want).max() < 1e-6
    low = smooth.ThinPlate(x, 10)
    b = low.basis(x)
    assert b.shape == (30, 10) and np.abs(b @ low.solved(b.T @ b, b.T @ (2 * x - 1), (2 * x - 1) @ (2 * x - 1), 30) - 2 * x + 1).max() < 1e-8
    z = np.linspace(0, 1, 200)
    plate = smooth.ThinPlate(z, 10)
    b, s = plate.basis(z), np.sin(6 * z)
    assert np.abs(b @ plate.solved(b.T @ b, b.T @ s, s @ s, 200) - s).max() < 0.01


def test_smooth_on_the_cluster(spark):
    r = np.random.default_rng(7)
    x = r.normal(size=500).round(3)
    y = x**3 - x + r.normal(0, 0.2, 500)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "m double, v double").repartition(4)
    plate, b = smooth.fitted(df, "m", "v", 10)
    basis = plate.basis(x)
    want = basis @ plate.solved(basis.T @ basis, basis.T @ y, y @ y, 500)
    assert np.abs(basis @ b - want).max() < 1e-6 and np.sqrt(np.mean((basis @ b - x**3 + x) ** 2)) < 0.1
    res = y - basis @ b
    assert abs(res.sum()) < 1e-6 and abs((res * x).sum()) < 1e-6


def test_percentiles(spark, numbers):
    """Against numpy, with ties, nulls, a null group and values that span partitions."""
    df = spark.createDataFrame([(g, float(p) if k % 40 else None) for k, g, p in zip(numbers.k, numbers.g, numbers.p)], "g string, p double").repartition(4)
    t = df.toPandas()
    got = {r.g: (r.lo, r.mid, r.hi) for r in scans.percentiles(df, ["g"], "p", {"lo": 0.05, "mid": 0.5, "hi": 0.99}).collect()}
    for g in ("a", "b", None):
        x = t.p[(t.g == g) if g else t.g.isna()].dropna()
        assert got[g] == pytest.approx(tuple(np.quantile(x, [0.05, 0.5, 0.99])))
    assert scans.percentiles(df, [], "p", {"all": 1.0, "least": 0.0}).first().asDict() == {"all": t.p.max(), "least": t.p.min()}
    assert scans.percentiles(df.limit(0), [], "p", {"mid": 0.5}).first()[0] is None


def test_many_members(spark, tmp_path):
    """A set of more than a million members keeps them all."""
    from quern.sources.text import read_genesets

    (tmp_path / "sets.gmt").write_text("big set\td\t" + "\t".join(map(str, range(1_000_010))) + "\nnone\td\none\td\ta\n")
    got = {r.geneset: r.n for r in read_genesets(spark, f"file://{tmp_path}/sets.gmt").select("geneset", F.size("members").alias("n")).collect()}
    assert got == {"big_set": 1_000_010, "one": 1}


@pytest.mark.parametrize("rows", [None, 40])
def test_silhouettes_by_parts(spark, rows):
    """Against plain widths: clusters cut into parts, one of a single sample, equal points, a sample without a cluster."""
    from quern.operators import evaluate

    r = np.random.default_rng(9)
    x = np.r_[r.normal(size=(70, 5)), 1000 + r.normal(size=(60, 5)), np.tile(7.0, (20, 5)), [[3.0] * 5]]
    grp = [*("ab"[i % 2] for i in range(70)), *("c" * 60), *("d" * 20), "e"]
    of = spark.createDataFrame([*enumerate(grp), (900, None)], "sample_id long, grp string")
    p = points(spark, x).unionByName(spark.createDataFrame([(900, [0.0] * 5)], "sample_id long, v array<double>"))
    got = {g.sample_id: g.width for g in evaluate.silhouette(p, of, rows).collect()}
    d, names = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), np.array(grp)
    for i in range(len(x)):
        n = (names == grp[i]).sum()
        a = d[i, names == grp[i]].sum() / (n - 1) if n > 1 else None
        b = min(d[i, names == o].mean() for o in "abcde" if o != grp[i])
        assert got[i] == pytest.approx(0.0 if a is None else (b - a) / max(a, b), abs=1e-9)
    assert len(got) == len(x)


def test_nested_rows_are_bounded(spark, monkeypatch):
    """A group of many members is several rows, and flat again it is whole."""
    from quern.operators import groups

    monkeypatch.setattr(groups, "MEMBERS", 100)
    flat = spark.range(2000).select(F.col("id").alias("sample_id"), F.when(F.col("id") < 1900, "a").otherwise("b").alias("grp"))
    nested = groups.nest_groups(flat)
    assert nested.agg(F.max(F.size("members"))).first()[0] < 200
    assert sorted(map(tuple, groups.flatten_groups(nested).collect())) == sorted(map(tuple, flat.collect()))


@pytest.mark.parametrize("several", [False, True])
def test_trajectories_without_a_distinct(spark, monkeypatch, several):
    """Steps cut into packs, junctions given twice, turned, within a path and of a step with itself: against plain pairs. No pair
    is made twice where samples are in one step only."""
    from quern.operators import evaluate

    monkeypatch.setattr(evaluate, "STEP_ROWS", 4)
    meta = [(i, "ab"[i % 2], i // 2 % 5) for i in range(90)] + ([(3, "a", 0), (4, "b", 4)] if several else [])
    jun = [("a", 4, "b", 0), ("b", 0, "a", 4), ("a", 4, "b", 0), ("a", 1, "a", 2), ("b", 2, "b", 2), ("a", 0, "a", 3)]
    got = evaluate.trajectory_graph(spark.createDataFrame(meta, "sample_id long, grp string, step long"), spark.createDataFrame(jun, "grp_a string, step_a long, grp_b string, step_b long"))
    want = {(min(i, j), max(i, j)) for i, g, s in meta for j, h, t in meta if (g == h and abs(s - t) <= 1 and i != j) or (g, s, h, t) in jun}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert several or "aggregate(keys=[src" not in got._jdf.queryExecution().toString().lower()
    # the two explodes are two steps: a task holds what one sample becomes, not what a pack of samples does
    steps = [x.split()[0] for x in re.findall(r"(Generate explode|Coalesce)\b", got._jdf.queryExecution().sparkPlan().toString())]
    assert "-".join(steps).count("Generate-Coalesce-Generate") == 1


@pytest.mark.parametrize("method", ["cells", "blocks"])
def test_copies_meet_as_one(spark, monkeypatch, method):
    """Queries and points that are copies meet once for each distinct vector; rows are those of all pairs, with ties by id."""
    r, met, dealt = np.random.default_rng(11), [], neighbours.dealt
    x = r.permutation(np.r_[np.tile(r.integers(0, 3, (20, 2)), (30, 1)), r.integers(0, 30, (40, 2)), [[90, 0]]]).astype(float)
    distinct = len(np.unique(x, axis=0))

    def seen(points, queries, *rest):
        met.append((points.count(), queries.count()))
        return dealt(points, queries, *rest)

    monkeypatch.setattr(neighbours, "dealt", seen)
    p = points(spark, x)
    got = [(g.query_id, g["rank"], g.point_id) for g in graph.neighbours(p, p, 7, True, method).collect()]
    assert len(got) == 7 * len(x) and set(got) == plain_knn(x, 7)
    assert met and all(a <= distinct and b <= distinct for a, b in met)
    # other queries than the points, one of them far from all
    d = np.sqrt(((x[::3, None] - x[None]) ** 2).sum(2))
    want = {(3 * i, n + 1, int(j)) for i in range(len(d)) for n, j in enumerate(np.lexsort((np.arange(len(x)), d[i]))[:45])}
    assert {(g.query_id, g["rank"], g.point_id) for g in graph.neighbours(p.where("sample_id % 3 = 0"), p, 45, method=method).collect()} == want


def test_points_are_sent_once_a_core(spark):
    """The number of tasks that a part's points go to stays where it is as queries become more."""
    assert neighbours.shares_for(spark, 1, 10**5) == neighbours.shares_for(spark, 1, 10**8) == spark.sparkContext.defaultParallelism
    assert neighbours.shares_for(spark, 3, 10**8) <= 1 + spark.sparkContext.defaultParallelism // 3


def test_no_links_between_clusters(spark):
    """Clusters without a link between them: nothing is divided by their sum, no pair is significant, no link is dropped."""
    knn = spark.createDataFrame([(i, j) for c in (0, 3) for i in range(c, c + 3) for j in range(c, c + 3)], "src long, dst long")
    groups = spark.createDataFrame([(i, i // 3) for i in range(6)], "sample_id long, grp int")
    pairs, _ = graph.build_paga(knn, groups)
    assert [(r.links, r.stat, r.significant) for r in pairs.collect()] == [(0.0, 0.0, False)] * 4
    assert graph.prune_snn(graph.shared_neighbours(knn, 3), knn, groups).count() == 18


@pytest.mark.parametrize("exp", [1.0, 0.5])
def test_twins_are_one_class(spark, exp):
    """Copies make few links: the graph of classes stands for all pairs, pruned and averaged as they are, with samples left out."""
    from quern.operators import embed

    r = np.random.default_rng(12)
    x = r.permutation(np.r_[np.tile(r.integers(0, 3, (6, 2)), (25, 1)), r.integers(0, 30, (30, 2))]).astype(float)
    knn = graph.calc_knn(points(spark, x), 6).localCheckpoint()
    groups = spark.createDataFrame([(i, i % 3 if i % 7 else None) for i in range(len(x))], "sample_id long, grp int")
    pairs = spark.createDataFrame([(a, b, 1.0 if {a, b} == {0, 1} else 0.0) for a in range(3) for b in range(3)], "c1 int, c2 int, p_adj double")
    for prune, paga in ((1 / 20, False), (0.6, False), (0.9, False), (1 / 20, True)):
        g = graph.twinned(knn, 6, prune, groups if paga else None)
        whole = graph.shared_neighbours(knn, 6, prune)
        if paga:
            g, whole = type(g)(graph.prune_with(g.links, groups, pairs), g.members), graph.prune_with(whole, groups, pairs)
        want = {(a.src, a.dst): a.weight for a in whole.collect()}
        got = g.pairs().collect()
        assert len(got) == len(want) and {(a.src, a.dst): a.weight for a in got} == want
        assert g.members.count() == len(x)
        assert prune > 0.5 or g.links.count() < len(want) / 2
        h = spark.createDataFrame([(i, [float(v) for v in r.random(3)] if i % 11 else [0.0] * 3) for i in range(len(x))], "sample_id long, h array<double>")
        a, b = ({y.sample_id: (y.x, y.y) for y in embed.embed_samples(h, 3, e, 1.25, exp, 3).samples.collect()} for e in (g, whole))
        assert a.keys() == b.keys() and all(np.allclose(a[i], b[i], atol=1e-9) for i in a)
