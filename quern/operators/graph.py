"""Nearest neighbours, shared-nearest-neighbour graphs and tests of links between clusters."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import linalg, scans, stats
from ..functions.storage import materialized
from ..model import CountMatrix, Twinned, bounded, few
from .louvain import communities
from .neighbours import Distinct, nearest, nearest_by_cells, of_distinct


def nearest_lsh(points: DataFrame, k: int, bucket: float | None = None, tables: int = 8, seed: int = 7, probe: int = 200) -> DataFrame:
    """(query_id, point_id, dist, rank): approximate neighbours among points that share a bucket of a random projection, no pass
    over all pairs. Without a bucket's length it is twice the distance that nine tenths of `probe` samples, drawn by a hash,
    have their k neighbours within. Samples that find fewer than k are looked up exactly."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    p = materialized(points.select("sample_id", F.col("v").cast("array<double>").alias("v")), "points")
    if bucket is None:
        some = p.orderBy(F.xxhash64(F.lit(seed), "sample_id"), "sample_id").limit(probe)
        far = nearest(some, p, k, same=True).where(F.col("rank") == k)
        bucket = max(2.0 * float(far.agg(F.percentile("dist", F.lit(0.9))).first()[0] or 0.5), 1e-9)
    d = p.select("sample_id", array_to_vector("v").alias("x"))
    model = BucketedRandomProjectionLSH(inputCol="x", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed).fit(d)
    pairs = model.approxSimilarityJoin(d, d, 2 * bucket, "dist").where("datasetA.sample_id != datasetB.sample_id")
    w = Window.partitionBy("query_id").orderBy("dist", "point_id")
    found = pairs.select(F.col("datasetA.sample_id").alias("query_id"), F.col("datasetB.sample_id").alias("point_id"), "dist").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    found = materialized(found, "near")
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("sample_id"))
    rest = materialized(p.join(full, "sample_id", "left_anti"), "far")
    return found.join(full.withColumnRenamed("sample_id", "query_id"), "query_id", "left_semi").unionByName(nearest(rest, p, k, same=True)) if rest.limit(1).count() else found


#: Samples up to which comparing all pairs in blocks beats building an index. The rows are the same.
BLOCKED = 20_000


def neighbours(queries: DataFrame, points: DataFrame, k: int, same: bool = False, method: str | None = None, known: Distinct | None = None) -> DataFrame:
    """(query_id, point_id, dist, rank) by "cells" (an index), "blocks" (all pairs) or "lsh" (approximate, only with `same`);
    by default blocks for few points, else cells. Written once, as graphs are read several times. `known`: the points' distinct
    vectors, if they were found before."""
    if method == "lsh" and same:
        return materialized(nearest_lsh(points, k), "near")
    if method not in (None, "cells", "blocks"):
        raise ValueError(f"unknown method {method}")

    def find(q, p, k, same):
        by = method or ("blocks" if p.limit(BLOCKED + 1).count() <= BLOCKED else "cells")
        return (nearest_by_cells if by == "cells" else nearest)(q, p, k, same)

    return materialized(of_distinct(queries, points, k, same, find, known), "near")


def calc_knn(points: DataFrame, k: int = 10, method: str | None = None, known: Distinct | None = None) -> DataFrame:
    """(src, dst): each sample itself and its k - 1 nearest others. Raises with fewer than k samples."""
    if points.limit(k).count() < k:
        raise ValueError(f"fewer than k = {k} samples")
    near = neighbours(points, points, k - 1, True, method, known)
    ids = points.select(F.col("sample_id").alias("src"), F.col("sample_id").alias("dst"))
    return near.select(F.col("query_id").alias("src"), F.col("point_id").alias("dst")).unionByName(ids)


#: Samples with one neighbour in common that travel as one row, and such rows that a task counts at once.
HUB, COUNTED = 1000, 2000


def counted(batches):
    """(src, dst, s): how often dst is in the lists of a src, over rows (src, ids) in the order of src."""
    held = None
    for b in (whole.slice(i, COUNTED) for whole in batches for i in range(0, whole.num_rows, COUNTED)):
        ids = b.column("ids")
        t = pa.table({"src": b.column("src").take(pc.list_parent_indices(ids)), "dst": ids.flatten(), "s": pa.array(np.ones(len(ids.flatten()), np.int64))})
        t = (t if held is None else pa.concat_tables([held, t])).group_by(["src", "dst"]).aggregate([("s", "sum")]).select(["src", "dst", "s_sum"]).rename_columns(["src", "dst", "s"])
        last = pc.equal(t.column("src"), b.column("src")[b.num_rows - 1])
        held = t.filter(last)
        yield t.filter(pc.invert(last))
    if held is not None:
        yield held


def shared_neighbours(nn: DataFrame, k: int, prune: float = 1 / 15) -> DataFrame:
    """(src, dst, weight): Jaccard of neighbour sets of size k for all pairs that share a neighbour; below `prune` dropped;
    the diagonal is 1. The samples that have one neighbour are packed in rows of about HUB; each of them gets, as one row a
    pack, the ids there that aren't above its own, and its task counts how often it got each. So no pair travels as a row, and
    none twice."""
    nn = materialized(nn.select("src", "dst").where("dst is not null"), "neighbours")
    hubs = nn.groupBy("dst").agg(F.count("*").alias("n")).where(F.col("n") > HUB).select("dst", F.ceil(F.col("n") / HUB).cast("int").alias("shares"))
    e = nn.join(bounded(hubs), "dst", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    packs = e.groupBy("dst", "shares", F.pmod(F.xxhash64("src"), F.col("shares")).cast("int").alias("share")).agg(F.collect_list("src").alias("ids"))
    one = packs.where("shares = 1").select("ids", F.col("ids").alias("others"))
    big = materialized(packs.where("shares > 1"), "hubs")
    met = big.select("dst", "ids", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")).join(big.select("dst", "share", F.col("ids").alias("others")), ["dst", "share"])
    sent = one.unionByName(met.select("ids", "others")).select(F.explode("ids").alias("src"), "others").select("src", F.filter("others", lambda x: x <= F.col("src")).alias("ids"))
    kind, double = dict(nn.dtypes)["src"], 2.0 * k

    def run(batches):
        for t in counted(batches):
            s, own = t.column("s").to_numpy(), pc.equal(t.column("src"), t.column("dst")).to_numpy()
            with np.errstate(divide="ignore"):
                w = np.where(own, 1.0, s / (double - s))
            keep = pa.array(own | (w >= prune))
            yield from pa.table({"src": t.column("src"), "dst": t.column("dst"), "weight": pa.array(w)}).filter(keep).to_batches()

    half = sent.repartition("src").sortWithinPartitions("src").mapInArrow(run, f"src {kind}, dst {kind}, weight double")
    both = F.when(F.col("src") == F.col("dst"), F.array(F.struct("src", "dst"))).otherwise(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return half.select(F.explode(both).alias("e"), "weight").select("e.src", "e.dst", "weight")


def twinned(nn: DataFrame, k: int, prune: float = 1 / 15, groups: DataFrame | None = None) -> Twinned:
    """shared_neighbours without a row for each pair of twins: samples of one group that are in nobody's set but their own, and
    have the same others in it. Such twins share these others with each other, and as many neighbours with any third sample; so
    they are one class, and its first sample is compared for all. Copies of one vector make such classes."""
    nn = materialized(nn.select("src", "dst").where("dst is not null"), "neighbours")
    lists = nn.groupBy("src").agg(F.sort_array(F.collect_list(F.when(F.col("src") != F.col("dst"), F.col("dst")))).alias("others"))
    cited = nn.where("src != dst").select(F.col("dst").alias("src")).distinct().withColumn("alone", F.col("src"))
    grp = F.lit(None).cast("string").alias("grp") if groups is None else "grp"
    lists = (lists if groups is None else lists.join(groups.select(F.col("sample_id").alias("src"), "grp"), "src", "left")).join(cited, "src", "left").select("src", "others", "alone", grp)
    w = Window.partitionBy(F.xxhash64("others"), "others", "grp", "alone").orderBy("src").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = F.size("others")
    weight = s / (F.lit(2.0 * k) - s)
    twin = F.when((s > 0) & (weight >= prune), weight)
    members = materialized(lists.select(F.col("src").alias("sample_id"), F.first("src").over(w).alias("cls"), twin.alias("twin")), "twins")
    first = members.where("sample_id = cls").select(F.col("cls").alias("src"))
    return Twinned(shared_neighbours(nn.join(first, "src", "left_semi"), k, prune), members)


def pruned_graph(knn: DataFrame, k: int, prune: float, paga: bool, groups: DataFrame | None, qval_cutoff: float) -> Twinned:
    """The graph of `knn`, without links between clusters that aren't linked (paga)."""
    if not paga:
        g = twinned(knn, k, prune)
        return Twinned(materialized(g.links, "snn"), g.members)
    pairs, groups = build_paga(knn, groups, qval_cutoff)
    g = twinned(knn, k, prune, groups)
    return Twinned(materialized(prune_with(g.links, groups, pairs, qval_cutoff), "snn"), g.members)


def calc_snn(points: DataFrame, k: int = 10, prune: float = 1 / 15, method: str | None = None) -> DataFrame:
    return shared_neighbours(calc_knn(points, k, method), k, prune)


def project_links(test: DataFrame, train: DataFrame, k: int = 30, k_scale: int = 10, prune: float = 1 / 15, compat: bool = False, method: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """project_snn, where test samples that are copies of others have their links: these are found for one of them. Returns the
    links of those, and (sample_id, test_id) of all test samples with the one whose links they have; None if all have their own."""
    n = train.count()
    if k * k_scale >= n - 1:
        raise ValueError("k * k_scale must be under the number of train samples less one")
    known, copies = Distinct.of(train), None if compat else Distinct.of(test)
    far = neighbours(test if compat else copies.first, train, k * k_scale, method=None if method == "lsh" else method, known=known)
    near = far.select(F.col("query_id").alias("test_id"), "point_id", F.lit(True).alias("far"), (F.col("rank") <= k - 1).alias("mine"))
    if compat:
        from .ranking import dense_index

        at = dense_index(test.select("sample_id"), "sample_id", "i").select(F.col("sample_id").alias("test_id"), "i")
        names = dense_index(train.select("sample_id"), "sample_id", "i").select(F.col("sample_id").alias("point_id"), "i")
        near = near.unionByName(at.join(names, "i").select("test_id", "point_id", F.lit(False).alias("far"), F.lit(True).alias("mine")))
    # a test sample's neighbours travel once to each of its train samples, as a list that meets the list there
    taken = lambda x: F.when(F.col(x), F.col("point_id"))
    sent = near.groupBy("test_id").agg(F.collect_list(taken("far")).alias("far"), F.collect_set(taken("mine")).alias("mine")).select("test_id", "mine", F.explode("far").alias("train_id"))
    nn = calc_knn(train, k, method, known).groupBy(F.col("src").alias("train_id")).agg(F.collect_list("dst").alias("nn"))
    met = sent.join(nn, "train_id").select("test_id", "train_id", F.size("mine").alias("a"), F.size(F.array_intersect("mine", "nn")).alias("s")).where("s > 0")
    w = F.col("s") / (F.col("a") + F.lit(float(k)) - F.col("s"))
    links = met.select("test_id", "train_id", w.alias("weight")).where(F.col("weight") > prune)
    return links, None if compat or not copies.copies else copies.rows.select("sample_id", F.col("rep").alias("test_id"))


def project_snn(test: DataFrame, train: DataFrame, k: int = 30, k_scale: int = 10, prune: float = 1 / 15, compat: bool = False, method: str | None = None) -> DataFrame:
    """(test_id, train_id, weight): Jaccard of a test sample's nearest train samples and a train sample's neighbour set, for
    the k * k_scale nearest train samples of each test sample, kept above `prune`. A test sample has k - 1 neighbours; with
    compat it also has itself, by its position among the test samples, as a train index."""
    links, copies = project_links(test, train, k, k_scale, prune, compat, method)
    return links if copies is None else links.join(copies, "test_id").select(F.col("sample_id").alias("test_id"), "train_id", "weight")


def project_snn_counts(test: CountMatrix, train: CountMatrix, n_pcs: int | None = None, k: int = 30, k_scale: int = 10, prune: float = 1 / 15, compat: bool = False, pk: linalg.Packed | None = None) -> tuple[DataFrame, DataFrame | None]:
    """project_links on the features that both matrices have, or on principal components of the train matrix. Test samples
    are scaled as the train samples are; with compat train coordinates are whitened and test coordinates aren't. `pk`: the train
    matrix by sample, if it was packed before."""
    shared = train.features.select("feature_id").intersect(test.features.select("feature_id"))
    names = sorted(r[0] for r in few(shared.distinct(), linalg.MAX_CELLS, "features"))
    a, b = pk if pk is not None and pk.features == names else linalg.packed(train, names), linalg.packed(test, names)
    if n_pcs is None:
        # read several times, so written once; rows of mostly zeros stay small in files
        return project_links(*(materialized(linalg.each(x, lambda r: r.dense(), "v"), "dense") for x in (b, a)), k, k_scale, prune, compat)
    u, d, mu = linalg.truncated_svd(a, n_pcs)
    inv = np.where(d > 0, 1 / np.maximum(d, 1e-300), 0)
    mu_b = linalg.means(b)
    v = u if compat else u * inv
    at, at_b = mu @ (u * inv), mu_b @ v
    one = materialized(linalg.each(a, lambda x: x @ (u * inv) - at, "v"), "train")
    two = materialized(linalg.each(b, lambda x: x @ v - at_b, "v"), "test")
    return project_links(two, one, k, k_scale, prune, compat)


def undirected(knn: DataFrame) -> DataFrame:
    return knn.where("src != dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def cluster_links(knn: DataFrame, groups: DataFrame) -> DataFrame:
    """(c1, c2, links) for all pairs of clusters, both ways and the diagonal (0): undirected links between members."""
    e = undirected(knn)
    g1, g2 = groups.select(F.col("sample_id").alias("src"), F.col("grp").alias("c1")), groups.select(F.col("sample_id").alias("dst"), F.col("grp").alias("c2"))
    one = e.join(g1, "src").join(g2, "dst").where("c1 != c2").groupBy("c1", "c2").agg(F.count("*").alias("links"))
    both = one.unionByName(one.select(F.col("c2").alias("c1"), F.col("c1").alias("c2"), "links")).groupBy("c1", "c2").agg(F.sum("links").alias("links"))
    both = materialized(both, "links")
    names = groups.where("grp is not null").select("grp").distinct()
    grid = names.withColumnRenamed("grp", "c1").crossJoin(names.withColumnRenamed("grp", "c2"))
    return grid.join(both, ["c1", "c2"], "left").select("c1", "c2", F.coalesce("links", F.lit(0)).cast("double").alias("links"))


def link_statistics(links: DataFrame) -> DataFrame:
    """Adds total, theta (expected share), sd and stat (share above the expected) of every pair; one row per pair. Without a
    link between any clusters the last three are null."""
    x = scans.beside(links, links.groupBy("c1").agg(F.sum("links").alias("e1")), ["c1"])
    x = scans.beside(x, links.groupBy("c2").agg(F.sum("links").alias("e2")), ["c2"])
    x = scans.beside(x, links.agg(F.sum("links").alias("total")), [])
    total = F.nullif(F.col("total"), F.lit(0.0))
    theta = F.col("e1") / total * F.col("e2") / total
    return x.withColumn("theta", theta).withColumn("sd", F.sqrt(F.col("theta") * (1 - F.col("theta")) / total)).withColumn("stat", F.col("links") / total - F.col("theta")).drop("e1", "e2")


def compute_partitions(links: DataFrame, qval_cutoff: float = 0.05) -> DataFrame:
    """(c1, c2, links, num_links, stat, p, p_adj, significant): upper normal tails, Holm over all pairs of the square, as
    scans on the cluster. num_links is stat / total."""
    x = link_statistics(links).selectExpr("c1", "c2", "links", "coalesce(stat / nullif(total, 0), stat, 0D) AS num_links", "coalesce(stat, 0D) AS stat", "if(sd > 0, sd, 1e-300D) AS sd")
    kind = links.schema["c1"].dataType.simpleString()

    def run(batches):
        for b in batches:
            stat, sd = (b.column(c).to_numpy(zero_copy_only=False) for c in ("stat", "sd"))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("c1", "c2", "links", "num_links", "stat")), pa.array(stats.normal_upper(stat, 0.0, sd), pa.float64())], names=["c1", "c2", "links", "num_links", "stat", "p"])

    tested = materialized(x.mapInArrow(run, f"c1 {kind}, c2 {kind}, links double, num_links double, stat double, p double"), "tested")
    return stats.adjusted(tested, "p", ["c1", "c2"], stats.holm).withColumn("significant", F.col("p_adj") <= qval_cutoff)


def louvain_local(graph: list[dict[int, float]], loops: list[float], seed: int = 1) -> list[int]:
    """The community of each node of a graph in memory: weights to other nodes, and inside each (from both ends)."""
    member = list(range(len(graph)))
    while graph:
        n = len(graph)
        degree = [sum(g.values()) + loops[i] for i, g in enumerate(graph)]
        total = sum(degree) or 1.0
        com, tot = list(range(n)), degree[:]
        order = np.random.default_rng(seed).permutation(n).tolist()
        moved_any = False
        for _ in range(50):
            moved = False
            for i in order:
                near: dict[int, float] = {}
                for j, w in graph[i].items():
                    near[com[j]] = near.get(com[j], 0.0) + w
                own = com[i]
                tot[own] -= degree[i]
                best, gain = own, near.get(own, 0.0) - tot[own] * degree[i] / total
                for c in sorted(near):
                    g = near[c] - tot[c] * degree[i] / total
                    if g > gain + 1e-12:
                        best, gain = c, g
                tot[best] += degree[i]
                if best != own:
                    com[i], moved, moved_any = best, True, True
            if not moved:
                break
        names = {c: k for k, c in enumerate(sorted(set(com)))}
        member = [names[com[m]] for m in member]
        if not moved_any or len(names) == n:
            break
        new: list[dict[int, float]] = [{} for _ in names]
        more = [0.0] * len(names)
        for i, g in enumerate(graph):
            a = names[com[i]]
            more[a] += loops[i]
            for j, w in g.items():
                b = names[com[j]]
                if a == b:
                    more[a] += w
                else:
                    new[a][b] = new[a].get(b, 0.0) + w
        graph, loops = new, more
    return member


def louvain(edges: DataFrame, max_nodes: int = 300_000, seed: int = 1) -> DataFrame:
    """(sample_id, grp) by modularity, for graphs of at most max_nodes nodes: local moving and contraction on the driver.
    communities() does it on the cluster, for any number."""
    rows = few(edges.where("src != dst").select("src", "dst").distinct(), 20 * max_nodes, "links for clustering on the driver: use label_propagation or give clusters")
    ids = sorted({x for r in rows for x in (r[0], r[1])})
    if len(ids) > max_nodes:
        raise ValueError(f"more than {max_nodes} samples for clustering on the driver: use label_propagation or give clusters")
    at = {v: i for i, v in enumerate(ids)}
    graph: list[dict[int, float]] = [{} for _ in ids]
    for r in rows:
        a, b = at[r[0]], at[r[1]]
        graph[a][b] = graph[a].get(b, 0.0) + 1.0
        graph[b][a] = graph[b].get(a, 0.0) + 1.0
    member = louvain_local(graph, [0.0] * len(ids), seed)
    kind = dict(edges.dtypes)["src"]
    return edges.sparkSession.createDataFrame([(v, str(member[i])) for v, i in at.items()], f"sample_id {kind}, grp string")


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(sample_id, grp): every node takes the most frequent label of its neighbours (ties: smallest), all on the cluster;
    for graphs beyond louvain's bound."""
    e = edges.where("src != dst").select("src", "dst")
    e = materialized(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "graph")
    lab = e.select(F.col("src").alias("sample_id")).distinct().withColumn("grp", F.col("sample_id").cast("string"))
    for _ in range(rounds):
        votes = e.join(lab.withColumnRenamed("sample_id", "dst"), "dst").groupBy("src", "grp").agg(F.count("*").alias("n"))
        lab = materialized(votes.groupBy("src").agg(F.min(F.struct((-F.col("n")).alias("m"), "grp")).alias("b")).select(F.col("src").alias("sample_id"), F.col("b.grp").alias("grp")), "labels")
    return lab


def build_paga(knn: DataFrame, groups: DataFrame | None = None, qval_cutoff: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(table of cluster pairs, groups). Clusters are found on the cluster if none are given; given ones are joined by sample."""
    groups = communities(knn) if groups is None else groups.where("grp is not null")
    return compute_partitions(cluster_links(knn, groups), qval_cutoff), groups


def prune_with(snn: DataFrame, groups: DataFrame, pairs: DataFrame, qval_cutoff: float = 0.05) -> DataFrame:
    """Drops links between clusters whose p_adj is above the cutoff; the diagonal is 1. Stays sparse; one cluster: no-op."""
    g1, g2 = groups.select(F.col("sample_id").alias("src"), F.col("grp").alias("c1")), groups.select(F.col("sample_id").alias("dst"), F.col("grp").alias("c2"))
    bad = bounded(pairs.where((F.col("p_adj") > qval_cutoff) & (F.col("c1") != F.col("c2"))).select("c1", "c2"))
    kept = snn.join(g1, "src", "left").join(g2, "dst", "left").join(bad, ["c1", "c2"], "left_anti")
    return kept.select("src", "dst", F.when(F.col("src") == F.col("dst"), F.lit(1.0)).otherwise(F.col("weight")).alias("weight"))


def prune_snn(snn: DataFrame, knn: DataFrame, groups: DataFrame | None = None, qval_cutoff: float = 0.05) -> DataFrame:
    pairs, groups = build_paga(knn, groups, qval_cutoff)
    return prune_with(snn, groups, pairs, qval_cutoff)


def centroids(coords: DataFrame, groups: DataFrame, median: bool = False) -> DataFrame:
    """(grp, pos, value) of array coordinates: mean or median of each position over a group's samples."""
    long = coords.join(groups.where("grp is not null"), "sample_id").select("grp", F.posexplode(F.col("v").cast("array<double>")).alias("pos", "value"))
    return scans.percentiles(long, ["grp", "pos"], "value", {"value": 0.5}) if median else long.groupBy("grp", "pos").agg(F.avg("value").alias("value"))


def centroid_cosine(coords: DataFrame, groups: DataFrame) -> DataFrame:
    """(c1, c2, sim) of all pairs c1 < c2: cosine of cluster centroids."""
    c = centroids(coords, groups)
    norm = c.groupBy("grp").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    a = c.join(norm, "grp").select(F.col("grp").alias("c1"), "pos", F.col("value").alias("x"), F.col("norm").alias("nx"))
    b = c.join(norm, "grp").select(F.col("grp").alias("c2"), "pos", F.col("value").alias("y"), F.col("norm").alias("ny"))
    return a.join(b, "pos").where("c1 < c2").groupBy("c1", "c2").agg((F.sum(F.col("x") * F.col("y")) / F.first("nx") / F.first("ny")).alias("sim"))


def partition_similarity_graph(pairs: DataFrame, coords: DataFrame, groups: DataFrame, qval_cutoff: float = 1e-3, min_sim: float = 0.05, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(edges c1, c2, sim; layout grp, x, y): similar clusters that are linked significantly, laid out by springs."""
    sig = pairs.where((F.col("p_adj") <= qval_cutoff) & (F.col("c1") < F.col("c2"))).select("c1", "c2")
    edges = materialized(centroid_cosine(coords, groups).where(F.col("sim") >= min_sim).join(sig, ["c1", "c2"], "left_semi"), "similar")
    names = sorted(r[0] for r in few(groups.where("grp is not null").select("grp").distinct(), 2000, "groups to lay out"))
    at = {v: i for i, v in enumerate(names)}
    n = len(names)
    w = np.zeros((n, n))
    for r in edges.collect():
        w[at[r.c1], at[r.c2]] = w[at[r.c2], at[r.c1]] = r.sim
    xy = force_layout(w, seed)
    kind = dict(groups.dtypes)["grp"]
    return edges, edges.sparkSession.createDataFrame([(v, float(xy[i, 0]), float(xy[i, 1])) for v, i in at.items()], f"grp {kind}, x double, y double")


def force_layout(w: np.ndarray, seed: int = 42, rounds: int = 300) -> np.ndarray:
    """Fruchterman-Reingold: attraction along weights, repulsion of all, falling steps."""
    n = len(w)
    xy = np.random.default_rng(seed).normal(size=(n, 2))
    k = math.sqrt(1.0 / max(n, 1))
    for t in range(rounds):
        d = xy[:, None] - xy[None]
        dist = np.maximum(np.sqrt((d * d).sum(axis=2)), 1e-9)
        force = (d / dist[..., None] * (k * k / dist - w * dist * dist / k)[..., None]).sum(axis=1)
        size = np.maximum(np.sqrt((force * force).sum(axis=1)), 1e-12)
        xy = xy + force / size[:, None] * np.minimum(size, 0.1 * (1 - t / rounds))[:, None]
    return xy
