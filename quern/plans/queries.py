"""The engine's queries over the driver's tables, with equivalent SQL where SQL expresses them.

Counts are lineitem quantities: samples are customers, features are brand|type of parts. Factor scores without a fit are
quantities by part type. Computed doubles are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import linalg, stats
from ..functions.storage import folder, materialized
from ..model import CountMatrix, Embedding
from ..operators import annotate, embed, evaluate, factorize, filtering, graph, groups, louvain, normalize, plotdata
from ..operators.ranking import dense_index
from ..sources import text
from . import pipeline

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---------------------------------------------------------------- inputs
TYPES = "SELECT p_type, row_number() OVER (ORDER BY p_type) AS i FROM (SELECT DISTINCT p_type FROM part)"
COUNTS = """e AS (SELECT p_brand || '|' || p_type AS feature_id, o_custkey AS sample_id, sum(l_quantity) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
 f AS (SELECT DISTINCT p_brand || '|' || p_type AS feature_id FROM part),
 s AS (SELECT c_custkey AS sample_id, c_mktsegment AS batch FROM customer)"""
NN = """p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
 d AS (SELECT a.vec_id AS src, b.vec_id AS dst, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS dist FROM p a JOIN p b ON a.vec_id != b.vec_id),
 r AS (SELECT src, dst, dist, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rn FROM d)"""
KNN = NN + ", nn AS (SELECT src, dst FROM r WHERE rn <= 9 UNION ALL SELECT vec_id, vec_id FROM p)"
SNN = KNN + """, snn AS (SELECT * FROM (SELECT a.src, b.src AS dst, CASE WHEN a.src = b.src THEN 1.0 ELSE count(*) / (20.0 - count(*)) END AS weight
   FROM nn a JOIN nn b ON a.dst = b.dst GROUP BY a.src, b.src) WHERE weight >= 1.0 / 15 OR src = dst)"""
#: Coordinates of six factors, in the order of part types.
XY = ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.5, 0.2), (0.3, 0.8))
XYSQL = "xy AS (SELECT * FROM (VALUES " + ", ".join(f"({i + 1}, CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))" for i, (x, y) in enumerate(XY)) + ") t(i, x, y))"
SCORES = f"""t AS ({TYPES}), ids AS (SELECT DISTINCT o_custkey AS sample_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
 q AS (SELECT o_custkey AS sample_id, p_type, sum(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
 h AS (SELECT ids.sample_id, t.i, coalesce(q.v, 0.0) AS v FROM ids CROSS JOIN t LEFT JOIN q ON q.sample_id = ids.sample_id AND q.p_type = t.p_type)"""
FEATURES = f"""t AS ({TYPES}), ids AS (SELECT DISTINCT p_brand AS feature_id FROM part),
 q AS (SELECT p_brand AS feature_id, p_type, sum(l_quantity) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
 h AS (SELECT ids.feature_id, t.i, coalesce(q.v, 0.0) AS v FROM ids CROSS JOIN t LEFT JOIN q ON q.feature_id = ids.feature_id AND q.p_type = t.p_type)"""


def counts(spark, d) -> CountMatrix:
    l, o, p = (table(spark, d, x) for x in ("lineitem", "orders", "part"))
    name = F.concat_ws("|", "p_brand", "p_type")
    e = l.select("l_orderkey", "l_partkey", "l_quantity").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(p.select("p_partkey", name.alias("feature_id")), F.col("l_partkey") == F.col("p_partkey"))
    e = e.groupBy("feature_id", F.col("o_custkey").alias("sample_id")).agg(F.sum("l_quantity").alias("value"))
    # operators pass over a matrix several times: the joins and the aggregate are done once
    return CountMatrix(materialized(e, "counts"), p.select(name.alias("feature_id")).distinct(), table(spark, d, "customer").select(F.col("c_custkey").alias("sample_id")))


def held(m: CountMatrix) -> CountMatrix:
    return CountMatrix(materialized(m.entries, "entries"), materialized(m.features, "features"), materialized(m.samples, "samples"))


def batches(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_mktsegment").alias("batch"))


def as_groups(df):
    return df.select("sample_id", F.col("batch").alias("grp"))


def _scores(spark, d, by: str, out: str) -> tuple[DataFrame, int]:
    p = table(spark, d, "part")
    types = [r[0] for r in p.select("p_type").distinct().orderBy("p_type").collect()]
    j = table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    if by == "o_custkey":
        j = j.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    sums = j.groupBy(F.col(by).alias(out)).agg(*(F.coalesce(F.sum(F.when(F.col("p_type") == t, F.col("l_quantity"))), F.lit(0.0)).alias(f"c{i}") for i, t in enumerate(types)))
    return sums.select(out, F.array(*(F.col(f"c{i}") for i in range(len(types)))).alias("h")), len(types)


def scores(spark, d):
    return _scores(spark, d, "o_custkey", "sample_id")


def brands(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("feature_id")).distinct()
    s, k = _scores(spark, d, "p_brand", "feature_id")
    return p.join(s, "feature_id", "left").select("feature_id", F.coalesce("h", F.array(*(F.lit(0.0) for _ in range(k)))).alias("a")), k


def factor_xy(spark):
    return spark.createDataFrame([(f"factor_{i + 1}", i + 1, x, y, f"factor_{i + 1}") for i, (x, y) in enumerate(XY)], "factor string, factor_idx int, x double, y double, name string")


def points(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("embedding").cast("array<double>").alias("v"))


def labels(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("label").alias("grp"))


def genesets(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("geneset"), F.concat_ws("|", "p_brand", "p_type").alias("m")).distinct()
    return p.groupBy("geneset").agg(F.sort_array(F.collect_list("m")).alias("members"))


def rounded(df: DataFrame, n: int, *cols: str) -> DataFrame:
    """Rounded, without negative zeros."""
    return df.withColumns({c: F.round(c, n) + F.lit(0.0) for c in cols})


# ---------------------------------------------------------------- names, filters, clipping
@query("SELECT p_partkey, split_part(p_brand, '#', 2) AS number, split_part(p_type, ' ', 1) AS first FROM part")
def extract_field(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.coalesce(text.extract_field(F.col("p_brand"), 2, "#"), F.lit("")).alias("number"), text.extract_field(F.col("p_type"), 1, " ").alias("first"))


@query(r"""WITH n AS (SELECT c_custkey, regexp_replace(c_name, '[^\p{L}\p{N}._]', '.', 'g') AS t FROM customer)
SELECT c_custkey, CASE WHEN regexp_matches(t, '^[A-Za-z]') THEN t ELSE 'X' || t END AS name FROM n""")
def make_names(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.make_names(F.col("c_name")).alias("name"))


@query("""SELECT 'c' || o_custkey AS sample_id, p_brand AS feature_id, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND p_size % 2 = 0 GROUP BY 1, 2""")
def species_filter(spark, d):
    """Customers of one segment are samples of one species, parts of even size its features."""
    p = table(spark, d, "part").select("p_partkey", F.concat(F.when(F.col("p_size") % 2 == 0, "hg19_").otherwise("mm10_"), F.col("p_brand")).alias("feature_id"))
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    e = j.groupBy("feature_id", F.concat(F.lit("c"), F.col("o_custkey")).alias("sample_id")).agg(F.sum("l_quantity").alias("value"))
    c = table(spark, d, "customer")
    m = CountMatrix(e, p.select("feature_id").distinct(), c.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("sample_id")))
    calls = c.select(F.concat(F.lit("c"), F.col("c_custkey"), F.lit("-1")).alias("barcode"), F.when(F.col("c_mktsegment") == "BUILDING", "hg19").otherwise("mm10").alias("call"))
    return text.filter_species(m, calls).entries


FILTER = f"""WITH {COUNTS}, ps AS (SELECT sample_id FROM e GROUP BY 1 HAVING sum(value) < 5000 AND count(CASE WHEN value > 0 THEN 1 END) > 20),
 e2 AS (SELECT e.* FROM e SEMI JOIN ps ON e.sample_id = ps.sample_id),
 pf AS (SELECT feature_id FROM e2 GROUP BY 1 HAVING count(CASE WHEN value > 0 THEN 1 END) > (SELECT round_even(count(*) * 0.1, 0) FROM s)),
 e3 AS (SELECT e2.* FROM e2 SEMI JOIN pf ON e2.feature_id = pf.feature_id)"""
WINS = """r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY value DESC, feature_id) AS rn, count(*) OVER (PARTITION BY sample_id) AS n FROM {0}),
 cap AS (SELECT sample_id, value AS cap FROM r WHERE rn = 4 AND n > 4)
SELECT r.feature_id, r.sample_id, least(r.value, coalesce(cap.cap, r.value)) AS value FROM r LEFT JOIN cap ON r.sample_id = cap.sample_id"""


@query(f"{FILTER}, {WINS.format('e3')}")
def filter_data(spark, d):
    return filtering.filter_data(counts(spark, d), 0.1, 3, 20, 5000).entries


@query(f"WITH {COUNTS}, {WINS.format('e')}")
def winsorize(spark, d):
    return filtering.winsorize(counts(spark, d).entries, 3)


# ---------------------------------------------------------------- normalisation
DEPTH = "dp AS (SELECT sample_id, sum(value) AS depth FROM e GROUP BY 1), md AS (SELECT quantile_cont(depth, 0.5) AS m FROM dp)"


@query(f"WITH {COUNTS}, {DEPTH} SELECT feature_id, e.sample_id, round(value / (depth / 1000.0), 6) AS value FROM e JOIN dp ON e.sample_id = dp.sample_id")
def normalize_counts(spark, d):
    return rounded(normalize.normalize_counts(counts(spark, d)).entries, 6, "value")


@query(f"""WITH {COUNTS}, {DEPTH}, b AS (SELECT e.*, s.batch, dp.depth FROM e JOIN s ON e.sample_id = s.sample_id JOIN dp ON e.sample_id = dp.sample_id),
 n AS (SELECT count(DISTINCT batch) AS n FROM s), t AS (SELECT sum(value) AS t FROM e),
 sh AS (SELECT feature_id, (sum(value) + any_value(n.n)) / (any_value(t.t) + any_value(n.n)) AS share FROM e, n, t GROUP BY 1),
 fb AS (SELECT feature_id, batch, sum(value) AS t FROM b GROUP BY 1, 2), db AS (SELECT batch, sum(value) AS d FROM b GROUP BY 1),
 bc AS (SELECT fb.feature_id, fb.batch, exp(ln(fb.t + 1) - ln(db.d + 1) - ln(sh.share)) AS bc FROM fb JOIN db ON fb.batch = db.batch JOIN sh ON fb.feature_id = sh.feature_id)
SELECT b.feature_id, b.sample_id, round(value / bc.bc / (depth / 1000.0), 4) AS value FROM b JOIN bc ON b.feature_id = bc.feature_id AND b.batch = bc.batch""")
def normalize_counts_batch(spark, d):
    return rounded(normalize.normalize_counts(counts(spark, d), 1e3, batches(spark, d)).entries, 4, "value")


@query(f"WITH {COUNTS} SELECT feature_id, batch AS grp, sum(value) AS total FROM e LEFT JOIN s ON e.sample_id = s.sample_id GROUP BY 1, 2")
def col_sum_by_fac(spark, d):
    return normalize.col_sum_by_group(counts(spark, d).entries, as_groups(batches(spark, d)))


MEANVAR = f"""{COUNTS}, n AS (SELECT count(*) AS n FROM s), m1 AS (SELECT feature_id, sum(value) / any_value(n.n) AS m, count(*) AS nobs, any_value(n.n) AS n FROM e, n GROUP BY 1),
 mv AS (SELECT f.feature_id, coalesce(any_value(m1.m), 0) AS m, coalesce((sum((e.value - m1.m) * (e.value - m1.m)) + any_value(m1.m * m1.m * (m1.n - m1.nobs))) / any_value(m1.n), 0) AS v, coalesce(any_value(m1.nobs), 0) AS nobs
  FROM f LEFT JOIN m1 ON f.feature_id = m1.feature_id LEFT JOIN e ON e.feature_id = m1.feature_id GROUP BY 1)"""


@query(f"WITH {MEANVAR} SELECT feature_id, round(m, 6) AS m, round(v, 6) AS v, nobs FROM mv")
def col_mean_var(spark, d):
    return rounded(normalize.col_mean_var(counts(spark, d)), 6, "m", "v")


@query(f"WITH {MEANVAR} SELECT round(regr_slope(ln(v), ln(m)), 6) AS slope, round(regr_intercept(ln(v), ln(m)), 6) AS intercept FROM mv WHERE v > 0")
def variance_ols_fit(spark, d):
    v = normalize.col_mean_var(counts(spark, d)).where("v > 0")
    return v.agg(F.round(F.regr_slope(F.log("v"), F.log("m")), 6).alias("slope"), F.round(F.regr_intercept(F.log("v"), F.log("m")), 6).alias("intercept"))


PVALS = "p AS (SELECT p_brand || '|' || p_type AS k, (min(p_partkey) * 7919 % 1000 + 1) / 1001.0 AS p FROM part GROUP BY 1), r AS (SELECT k, p, row_number() OVER (ORDER BY p, k) AS r, count(*) OVER () AS m FROM p)"


def _pvals(spark, d):
    return table(spark, d, "part").groupBy(F.concat_ws("|", "p_brand", "p_type").alias("k")).agg(((F.min("p_partkey") * 7919 % 1000 + 1) / F.lit(1001.0)).alias("p"))


@query(f"WITH {PVALS} SELECT k, round(least(1.0, min(p * m / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 6) AS p_adj FROM r")
def bh_adjust(spark, d):
    return rounded(stats.adjusted(_pvals(spark, d), "p", ["k"], stats.bh), 6, "p_adj").select("k", "p_adj")


@query(f"WITH {PVALS} SELECT k, round(least(1.0, max((m - r + 1) * p) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING)), 6) AS p_adj FROM r")
def holm_adjust(spark, d):
    return rounded(stats.adjusted(_pvals(spark, d), "p", ["k"], stats.holm), 6, "p_adj").select("k", "p_adj")


NORM = f"{COUNTS}, {DEPTH}, nm AS (SELECT feature_id, e.sample_id, value / (depth / md.m) AS v FROM e JOIN dp ON e.sample_id = dp.sample_id, md)"


@query(f"WITH {NORM} SELECT feature_id, sample_id, round(ln(v + 1), 6) AS value FROM nm")
def scale_log(spark, d):
    return rounded(normalize.scale_counts(counts(spark, d), adj_var=False).entries, 6, "value")


@query(f"WITH {NORM} SELECT feature_id, sample_id, round(sqrt(v) + sqrt(v + 1), 6) AS value FROM nm")
def scale_ft(spark, d):
    return rounded(normalize.scale_counts(counts(spark, d), method="ft", adj_var=False).entries, 6, "value")


@query(f"""WITH {NORM}, x AS (SELECT feature_id, sample_id, round(v, 9) AS v FROM nm), mid AS (SELECT quantile_cont(c, 0.5) AS m FROM (SELECT count(*) AS c FROM e GROUP BY sample_id)), np AS (SELECT count(*) AS p FROM f)
SELECT feature_id, sample_id, round((rank() OVER (PARTITION BY sample_id ORDER BY v) + (count(*) OVER (PARTITION BY sample_id, v) - 1) / 2.0) / np.p * mid.m, 6) AS value FROM x, mid, np""")
def scale_logrank(spark, d):
    m = counts(spark, d)
    n = normalize.normalize_counts(m, normalize.median_depth(m))
    return rounded(normalize.log_rank(n.with_entries(rounded(n.entries, 9, "value")), m), 6, "value")


def _vector(method, sql):
    def f(spark, d):
        c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
        return rounded(normalize.normalize_vector(c, "c_acctbal", method), 6, "value").select("c_custkey", "value")

    f.__name__ = f"normalize_vector_{method}"
    query(sql)(f)


_vector("scale", "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER (), 6) AS value FROM customer")
_vector("rank", "SELECT c_custkey, round((rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0) / count(*) OVER () * 10000, 6) AS value FROM customer")
_vector("bounded", "SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS value FROM customer")


@query(f"WITH {COUNTS}, r AS (SELECT feature_id, min(value) AS lo, max(value) AS hi FROM e GROUP BY 1) SELECT e.feature_id, sample_id, CASE WHEN hi = lo THEN 'NaN'::DOUBLE ELSE round((value - lo) / (hi - lo), 6) END AS value FROM e JOIN r ON e.feature_id = r.feature_id")
def minmax_integrated(spark, d):
    return rounded(normalize.extract_norm_counts(counts(spark, d), "integrated").entries, 6, "value")


@query()
def select_features_gam(spark, d):
    return rounded(normalize.select_features(counts(spark, d), n_features=50), 6, "lp")


@query(f"WITH {NORM}, mv AS (SELECT f.feature_id, sum(v) / (SELECT count(*) FROM s) AS m, sum(v * v) / (SELECT count(*) FROM s) AS q FROM f JOIN nm ON nm.feature_id = f.feature_id GROUP BY 1), l AS (SELECT ln(m) AS m, ln(q - m * m) AS v FROM mv WHERE q - m * m > 0) SELECT count(*) AS n, round(sum(v), 5) AS total, 0.0 AS res_sum, 0.0 AS res_line FROM l")
def variance_spline_moments(spark, d):
    """Of a spline with a free line, residuals add up to nothing, also times the mean; with the trend they are the variances."""
    m = counts(spark, d)
    v = normalize.adjust_variance(normalize.normalize_counts(m, normalize.median_depth(m))).where("res > double('-infinity')")
    return v.agg(F.count("*").alias("n"), F.round(F.sum("v"), 5).alias("total"), (F.round(F.sum("res"), 5) + 0.0).alias("res_sum"), (F.round(F.sum(F.col("res") * F.col("m")), 4) + 0.0).alias("res_line"))


@query()
def adjust_variance(spark, d):
    return normalize.adjust_variance(counts(spark, d))


# ---------------------------------------------------------------- graphs
@query(f"WITH {KNN} SELECT src, dst FROM nn")
def calc_knn(spark, d):
    return graph.calc_knn(points(spark, d), 10, "cells")


@query(f"WITH {KNN} SELECT src, dst FROM nn")
def calc_knn_blocks(spark, d):
    return graph.calc_knn(points(spark, d), 10, "blocks")


@query(f"WITH {SNN} SELECT src, dst, round(weight, 6) AS weight FROM snn")
def calc_snn(spark, d):
    return rounded(graph.calc_snn(points(spark, d), 10), 6, "weight")


@query(f"""WITH p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
 d AS (SELECT a.vec_id AS src, b.vec_id AS dst, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS dist FROM p a JOIN p b ON a.vec_id != b.vec_id AND b.vec_id % 5 != 0),
 r AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rn FROM d),
 tr AS (SELECT src, dst FROM r WHERE src % 5 != 0 AND rn <= 9 UNION ALL SELECT vec_id, vec_id FROM p WHERE vec_id % 5 != 0),
 te AS (SELECT src, dst FROM r WHERE src % 5 = 0 AND rn <= 9), far AS (SELECT src, dst FROM r WHERE src % 5 = 0 AND rn <= 100),
 x AS (SELECT far.src AS test_id, far.dst AS train_id, count(*) AS s FROM far JOIN te ON te.src = far.src JOIN tr ON tr.src = far.dst AND tr.dst = te.dst GROUP BY 1, 2)
SELECT test_id, train_id, round(s / (19.0 - s), 6) AS weight FROM x WHERE s / (19.0 - s) > 1.0 / 15""")
def project_snn(spark, d):
    p = points(spark, d)
    return rounded(graph.project_snn(p.where("sample_id % 5 = 0"), p.where("sample_id % 5 != 0"), 10, 10), 6, "weight")


LINKS = f"""{KNN}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM nn WHERE src != dst),
 c AS (SELECT x.label AS c1, y.label AS c2, count(*) AS n FROM u JOIN p x ON u.a = x.vec_id JOIN p y ON u.b = y.vec_id WHERE x.label != y.label GROUP BY 1, 2),
 bo AS (SELECT c1, c2, sum(n) AS n FROM (SELECT c1, c2, n FROM c UNION ALL SELECT c2, c1, n FROM c) GROUP BY 1, 2), g AS (SELECT DISTINCT label FROM p),
 lk AS (SELECT a.label AS c1, b.label AS c2, CAST(coalesce(bo.n, 0) AS DOUBLE) AS links FROM g a CROSS JOIN g b LEFT JOIN bo ON bo.c1 = a.label AND bo.c2 = b.label),
 st AS (SELECT c1, c2, links, sum(links) OVER (PARTITION BY c1) AS e1, sum(links) OVER (PARTITION BY c2) AS e2, sum(links) OVER () AS t FROM lk)"""


@query(f"WITH {LINKS} SELECT c1, c2, links, round(links / t - e1 / t * e2 / t, 8) AS stat FROM st")
def paga_links(spark, d):
    return rounded(graph.link_statistics(graph.cluster_links(graph.calc_knn(points(spark, d), 10), labels(spark, d))), 8, "stat").select("c1", "c2", "links", "stat")


@query(f"""WITH {SNN}, pr AS (SELECT DISTINCT a.label AS c1, b.label AS c2 FROM p a CROSS JOIN p b WHERE (a.label * b.label) % 3 = 1 AND a.label != b.label)
SELECT snn.src, snn.dst, round(CASE WHEN snn.src = snn.dst THEN 1.0 ELSE weight END, 6) AS weight FROM snn JOIN p x ON snn.src = x.vec_id JOIN p y ON snn.dst = y.vec_id
WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.c1 = x.label AND pr.c2 = y.label)""")
def prune_snn_given_p(spark, d):
    g = labels(spark, d)
    names = g.select("grp").distinct()
    pairs = names.withColumnRenamed("grp", "c1").crossJoin(names.withColumnRenamed("grp", "c2")).withColumn("p_adj", F.when((F.col("c1") * F.col("c2")) % 3 == 1, 1.0).otherwise(0.0))
    return rounded(graph.prune_with(graph.calc_snn(points(spark, d), 10), g, pairs), 6, "weight")


CENT = """p AS (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
 c AS (SELECT label AS grp, pos, avg(v) AS value FROM p GROUP BY 1, 2)"""


@query(f"""WITH {CENT}, n AS (SELECT grp, sqrt(sum(value * value)) AS n FROM c GROUP BY 1)
SELECT a.grp AS c1, b.grp AS c2, round(sum(a.value * b.value) / any_value(x.n) / any_value(y.n), 6) AS sim FROM c a JOIN c b ON a.pos = b.pos AND a.grp < b.grp JOIN n x ON x.grp = a.grp JOIN n y ON y.grp = b.grp GROUP BY 1, 2""")
def partition_similarity(spark, d):
    return rounded(graph.centroid_cosine(points(spark, d), labels(spark, d)), 6, "sim")


#: P(N(0, 1) > z) by the series of the error function, all of whose terms are positive; beyond 6 it is 0 to 8 digits.
def upper_tail(z: str) -> str:
    series = f"exp(-({z}) * ({z}) / 2) * list_sum(list_transform(range(0, 100), lambda n: pow(abs({z}) / sqrt(2.0), 2 * n + 1) / gamma(n + 1.5)))"
    return f"CASE WHEN {z} > 6 THEN 0.0 WHEN {z} < -6 THEN 1.0 WHEN {z} >= 0 THEN 0.5 * (1 - {series}) ELSE 0.5 * (1 + {series}) END"


PAGA = f"""{LINKS}, zz AS (SELECT c1, c2, links, t, links / t - e1 / t * e2 / t AS stat, (links / t - e1 / t * e2 / t) / sqrt(e1 / t * e2 / t * (1 - e1 / t * e2 / t) / t) AS z FROM st),
 pp AS (SELECT *, {upper_tail("z")} AS pv FROM zz), rr AS (SELECT *, row_number() OVER (ORDER BY pv, c1, c2) AS r, count(*) OVER () AS m FROM pp),
 pa AS (SELECT c1, c2, links, stat, t, pv, least(1.0, max((m - r + 1) * pv) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING)) AS p_adj FROM rr)"""


@query(f"WITH {PAGA} SELECT c1, c2, links, round(stat / t, 10) AS num_links, round(stat, 8) AS stat, round(pv, 7) AS p, round(p_adj, 6) AS p_adj, p_adj <= 0.05 AS significant FROM pa")
def build_paga(spark, d):
    """Clusters are given, so every number is exact."""
    pairs, _ = graph.build_paga(graph.calc_knn(points(spark, d), 10), labels(spark, d))
    return rounded(rounded(rounded(rounded(pairs, 10, "num_links"), 8, "stat"), 7, "p"), 6, "p_adj")


@query(f"""WITH {SNN}, x AS (WITH {PAGA.replace(KNN + ",", NN + ", nn AS (SELECT src, dst FROM r WHERE rn <= 9 UNION ALL SELECT vec_id, vec_id FROM p),", 1)} SELECT c1, c2 FROM pa WHERE p_adj > 0.05 AND c1 != c2)
SELECT snn.src, snn.dst, round(CASE WHEN snn.src = snn.dst THEN 1.0 ELSE weight END, 6) AS weight FROM snn JOIN p a ON snn.src = a.vec_id JOIN p b ON snn.dst = b.vec_id WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.c1 = a.label AND x.c2 = b.label)""")
def prune_snn(spark, d):
    p = points(spark, d)
    knn = materialized(graph.calc_knn(p, 10), "knn")
    return rounded(graph.prune_snn(graph.shared_neighbours(knn, 10), knn, labels(spark, d)), 6, "weight")


@query(f"""WITH {PAGA}, pt AS (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings), ct AS (SELECT label AS grp, pos, avg(v) AS value FROM pt GROUP BY 1, 2), nm AS (SELECT grp, sqrt(sum(value * value)) AS n FROM ct GROUP BY 1),
 sm AS (SELECT a.grp AS c1, b.grp AS c2, sum(a.value * b.value) / any_value(x.n) / any_value(y.n) AS sim FROM ct a JOIN ct b ON a.pos = b.pos AND a.grp < b.grp JOIN nm x ON x.grp = a.grp JOIN nm y ON y.grp = b.grp GROUP BY 1, 2)
SELECT sm.c1, sm.c2, round(sim, 6) AS sim FROM sm JOIN pa ON pa.c1 = sm.c1 AND pa.c2 = sm.c2 WHERE pa.p_adj <= 0.9999 AND sim >= -0.05""")
def partition_edges(spark, d):
    p, g = points(spark, d), labels(spark, d)
    pairs, _ = graph.build_paga(graph.calc_knn(p, 10), g)
    return rounded(graph.partition_similarity_graph(pairs, p, g, 0.9999, -0.05)[0], 6, "sim")


@query("SELECT c_custkey AS sample_id, CAST(min(c_custkey) OVER (PARTITION BY c_nationkey) AS BIGINT) AS first_member FROM customer QUALIFY count(*) OVER (PARTITION BY c_nationkey) > 1")
def louvain_stars(spark, d):
    """Customers linked to the first of their nation: the best communities are the nations."""
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("src"), "c_nationkey")
    hub = s.groupBy("c_nationkey").agg(F.min("src").alias("dst"))
    g = graph.communities(s.join(hub, "c_nationkey").select("src", "dst"))
    first = g.groupBy("grp").agg(F.min("sample_id").cast("long").alias("first_member"))
    return g.join(first, "grp").select("sample_id", "first_member")


@query(f"""WITH {KNN}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM nn WHERE src != dst), e AS (SELECT a, b FROM u UNION ALL SELECT b, a FROM u),
 c AS (SELECT x.label AS c1, count(*) AS tot, count(*) FILTER (x.label = y.label) AS inside FROM e JOIN p x ON e.a = x.vec_id JOIN p y ON e.b = y.vec_id GROUP BY 1), t AS (SELECT sum(tot) AS m FROM c)
SELECT round(sum(inside / m - (tot / m) * (tot / m)), 8) AS modularity FROM c, t""")
def modularity(spark, d):
    q = louvain.modularity(graph.calc_knn(points(spark, d), 10), labels(spark, d))
    return spark.createDataFrame([(round(q, 8),)], "modularity double")


@query()
def build_paga_louvain(spark, d):
    pairs, _ = graph.build_paga(materialized(graph.calc_knn(points(spark, d), 10), "knn"))
    return pairs


@query()
def partition_layout(spark, d):
    p, g = points(spark, d), labels(spark, d)
    pairs = graph.compute_partitions(graph.cluster_links(graph.calc_knn(p, 10), g))
    return graph.partition_similarity_graph(pairs, p, g, 0.9999, -0.05)[1]


# ---------------------------------------------------------------- embedding
def _distance(kind, expr):
    def f(spark, d):
        h, k = scores(spark, d)
        return rounded(embed.factor_distance_table(h, k, kind), 6, "dist")

    f.__name__ = f"factor_distance_{kind}"
    query(f"""WITH {SCORES}, x AS (SELECT a.i AS f1, b.i AS f2, count(*) AS n, sum(a.v * b.v) AS g, sum(a.v) AS sa, sum(b.v) AS sb, sum(a.v * a.v) AS qa, sum(b.v * b.v) AS qb FROM h a JOIN h b ON a.sample_id = b.sample_id AND a.i < b.i GROUP BY 1, 2)
SELECT CAST(f1 AS INTEGER) AS f1, CAST(f2 AS INTEGER) AS f2, round({expr}, 6) AS dist FROM x""")(f)


_distance("cosine", "1 - g / sqrt(qa * qb)")
_distance("pearson", "sqrt(greatest(0, 2 * (1 - (g - sa * sb / n) / sqrt((qa - sa * sa / n) * (qb - sb * sb / n)))))")
_distance("euclidean", "sqrt(greatest(0, qa + qb - 2 * g))")

COORDS = f"""{SCORES}, {XYSQL}, rk AS (SELECT sample_id, i, v, row_number() OVER (PARTITION BY sample_id ORDER BY v DESC, i) AS rn FROM h),
 co AS (SELECT sample_id, sum(x * pow(v, 1.25)) / nullif(sum(pow(v, 1.25)), 0) AS x, sum(y * pow(v, 1.25)) / nullif(sum(pow(v, 1.25)), 0) AS y FROM rk JOIN xy ON rk.i = xy.i WHERE rn <= 3 GROUP BY 1)"""


@query(f"WITH {COORDS} SELECT sample_id, round(x, 6) AS x, round(y, 6) AS y FROM co")
def sample_coords(spark, d):
    h, _ = scores(spark, d)
    return rounded(embed.pulled(h, factor_xy(spark), "sample_id", "h", 1.25, 3), 6, "x", "y")


VXY = "cv AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"


def _vec_xy(spark, d):
    return points(spark, d).select("sample_id", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))


@query(f"WITH {SNN}, {VXY} SELECT src AS sample_id, round(sum(pow(weight, 0.5) * x) / sum(pow(weight, 0.5)), 6) AS x, round(sum(pow(weight, 0.5) * y) / sum(pow(weight, 0.5)), 6) AS y FROM snn JOIN cv ON snn.dst = cv.vec_id GROUP BY 1")
def snn_smooth(spark, d):
    return rounded(embed.smoothed(_vec_xy(spark, d), graph.calc_snn(points(spark, d), 10), 0.5), 6, "x", "y")


@query(f"""WITH {FEATURES}, {XYSQL}, mm AS (SELECT feature_id, min(v) AS lo, max(v) AS hi FROM h GROUP BY 1),
 sc AS (SELECT h.feature_id, i, CASE WHEN hi = lo THEN 1.0 ELSE (v - lo) / (hi - lo) END AS v FROM h JOIN mm ON h.feature_id = mm.feature_id),
 rk AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY v DESC, i) AS rn FROM sc)
SELECT feature_id, round(sum(x * v) / nullif(sum(v), 0), 6) AS x, round(sum(y * v) / nullif(sum(v), 0), 6) AS y FROM rk JOIN xy ON rk.i = xy.i WHERE rn <= 3 GROUP BY 1""")
def embed_features(spark, d):
    a, _ = brands(spark, d)
    e = embed.embed_features(Embedding(factor_xy(spark), _vec_xy(spark, d)), a, n_pull=3)
    return rounded(e.features, 6, "x", "y")


@query(f"""WITH {SNN}, {VXY}, {XYSQL}, hh AS (SELECT vec_id, abs(v[1]) + 0.1 AS a, abs(v[2]) + 0.1 AS b, abs(v[3]) + 0.1 AS c FROM p),
 own AS (SELECT vec_id, (SELECT sum(CASE i WHEN 1 THEN a WHEN 2 THEN b ELSE c END * x) FROM xy WHERE i <= 3) / (a + b + c) AS x, (SELECT sum(CASE i WHEN 1 THEN a WHEN 2 THEN b ELSE c END * y) FROM xy WHERE i <= 3) / (a + b + c) AS y FROM hh WHERE vec_id % 5 = 0),
 ed AS (SELECT src, weight, x, y FROM snn JOIN cv ON snn.dst = cv.vec_id WHERE src % 5 = 0 AND dst % 5 != 0 UNION ALL SELECT vec_id, 1.0, x, y FROM own)
SELECT src AS sample_id, round(sum(weight * x) / sum(weight), 6) AS x, round(sum(weight * y) / sum(weight), 6) AS y FROM ed GROUP BY 1""")
def project_coords(spark, d):
    """Every fifth point is new: its scores on three factors place it, then the others that it is linked to."""
    p = points(spark, d)
    snn = graph.calc_snn(p, 10).where("src % 5 = 0 and dst % 5 != 0").select(F.col("src").alias("test_id"), F.col("dst").alias("train_id"), "weight")
    new = p.where("sample_id % 5 = 0").select("sample_id", F.transform(F.slice("v", 1, 3), lambda x: F.abs(x) + 0.1).alias("h"))
    emb = Embedding(factor_xy(spark).where("factor_idx <= 3"), _vec_xy(spark, d).where("sample_id % 5 != 0"))
    return rounded(embed.project_embedding(emb, new, snn), 6, "x", "y")


@query("""WITH t AS (SELECT p_type, row_number() OVER (ORDER BY p_type) AS i, avg(p_size) AS s FROM part GROUP BY 1)
SELECT 'factor_' || i AS factor, CAST(i AS INTEGER) AS factor_idx, CASE WHEN s > (SELECT avg(p_size) FROM part) THEN p_type ELSE '' END AS name FROM t""")
def rename_factors(spark, d):
    """A factor for each part type; those of large parts get the type's name, the others keep theirs and so lose it."""
    p = table(spark, d, "part")
    t = dense_index(p.groupBy("p_type").agg(F.avg("p_size").alias("s")), "p_type", "i").crossJoin(F.broadcast(p.agg(F.avg("p_size").alias("mean"))))
    f = materialized(t.select(F.concat(F.lit("factor_"), F.col("i") + 1).alias("factor"), (F.col("i") + 1).cast("int").alias("factor_idx"), "p_type", "s", "mean"), "factors")
    mapping = f.select(F.col("factor").alias("old"), F.when(F.col("s") > F.col("mean"), F.col("p_type")).otherwise(F.col("factor")).alias("new"))
    return embed.rename_factors(f.select("factor", "factor_idx", F.col("factor").alias("name")), mapping).select("factor", "factor_idx", "name")


def _regions(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("region_id"), F.col("p_name").alias("symbol"), F.when(F.col("p_partkey") % 3 == 0, "Promoter").when(F.col("p_partkey") % 3 == 1, "Intron").otherwise("Distal").alias("annotation"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice").cast("double")).alias("a"))


@query("SELECT p_name || '-pr' AS feature_id, round(avg(p_size), 6) AS a1, round(avg(p_retailprice), 6) AS a2 FROM part WHERE p_partkey % 3 = 0 GROUP BY 1")
def embed_promoters_agg(spark, d):
    r = _regions(spark, d)
    s = embed.region_scores(r, r.select(F.col("symbol").alias("feature_id")).distinct())
    return rounded(s.select("feature_id", F.col("a")[0].alias("a1"), F.col("a")[1].alias("a2")), 6, "a1", "a2")


@query("SELECT p_brand || '-tfbs' AS feature_id, round(CAST(sum(p_size) AS DOUBLE), 4) AS a1, round(sum(p_retailprice), 4) AS a2 FROM part WHERE p_partkey % 4 != 0 GROUP BY 1")
def tfbs_scores(spark, d):
    motifs = table(spark, d, "part").select(F.col("p_partkey").alias("region_id"), F.col("p_brand").alias("tf"), F.when(F.col("p_partkey") % 4 == 0, 0).otherwise(1).alias("hit"))
    s = embed.tfbs_scores(_regions(spark, d), motifs)
    return rounded(s.select("feature_id", F.col("a")[0].alias("a1"), F.col("a")[1].alias("a2")), 4, "a1", "a2")


@query()
def sammon(spark, d):
    h, k = scores(spark, d)
    return rounded(embed.factor_coordinates(h, k), 4, "x", "y")


# ---------------------------------------------------------------- annotation
def _cust(spark, d):
    """Counts and factor scores on the customers that have both."""
    h, k = scores(spark, d)
    m = counts(spark, d)
    return CountMatrix(m.entries, m.features, h.select("sample_id")), h, k


@query(f"""WITH {COUNTS}, {SCORES}, n AS (SELECT count(*) AS n FROM ids), b AS (SELECT i, sum(v) AS s, sum(v * v) AS q FROM h GROUP BY 1),
 x AS (SELECT feature_id, i, sum(value * v) AS p FROM e JOIN h ON e.sample_id = h.sample_id GROUP BY 1, 2), a AS (SELECT feature_id, sum(value) AS a, sum(value * value) AS aa FROM e GROUP BY 1)
SELECT f.feature_id, CAST(b.i AS INTEGER) AS factor_idx, CASE WHEN (aa - a * a / n) * (q - s * s / n) > 0 THEN round((p - a * s / n) / sqrt((aa - a * a / n) * (q - s * s / n)), 6) END AS assoc
FROM f CROSS JOIN b CROSS JOIN n LEFT JOIN x ON x.feature_id = f.feature_id AND x.i = b.i LEFT JOIN a ON a.feature_id = f.feature_id""")
def factor_assoc_pearson(spark, d):
    m, h, k = _cust(spark, d)
    return rounded(annotate.associate_pearson(m, h, k), 6, "assoc")


@query(f"""WITH {COUNTS}, {SCORES}, gr AS (SELECT f.feature_id, ids.sample_id, coalesce(e.value, 0) AS v FROM (SELECT DISTINCT feature_id FROM e) f CROSS JOIN ids LEFT JOIN e ON e.feature_id = f.feature_id AND e.sample_id = ids.sample_id),
 ra AS (SELECT feature_id, sample_id, rank() OVER (PARTITION BY feature_id ORDER BY v) + (count(*) OVER (PARTITION BY feature_id, v) - 1) / 2.0 AS r FROM gr),
 rb AS (SELECT i, sample_id, rank() OVER (PARTITION BY i ORDER BY v) + (count(*) OVER (PARTITION BY i, v) - 1) / 2.0 AS r FROM h)
SELECT feature_id, CAST(i AS INTEGER) AS factor_idx, round(corr(ra.r, rb.r), 6) AS assoc FROM ra JOIN rb ON ra.sample_id = rb.sample_id GROUP BY 1, 2""")
def factor_assoc_spearman(spark, d):
    m, h, k = _cust(spark, d)
    return rounded(annotate.associate_spearman(m, h, k), 6, "assoc")


@query()
def factor_assoc_ic(spark, d):
    m, h, k = _cust(spark, d)
    return rounded(annotate.associate_ic(m, h, k), 6, "assoc")


ASSOC = f"{FEATURES}, a AS (SELECT feature_id, i, v AS assoc FROM h)"


def _assoc(spark, d):
    a, _ = brands(spark, d)
    return a.select("feature_id", F.posexplode("a").alias("i", "assoc")).select("feature_id", (F.col("i") + 1).alias("factor_idx"), "assoc")


@query(f"WITH {ASSOC} SELECT assoc, feature_id, CAST(i AS INTEGER) AS factor_idx FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY assoc DESC, feature_id) AS rn FROM a) WHERE rn <= 10")
def summarize_assoc(spark, d):
    return annotate.summarize_assoc(_assoc(spark, d), 10)


@query("WITH m AS (SELECT DISTINCT p_brand AS geneset, p_brand || '|' || p_type AS f FROM part), k AS (SELECT DISTINCT p_brand || '|' || p_type AS f FROM part WHERE p_size > 5), c AS (SELECT m.* FROM m SEMI JOIN k ON m.f = k.f), g AS (SELECT geneset FROM c GROUP BY 1 HAVING count(*) > 2 AND count(*) < 50) SELECT c.geneset, c.f AS feature_id FROM c SEMI JOIN g ON c.geneset = g.geneset")
def genesets_filter(spark, d):
    known = table(spark, d, "part").where("p_size > 5").select(F.concat_ws("|", "p_brand", "p_type").alias("feature_id")).distinct()
    return filtering.filter_genesets(genesets(spark, d), known, 2, 50).select("geneset", F.explode("members").alias("feature_id"))


@query("WITH m AS (SELECT DISTINCT p_brand AS geneset, p_brand || '|' || p_type AS feature_id FROM part) SELECT f.feature_id, g.geneset FROM (SELECT DISTINCT feature_id FROM m) f CROSS JOIN (SELECT DISTINCT geneset FROM m) g WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.feature_id = f.feature_id AND m.geneset = g.geneset)")
def geneset_indicator(spark, d):
    return annotate.genesets_indicator(genesets(spark, d), inverse=True)


@query("SELECT c_mktsegment AS grp, c_custkey AS sample_id, CAST(1.0 AS DOUBLE) AS value FROM customer")
def cluster_indicator(spark, d):
    return annotate.cluster_indicator(as_groups(batches(spark, d)))


BRANDSET = "gs AS (SELECT DISTINCT 'set' || (length(p_brand) + CAST(right(p_brand, 1) AS INTEGER) % 4) AS geneset, p_brand AS feature_id FROM part)"


def _brandsets(spark, d):
    g = table(spark, d, "part").select(F.concat(F.lit("set"), (F.length("p_brand") + F.right("p_brand", F.lit(1)).cast("int") % 4).cast("string")).alias("geneset"), F.col("p_brand").alias("m")).distinct()
    return g.groupBy("geneset").agg(F.sort_array(F.collect_list("m")).alias("members"))


@query(f"WITH {FEATURES}, {BRANDSET} SELECT geneset, CAST(i AS INTEGER) AS factor_idx, round(avg(v * length(geneset || gs.feature_id)), 4) AS loading FROM h JOIN gs ON h.feature_id = gs.feature_id GROUP BY 1, 2")
def geneset_loadings(spark, d):
    a, _ = brands(spark, d)
    sets = _brandsets(spark, d)
    w = annotate.genesets_indicator(sets).withColumn("weight", F.length(F.concat("geneset", "feature_id")).cast("double"))
    return rounded(annotate.geneset_loadings(a.withColumnRenamed("a", "w"), w, sets), 4, "loading")


@query(f"""WITH {ASSOC}, {BRANDSET}, r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY assoc DESC, feature_id) AS r FROM a),
 g AS (SELECT r.i, s.geneset, r.r, CASE WHEN gs.feature_id IS NULL THEN 0.0 ELSE abs(assoc) END AS hit, CASE WHEN gs.feature_id IS NULL THEN 1 ELSE 0 END AS miss FROM r CROSS JOIN (SELECT DISTINCT geneset FROM gs) s LEFT JOIN gs ON gs.geneset = s.geneset AND gs.feature_id = r.feature_id),
 c AS (SELECT i, geneset, sum(hit) OVER (PARTITION BY i, geneset ORDER BY r) / sum(hit) OVER (PARTITION BY i, geneset) - sum(miss) OVER (PARTITION BY i, geneset ORDER BY r) / CAST(sum(miss) OVER (PARTITION BY i, geneset) AS DOUBLE) AS run FROM g),
 x AS (SELECT i, geneset, greatest(max(run), 0) AS hi, least(min(run), 0) AS lo FROM c GROUP BY 1, 2)
SELECT CAST(i AS INTEGER) AS factor_idx, geneset, round(CASE WHEN round(hi, 9) >= round(-lo, 9) THEN hi ELSE lo END, 6) AS es FROM x""")
def gsea_es(spark, d):
    return rounded(annotate.run_gsea(_assoc(spark, d), _brandsets(spark, d), n_rand=0), 6, "es").select("factor_idx", "geneset", "es")


@query()
def run_gsea(spark, d):
    return annotate.run_gsea(_assoc(spark, d), _brandsets(spark, d))


@query(f"WITH {COUNTS}, g AS (SELECT DISTINCT p_brand AS geneset, p_brand || '|' || p_type AS feature_id FROM part) SELECT geneset, sample_id, sum(value) AS total FROM e JOIN g ON e.feature_id = g.feature_id GROUP BY 1, 2")
def geneset_sums(spark, d):
    return annotate.geneset_sums(counts(spark, d), genesets(spark, d))


@query(f"""WITH {COUNTS}, {SCORES}, g AS (SELECT DISTINCT p_brand AS geneset, p_brand || '|' || p_type AS feature_id FROM part), sz AS (SELECT geneset, count(*) AS c FROM g GROUP BY 1), n AS (SELECT count(*) AS n FROM ids),
 sc AS (SELECT g.geneset, sample_id, sum(value) / any_value(sz.c) AS y FROM e JOIN g ON e.feature_id = g.feature_id JOIN sz ON sz.geneset = g.geneset GROUP BY 1, 2), a AS (SELECT geneset, sum(y) AS a, sum(y * y) AS aa FROM sc GROUP BY 1),
 b AS (SELECT i, sum(v) AS s, sum(v * v) AS q FROM h GROUP BY 1), x AS (SELECT geneset, i, sum(y * v) AS p FROM sc JOIN h ON sc.sample_id = h.sample_id GROUP BY 1, 2),
 r AS (SELECT x.geneset, x.i, (p - a * s / n) / sqrt((aa - a * a / n) * (q - s * s / n)) AS assoc FROM x JOIN a ON a.geneset = x.geneset JOIN b ON b.i = x.i, n),
 o AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY assoc DESC, geneset) AS rn FROM r)
SELECT round(assoc, 6) AS assoc, geneset AS feature_id, CAST(i AS INTEGER) AS factor_idx FROM o WHERE rn <= 5""")
def select_genesets(spark, d):
    m, h, k = _cust(spark, d)
    return rounded(annotate.select_genesets(m, materialized(h, "h"), k, genesets(spark, d)), 6, "assoc")


LOADINGS = "ld AS (SELECT feature_id, CAST(length(feature_id) AS DOUBLE) AS w1, CAST(ascii(substr(feature_id, 7, 1)) % 5 AS DOUBLE) AS w2, CAST(ascii(right(feature_id, 1)) % 3 + 1 AS DOUBLE) AS w3 FROM f)"


def _loadings(m: CountMatrix, k: int):
    f = F.col("feature_id")
    w = [F.length(f), F.ascii(F.substring(f, 7, 1)) % 5, F.ascii(F.right(f, F.lit(1))) % 3 + 1]
    return m.features.select("feature_id", F.array(*(x.cast("double") for x in w[:k])).alias("w"))


@query(f"""WITH {COUNTS}, {LOADINGS}, ps AS (SELECT batch, count(*) AS n FROM s GROUP BY 1), nn AS (SELECT count(*) AS n FROM s), tw AS (SELECT sum(w1) AS t1, sum(w2) AS t2, sum(w3) AS t3 FROM ld),
 sw AS (SELECT feature_id, greatest(w1 / t1, w2 / t2, w3 / t3) AS top, w1 / t1 + w2 / t2 + w3 / t3 AS alls FROM ld, tw), fl AS (SELECT feature_id, log2((top + 1e-4) / ((alls - top) / 2 + 1e-4)) AS factor_logfc FROM sw),
 pg AS (SELECT feature_id, batch, sum(value) AS t FROM e JOIN s ON e.sample_id = s.sample_id GROUP BY 1, 2),
 mx AS (SELECT pg.feature_id, pg.batch, pg.t, ps.n, pg.t / ps.n AS mean, sum(pg.t) OVER (PARTITION BY pg.feature_id) AS alls, row_number() OVER (PARTITION BY pg.feature_id ORDER BY pg.t / ps.n DESC, pg.batch DESC) AS rn FROM pg JOIN ps ON pg.batch = ps.batch),
 cl AS (SELECT feature_id, batch AS cluster, log2((mean + 1e-4) / ((alls - t) / (nn.n - mx.n) + 1e-4)) AS cluster_logfc FROM mx, nn WHERE rn = 1)
SELECT cl.feature_id, cluster, round(cluster_logfc, 6) AS cluster_logfc, round(factor_logfc, 6) + 0.0 AS factor_logfc, length(cl.feature_id) % 2 = 0 AS embedded, length(cl.feature_id) % 2 = 0 AND (cluster_logfc < 0.2 OR factor_logfc < 0.05) AS weak FROM cl JOIN fl ON cl.feature_id = fl.feature_id""")
def check_gene_embedding(spark, d):
    m = counts(spark, d)
    return rounded(annotate.check_gene_embedding(_loadings(m, 3), 3, m, as_groups(batches(spark, d)), m.features.where(F.length("feature_id") % 2 == 0), 0.2, 0.05), 6, "cluster_logfc", "factor_logfc")


# ---------------------------------------------------------------- groups
@query("WITH m AS (SELECT DISTINCT l_returnflag AS grp, l_orderkey AS sample_id FROM lineitem) SELECT sample_id, any_value(grp) AS grp FROM m GROUP BY 1 HAVING count(*) = 1")
def flatten_groups(spark, d):
    o = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_orderkey").alias("sample_id")).distinct()
    return groups.flatten_groups(groups.nest_groups(o))


@query("SELECT c_mktsegment AS grp, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) AS members FROM customer GROUP BY 1")
def unflatten_groups(spark, d):
    return groups.unflatten_groups(as_groups(batches(spark, d))).select("grp", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query("SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS F, sum(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS O, sum(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS P FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY 1")
def unflatten_dataframe(spark, d):
    long = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").count()
    return groups.unflatten_dataframe(long.where("o_orderstatus in ('F', 'O', 'P')"), "count", "o_custkey", "o_orderstatus", ["F", "O", "P"])


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'works' WHEN 'MACHINERY' THEN 'works' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def label_recode(spark, d):
    m = spark.createDataFrame([("BUILDING", "works"), ("MACHINERY", "works")], "old string, new string")
    return groups.recode(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", m)


@query("WITH x AS (SELECT doc_id, 'quality' AS label, quality AS score FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels), h AS (SELECT doc_id, count(*) AS n, any_value(label) AS label FROM x WHERE score >= 1 GROUP BY 1) SELECT l.doc_id AS sample_id, CASE WHEN h.n = 1 THEN h.label END AS label FROM labels l LEFT JOIN h ON l.doc_id = h.doc_id")
def multi_label_resolve(spark, d):
    l = table(spark, d, "labels").withColumnRenamed("doc_id", "sample_id")
    long = l.unpivot("sample_id", ["quality", "toxic"], "label", "score")
    return groups.multi_label(long, spark.createDataFrame([("quality", 1), ("toxic", 1)], "label string, cutoff int"), l)


# ---------------------------------------------------------------- plots
@query(f"WITH {VXY} SELECT CAST(label AS VARCHAR) AS label, round(quantile_cont(x, 0.5), 6) AS x, round(quantile_cont(y, 0.5), 6) AS y FROM cv JOIN embeddings e ON cv.vec_id = e.vec_id GROUP BY 1")
def plot_group_medians(spark, d):
    return rounded(plotdata.group_medians(plotdata.grouped_points(_vec_xy(spark, d), labels(spark, d))), 6, "x", "y")


@query(f"""WITH {VXY}, sc AS (SELECT vec_id, CASE WHEN label != 0 THEN CAST(embedding[3] AS DOUBLE) END AS score FROM embeddings), q AS (SELECT quantile_cont(score, 0.01) AS lo, quantile_cont(score, 0.99) AS hi FROM sc)
SELECT cv.vec_id AS sample_id, round(x, 6) AS x, round(y, 6) AS y, CASE WHEN score IS NOT NULL THEN round((least(greatest(score, lo), hi) - lo) / (hi - lo), 6) END AS score FROM cv LEFT JOIN sc ON cv.vec_id = sc.vec_id, q""")
def feature_plot_clip(spark, d):
    sc = points(spark, d).join(labels(spark, d), "sample_id").select("sample_id", F.when(F.col("grp") != 0, F.col("v")[2]).alias("score"))
    out = rounded(plotdata.clipped_scores(_vec_xy(spark, d), sc), 6, "x", "y")
    return out.withColumn("score", F.round("score", 6))


@query("""WITH a AS (SELECT p_brand AS feature_id, p_type AS sample_id, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), w AS (SELECT *, avg(value) OVER (PARTITION BY feature_id) AS m, stddev_samp(value) OVER (PARTITION BY feature_id) AS s FROM a),
 z AS (SELECT feature_id, sample_id, CASE WHEN s > 0 THEN (value - m) / s ELSE 0 END AS value FROM w) SELECT feature_id, sample_id, round(value, 6) + 0.0 AS value, value > 1 AS highlight FROM z""")
def heat_scale_melt(spark, d):
    p = table(spark, d, "part")
    e = table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("feature_id"), F.col("p_type").alias("sample_id")).agg(F.sum("l_quantity").alias("value"))
    return rounded(plotdata.heat_table(e, "row", 1.0), 6, "value")


@query("SELECT CAST(row_number() OVER (ORDER BY c_custkey) AS INTEGER) AS idx, c_name AS name, c_acctbal AS value FROM customer")
def bar_table(spark, d):
    c = dense_index(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_custkey", "idx")
    return plotdata.bar_table(c.select((F.col("idx") + 1).cast("int").alias("idx"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("value")))


@query(f"WITH {VXY} SELECT label AS grp, count(*) AS n, round(avg(x), 6) AS mx, round(avg(y), 6) AS my, round(var_samp(x), 6) AS vxx, round(var_samp(y), 6) AS vyy, round(covar_samp(x, y), 6) AS vxy FROM cv JOIN embeddings e ON cv.vec_id = e.vec_id GROUP BY 1")
def contour_moments(spark, d):
    return rounded(plotdata.ellipse_moments(plotdata.grouped_points(_vec_xy(spark, d), labels(spark, d))), 6, "mx", "my", "vxx", "vyy", "vxy")


@query("""WITH g AS (SELECT DISTINCT c_mktsegment AS grp FROM customer), o AS (SELECT grp, (row_number() OVER (ORDER BY sha256('42:' || grp)) - 1) / CAST(count(*) OVER () AS DOUBLE) AS hue FROM g),
 c AS (SELECT grp, unnest([1.0 / 3, 0.0, -1.0 / 3]) AS shift, generate_subscripts([1, 2, 3], 1) AS pos, hue FROM o), q AS (SELECT grp, pos, CASE WHEN hue + shift < 0 THEN hue + shift + 1 WHEN hue + shift >= 1 THEN hue + shift - 1 ELSE hue + shift END AS u FROM c),
 v AS (SELECT grp, pos, CASE WHEN u < 1.0 / 6 THEN 0.2575 + 0.585 * u * 6 WHEN u < 0.5 THEN 0.8425 WHEN u < 2.0 / 3 THEN 0.2575 + 0.585 * (2.0 / 3 - u) * 6 ELSE 0.2575 END AS v FROM q)
SELECT grp, '#' || string_agg(printf('%02x', CAST(round(255 * v) AS INTEGER)), '' ORDER BY pos) AS color FROM v GROUP BY 1""")
def group_colors(spark, d):
    return plotdata.palette(as_groups(batches(spark, d)))


# ---------------------------------------------------------------- evaluation
@query(f"WITH {CENT} SELECT a.grp AS c1, b.grp AS c2, round(sqrt(sum((a.value - b.value) * (a.value - b.value))), 6) AS dist FROM c a JOIN c b ON a.pos = b.pos AND a.grp < b.grp GROUP BY 1, 2")
def pairwise_centroid_dist(spark, d):
    return rounded(evaluate.pairwise_centroid_dist(points(spark, d), labels(spark, d)), 6, "dist")


@query(f"""WITH {CENT}, a AS (SELECT a.grp AS c1, b.grp AS c2, sqrt(sum((a.value - b.value) * (a.value - b.value))) AS d1, sqrt(sum(CASE WHEN a.pos <= 2 THEN (a.value - b.value) * (a.value - b.value) END)) AS d2 FROM c a JOIN c b ON a.pos = b.pos AND a.grp < b.grp GROUP BY 1, 2) SELECT round(corr(d1, d2), 6) AS corr FROM a""")
def distance_correlation(spark, d):
    p, g = points(spark, d), labels(spark, d)
    two = p.select("sample_id", F.slice("v", 1, 2).alias("v"))
    return rounded(evaluate.distance_correlation(evaluate.pairwise_centroid_dist(p, g), evaluate.pairwise_centroid_dist(two, g)), 6, "corr")


STEPS = "st AS (SELECT event_id, event_type AS grp, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS step FROM events)"


def _steps(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("sample_id"), F.col("event_type").alias("grp"), F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id")).cast("long").alias("step"))


@query(f"WITH {STEPS}, m AS (SELECT *, min(step) OVER (PARTITION BY grp) AS lo FROM st) SELECT event_id AS sample_id, grp, step, CAST(lo + floor((step - lo) / 25.0) * 25 AS BIGINT) AS bucket, grp || '.' || CAST(CAST(lo + floor((step - lo) / 25.0) * 25 AS BIGINT) AS VARCHAR) AS label FROM m")
def path_step(spark, d):
    return evaluate.path_step(_steps(spark, d), 25)


@query(f"WITH {NN}, k AS (SELECT src, dst FROM r WHERE rn <= 10) SELECT src, dst FROM k UNION SELECT dst, src FROM k")
def knn_symmetric(spark, d):
    return evaluate.knn_symmetric(points(spark, d), 10)


@query(f"""WITH {NN}, {VXY}, k1 AS (SELECT src, dst FROM r WHERE rn <= 10),
 d2 AS (SELECT a.vec_id AS src, b.vec_id AS dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist FROM cv a JOIN cv b ON a.vec_id != b.vec_id), k2 AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rn FROM d2) WHERE rn <= 10),
 s1 AS (SELECT src, dst FROM k1 UNION SELECT dst, src FROM k1), s2 AS (SELECT src, dst FROM k2 UNION SELECT dst, src FROM k2),
 n1 AS (SELECT src, count(*) AS n FROM s1 GROUP BY 1), n2 AS (SELECT src, count(*) AS n FROM s2 GROUP BY 1), b AS (SELECT s1.src, count(*) AS n FROM s1 JOIN s2 ON s1.src = s2.src AND s1.dst = s2.dst GROUP BY 1)
SELECT n1.src, round(coalesce(b.n, 0) / CAST(n1.n + n2.n - coalesce(b.n, 0) AS DOUBLE), 6) AS jaccard FROM n1 JOIN n2 ON n1.src = n2.src LEFT JOIN b ON b.src = n1.src""")
def jaccard_score(spark, d):
    p = points(spark, d)
    two = p.select("sample_id", F.slice("v", 1, 2).alias("v"))
    return rounded(evaluate.jaccard_score(evaluate.knn_symmetric(p, 10), evaluate.knn_symmetric(two, 10)), 6, "jaccard")


@query(f"""WITH {NN}, m AS (SELECT d.src, x.label AS g1, y.label AS g2, avg(dist) AS d FROM d JOIN p x ON d.src = x.vec_id JOIN p y ON d.dst = y.vec_id GROUP BY 1, 2, 3),
 s AS (SELECT src, g1, max(CASE WHEN g1 = g2 THEN d END) AS a, min(CASE WHEN g1 != g2 THEN d END) AS b FROM m GROUP BY 1, 2) SELECT src AS sample_id, g1 AS grp, round(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS width FROM s""")
def silhouette(spark, d):
    return rounded(evaluate.silhouette(points(spark, d), labels(spark, d)), 6, "width")


@query("WITH m AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag || l_linestatus || (l_orderkey % 97) AS grp, l_suppkey AS step FROM lineitem) SELECT DISTINCT least(a.id, b.id) AS src, greatest(a.id, b.id) AS dst FROM m a JOIN m b ON a.grp = b.grp AND b.step BETWEEN a.step - 1 AND a.step AND a.id != b.id")
def trajectory_graph(spark, d):
    l = table(spark, d, "lineitem")
    return evaluate.trajectory_graph(l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sample_id"), F.concat("l_returnflag", "l_linestatus", (F.col("l_orderkey") % 97).cast("string")).alias("grp"), F.col("l_suppkey").alias("step")))


@query(f"""WITH {COUNTS}, c AS (SELECT c_custkey AS sample_id, c_acctbal AS v FROM customer), t AS (SELECT count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM c), x AS (SELECT feature_id, sum(value) AS a, sum(value * value) AS aa, sum(value * v) AS p FROM e JOIN c ON e.sample_id = c.sample_id GROUP BY 1)
SELECT feature_id, round((p - a * s / n) / sqrt((aa - a * a / n) * (q - s * s / n)), 6) AS corr FROM x, t""")
def covariate_correlation(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_acctbal").alias("score"))
    return rounded(evaluate.covariate_correlation(counts(spark, d), c), 6, "corr")


@query("""WITH x AS (SELECT l_shipmode AS b, p_brand AS f, sum(l_quantity) AS q FROM (SELECT *, l_linenumber % 3 AS l_shipmode FROM lineitem) JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), r AS (SELECT b, f, row_number() OVER (PARTITION BY b ORDER BY q DESC, f) AS rn FROM x)
SELECT f AS feature_id FROM r WHERE rn <= 10 GROUP BY 1 HAVING count(*) >= 2 AND (SELECT count(DISTINCT b) FROM x WHERE x.f = r.f) = 3""")
def variable_in_several(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy((F.col("l_linenumber") % 3).alias("b"), F.col("p_brand").alias("feature_id")).agg(F.sum("l_quantity").alias("q"))
    r = j.withColumn("selected", F.row_number().over(Window.partitionBy("b").orderBy(F.col("q").desc(), "feature_id")) <= 10)
    return evaluate.variable_in_several([r.where(F.col("b") == i) for i in range(3)])


# ---------------------------------------------------------------- factorisation
@query(f"WITH {NORM} SELECT feature_id, sample_id, round((v + 1e-12) * ln((v + 1e-12) / (ln(v + 1) + 1e-12)) - v + ln(v + 1), 4) AS kl FROM nm")
def kl_div(spark, d):
    m = counts(spark, d)
    n = normalize.normalize_counts(m, normalize.median_depth(m)).entries
    return n.select("feature_id", "sample_id", F.round(factorize.kl_divergence(F.col("value"), F.log1p("value")), 4).alias("kl"))


#: Errors by number of factors, with those of a shuffled matrix: quantities by line number against 25 a line.
ERRORS = "er AS (SELECT l_linenumber AS k, sum(l_quantity) AS err, CAST(count(*) * 25 AS DOUBLE) AS err_rand FROM lineitem GROUP BY 1)"


def _errors(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(F.sum("l_quantity").alias("err"), (F.count("*") * 25).cast("double").alias("err_rand"))


@query(f"WITH {ERRORS} SELECT k, round((err - lead(err) OVER (ORDER BY k)) - (err_rand - lead(err_rand) OVER (ORDER BY k)), 6) AS diff FROM er")
def num_factors_rule(spark, d):
    e = _errors(spark, d)
    return factorize.factor_number_table(e).select("k", F.round("diff", 6).alias("diff"))


@query(f"WITH {COUNTS}, {SCORES} SELECT e.feature_id, CAST(h.i AS INTEGER) AS factor_idx, sum(value * v) AS b FROM e JOIN h ON e.sample_id = h.sample_id GROUP BY 1, 2")
def nnls_rhs(spark, d):
    m, h, k = _cust(spark, d)
    b = factorize.products(m.entries, h, "sample_id", "feature_id", "h", k)
    return b.select("feature_id", F.posexplode("b").alias("i", "b")).select("feature_id", (F.col("i") + 1).alias("factor_idx"), "b")


def _norm(spark, d):
    m = counts(spark, d)
    m = CountMatrix(m.entries, m.features, m.samples.join(m.entries.select("sample_id").distinct(), "sample_id", "left_semi"))
    return held(normalize.scale_counts(m, adj_var=False))


@query()
def run_nmf(spark, d):
    return factorize.run_nmf(_norm(spark, d), 6, init="random").w


@query()
def nnsvd_init(spark, d):
    return factorize.run_nmf(_norm(spark, d), 4, init="nnsvd").w


@query()
def ica_init(spark, d):
    return factorize.run_nmf(_norm(spark, d), 4, init="ica").w


@query()
def run_nmf_kl(spark, d):
    return factorize.run_nmf(_norm(spark, d), 4, init="random", loss="mkl").w


@query()
def project_features(spark, d):
    m, h, k = _cust(spark, d)
    return factorize.project_features(m, h, k)


@query()
def project_samples(spark, d):
    m = _norm(spark, d)
    f = factorize.run_nmf(m, 4, init="random")
    return factorize.project_samples(m, f.w, 4)


@query()
def find_num_factors(spark, d):
    return factorize.find_num_factors(_norm(spark, d))[1]


@query()
def run_embedding(spark, d):
    m = _norm(spark, d)
    g = as_groups(batches(spark, d))
    fit = pipeline.run_embedding(m, 6, init="nnsvd", groups=g, genes_embed=m.features)
    return fit.embedding.samples


@query()
def project_embedding(spark, d):
    m = _norm(spark, d)
    train = CountMatrix(m.entries.where("sample_id % 5 != 0"), m.features, m.samples.where("sample_id % 5 != 0"))
    test = CountMatrix(m.entries.where("sample_id % 5 = 0"), m.features, m.samples.where("sample_id % 5 = 0"))
    fit = pipeline.run_embedding(train, 4, init="random", paga=False, snn_k=10)
    return pipeline.project_samples(fit, test, snn_k=10, k_scale=5)


# ---------------------------------------------------------------- exact cases of iterative operators
TWO = "x AS (SELECT k, CASE WHEN u1 >= 0 AND u2 >= 0 THEN u1 WHEN u1 < 0 THEN 0 ELSE greatest(0, b1 / g11) END AS x1, CASE WHEN u1 >= 0 AND u2 >= 0 THEN u2 WHEN u1 < 0 THEN greatest(0, b2 / g22) ELSE 0 END AS x2 FROM (SELECT *, (b1 * g22 - b2 * g12) / (g11 * g22 - g12 * g12) AS u1, (b2 * g11 - b1 * g12) / (g11 * g22 - g12 * g12) AS u2 FROM b, g))"


@query(f"""WITH {COUNTS}, {LOADINGS}, g AS (SELECT sum(w1 * w1) AS g11, sum(w1 * w2) AS g12, sum(w2 * w2) AS g22 FROM ld),
 b AS (SELECT s.sample_id AS k, coalesce(sum(value * w1), 0) AS b1, coalesce(sum(value * w2), 0) AS b2 FROM s LEFT JOIN e ON e.sample_id = s.sample_id LEFT JOIN ld ON ld.feature_id = e.feature_id GROUP BY 1), {TWO}
SELECT k AS sample_id, round(x1, 6) AS h1, round(x2, 6) AS h2 FROM x""")
def project_samples_two(spark, d):
    """Two loadings that overlap: least squares have a closed form there."""
    m = counts(spark, d)
    h = factorize.project_samples(m, _loadings(m, 2), 2)
    return rounded(h.select("sample_id", F.col("h")[0].alias("h1"), F.col("h")[1].alias("h2")), 6, "h1", "h2")


@query(f"""WITH {COUNTS}, {SCORES}, hh AS (SELECT sample_id, sum(CASE WHEN i = 1 THEN v END) AS h1, sum(CASE WHEN i <= 2 THEN v END) AS h2 FROM h GROUP BY 1), g AS (SELECT sum(h1 * h1) AS g11, sum(h1 * h2) AS g12, sum(h2 * h2) AS g22 FROM hh),
 b AS (SELECT f.feature_id AS k, coalesce(sum(value * h1), 0) AS b1, coalesce(sum(value * h2), 0) AS b2 FROM f LEFT JOIN e ON e.feature_id = f.feature_id LEFT JOIN hh ON hh.sample_id = e.sample_id GROUP BY 1), {TWO}
SELECT k AS feature_id, round(x1, 6) AS w1, round(x2, 6) AS w2 FROM x""")
def project_features_two(spark, d):
    m, h, _ = _cust(spark, d)
    h = h.select("sample_id", F.array(F.col("h")[0], F.col("h")[0] + F.col("h")[1]).alias("h"))
    w = factorize.project_features(m, h, 2)
    return rounded(w.select("feature_id", F.col("w")[0].alias("w1"), F.col("w")[1].alias("w2")), 6, "w1", "w2")


@query(f"""WITH {COUNTS}, {LOADINGS}, g AS (SELECT sum(w1 * w1) AS g, sum(w1) AS t FROM ld), b AS (SELECT s.sample_id, coalesce(sum(value * w1), 0) AS b, coalesce(sum(value), 0) AS v FROM s LEFT JOIN e ON e.sample_id = s.sample_id LEFT JOIN ld ON ld.feature_id = e.feature_id GROUP BY 1)
SELECT sample_id, round(greatest(0, (b - 40.0) / (g + 7.0)), 6) AS penalised, round(v / t, 6) AS kl FROM b, g""")
def project_samples_one(spark, d):
    """One loading, where penalties and the KL divergence have closed forms too."""
    m = counts(spark, d)
    w = _loadings(m, 1)
    a = factorize.project_samples(m, w, 1, alpha=(7.0, 0.0, 40.0)).select("sample_id", F.col("h")[0].alias("penalised"))
    b = factorize.project_samples(m, w, 1, loss="mkl").select("sample_id", F.col("h")[0].alias("kl"))
    return rounded(a.join(b, "sample_id"), 6, "penalised", "kl")


@query(f"WITH {COUNTS}, g AS (SELECT DISTINCT p_brand AS geneset, p_brand || '|' || p_type AS feature_id FROM part), sz AS (SELECT geneset, count(*) AS c FROM g GROUP BY 1) SELECT sz.geneset, s.sample_id, round(coalesce(sum(value), 0) / any_value(sz.c), 6) AS score FROM sz CROSS JOIN s LEFT JOIN g ON g.geneset = sz.geneset LEFT JOIN e ON e.feature_id = g.feature_id AND e.sample_id = s.sample_id GROUP BY 1, 2")
def project_genesets(spark, d):
    """Sets without common members: each score is a mean over the set."""
    names, _, h = annotate.project_genesets(counts(spark, d), genesets(spark, d))
    label = F.array(*(F.lit(x) for x in names))
    return rounded(h.select("sample_id", F.posexplode("h").alias("i", "score")).select(F.element_at(label, F.col("i") + 1).alias("geneset"), "sample_id", "score"), 6, "score")


BLOCKS = """bf AS (SELECT DISTINCT p_brand AS feature_id, CAST(substr(p_brand, 7) AS INTEGER) AS r FROM part), bs AS (SELECT s_suppkey AS sample_id, CAST(s_suppkey % 7 + 1 AS DOUBLE) AS c FROM supplier),
 bn AS (SELECT a.b, a.n * c.n AS d, a.n AS nf, row_number() OVER (ORDER BY a.n * c.n DESC) AS i FROM (SELECT r % 3 AS b, sqrt(sum(r * r)) AS n FROM bf GROUP BY 1) a JOIN (SELECT sample_id % 3 AS b, sqrt(sum(c * c)) AS n FROM bs GROUP BY 1) c ON a.b = c.b)"""


def _blocks(spark, d) -> CountMatrix:
    """Brands and suppliers in three blocks, each of rank one, so that singular vectors and factors are known."""
    f = table(spark, d, "part").select(F.col("p_brand").alias("feature_id")).distinct().withColumn("r", F.substring("feature_id", 7, 9).cast("int"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("sample_id"), (F.col("s_suppkey") % 7 + 1).cast("double").alias("c"))
    e = f.join(s, F.col("r") % 3 == F.col("sample_id") % 3).select("feature_id", "sample_id", (F.col("r") * F.col("c")).alias("value"))
    return held(CountMatrix(e, f.select("feature_id"), s.select("sample_id")))


@query(f"WITH {BLOCKS} SELECT CAST(i AS INTEGER) AS factor_idx, round(d, 4) AS value FROM bn")
def truncated_svd(spark, d):
    _, values, _ = linalg.truncated_svd(linalg.packed(_blocks(spark, d)), 3, center=False)
    return rounded(spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(values)], "factor_idx int, value double"), 4, "value")


@query(f"WITH {BLOCKS} SELECT feature_id, CAST(i AS INTEGER) AS factor_idx, round(sqrt(d) * r / nf, 5) AS w FROM bf JOIN bn ON bf.r % 3 = bn.b")
def nnsvd_start(spark, d):
    pk = linalg.packed(_blocks(spark, d))
    w = factorize.nnsvd_init(pk, 3)
    out = [(f, i + 1, float(v)) for f, row in zip(pk.features, w) for i, v in enumerate(row) if v > 1e-6]
    return rounded(spark.createDataFrame(out, "feature_id string, factor_idx int, w double"), 5, "w")


def _rebuilt(init: str, loss: str = "mse"):
    def f(spark, d):
        m = _blocks(spark, d)
        fit = factorize.run_nmf(m, 3, init=init, loss=loss, tol=1e-9)
        both = m.entries.join(fit.w, "feature_id").join(fit.h, "sample_id")
        return both.select("feature_id", "sample_id", (F.round(sum((F.col("w")[i] * F.col("h")[i] for i in range(1, 3)), F.col("w")[0] * F.col("h")[0]), 2) + 0.0).alias("value"))

    f.__name__ = f"nmf_rebuilds_{init}" + ("_kl" if loss == "mkl" else "")
    query(f"WITH {BLOCKS} SELECT feature_id, sample_id, CAST(r * c AS DOUBLE) AS value FROM bf JOIN bs ON bf.r % 3 = bs.sample_id % 3")(f)


_rebuilt("nnsvd")
_rebuilt("ica")
_rebuilt("nnsvd", "mkl")


@query(f"""WITH {SCORES}, x AS (SELECT a.i AS f1, b.i AS f2, sum(a.v * b.v) AS g, sum(a.v * a.v) AS qa, sum(b.v * b.v) AS qb FROM h a JOIN h b ON a.sample_id = b.sample_id AND a.i < b.i AND b.i <= 3 GROUP BY 1, 2)
SELECT CAST(f1 AS INTEGER) AS f1, CAST(f2 AS INTEGER) AS f2, round(1 - g / sqrt(qa * qb), 3) AS dist FROM x""")
def sammon_three(spark, d):
    """Three factors fit into the plane, so the map must keep their distances."""
    h, _ = scores(spark, d)
    y, _ = embed.sammon(embed.factor_distances(h.select("sample_id", F.slice("h", 1, 3).alias("h")), 3), tol=1e-12)
    out = [(i + 1, j + 1, float(((y[i] - y[j]) ** 2).sum() ** 0.5)) for i in range(3) for j in range(i + 1, 3)]
    return rounded(spark.createDataFrame(out, "f1 int, f2 int, dist double"), 3, "dist")


@query("""WITH e AS (SELECT p_type AS feature_id, o_custkey AS sample_id, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM customer),
 m AS (SELECT feature_id, sum(value) / any_value(n.n) AS m, count(*) AS nobs FROM e, n GROUP BY 1), v AS (SELECT e.feature_id, ln(any_value(m.m)) AS m, ln((sum((value - m.m) * (value - m.m)) + any_value(m.m * m.m * (n.n - nobs))) / any_value(n.n)) AS v, any_value(nobs) AS nobs FROM e JOIN m ON e.feature_id = m.feature_id, n GROUP BY 1),
 l AS (SELECT regr_slope(v, m) AS s, regr_intercept(v, m) AS i FROM v) SELECT feature_id, round(m, 6) AS m, round(v, 6) AS v, nobs, round(v - s * m - i, 6) + 0.0 AS res FROM v, l""")
def adjust_variance_line(spark, d):
    """Few features, so the trend is a line."""
    l, o, p = (table(spark, d, x) for x in ("lineitem", "orders", "part"))
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    e = materialized(j.groupBy(F.col("p_type").alias("feature_id"), F.col("o_custkey").alias("sample_id")).agg(F.sum("l_quantity").alias("value")), "counts")
    m = CountMatrix(e, p.select(F.col("p_type").alias("feature_id")).distinct(), table(spark, d, "customer").select(F.col("c_custkey").alias("sample_id")))
    return rounded(normalize.adjust_variance(m).select("feature_id", "m", "v", "nobs", "res"), 6, "m", "v", "res")


@query(f"WITH {NORM} SELECT feature_id, sample_id, round(v, 6) AS value FROM nm")
def scale_none(spark, d):
    return rounded(normalize.scale_counts(counts(spark, d), method="none", adj_var=False).entries, 6, "value")


@query(f"WITH {COUNTS}, r AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY value DESC, sample_id) AS rn, count(*) OVER (PARTITION BY feature_id) AS n FROM e), cap AS (SELECT feature_id, value AS cap FROM r WHERE rn = 4 AND n > 4) SELECT r.feature_id, r.sample_id, least(r.value, coalesce(cap.cap, r.value)) AS value FROM r LEFT JOIN cap ON r.feature_id = cap.feature_id")
def winsorize_features(spark, d):
    return filtering.winsorize(counts(spark, d).entries, 3, "feature_id")


@query(f"WITH {FEATURES}, k AS (SELECT feature_id FROM h GROUP BY 1 HAVING sum(v) > 0), n AS (SELECT feature_id, CAST(substr(feature_id, 7) AS INTEGER) AS b FROM k) SELECT x.feature_id AS src, y.feature_id AS dst, CAST(1.0 AS DOUBLE) AS weight FROM n x JOIN n y ON x.b + 1 = y.b WHERE x.b % 3 != 0 AND y.b % 3 != 0")
def drop_empty_samples(spark, d):
    """Brands as samples, every third of them without mass; links to the next brand."""
    a, k = brands(spark, d)
    n = F.substring("feature_id", 7, 9).cast("int")
    h = a.select(F.col("feature_id").alias("sample_id"), F.when(n % 3 == 0, F.array(*(F.lit(0.0) for _ in range(k)))).otherwise(F.col("a")).alias("h"), n.alias("n"))
    e = h.select(F.col("sample_id").alias("src"), (F.col("n") + 1).alias("n")).join(h.select(F.col("sample_id").alias("dst"), "n"), "n").select("src", "dst", F.lit(1.0).alias("weight"))
    return filtering.drop_empty_samples(h.drop("n"), e)[1]


# ---------------------------------------------------------------- promoters, factors, labels
PLACED = """mm AS (SELECT feature_id, min(v) AS lo, max(v) AS hi FROM h GROUP BY 1), sc AS (SELECT h.feature_id, i, CASE WHEN hi = lo THEN 1.0 ELSE (v - lo) / (hi - lo) END AS v FROM h JOIN mm ON h.feature_id = mm.feature_id)
SELECT feature_id, round(sum(x * v) / nullif(sum(v), 0), 6) AS x, round(sum(y * v) / nullif(sum(v), 0), 6) AS y FROM sc JOIN xy ON sc.i = xy.i GROUP BY 1"""


def _three(df, cols):
    return df.select("*", F.array(*(F.col(c).cast("double") for c in cols)).alias("a"))


@query(f"WITH {XYSQL}, r AS (SELECT p_name || '-pr' AS feature_id, avg(p_size) AS a1, avg(p_retailprice / 100) AS a2, avg(p_partkey % 11) AS a3 FROM part WHERE p_partkey % 3 = 0 GROUP BY 1), h AS (SELECT feature_id, 1 AS i, a1 AS v FROM r UNION ALL SELECT feature_id, 2, a2 FROM r UNION ALL SELECT feature_id, 3, a3 FROM r), {PLACED}")
def embed_promoters(spark, d):
    p = table(spark, d, "part")
    r = p.select(F.col("p_partkey").alias("region_id"), F.col("p_name").alias("symbol"), F.when(F.col("p_partkey") % 3 == 0, "Promoter (<=1kb)").otherwise("Distal").alias("annotation"), F.array(F.col("p_size").cast("double"), (F.col("p_retailprice") / 100).cast("double"), (F.col("p_partkey") % 11).cast("double")).alias("a"))
    emb = embed.embed_promoters(Embedding(factor_xy(spark).where("factor_idx <= 3"), _vec_xy(spark, d)), r, r.select(F.col("symbol").alias("feature_id")).distinct())
    return rounded(emb.features, 6, "x", "y")


@query(f"""WITH {SCORES}, {XYSQL}, q2 AS (SELECT p_brand, o_custkey AS sample_id, sum(l_quantity) AS dev FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
 cr AS (SELECT p_brand || '-tfbs' AS feature_id, i, corr(dev, h.v) AS v FROM q2 JOIN h ON q2.sample_id = h.sample_id GROUP BY 1, 2), mm AS (SELECT feature_id, min(v) AS lo, max(v) AS hi FROM cr GROUP BY 1),
 sc AS (SELECT cr.feature_id, i, CASE WHEN hi = lo THEN 1.0 ELSE (v - lo) / (hi - lo) END AS v FROM cr JOIN mm ON cr.feature_id = mm.feature_id), rk AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY v DESC, i) AS rn FROM sc)
SELECT feature_id, round(sum(x * v) / nullif(sum(v), 0), 5) AS x, round(sum(y * v) / nullif(sum(v), 0), 5) AS y FROM rk JOIN xy ON rk.i = xy.i WHERE rn <= 3 GROUP BY 1""")
def embed_deviations(spark, d):
    """Deviations of brands, correlated with the factors' scores and placed."""
    h, k = scores(spark, d)
    l, o, p = (table(spark, d, x) for x in ("lineitem", "orders", "part"))
    dev = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("tf"), F.col("o_custkey").alias("sample_id")).agg(F.sum("l_quantity").alias("dev"))
    emb = embed.embed_tfbs(Embedding(factor_xy(spark), _vec_xy(spark, d)), dev=dev, h=h, k=k)
    return rounded(emb.features, 5, "x", "y")


@query("SELECT p_partkey AS feature_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def missing_genes(spark, d):
    regions = table(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("symbol"))
    return embed.missing_genes(regions, table(spark, d, "part").select(F.col("p_partkey").alias("feature_id")))


@query(f"WITH {VXY}, {XYSQL} SELECT 'group' AS kind, CAST(label AS VARCHAR) AS label, round(quantile_cont(x, 0.5), 6) AS x, round(quantile_cont(y, 0.5), 6) AS y FROM cv JOIN embeddings e ON cv.vec_id = e.vec_id GROUP BY 2 UNION ALL SELECT 'factor', 'factor_' || i, x, y FROM xy WHERE i != 2")
def embedding_labels(spark, d):
    hidden = factor_xy(spark).withColumn("name", F.when(F.col("factor_idx") == 2, "").otherwise(F.col("name")))
    emb = Embedding(hidden, _vec_xy(spark, d))
    return rounded(plotdata.embedding_labels(emb, plotdata.grouped_points(emb.samples, labels(spark, d))), 6, "x", "y")


@query(f"WITH {ERRORS}, l AS (SELECT k, (err - lead(err) OVER (ORDER BY k)) - (err_rand - lead(err_rand) OVER (ORDER BY k)) AS diff FROM er) SELECT k, round(diff, 6) AS diff FROM l WHERE diff IS NOT NULL")
def factor_selection(spark, d):
    e = _errors(spark, d)
    return plotdata.factor_selection(e).select("k", F.round("diff", 6).alias("diff"))


@query("WITH p AS (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings), c AS (SELECT label AS grp, pos, quantile_cont(v, 0.5) AS value FROM p GROUP BY 1, 2) SELECT a.grp AS c1, b.grp AS c2, round(sqrt(sum((a.value - b.value) * (a.value - b.value))), 6) AS dist FROM c a JOIN c b ON a.pos = b.pos AND a.grp < b.grp GROUP BY 1, 2")
def pairwise_median_dist(spark, d):
    return rounded(evaluate.pairwise_centroid_dist(points(spark, d), labels(spark, d), median=True), 6, "dist")


@query("""WITH m AS (SELECT c_custkey AS id, c_mktsegment AS grp, c_custkey % 40 AS step FROM customer), e AS (SELECT a.id AS s, b.id AS t FROM m a JOIN m b ON a.grp = b.grp AND b.step BETWEEN a.step - 1 AND a.step AND a.id != b.id
 UNION ALL SELECT a.id, b.id FROM m a JOIN m b ON a.grp = 'BUILDING' AND a.step = 39 AND b.grp = 'MACHINERY' AND b.step = 0) SELECT DISTINCT least(s, t) AS src, greatest(s, t) AS dst FROM e""")
def trajectory_junctions(spark, d):
    meta = table(spark, d, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_mktsegment").alias("grp"), (F.col("c_custkey") % 40).alias("step"))
    return evaluate.trajectory_graph(meta, spark.createDataFrame([("BUILDING", 39, "MACHINERY", 0)], "grp_a string, step_a long, grp_b string, step_b long"))


# ---------------------------------------------------------------- files
@query("SELECT 'Brand.' || substr(p_brand, 7) AS feature_id, 's' || o_custkey AS sample_id, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def read_matrix(spark, d):
    """Counts written as a MatrixMarket folder, with the endings that barcodes have, and read back."""
    at = folder(spark, "matrix")
    text.write_matrix_dir(_brand_counts(spark, d, F.concat(F.lit("Brand."), F.substring("p_brand", 7, 9))), at)
    return text.read_data(spark, at).entries


def _brand_counts(spark, d, name) -> CountMatrix:
    """Quantities by a name of the part's brand and customers' barcodes."""
    l, o, p, c = (table(spark, d, x) for x in ("lineitem", "orders", "part", "customer"))
    code = lambda key: F.concat(F.lit("s"), key, F.lit("-1")).alias("sample_id")
    e = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy(name.alias("feature_id"), code("o_custkey")).agg(F.sum("l_quantity").alias("value"))
    return CountMatrix(e, p.select(name.alias("feature_id")).distinct(), c.select(code("c_custkey")))


@query("""SELECT 'Brand.' || substr(p_brand, 7) AS feature_id, 's' || o_custkey AS sample_id, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON c_custkey = o_custkey
WHERE substr(p_brand, 7, 1) NOT IN ('1', '2') AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY') GROUP BY 1, 2""")
def read_species(spark, d):
    """A matrix of two species' features and a table of calls, written and read back as those of one."""
    at, calls = folder(spark, "matrix"), folder(spark, "calls")
    name = F.concat(F.when(F.substring("p_brand", 7, 1).isin("1", "2"), "mm10_Brand.").otherwise("hg19_Brand."), F.substring("p_brand", 7, 9))
    text.write_matrix_dir(_brand_counts(spark, d, name), at)
    c = table(spark, d, "customer")
    c.select(F.concat(F.lit("s"), "c_custkey", F.lit("-1")).alias("barcode"), F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "mm10").otherwise("hg19").alias("call")).write.csv(calls, header=True)
    return text.read_10x_species(spark, at, calls).entries


@query("SELECT p_brand AS feature_id, p_type AS sample_id, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def read_wide(spark, d):
    p = table(spark, d, "part")
    types = [r[0] for r in p.select("p_type").distinct().orderBy("p_type").collect()]
    wide = groups.unflatten_dataframe(table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "p_type").agg(F.sum("l_quantity").alias("q")), "q", "p_brand", "p_type", types).na.fill(0.0)
    at = f"{folder(spark, 'wide')}/table.tsv"
    wide.write.csv(at, sep="\t", header=True, quote="")
    return text.read_wide(spark, at).entries


@query("SELECT DISTINCT replace(p_type, ' ', '_') AS geneset, p_brand AS feature_id FROM part")
def genesets_files(spark, d):
    """Sets written as GMT and read back."""
    sets = table(spark, d, "part").groupBy(F.col("p_type").alias("geneset")).agg(F.sort_array(F.collect_set("p_brand")).alias("members"))
    at = f"{folder(spark, 'sets')}/sets.gmt"
    text.write_genesets(sets, at)
    return text.read_genesets(spark, at).select("geneset", F.explode("members").alias("feature_id"))


@query("SELECT c_mktsegment AS grp, 'c' || c_custkey AS sample_id FROM customer")
def groups_files(spark, d):
    """Groups written and read back."""
    g = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("grp")).agg(F.sort_array(F.collect_list(F.concat(F.lit("c"), F.col("c_custkey")))).alias("members"))
    at = f"{folder(spark, 'groups')}/groups.csv"
    text.write_groups(g, at)
    return text.read_groups(spark, at).select("grp", F.explode("members").alias("sample_id"))
