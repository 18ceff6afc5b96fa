"""Neighbour, fold, regression and sampler queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import boosting, gibbs
from ..operators import graph as G
from ..operators import model as M
from ..operators import neighbours as N
from ..operators import features as X
from ..operators import spectral
from ..operators import stats as S
from .registry import query, table


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").cast("string").alias("grp"))


_KNN = """
q AS (SELECT vec_id AS query, embedding AS qv, label AS ql FROM embeddings WHERE vec_id % 100 = 0),
p AS (SELECT query, vec_id AS id, ql, label, round(sqrt(list_sum([(x[1]::DOUBLE - x[2]::DOUBLE) ** 2 for x in list_zip(qv, embedding)])), 9) AS dist FROM q JOIN embeddings ON query <> vec_id {where})
"""


@query("WITH " + _KNN.format(where="") + "SELECT query, id, round(dist, 5) AS distance FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY dist, id) <= 5")
def knn(spark, d):
    v = _vectors(spark, d)
    return N.nearest(v.where("id % 100 = 0"), v, 5).select("query", "id", F.round("distance", 5).alias("distance"))


@query("WITH " + _KNN.format(where="") + "SELECT query, round(sum(label / (dist + 1e-6)) / sum(1 / (dist + 1e-6)), 5) AS estimate, count(*) AS n FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY dist, id) <= 5) GROUP BY 1")
def knn_idw(spark, d):
    v = _vectors(spark, d)
    near = N.nearest(v.where("id % 100 = 0"), v, 5)
    return M.idw(near, v.select("id", F.col("grp").cast("double").alias("y"))).withColumn("estimate", F.round("estimate", 5))


@query("WITH " + _KNN.format(where="WHERE ql <> label") + "SELECT query, id, round(dist, 5) AS distance FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY dist, id) <= 3")
def knn_cross_group(spark, d):
    v = _vectors(spark, d)
    return N.nearest(v.where("id % 100 = 0"), v, 3, group="grp", mode="other").select("query", "id", F.round("distance", 5).alias("distance"))


_TIER = "SELECT query, sum(y / (dist + 1e-6)) / sum(1 / (dist + 1e-6)) AS e, count(*) AS n FROM (SELECT * FROM p {where} QUALIFY row_number() OVER (PARTITION BY query ORDER BY dist, id) <= 5) JOIN y USING (id) GROUP BY 1"


@query("WITH " + _KNN.format(where="") + ", y AS (SELECT vec_id AS id, vec_id % 100 AS y FROM embeddings), own AS (" + _TIER.format(where="WHERE ql = label") + "), every AS (" + _TIER.format(where="") + """)
SELECT query, round(CASE WHEN own.n >= 2 THEN own.e ELSE every.e END, 5) AS estimate, CASE WHEN own.n >= 2 THEN 1 ELSE 2 END AS tier FROM every FULL JOIN own USING (query)
""")
def knn_tiered(spark, d):
    """Estimates from the query's own group where it has enough neighbours, else from all."""
    v = _vectors(spark, d)
    y = v.select("id", (F.col("id") % 100).cast("double").alias("y"))
    own = M.idw(N.nearest(v.where("id % 100 = 0"), v, 5, group="grp", mode="same"), y)
    return M.tiered(own, M.idw(N.nearest(v.where("id % 100 = 0"), v, 5), y)).withColumn("estimate", F.round("estimate", 5))


@query("""
SELECT a.vec_id AS id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine, round(list_sum([abs(x[1]::DOUBLE - x[2]::DOUBLE) for x in list_zip(a.embedding, b.embedding)]) / 64, 6) AS delta,
 round(sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in a.embedding])), 6) AS norm FROM embeddings a, embeddings b WHERE b.vec_id = 0
""")
def profile_distance(spark, d):
    v = _vectors(spark, d)
    profile = F.broadcast(v.where("id = 0").select(F.col("v").alias("p")))
    a, p = F.col("v"), F.col("p")
    return v.crossJoin(profile).select("id", F.round(V.cosine_distance(a, p), 6).alias("cosine"), F.round(V.delta(a, p), 6).alias("delta"), F.round(V.norm(a), 6).alias("norm"))


@query("SELECT c_custkey, ((row_number() OVER (ORDER BY c_custkey) - 1) * 10 // (SELECT count(*) FROM customer))::INT AS fold FROM customer")
def contiguous_folds(spark, d):
    return M.contiguous_folds(table(spark, d, "customer").select("c_custkey"), ["c_custkey"]).select("c_custkey", "fold")


@query()
def grouped_folds(spark, d):
    return M.grouped_folds(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", 5)


def _chunk_rows(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.col("c_acctbal").alias("y"), (F.col("c_acctbal") / 100 + F.col("c_custkey") % 17).alias("x1"), (F.col("c_custkey") % 13).cast("double").alias("x2"))
    return M.grouped_folds(c, "c_nationkey", 3)


@query()
def gbt_cv(spark, d):
    """Cross-validated error of boosted trees, folds whole by nation."""
    rows = _chunk_rows(spark, d)
    scored = M.out_of_fold(rows, lambda t: M.boosted(t, ["x1", "x2"], "y", rounds=10), 3)
    return scored.agg(F.round(F.avg(F.abs(F.col("prediction") - F.col("y"))), 1).alias("mae"), F.count(F.lit(1)).alias("n"))


@query()
def histogram_gbt_cv(spark, d):
    """Cross-validated error of trees grown leaf by leaf, all folds in the same passes."""
    scored = boosting.out_of_fold(_chunk_rows(spark, d), ["x1", "x2"], "y", 3, rounds=10, leaves=31, step=0.3)
    return scored.agg(F.round(F.avg(F.abs(F.col("prediction") - F.col("y"))), 1).alias("mae"), F.count(F.lit(1)).alias("n"))


def _order_rows(spark, d):
    """Orders as chunks of customers: y is what the lines sum to, the stratum is the customer's mean number of lines, rounded."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).cast("double").alias("lines"), F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.sum("l_extendedprice").alias("y")
    )
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    strata = rows.groupBy("o_custkey").agg(F.round(F.avg("lines")).cast("int").alias("stratum"))
    return rows.join(strata, "o_custkey")


@query()
def held_out_cluster(spark, d):
    """One market segment's customers dated by a model of the others: rank correlation with their strata."""
    fit = lambda t: boosting.fitted(t, ["lines", "quantity", "discount"], "y", rounds=10, leaves=31, step=0.3)
    works = M.held_out_cluster(_order_rows(spark, d), F.col("c_mktsegment") == "BUILDING", fit, "o_custkey", "stratum")
    return S.spearman(works, [], "stratum", "p500").select(F.round("rho", 3).alias("rho"), "n")


@query()
def ridge_fit(spark, d):
    rows = _chunk_rows(spark, d)
    model = M.ridge(rows, ["x1", "x2"], "y", penalties=(0.01, 1.0, 100.0), folds=3)
    return model.transform(rows).agg(F.round(F.avg(F.abs(F.col("prediction") - F.col("y"))), 1).alias("mae"), F.count(F.lit(1)).alias("n"))


@query()
def mlp_fit(spark, d):
    rows = _chunk_rows(spark, d)
    return M.perceptron(rows, ["x1", "x2"], "y", hidden=(16,), epochs=30)(rows).agg(F.round(F.avg(F.abs(F.col("prediction") - F.col("y"))), 1).alias("mae"), F.count(F.lit(1)).alias("n"))


@query()
def feature_ablation(spark, d):
    rows = _chunk_rows(spark, d)
    return M.ablation(rows, {"first": ["x1"], "second": ["x2"]}, lambda t, f: M.boosted(t, f, "y", rounds=3), "y", 3).withColumn("mae", F.round("mae", 1))


@query()
def feature_importance(spark, d):
    rows = _chunk_rows(spark, d)
    return M.importances(M.boosted(rows, ["x1", "x2"], "y", rounds=5), ["x1", "x2"], spark).withColumn("importance", F.round("importance", 4))


@query()
def pca_scores(spark, d):
    out, _ = M.principal_components(_chunk_rows(spark, d), ["x1", "x2", "y"], 2)
    return out.select("c_custkey", F.round(F.abs(F.col("pc")[0]), 6).alias("pc1"), F.round(F.abs(F.col("pc")[1]), 6).alias("pc2"))


@query()
def svd_lengths(spark, d):
    """Length of each order's row in the first directions of a customer-by-priority matrix."""
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc"), F.col("o_orderpriority").alias("term")).agg(F.count(F.lit(1)).alias("cnt"))
    v = M.truncated_svd(X.tf_idf(counts), 3)
    return v.select("doc", F.round(V.norm(F.col("v")), 6).alias("length"))


@query()
def fiedler_order(spark, d):
    """Seriation of the groups of vectors, by the second eigenvector of the neighbour graph of their means."""
    each = _vectors(spark, d).select("grp", F.posexplode("v").alias("pos", "x")).groupBy("grp", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = each.groupBy(F.col("grp").alias("id")).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v")).select("id", V.unit(F.col("v.x")).alias("v"))
    return spectral.fiedler(G.nearest_graph(mean, 10)).withColumn("fiedler", F.round("fiedler", 6))


def _works(spark, d):
    """Nations as works, dated by their suppliers."""
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.avg("s_acctbal").alias("mean"), F.count(F.lit(1)).alias("n_chunks"))
    anchor, m = F.col("k") % 4 == 0, F.col("mean") / 10
    return s.select(
        F.col("k").cast("string").alias("work"),
        m.alias("m"),
        "n_chunks",
        F.when(anchor, m - 50).alias("lo"),
        F.when(anchor, m + 50).alias("hi"),
        F.when(F.col("k") % 7 == 0, F.lit(100.0)).alias("not_before"),
        F.when(F.col("k") % 11 == 0, F.lit(600.0)).alias("not_after"),
    )


@query()
def gibbs_posterior(spark, d):
    """Posterior dates of works under anchors, termini and orders."""
    edges = table(spark, d, "nation").where("n_nationkey % 6 = 0").select(F.col("n_nationkey").cast("string").alias("src"), (F.col("n_nationkey") + 1).cast("string").alias("dst"))
    out = gibbs.posterior(gibbs.draws(_works(spark, d), edges, chains=40, iterations=14, burn=6, thin=1))
    return out.select("work", *[F.round(c, 1).alias(c) for c in ("median", "lo95", "hi95")], "n")


@query("""
WITH w AS (SELECT s_suppkey::VARCHAR AS work, s_acctbal / 10 AS m, sqrt(1 + 4.0 / (s_suppkey % 5 + 1)) AS f FROM supplier), p AS (SELECT *, 1 / (22500 * f * f) AS own FROM w)
SELECT work, round((m * own + 300 / 40000.0) / (own + 1 / 40000.0), 4) AS held_mean, round(1 / sqrt(own + 1 / 40000.0), 4) AS held_sd FROM p
""")
def held_out_posterior(spark, d):
    return _held(spark, d).select("work", F.round("held_mean", 4).alias("held_mean"), F.round("held_sd", 4).alias("held_sd"))


def _held(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("work"), (F.col("s_acctbal") / 10).alias("m"), (F.col("s_suppkey") % 5 + 1).alias("n_chunks"), (F.col("s_acctbal") / 10 - 50).alias("lo"), (F.col("s_acctbal") / 10 + 50).alias("hi"))
    return gibbs.held_out(gibbs.noise_terms(s), 300.0, 40000.0, 22500.0)


#: The normal distribution function by Simpson's rule over 400 strips from the mean: exact to far more than is compared.
_SIMPSON = "(0.5 + {z} / 1200 * list_sum([(CASE WHEN k = 0 OR k = 400 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-0.5 * pow({z} * k / 400, 2)) FOR k IN range(401)]) / sqrt(2 * pi()))"


@query("""
WITH w AS (SELECT s_suppkey::VARCHAR AS work, s_acctbal / 10 AS m, sqrt(1 + 4.0 / (s_suppkey % 5 + 1)) AS f FROM supplier), p AS (SELECT *, 1 / (22500 * f * f) AS own FROM w),
h AS (SELECT work, m, (m * own + 300 / 40000.0) / (own + 1 / 40000.0) AS held_mean, 1 / sqrt(own + 1 / 40000.0) AS held_sd FROM p), z AS (SELECT work, (m + 50 - held_mean) / held_sd AS zh, (m - 50 - held_mean) / held_sd AS zl FROM h)
SELECT work, round(""" + _SIMPSON.format(z="zh") + " - " + _SIMPSON.format(z="zl") + ", 5) AS held_mass FROM z")
def held_out_mass(spark, d):
    return _held(spark, d).select("work", F.round("held_mass", 5).alias("held_mass"))
