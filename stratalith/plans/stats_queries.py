"""Statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import years as Y
from ..operators import stats as S
from .registry import query, table


@query("""
SELECT l_returnflag, count(*) AS n, min(l_extendedprice) AS min, round(quantile_cont(l_extendedprice, 0.025), 4) AS p25, round(quantile_cont(l_extendedprice, 0.25), 4) AS p250, round(quantile_cont(l_extendedprice, 0.5), 4) AS p500,
  round(quantile_cont(l_extendedprice, 0.75), 4) AS p750, round(quantile_cont(l_extendedprice, 0.975), 4) AS p975, max(l_extendedprice) AS max FROM lineitem GROUP BY 1
""")
def percentile_summary(spark, d):
    out = S.five_numbers(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice")
    for c in ("p25", "p250", "p500", "p750", "p975"):
        out = out.withColumn(c, F.round(c, 4))
    return out


@query("""
WITH m AS (SELECT l_returnflag, median(l_extendedprice) AS med FROM lineitem GROUP BY 1),
a AS (SELECT l_returnflag, median(abs(l_extendedprice - med)) AS mad FROM lineitem JOIN m USING (l_returnflag) GROUP BY 1)
SELECT l_orderkey, l_linenumber, round((l_extendedprice - med) / (1.4826 * mad + 1e-9), 6) AS z FROM lineitem JOIN m USING (l_returnflag) JOIN a USING (l_returnflag)
WHERE abs((l_extendedprice - med) / (1.4826 * mad + 1e-9)) >= 1.3
""")
def mad_outliers(spark, d):
    z = S.robust_z(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice")
    return z.where(F.abs("z") >= 1.3).select("l_orderkey", "l_linenumber", F.round("z", 6).alias("z"))


_RANKED = """
r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0 AS ry FROM t)
"""


@query("WITH t AS (SELECT lang AS g, n_chars AS x, l.quality AS y FROM documents JOIN labels l USING (doc_id)), " + _RANKED + "SELECT g AS lang, count(*) AS n, CASE WHEN stddev_pop(ry) > 0 AND stddev_pop(rx) > 0 THEN round(corr(rx, ry), 6) END AS rho FROM r GROUP BY 1")
def spearman_by_group(spark, d):
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return S.spearman(t, ["lang"], "n_chars", "quality").withColumn("rho", F.round("rho", 6))


@query("SELECT o_orderpriority, count(*) AS n, round(corr(o_totalprice, o_custkey), 6) AS r FROM orders GROUP BY 1")
def pearson_by_group(spark, d):
    return S.pearson(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", "o_custkey").withColumn("r", F.round("r", 6))


@query("""
WITH g AS (SELECT count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders GROUP BY o_orderpriority), a AS (SELECT avg(o_totalprice) AS m, var_pop(o_totalprice) AS v, count(*) AS n FROM orders)
SELECT round(sum(g.n * (g.m - a.m) ** 2) / any_value(a.n * a.v), 9) AS eta2 FROM g, a
""")
def eta_squared(spark, d):
    return S.eta_squared(table(spark, d, "orders"), "o_orderpriority", "o_totalprice").select(F.round("eta2", 9).alias("eta2"))


@query("""
WITH t AS (SELECT lang AS g, n_chars AS v, quality = 1 AS s FROM documents JOIN labels USING (doc_id)),
r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY v) + (count(*) OVER (PARTITION BY g, v) - 1) / 2.0 AS rk FROM t),
q AS (SELECT g, sum(s::INT)::BIGINT AS n1, (count(*) - sum(s::INT))::BIGINT AS n2, sum(CASE WHEN s THEN rk END) - sum(s::INT) * (sum(s::INT) + 1) / 2.0 AS u FROM r GROUP BY 1),
ti AS (SELECT g, sum(c ** 3 - c) AS ties FROM (SELECT g, v, count(*)::DOUBLE AS c FROM t GROUP BY 1, 2) GROUP BY 1)
SELECT q.g AS lang, n1, n2, round(u, 4) AS u, round(sign(u - n1 * n2 / 2.0) * greatest(0, abs(u - n1 * n2 / 2.0) - 0.5) / nullif(sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1.0)))), 0), 6) AS z FROM q JOIN ti ON q.g = ti.g
""")
def mann_whitney(spark, d):
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    out = S.mann_whitney(t, ["lang"], "n_chars", F.col("quality") == 1)
    return out.select("lang", "n1", "n2", F.round("u", 4).alias("u"), F.round("z", 6).alias("z"))


@query("""
WITH RECURSIVE t AS (SELECT o_custkey AS g, o_totalprice AS v, o_orderstatus = 'F' AS s FROM orders WHERE o_totalprice IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY v) + (count(*) OVER (PARTITION BY g, v) - 1) / 2.0 AS rk FROM t),
q AS (SELECT g, sum(s::INT)::BIGINT AS n1, (count(*) - sum(s::INT))::BIGINT AS n2, coalesce(sum(CASE WHEN s THEN rk END), 0) - sum(s::INT) * (sum(s::INT) + 1) / 2.0 AS u FROM r GROUP BY 1),
ti AS (SELECT g, sum(c ** 3 - c) AS ties FROM (SELECT g, v, count(*)::DOUBLE AS c FROM t GROUP BY 1, 2) GROUP BY 1),
ways(t, k, s, w) AS (SELECT 0, 0, 0, 1::DOUBLE UNION ALL SELECT t, k, s, sum(w) FROM
  (SELECT t + 1 AS t, k + i AS k, s + i * (t + 1) AS s, w FROM ways, (VALUES (0), (1)) b(i) WHERE k + i <= 8 AND t < (SELECT max(n1 + n2) FROM q WHERE least(n1, n2) <= 8 AND greatest(n1, n2) <= 200)) GROUP BY 1, 2, 3),
a AS (SELECT q.g, n1, n2, u, ties = 0 AND least(n1, n2) BETWEEN 1 AND 8 AND greatest(n1, n2) <= 200 AS exact,
  abs(sign(u - n1 * n2 / 2.0) * greatest(0, abs(u - n1 * n2 / 2.0) - 0.5) / nullif(sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1.0)))), 0)) AS z FROM q JOIN ti ON q.g = ti.g),
e AS (SELECT g, least(1, 2 * sum(CASE WHEN s - k * (k + 1) / 2 >= greatest(u, n1 * n2 - u) THEN w ELSE 0 END) / sum(w)) AS p FROM a JOIN ways ON exact AND t = n1 + n2 AND k = least(n1, n2) GROUP BY 1)
SELECT a.g AS o_custkey, n1, n2, round(u, 1) AS u, exact, round(CASE WHEN exact THEN e.p WHEN least(n1, n2) > 0 THEN 2 * (0.5 - z / 1200 * list_sum([(CASE WHEN i = 0 OR i = 400 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-0.5 * pow(z * i / 400, 2)) FOR i IN range(401)]) / sqrt(2 * pi())) END, 7) AS p
FROM a LEFT JOIN e ON a.g = e.g
""")
def mann_whitney_p(spark, d):
    """Each customer's settled orders against the others, by price: exact p for few orders, the normal tail for many."""
    out = S.mann_whitney(table(spark, d, "orders"), ["o_custkey"], "o_totalprice", F.col("o_orderstatus") == "F")
    return out.select("o_custkey", "n1", "n2", F.round("u", 1).alias("u"), "exact", F.round("p", 7).alias("p"))


@query("""
WITH m AS (SELECT *, o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS a, o_custkey - avg(o_custkey) OVER (PARTITION BY o_orderpriority) AS b FROM orders)
SELECT round(corr(a, b), 6) AS r, count(*) AS n FROM m
""")
def group_residual_corr(spark, d):
    r = S.group_residuals(table(spark, d, "orders"), "o_orderpriority", ["o_totalprice", "o_custkey"])
    return r.agg(F.round(F.corr("o_totalprice_res", "o_custkey_res"), 6).alias("r"), F.count(F.lit(1)).alias("n"))


_PRED = "SELECT o_orderpriority, o_orderkey % 700 AS est, (o_orderkey * 7) % 500 AS lo, (o_orderkey * 7) % 500 + 100 AS hi FROM orders"


@query(f"""
WITH t AS ({_PRED}), e AS (SELECT *, CASE WHEN est BETWEEN lo AND hi THEN 0.0 ELSE least(abs(est - lo), abs(est - hi)) END AS e, abs(est - (lo + hi) / 2) AS m FROM t)
SELECT o_orderpriority, count(*) AS n, round(100 * avg((e = 0)::INT), 6) AS in_range, round(avg(e), 6) AS edge_mean, median(e)::DOUBLE AS edge_median, round(avg(m), 6) AS mae_mid FROM e GROUP BY 1
""")
def interval_score(spark, d):
    k = F.col("o_orderkey")
    t = table(spark, d, "orders").select("o_orderpriority", (k % 700).alias("est"), ((k * 7) % 500).alias("lo"), ((k * 7) % 500 + 100).alias("hi"))
    out = S.interval_score(t, ["o_orderpriority"], "est", "lo", "hi")
    return out.select("o_orderpriority", "n", *[F.round(c, 6).alias(c) for c in ("in_range", "edge_mean")], "edge_median", F.round("mae_mid", 6).alias("mae_mid"))


@query(f"""
WITH t AS (SELECT o_orderpriority, abs(est - (lo + hi) / 2) AS e FROM ({_PRED}))
SELECT o_orderpriority, count(*) AS n, round(avg(e), 6) AS mae, median(e) AS median_ae, round(100 * avg((e <= 50)::INT), 6) AS within_50, round(100 * avg((e <= 100)::INT), 6) AS within_100, round(100 * avg((e <= 200)::INT), 6) AS within_200,
  round(100 * avg((e <= 300)::INT), 6) AS within_300, round(100 * avg((e <= 500)::INT), 6) AS within_500 FROM t GROUP BY 1
""")
def error_summary(spark, d):
    k = F.col("o_orderkey")
    mid = ((k * 7) % 500 + (k * 7) % 500 + 100) / 2
    out = S.error_summary(table(spark, d, "orders"), ["o_orderpriority"], k % 700 - mid)
    return out.select("o_orderpriority", "n", F.round("mae", 6).alias("mae"), "median_ae", *[F.round(c, 6).alias(c) for c in out.columns[4:]])


@query("""
WITH w AS (SELECT o_custkey, date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) AS w FROM orders GROUP BY 1)
SELECT min(w) AS min, median(w) AS median, round(avg(w), 6) AS mean, max(w) AS max, round(100 * avg((w >= 100)::INT), 6) AS at_least_100, round(100 * avg((w >= 200)::INT), 6) AS at_least_200, round(100 * avg((w >= 400)::INT), 6) AS at_least_400 FROM w
""")
def width_summary(spark, d):
    w = table(spark, d, "orders").groupBy("o_custkey").agg(F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).cast("long").alias("w"))
    out = S.width_summary(w, F.col("w"))
    return out.select("min", "median", F.round("mean", 6).alias("mean"), "max", *[F.round(c, 6).alias(c) for c in out.columns[4:]])


@query("""
SELECT m + floor((o_totalprice - m) / 50) * 50 AS bin, count(*) AS n FROM orders, (SELECT min(o_totalprice) AS m FROM orders) GROUP BY 1
""")
def histogram_50(spark, d):
    return S.histogram(table(spark, d, "orders"), "o_totalprice", 50)


@query("""
WITH n AS (SELECT c_nationkey, count(*) AS n, median(c_acctbal) AS s FROM customer GROUP BY 1), c AS (SELECT *, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
r AS (SELECT n_regionkey, count(*) AS n, median(c_acctbal) AS s FROM c GROUP BY 1), a AS (SELECT median(c_acctbal) AS s FROM customer)
SELECT c_custkey, round(CASE WHEN n.n >= 60 THEN n.s WHEN r.n >= 60 THEN r.s ELSE a.s END, 4) AS prior, CASE WHEN n.n >= 60 THEN 'c_nationkey' WHEN r.n >= 60 THEN 'n_regionkey' ELSE 'all' END AS level
FROM c JOIN n USING (c_nationkey) JOIN r USING (n_regionkey), a
""")
def fallback_prior(spark, d):
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return S.fallback(c, ["c_nationkey", "n_regionkey"], "c_acctbal", 60, "median").select("c_custkey", F.round("prior", 4).alias("prior"), "level")


@query("SELECT c_custkey, round((sum(c_acctbal) OVER (PARTITION BY c_nationkey) - c_acctbal) / (count(*) OVER (PARTITION BY c_nationkey) - 1), 7) AS loo FROM customer")
def loo_mean(spark, d):
    return S.without_self(table(spark, d, "customer"), ["c_nationkey"], "c_acctbal").select("c_custkey", F.round("loo", 7).alias("loo"))


@query("SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean, round(median(c_acctbal), 4) AS median, min(c_acctbal) AS min, max(c_acctbal) AS max FROM customer GROUP BY 1")
def group_summary(spark, d):
    return S.group_summary(table(spark, d, "customer"), ["c_mktsegment"], "c_acctbal").withColumn("mean", F.round("mean", 4)).withColumn("median", F.round("median", 4))


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY 1, 2")
def tally(spark, d):
    return S.tally(table(spark, d, "customer"), ["c_mktsegment", "c_nationkey"])


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal - 4000) DESC, c_custkey LIMIT 12")
def worst_residuals(spark, d):
    return S.worst(table(spark, d, "customer").select("c_custkey", "c_acctbal"), F.abs(F.col("c_acctbal") - 4000), 12, "c_custkey")


@query("SELECT c_custkey, round(greatest(-100.0, least(500.0, c_acctbal)), 4) AS clamped, round(CASE WHEN c_acctbal BETWEEN 0 AND 1000 THEN 0 ELSE least(abs(c_acctbal), abs(c_acctbal - 1000)) END, 4) AS edge FROM customer")
def clamp_and_edge(spark, d):
    x = F.col("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", F.round(Y.clamped(x, F.lit(500.0), F.lit(-100.0)), 4).alias("clamped"), F.round(Y.edge_error(x, F.lit(0.0), F.lit(1000.0)), 4).alias("edge"))
