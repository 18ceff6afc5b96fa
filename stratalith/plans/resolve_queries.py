"""Identifier, title and interval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import years as Y
from ..operators import constraints as C
from ..operators import resolve as R
from .registry import query, table


def _part_ids(spark, d):
    return table(spark, d, "part").select(F.concat_ws("_", "p_brand", F.col("p_partkey").cast("string")).alias("id"))


@query("""
WITH ids AS (SELECT concat_ws('_', p_brand, p_partkey) AS id FROM part), keys AS (SELECT DISTINCT p_brand AS k FROM part)
SELECT id, max_by(k, length(k)) AS key FROM ids JOIN keys ON starts_with(id, k) GROUP BY id
""")
def longest_prefix_resolve(spark, d):
    return R.longest_prefix(_part_ids(spark, d), table(spark, d, "part").select("p_brand").distinct(), "id", "p_brand").select("id", "key")


@query("""
SELECT o_orderkey, CASE WHEN starts_with(o_orderpriority, '1') THEN '1' WHEN starts_with(o_orderpriority, '2') THEN '2'
  WHEN starts_with(o_orderpriority, '2-H') THEN '2-H' WHEN starts_with(o_orderpriority, '3-') THEN '3-' ELSE o_orderpriority END AS grp FROM orders
""")
def first_prefix_collapse(spark, d):
    return R.first_listed_prefix(table(spark, d, "orders"), ["1", "2", "2-H", "3-"], "o_orderpriority", "grp").select("o_orderkey", "grp")


@query("""
WITH ids AS (SELECT DISTINCT concat_ws('_', 'SA', replace(p_brand, '#', ''), p_size) AS id FROM part),
keys AS (SELECT DISTINCT concat_ws('_', 'SA', replace(p_brand, '#', ''), p_size // 10) AS k FROM part),
hits AS (SELECT id, k FROM ids JOIN keys ON split_part(id, '_', 2) = split_part(k, '_', 2) AND (starts_with(id, k) OR starts_with(k, id))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY (id = k) DESC, length(k) DESC, k DESC) AS rn FROM hits)
SELECT ids.id, ranked.k AS key FROM ids LEFT JOIN ranked ON ids.id = ranked.id AND rn = 1
""")
def either_way_prefix(spark, d):
    p = table(spark, d, "part").withColumn("b", F.regexp_replace("p_brand", "#", ""))
    ids = p.select(F.concat_ws("_", F.lit("SA"), "b", F.col("p_size").cast("string")).alias("id")).distinct()
    keys = p.select(F.concat_ws("_", F.lit("SA"), "b", F.floor(F.col("p_size") / 10).cast("string")).alias("k")).distinct()
    return R.either_way_prefix(ids, keys, "id", "k", out="key").select("id", "key")


@query("""
SELECT p_partkey, coalesce(a.p_name, b.p_name) AS name FROM part
LEFT JOIN (SELECT p_size AS s, min(p_name) AS p_name FROM part WHERE p_size < 10 GROUP BY 1) a ON part.p_size = a.s
LEFT JOIN (SELECT p_size AS s, min(p_name) AS p_name FROM part WHERE p_size < 10 GROUP BY 1) b ON part.p_size // 10 = b.s
""")
def key_cascade(spark, d):
    p = table(spark, d, "part")
    t = p.where("p_size < 10").groupBy(F.col("p_size").alias("s")).agg(F.min("p_name").alias("name"))
    return R.cascade(p.select("p_partkey", "p_size"), t, [F.col("p_size"), F.floor(F.col("p_size") / 10)], "s", ["name"]).select("p_partkey", "name")


@query("""
WITH c AS (SELECT o_custkey, min(year(o_orderdate)) AS a, max(year(o_orderdate)) AS b FROM orders GROUP BY 1),
r AS (SELECT o_custkey, CASE WHEN o_custkey % 3 = 0 THEN b ELSE a END AS nb, CASE WHEN o_custkey % 3 = 0 THEN a WHEN o_custkey % 5 = 0 THEN NULL ELSE b END AS na FROM c)
SELECT o_custkey, CASE WHEN nb IS NOT NULL AND na IS NOT NULL THEN least(nb, na)::DOUBLE END AS lo, CASE WHEN nb IS NOT NULL AND na IS NOT NULL THEN greatest(nb, na)::DOUBLE END AS hi,
  (nb + na) / 2 AS mid FROM r
""")
def interval_midpoint(spark, d):
    c = table(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("a"), F.max(F.year("o_orderdate")).alias("b"))
    swap = F.col("o_custkey") % 3 == 0
    r = c.select("o_custkey", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("nb"), F.when(swap, F.col("a")).when(F.col("o_custkey") % 5 == 0, None).otherwise(F.col("b")).alias("na"))
    iv = Y.interval(F.col("nb"), F.col("na"))
    return r.select("o_custkey", iv.lo.alias("lo"), iv.hi.alias("hi"), Y.midpoint(F.col("nb"), F.col("na")).alias("mid"))


@query("""
WITH w AS (SELECT concat_ws('_', p_brand, p_partkey) AS work, p_partkey, p_size FROM part),
m AS (SELECT work, p_size::DOUBLE AS nb, CASE WHEN p_partkey % 2 = 0 THEN p_size + 10.0 END AS na FROM w WHERE p_partkey % 3 = 0),
k AS (SELECT p_brand AS prefix, min(p_size)::DOUBLE AS nb, max(p_size)::DOUBLE AS na FROM part WHERE length(p_brand) = 7 GROUP BY 1)
SELECT w.work, coalesce(m.nb, k.nb) AS lo, coalesce(m.na, k.na) AS hi, CASE WHEN m.work IS NOT NULL THEN 'metadata' WHEN k.nb IS NOT NULL THEN 'prefix' ELSE 'inferred' END AS source
FROM w LEFT JOIN (SELECT * FROM m WHERE na IS NOT NULL) m ON m.work = w.work
LEFT JOIN k ON starts_with(w.work, k.prefix)
QUALIFY row_number() OVER (PARTITION BY w.work ORDER BY length(k.prefix) DESC NULLS LAST) = 1
""")
def coalesce_anchor(spark, d):
    p = table(spark, d, "part").withColumn("work", F.concat_ws("_", "p_brand", F.col("p_partkey").cast("string")))
    meta = p.where("p_partkey % 3 = 0").select("work", F.col("p_size").cast("double").alias("nb"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size") + 10.0).alias("na"))
    anchors = p.where(F.length("p_brand") == 7).groupBy(F.col("p_brand").alias("prefix")).agg(F.min("p_size").cast("double").alias("nb"), F.max("p_size").cast("double").alias("na"))
    return R.anchored(p.select("work"), meta, anchors)


@query("""
WITH c AS (SELECT o_custkey AS k, min(epoch(o_orderdate)) AS lo, max(epoch(o_orderdate)) AS hi FROM orders GROUP BY 1)
SELECT a.k AS x, b.k AS y, CASE WHEN a.hi < b.lo THEN 'x_older' ELSE 'y_older' END AS told FROM c a JOIN c b ON a.k <> b.k AND (a.hi < b.lo OR b.hi < a.lo) WHERE a.k % 100 = 0
""")
def disjoint_intervals(spark, d):
    # A stated query set, customers divisible by 100, against all: those that end before it, and those that begin after it.
    c = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.min(F.unix_timestamp("o_orderdate")).alias("lo"), F.max(F.unix_timestamp("o_orderdate")).alias("hi"))
    a, b = c.where("k % 100 = 0").select(F.col("k").alias("x"), F.col("lo").alias("xl"), F.col("hi").alias("xh")), c.select(F.col("k").alias("y"), F.col("lo").alias("yl"), F.col("hi").alias("yh"))
    return R.disjoint(a, b).withColumn("told", Y.order_of(F.col("xl"), F.col("xh"), F.col("yl"), F.col("yh"))).select("x", "y", "told")


@query("""
WITH p AS (SELECT p_partkey AS work, p_brand || p_type AS base, p_size AS level FROM part),
s AS (SELECT base FROM p GROUP BY 1 HAVING count(DISTINCT level) >= 2)
SELECT a.work AS earlier, b.work AS later, min(a.base) AS base FROM p a JOIN p b ON a.base = b.base AND a.level < b.level AND a.work <> b.work WHERE a.base IN (SELECT base FROM s) GROUP BY 1, 2
""")
def theta_pairs(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("work"), F.concat("p_brand", "p_type").alias("base"), F.col("p_size").alias("level"))
    return C.level_pairs(p)


@query("""
SELECT o_custkey AS work, min(year(o_orderdate))::DOUBLE - 20 AS not_after, min(year(o_orderdate))::DOUBLE AS time_from, min_by(o_orderkey, (year(o_orderdate), o_orderkey)) AS source FROM orders GROUP BY 1
""")
def min_by_termini(spark, d):
    t = table(spark, d, "orders").select(F.col("o_custkey").alias("work"), F.year("o_orderdate").cast("double").alias("time_from"), F.col("o_orderkey").alias("source"))
    return C.translation_termini(t)


@query("""
WITH w AS (SELECT c_custkey::VARCHAR AS work FROM customer),
k AS (SELECT o_custkey::VARCHAR AS work, o_orderkey AS line, CASE o_orderkey % 3 WHEN 0 THEN 'anchor' WHEN 1 THEN 'not_before' ELSE 'not_after' END AS type, year(o_orderdate)::DOUBLE AS x, year(o_orderdate)::DOUBLE + 3 AS y FROM orders)
SELECT w.work, max_by(x, line) FILTER (type = 'anchor') AS lo, max_by(y, line) FILTER (type = 'anchor') AS hi, max(x) FILTER (type = 'not_before') AS not_before, min(x) FILTER (type = 'not_after') AS not_after
FROM w LEFT JOIN k ON w.work = k.work GROUP BY 1
""")
def constraint_apply(spark, d):
    w = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("work"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    kind = F.when(F.col("o_orderkey") % 3 == 0, "anchor").when(F.col("o_orderkey") % 3 == 1, "not_before").otherwise("not_after")
    y = F.year("o_orderdate")
    k = table(spark, d, "orders").select(F.lit(0).alias("src"), F.col("o_orderkey").alias("line"), kind.alias("type"), F.col("o_custkey").cast("string").alias("arg1"), y.cast("string").alias("arg2"), (y + 3).cast("string").alias("arg3"))
    return C.applied(w, k).select("work", "lo", "hi", "not_before", "not_after")


@query("""
WITH e AS (SELECT DISTINCT l_suppkey AS src, 100 - l_suppkey AS dst FROM lineitem WHERE l_suppkey <> 50),
t AS (SELECT s_suppkey AS work, s_acctbal AS est FROM supplier)
SELECT src, dst, round(a.est - b.est, 4) AS gap FROM e JOIN t a ON src = a.work JOIN t b ON dst = b.work WHERE a.est > b.est + 2
""")
def order_violations(spark, d):
    e = table(spark, d, "lineitem").where("l_suppkey <> 50").select(F.col("l_suppkey").alias("src"), (100 - F.col("l_suppkey")).alias("dst")).distinct()
    t = table(spark, d, "supplier").select(F.col("s_suppkey").alias("work"), F.col("s_acctbal").alias("est"))
    return C.violations(e, t).withColumn("gap", F.round("gap", 4))


def _following(spark, d):
    """Each customer stands before the customer of the order that follows their dearest one by key."""
    o = table(spark, d, "orders")
    dearest = o.groupBy(F.col("o_custkey").alias("src")).agg(F.max(F.struct("o_totalprice", F.col("o_orderkey").alias("k"))).alias("m"))
    return dearest.select("src", (F.col("m.k") + 1).alias("k")).join(o.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("dst")), "k").where("src <> dst").select("src", "dst").distinct()


_REACHED = """
WITH RECURSIVE m AS (SELECT o_custkey AS src, o_orderkey + 1 AS k FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) = 1),
e AS (SELECT DISTINCT src, o_custkey AS dst FROM m JOIN orders ON o_orderkey = k WHERE src <> o_custkey),
r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src),
c AS (SELECT a.src AS node, min(a.dst) AS cycle FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY 1)
"""


@query(_REACHED + "SELECT node, cycle FROM c")
def order_cycles(spark, d):
    """Customers who stand before themselves, however long the way."""
    return C.order_cycles(_following(spark, d))


@query(_REACHED + """, w AS (SELECT c_custkey, c_acctbal AS lo, c_acctbal + 50 AS hi, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal - c_custkey % 4 END AS not_after, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal - 2 END AS not_before FROM customer)
SELECT c_custkey::VARCHAR AS work, NULL AS other, 'terminus before anchor' AS kind FROM w WHERE not_after < lo - 1 UNION ALL
SELECT c_custkey::VARCHAR, NULL, 'empty bounds' FROM w WHERE not_before > not_after UNION ALL
SELECT src::VARCHAR, dst::VARCHAR, 'order against anchors' FROM e JOIN w a ON a.c_custkey = src JOIN w b ON b.c_custkey = dst WHERE a.lo > b.hi UNION ALL
SELECT e.src::VARCHAR, e.dst::VARCHAR, 'order both ways' FROM e JOIN e f ON e.src = f.dst AND e.dst = f.src WHERE e.src::VARCHAR < e.dst::VARCHAR UNION ALL
SELECT node::VARCHAR, (min(node::VARCHAR) OVER (PARTITION BY cycle)), 'order cycle' FROM c QUALIFY count(*) OVER (PARTITION BY cycle) > 2
""")
def order_conflicts(spark, d):
    """Every kind of contradiction among bounds and orders of customers."""
    k, x = F.col("c_custkey"), F.col("c_acctbal")
    works = table(spark, d, "customer").select(k.cast("string").alias("work"), x.alias("lo"), (x + 50).alias("hi"), F.when(k % 3 == 0, x - k % 4).alias("not_after"), F.when(k % 5 == 0, x - 2).alias("not_before"))
    return C.conflicts(works, _following(spark, d).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")))


@query("""
SELECT doc_id, regexp_replace(seg, ':[^:]*$', '') AS text_id, CASE WHEN contains(seg, ':') THEN try_cast(split_part(seg, ':', -1) AS INT) END AS line,
  CASE WHEN contains(w, '_') THEN split_part(w, '_', 2) ELSE w END AS coll, coalesce(nullif(regexp_extract(CASE WHEN contains(w, '_') THEN split_part(w, '_', 2) ELSE w END, '^([A-Za-z]+)', 1), ''), CASE WHEN contains(w, '_') THEN split_part(w, '_', 2) ELSE w END) AS coarse
FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN source || ':' || doc_id ELSE source || ':b:x' END AS seg, CASE doc_id % 2 WHEN 0 THEN 'SA_' || source || '_x' ELSE source END AS w FROM documents)
""")
def identifier_parts(spark, d):
    n = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", F.when(n % 3 == 0, F.col("source")).when(n % 3 == 1, F.concat("source", F.lit(":"), n.cast("string"))).otherwise(F.concat("source", F.lit(":b:x"))).alias("seg"), F.when(n % 2 == 0, F.concat(F.lit("SA_"), "source", F.lit("_x"))).otherwise(F.col("source")).alias("w"))
    coll = T.collection(F.col("w"))
    return docs.select("doc_id", T.text_id(F.col("seg")).alias("text_id"), T.line_no(F.col("seg")).alias("line"), coll.alias("coll"), T.coarse_class(coll).alias("coarse"))


@query("""
SELECT o_orderkey, try_cast(nullif(replace(trim(x), ',', ''), '') AS DOUBLE) AS n FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '1,' || (o_orderkey % 900 + 100) WHEN 1 THEN '' WHEN 2 THEN 'c. 300' ELSE ' ' || o_orderkey || ' ' END AS x FROM orders)
""")
def tolerant_numbers(spark, d):
    k = F.col("o_orderkey")
    x = F.when(k % 4 == 0, F.concat(F.lit("1,"), (k % 900 + 100).cast("string"))).when(k % 4 == 1, "").when(k % 4 == 2, "c. 300").otherwise(F.concat(F.lit(" "), k.cast("string"), F.lit(" ")))
    return table(spark, d, "orders").select("o_orderkey", T.number(x).alias("n"))


@query("""
WITH y AS (SELECT c_custkey, round(c_acctbal / 10)::BIGINT AS lo, round(c_acctbal / 10)::BIGINT + c_custkey % 900 AS hi FROM customer)
SELECT c_custkey, CASE WHEN lo < 0 THEN -lo || ' BCE' ELSE lo || ' CE' END AS era, (floor(lo / 25.0) * 25)::BIGINT AS out_lo, (ceil(hi / 25.0) * 25)::BIGINT AS out_hi,
  round(0.85 + (greatest(100, least(900, hi - lo)) - 100) / 800.0 * (0.10 - 0.85), 9) AS opacity FROM y
""")
def year_labels(spark, d):
    y = table(spark, d, "customer").select("c_custkey", F.round(F.col("c_acctbal") / 10).cast("long").alias("lo")).withColumn("hi", F.col("lo") + F.col("c_custkey") % 900)
    band = Y.outward(F.col("lo"), F.col("hi"))
    return y.select("c_custkey", Y.era(F.col("lo")).alias("era"), band.lo.alias("out_lo"), band.hi.alias("out_hi"), F.round(Y.interpolated(F.col("hi") - F.col("lo"), 100, 900, 0.85, 0.10), 9).alias("opacity"))


@query("""
SELECT page_id, replace(replace(replace(replace(replace(trim(html), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS html FROM pages
""")
def html_escape(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_escaped(F.col("html")).alias("html"))


@query("""
SELECT doc_id, contains(lower(text), 'eci') OR contains(lower(strip_accents(text)), 'eci') AS hit, length(lower(text)) AS n FROM documents
""")
def search_index(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.contains(T.search_index(F.col("text")), F.lit("eci")).alias("hit"), F.length(F.lower("text")).cast("long").alias("n"))


@query("""
WITH t AS (SELECT doc_id, lower(strip_accents(substring(text, 1, 200))) || CASE doc_id % 4 WHEN 0 THEN ' sutra' WHEN 1 THEN ' bhasya on sutra' WHEN 2 THEN ' tika' ELSE '' END AS title FROM documents),
k AS (SELECT *, CASE WHEN contains(title, 'anutika') THEN 'anutika' WHEN contains(title, 'tika') THEN 'tika' WHEN contains(title, 'bhasya') THEN 'bhasya' WHEN contains(title, 'sutra') THEN 'sutra' END AS kw FROM t)
SELECT doc_id, CASE WHEN kw IN ('anutika', 'tika') THEN 2 WHEN kw = 'bhasya' THEN 1 WHEN kw = 'sutra' THEN 0 END AS level, regexp_replace(CASE WHEN kw IS NULL THEN title ELSE replace(title, kw, ' ') END, '[^a-z]', '', 'g') AS base FROM k
""")
def commentary_levels(spark, d):
    n = F.col("doc_id")
    tail = F.when(n % 4 == 0, " sutra").when(n % 4 == 1, " bhasya on sutra").when(n % 4 == 2, " tika").otherwise("")
    t = table(spark, d, "documents").select("doc_id", F.concat(T.folded(F.substring("text", 1, 200)), tail).alias("title"))
    c = T.commentary(F.col("title"))
    return t.select("doc_id", c.level.alias("level"), c.base.alias("base"))


_STRATA = [("BUILDING", -700.0, -500.0), ("MACHINERY", -600.0, -200.0)]


@query("""
WITH s(title, nb, na) AS (VALUES ('Customer#000000007', 200.0, 500.0)), t(stratum, nb, na) AS (VALUES ('BUILDING', -700.0, -500.0), ('MACHINERY', -600.0, -200.0))
SELECT c_custkey AS work, coalesce(s.nb, t.nb)::DOUBLE AS nb, coalesce(s.na, t.na)::DOUBLE AS na, CASE WHEN s.nb IS NOT NULL THEN 'title: ' || c_name ELSE 'stratum: ' || c_mktsegment END AS why
FROM customer LEFT JOIN s ON c_name = s.title LEFT JOIN t ON c_mktsegment = t.stratum WHERE coalesce(s.nb, t.nb) IS NOT NULL
""")
def stratum_priors(spark, d):
    works = table(spark, d, "customer").select(F.col("c_custkey").alias("work"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("stratum"))
    special = spark.createDataFrame([("Customer#000000007", 200.0, 500.0)], "title string, nb double, na double")
    return C.stratum_priors(works, special, spark.createDataFrame(_STRATA, "stratum string, nb double, na double"))
