"""Edge and graph queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import spectral
from ..operators.staging import shared_folder, staged
from ..streaming import edges as E
from .registry import query, table


@query("SELECT l_suppkey AS src, l_partkey AS dst, count(*) AS cnt, sum(l_quantity) AS qty, round(sum(l_extendedprice), 2) AS price FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY 1, 2")
def edge_agg(spark, d):
    out = G.edges(table(spark, d, "lineitem"), "l_suppkey", "l_partkey", {"qty": F.col("l_quantity"), "price": F.col("l_extendedprice")})
    return out.withColumn("price", F.round("price", 2))


@query("SELECT node, count(*) AS cnt FROM (SELECT l_suppkey AS node FROM lineitem UNION ALL SELECT l_partkey FROM lineitem) GROUP BY 1")
def node_counts(spark, d):
    return G.node_counts(table(spark, d, "lineitem"), "l_suppkey", "l_partkey")


@query("""
WITH e AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, l_quantity AS q FROM lineitem),
m AS (SELECT 's' || s_suppkey AS node, 'nation' || s_nationkey AS work FROM supplier UNION ALL SELECT 'p' || p_partkey, p_brand FROM part WHERE p_size % 3 > 0)
SELECT coalesce(x.work, src) AS src, coalesce(y.work, dst) AS dst, count(*) AS cnt, sum(q) AS qty FROM e LEFT JOIN m x ON x.node = src LEFT JOIN m y ON y.node = dst WHERE coalesce(x.work, src) <> coalesce(y.work, dst) GROUP BY 1, 2
""")
def edge_rollup(spark, d):
    name = lambda mark, key: F.concat(F.lit(mark), F.col(key).cast("string"))
    lines = table(spark, d, "lineitem").select(name("s", "l_suppkey").alias("a"), name("p", "l_partkey").alias("b"), "l_quantity")
    raw = G.edges(lines, "a", "b", {"qty": F.col("l_quantity")}, keep_self=True)
    # Suppliers belong to nations and most parts to brands; the other parts stand for themselves.
    works = table(spark, d, "supplier").select(name("s", "s_suppkey").alias("node"), name("nation", "s_nationkey").alias("work"))
    return G.rolled_up(raw, works.union(table(spark, d, "part").where("p_size % 3 > 0").select(name("p", "p_partkey"), "p_brand")), ["cnt", "qty"])


_STEPS = "SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS src, event_type AS dst, value FROM events"


def _event_pairs(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "events").withColumn("src", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return G.edges(e.where("src IS NOT NULL"), "src", "event_type", {"total": F.col("value")})


@query(f"SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS cnt, round(sum(value), 4) AS total FROM ({_STEPS}) WHERE src <> dst GROUP BY 1, 2")
def edge_fold_undirected(spark, d):
    return G.undirected(_event_pairs(spark, d), ["cnt", "total"]).withColumn("total", F.round("total", 4))


#: Pairs of suppliers that share an order, with summed prices of either.
_PAIRS = """
s AS (SELECT l_orderkey AS o, l_suppkey AS s, sum(l_extendedprice) AS p FROM lineitem GROUP BY 1, 2),
pairs AS (SELECT x.s AS a, y.s AS b, count(*) AS cnt, sum(x.p) AS len_a, sum(y.p) AS len_b FROM s x JOIN s y ON x.o = y.o AND x.s < y.s GROUP BY 1, 2)
"""


def _pairs(spark, d, lengths=False):
    # An order has few lines, so the self-join by order multiplies each row by a handful. Lines are dealt out once, by order:
    # sums and join both find them there. Prices go along only where they are asked for.
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s"), *[F.col("l_extendedprice").alias("p")] * lengths).repartition("o")
    s = lines.groupBy("o", "s").agg(F.sum("p").alias("p")) if lengths else lines.distinct()
    x, y = (s.select("o", F.col("s").alias(e), *[F.col("p").alias(f"p{e}")] * lengths) for e in "ab")
    sums = [F.sum("pa").alias("len_a"), F.sum("pb").alias("len_b")] if lengths else []
    return staged(x.hint("merge").join(y, "o").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("cnt"), *sums))


_BREADTH = _PAIRS + ", two AS (SELECT a AS node, b AS other, cnt FROM pairs UNION ALL SELECT b, a, cnt FROM pairs), br AS (SELECT node, count(*) AS breadth FROM two GROUP BY 1)"


@query("WITH " + _BREADTH + " SELECT node, breadth FROM br")
def breadth(spark, d):
    return G.breadth(_pairs(spark, d))


@query("WITH " + _BREADTH + " SELECT node, round(sum(ln(1 + cnt)), 6) AS degree FROM two GROUP BY 1")
def weighted_degree(spark, d):
    return G.weighted_degree(_pairs(spark, d)).withColumn("degree", F.round("degree", 6))


def _scored(spark, d):
    pairs = _pairs(spark, d, lengths=True)
    # What is known of a node goes to the pairs in one join an end.
    known = staged(G.breadth(pairs).join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), "s_acctbal"), "node"))
    a, b = (known.select(F.col("node").alias(e), F.col("breadth").alias(f"b{e}"), F.col("s_acctbal").alias(f"t{e}")) for e in "ab")
    truth = pairs.join(a, "a").join(b, "b")
    return truth.withColumn("score", G.orientation_score(F.col("len_a"), F.col("len_b"), F.col("ba"), F.col("bb"))).withColumn("later_a", F.col("ta") > F.col("tb"))


_SCORED = _BREADTH + """, sc AS (SELECT a, b, ln((len_b + 1) / (len_a + 1)) + 1.5 * ln((x.breadth + 1) / (y.breadth + 1)) AS score, ln((len_b + 1) / (len_a + 1)) AS e, ln((x.breadth + 1) / (y.breadth + 1)) AS br, p.s_acctbal > q.s_acctbal AS later_a
 FROM pairs JOIN br x ON a = x.node JOIN br y ON b = y.node JOIN supplier p ON p.s_suppkey = a JOIN supplier q ON q.s_suppkey = b)
"""


@query("WITH " + _SCORED + " SELECT CASE WHEN score > 0 THEN b ELSE a END AS src, CASE WHEN score > 0 THEN a ELSE b END AS dst, round(score, 6) AS score FROM sc WHERE abs(score) >= 0.2")
def orient_pairs(spark, d):
    return G.oriented(_scored(spark, d), 0.2).withColumn("score", F.round("score", 6))


@query("WITH " + _SCORED + """ SELECT thr::DOUBLE AS thr, sum((abs(score) >= thr)::INT)::BIGINT AS decided, round(100.0 * sum((abs(score) >= thr)::INT) / count(*), 6) AS coverage,
 round(100.0 * sum((abs(score) >= thr AND (score > 0) = later_a)::INT) / greatest(1, sum((abs(score) >= thr)::INT)), 6) AS accuracy FROM sc, (VALUES (0.0), (0.2), (0.5), (1.0), (1.5), (2.0), (3.0)) v(thr) GROUP BY 1
""")
def orient_sweep(spark, d):
    out = G.threshold_sweep(_scored(spark, d), "score", "later_a")
    return out.select("thr", "decided", F.round("coverage", 6).alias("coverage"), F.round("accuracy", 6).alias("accuracy"))


@query("WITH " + _SCORED + """, r AS (SELECT later_a, unnest([{'rule': 'expansion', 's': CASE WHEN abs(e) >= 0.05 THEN e > 0 END}, {'rule': 'breadth', 's': CASE WHEN abs(br) >= 0.05 THEN br > 0 END}]) AS r FROM sc)
 SELECT r.rule AS rule, count(r.s) AS decided, coalesce(sum((r.s = later_a)::INT), 0)::BIGINT AS correct, round(sum((r.s = later_a)::INT) / nullif(count(r.s), 0), 6) AS accuracy FROM r GROUP BY 1
""")
def orient_rules(spark, d):
    rows = _scored(spark, d)
    e, b = F.ln((F.col("len_b") + 1) / (F.col("len_a") + 1)), F.ln((F.col("ba") + 1) / (F.col("bb") + 1))
    out = G.rule_accuracy(rows, "later_a", {"expansion": F.when(F.abs(e) >= 0.05, e > 0), "breadth": F.when(F.abs(b) >= 0.05, b > 0)})
    return out.select("rule", "decided", F.col("correct").cast("long").alias("correct"), F.round("accuracy", 6).alias("accuracy"))


@query("""
WITH e AS (SELECT src, dst, count(*) AS cnt, sum(value) AS r, sum(value * 2) AS p FROM (""" + _STEPS + """) WHERE src <> dst GROUP BY 1, 2)
SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(cnt)::BIGINT AS cnt, round(sum(CASE WHEN src < dst THEN r ELSE p END), 4) AS len_a, round(sum(CASE WHEN src < dst THEN p ELSE r END), 4) AS len_b FROM e GROUP BY 1, 2
""")
def folded_pairs(spark, d):
    e = _event_pairs(spark, d).withColumn("par", F.col("total") * 2)
    return G.folded_pairs(e, "total", "par").withColumn("len_a", F.round("len_a", 4)).withColumn("len_b", F.round("len_b", 4))


def _dated(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal")).alias("date"))


@query("WITH " + _BREADTH + """, n AS (SELECT node, s_acctbal AS date, sum(ln(1 + cnt)) AS w, count(*) AS c FROM two JOIN supplier ON other = s_suppkey AND s_suppkey % 3 <> 0 GROUP BY 1, 2),
 k AS (SELECT *, sum(w) OVER (PARTITION BY node ORDER BY date ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY node) AS cum, w / sum(w) OVER (PARTITION BY node) AS sh FROM n),
 g AS (SELECT node, round(sum(sh * date), 4) AS w_mean, min(date) AS w_min, max(date) AS w_max, coalesce(min(date) FILTER (cum >= 0.25 - 1e-12), max(date)) AS q25, coalesce(min(date) FILTER (cum >= 0.5 - 1e-12), max(date)) AS q50, sum(c)::BIGINT AS n_dated FROM k GROUP BY 1)
 SELECT node, round(ln(1 + breadth), 6) AS log_degree, w_mean, w_min, w_max, q25, q50, coalesce(n_dated, 0) AS n_dated FROM br LEFT JOIN g USING (node)
""")
def weighted_neighbor_quantiles(spark, d):
    out = G.neighbour_dates(_pairs(spark, d), _dated(spark, d))
    return out.select("node", F.round("log_degree", 6).alias("log_degree"), F.round("w_mean", 4).alias("w_mean"), "w_min", "w_max", "q25", "q50", "n_dated")


@query("WITH " + _BREADTH + " SELECT node, count(*) AS n_known FROM two JOIN supplier ON other = s_suppkey AND s_suppkey % 3 <> 0 GROUP BY 1")
def known_neighbours(spark, d):
    return G.known_neighbours(_pairs(spark, d), _dated(spark, d))


@query("WITH " + _PAIRS + " SELECT a, b, p.s_nationkey AS grp FROM pairs JOIN supplier p ON a = p.s_suppkey JOIN supplier q ON b = q.s_suppkey WHERE p.s_nationkey = q.s_nationkey")
def induced_pairs(spark, d):
    m = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("grp"))
    return G.induced(_pairs(spark, d), m).select("a", "b", "grp")


def _labels(spark, d):
    return table(spark, d, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("node"), F.col("s_acctbal").alias("y"))


#: The fixed point of spreading by plain steps. cell (h, node, y, prior) and two (h, a, b, w) are to stand before it: the systems h.
_SPREAD = """
dg AS (SELECT h, a AS node, sum(w) AS d FROM two GROUP BY 1, 2),
kn AS (SELECT two.h, two.a AS node, sum(w * y) AS s FROM two JOIN cell c ON c.h = two.h AND c.node = two.b WHERE c.y IS NOT NULL GROUP BY 1, 2),
fr AS (SELECT c.h, c.node, prior, coalesce(d, 0) AS d, coalesce(s, 0) AS s FROM cell c LEFT JOIN dg ON dg.h = c.h AND dg.node = c.node LEFT JOIN kn ON kn.h = c.h AND kn.node = c.node WHERE y IS NULL),
ed AS (SELECT two.h, a, b, w FROM two JOIN fr x ON x.h = two.h AND x.node = a JOIN fr z ON z.h = two.h AND z.node = b UNION ALL SELECT h, node, node, 0.0 FROM fr),
it(k, h, node, x) AS (SELECT 0, h, node, prior::DOUBLE FROM fr UNION ALL
 SELECT any_value(it.k) + 1, fr.h, fr.node, (CASE WHEN any_value(fr.d) > 0 THEN (sum(ed.w * it.x) + any_value(fr.s)) / any_value(fr.d) ELSE any_value(fr.prior) END + 0.05 * any_value(fr.prior)) / 1.05
 FROM it JOIN ed ON ed.h = it.h AND ed.b = it.node JOIN fr ON fr.h = ed.h AND fr.node = ed.a WHERE it.k < 700 GROUP BY fr.h, fr.node),
spread AS (SELECT h, node, x, false AS labelled FROM it WHERE k = 700 UNION ALL SELECT h, node, y, true FROM cell WHERE y IS NOT NULL)
"""
_LABELLED = "sup AS (SELECT s_suppkey AS node, s_suppkey // 50 AS grp, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END AS y FROM supplier)"
_IN_GROUPS = "own AS (SELECT a, b, ln(1 + cnt) AS w, a // 50 AS grp FROM pairs JOIN sup p ON p.node = a JOIN sup q ON q.node = b WHERE a // 50 = b // 50), twice AS (SELECT grp, a, b, w FROM own UNION ALL SELECT grp, b, a, w FROM own)"


@query("WITH RECURSIVE " + _PAIRS + "," + _LABELLED + """,
two AS (SELECT 0 AS h, a, b, ln(1 + cnt) AS w FROM pairs UNION ALL SELECT 0, b, a, ln(1 + cnt) FROM pairs),
cell AS (SELECT 0 AS h, n.node, y, (SELECT avg(y) FROM sup) AS prior FROM (SELECT a AS node FROM pairs UNION SELECT b FROM pairs UNION SELECT node FROM sup WHERE y IS NOT NULL) n LEFT JOIN sup USING (node)),
""" + _SPREAD + "SELECT node, round(x, 3) AS x, labelled FROM spread")
def harmonic_propagation(spark, d):
    return G.harmonic(_pairs(spark, d), _labels(spark, d), lam=0.05).withColumn("x", F.round("x", 3)).orderBy("x", "node")


def _grouped(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.floor(F.col("s_suppkey") / 50).alias("grp"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal")).alias("y"))
    return G.induced(_pairs(spark, d), s), s


@query("WITH RECURSIVE " + _PAIRS + "," + _LABELLED + "," + _IN_GROUPS + """,
two AS (SELECT grp AS h, a, b, w FROM twice), cell AS (SELECT grp AS h, node, y, median(y) OVER (PARTITION BY grp) AS prior FROM sup),
""" + _SPREAD + "SELECT h AS grp, node, round(x, 3) AS x, labelled FROM spread")
def harmonic_groups(spark, d):
    return G.harmonic_by_group(*_grouped(spark, d)).withColumn("x", F.round("x", 3))


@query("WITH RECURSIVE " + _PAIRS + "," + _LABELLED + "," + _IN_GROUPS + """,
held AS (SELECT node AS h, grp FROM sup WHERE y IS NOT NULL), two AS (SELECT h, a, b, w FROM twice JOIN held USING (grp)),
sys AS (SELECT h, node, CASE WHEN node <> h THEN y END AS y FROM sup JOIN held USING (grp)), cell AS (SELECT h, node, y, median(y) OVER (PARTITION BY h) AS prior FROM sys),
""" + _SPREAD + "SELECT h // 50 AS grp, node, round(x, 3) AS x, true AS labelled FROM spread WHERE h = node")
def harmonic_leave_one_out(spark, d):
    return G.harmonic_by_group(*_grouped(spark, d), leave_one_out=True).withColumn("x", F.round("x", 3))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT s_suppkey AS src, s_suppkey * 2 AS dst FROM supplier WHERE s_suppkey * 2 <= (SELECT max(s_suppkey) FROM supplier) AND s_suppkey > 0),
k AS (SELECT s_suppkey AS node, CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey % 40 - 0.0 ELSE -500.0 END AS lo, CASE WHEN s_suppkey % 5 = 0 THEN 100.0 + s_suppkey % 40 ELSE 1900.0 END AS hi FROM supplier WHERE s_suppkey IN (SELECT src FROM e UNION SELECT dst FROM e) OR s_suppkey % 5 = 0),
up AS (SELECT node, lo FROM k UNION SELECT e.dst, up.lo FROM up JOIN e ON e.src = up.node), dn AS (SELECT node, hi FROM k UNION SELECT e.src, dn.hi FROM dn JOIN e ON e.dst = dn.node)
SELECT u.node, u.lo::DOUBLE AS lo, w.hi::DOUBLE AS hi FROM (SELECT node, max(lo) AS lo FROM up GROUP BY 1) u JOIN (SELECT node, min(hi) AS hi FROM dn GROUP BY 1) w USING (node)
""")
def bound_propagation(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey")
    most = F.broadcast(s.agg(F.max("s_suppkey").alias("m")))
    e = s.crossJoin(most).where("s_suppkey * 2 <= m AND s_suppkey > 0").select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") * 2).alias("dst"))
    known = s.where("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("node"), (F.col("s_suppkey") % 40).cast("double").alias("lo"), (F.lit(100.0) + F.col("s_suppkey") % 40).alias("hi"))
    return G.bounds(e, known)


@query("""
WITH RECURSIVE p AS (SELECT p_partkey AS a, p_partkey * 3 AS b FROM part WHERE p_partkey * 3 <= (SELECT max(p_partkey) FROM part) AND p_partkey % 2 = 0 AND p_partkey > 0),
two AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r(node, c) AS (SELECT DISTINCT a, a FROM two UNION SELECT two.b, r.c FROM r JOIN two ON two.a = r.node) SELECT node, min(c) AS component FROM r GROUP BY 1
""")
def components(spark, d):
    p = table(spark, d, "part").select("p_partkey")
    most = F.broadcast(p.agg(F.max("p_partkey").alias("m")))
    pairs = p.crossJoin(most).where("p_partkey * 3 <= m AND p_partkey % 2 = 0 AND p_partkey > 0").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") * 3).alias("b"))
    return G.components(pairs)


@query()
def spanning_forest(spark, d):
    return G.spanning_forest(_pairs(spark, d))


@query()
def fiedler_suppliers(spark, d):
    """Suppliers in the order of the second eigenvector of the graph of suppliers that share an order."""
    return spectral.fiedler(_pairs(spark, d), "cnt").withColumn("fiedler", F.round("fiedler", 6))


@query("""
WITH m AS (SELECT max(ts) AS m FROM events) SELECT date_trunc('hour', ts) AS start, user_id AS src, event_type AS dst, count(*) AS cnt, round(sum(value), 4) AS total FROM events, m WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= m - INTERVAL 10 MINUTE GROUP BY 1, 2, 3
""")
def streamed_edges(spark, d):
    """Windows that the stream of events has closed by its end."""
    source = f"{d}/events.parquet"
    reader = spark.readStream.schema(E.EVENTS)
    stream = reader.parquet(source) if _is_folder(spark, source) else reader.option("pathGlobFilter", "events.parquet").parquet(d)
    out = E.windowed_edges(stream, "user_id", "event_type", "value")
    at = f"{shared_folder(spark)}/stratalith/stream-{uuid.uuid4().hex}"
    return E.drained(spark, out, f"{at}/out", f"{at}/checkpoint").withColumn("total", F.round("total", 4))


def _is_folder(spark, path):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
