"""Term and feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import features as X
from ..operators.staging import staged
from .registry import query, table

#: The tokenizer with a plain ASCII alphabet, so that SQL says the same.
_ALPHABET = "abcdefghijklmnopqrstuvwxyz'"
_TOKENS = r"""
t AS (SELECT doc_id AS doc, lower(trim(w, '/|.,;:()[]{}"')) AS term FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS w FROM documents)),
c AS (SELECT doc, term, count(*) AS cnt FROM t WHERE regexp_full_match(term, '[a-z'']+') AND regexp_matches(term, '[a-z]') GROUP BY 1, 2)
"""


def _counts(spark, d):
    return X.term_counts(table(spark, d, "documents"), "doc_id", T.pieces(F.col("text")), lambda p: T.word(p, _ALPHABET))


@query("WITH " + _TOKENS + "SELECT doc, term, cnt FROM c")
def token_counts(spark, d):
    return _counts(spark, d)


@query("WITH " + _TOKENS + "SELECT term, count(*) AS df FROM c GROUP BY 1 HAVING count(*) >= 10 AND count(*) <= (SELECT count(DISTINCT doc) FROM c) * 0.5")
def doc_freq(spark, d):
    return X.document_frequency(_counts(spark, d), 10, 0.5)


@query("WITH " + _TOKENS + "SELECT term, sum(cnt)::BIGINT AS total FROM c GROUP BY 1 ORDER BY total DESC, term LIMIT 100")
def topk_terms(spark, d):
    return X.top_terms(_counts(spark, d), 100)


@query("WITH " + _TOKENS + """,
f AS (SELECT term, count(*) AS df FROM c GROUP BY 1 HAVING count(*) >= 20), n AS (SELECT count(DISTINCT doc) AS n FROM c), s AS (SELECT doc, sum(cnt) AS total FROM c GROUP BY 1),
w AS (SELECT doc, term, cnt / total * ln((n + 1) / (df + 1)) AS w FROM c JOIN f USING (term) JOIN s USING (doc), n), l AS (SELECT doc, sqrt(sum(w * w)) AS l FROM w GROUP BY 1)
SELECT doc, term, round(w / l, 6) AS w FROM w JOIN l USING (doc) QUALIFY row_number() OVER (PARTITION BY doc ORDER BY round(w / l, 6) DESC, term) <= 3
""")
def tfidf_top(spark, d):
    counts = staged(_counts(spark, d))
    w = X.tf_idf(counts, X.document_frequency(counts, 20)).withColumn("w", F.round("w", 6))
    return X.rank_of_groups(w, ["doc"], [F.desc("w"), F.col("term")]).where("rank <= 3").select("doc", "term", "w")


@query("""
SELECT user_id, count(*) AS n, round(avg((event_type = 'click')::INT), 6) AS click, round(avg((event_type = 'view')::INT), 6) AS view, round(avg((event_type = 'error')::INT), 6) AS error FROM events GROUP BY 1
""")
def conditional_rates(spark, d):
    out = X.rates(table(spark, d, "events"), ["user_id"], {k: F.col("event_type") == k for k in ("click", "view", "error")})
    return out.select("user_id", "n", *[F.round(k, 6).alias(k) for k in ("click", "view", "error")])


@query("""
SELECT o_custkey, sum(l_quantity) AS l_quantity, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS l_discount, round(sum(l_tax * l_quantity) / sum(l_quantity), 6) AS l_tax FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1
""")
def weighted_rollup(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = X.weighted_means(rows, ["o_custkey"], ["l_discount", "l_tax"], "l_quantity")
    return out.select("o_custkey", "l_quantity", F.round("l_discount", 6).alias("l_discount"), F.round("l_tax", 6).alias("l_tax"))


@query("""
WITH g AS (SELECT c_nationkey, avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer GROUP BY 1) SELECT c_custkey, round((c_acctbal - m) / (s + 1e-9), 6) AS z FROM customer JOIN g USING (c_nationkey)
""")
def z_scores_by_group(spark, d):
    return X.z_scores(table(spark, d, "customer"), ["c_acctbal"], ["c_nationkey"]).select("c_custkey", F.round("c_acctbal_z", 6).alias("z"))


@query(r"""
WITH w AS (SELECT doc_id, trim(w, '/|.,;:()[]{}"') AS w FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS w FROM documents))
SELECT doc_id, sum(length(w))::BIGINT AS chars, count(*) AS words, round(avg(length(w)), 6) AS mean_length FROM w WHERE w <> '' AND NOT regexp_matches(w, '\d') GROUP BY 1
""")
def mean_word_length(spark, d):
    out = X.mean_word_length(table(spark, d, "documents"), ["doc_id"], T.word_lengths(F.col("text")))
    return out.where("words > 0").withColumn("mean_length", F.round("mean_length", 6))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN (SELECT median(c_acctbal) FROM customer WHERE c_custkey % 4 <> 0) ELSE c_acctbal END AS x FROM customer")
def median_imputed(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("x"))
    return X.imputed(c, ["x"])


@query("WITH " + _TOKENS + """,
s AS (SELECT doc, sum(cnt) AS total FROM c GROUP BY 1)
SELECT s.doc, total::BIGINT AS total, round(coalesce(sum(cnt) FILTER (term = 'the'), 0) / total, 8) AS a, round(coalesce(sum(cnt) FILTER (term = 'de'), 0) / total, 8) AS b FROM s JOIN c USING (doc) GROUP BY s.doc, total
""")
def term_vectors(spark, d):
    v = X.frequency_vectors(_counts(spark, d), ["the", "de"])
    return v.select("doc", "total", F.round(F.col("v")[0], 8).alias("a"), F.round(F.col("v")[1], 8).alias("b"))
