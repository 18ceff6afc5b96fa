"""Queries over what the writers wrote and the readers read back: the tables go out as files in the readers' formats."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators.staging import shared_folder
from ..sources import readers as R
from ..sources import writers as W
from .registry import query, table


def _new(spark):
    return f"{shared_folder(spark)}/stratalith/files-{uuid.uuid4().hex}"


def _match_files(spark, d):
    """Match events of lineitem as gzip JSON lines; those of every seventh order are broken off.

    A gzip file is one task to read, so files are kept small."""
    at = _new(spark)
    name = lambda mark, key, line: F.array(F.concat(F.lit(mark), F.col(key).cast("string"), F.lit(":"), F.col(line).cast("string")))
    event = F.to_json(F.struct(name("s", "l_suppkey", "l_orderkey").alias("root_segnr"), name("p", "l_partkey", "l_linenumber").alias("par_segnr"), F.array("l_returnflag").alias("root_segtext"), F.array("l_linestatus").alias("par_segtext"), F.col("l_quantity").alias("score"), F.col("l_linenumber").alias("root_length")))
    table(spark, d, "lineitem").select(F.when(F.col("l_orderkey") % 7 == 0, F.substring(event, 1, 20)).otherwise(event).alias("value")).write.option("maxRecordsPerFile", 100_000).text(at, compression="gzip")
    return R.matches(spark, at)


@query("SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, count(*) AS cnt, sum(l_quantity) AS score, sum(l_linenumber)::BIGINT AS root_len, 0::BIGINT AS par_len FROM lineitem WHERE l_orderkey % 7 <> 0 GROUP BY 1, 2")
def match_reader(spark, d):
    return G.edges(R.match_endpoints(_match_files(spark, d)), "root", "par", {c: F.col(c) for c in ("score", "root_len", "par_len")})


@query("""
SELECT text, line, min(seg) AS seg_text, count(*) AS n FROM (SELECT 's' || l_suppkey AS text, l_orderkey AS line, l_returnflag AS seg FROM lineitem WHERE l_orderkey % 7 <> 0 UNION ALL SELECT 'p' || l_partkey, l_linenumber, l_linestatus FROM lineitem WHERE l_orderkey % 7 <> 0) GROUP BY 1, 2
""")
def matched_segment_reader(spark, d):
    rows = R.matched_segments(_match_files(spark, d))
    return rows.groupBy("text", "line").agg(F.min("seg_text").alias("seg_text"), F.count(F.lit(1)).alias("n"))


_TAGS = """
t AS (SELECT c_nationkey AS k, 'Case=' || c_mktsegment AS f FROM customer UNION ALL SELECT c_nationkey, 'Finite' FROM customer WHERE c_custkey % 3 = 0
 UNION ALL SELECT c_nationkey, 'Tense=Past' FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_nationkey, 'VerbForm=Part' FROM customer WHERE c_custkey % 4 = 0)
"""


def _tagged(spark, d):
    """Analysed segments, a JSON list in a file per nation, a segment per customer."""
    at, k = _new(spark), F.col("c_custkey")
    some = lambda n, mark: F.when(k % n == 0, F.lit(mark))
    tag = F.concat_ws(", ", F.concat(F.lit("Case="), "c_mktsegment"), some(3, "Person=3"), some(2, "Tense=Past"), some(4, "VerbForm=Part"), F.lit("Number=Singular"))
    segment = F.struct(F.col("c_name").alias("original"), F.lit("").alias("analyzed"), F.array(F.struct(F.lit("w").alias("lemma"), tag.alias("tag"))).alias("full_analysis"))
    lists = table(spark, d, "customer").groupBy("c_nationkey").agg(F.to_json(F.sort_array(F.collect_list(F.struct("c_custkey", segment.alias("s"))))["s"]).alias("value"))
    # A file holds one list: a nation is a partition.
    lists.repartitionById(25, F.pmod("c_nationkey", F.lit(25))).select("value").write.text(at)
    return R.segments(spark, f"{at}/*.txt")


@query("WITH " + _TAGS + "SELECT f AS feature, count(*) AS n FROM t GROUP BY 1")
def tag_feature_counts(spark, d):
    rows = _tagged(spark, d).select(F.explode("full_analysis").alias("a"))
    return rows.select(F.explode(T.tag_features(F.col("a.tag"))).alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT (c_custkey % 4 = 0) AS c_ppp, false AS c_pres_opt, false AS c_pres_subj, true AS c_adverb_indc, count(*) AS n FROM customer GROUP BY 1")
def tag_flag_counts(spark, d):
    rows = _tagged(spark, d).select(F.explode("full_analysis").alias("a")).select(T.tag_flags(F.col("a.tag"), F.lit("INDC")).alias("f")).select("f.*")
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT p_brand || p_partkey AS work, p_name AS title, p_type AS author, (CASE WHEN p_size % 5 > 0 THEN p_size END)::DOUBLE AS nb, (1000 + p_size)::DOUBLE AS na FROM part
""")
def metadata_reader(spark, d):
    """Dates go out with separators of thousands, every other row's the wrong way round, some not as numbers."""
    at, size = _new(spark), F.col("p_size")
    low, high = F.when(size % 5 == 0, F.lit("c. 300")).otherwise(size.cast("string")), F.concat(F.lit("1,"), F.lpad(size.cast("string"), 3, "0"))
    turn = (size % 2 == 0) & (size % 5 > 0)
    rows = table(spark, d, "part").select(F.concat("p_brand", F.col("p_partkey").cast("string")).alias("File name"), F.col("p_name").alias("title"), F.col("p_type").alias("author"), F.when(turn, high).otherwise(low).alias("not before"), F.when(turn, low).otherwise(high).alias("not after"))
    rows.write.csv(at, sep="\t", header=True, quoteAll=True)
    return R.metadata(spark, at)


@query("SELECT n_nationkey::VARCHAR AS key, n_name AS title, n_regionkey AS time_from FROM nation")
def json_map_reader(spark, d):
    at = _new(spark)
    entry = F.struct(F.col("n_nationkey").cast("string").alias("key"), F.struct(F.col("n_name").alias("title"), F.col("n_regionkey").alias("time_from")).alias("value"))
    table(spark, d, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")).write.text(at)
    return R.json_map(spark, f"{at}/*.txt", "struct<title:string,time_from:int>")


@query("SELECT s_suppkey AS work, round_even(s_acctbal, 1) AS est, s_name AS title FROM supplier")
def tsv_round_trip(spark, d):
    at = _new(spark)
    W.tsv(table(spark, d, "supplier").select(F.col("s_suppkey").alias("work"), F.col("s_acctbal").alias("est"), F.col("s_name").alias("title")), at, {"est": 1}, ["work"])
    return R.tsv(spark, at, "work long, est double, title string")


@query("SELECT s_suppkey AS work, s_acctbal AS est, s_name AS title, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS place FROM supplier")
def dated_round_trip(spark, d):
    """The order of the file's rows is that of the estimates."""
    from pyspark.sql import Window

    at, again = _new(spark), _new(spark)
    W.dated(table(spark, d, "supplier").select(F.col("s_suppkey").alias("work"), F.col("s_acctbal").alias("est"), F.col("s_name").alias("title")), at)
    W.json_lines(spark.read.parquet(at), again)
    back = spark.read.schema("work long, est double, title string").json(again)
    return back.withColumn("place", F.row_number().over(Window.orderBy("est", "work")))
