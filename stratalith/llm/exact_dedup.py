"""Exact de-duplication: 128-bit content hash, then a comparison of bytes inside equal hashes.

Texts are equal when identical after lower-casing A-Z only; null counts as the empty text.
One row of each class stays: the smallest id (or the largest, by ``keep``).

Plan: one shuffle of the distinct texts of each map task (grouping by hash *and* text compares
the bytes, and collapses hot groups before the shuffle), one small shuffle of (id, hash) for the
membership. A hash that two different texts share is settled by a second, normally empty, branch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import renamed, staged

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", hash_of=None) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Nulls: a null text is empty; a null id never stays while its class has another id, and a class
    of null ids only keeps all its rows (keep_id null). Rows repeated with the same id are one document:
    they are counted in group_size and share ``kept``. An empty table gives no rows. Other columns are
    ignored. ``hash_of`` replaces the 128-bit hash (tests force collisions with it).
    """
    best = F.min if keep == "smallest" else F.max
    hash_of = hash_of or (lambda text: F.unhex(F.md5(text)))
    rows = renamed(docs, id=id_col, text=text_col).select("id", normalised(F.col("text")).alias("norm"))
    hashed = rows.select("id", "norm", hash_of(F.col("norm")).alias("h"))
    classes = staged(
        hashed.groupBy("h", "norm").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).withColumn("sha", F.sha2("norm", 256)).drop("norm"),
        "exact-classes",
    )
    # Only the hashes of the corpus with more than one text: none, unless the hash collides.
    shared = classes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    members = hashed.select("id", "h")
    if shared.isEmpty():
        out = members.join(classes, "h")
    else:
        texts = hashed.join(shared, "h", "left_semi").groupBy("h", "norm").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).withColumn("sha", F.sha2("norm", 256))
        apart = hashed.join(shared, "h", "left_semi").join(texts, ["h", "norm"]).select("id", "keep_id", "group_size", "sha")
        alone = members.join(classes.join(shared, "h", "left_anti"), "h").select("id", "keep_id", "group_size", "sha")
        out = alone.unionByName(apart)
    return out.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were; rows repeated with one id become one.

    An id goes when none of its rows stays. Rows without an id stay as they are.
    """
    found = exact_duplicates(docs, id_col, text_col, keep).where(F.col(id_col).isNotNull())
    ids = staged(found.groupBy(F.col(id_col).alias("__dedup_id")).agg(F.max("kept").alias("__dedup_kept"), F.count(F.lit(1)).alias("__dedup_n")), "exact-ids")
    here = docs[f"`{id_col}`"] == F.col("__dedup_id")
    # How many ids go has no bound: they are merged, never broadcast.
    stays = docs.join(ids.where("NOT __dedup_kept").select("__dedup_id").hint("merge"), here, "left_anti")
    again = ids.where("__dedup_n > 1").select("__dedup_id")
    if again.isEmpty():
        return stays
    here = stays[f"`{id_col}`"] == F.col("__dedup_id")
    return stays.join(again, here, "left_anti").unionByName(stays.join(again, here, "left_semi").dropDuplicates([id_col]))


def op5_exact_dedup(spark, sf_dir):
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest")


OP5_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
