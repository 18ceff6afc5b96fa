"""Resolving identifiers by prefixes of them.

A prefix condition is no equality; it becomes one by exploding each distinct id into its prefixes of the lengths that
keys have. So ids meet keys in a hash join, not in a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import staged


def _prefixes(ids: DataFrame, id_col: str, keys: DataFrame, key_col: str) -> DataFrame:
    """__id, __key: each distinct id beside each key that it starts with."""
    known = keys.select(F.col(key_col).alias("__key")).where(F.col("__key").isNotNull()).distinct()
    lengths = known.agg(F.collect_set(F.length("__key")).alias("__lengths"))  # one row of small numbers
    distinct = ids.select(F.col(id_col).alias("__id")).where(F.col("__id").isNotNull()).distinct()
    cut = distinct.join(F.broadcast(lengths)).select("__id", F.explode(F.filter("__lengths", lambda n: n <= F.length("__id"))).alias("__n"))
    return cut.select("__id", F.expr("substring(__id, 1, __n)").alias("__key")).join(known, "__key")


def longest_prefix(ids: DataFrame, keys: DataFrame, id_col: str, key_col: str, out: str = "key", default: Column | None = None) -> DataFrame:
    """``ids`` with the longest key that is the id or begins it; ``default`` (null) where there is none."""
    best = _prefixes(ids, id_col, keys, key_col).groupBy("__id").agg(F.max_by("__key", F.length("__key")).alias("__best"))
    found = ids.join(best, ids[id_col] == best["__id"], "left")
    return found.withColumn(out, F.coalesce("__best", default) if default is not None else F.col("__best")).drop("__id", "__best")


def first_listed_prefix(ids: DataFrame, prefixes: list[str], id_col: str, out: str = "group") -> DataFrame:
    """``ids`` with the first of the listed prefixes that begins the id; the id itself where none does."""
    id_ = F.col(id_col)
    found = F.lit(None).cast("string")
    for p in reversed(prefixes):
        found = F.when(F.startswith(id_, F.lit(p)), p).otherwise(found)
    return ids.withColumn(out, F.coalesce(found, id_))


def either_way_prefix(ids: DataFrame, keys: DataFrame, id_col: str, key_col: str, root: str = "split_part", out: str = "key") -> DataFrame:
    """``ids`` with the key of the same root (the first two underscored parts) of which one begins the other: an equal one, else the longest."""
    def root_of(c):
        return F.substring_index(c, "_", 2)

    a = ids.select(F.col(id_col).alias("__id")).distinct().withColumn("__root", root_of(F.col("__id")))
    b = keys.select(F.col(key_col).alias("__key")).distinct().withColumn("__root", root_of(F.col("__key")))
    hits = a.join(b, "__root").where(F.startswith(F.col("__id"), F.col("__key")) | F.startswith(F.col("__key"), F.col("__id")))
    best = hits.groupBy("__id").agg(F.max_by("__key", F.struct((F.col("__id") == F.col("__key")).alias("same"), F.length("__key").alias("n"), F.col("__key").alias("k"))).alias(out))
    return ids.join(best, ids[id_col] == best["__id"], "left").drop("__id")


def cascade(rows: DataFrame, table: DataFrame, keys: list[Column], key_col: str, value_cols: list[str]) -> DataFrame:
    """``rows`` with the values of the first of several keys that the table has; null where it has none."""
    found = rows
    for i, key in enumerate(keys):
        side = table.select(F.col(key_col).alias(f"__k{i}"), F.struct(key_col, *value_cols).alias(f"__v{i}"))
        found = found.join(side, key == F.col(f"__k{i}"), "left")
    best = F.coalesce(*[F.col(f"__v{i}") for i in range(len(keys))])
    out = found.withColumn("__best", best)
    for c in [key_col, *value_cols]:
        out = out.withColumn(c, F.col("__best")[c])
    return out.drop("__best", *[f"__{x}{i}" for x in "kv" for i in range(len(keys))])


def lookup(rows: DataFrame, table: DataFrame, on: list[str] | str, defaults: dict) -> DataFrame:
    """Left join with defaults for what is not there."""
    out = rows.join(table, on, "left")
    for c, v in defaults.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return out


def anchored(works: DataFrame, metadata: DataFrame, anchors: DataFrame, work_col: str = "work") -> DataFrame:
    """``works`` with lo, hi and source: dates of the metadata where both ends are known, else of the longest anchor prefix, else null.

    ``metadata``: work, nb, na; ``anchors``: prefix, nb, na.
    """
    meta = metadata.where("nb IS NOT NULL AND na IS NOT NULL").select(F.col("work").alias("__w"), F.col("nb").alias("__nb"), F.col("na").alias("__na"))
    own = works.join(meta, works[work_col] == meta["__w"], "left")
    far = longest_prefix(own, anchors, work_col, "prefix", out="__prefix")
    table = anchors.select(F.col("prefix").alias("__p"), F.col("nb").alias("__anb"), F.col("na").alias("__ana"))
    joined = far.join(table, F.col("__prefix") == F.col("__p"), "left")
    nb, na = F.coalesce("__nb", "__anb"), F.coalesce("__na", "__ana")
    return joined.select(
        *[works[c] for c in works.columns],
        F.least(nb, na).cast("double").alias("lo"),
        F.greatest(nb, na).cast("double").alias("hi"),
        F.when(F.col("__nb").isNotNull(), "metadata").when(F.col("__anb").isNotNull(), "prefix").otherwise("inferred").alias("source"),
    )


def disjoint(queries: DataFrame, rows: DataFrame, most: int = 1 << 26, block: int = 4096) -> DataFrame:
    """Rows of ``queries`` (x, xl, xh) beside those of ``rows`` (y, yl, yh), another key, whose interval does not meet theirs.

    A stated query set against all rows. These are cut into blocks in the order of one end, ties by key; a query goes only to
    blocks that reach past its own end, so the work grows with the result and a block a query. A block and all queries make at
    most ``most`` pairs. Unknown ends meet nothing.
    """
    queries, rows = staged(queries), staged(rows)
    size = max(1, min(block, most // max(1, queries.count())))
    blocks = max(1, -(-rows.count() // size))

    def beyond(end: str, reach: Column, told: Column) -> DataFrame:
        cut = staged(rows.where(F.col(end).isNotNull()).repartitionByRange(blocks, end, "y").withColumn("__b", F.spark_partition_id()))
        ends = F.broadcast(cut.groupBy("__b").agg(F.min(end).alias("__least"), F.max(end).alias("__most")))  # a row per block
        tasks = max(1, min(blocks, 2000))
        sent = queries.join(ends, reach).drop("__least", "__most")
        # The number of partitions is stated: few bytes come in, but many pairs may go out.
        return sent.repartition(tasks, "__b").hint("merge").join(cut.repartition(tasks, "__b"), "__b").where(told & (F.col("x") != F.col("y"))).drop("__b")

    before, after = F.col("xh") < F.col("yl"), F.col("yh") < F.col("xl")
    return beyond("yl", F.col("xh") < F.col("__most"), before).unionByName(beyond("yh", F.col("__least") < F.col("xl"), after & ~F.coalesce(before, F.lit(False))))
