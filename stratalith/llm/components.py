"""Connected components of an edge table, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import files_for, staged


#: Edges, of 16 bytes, for each file of labels.
EDGES = 200_000


def components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """(v, c) for each end of the edges (a, b): c is the least id that v is connected with.

    Each round takes the least label among a node's neighbours (summed up before the shuffle, so a hub is no hot key)
    and then that label's own label; the rounds grow with the logarithm of the longest chain. ``files``: at most so many hold the
    edges; the labels, which are no more, are held in files of EDGES or more.
    """
    both = staged(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges", files)
    files = files_for(both.sparkSession, both.count(), EDGES)
    labels = staged(both.groupBy(F.col("a").alias("v")).agg(F.min(F.least("a", "b")).alias("c")), "labels", files)
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), F.col("c")), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        lower = labels.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        jumped = lower.alias("x").join(labels.select(F.col("v").alias("p"), F.col("c").alias("pc")).alias("y"), F.col("x.c") == F.col("y.p"), "left").select("v", "old", F.least("c", F.coalesce("pc", "c")).alias("c"))
        after = staged(jumped, "labels", files)
        if after.where("old <> c").isEmpty():
            return after.select("v", "c")
        labels = after.select("v", "c")
