"""Exact nearest neighbours by pivots and the triangle inequality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

#: Pivots are a sample of the rows, by hash of the id; rows of a shard of a cell, and queries that meet it in one task.
PIVOTS, SHARD, BLOCK = 64, 16_384, 4_096


def _matrix(v: pd.Series) -> np.ndarray:
    return np.array(v.tolist(), dtype=float)


def _apart(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Distances that keep the triangle inequality: mean absolute differences, or Euclidean (of unit vectors for cosine)."""
    if metric == "delta":
        return np.stack([np.abs(x - one).mean(1) for one in q]) if len(q) else np.zeros((0, len(x)))
    return np.sqrt(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * q @ x.T, 0))


def _stated(q: np.ndarray, x: np.ndarray, apart: np.ndarray, metric: str) -> np.ndarray:
    """The distance as it is given back; a vector of length 0 is at cosine distance 1 from all."""
    if metric != "cosine":
        return apart
    zero = ~q.any(1)[:, None] | ~x.any(1)[None, :]
    return np.where(zero, 1.0, 1 - q @ x.T)


def nearest(queries: DataFrame, rows: DataFrame, k: int, metric: str = "euclidean", id_col: str = "id", v: str = "v", group: str | None = None, mode: str | None = None, pivots: int = PIVOTS, shard: int = SHARD, block: int = BLOCK, compared=None) -> DataFrame:
    """query, id, distance, rank: the k nearest rows of each query, exactly; never itself.

    Rows go to the cell of their nearest pivot, large cells in shards. A query meets a shard of its own cell first, which
    bounds the distance of its k-th neighbour; then only those cells whose pivot, less the cell's radius, is not beyond that
    bound, and in a cell only rows whose distance from the pivot differs from the query's by no more. Neither side passes
    the driver: it sees the pivots (at most ``pivots`` vectors) and a row of counts per cell. ``group`` with mode "same" or "other" keeps
    rows of the query's own group, or of others. Metrics: euclidean, cosine, delta (mean absolute difference). Ties go by id.
    Null vectors are left out. ``compared``: an accumulator that counts the pairs whose distance was taken.
    """
    spark = rows.sparkSession
    kind, made = dict(rows.dtypes)[id_col], np.linalg.norm
    unit = metric == "cosine"

    def slim(df: DataFrame) -> DataFrame:
        x = F.col(v).cast("array<double>")
        length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, c: s + c * c))
        x = F.when(length > 0, F.transform(x, lambda c: c / length)).otherwise(x) if unit else x
        return df.where(F.col(v).isNotNull()).select(F.col(id_col).alias("id"), x.alias("v"), (F.col(group).cast("string") if group else F.lit(None).cast("string")).alias("g"))

    own = slim(rows)
    sample = own.orderBy(F.xxhash64("id"), "id").limit(pivots).select("v").collect()
    if not sample:
        return queries.limit(0).select(F.col(id_col).alias("query"), F.col(id_col).alias("id"), F.lit(0.0).alias("distance"), F.lit(0).alias("rank"))
    pivot = np.unique(np.array([list(r.v) for r in sample], dtype=float), axis=0)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 4096):
                part = batch.iloc[start : start + 4096]
                d = _apart(_matrix(part["v"]), pivot, metric)
                cell = d.argmin(1)
                yield part.assign(cell=cell.astype(np.int32), off=d[np.arange(len(d)), cell])

    where = f"id {kind}, v array<double>, g string, cell int, off double"
    cells = staged(own.mapInPandas(placed, where))
    asked = staged(slim(queries).mapInPandas(placed, where))
    n, radius, q = np.zeros(len(pivot), int), np.zeros(len(pivot)), np.zeros(len(pivot), int)
    for r in cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("off").alias("r")).collect():
        n[r.cell], radius[r.cell] = r.n, r.r
    for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():
        q[r.cell] = r.n
    of = lambda per_cell: F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in per_cell]), F.col("cell") + 1)
    shards, blocks = np.maximum(1, -(-n // shard)), max(1, -(-int(q.sum()) // block))
    salted = lambda many, seed: F.pmod(F.xxhash64(F.lit(seed), "id"), many)
    cells = cells.withColumn("salt", salted(of(shards), 1))
    asked = asked.withColumn("salt", salted(of(shards), 2)).withColumn("own", F.col("cell")).withColumn("own_salt", F.col("salt"))

    def met(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.sort_values(["id"], ignore_index=True)
            x, ids, groups, off = _matrix(right["v"]), right["id"].to_numpy(), right["g"].to_numpy(dtype=object), right["off"].to_numpy()
            here = pivot[int(right["cell"].iloc[0])][None, :]
            for start in range(0, len(left), 256):
                some = left.iloc[start : start + 256]
                y, bound, names = _matrix(some["v"]), some["bound"].to_numpy(), some["id"].to_numpy()
                far, slack = _apart(y, here, metric)[:, 0], 1e-6 * (made(y, axis=1) + np.where(np.isfinite(bound), bound, 0))
                ring = np.abs(off[None, :] - far[:, None]) <= (bound + slack)[:, None]
                use = np.flatnonzero(ring.any(0))
                if not len(use):
                    continue
                apart = _apart(y, x[use], metric)
                if compared is not None:
                    compared.add(int(apart.size))
                bar = ~ring[:, use] | (names[:, None] == ids[use][None, :]) | (apart > (bound + slack)[:, None])
                if mode:
                    same = some["g"].to_numpy(dtype=object)[:, None] == groups[use][None, :]
                    bar |= ~same if mode == "same" else same
                said = np.where(bar, np.inf, _stated(y, x[use], apart, metric))
                best = np.argsort(said, axis=1, kind="stable")[:, :k]
                near = np.take_along_axis(said, best, 1)
                rows_, cols = np.nonzero(np.isfinite(near))
                at = best[rows_, cols]
                out.append(pd.DataFrame({"query": names[rows_], "id": ids[use[at]], "distance": near[rows_, cols], "apart": apart[rows_, at]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query": [], "id": [], "distance": [], "apart": []})

    def meetings(asking: DataFrame) -> DataFrame:
        """asking: id, v, g, bound, cell, salt. A task holds a shard of a cell and a block of the queries that come to it."""
        left = asking.select("id", "v", "g", "bound", F.col("cell").alias("c"), F.col("salt").alias("s"), salted(F.lit(blocks).cast("long"), 3).alias("b"))
        right = cells.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"))
        return left.groupBy("c", "s", "b").cogroup(right.groupBy("cell", "salt", "b")).applyInPandas(met, f"query {kind}, id {kind}, distance double, apart double")

    first = staged(meetings(asked.withColumn("bound", F.lit(float("inf")))))
    bounds = first.groupBy("query").agg(F.max("apart").alias("kth"), F.count(F.lit(1)).alias("found")).where(F.col("found") >= k)

    def reached(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 4096):
                part = batch.iloc[start : start + 4096]
                y, bound = _matrix(part["v"]), part["bound"].to_numpy()
                slack = 1e-6 * (made(y, axis=1) + np.where(np.isfinite(bound), bound, 0))
                near = (_apart(y, pivot, metric) - radius[None, :] <= (bound + slack)[:, None]) & (n > 0)[None, :]
                yield part.assign(cells=[np.flatnonzero(row).tolist() for row in near])

    more = asked.join(bounds.select(F.col("query").alias("id"), "kth"), "id", "left").select("id", "v", "g", "own", "own_salt", F.coalesce("kth", F.lit(float("inf"))).alias("bound"))
    more = more.mapInPandas(reached, f"id {kind}, v array<double>, g string, own int, own_salt long, bound double, cells array<int>")
    more = more.select("id", "v", "g", "bound", "own", "own_salt", F.explode("cells").alias("cell")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), of(shards) - 1)).alias("salt"))
    second = meetings(more.where("cell <> own OR salt <> own_salt"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    return first.unionByName(second).select("query", "id", "distance").withColumn("rank", rank).where(F.col("rank") <= k)
