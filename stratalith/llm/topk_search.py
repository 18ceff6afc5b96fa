"""Exact search for the largest inner products by buckets of vectors of like length.

Vectors lie in buckets by falling length; runs of buckets are shards. Every query first meets the shard of the longest
vectors, which gives it a score to beat. A score to beat, divided by the lengths of the query and of a bucket's longest
vector, is the cosine that a vector of that bucket must reach: above 1 the bucket is left out (whole shards are never sent to
a query block that they cannot help), near 1 the vectors are chosen by ranges of single coordinates, below that by their
lengths. What is left is verified by its products, in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import renamed, staged
from .tokens import released

#: Vectors of a bucket, of a shard and queries of a block; each also ends at its bytes.
BUCKET, SHARD, BLOCK = 1024, 65_536, 512
BUCKET_BYTES, SHARD_BYTES = 1 << 22, 1 << 24
#: Components beyond this count as this.
LARGEST = 2**62
NONE = np.iinfo(np.int64).min
PACKED = "dim int, key long, place int, high double, low double, ids binary, width int, data binary, bars binary"
FOUND = "query long, id long, score long"
FOUND_ARROW = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", v_col: str = "embedding", scale: int = 64) -> DataFrame:
    """id, v (array of long): floor(scale * x) of each component; vectors that are null or hold a null or no finite number go, as do rows without an id."""
    x = renamed(rows, id=id_col, v=v_col).withColumn("v", F.col("v").cast("array<double>"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform("v", lambda c: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), c * scale))))
    return x.where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine).select(F.col("id").cast("long").alias("id"), whole.alias("v"))


def _sized(rows: DataFrame) -> DataFrame:
    """rows with dim and length."""
    squares = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    return rows.select("*", F.size("v").alias("dim"), F.sqrt(squares).alias("length"))


def _lengths(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m.astype(float) ** 2).sum(1))


def _packed(rows: DataFrame, most: int, most_bytes: int, per_key: int, key_bytes: int, bars: bool) -> DataFrame:
    """Runs of the rows (id, v, dim[, bar]) of each partition, in their order, as one row each; runs of runs share a key. A run has vectors of one size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        head, key, place, filled, last = TaskContext.get().partitionId() << 32, 0, 0, 0, None
        held: list[tuple] = []

        def row() -> pa.RecordBatch:
            nonlocal key, place, filled
            m = np.stack([h[1] for h in held]) if held[0][1].size else np.zeros((len(held), 0), np.int64)
            low, high = (int(m.min()), int(m.max())) if m.size else (0, 0)
            width = next(w for w in (1, 2, 4, 8) if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
            own, size = np.array([h[2] for h in held], np.int64), _lengths(m)
            low_bar = (own / np.maximum(size, 1e-300)).min() if (size > 0).all() and (own > NONE).all() else -np.inf
            out = pd.DataFrame({"dim": [m.shape[1]], "key": head + key, "place": place, "high": size.max(), "low": low_bar, "ids": np.array([h[0] for h in held], np.int64).tobytes(), "width": width, "data": m.astype(f"i{width}").tobytes(), "bars": own.tobytes()})
            place, filled = place + 1, filled + m.nbytes
            if place == per_key or filled >= key_bytes:
                key, place, filled = key + 1, 0, 0
            held.clear()
            return pa.RecordBatch.from_pandas(out.astype({"dim": "int32", "place": "int32", "width": "int32"}), preserve_index=False)

        for batch in batches:
            ids, lists, dims = batch.column("id").to_numpy(), batch.column("v"), batch.column("dim").to_pylist()
            bar = batch.column("bar").to_numpy() if bars else np.full(len(dims), NONE)
            flat = lists.flatten().to_numpy()
            ends = np.cumsum(dims)
            for i, (n, end) in enumerate(zip(dims, ends.tolist(), strict=True)):
                if last not in (None, n):
                    if held:
                        yield row()
                    if place:
                        key, place, filled = key + 1, 0, 0
                held.append((ids[i], flat[end - n : end], bar[i]))
                last = n
                if len(held) == most or len(held) * n * 8 >= most_bytes:
                    yield row()
        if held:
            yield row()

    return rows.select("id", "v", "dim", *(["bar"] if bars else [])).mapInArrow(released(run), PACKED)


def _matrix(row: dict) -> np.ndarray:
    ids = len(row["ids"]) // 8
    return np.frombuffer(row["data"], f"i{row['width']}").reshape(ids, row["dim"])


class Bucket:
    """Vectors in order of falling length, and what the two ways of pruning need of them."""

    def __init__(self, row: dict):
        self.ids, self.v, self.high = np.frombuffer(row["ids"], np.int64), _matrix(row), row["high"]
        self.lengths = _lengths(self.v)
        self._unit, self._sorted, self._forms = None, {}, {}

    def form(self, kind) -> np.ndarray:
        if kind not in self._forms:
            self._forms[kind] = self.v.astype(kind)
        return self._forms[kind]

    def unit(self) -> np.ndarray:
        if self._unit is None:
            self._unit = self.v / np.maximum(self.lengths, 1e-300)[:, None]
        return self._unit

    def sure_cosine(self) -> float:
        """The local cosine from which on a coordinate's feasible range is no wider than two standard deviations of the bucket on either side."""
        return float(np.sqrt(max(0.0, 1 - 4 * self.unit().var(0).mean()))) if self.v.size else 2.0

    def by_coordinates(self, q: np.ndarray, cosine: float, focus: int = 3) -> np.ndarray:
        """Places of the vectors whose cosine with the unit vector q can reach ``cosine``, by ranges of q's largest coordinates."""
        some = None
        for f in np.argsort(-np.abs(q), kind="stable")[:focus]:
            x, t = q[f], min(cosine, 1.0)
            half = np.sqrt(max(0.0, (1 - x * x) * (1 - t * t))) + 1e-6
            lo, hi = (x * t - half if x >= -t else -2.0), (x * t + half if x <= t else 2.0)
            if some is None:
                if f not in self._sorted:
                    order = np.argsort(self.unit()[:, f], kind="stable")
                    self._sorted[f] = order, self.unit()[order, f]
                order, values = self._sorted[f]
                some = order[np.searchsorted(values, lo) : np.searchsorted(values, hi, "right")]
            else:
                own = self.unit()[some, f]
                some = some[(own >= lo) & (own <= hi)]
        return np.sort(some)


def _products(q: np.ndarray, bucket: Bucket, some, bound: float) -> np.ndarray:
    """q times the bucket's vectors, exactly: in floats while every sum fits their mantissa, else in whole numbers (the ends of a long are kept)."""
    for kind, bits in ((np.float32, 24), (np.float64, 53)):
        if bound < 2**bits * 0.999:
            return q.astype(kind) @ bucket.form(kind)[some].T
    exact = q.astype(object) @ bucket.v[some].astype(object).T
    return np.clip(exact, NONE + 1, np.iinfo(np.int64).max).astype(np.int64)


class Best:
    """The k best of each query of a block so far: score falling, ties to the smaller id."""

    def __init__(self, bars: np.ndarray, k: int):
        self.k, self.bars = k, bars.copy()
        self.rows, self.scores, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, rows, scores, ids) -> None:
        if not len(rows):
            return
        rows, scores, ids = (np.concatenate(p) for p in ((self.rows, rows), (self.scores, scores.astype(np.int64)), (self.ids, ids)))
        order = np.lexsort((ids, ~scores, rows))  # ~ turns the order round and never overflows
        rows, scores, ids = rows[order], scores[order], ids[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = place < self.k
        last = place == self.k - 1
        self.bars[rows[last]] = np.maximum(self.bars[rows[last]], scores[last])
        self.rows, self.scores, self.ids = rows[keep], scores[keep], ids[keep]


def searched(block: dict, buckets: list[dict], k: int) -> tuple[np.ndarray, Best]:
    """Ids of the block's queries, and their best among the buckets that reach the block's bars. ``buckets``: of falling length."""
    q, own = _matrix(block), np.frombuffer(block["ids"], np.int64)
    lengths, best = _lengths(q), Best(np.frombuffer(block["bars"], np.int64), k)
    for row in buckets:
        reach = lengths * row["high"] * (1 + 1e-9)
        live = (best.bars == NONE) | (reach >= best.bars)
        if not live.any():
            break
        bucket = Bucket(row)
        cosine = np.where(best.bars > 0, best.bars / np.maximum(reach, 1e-300), -1.0)
        near = live & (cosine >= bucket.sure_cosine())
        for i in np.flatnonzero(near):
            some = bucket.by_coordinates(q[i] / lengths[i], cosine[i])
            s = _products(q[i : i + 1], bucket, some, reach[i])[0]
            hit = (s >= best.bars[i]) & (bucket.ids[some] != own[i])
            best.add(np.full(hit.sum(), i), s[hit], bucket.ids[some[hit]])
        far = np.flatnonzero(live & ~near)
        if not len(far):
            continue
        # By length: a query goes on while its length times a vector's can reach its bar.
        least = np.where(best.bars[far] > 0, best.bars[far] / np.maximum(lengths[far] * (1 + 1e-9), 1e-300), -1.0)
        upto = int(np.searchsorted(-bucket.lengths * (1 + 1e-9), -least.min(), "right"))
        s = _products(q[far], bucket, slice(0, upto), reach[far].max())
        bars, theirs = best.bars[far], bucket.ids[:upto]
        hit = (s >= bars[:, None]) & (theirs[None, :] != own[far][:, None])
        if hit.sum() > 4 * k * len(far) and upto > k:
            cut = np.partition(np.where(hit, s, -np.inf if s.dtype.kind == "f" else NONE), upto - k, axis=1)[:, upto - k]
            hit &= s >= cut[:, None]
        at = np.nonzero(hit)
        best.add(far[at[0]], s[at], theirs[at[1]])
    return own, best


def _meetings(blocks: DataFrame, buckets: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """query, id, score of the pairs (block, shard); a task holds a block of queries and a shard."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return FOUND_ARROW.empty_table()
        own, best = searched(left.to_pylist()[0], sorted(right.to_pylist(), key=lambda r: r["place"]), k)
        return pa.table([own[best.rows], best.ids, best.scores], schema=FOUND_ARROW)

    # Neither side is ever broadcast by chance: all vectors and all queries are in them.
    pairs = staged(pairs, "topk-pairs")
    left = blocks.join(pairs.select(F.col("block").alias("key"), F.col("shard").alias("to")).hint("merge"), "key")
    right = buckets.withColumnRenamed("key", "to").join(pairs.select("block", F.col("shard").alias("to")).hint("merge"), "to")
    return left.groupBy("key", "to").cogroup(right.groupBy("block", "to")).applyInArrow(run, FOUND)


def top_k(queries: DataFrame, rows: DataFrame, k: int = 20, shard: int = SHARD, block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """query, rank, id, score: of each query (id, v) the k rows (id, v) of largest inner product; v are arrays of long.

    Rows of the query's own id are no answer, and of queries that share an id the smallest vector is the query. Other rows that
    repeat are rows of their own. Ties go to the smaller id. Vectors meet those of their own number of components only; two
    without components have score 0. Scores beyond a long count as its ends. Empty tables give none. Other columns are ignored.
    The driver sees a row per shard and per query block (65,536 vectors, 512 queries) and nothing of the vectors.
    """
    spark = rows.sparkSession
    buckets = _sized(rows).repartitionByRange("dim", F.desc("length"), "id").sortWithinPartitions("dim", F.desc("length"), "id")
    buckets = staged(_packed(buckets, bucket, BUCKET_BYTES, max(1, shard // bucket), SHARD_BYTES, False), "topk-buckets")
    asked = staged(_sized(queries.groupBy("id").agg(F.min("v").alias("v"))), "topk-queries")
    tops = buckets.groupBy("dim", "key").agg(F.max("high").alias("high")).orderBy("dim", "key").collect()
    seen: set[int] = set()
    shards = [(t.dim, t.key, t.high, not (t.dim in seen or seen.add(t.dim))) for t in tops]
    shards = F.broadcast(spark.createDataFrame(shards, "dim int, shard long, high double, first boolean"))  # a row per shard

    def blocks_of(rows: DataFrame, *order: str) -> DataFrame:
        return staged(_packed(rows.repartitionByRange("dim", *order).sortWithinPartitions("dim", *order), block, BUCKET_BYTES, 1, 1, True), "topk-blocks")

    first = blocks_of(asked.withColumn("bar", F.lit(NONE)), "id")
    pairs = first.select("dim", F.col("key").alias("block")).join(shards.where("first"), "dim").select("block", "shard")
    start = staged(_meetings(first, buckets, pairs, k), "topk-first")
    bars = start.groupBy("query").agg(F.min("score").alias("bar"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    barred = asked.join(bars, asked["id"] == bars["query"], "left").select("id", "v", "dim", F.coalesce("bar", F.lit(NONE)).alias("bar"), F.when(F.col("length") > 0, F.col("bar") / F.col("length")).alias("ratio"))
    # Queries of like bars together: the lowest bar of a block, for a query of length 1, says which shards it needs.
    ratio = F.coalesce(F.when(F.col("length") > 0, F.col("bar") / F.col("length")), F.lit(float("-inf")))
    barred = asked.join(bars, asked["id"] == bars["query"], "left").select("id", "v", "dim", ratio.alias("ratio"), F.coalesce("bar", F.lit(NONE)).alias("bar"))
    second = blocks_of(barred, "ratio", "id")
    more = second.select("dim", F.col("key").alias("block"), "low").join(shards.where("NOT first"), "dim").where(F.col("high") * (1 + 1e-9) >= F.col("low")).select("block", "shard")
    found = start.unionByName(_meetings(second, buckets, more, k))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "id", "score")


def op11_topk_search(spark, sf_dir):
    rows = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(rows.where("id % 20 = 0"), rows).select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


OP11_SQL = """
WITH x AS (SELECT vec_id, unnest(embedding) AS c, generate_subscripts(embedding, 1) AS i, len(embedding) AS d FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
     ok AS (SELECT vec_id FROM x GROUP BY vec_id HAVING bool_and(coalesce(isfinite(c), false))),
     v AS (SELECT vec_id, i, d, floor(64 * c::DOUBLE)::HUGEINT AS c FROM x SEMI JOIN ok USING (vec_id)),
     s AS (SELECT q.vec_id AS query_id, p.vec_id, sum(q.c * p.c)::BIGINT AS score FROM v q JOIN v p ON q.i = p.i AND q.d = p.d AND q.vec_id <> p.vec_id
           WHERE q.vec_id % 20 = 0 GROUP BY 1, 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY rank <= 20
"""
