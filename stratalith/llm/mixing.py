"""Mixing sources to target weights by a low-discrepancy schedule.

Each source is one long stream of its documents in shuffled order, cut into blocks of equal word count.
Slot s of the mix maps the golden-ratio point frac((s + 1) / phi) through the cumulative weights to a source;
slots are ranked within their source, and slot of rank r takes block r of the source's stream (the stream goes
round again where a target exceeds the source). Ranks and stream positions come from two-level sums, so no
source, however large, is gathered or sorted in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .storage import renamed, staged
from .tokens import Chunk, released, text_chunks

WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = 0.6180339887498949
#: Slots that are ranked together, and about as many documents that are laid out together.
RANK_CHUNK, LAYOUT_DOCS = 65_536, 4_096
#: Mixing weights are stated by source; more sources than this are refused, so what is broadcast stays small.
MAX_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mark_of(id_col, text_col) -> Column:
    return F.xxhash64(id_col, text_col)


def water_filled(sizes: list[int], weights: list[float], total: float, epochs: float) -> list[float]:
    """Shares of ``total`` by weight; a share stops at ``epochs`` times its size and the excess goes to the others by weight."""
    target, live, left = [0.0] * len(sizes), list(range(len(sizes))), total
    while live and (whole := sum(weights[i] for i in live)) > 0:
        share = {i: left * weights[i] / whole for i in live}
        over = [i for i in live if share[i] > epochs * sizes[i]]
        if not over:
            for i in live:
                target[i] = share[i]
            break
        for i in over:
            target[i] = float(epochs * sizes[i])
            left -= target[i]
        live = [i for i in live if i not in set(over)]
    return target


def cycled_weights(sources: list, cycle=(3, 1, 2)) -> list[float]:
    """Weights that repeat over the sources by code point, null last."""
    return [float(cycle[i % len(cycle)]) for i in range(len(sources))]


class Mixture:
    """layout: a row per input row (id, mark, src, size, pos); slots: the schedule (src, block, slot); pieces: what the slots take.

    ``mark`` is a hash of id and text. A piece: slot, offset (its place in the block), id, mark, first_word, n_words.
    """

    def __init__(self, sources: DataFrame, layout: DataFrame, slots: DataFrame, pieces: DataFrame, n_slots: int):
        self.sources, self.layout, self.slots, self.pieces, self.n_slots = sources, layout, slots, pieces, n_slots


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=cycled_weights, share: float = 1.5, epochs: int = 2, block_words: int = 1024, seed: int = 7) -> Mixture:
    """Schedule of a mix that takes ``share`` times all words, by weight, at most ``epochs`` times each.

    ``weights``: list of sources (by code point, null last) -> list of weights. Null texts have size 0 and are
    never taken; a null source is a source; null ids are documents like others; repeated rows are documents of
    their own. Order within a source depends only on ids, texts and ``seed``, so reruns agree (rows that repeat both
    are interchangeable; they lie together). An empty table gives empty results.
    """
    spark = docs.sparkSession
    rows = staged(renamed(docs, id=id_col, text=text_col, source=source_col).select("id", "source", word_count(F.col("text")).alias("size"), mark_of("id", "text").alias("mark")), "mix-sizes")
    by_source = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(by_source) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    by_source.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [int(r["size"]) for r in by_source]
    targets = water_filled(sizes, weights([r.source for r in by_source]), share * sum(sizes), epochs)
    takes = [min(round(t), epochs * n) for t, n in zip(targets, sizes, strict=True)]
    counts = [-(-t // block_words) for t in takes]
    n_slots, n_docs = sum(counts), sum(r.n for r in by_source)
    sources = F.broadcast(
        spark.createDataFrame(
            [(k, r.source, sizes[k], float(targets[k]), int(takes[k]), int(counts[k])) for k, r in enumerate(by_source)],
            "src int, source string, source_size long, target double, takes long, n_blocks long",
        )
    )

    # Place of each document in its source's stream: offset of its bucket + sum of sizes before it in the bucket.
    n_buckets = max(1, -(-n_docs // LAYOUT_DOCS))
    shuffled = F.xxhash64(F.lit(seed), F.col("mark"))
    placed = rows.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.id", "d.mark", "d.size", "s.src", "s.source_size", "s.takes", shuffled.alias("u"), F.pmod(shuffled, F.lit(n_buckets)).alias("bucket"))
    offsets = placed.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
    offsets = offsets.select("src", "bucket", (F.sum("words").over(Window.partitionBy("src").orderBy("bucket")) - F.col("words")).alias("before"))
    inside = Window.partitionBy("src", "bucket").orderBy("u", "mark", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    layout = staged(placed.withColumn("pos", F.sum("size").over(inside) - F.col("size")).join(offsets, ["src", "bucket"]).select("id", "mark", "src", "size", "source_size", "takes", (F.col("pos") + F.col("before")).alias("pos")), "mix-layout")

    # The schedule.
    bounds = np.cumsum(counts) / max(1, n_slots)

    def sources_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src = np.minimum(np.searchsorted(bounds, batch.column("point").to_numpy(), "right"), len(bounds) - 1)
            yield pa.record_batch({"slot": batch.column("slot"), "src": src.astype(np.int32)})

    # By mapInArrow as all else here: another kind of function has workers of its own, beside those that are kept.
    points = spark.range(n_slots).select(F.col("id").alias("slot"), F.pmod((F.col("id") + 1) * F.lit(GOLDEN), F.lit(1.0)).alias("point"))
    points = points.mapInArrow(released(sources_at), "slot long, src int").withColumn("chunk", F.floor(F.col("slot") / RANK_CHUNK))
    chunks = points.groupBy("src", "chunk").agg(F.count(F.lit(1)).alias("n"))
    chunks = chunks.select("src", "chunk", (F.sum("n").over(Window.partitionBy("src").orderBy("chunk")) - F.col("n")).alias("before"))
    ranked = points.withColumn("rank", F.row_number().over(Window.partitionBy("src", "chunk").orderBy("slot")) - 1).join(chunks, ["src", "chunk"]).select("src", (F.col("rank") + F.col("before")).cast("long").alias("block"), "slot")
    # The points miss a weight by a few slots: slots beyond a source's blocks lapse, blocks without a slot come last.
    got = points.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    late = sources.join(got, "src", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < n_blocks").select("src", F.explode(F.sequence("n", F.col("n_blocks") - 1)).alias("block"))
    late = late.select("src", F.col("block").cast("long"), (F.lit(n_slots) + F.col("block") * len(sizes) + F.col("src")).alias("slot"))
    slots = ranked.join(sources.select("src", "n_blocks"), "src").where("block < n_blocks").select("src", "block", "slot").unionByName(late)

    # Which words of which document fill which block, for each time round the stream.
    times = layout.where("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(max(epochs - 1, 0)))).alias("epoch"))
    times = times.withColumn("begin", F.col("pos") + F.col("epoch") * F.col("source_size")).withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("takes"))).where("begin < end")
    cut = times.withColumn("block", F.explode(F.sequence(F.expr(f"begin div {block_words}"), F.expr(f"(end - 1) div {block_words}"))))
    cut = cut.select("src", "block", "pos", "id", "mark", "epoch", F.greatest(F.col("begin"), F.col("block") * block_words).alias("a"), F.least(F.col("end"), (F.col("block") + 1) * block_words).alias("b"), "begin")
    pieces = cut.join(slots, ["src", "block"]).select("slot", (F.col("a") - F.col("block") * block_words).alias("offset"), "src", "block", "epoch", "pos", F.col("id").alias(id_col), "mark", (F.col("a") - F.col("begin")).alias("first_word"), (F.col("b") - F.col("a")).alias("n_words"))
    return Mixture(sources, layout, slots, pieces, n_slots)


def taken_words(mixture: Mixture, id_col: str = "doc_id") -> DataFrame:
    """A row per document: id, size, source_size, target, taken."""
    taken = mixture.pieces.groupBy("src", "pos").agg(F.sum("n_words").alias("taken"))
    sized, empty = mixture.layout.where("size > 0").join(taken, ["src", "pos"], "left"), mixture.layout.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    rows = sized.select("id", "src", "size", "taken").unionByName(empty.select("id", "src", "size", "taken"))
    return rows.join(mixture.sources.select("src", "source_size", "target"), "src").select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def _cut(names: list[str], text_col: str):
    """Texts of the pieces of each row; the pieces of a document, put together, are its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_chunks(batch.column(text_col)):
                c, some = Chunk(texts), batch.slice(part.start, len(texts))
                bounds, raw = c.bounds(), c.buf.tobytes()
                wanted = some.column("__pieces")
                row = np.repeat(np.arange(len(texts)), pc.list_value_length(wanted).to_numpy())
                flat = wanted.flatten()
                first, n = (flat.field(f).to_numpy() for f in ("first_word", "n_words"))
                head, end = bounds[row] + first, bounds[row] + first + n
                ahead = np.append(c.w_starts, 0)
                lo = np.where(first == 0, c.starts[row], ahead[head])
                hi = np.where(end == bounds[row + 1], c.ends[row] - 1, ahead[end])
                for i in range(0, len(row), 4096):  # a long text has many pieces
                    j = slice(i, i + 4096)
                    cut = pa.array([raw[x:y] for x, y in zip(lo[j].tolist(), hi[j].tolist(), strict=True)], pa.binary()).cast(pa.string())
                    yield pa.record_batch([*(cut if x == text_col else some.column(x).take(pa.array(row[j])) for x in names), flat.field("slot")[j], flat.field("offset")[j]], names=[*names, "__slot", "__offset"])

    return run


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix as the schedule has it: a row per piece, by slot and place in the slot's block, all columns as in ``docs``.

    The text of a row is the piece's; the other columns are its document's. Documents of no words are never taken. The
    rows come out in the order of the mix: so do the files that they are written to.
    """
    mixture = mix(docs, id_col, text_col, source_col, **how)
    pieces = mixture.pieces.groupBy(F.col(id_col).alias("__mix_id"), F.col("mark").alias("__mix_mark")).agg(F.collect_list(F.struct("slot", "offset", "first_word", "n_words")).alias("__pieces")).hint("merge")
    own = docs.withColumn("__mark", mark_of(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")))
    # Rows that repeat id and text stand for one another: the pieces of all of them are cut from one.
    if not mixture.layout.groupBy("id", "mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        own = own.dropDuplicates([id_col, "__mark"])
    names = docs.columns
    both = own.join(pieces, own[f"`{id_col}`"].eqNullSafe(pieces["__mix_id"]) & (own["__mark"] == pieces["__mix_mark"])).select(*[own[f"`{c}`"] for c in names], "__pieces")
    cut = both.mapInArrow(released(_cut(names, text_col)), StructType([*docs.schema.fields, StructField("__slot", LongType()), StructField("__offset", LongType())]))
    # Slots are numbers in a row, so equal ranges of them are known without a look at the rows.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.least(F.lit(parts - 1), F.floor(F.col("__slot") * F.lit(parts) / F.lit(max(1, mixture.n_slots)))).cast("int")
    return cut.repartitionById(parts, part).sortWithinPartitions("__slot", "__offset").select(*[F.col(f"`{c}`") for c in names])


def op10_mixing(spark, sf_dir):
    return taken_words(mix(spark.read.parquet(f"{sf_dir}/documents.parquet")))
