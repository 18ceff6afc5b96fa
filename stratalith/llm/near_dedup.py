"""Near-duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

A shingle is five words of the lower-cased text (a shorter text is one shingle). Its weight is its count times its idf,
1 + ln(min(1000, N / df)) / (2 ln 1000): from 1 for a shingle of all N documents to 1.5 for one of a thousandth of them or
fewer. So it depends on the share of documents alone, a large group of copies does not make its own text cheap, and the
shingles above a thousandth, at most 1000 times those of a mean document, make a table of bounded size: with it
every shingle has its exact weight.

1. Frequent shingles: a fixed table of counters over all documents names the candidates, an exact count follows.
2. Each document gets 36 samples in 12 bands of 3, and its shingle vector.
3. Documents that share a band are compared with the band's least and largest ids. Where a bucket's documents are not
   one class by then, it is cut in blocks, and every two blocks meet in a tile: pairs of unlike classes whose samples agree
   as often as those of near-duplicates do are compared there by their vectors, each in the first band that they share.
   A tile gives back a spanning forest of its links, so what is written grows with its documents, not with its pairs.
4. A pair whose vectors reach the weighted Jaccard similarity is a link; classes are the connected components.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import files_for, renamed, staged
from .tokens import U64, Chunk, mixed, released, text_chunks, windows, within

SHINGLE, BANDS, ROWS = 5, 12, 3
SAMPLES = BANDS * ROWS
#: Counters of the sketch, and the pieces in which they are summed.
COUNTERS, PIECES = 1 << 21, 64
_TABLE = 4096
#: Documents of a bucket that a task compares with as many others.
BLOCK = 2048
#: Documents for each file of a staged table. Without it a cluster of many shuffle partitions writes as many tiny files at every step.
FILE_DOCS = 5_000
#: Chance that too few samples agree of a pair right at the threshold.
MISSED = 1e-7


def _quantiles_of_gamma2() -> np.ndarray:
    """Mid quantiles of the Gamma(2, 1) distribution: F(x) = 1 - (1 + x) e^-x."""
    x = np.linspace(1e-4, 30, 600_000)
    return np.interp((np.arange(_TABLE) + 0.5) / _TABLE, 1 - (1 + x) * np.exp(-x), x)


_GAMMA = _quantiles_of_gamma2().astype(np.float32)
_GAMMA_INVERSE, _GAMMA_LOG = (1 / _GAMMA).astype(np.float32), np.log(_GAMMA).astype(np.float32)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """52-bit hash and text number of every shingle, by text."""
    c = Chunk(texts)
    h = c.word_hashes()
    ok = within(c.w_doc, SHINGLE)
    keys, doc = windows(h, SHINGLE)[ok], c.w_doc[: len(ok)][ok]
    short = np.flatnonzero((c.n_words > 0) & (c.n_words < SHINGLE))
    if len(short):
        bounds = c.bounds()
        own = [mixed(np.array([len(w := h[bounds[i] : bounds[i + 1]])], dtype=U64) + np.bitwise_xor.reduce(mixed(w + np.arange(len(w), dtype=U64))))[0] for i in short]
        keys, doc = np.concatenate([keys, np.array(own, dtype=U64)]), np.concatenate([doc, short])
    return keys >> U64(12), doc


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(COUNTERS, dtype=np.int64)
    for batch in batches:
        for _, texts in text_chunks(batch.column("text"), lower=True):
            keys, _ = shingles(texts)
            counts += np.bincount((keys % U64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
    parts = counts.reshape(PIECES, -1)
    yield pa.record_batch({"piece": pa.array(range(PIECES), pa.int32()), "counts": pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())})


def _frequent(floor: float):
    def run(table: pa.Table) -> pa.Table:
        total = 0
        for c in table.column("counts").to_pylist():
            total = total + np.frombuffer(zlib.decompress(c), dtype=np.int64)
        return pa.table({"piece": pa.array([table.column("piece")[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(total >= floor).tobytes()], pa.binary())})

    return run


def _exact(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = np.unpackbits(bits).astype(bool)
        for batch in batches:
            found = []
            for _, texts in text_chunks(batch.column("text"), lower=True):
                keys, doc = shingles(texts)
                hit = maybe[(keys % U64(COUNTERS)).astype(np.int64)]
                found.append(np.unique((doc[hit].astype(U64) << U64(52)) | keys[hit]) & U64((1 << 52) - 1))
            keys, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, dtype=U64), np.zeros(0, dtype=int))
            yield pa.record_batch({"h": keys.astype(np.int64), "n": n.astype(np.int64)})

    return run


SHARE = 1000


def idf(n_docs: int, df):
    return 1 + np.log(np.clip(n_docs / np.maximum(df, 1), 1, SHARE)) / (2 * math.log(SHARE))


class Weights:
    """Weight of a shingle by document frequency: those of a share above 1 / SHARE (or of several documents) in a table, all others alike."""

    def __init__(self, n_docs: int, frequent: np.ndarray, df: np.ndarray):
        self.n_docs, self.base = n_docs, float(idf(n_docs, 1))
        order = np.argsort(frequent)
        self.keys = frequent[order].astype(U64)
        self.values = idf(n_docs, df[order])
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.keys & U64(0xFFFF)).astype(np.int64)] = True

    def of(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), self.base)
        if len(self.keys):
            at = np.flatnonzero(self.maybe[(keys & U64(0xFFFF)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
            hit = self.keys[place] == keys[at]
            out[at[hit]] = self.values[place[hit]]
        return out


def idf_weights(texts: DataFrame) -> Weights:
    """Weights by the document frequencies over all of ``texts`` (text)."""
    n = texts.count()
    floor = max(2.0, n / SHARE)  # below it every weight is that of df 1
    pieces = texts.mapInArrow(released(_sketch), "piece int, counts binary").groupBy("piece").applyInArrow(_frequent(floor), "piece int, bits binary").collect()
    bits = dict((r.piece, r.bits) for r in pieces)
    empty = bytes(COUNTERS // PIECES // 8)
    flags = np.frombuffer(b"".join(bits.get(i, empty) for i in range(PIECES)), dtype=np.uint8)
    counted = texts.mapInArrow(released(_exact(flags)), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= floor).collect()
    return Weights(n, np.array([r.h for r in counted], dtype=np.int64), np.array([r.n for r in counted], dtype=np.float64))


def samples_of(keys: np.ndarray, weights: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Consistent weighted samples: (documents, SAMPLES) of 32 bits; cuts: start of each document's shingles."""
    log_w = np.log(weights).astype(np.float32)
    out = np.empty((len(cuts), SAMPLES), dtype=np.uint32)
    for k in range(SAMPLES):
        y = keys * U64((0x9E3779B97F4A7C15 + 0xA0761D6478BD642E * k) % 2**64 | 1)
        y ^= y >> U64(29)
        y *= U64(0xBF58476D1CE4E5B9)
        y ^= y >> U64(32)
        low = y.astype(np.uint32)
        r = low & np.uint32(_TABLE - 1)
        beta = (low >> np.uint32(12) & np.uint32(0xFFFF)).astype(np.float32) * np.float32(2.0**-16)
        t = np.floor(log_w * _GAMMA_INVERSE[r] + beta)
        log_a = _GAMMA_LOG[(y >> U64(52)).astype(np.int64)] - _GAMMA[r] * (t - beta + np.float32(1))
        first = ((log_a + np.float32(64)) * np.float32(2.0**25)).astype(U64)
        # The sample is the shingle with its t.
        name = (y >> U64(20)).astype(np.uint32) ^ (t.astype(np.int32).astype(np.uint32) * np.uint32(0x9E3779B1))
        out[:, k] = np.minimum.reduceat(first << U64(32) | name, cuts).astype(np.uint32)
    return out


def packed(keys: np.ndarray, weights: np.ndarray, base: float) -> bytes:
    """Vector of a document: sorted 32-bit keys; where weights differ from the base, their places and values; and how many do."""
    odd = np.flatnonzero(weights != base)
    return keys.astype("<u4").tobytes() + odd.astype("<u4").tobytes() + weights[odd].astype("<f4").tobytes() + np.array([len(odd)], dtype="<u4").tobytes()


def unpacked(vector: bytes, base: float) -> tuple[np.ndarray, np.ndarray]:
    words = np.frombuffer(vector, dtype="<u4")
    m = int(words[-1])
    n = len(words) - 1 - 2 * m
    weights = np.full(n, base, dtype=np.float64)
    weights[words[n : n + m]] = words[n + m : n + 2 * m].view("<f4")
    return words[:n], weights


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    (ka, wa), (kb, wb) = a, b
    if not len(ka) or not len(kb):
        return 0.0
    at = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
    hit = kb[at] == ka
    common = np.minimum(wa[hit], wb[at[hit]]).sum()
    return float(common / (wa.sum() + wb.sum() - common))


def _vectors(w: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_chunks(batch.column("text"), lower=True):
                keys, doc = shingles(texts)
                both = np.sort(doc.astype(U64) << U64(52) | keys)
                if not len(both):
                    continue
                first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
                tf = np.diff(np.append(first, len(both)))
                both = both[first]
                keys, doc = both & U64((1 << 52) - 1), (both >> U64(52)).astype(np.int64)
                weights = tf * w.of(keys)
                cuts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
                found = samples_of(keys, weights, cuts)
                short = (keys >> U64(20)).astype(np.uint32)
                ends = np.append(cuts[1:], len(keys))
                vectors = [packed(short[i:j], weights[i:j], w.base) for i, j in zip(cuts.tolist(), ends.tolist(), strict=True)]
                some = batch.column("id")[part].to_pylist()
                yield pa.record_batch(
                    {
                        "id": pa.array([some[i] for i in doc[cuts].tolist()], pa.int64()),
                        "same": pa.array([hashlib.blake2b(v, digest_size=16).digest() for v in vectors], pa.binary()),
                        "samples": pa.FixedSizeListArray.from_arrays(pa.array(found.ravel().view(np.int32)), SAMPLES).cast(pa.list_(pa.int32())),
                        "vector": pa.array(vectors, pa.binary()),
                    }
                )

    return run


def _banded(samples: DataFrame) -> DataFrame:
    """id, band, key: a row per document and band; documents meet where they share the samples of a band."""
    keys = [F.xxhash64(F.lit(b), *[F.col("samples")[b * ROWS + j] for j in range(ROWS)]) for b in range(BANDS)]
    return samples.select("id", F.posexplode(F.array(*keys)).alias("band", "key"))


def least_alike(threshold: float) -> int:
    """So many samples agree, but for a chance of MISSED, where the similarity is ``threshold`` or more."""
    below, k = 0.0, 0
    while k < SAMPLES and (below := below + math.comb(SAMPLES, k) * threshold**k * (1 - threshold) ** (SAMPLES - k)) <= MISSED:
        k += 1
    return k


def _open(rest: DataFrame, links: DataFrame, files: int | None) -> DataFrame:
    """id, band, key, c, n: members of buckets that hold more than one class c so far, and the bucket's size."""
    labels = components(links.select("a", "b"), files)
    rest = rest.select("id", "band", "key").join(labels, F.col("id") == F.col("v"), "left").select("id", "band", "key", F.coalesce("c", "id").alias("c"))
    buckets = rest.groupBy("band", "key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
    return staged(rest.join(buckets.select("band", "key", "n"), ["band", "key"]), "open", files)


def _tiles(rest: DataFrame, more: DataFrame, block: int) -> DataFrame:
    """A row per tile that a document is in: tile (band, key, i, j), id, c, block and the columns of ``more`` (by id)."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    rows = rest.join(more, "id").withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    tiles = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    return rows.withColumn("tile", F.explode(tiles)).select("band", "key", "tile.i", "tile.j", "id", "c", "n", "block", "samples", *[c for c in more.columns if c not in ("id", "samples")])


def _by_tile(rows: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over the rows of one tile after the other: it gets a dictionary of arrays, and gives arrays of the schema's columns."""
    names = [c for c in rows.columns if c != "samples"]
    out = [c.split(" ")[0] for c in schema.split(", ")]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        done: list[tuple] = []

        def tiles(last: bool):
            nonlocal held
            whole = {c: np.concatenate(x) for c, x in held.items()}
            tile = np.stack([whole[c].astype(np.int64) for c in ("band", "key", "i", "j")], axis=1)
            cuts = np.flatnonzero(np.concatenate(([True], (tile[1:] != tile[:-1]).any(axis=1), [True]))).tolist()
            for i, j in itertools.pairwise(cuts if last else cuts[:-1]):
                found = run({c: x[i:j] for c, x in whole.items()})
                if len(found[0]):
                    done.append(found)
            held = {} if last else {c: [x[cuts[-2] :]] for c, x in whole.items()}

        for batch in batches:
            if not batch.num_rows:
                continue
            for c in names:
                held.setdefault(c, []).append(np.array(batch.column(c).to_pylist(), dtype=object) if c == "vector" else batch.column(c).to_numpy())
            held.setdefault("samples", []).append(batch.column("samples").flatten().to_numpy().reshape(-1, SAMPLES))
            tiles(False)
            if done:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*done, strict=True)], names=out)
                done = []
        if held:
            tiles(True)
        if done:
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*done, strict=True)], names=out)

    return rows.repartition("band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j").mapInArrow(released(stream), schema)


def _company(t: dict, p: int, least: int) -> np.ndarray:
    """Places in the tile after p that p has to be compared with there: of another class, in the other block where the tile has
    two, alike by samples, and not together in an earlier band."""
    whom = np.arange(p + 1, len(t["id"]))
    whom = whom[(t["c"][whom] != t["c"][p]) & ((t["block"][whom] != t["block"][p]) | (t["i"][0] == t["j"][0]))]
    same = t["samples"][whom] == t["samples"][p]
    whom, same = whom[same.sum(axis=1) >= least], same[same.sum(axis=1) >= least]
    first = same.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1)
    return whom[first == t["band"][0]]


def _wanted(least: int):
    """Documents of a tile that have somebody to be compared with."""

    def run(t: dict) -> tuple:
        if (t["c"] == t["c"][0]).all():
            return (t["id"][:0],) * 5
        wanted = np.zeros(len(t["id"]), dtype=bool)
        for p in range(len(wanted) - 1):
            whom = _company(t, p, least)
            if len(whom):
                wanted[p] = wanted[whom] = True
        return tuple(t[c][wanted] for c in ("band", "key", "i", "j", "id"))

    return run


def _linked(least: int, threshold: float, base: float):
    """Links of a tile, as many as join what they join."""

    def run(t: dict) -> tuple:
        vectors = [unpacked(v, base) for v in t["vector"]]
        weight = np.array([w.sum() for _, w in vectors])
        of = np.arange(len(vectors))
        a, b, found = [], [], []
        for p in range(len(vectors) - 1):
            for q in _company(t, p, least).tolist():
                if of[p] == of[q] or min(weight[p], weight[q]) < threshold * max(weight[p], weight[q]):
                    continue
                similarity = weighted_jaccard(vectors[p], vectors[q])
                if similarity >= threshold:
                    of[of == of[q]] = of[p]
                    a.append(min(t["id"][p], t["id"][q]))
                    b.append(max(t["id"][p], t["id"][q]))
                    found.append(similarity)
        return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64), np.array(found, dtype=np.float64)

    return run


def _verify(base: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("va").to_pylist(), batch.column("vb").to_pylist()
            score = [weighted_jaccard(unpacked(x, base), unpacked(y, base)) for x, y in zip(a, b, strict=True)]
            yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b"), "similarity": score})

    return run


def similar_pairs(samples: DataFrame, vectors: DataFrame, base: float, threshold: float, block: int = BLOCK, files: int | None = None) -> DataFrame | None:
    """Links (a, b, similarity) among the documents of ``samples`` (id, samples); ``vectors`` (id, vector) may have more.

    Documents that are linked by way of others are in one class; not each such pair is a link.
    """
    members = _banded(samples)
    # Some buckets hold a third of all documents: their ends are found by partial sums.
    ends = members.groupBy("band", "key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    members = staged(members.join(ends, ["band", "key"]), "buckets", files)
    if members.isEmpty():
        return None
    # Of most documents no vector is needed; how many are has no bound, so nothing is broadcast.
    company = staged(vectors.join(members.select("id").distinct().hint("merge"), "id", "left_semi"), "company-vectors", files)
    wanted = members.select(F.col("id").alias("a"), F.explode(F.array("low", "high")).alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = staged(wanted, "wanted", files).join(company.select(F.col("id").alias("a"), F.col("vector").alias("va")), "a").join(company.select(F.col("id").alias("b"), F.col("vector").alias("vb")), "b")
    links = staged(both.mapInArrow(released(_verify(base)), "a long, b long, similarity double"), "judged", files).where(F.col("similarity") >= threshold)
    # The ends have met everybody. Linked members stay: others may be like them, and like neither end.
    rest, least = _open(members.where("id <> low AND id <> high"), links, files), least_alike(threshold)
    if rest.isEmpty():
        return links
    tiles = _tiles(rest, samples, block)
    some = staged(_by_tile(tiles, _wanted(least), "band int, key long, i int, j int, id long"), "to-compare", files)
    full = tiles.join(some, ["band", "key", "i", "j", "id"]).join(company, "id")
    return links.unionByName(staged(_by_tile(full, _linked(least, threshold, base), "a long, b long, similarity double"), "linked", files))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row per input row: id_col, class_id (the least id of the class), kept (it is that id).

    Texts without words are like nothing and are classes of their own. A null id has no class (class_id null) and is
    kept; rows that share an id are one document. An empty table gives no rows; other columns are ignored.
    """
    rows = renamed(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text")
    weights = idf_weights(rows.select("text"))
    files = files_for(docs.sparkSession, weights.n_docs, FILE_DOCS)
    vectors = staged(rows.where("id IS NOT NULL").mapInArrow(released(_vectors(weights)), "id long, same binary, samples array<int>, vector binary"), "vectors", files)
    # Documents with one vector are a class at once; its least id stands for it.
    first = vectors.groupBy("same").agg(F.min("id").alias("rep"))
    alike = staged(vectors.select("id", "same").join(first, "same").select("id", "rep", "same"), "alike", files)
    several = alike.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct()
    stand = staged(vectors.select("id", "same", "samples").join(first.select(F.col("rep").alias("id"), "same"), ["id", "same"], "left_semi").select("id", "samples"), "samples", files)
    links = similar_pairs(stand, vectors.select("id", "vector"), weights.base, threshold, files=files)
    edges = several if links is None else several.unionByName(links.select("a", "b"))
    labels = components(edges, files)
    found = rows.select("id").join(labels, F.col("id") == F.col("v"), "left").withColumn("class_id", F.coalesce("c", "id"))
    return found.select(F.col("id").alias(id_col), "class_id", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were: one document of each class, and those without an id."""
    gone = near_duplicates(docs, id_col, text_col, threshold).where("NOT kept").select(F.col(id_col).alias("__gone_id")).distinct().hint("merge")  # no bound, no broadcast
    return docs.join(gone, docs[f"`{id_col}`"] == gone["__gone_id"], "left_anti")


def op3_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
