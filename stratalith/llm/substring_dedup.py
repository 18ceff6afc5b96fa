"""Removal of passages that repeat across documents, by repeated-phrase automata.

A window is 13 consecutive words of one document. A word goes when a window over it also starts in a document
with a smaller id; windows are judged on the input.

1. Documents are dealt to shards by ranges of ids, so that a smaller shard only has smaller ids.
2. Recurring passages are confirmed: each shard sends the 64-bit hashes of its distinct windows to buckets (dealt
   by a second, independent hash), and a bucket answers with one bit for each: whether a smaller shard has it.
   A window that is in a third of all documents is sent once by a shard.
3. Each shard compiles an Aho-Corasick automaton of its confirmed passages, over an alphabet of words (equal symbols
   stand for words of equal bytes). The passages go in as phrases of 7 words side by side; a window of 13 holds one of
   them whole, at a place of its own. All documents of the shard stream through the automaton. A window is located where
   its phrase is hit at its place and the words around it are the window's: every word that goes is found by such a hit.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import renamed
from .tokens import U64, Chunk, as_bytes, windows, within

#: Code points for words: all but 0 and the surrogates. Where they do not do, a word is two of them.
_ALPHABET, _LOW = 0x10F000, 0xD000
KNOTS = 256


def id_ranges(docs: DataFrame, shard_bytes: int) -> tuple[Column, int]:
    """Column of shards that never falls as the id grows, of about ``shard_bytes`` of text each, and all bytes.

    The knots are quantiles of the ids; the bytes between them are counted, and inside they are taken as evenly spread.
    Rows without an id take part in nothing and go to any shard.
    """
    found = sorted(set(docs.approxQuantile("id", [i / KNOTS for i in range(KNOTS + 1)], 0.001)))
    value, knots = F.col("id").cast("double"), F.array(*map(F.lit, found or [0.0]))
    k = F.greatest(F.lit(1), F.least(F.lit(max(1, len(found) - 1)), F.size(F.filter(knots, lambda x: x <= value))))
    sums = {r.k: r.n for r in docs.groupBy(F.when(F.col("id").isNotNull(), k).alias("k")).agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    size = sum(sums.values())
    upto = [0]
    for i in range(1, max(1, len(found) - 1) + 1):
        upto.append(upto[-1] + sums.get(i, 0))
    n = max(1, -(-upto[-1] // shard_bytes))
    anywhere = F.pmod(F.xxhash64("text"), F.lit(n)).cast("int")
    if len(found) < 2:
        return F.when(F.col("id").isNull(), anywhere).otherwise(F.lit(0)), size
    lo, hi = (F.element_at(knots, i) for i in (k, k + 1))
    p, q = (F.element_at(F.array(*[F.lit(float(u)) for u in upto]), i) for i in (k, k + 1))
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - lo) / (hi - lo)))
    shard = F.least(F.lit(n - 1), F.floor((p + part * (q - p)) * (n / max(upto[-1], 1)))).cast("int")
    return F.when(F.col("id").isNull(), anywhere).otherwise(shard), size


class _Batch:
    """The windows of a batch, documents by ascending id; those without an id have no window."""

    def __init__(self, table: pa.Table, k: int, n_buckets: int):
        ids = table.column("id").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        self.ids = [ids[i] for i in order]
        texts = as_bytes(table.column("text"))
        self.chunk = c = Chunk([texts[i] for i in order])
        self.h = c.word_hashes()
        named = np.array([i is not None for i in self.ids], dtype=bool)
        self.pos = np.flatnonzero(within(c.w_doc, k) & named[c.w_doc[: max(0, len(c.w_doc) - k + 1)]])
        keys = windows(self.h, k)[self.pos]
        self.distinct, self.first, self.inverse = np.unique(keys, return_index=True, return_inverse=True)
        far = windows(c.word_hashes(1), k, 1)[self.pos[self.first]]
        bucket = (far % U64(n_buckets)).astype(np.int32)
        self.order = np.argsort(bucket, kind="stable")
        self.buckets, self.cuts = np.unique(bucket[self.order], return_index=True)
        self.cuts = [*self.cuts.tolist(), len(bucket)]


def _sender(k: int, n_buckets: int):
    def send(table: pa.Table) -> pa.Table:
        b = _Batch(table, k, n_buckets)
        sent = b.distinct[b.order]
        return pa.table(
            {
                "bucket": pa.array(b.buckets, pa.int32()),
                "batch": pa.array([table.column("batch")[0].as_py()] * len(b.buckets), pa.int32()),
                "hashes": pa.array([sent[i:j].tobytes() for i, j in zip(b.cuts, b.cuts[1:], strict=False)], pa.binary()),
            }
        )

    return send


def _answer(table: pa.Table) -> pa.Table:
    batches = np.array(table.column("batch").to_pylist(), dtype=np.int32)
    blobs = table.column("hashes").to_pylist()
    rows = np.argsort(batches)
    parts = [np.frombuffer(blobs[i], dtype=U64) for i in rows]
    keys = np.concatenate(parts)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    later = np.zeros(len(keys), dtype=bool)  # the same window stands before it, in a smaller batch
    later[order[1:]] = keys[1:] == keys[:-1]
    cuts = np.cumsum([0, *map(len, parts)])
    bits = [np.packbits(later[i:j]).tobytes() for i, j in zip(cuts, cuts[1:], strict=False)]
    return pa.table({"batch": pa.array(batches[rows], pa.int32()), "bucket": pa.array(table.column("bucket").to_pylist(), pa.int32()), "bits": pa.array(bits, pa.binary())})


FOUND = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept_text", pa.string())])
FOUND_SQL = "id long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept_text string"


def _spelled(c: Chunk, h: np.ndarray) -> tuple[str, int]:
    """The words of the chunk as a string over an alphabet of words, and the symbols a word has. Words of equal symbols have equal bytes."""
    first, code = np.unique(h, return_index=True, return_inverse=True)[1:]
    size = c.w_ends - c.w_starts
    own = first[code]
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    same = (size[own] == size).all() and (c.buf[at + np.repeat(c.w_starts[own], size)] == c.buf[at + np.repeat(c.w_starts, size)]).all()
    if not same:  # two words share a hash
        words = c.words()
        number = {w: k for k, w in enumerate(dict.fromkeys(words))}
        code = np.fromiter((number[w] for w in words), dtype=np.int64, count=len(words))
    if len(code) == 0 or int(code.max()) + 1 < _ALPHABET:
        code = code + 1
        code[code >= 0xD800] += 0x800
        return code.astype("<u4").tobytes().decode("utf-32-le"), 1
    # The two halves have symbols of their own, so that no half stands for the other.
    both = np.stack([0x10000 + code // _LOW, 1 + code % _LOW], axis=1)
    return both.astype("<u4").tobytes().decode("utf-32-le"), 2


def _occurrences(text: str, symbols: int, starts: np.ndarray, passages: np.ndarray, window_at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the ``passages`` (windows, with a first word each in ``starts``) occur in the text: windows, and first words of their occurrences.

    ``window_at``: the window that each word begins by its hash, -1: none.
    """
    size = (k + 1) // 2
    # The phrases begin at words divisible by their size; the first of them in a window is whole in it.
    place = -starts % size
    number: dict[str, int] = {}
    of_window = np.full((2, int(window_at.max(initial=-1)) + 1), -1, dtype=np.int64)
    of_window[0, passages] = place
    of_window[1, passages] = [number.setdefault(text[i : i + size * symbols], len(number)) for i in ((starts + place) * symbols).tolist()]
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for phrase, n in number.items():
        automaton.add_word(phrase, n)
    automaton.make_automaton()
    found = np.fromiter((x for hit in automaton.iter(text) for x in hit), dtype=np.int64).reshape(-1, 2)
    at, hit = (found[:, 0] + 1) // symbols - size, found[:, 1]
    which, where = [], []
    for j in range(size):
        start = at - j
        window = np.where(start >= 0, window_at.take(start, mode="clip"), -1)
        good = np.flatnonzero(window >= 0)
        good = good[(of_window[0, window[good]] == j) & (of_window[1, window[good]] == hit[good])]
        which.append(window[good])
        where.append(start[good])
    return np.concatenate(which), np.concatenate(where)


def _remover(k: int, n_buckets: int):
    def remove(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return FOUND.empty_table()
        b = _Batch(docs, k, n_buckets)
        c, n = b.chunk, len(b.chunk.w_starts)
        outside = np.zeros(len(b.distinct), dtype=bool)
        told = dict(zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True))
        for bucket, i, j in zip(b.buckets.tolist(), b.cuts, b.cuts[1:], strict=False):
            outside[b.order[i:j]] = np.unpackbits(np.frombuffer(told[bucket], dtype=np.uint8), count=j - i).astype(bool)
        ids = np.array([i or 0 for i in b.ids], dtype=np.int64)
        own = ids[c.w_doc[b.pos[b.first]]]  # the smallest document of the shard that has the window
        confirmed = outside.copy()
        confirmed[b.inverse[ids[c.w_doc[b.pos]] > own[b.inverse]]] = True
        covered = np.zeros(n, dtype=bool)
        if confirmed.any():
            passages = np.flatnonzero(confirmed)
            text, symbols = _spelled(c, b.h)
            window_at = np.full(n, -1, dtype=np.int64)
            window_at[b.pos] = b.inverse
            which, at = _occurrences(text, symbols, b.pos[b.first[passages]], passages, window_at, k)
            doc = c.w_doc[at]
            goes = outside[which] | (own[which] < ids[doc])
            edge = np.zeros(n + 1, dtype=np.int32)
            begun = np.unique(at[goes])
            edge[begun] += 1
            edge[begun + k] -= 1
            covered = np.cumsum(edge[:n]) > 0
        # Kept words, each with one space after it, cut from the bytes.
        out = c.buf.copy()
        stays = ~covered
        edge = np.zeros(len(out) + 1, dtype=np.int8)
        edge[c.w_starts[stays]] = 1
        edge[c.w_ends[stays] + 1] -= 1
        out[c.w_ends[stays]] = 0x20
        mask = np.cumsum(edge[:-1], dtype=np.int8) > 0
        out = out[mask].tobytes()
        taken = np.concatenate(([0], np.cumsum(mask)))
        lo, hi = taken[c.starts], taken[c.ends]
        kept = [out[i : max(i, j - 1)] for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]
        # Spans of removed words.
        bounds = c.bounds()
        inner = np.concatenate(([False], covered[1:] & covered[:-1] & (c.w_doc[1:] == c.w_doc[:-1]))) if n else np.zeros(0, dtype=bool)
        first = np.flatnonzero(covered & ~inner)
        last = np.flatnonzero(covered & ~np.concatenate((inner[1:], [False]))) if n else first
        doc = c.w_doc[first]
        spans = pa.StructArray.from_arrays([pa.array((first - bounds[doc]).astype(np.int32)), pa.array((last + 1 - bounds[doc]).astype(np.int32))], names=["start", "end"])
        offsets = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=c.n)))).astype(np.int32)
        return pa.table(
            {
                "id": pa.array(b.ids, pa.int64()),
                "n_words": pa.array(c.n_words.astype(np.int64)),
                "n_removed": pa.array(np.bincount(c.w_doc, weights=covered, minlength=c.n).astype(np.int64)),
                "removed": pa.ListArray.from_arrays(pa.array(offsets), spans),
                "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
            }
        )

    return remove


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 13, batch_bytes: int = 3_000_000, bucket_windows: int = 1_500_000) -> DataFrame:
    """One row per input row: id_col, n_words, n_removed, removed (word spans), kept_text.

    About ``batch_bytes`` of text (a longer document is a shard of its own) and ``bucket_windows`` hashes are what one
    task holds at a time; both grow with the executors, not with the input. Null text has no words; a row with a null id keeps all its words and takes none
    from others; rows that share an id take none from each other. An empty table gives no rows; other columns are
    ignored.
    """
    rows = renamed(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    shard, size = id_ranges(rows, batch_bytes)
    n_buckets = max(1, -(-size // (6 * bucket_windows)))
    dealt = rows.withColumn("batch", shard).select("batch", "id", "text")
    sent = dealt.groupBy("batch").applyInArrow(_sender(words, n_buckets), "bucket int, batch int, hashes binary")
    answers = sent.groupBy("bucket").applyInArrow(_answer, "batch int, bucket int, bits binary")
    found = dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_remover(words, n_buckets), FOUND_SQL)
    return found.withColumnRenamed("id", id_col)


def op6_substring_dedup(spark, sf_dir):
    found = repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
