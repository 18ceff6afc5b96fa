"""Phrases whose words stand together more often than by chance, from suffix arrays over word ids.

Documents are coded shard by shard as word ids; counts of words are merged over all shards, and words too rare to be in a
phrase become breaks. A shard sorts its suffixes by numpy prefix doubling; runs of neighbours that share their first m words
(LCP intervals) are the m-grams with their counts, and counts are merged by key over all shards. Lengths are merged
one after the other; a shard goes on only where all phrases a word shorter are frequent, as longer phrases are no more frequent than theirs.
Of pairs and of phrases of three words the shards first count hashes: a phrase whose hash is rare in all shards together is
rare itself and goes nowhere (exact: all others are counted by their words).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import numbered, renamed, staged
from .tokens import U64, mixed, released, text_chunks

#: Bytes of text of a shard.
SHARD_BYTES = 12 << 20
#: Frequent words, and frequent phrases of a length, that are sent to every task; more are asked for by join. A word has 32 bytes on average.
HELD = 2_000_000
#: Counters of hashed phrases: one for so many words, by their power of two at least and at most, in so many pieces.
PER_COUNTER, FEWEST_BITS, MOST_BITS, PIECES = 8, 16, 29, 256
BREAK, BLANK = 10, 32
#: A-Z to a-z, marks that end a piece to a line feed, tab to blank.
_BYTES = bytes(BREAK if chr(b) in ".,;:!?\n\x0b\x0c\r" else BLANK if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))

#: A row of a shard has its ids and its words in the order of their ids; a row of a word its id there and its count.
CODED = "shard long, coded binary, spelled binary, lang string, word string, lid int, cnt long"
_CODED = pa.schema([("shard", pa.int64()), ("coded", pa.binary()), ("spelled", pa.binary()), ("lang", pa.string()), ("word", pa.string()), ("lid", pa.int32()), ("cnt", pa.int64())])


def _zip(ids: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(ids.astype("<i4").tobytes())


def _unzip(coded: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(coded), "<i4")


def _keys(langs, words):
    """One string for a language and a word, which has no blank in it."""
    return pc.binary_join_element_wise(langs.cast(pa.large_string()), words.cast(pa.large_string()), pa.scalar(" ", pa.large_string()))


def _packed(langs: pa.Array, words: pa.Array) -> bytes:
    sink, batch = pa.BufferOutputStream(), pa.record_batch([langs, words], names=["lang", "word"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(packed).read_next_batch()


class _Shard:
    """Words of some texts: their bytes end to end, their lengths, and at which a piece begins."""

    def __init__(self):
        self.bytes, self.lengths, self.heads, self.langs, self.size = [], [], [], [], 0

    def add(self, texts: list[bytes], langs: np.ndarray) -> None:
        buf = np.frombuffer((b"\n".join(texts) + b"\n").translate(_BYTES), np.uint8)
        inside = np.concatenate(([False], (buf != BREAK) & (buf != BLANK)))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edge[::2], edge[1::2]
        piece = np.cumsum(buf == BREAK)[starts]
        text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        self.bytes.append(buf[inside[1:]])
        self.lengths.append(ends - starts)
        self.heads.append(np.diff(piece, prepend=-1) != 0)
        self.langs.append(langs[np.searchsorted(text_ends, starts, "right")])
        self.size += len(buf)

    def coded(self) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
        """Ids from 1 with 0 between pieces; of each id from 1 its word, language and count. Frequent words have small ids."""
        lengths, langs, heads = np.concatenate(self.lengths), np.concatenate(self.langs), np.concatenate(self.heads)
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(self.bytes))]).dictionary_encode()
        n = int(langs.max(initial=0)) + 1
        key = words.indices.to_numpy().astype(np.int64) * n + langs
        size, labels = len(words.dictionary) * n, None
        if size > 8 * len(key) + 1024:  # many languages: only the pairs that occur
            labels, key = np.unique(key, return_inverse=True)
            size = len(labels)
        table = np.bincount(key, minlength=size)
        kinds = np.flatnonzero(table)
        kinds = kinds[np.argsort(-table[kinds], kind="stable")]
        counts, rank = table[kinds], np.zeros(size, np.int32)
        rank[kinds] = np.arange(1, len(kinds) + 1)
        ids = np.zeros(len(key) + heads.sum(), np.int32)
        ids[np.arange(len(key)) + np.cumsum(heads)] = rank[key]
        kinds = kinds if labels is None else labels[kinds]
        return ids, words.dictionary.take(pa.array(kinds // n)).cast(pa.large_string()).cast(pa.string()), kinds % n, counts


def _coding(shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, shard, names = TaskContext.get().partitionId() << 32, _Shard(), {}

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal number, shard
            ids, words, langs, counts = shard.coded()
            none = lambda k, n: pa.nulls(n, _CODED.types[k])
            langs = pa.array(list(names), pa.string()).take(pa.array(langs))
            yield pa.record_batch([pa.array([number], pa.int64()), pa.array([_zip(ids)], pa.binary()), pa.array([_packed(langs, words)], pa.binary()), *(none(k, 1) for k in range(3, 7))], schema=_CODED)
            for i in range(0, len(counts), 1 << 16):
                part = slice(i, min(i + (1 << 16), len(counts)))
                n = part.stop - part.start
                yield pa.record_batch([pa.array(np.full(n, number)), none(1, n), none(2, n), langs[part], words[part], pa.array(np.arange(i + 1, part.stop + 1, dtype=np.int32)), pa.array(counts[part])], schema=_CODED)
            number, shard = number + 1, _Shard()
            names.clear()

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for part, texts in text_chunks(batch.column("text")):
                shard.add(texts, np.array([names.setdefault(x, len(names)) for x in langs[part]], np.int64))
                if shard.size >= shard_bytes:
                    yield from rows()
        if shard.size:
            yield from rows()

    return run


def links_left(linked: np.ndarray) -> np.ndarray:
    """How many words go on from each position, itself included; linked: whether a position and the next belong together."""
    at = np.arange(len(linked))
    stops = np.flatnonzero(~linked)
    return stops[np.searchsorted(stops, at)] - at + 1 if len(at) else at


def suffixes(ids: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in order of their first ``depth`` words, and how many of these each shares with the one before.

    ``ids`` below 2^31; ``left``: words from a position to where its run ends; a suffix ends there. Prefix doubling: ranks by h words, then by
    the rank of h words and that of the h that follow.
    """
    n, h, rank = len(ids), 1, ids.astype(np.int64)
    ranks = {1: rank}
    order = np.argsort(rank) if depth == 1 else None
    while h < depth:
        step = max(s for s in ranks if s <= min(h, depth - h))
        after = np.zeros(n, np.int64)
        on = left > h
        after[on] = ranks[step][np.flatnonzero(on) + h]
        key = rank * (int(ranks[step].max(initial=0)) + 1) + after
        order = np.argsort(key)
        new = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))[:n] + 1
        rank = np.empty(n, np.int64)
        rank[order] = new
        h += step
        ranks[h] = rank
    shared, same = np.zeros(n, np.int64), np.ones(max(n - 1, 0), bool)
    for d in range(depth if n else 0):
        word = np.where(left[order] > d, ids[np.minimum(order + d, n - 1)], 0)
        same &= (word[1:] == word[:-1]) & (word[1:] > 0)
        shared[1:] += same
    return order, shared


def gram_counts(ids: np.ndarray, left: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """m, the m-grams (rows of ids) and their counts, by LCP intervals."""
    order, shared = suffixes(ids, left, max(sizes))
    for m in sizes:
        heads = np.flatnonzero(shared < m)
        counts = np.diff(np.append(heads, len(order)))
        whole = left[order[heads]] >= m
        at = order[heads[whole]]
        yield m, np.stack([ids[at + d] for d in range(m)], 1) if len(at) else np.zeros((0, m), np.int64), counts[whole]


def _gram_rows(ids: np.ndarray, left: np.ndarray, sizes: list[int], longest: int) -> Iterator[list[pa.Array]]:
    for _, grams, counts in gram_counts(ids, left, sizes):
        wide = np.zeros((len(grams), longest), np.int32)
        wide[:, : grams.shape[1]] = grams
        for i in range(0, len(wide), 1 << 16):
            yield [*(pa.array(np.ascontiguousarray(wide[i : i + (1 << 16), k])) for k in range(longest)), pa.array(counts[i : i + (1 << 16)])]


def _key_order(columns: list[np.ndarray], tables: list[np.ndarray]) -> np.ndarray:
    """Sorted keys of phrases of m words: the number of the first m - 1 in the table of such phrases, then the last word."""
    head = columns[0].astype(np.int64)
    for table, word in zip(tables, columns[1:], strict=False):
        head = np.searchsorted(table, head << 32 | word) + 1
    return np.sort(head << 32 | columns[-1])


def runs_left(ids: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """Words to the end of the run in which every phrase of len(tables) + 1 words is in the tables; 0 outside of such runs."""
    n, head, m = len(ids), ids.astype(np.int64), len(tables) + 1
    for j, table in enumerate(tables, 1):
        key = np.zeros(n, np.int64)
        key[: max(n - j, 0)] = np.where((head[: max(n - j, 0)] > 0) & (ids[j:] > 0), head[: max(n - j, 0)] << 32 | ids[j:], 0)
        at = np.minimum(np.searchsorted(table, key), max(len(table) - 1, 0))
        head = np.where(table[at] == key, at + 1, 0) if len(table) else np.zeros(n, np.int64)
    return _runs_of(head > 0, m)


def _runs_of(starts: np.ndarray, m: int) -> np.ndarray:
    """Words to the end of the run, of phrases of m words that begin at each of the marked positions; 0 outside of such runs."""
    at = np.arange(len(starts))
    if not len(at):
        return at
    ends = np.where(starts, at + links_left(np.append(starts[:-1] & starts[1:], False)) + m - 1, 0)
    return np.maximum(np.maximum.accumulate(ends) - at, 0)


def _may_be(ids: np.ndarray, m: int, tables: list[np.ndarray]) -> np.ndarray:
    """Words to the end of the run, in which a phrase of m words is one of words that stand together, or of frequent phrases a word shorter."""
    if tables:
        return runs_left(ids, tables)
    return np.where(ids > 0, links_left(np.append((ids[:-1] > 0) & (ids[1:] > 0), False)[: len(ids)]), 0)


def _hashed(ids: np.ndarray, at: np.ndarray, m: int, bits: int) -> np.ndarray:
    """Counter of the phrase of m words at each of the positions."""
    h = ids[at].astype(U64)
    for d in range(1, m):
        h = mixed((h << U64(32)) + (h >> U64(32)) + ids[at + d].astype(U64))
    return (h >> U64(64 - bits)).astype(np.uint32)


def sifted(ids: np.ndarray, left: np.ndarray, m: int, full: np.ndarray) -> np.ndarray:
    """``left`` with only such phrases of m words as have a full counter (a bit each)."""
    at = np.flatnonzero(left >= m)
    place = _hashed(ids, at, m, (8 * len(full) - 1).bit_length())
    starts = np.zeros(len(ids), bool)
    starts[at] = full.take(place >> np.uint32(3)) << (place & np.uint32(7)).astype(np.uint8) & 0x80 > 0
    return _runs_of(starts, m)


def _full_counters(coded: DataFrame, m: int, sent, bits: int, least: int) -> np.ndarray:
    """A bit for each of 2 ** bits counters: whether the phrases of m words that share it stand ``least`` times in all shards. A frequent phrase always has a full one."""
    each = 1 << bits - (PIECES.bit_length() - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = _unzip(row["coded"])
                place = np.sort(_hashed(ids, np.flatnonzero(_may_be(ids, m, sent.value) >= m), m, bits))
                heads = np.flatnonzero(np.append(True, place[1:] != place[:-1])[: len(place)])
                place, times = place[heads], np.minimum(np.diff(np.append(heads, len(place))), least)
                cuts = np.searchsorted(place, np.arange(PIECES + 1, dtype=np.int64) * each).tolist()
                found = [(k, _zip(np.diff(place[i:j] % each, prepend=0)), _zip(times[i:j])) for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if i < j]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*found, strict=True)) or [()] * 3, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["piece", "gaps", "times"])

    def full(table: pa.Table) -> pa.Table:
        total = np.zeros(each, np.int64)
        for gaps, times in zip(table.column("gaps").to_pylist(), table.column("times").to_pylist(), strict=True):
            total[np.cumsum(_unzip(gaps))] += _unzip(times)
        return pa.table({"piece": pa.array([table.column("piece")[0].as_py()], pa.int32()), "full": pa.array([np.packbits(total >= least).tobytes()], pa.binary())})

    pieces = coded.select("coded").mapInArrow(released(count), "piece int, gaps binary, times binary").groupBy("piece").applyInArrow(full, "piece int, full binary")
    known, empty = {r.piece: r.full for r in pieces.collect()}, bytes(each // 8)
    return np.frombuffer(b"".join(known.get(k, empty) for k in range(PIECES)), np.uint8)


def _pairs_of(ids: np.ndarray) -> np.ndarray:
    return ids[:-1].astype(np.int64) << 32 | ids[1:]


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, longest: int = 5, top: int = 2000, shard_bytes: int = SHARD_BYTES, held: int = HELD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of 2 to ``longest`` words.

    a, l, r: how often the phrase, its first and its second part at its weakest cut stand in the language; n: words of the
    language; score: floor(1000 a n / (l r)) there. Phrases of fewer than ``least`` occurrences are none, and one that stands in
    a longer phrase wherever it stands is dropped. A null text is empty, a null language ``und``; rows that repeat count each
    time; empty tables give none; ties go by a, then by the phrase's bytes. Other columns are ignored. A text of any length is
    taken whole (some tens of bytes for each of its bytes in a task).
    """
    rows = renamed(docs, text=text_col, lang=lang_col).select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    parts = staged(rows.mapInArrow(released(_coding(shard_bytes)), CODED), "phrase-shards")
    vocabulary = parts.where("coded IS NULL").drop("coded", "spelled")
    totals = vocabulary.groupBy("lang").agg(F.sum("cnt").alias("n"))
    frequent = vocabulary.groupBy("lang", "word").agg(F.sum("cnt").alias("f")).where(F.col("f") >= least)
    words = staged(numbered(frequent, "wid", "phrase-words").withColumn("wid", (F.col("wid") + 1).cast("int")), "phrase-words")

    def mapped(coded: bytes, lids: np.ndarray, wids: np.ndarray) -> bytes:
        """The shard in ids of frequent words; other words are breaks, and words between breaks go."""
        ids = _unzip(coded)
        table = np.zeros(max(int(ids.max(initial=0)), int(lids.max(initial=0))) + 1, np.int32)
        table[lids] = wids
        ids = np.concatenate(([0], table[ids], [0]))
        ids[1:-1][(ids[:-2] == 0) & (ids[2:] == 0)] = 0
        return _zip(ids[np.concatenate(([True], (ids[1:] > 0) | (ids[:-1] > 0)))])

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, wids = known.value
        for batch in batches:
            for row in range(batch.num_rows):
                shard, ids, spelled = (column[row].as_py() for column in batch.columns)
                own = _unpacked(spelled)
                at = pc.index_in(_keys(own["lang"], own["word"]), value_set=keys)
                lids = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                yield pa.record_batch([pa.array([shard], pa.int64()), pa.array([mapped(ids, lids + 1, wids[at.drop_null().to_numpy()])], pa.binary())], names=["shard", "coded"])

    def answered(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(row["shard"], mapped(row["coded"], right.column("lid").to_numpy(), right.column("wid").to_numpy())) for row in left.to_pylist()]
        return pa.table([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], names=["shard", "coded"])

    coded = parts.where("coded IS NOT NULL")
    size = words.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("lang") + F.octet_length("word")).alias("bytes"), F.sum("f").alias("stand")).first()
    if size.n <= held and (size.bytes or 0) <= 32 * held:
        rows = words.select("lang", "word", "wid").toArrow().combine_chunks()
        known = docs.sparkSession.sparkContext.broadcast((_keys(rows["lang"], rows["word"]).combine_chunks(), rows["wid"].to_numpy()))
        coded = coded.select("shard", "coded", "spelled").mapInArrow(released(looked_up), "shard long, coded binary")
    else:
        # Too many to send to every task: each shard is told which of its own words are frequent, at most a row for each of its words.
        answers = vocabulary.join(words.select("lang", "word", "wid"), ["lang", "word"]).select(F.col("shard").alias("to"), "lid", "wid")
        coded = coded.select("shard", "coded").groupBy("shard").cogroup(answers.groupBy("to")).applyInArrow(answered, "shard long, coded binary")
    coded = staged(coded, "phrase-coded")

    spark = docs.sparkSession
    bits = min(max((size.stand or 0) // PER_COUNTER, 1).bit_length(), MOST_BITS)
    bits = max(bits, FEWEST_BITS)
    # Where even counters of rare phrases alone would be full, phrases are merged by key as they are.
    telling = (size.stand or 0) <= least << bits - 2

    def sieve(m: int, sent):
        return spark.sparkContext.broadcast(_full_counters(coded, m, sent, bits, least) if telling else None)

    def left_of(ids: np.ndarray, m: int, sent, full) -> np.ndarray:
        left = _may_be(ids, m, sent.value)
        return left if full is None or full.value is None else sifted(ids, left, m, full.value)

    none = spark.sparkContext.broadcast([])
    full_pairs = sieve(2, none)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = _unzip(row["coded"])
                left = left_of(ids, 2, none, full_pairs)
                for w1, w2, cnt in _gram_rows(ids[left > 0], left[left > 0], [2], 2):
                    yield pa.record_batch([pa.array(np.full(len(w1), row["shard"])), w1, w2, cnt], names=["shard", "w1", "w2", "cnt"])

    local = coded.mapInArrow(released(pairs), "shard long, w1 int, w2 int, cnt long")
    two = staged(local.groupBy("w1", "w2").agg(F.sum("cnt").alias("f")).where(F.col("f") >= least), "phrase-pairs")
    names = [f"w{k}" for k in range(1, longest + 1)]

    def longer(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([*((w, pa.int32()) for w in names), ("cnt", pa.int64())])
        known = np.sort(right.column("w1").to_numpy().astype(np.int64) << 32 | right.column("w2").to_numpy())
        found = []
        for row in left.to_pylist() if len(known) else ():
            ids = _unzip(row["coded"])
            key = _pairs_of(ids)
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            linked = np.append(known[at] == key, False)
            keep = linked | np.concatenate(([False], linked[:-1]))
            ids, linked = ids[keep].astype(np.int64), linked[keep]
            found += [pa.record_batch(columns, schema=schema) for columns in _gram_rows(ids, links_left(linked), list(range(3, longest + 1)), longest)]
        return pa.Table.from_batches(found, schema=schema)

    grams = two.select(F.array("w1", "w2").alias("g"), "f")
    if longest == 2:
        return _scored(grams, words, totals, top)
    schema = ", ".join(f"{w} int" for w in names) + ", cnt long"
    spelled = F.filter(F.array(*names), lambda w: w > 0).alias("g")
    found, tables = two, []
    for m in range(3, longest + 1):
        if found.count() > held:
            # Too many to send to every task: each shard is told which of its own pairs are frequent.
            asked = local.join(two.select("w1", "w2"), ["w1", "w2"], "left_semi").select(F.col("shard").alias("to"), "w1", "w2")
            more = coded.groupBy("shard").cogroup(asked.groupBy("to")).applyInArrow(longer, schema)
            more = staged(more.groupBy(*names).agg(F.sum("cnt").alias("f")).where(F.col("f") >= least), "phrase-longer")
            return _scored(two.select(F.array("w1", "w2").alias("g"), "f").unionByName(more.select(spelled, "f")), words, totals, top)
        rows = found.select(*names[: m - 1]).toArrow()
        tables.append(_key_order([rows.column(k).to_numpy() for k in range(m - 1)], tables))
        sent = spark.sparkContext.broadcast(list(tables))  # 8 bytes for each of at most ``held`` phrases a length

        # Longer phrases are few where those of three words are.
        full = sieve(m, sent) if m == 3 else None

        def level(batches: Iterator[pa.RecordBatch], m=m, sent=sent, full=full) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    ids = _unzip(row["coded"])
                    left = left_of(ids, m, sent, full)
                    for columns in _gram_rows(ids[left > 0].astype(np.int64), left[left > 0], [m], longest):
                        yield pa.record_batch(columns, names=[*names, "cnt"])

        more = coded.mapInArrow(released(level), schema).groupBy(*names).agg(F.sum("cnt").alias("f"))
        found = staged(more.where(F.col("f") >= least), "phrase-longer")
        grams = grams.unionByName(found.select(spelled, "f"))
    return _scored(grams, words, totals, top)


def _scored(grams: DataFrame, words: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """The frequent phrases g (arrays of word ids) with f: weakest cuts, those inside equals dropped, the first of each language. There are at most n / least a length."""
    parts = staged(grams.unionByName(words.select(F.array("wid").alias("g"), "f")), "phrase-grams")
    m = F.size("g")
    cuts = parts.where(m >= 2).select("g", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), m - 1)).alias("k"))
    cuts = cuts.select("g", "a", "k", F.slice("g", F.lit(1), F.col("k")).alias("first"), F.slice("g", F.col("k") + 1, m - F.col("k")).alias("rest"))
    cuts = cuts.join(parts.select(F.col("g").alias("first"), F.col("f").alias("l")), "first").join(parts.select(F.col("g").alias("rest"), F.col("f").alias("r")), "rest")
    lang = words.select(F.col("wid").alias("w1"), "lang").join(totals, "lang")
    cuts = cuts.withColumn("w1", F.col("g")[0]).join(lang, "w1")
    whole = {c: f"CAST({c} AS DECIMAL(19, 0))" for c in "anlr"}
    score = F.expr(f"(CAST(1000 AS DECIMAL(4, 0)) * {whole['a']} * {whole['n']}) div ({whole['l']} * {whole['r']})")
    best = cuts.groupBy("g", "a", "lang", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # A phrase that occurs in a longer one wherever it occurs does so in one that is longer by a word.
    inside = parts.where(m >= 3).select(F.explode(F.array(F.slice("g", F.lit(1), m - 1), F.slice("g", F.lit(2), m - 1))).alias("g"), F.col("f").alias("a"))
    kept = staged(best.join(inside, ["g", "a"], "left_anti").select("g", "a", "lang", "n", "cut.score", "cut.l", "cut.r"), "phrase-kept")
    spelled = kept.select("g", F.posexplode("g").alias("i", "wid")).join(words.select("wid", "word"), "wid").groupBy("g").agg(F.sort_array(F.collect_list(F.struct("i", "word"))).alias("w"))
    out = kept.join(spelled.select("g", F.array_join("w.word", " ").alias("phrase")), "g")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return out.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark, sf_dir):
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
     p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
     w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
     n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
     i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
     m AS (SELECT lang, w, i, unnest(range(0, least(5, len(w) - i + 1))) AS m FROM i),
     c AS (SELECT lang, w[i : i + m] AS g, count(*)::BIGINT AS f FROM m GROUP BY 1, 2 HAVING count(*) >= 100),
     k AS (SELECT lang, g, f AS a, unnest(range(1, len(g))) AS k FROM c WHERE len(g) >= 2),
     s AS (SELECT k.lang, k.g, k.k, a, l.f AS l, r.f AS r, n, ((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
           FROM k JOIN c l ON l.lang = k.lang AND l.g = k.g[1 : k.k] JOIN c r ON r.lang = k.lang AND r.g = k.g[k.k + 1 :] JOIN n ON n.lang = k.lang),
     b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
     x AS (SELECT lang, unnest([g[1 : len(g) - 1], g[2 :]]) AS g, f FROM c WHERE len(g) >= 3),
     o AS (SELECT b.* FROM b ANTI JOIN x ON b.lang = x.lang AND b.g = x.g AND x.f >= b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n, score
FROM o QUALIFY rank <= 2000
"""
