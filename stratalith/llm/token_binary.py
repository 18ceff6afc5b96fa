"""Token ids as a binary table: byte-level BPE ids in document order, coded in independently reset, checksummed blocks.

The table is Parquet (Spark's writers commit it, whichever executors are lost), a row per segment: part and seq (their
order is the order of documents), the ids and token counts of the segment's documents, and the coded ids (range_coder).
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import range_coder
from .storage import new_path, renamed
from .tokens import released
from .word_ids import WordIds

END_ID = 2
_WHITE, _LETTER, _MARK = np.zeros((3, 256), dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARKS = b".,;:!?#*$%&"
_MARK[list(_MARKS)] = True
#: Letters of ASCII, Latin-1 and Latin Extended-A, after a blank or none.
_PLAIN = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4\xc5][\x80-\xbf])+")
#: The characters that stand for bytes in a byte-level vocabulary: visible ones of Latin-1 for themselves, others from U+0100 on in turn.
_SHOWN = np.arange(256, dtype="<u4")
_hidden = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE)]
_SHOWN[_hidden] = np.arange(256, 256 + len(_hidden))


def _plain(buf: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of the words, whose bytes stand end to end in ``buf``, _PLAIN matches from end to end."""
    starts, after = np.cumsum(lengths) - lengths, np.append(buf[1:], np.uint8(0))
    lead = (buf == 0xC4) | (buf == 0xC5) | (buf == 0xC3) & (after != 0x97) & (after != 0xB7)
    good = _LETTER.take(buf) | lead
    good[1:] |= lead[:-1]
    good[starts[(buf[starts] == 0x20) & (lengths > 1)]] = True
    return np.logical_and.reduceat(good, starts) if len(starts) else np.zeros(0, dtype=bool)


SCHEMA = "part int, seq int, doc_ids array<long>, n_tokens array<long>, coded binary"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteLevelBPE(WordIds):
    """Encodes texts with the tokenizers library, each distinct word once.

    The tokenizer's own pattern never joins a character with white space after it, nor a letter with a mark such as a full
    stop after it; a word begins at such white space and at such marks. An added token in a text has neither in it (or marks
    are not looked at), so it is whole in a word, and gets its own id as the library gives it.
    """

    def __init__(self, spec: str):
        super().__init__(remembered=1 << 20)
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.size_of_vocabulary = self.tokenizer.get_vocab_size()
        # Each character of a token stands for a byte; of an added token the text itself is meant.
        added = self.tokenizer.get_added_tokens_decoder()
        self.marks_apart = not any(re.search(rb"[A-Za-z][" + _MARKS + rb"]", t.content.encode()) for t in added.values())
        # Such letters alone are one piece of the pattern: the library's model takes them as they are.
        how = json.loads(spec)
        before, model = how.get("pre_tokenizer") or {}, how.get("model") or {}
        self.plain_whole = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True) and not (how.get("normalizer") or how.get("truncation") or how.get("padding"))
        self.plain_whole = self.plain_whole and not model.get("dropout") and not any(_PLAIN.search(t.content.encode()) and re.fullmatch(r"[ \w]*", t.content) for t in added.values())
        self.token_bytes = np.array([len(added[i].content.encode() if i in added else self.tokenizer.id_to_token(i) or "") for i in range(self.size_of_vocabulary)])

    def begins(self, buf: np.ndarray) -> np.ndarray:
        white = _WHITE.take(buf)
        after = white[1:] & ~white[:-1]
        # Characters beyond ASCII that may be white space: U+0085, U+00A0 and those of three bytes from 0xE1 to 0xE3; and the separators 0x1C to 0x1F.
        odd = (buf[:-1] >= 0x1C) & (buf[:-1] <= 0x1F)
        odd[1:] |= (buf[:-2] == 0xC2) & ((buf[1:-1] == 0x85) | (buf[1:-1] == 0xA0))
        odd[2:] |= (buf[:-3] >= 0xE1) & (buf[:-3] <= 0xE3)
        after &= ~odd
        if self.marks_apart:
            after |= _LETTER.take(buf[:-1]) & _MARK.take(buf[1:])
        return after

    def tokenised(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths, raw = np.fromiter(map(len, words), dtype=np.int64, count=len(words)), b"".join(words)
        plain = _plain(np.frombuffer(raw, dtype=np.uint8), lengths) if self.plain_whole else np.zeros(len(words), dtype=bool)
        if not plain.any():
            return self.by_pattern(words)
        tokenize, n = self.tokenizer.model.tokenize, np.zeros(len(words), dtype=np.int64)
        # No plain word holds a line feed, which is shown as another character.
        shown = _SHOWN.take(np.frombuffer(b"\n".join(itertools.compress(words, plain.tolist())), dtype=np.uint8)).tobytes().decode("utf-32-le")
        found = [[t.id for t in tokenize(w)] for w in shown.split(chr(_SHOWN[0x0A]))]
        n[plain] = [len(ids) for ids in found]
        rest, n[~plain] = self.by_pattern([words[i] for i in np.flatnonzero(~plain).tolist()])
        out, of_plain = np.zeros(int(n.sum()), dtype=np.uint32), np.repeat(plain, n)
        out[of_plain], out[~of_plain] = list(itertools.chain.from_iterable(found)), rest
        return out, n

    def by_pattern(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words that begin with white space, so that they are words in any company, go as one text; its ids are dealt out by their bytes."""
        joint = np.fromiter((_WHITE[w[0]] for w in words), dtype=bool, count=len(words))
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        while True:
            which = np.flatnonzero(joint)
            text = b"".join([words[i] for i in which.tolist()])
            ends = np.cumsum(length[which])
            # A word such as one of white space alone would melt into the one after it.
            clean = self.begins(np.frombuffer(text + b" ", dtype=np.uint8))[ends - 1] if len(which) else np.ones(0, dtype=bool)
            if clean.all():
                break
            joint[which[~clean]] = False
        flat = np.array(self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, dtype=np.uint32)
        upto = np.cumsum(self.token_bytes[flat])
        last = np.searchsorted(upto, ends)
        if len(which) and (upto[-1] != ends[-1] or (upto[np.minimum(last, len(upto) - 1)] != ends).any()):
            raise ValueError("a token goes beyond a word")
        n = np.zeros(len(words), dtype=np.int64)
        n[which] = np.diff(last + 1, prepend=0)
        alone = np.flatnonzero(~joint)
        found = [e.ids for e in self.tokenizer.encode_batch_fast([words[i].decode() for i in alone.tolist()], add_special_tokens=False)]
        n[alone] = [len(ids) for ids in found]
        out = np.zeros(int(n.sum()), dtype=np.uint32)
        of_joint = np.repeat(joint, n)
        out[of_joint] = flat
        out[~of_joint] = [i for ids in found for i in ids]
        return out, n


_bpe: dict[int, ByteLevelBPE] = {}


def _of(spec: str) -> ByteLevelBPE:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = zlib.crc32(spec.encode())
    if key not in _bpe:
        _bpe[key] = ByteLevelBPE(spec)
    return _bpe[key]


def _writer(spec: str, end_id: int, segment_ids: int):
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("coded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, seq = _of(spec), TaskContext.get().partitionId(), 0
        docs: list = []
        sizes: list[int] = []
        held: list[np.ndarray] = []

        def segment():
            nonlocal seq, docs, sizes, held
            row = {"part": part, "seq": seq, "doc_ids": docs, "n_tokens": sizes, "coded": range_coder.encode(np.concatenate(held), bpe.size_of_vocabulary)}
            docs, sizes, held, seq = [], [], [], seq + 1
            return pa.RecordBatch.from_pylist([row], schema=schema)

        total = 0
        for batch in batches:
            for part_of, _, flat, n in bpe.encode_column(batch.column("text")):
                ends = np.cumsum(n)
                flat = np.insert(flat, ends, end_id)  # an end after each document
                docs += batch.column("id")[part_of].to_pylist()
                sizes += (n + 1).tolist()
                held.append(flat)
                total += len(flat)
                if total >= segment_ids:
                    yield segment()
                    total = 0
        if docs:
            yield segment()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", segment_ids: int = 1 << 22) -> None:
    """Write the token ids of ``docs``, by ascending id (null first; rows of one id by text), an end id after each.

    Null text is empty. An empty table writes an empty one; other columns are ignored. ``segment_ids`` is about what
    a task holds at a time; a longer document is a segment of its own (4 bytes an id; it is tokenised and coded in runs).
    """
    with open(tokenizer_file or default_tokenizer(), encoding="utf-8") as f:
        spec = f.read()
    rows = renamed(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = max(1, rows.rdd.getNumPartitions())
    rows.repartitionByRange(parts, "id").sortWithinPartitions("id", "text").mapInArrow(released(_writer(spec, end_id, segment_ids)), SCHEMA).write.parquet(path)


def _reader(n_ids: int, digest: bool):
    columns = {"part": pa.int32(), "seq": pa.int32(), "doc_id": pa.int64(), "before": pa.int64(), "n_tokens": pa.int64()}
    schema = pa.schema([*columns.items(), ("ids_crc32", pa.int64()) if digest else ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, seq, docs, sizes, coded = (batch.column(c)[row].as_py() for c in ("part", "seq", "doc_ids", "n_tokens", "coded"))
                ids = range_coder.decode(coded, n_ids)
                offsets, raw = np.concatenate(([0], np.cumsum(sizes))), memoryview(ids.astype("<u4", copy=False)).cast("B")
                for i in range(0, len(docs), 2000):
                    cut = offsets[i : i + 2001]
                    n = len(cut) - 1
                    if digest:
                        last = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.int64())
                    else:
                        last = pa.ListArray.from_arrays(pa.array((cut - cut[0]).astype(np.int32)), pa.array(ids[cut[0] : cut[-1]].astype(np.int32)))
                    yield pa.record_batch([pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(docs[i : i + n], pa.int64()), pa.array(cut[:-1]), pa.array(np.diff(cut)), last], schema=schema)

    return run


def read_tokens(spark: SparkSession, path: str, tokenizer_file: str | None = None, digest: bool = False) -> DataFrame:
    """Documents of a table of tokens: part, seq (segment), doc_id, before (ids before it in the segment), n_tokens, ids.

    ``digest``: instead of the decoded ids only ids_crc32, of the ids as little-endian unsigned 32-bit integers.
    """
    with open(tokenizer_file or default_tokenizer(), encoding="utf-8") as f:
        n_ids = _of(f.read()).size_of_vocabulary
    last = "ids_crc32 long" if digest else "ids array<int>"
    return spark.read.schema(SCHEMA).parquet(path).mapInArrow(released(_reader(n_ids, digest)), f"part int, seq int, doc_id long, before long, n_tokens long, {last}")


def segment_starts(spark: SparkSession, path: str) -> DataFrame:
    """part, seq, start: ids before each segment. Only the counts are read; the sums go by part, then within parts."""
    sizes = spark.read.schema(SCHEMA).parquet(path).select("part", "seq", F.expr("aggregate(n_tokens, 0L, (a, n) -> a + n)").alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))  # a row per partition
    inside = sizes.select("part", "seq", (F.sum("n").over(Window.partitionBy("part").orderBy("seq")) - F.col("n")).alias("start"))
    return inside.join(parts, "part").select("part", "seq", (F.col("start") + F.col("first")).alias("start"))


def op8_token_binary(spark, sf_dir):
    path = new_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    rows = read_tokens(spark, path, digest=True)
    return rows.join(segment_starts(spark, path), ["part", "seq"]).select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
