"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text gets the dummy prefix and its blanks become the mark U+2581; it is cut into marked words, the distinct ones
are sorted, and the sorted list is walked as a trie, depth first: the forward scores of a prefix are kept on a stack,
so that the words that share it share the work, and a word only adds the scores of its own end.

The lattice scores follow the model file. For a unigram model the score of a prefix is its best sum of piece scores.
For a BPE model a path is valid when every pair of neighbouring pieces is what byte-pair merging makes of the two
alone (then the whole path is what merging makes of the whole word); just one path to each prefix is valid, and its
score is 0. Both give the ids of the library. Characters that the model lacks become byte pieces.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import renamed
from .tokens import released
from .word_ids import WordIds

MARK = "▁"
UNIGRAM, BPE = 1, 2


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The pieces of a SentencePiece model file, and the encoder over them."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces or not proto.trainer_spec.byte_fallback:
            raise ValueError("a model with identity normalisation and byte fallback is needed")
        self.kind = proto.trainer_spec.model_type
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.texts = [p.piece for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (1, 4)}
        self.scores = [p.score for p in proto.pieces]
        self.byte_ids = [0] * 256
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                self.byte_ids[int(p.piece[3:5], 16)] = i
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.unknown = next((i for i, p in enumerate(proto.pieces) if p.type == 2), 0)
        self.special = {i for i, p in enumerate(proto.pieces) if p.type == 3}
        #: The pieces from their last character to their first, as nested dictionaries; "" holds the id.
        self.endings: dict = {}
        for p, i in self.ids.items():
            node = self.endings
            for char in reversed(p):
                node = node.setdefault(char, {})
            node[""] = i
        self.pairs: dict[int, bool] = {}  # by left id * 2**24 + right id
        self.least = min(self.scores) - 10.0
        self.encoded = [p.encode() for p in self.texts]

    def bytes_of(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()]

    def merged(self, word: str) -> list[int]:
        """Ids by byte-pair merging: the neighbours whose joint piece scores best merge first, leftmost on ties."""
        parts: list = list(word)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list = []

        def offer(i):
            j = after[i]
            if j < len(parts) and (k := self.ids.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-self.scores[k], i, j, parts[i] + parts[j]))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, j, joint = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != joint:
                continue
            parts[i], parts[j] = joint, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        out: list[int] = []
        for p in parts:
            if p is not None:
                out += [self.ids[p]] if p in self.ids else self.bytes_of(p)
        return out

    def pair(self, a: int, b: int) -> bool:
        known = self.pairs.get(a << 24 | b)
        if known is None:
            if len(self.pairs) > 1 << 17:
                self.pairs.clear()
            known = self.pairs[a << 24 | b] = self.merged(self.texts[a] + self.texts[b]) == [a, b]
        return known

    def encode_sorted(self, words: list[str]) -> list[list[int]]:
        """Ids of distinct words in code point order, by depth-first traversal of their trie."""
        unigram = self.kind == UNIGRAM
        ids, endings, scores, pairs = self.ids, self.endings, self.scores, self.pairs
        found: list[list[int]] = []
        before = ""
        # By length of the prefix: where its last piece starts, that piece (-1: a character as bytes), forward score.
        start, last, score = [0], [-2], [0.0]
        for word in words:
            if not unigram and word.startswith(MARK + MARK):  # pieces of blanks only tie; merge them as they stand
                found.append(self.merged(word))
                continue
            n = min(len(word), len(before))
            shared = next((i for i in range(n) if word[i] != before[i]), n)
            del start[shared + 1 :], last[shared + 1 :], score[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                # Only a character that is no piece goes as bytes.
                at, piece, best = end - 1, -1, float("-inf")
                if unigram and word[at] not in ids:
                    best = score[at] + self.least
                node = endings
                for i in range(end - 1, -1, -1):
                    node = node.get(word[i])
                    if node is None:
                        break
                    k = node.get("")
                    if k is None:
                        continue
                    if unigram:
                        if score[i] + scores[k] > best:
                            at, piece, best = i, k, score[i] + scores[k]
                    else:
                        left = last[i]
                        if left >= 0:
                            fits = pairs.get(left << 24 | k)
                            if fits is None:
                                fits = self.pair(left, k)
                            if not fits:
                                continue
                        at, piece = i, k
                        break
                start.append(at)
                last.append(piece)
                score.append(best)
            out: list[int] = []
            end = len(word)
            while end:
                i, k = start[end], last[end]
                out += self.bytes_of(word[i:end])[::-1] if k < 0 else (k,)
                end = i
            found.append(out[::-1])
            before = word
        return found

    def decode(self, ids: list[int]) -> str:
        """Text of ids; byte pieces join to UTF-8, and what is no UTF-8 becomes U+FFFD."""
        if self.unknown in ids or not self.special.isdisjoint(ids):
            raw = b"".join(b" \xe2\x81\x87 " if i == self.unknown else bytes((self.byte_of[i],)) if i in self.byte_of else b"" if i in self.special else self.encoded[i] for i in ids)
        else:
            raw = self.raw(ids)
        text = raw.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text

    def raw(self, ids: list[int]) -> bytes:
        if not hasattr(self, "joined"):
            self.joined = [bytes((self.byte_of[i],)) if i in self.byte_of else e for i, e in enumerate(self.encoded)]
        joined = self.joined
        return b"".join([joined[i] for i in ids])


class Encoder(WordIds):
    """Encodes chunks of texts word by word. A word: some blanks and what follows, or a newline, which no piece holds, alone."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces
        self.prefix = b" " if pieces.prefix else b""

    def prepared(self, text: bytes) -> bytes:
        return self.prefix + text.replace(MARK.encode(), b" ") if text else b""

    def begins(self, buf: np.ndarray) -> np.ndarray:
        blank, line = buf == 0x20, buf == 0x0A
        return (blank[1:] & ~blank[:-1]) | line[1:] | line[:-1]

    def tokenised(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        marked = [w.decode().replace(" ", MARK) for w in words]
        order = sorted(range(len(marked)), key=marked.__getitem__)
        found: list = [None] * len(marked)
        for k, ids in zip(order, self.pieces.encode_sorted([marked[k] for k in order]), strict=True):
            found[k] = ids
        n = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter((i for ids in found for i in ids), dtype=np.uint32, count=int(n.sum())), n


_encoders: dict[int, Encoder] = {}


def _encoder(model: bytes) -> Encoder:
    key = zlib.crc32(model)
    if key not in _encoders:
        _encoders[key] = Encoder(Pieces(model))
    return _encoders[key]


def encoded(docs: DataFrame, model_file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_tokens, ids.

    Null and empty texts have no ids; a U+2581 in a text is a blank, as in the library. Null ids and repeated rows are encoded like others; an empty table gives no
    rows; other columns are ignored. ``model_file`` is read on the driver.
    """
    with open(model_file or default_model(), "rb") as f:
        model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        for batch in batches:
            for part, _, ids, n in encoder.encode_column(batch.column("text")):
                offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                yield pa.record_batch({"id": batch.column("id")[part], "n_tokens": n, "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))})

    rows = renamed(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text")
    return rows.mapInArrow(released(run), "id long, n_tokens long, ids array<int>").withColumnRenamed("id", id_col)


def decoded(tokens: DataFrame, model_file: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: id_col, text. Null ids of tokens give an empty text."""
    with open(model_file or default_model(), "rb") as f:
        model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _encoder(model).pieces
        for batch in batches:
            yield pa.record_batch({"id": batch.column("id"), "text": pa.array([pieces.decode(ids or []) for ids in batch.column("ids").to_pylist()], pa.string())})

    rows = renamed(tokens, id=id_col, ids=ids_col).select(F.col("id").cast("long").alias("id"), "ids")
    return rows.mapInArrow(released(run), "id long, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, model_file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_tokens, ids_crc32 (of little-endian 32-bit ids), decoded_chars, same (decoding gives the text back)."""
    with open(model_file or default_model(), "rb") as f:
        model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        for batch in batches:
            for part, some, ids, n in encoder.encode_column(batch.column("text")):
                cuts = np.concatenate(([0], np.cumsum(n))).tolist()
                raw, listed = ids.astype("<u4").tobytes(), ids.tolist()
                back = [encoder.pieces.decode(listed[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]
                yield pa.record_batch(
                    {
                        "id": batch.column("id")[part],
                        "n_tokens": n,
                        "ids_crc32": pa.array([zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(cuts, cuts[1:], strict=False)], pa.int64()),
                        "decoded_chars": pa.array(list(map(len, back)), pa.int64()),
                        "same": [b.encode() == t for b, t in zip(back, some, strict=True)],
                    }
                )

    rows = renamed(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text")
    return rows.mapInArrow(released(run), "id long, n_tokens long, ids_crc32 long, decoded_chars long, same boolean").withColumnRenamed("id", id_col)


def op4_sentencepiece(spark, sf_dir):
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
