"""Vectorised words, lines and hashes over the bytes of many texts at once.

A word is ``[^\\x20\\x09-\\x0D]+``: the ASCII white space that ``bytes.split()`` uses.
No Python object is made for a word; a chunk of texts is one byte array and words are
spans in it with a 64-bit hash each.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

_BASE = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche; a bijection of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@lru_cache(maxsize=2)
def _byte_values(family: int) -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93 + 2 * family))


class _Powers:
    """base**i and base**-i modulo 2**64, grown to the longest chunk seen."""

    def __init__(self, family: int):
        base = _BASE[family]
        self.base, self.inverse = U64(base), U64(pow(base, -1, 2**64))
        self.up = self.down = np.ones(1, dtype=U64)

    def to(self, n: int) -> None:
        if len(self.up) < n:
            size = n + n // 8
            self.up = np.multiply.accumulate(np.concatenate(([U64(1)], np.full(size - 1, self.base))))
            self.down = np.multiply.accumulate(np.concatenate(([U64(1)], np.full(size - 1, self.inverse))))


_powers: dict[int, _Powers] = {}


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """64-bit hash of each span of bytes; equal spans have equal hashes wherever they lie."""
    p = _powers.setdefault(family, _Powers(family))
    p.to(len(buf) + 1)
    total = np.empty(len(buf) + 1, dtype=U64)
    total[0] = 0
    np.cumsum(_byte_values(family)[buf] * p.up[: len(buf)], out=total[1:])
    return mixed((total[ends] - total[starts]) * p.down[starts] + (ends - starts).astype(U64))


class Chunk:
    """Some texts as one byte array, each followed by a newline."""

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n" if texts else b"", dtype=np.uint8)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=self.n) + 1
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        blank = np.concatenate(([True], BLANK[self.buf]))
        edge = np.flatnonzero(blank[1:] != blank[:-1])
        self.w_starts, self.w_ends = edge[::2], edge[1::2]
        self.w_doc = np.searchsorted(self.ends, self.w_starts, "right")
        self.n_words = np.bincount(self.w_doc, minlength=self.n)

    def word_hashes(self, family: int = 0) -> np.ndarray:
        return span_hashes(self.buf, self.w_starts, self.w_ends, family)

    def bounds(self) -> np.ndarray:
        """Index of each text's first word, and the number of words."""
        return np.concatenate(([0], np.cumsum(self.n_words)))

    def words(self) -> list[bytes]:
        raw = self.buf.tobytes()
        return [raw[a:b] for a, b in zip(self.w_starts.tolist(), self.w_ends.tolist(), strict=True)]


def windows(word_hashes: np.ndarray, k: int, family: int = 0) -> np.ndarray:
    """Hash of the k words that start at each position (positions short of k words are left off)."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    base = U64(_BASE[family] ^ 0x5851F42D4C957F2C)
    out = word_hashes[:n].copy()
    for j in range(1, k):
        out *= base
        out += word_hashes[j : j + n]
    return mixed(out)


def within(w_doc: np.ndarray, k: int) -> np.ndarray:
    """Whether the k words that start at each position lie in one text."""
    n = len(w_doc) - k + 1
    return w_doc[:n] == w_doc[k - 1 :] if n > 0 else np.zeros(0, dtype=bool)


def as_bytes(column: pa.ChunkedArray | pa.Array, lower: bool = False) -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    column = pc.fill_null(column, "")
    if lower:
        column = pc.utf8_lower(column)
    return pc.cast(column, pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def text_chunks(column: pa.Array, most: int = 1 << 20, count: int = 2000, lower: bool = False) -> Iterator[tuple[slice, list[bytes]]]:
    """Runs of a text column, of about ``most`` bytes and at most ``count`` texts, as UTF-8; a longer text is a run of its own, null is empty."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = total = 0
    for i, size in enumerate([*sizes, None]):
        if size is None or (i > start and (total + size > most or i - start == count)):
            if i > start:
                yield slice(start, i), as_bytes(column.slice(start, i - start), lower)
            start, total = i, 0
        total += size or 0


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, giving freed memory back to the system when its task ends: Spark keeps the worker for later tasks."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return inner
