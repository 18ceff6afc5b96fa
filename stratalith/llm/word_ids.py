"""Token ids of texts by way of their distinct words.

Where a tokenizer works on each word of a text by itself, only the distinct words need it: a worker remembers the words
it has met, in a table by hash, with their bytes and ids, and texts are put together from those. A word counts as met
only if its bytes are the same too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .tokens import U64, mixed, span_hashes, text_chunks

#: Longest run of bytes that is taken at a time; longer texts are cut where a word begins.
RUN = 1 << 22
#: Slots, one after the other, in which a word may stand.
PROBES = 8


class _Grown:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.held, self.n = np.zeros(1024, dtype=dtype), 0

    def append(self, more: np.ndarray) -> None:
        n = self.n + len(more)
        if n > len(self.held):
            held = np.zeros(n + n // 2, dtype=self.held.dtype)
            held[: self.n] = self.held[: self.n]
            self.held = held
        self.held[self.n : n] = more
        self.n = n


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0] .. begin[0] + size[0] - 1, begin[1] ..."""
    return np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)


#: By length, to 8: the bits of so many bytes.
_BITS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)


def end_bytes(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last 8 bytes of each word, or as many as it has, as numbers: with its length they are all of a word of 16 bytes or fewer."""
    padded = np.zeros(len(buf) + 16, dtype=np.uint8)
    padded[8:-8] = buf
    eights = np.ndarray((len(buf) + 9,), "<u8", padded, strides=(1,))
    n = np.minimum(lengths, 8)
    return eights[starts + 8] & _BITS.take(n), eights[starts + lengths] >> (U64(8) * (8 - n).astype(U64))


class WordIds:
    """prepared(), begins() and tokenised() say what a word is and what its ids are; about ``remembered`` words, of 32 bytes on average, are kept."""

    #: (bytes, starts, ends) -> hash of each word; None: of its ends, and of all of it where they are not the whole.
    hashes_of = None

    def __init__(self, remembered: int = 1 << 18):
        self.remembered = remembered
        self.forget()

    def forget(self) -> None:
        # The row of a word by its hash, in one of PROBES slots; where all are taken, a later word takes the place of an earlier one. Row 0 is no word.
        self.table = np.zeros(1 << max(4, (2 * self.remembered - 1).bit_length()), dtype=np.int32)
        self.ids, self.bytes = _Grown(np.uint32), _Grown(np.uint8)
        # Of each row: its hash, where its ids and bytes begin and how many they are, its ends; whether it was met again since the last sweep.
        self.hash, self.at, self.size, self.off, self.length, self.first, self.last, self.met = map(_Grown, (U64, np.int64, np.int32, np.int64, np.int32, U64, U64, bool))
        none = np.zeros(1, dtype=U64)
        self._remember(none, self.ids.held[:0], np.zeros(1, dtype=np.int64), self.bytes.held[:0], np.full(1, -1), none, none)

    def sweep(self) -> None:
        """Keep the words met again since the last sweep; all go if those are too many."""
        rows = np.flatnonzero(self.met.held[: self.met.n])
        rows = rows[self.length.held[rows] >= 0]
        if 2 * len(rows) > self.remembered or self.length.held[rows].sum() > 16 * self.remembered:
            return self.forget()
        hashes, at, size, off, length, first, last = (x.held[rows] for x in (self.hash, self.at, self.size, self.off, self.length, self.first, self.last))
        ids, raw = self.ids.held[_ranges(at, size)], self.bytes.held[_ranges(off, length)]
        self.forget()
        self._remember(hashes, ids, size, raw, length, first, last)

    def _slot(self, hashes: np.ndarray, probe: int = 0) -> np.ndarray:
        return ((hashes + np.uint64(probe)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row of each hash, and whether it is there."""
        row = self.table.take(self._slot(hashes))
        known = (self.hash.held.take(row) == hashes) & (row > 0)
        left = np.flatnonzero(~known & (row > 0))
        for probe in range(1, PROBES):
            if not len(left):
                break
            there = self.table.take(self._slot(hashes[left], probe))
            same = (self.hash.held.take(there) == hashes[left]) & (there > 0)
            row[left[same]], known[left[same]] = there[same], True
            left = left[~same & (there > 0)]
        return row, known

    def _remember(self, hashes, ids, size, raw, length, first, last) -> np.ndarray:
        """Rows of the words."""
        rows = np.arange(self.hash.n, self.hash.n + len(hashes), dtype=np.int32)
        self.at.append(self.ids.n + np.cumsum(size) - size)
        self.off.append(self.bytes.n + np.cumsum(length) - length)
        for column, values in ((self.hash, hashes), (self.size, size), (self.length, length), (self.first, first), (self.last, last), (self.met, np.zeros(len(hashes), dtype=bool)), (self.ids, ids), (self.bytes, raw)):
            column.append(values)
        left = np.arange(len(hashes))
        for probe in range(PROBES):
            slots = self._slot(hashes[left], probe)
            free = self.table[slots] == 0
            self.table[slots[free]] = rows[left[free]]
            left = left[self.table[slots] != rows[left]]
            if not len(left):
                break
        self.table[self._slot(hashes[left])] = rows[left]
        return rows

    def _hashes(self, buf, starts, lengths, first, last) -> np.ndarray:
        if self.hashes_of:
            return self.hashes_of(buf, starts, starts + lengths)
        hashes = mixed(first ^ mixed(last + lengths.astype(U64) * U64(0x9E3779B97F4A7C15)))
        long = np.flatnonzero(lengths > 16)
        if len(long):
            ends = np.cumsum(lengths[long])
            hashes[long] = span_hashes(buf[_ranges(starts[long], lengths[long])], ends - lengths[long], ends)
        return hashes

    def _same(self, row, buf, starts, lengths, first, last) -> bool:
        """Whether each word is that of its row."""
        if (self.length.held.take(row) != lengths).any() or (self.first.held.take(row) != first).any() or (self.last.held.take(row) != last).any():
            return False
        long = np.flatnonzero(lengths > 16)
        return bool((self.bytes.held[_ranges(self.off.held[row[long]], lengths[long])] == buf[_ranges(starts[long], lengths[long])]).all())

    def prepared(self, text: bytes) -> bytes:
        return text

    def begins(self, buf: np.ndarray) -> np.ndarray:
        """Whether a word begins at each byte but the first."""
        raise NotImplementedError

    def tokenised(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many are each word's."""
        raise NotImplementedError

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many are each text's."""
        return self._encoded([self.prepared(t) for t in texts])

    def _encoded(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = b"".join(texts)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        buf = np.frombuffer(raw, dtype=np.uint8)
        if not len(buf):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(texts), dtype=np.int64)
        begin = np.ones(len(buf), dtype=bool)
        begin[1:] = self.begins(buf)
        ends = np.cumsum(sizes)
        begin[ends[:-1][ends[:-1] < len(buf)]] = True
        starts = np.flatnonzero(begin)
        lengths = np.diff(np.append(starts, len(buf)))
        if self.hash.n > self.remembered or self.bytes.n > 32 * self.remembered:
            self.sweep()
        first, last = end_bytes(buf, starts, lengths)
        hashes = self._hashes(buf, starts, lengths, first, last)
        row, known = self._found(hashes)
        self.met.held[row[known]] = True
        unknown = np.flatnonzero(~known)
        if len(unknown):
            distinct, at, inverse = np.unique(hashes[unknown], return_index=True, return_inverse=True)
            some = unknown[at]
            flat, n = self.tokenised([raw[i : i + m] for i, m in zip(starts[some].tolist(), lengths[some].tolist(), strict=True)])
            row[unknown] = self._remember(distinct, flat, n, buf[_ranges(starts[some], lengths[some])], lengths[some], first[some], last[some])[inverse]
        if self._same(row, buf, starts, lengths, first, last):
            each = self.size.held.take(row).astype(np.int64)
            ids = self.ids.held.take(_ranges(self.at.held.take(row), each))
        else:  # two words share a hash: take this run's words by their bytes
            words = [raw[i : i + m] for i, m in zip(starts.tolist(), lengths.tolist(), strict=True)]
            number = {w: k for k, w in enumerate(dict.fromkeys(words))}
            flat, n = self.tokenised(list(number))
            which = np.fromiter((number[w] for w in words), dtype=np.int64, count=len(words))
            each = n[which].astype(np.int64)
            ids = flat[_ranges((np.cumsum(n) - n)[which], each)]
        upto = np.concatenate(([0], np.cumsum(each))).take(np.searchsorted(starts, ends))
        return ids, np.diff(upto, prepend=0)

    def runs(self, text: bytes, most: int = RUN) -> Iterator[bytes]:
        """A prepared text cut where words begin, in runs of about ``most`` bytes (more only where a word is longer)."""
        begin = 0
        while len(text) - begin > most:
            for reach in (1 << 12, most, len(text)):
                buf = np.frombuffer(text, dtype=np.uint8, offset=begin, count=min(len(text) - begin, most + reach))
                low = most - min(reach, most)
                cuts = np.flatnonzero(self.begins(buf[low:]))
                if len(cuts):
                    break
            else:
                break
            cut = begin + low + 1 + int(cuts[len(cuts) // 2])
            yield text[begin:cut]
            begin = cut
        yield text[begin:]

    def encode_column(self, column: pa.Array, most: int = RUN) -> Iterator[tuple[slice, list[bytes], np.ndarray, np.ndarray]]:
        """Runs of a text column: their rows, texts, ids, and how many ids are each text's."""
        for part, texts in text_chunks(column):
            if len(texts) == 1 and len(texts[0]) > most:
                ids = [self._encoded([run])[0] for run in self.runs(self.prepared(texts[0]), most)]
                yield part, texts, np.concatenate(ids), np.array([sum(map(len, ids))])
            else:
                yield part, texts, *self.encode(texts)
