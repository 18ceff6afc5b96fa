"""Adaptive context-mixing range coder for token ids.

Ids are cut into blocks that know nothing of each other. In a block the distribution of each id is a mixture of three
predictions: what followed the last two ids before (order 2), what followed the last id before (order 1), and the counts
of the block so far (order 0). Orders 1 and 2 learn from every id. The counts, and the weights of the three by what
orders 1 and 2 have in store (nothing, a guess, a confirmed guess), are taken anew at ids 64, 128, 256 ... Order 0
keeps room for fresh ids, as much as there are ids seen once. The fresh ids of a block are a list of their own before
it, coded by a fixed slowly falling prior, so that the coder of the block only says when the next of them comes.

The blocks of a segment are coded in step, as lanes of arrays. Only whole numbers below 2^53 and basic arithmetic take
part (exact in any floating-point unit), so a block decodes alike in any company.

A segment: "RCS2", the number of blocks, then for each block its ids, its fresh ids, the bytes of the list, the bytes
of the block and the crc32 of its ids, then lists and blocks by turns; all as little-endian 32-bit numbers.
"""

from __future__ import annotations

import zlib

import numpy as np

MAGIC, HEAD = b"RCS2", 5
BLOCK, LANES = 2048, 2048
#: The range lies between 2^32 and 2^48; words of 16 bits leave it.
TOP, WORD = 2.0**48, 2.0**16
BOTTOM = TOP / WORD
ID_BITS = 17
_ID = (1 << ID_BITS) - 1
SLOTS1, SLOTS2 = 256, 256
#: What an order has in store: 0 nothing, 1 a guess, 2 a guess that was right the last time. A kind: order 1's + 4 * order 2's.
KINDS = 16
#: Tries and hits that the weights start from, by what the order has in store.
TRIES, HITS = 16.0, np.array([0.0, 1.5, 8.0, 0.0])
FIRST_COUNT, PIECE = 64, 256


class Prior:
    """Whole-number prior over ids 0 .. n-1: falls with the id, never 0."""

    def __init__(self, n: int):
        if n >= _ID:
            raise ValueError(f"{n} ids are too many")
        sizes = np.maximum(1, 40_000 // (np.arange(max(n, 1)) + 400))
        self.size = sizes.astype(np.float64)
        self.start = np.cumsum(self.size) - self.size
        self.total = float(self.size.sum())
        self.id_at = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)


_priors: dict[int, Prior] = {}


def prior(n: int) -> Prior:
    if n not in _priors:
        _priors[n] = Prior(n)
    return _priors[n]


class _Contexts:
    """What orders 1 and 2 foresee, by lane."""

    def __init__(self, lanes: int):
        # Entries: the id that followed, and what is in store: from bit ID_BITS on for order 1, from bit ID_BITS + 2 on for order 2.
        self.t1, self.t2 = np.full(lanes * SLOTS1, _ID, dtype=np.int32), np.full(lanes * SLOTS2, _ID, dtype=np.int32)
        lane = np.arange(lanes, dtype=np.int32)
        self.base1, self.base2 = lane * np.int32(SLOTS1), lane * np.int32(SLOTS2)
        same = lambda v: np.full(lanes, v, dtype=np.int32)  # noqa: E731  (arrays: numpy is slower with numbers)
        self.id, self.m1, self.m2, self.spread, self.bits, self.once1, self.once2 = map(same, (_ID, SLOTS1 - 1, SLOTS2 - 1, 23, ID_BITS, 1 << ID_BITS, 4 << ID_BITS))
        self.i1, self.i2, self.before = self.base1, self.base2, same(0)

    def foresee(self) -> np.ndarray:
        """Kind of each lane; g1 and g2 are the guesses."""
        e1, e2 = self.t1.take(self.i1), self.t2.take(self.i2)
        self.g1, self.g2 = e1 & self.id, e2 & self.id
        return (e1 | e2) >> self.bits

    def learn(self, ids: np.ndarray, is1: np.ndarray, is2: np.ndarray) -> None:
        """is1, is2: whether the guesses were right."""
        self.t1[self.i1] = ids + self.once1 + is1 * self.once1
        self.t2[self.i2] = ids + self.once2 + is2 * self.once2
        self.i1 = (ids & self.m1) + self.base1
        self.i2 = ((ids ^ self.before) & self.m2) + self.base2
        self.before = ids * self.spread


class _Weights:
    """Weights of orders 2 and 1 beside order 0, by lane and kind, from the hits and tries so far."""

    def __init__(self, lanes: int):
        k = np.arange(KINDS)
        self.hits2, self.hits1 = np.tile(HITS[k >> 2], (lanes, 1)), np.tile(HITS[k & 3] * np.where(k >> 2 == 2, 0.2, 0.6), (lanes, 1))
        self.some2, self.some1 = k >> 2 > 0, k & 3 > 0
        self.tries = np.full((lanes, KINDS), TRIES)
        self.lane = np.arange(lanes, dtype=np.int32) * np.int32(KINDS)
        self.take(np.full(lanes, 16.0))

    def count(self, kinds: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        """kinds (with the lane), hits: (steps, lanes)."""
        at = kinds.ravel()
        for total, some in ((self.tries, at), (self.hits2, at[hit2.ravel()]), (self.hits1, at[hit1.ravel()])):
            total += np.bincount(some, minlength=total.size).reshape(total.shape)

    def take(self, order0: np.ndarray) -> None:
        """order0: its weight in each lane, at most 2^12. All together stay below 2^16."""
        self.order0 = order0
        rest = self.tries + 1.0 - self.hits2 - self.hits1
        unit = np.minimum(order0[:, None] / rest, 30_000.0 / (self.tries + 1.0))
        w2 = np.maximum(np.floor(self.hits2 * unit), 1.0) * self.some2
        w1 = np.maximum(np.floor(self.hits1 * unit), 1.0) * self.some1
        self.upto2, self.upto1 = (w2 + order0[:, None]).ravel(), (w2 + w1 + order0[:, None]).ravel()


def _moments(steps: int) -> list[int]:
    """Where the counts are taken anew, from 0 on, and the end."""
    out, at = [0], FIRST_COUNT
    while at < steps:
        out.append(at)
        at *= 2
    return [*out, steps]


def _sizes(n: int, block: int) -> np.ndarray:
    return np.full(n // block, block) if n % block == 0 else np.append(np.full(n // block, block), n % block)


class _Output:
    """Low ends of the lanes' ranges, and the words that left them."""

    def __init__(self, lanes: int, most: int):
        self.low, self.span = np.zeros(lanes), np.full(lanes, TOP)
        self.words = np.zeros(lanes * most, dtype=np.uint16)
        self.begin = np.arange(lanes) * most
        self.at = self.begin.copy()

    def carry(self, n: int) -> None:
        over = np.flatnonzero(self.low[:n] >= TOP)
        self.low[over] -= TOP
        at = self.at[over] - 1
        while len(at):
            self.words[at] += 1
            at = at[self.words[at] == 0] - 1

    def narrow(self, n: int, total, start, width, rounds: int = 1) -> None:
        """Narrow the ranges of the first n lanes, and move words out of those that have become small."""
        low, at = self.low[:n], self.at[:n]
        unit = np.floor(self.span[:n] / total)
        low += unit * start
        span = unit * width
        if low.max() >= TOP:
            self.carry(n)
        for _ in range(rounds):
            small = span < BOTTOM
            word = np.floor(low * (1 / BOTTOM))
            self.words[at] = word  # where the range is not small the next word takes this one's place
            low -= word * (small * BOTTOM)
            shift = small * (WORD - 1) + 1
            low *= shift
            span *= shift
            at += small
        self.span[:n] = span

    def finished(self) -> list[bytes]:
        """The words of each lane."""
        for _ in range(3):
            word = np.floor(self.low * (1 / BOTTOM))
            self.words[self.at] = word
            self.low = (self.low - word * BOTTOM) * WORD
            self.at += 1
        return [self.words[i:j].astype("<u2").tobytes() for i, j in zip(self.begin.tolist(), self.at.tolist(), strict=True)]


class _Input:
    """Words of the lanes, how far the code is above the low end of the range, and the range."""

    def __init__(self, coded: list[bytes]):
        n = [len(c) // 2 for c in coded]
        self.words = np.concatenate([np.frombuffer(b"".join(coded), dtype="<u2"), np.zeros(1, dtype=np.uint16)])
        self.next = np.cumsum(n) - n
        w = [self.words.take(self.next + k, mode="clip").astype(np.float64) for k in range(3)]
        self.next += 3
        self.code, self.span = (w[0] * WORD + w[1]) * WORD + w[2], np.full(len(n), TOP)

    def narrow(self, n: int, start, width, rounds: int = 1) -> None:
        """start, width: of the interval that holds the code."""
        code, span, at = self.code[:n] - start, width, self.next[:n]
        for _ in range(rounds):
            small = span < BOTTOM
            shift = small * (WORD - 1) + 1
            code = code * shift + self.words.take(at, mode="clip") * small
            span = span * shift
            at += small
        self.code[:n], self.span[:n] = code, span


def _live(counts: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Lanes by falling count, and how many of them have a step 0, 1, 2 ..."""
    order = np.argsort(-counts, kind="stable")
    return order, (len(counts) - np.searchsorted(counts[order[::-1]], np.arange(counts.max()), "right")).tolist() if len(counts) else []


def _list_encoded(ids: np.ndarray, counts: np.ndarray, fixed: Prior) -> list[bytes]:
    """Fresh ids of all lanes, one lane after the other, as words of each lane."""
    order, live = _live(counts)
    out = _Output(len(counts), 2 * int(counts.max()) + 8)
    first = (np.cumsum(counts) - counts)[order]
    for t, n in enumerate(live):
        now = ids.take(first[:n] + t)
        out.narrow(n, fixed.total, fixed.start.take(now), fixed.size.take(now), rounds=2)
    coded = out.finished()
    return [coded[k] for k in np.argsort(order).tolist()]


def _list_decoded(coded: list[bytes], counts: np.ndarray, fixed: Prior) -> np.ndarray:
    order, live = _live(counts)
    come = _Input([coded[k] for k in order.tolist()])
    first = (np.cumsum(counts) - counts)[order]
    ids = np.zeros(int(counts.sum()) + 1, dtype=np.int32)
    for t, n in enumerate(live):
        unit = np.floor(come.span[:n] / fixed.total)
        now = fixed.id_at.take(np.floor(come.code[:n] / unit).astype(np.int64), mode="clip")
        come.narrow(n, unit * fixed.start.take(now), unit * fixed.size.take(now), rounds=2)
        ids[first[:n] + t] = now
    return ids


def _order0(sheet: np.ndarray, moments: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the sheet (steps, lanes), as one number: ids counted below its id (from bit 12 on), and of it, when the counts were last taken; and, by moment and lane, ids counted once."""
    steps, lanes = sheet.shape
    rows = np.ascontiguousarray(sheet.T)
    if rows.max(initial=0) < 1 << 16:
        rows = rows.astype(np.uint16)  # sorted by digits
    order = np.argsort(rows, axis=1, kind="stable")
    ids = np.take_along_axis(rows, order, axis=1)
    # Places in that order, lane after lane: an id's places go by step, so those of one stretch between moments stand together.
    stretch = (np.searchsorted(moments, np.arange(steps), "right") - 1).astype(np.int16).take(order).ravel()
    new = np.ones(rows.shape, dtype=bool)
    np.not_equal(ids[:, 1:], ids[:, :-1], out=new[:, 1:])
    new = new.ravel()
    turn = new.copy()
    turn[1:] |= stretch[1:] != stretch[:-1]

    def begun(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The marked places, and for each place the last of them."""
        at = np.flatnonzero(marks).astype(np.int32)
        return at, np.repeat(at, np.diff(np.append(at, np.int32(len(marks)))))

    (heads, head), (_, run) = begun(new), begun(turn)
    out, upto = run - head, np.zeros(len(new) + 1, dtype=np.int32)
    for k in range(1, len(moments) - 1):
        np.cumsum(stretch < k, dtype=np.int32, out=upto[1:])
        here = np.flatnonzero(stretch == k)
        out[here] += (upto.take(head.take(here)) - here // steps * np.int32(moments[k])) << 12
    # Counted once at a moment: the first place of an id is before it, a second one is not.
    ones = np.zeros((len(moments), lanes), dtype=np.int64)
    seconds = heads + 1
    for places, sign in ((heads, 1), (seconds[(seconds < len(new)) & ~new.take(seconds, mode="clip")], -1)):
        ones[1:] += sign * np.cumsum(np.bincount(stretch[places] * np.int64(lanes) + places // steps, minlength=lanes * (len(moments) - 1)).reshape(-1, lanes), axis=0)
    back = np.empty(rows.shape, dtype=np.int32)
    np.put_along_axis(back, order, out.reshape(rows.shape), axis=1)
    return np.ascontiguousarray(back.T), ones


def _encoded(sheet: np.ndarray, short: int, fixed: Prior) -> tuple[list[bytes], np.ndarray, list[bytes]]:
    """Words of each lane's list, its fresh ids, and words of its block; ``sheet``: (steps, lanes), the last lane has ``short`` ids."""
    steps, lanes = sheet.shape
    moments = _moments(steps)
    counted, singles = _order0(sheet, moments)
    contexts, weights, out = _Contexts(lanes), _Weights(lanes), _Output(lanes, steps + 8)
    all_fresh = np.empty(sheet.shape, dtype=bool)
    for k, (begin, end) in enumerate(zip(moments, moments[1:], strict=False)):
        ones = singles[k] + 1.0 if begin else np.full(lanes, 16.0)
        weights.take(ones + begin)
        for i in range(begin, end, PIECE):
            j = min(end, i + PIECE)
            # Where the interval of each id begins and how large it is.
            now = sheet[i:j]
            kinds, is2, is1 = np.empty(now.shape, dtype=np.int32), np.empty(now.shape, dtype=bool), np.empty(now.shape, dtype=bool)
            for t in range(j - i):
                kinds[t] = contexts.foresee()
                np.equal(contexts.g2, now[t], out=is2[t])
                np.equal(contexts.g1, now[t], out=is1[t])
                contexts.learn(now[t], is1[t], is2[t])
            kinds += weights.lane
            upto2, total = weights.upto2.take(kinds), weights.upto1.take(kinds)
            is1 &= ~is2
            hit = np.flatnonzero(is2 | is1)
            fresh, times = all_fresh[i:j], counted[i:j] & 0xFFF
            np.equal(times, 0, out=fresh)
            fresh.ravel()[hit] = False
            start, width = np.where(fresh, float(begin), counted[i:j] >> 12), np.where(fresh, ones, times)
            two, middle, order0 = is2.ravel()[hit], upto2.ravel()[hit], weights.order0[hit % lanes]
            start.ravel()[hit] = np.where(two, order0, middle)
            width.ravel()[hit] = np.where(two, middle - order0, total.ravel()[hit] - middle)
            for t in range(j - i):
                n = lanes if i + t < short else lanes - 1
                out.narrow(n, total[t, :n], start[t, :n], width[t, :n])
            weights.count(kinds, is2, is1)
    all_fresh[short:, -1] = False
    fresh = np.ascontiguousarray(all_fresh.T)
    listed = fresh.sum(axis=1)
    return _list_encoded(np.ascontiguousarray(sheet.T)[fresh], listed, fixed), listed, out.finished()


def encode(ids: np.ndarray, n_ids: int, block: int = BLOCK, lanes: int = LANES) -> bytes:
    """Segment of ids, all below ``n_ids``; ``lanes`` blocks go in step. A block has at most 2048 ids."""
    if block > BLOCK:
        raise ValueError("longer blocks would overflow the weights")
    ids = np.asarray(ids, dtype=np.int32)
    sizes, table, coded = _sizes(len(ids), block), [], []
    for i in range(0, len(sizes), lanes):
        some = sizes[i : i + lanes]
        part = ids[i * block : i * block + int(some.sum())]
        sheet = np.zeros((len(some), int(some[0])), dtype=np.int32)
        sheet.ravel()[: len(part)] = part
        lists, counts, blocks = _encoded(np.ascontiguousarray(sheet.T), int(some[-1]), prior(n_ids))
        for k, (n, fresh) in enumerate(zip(some.tolist(), counts.tolist(), strict=True)):
            table.append((n, fresh, len(lists[k]), len(blocks[k]), zlib.crc32(sheet[k, :n].astype("<u4").tobytes())))
            coded += (lists[k], blocks[k])
    return MAGIC + np.array([len(sizes)], dtype="<u4").tobytes() + np.array(table, dtype="<u4").tobytes() + b"".join(coded)


def _decoded(lists: list[bytes], counts: np.ndarray, coded: list[bytes], sizes: np.ndarray, fixed: Prior) -> np.ndarray:
    """Ids as (steps, lanes)."""
    lanes, steps, short = len(sizes), int(sizes[0]), int(sizes[-1])
    listed = _list_decoded(lists, counts, fixed)
    next_fresh = np.cumsum(counts) - counts
    sheet = np.zeros((steps, lanes), dtype=np.int32)
    contexts, weights, come = _Contexts(lanes), _Weights(lanes), _Input(coded)
    every = np.arange(lanes)
    seen, ones = np.zeros(lanes, dtype=np.int64), np.full(lanes, 16.0)
    moments = _moments(steps)
    for begin, end in zip(moments, moments[1:], strict=False):
        if begin:
            rows = sheet[:begin].T
            rows = np.sort(rows.astype(np.uint16) if rows.max(initial=0) < 1 << 16 else rows, axis=1, kind="stable")
            new = np.ones((lanes, begin), dtype=bool)
            np.not_equal(rows[:, 1:], rows[:, :-1], out=new[:, 1:])
            head = np.flatnonzero(new)
            size = np.diff(np.append(head, lanes * begin))
            ones = np.bincount(head[size == 1] // begin, minlength=lanes) + 1.0
            # The id at each place of the counts, the first place of that id, and how many it has.
            seen = np.repeat(rows.ravel()[head] + (head % begin << ID_BITS) + (size << ID_BITS + 12), size)
            weights.take(ones + begin)
        order0, row, most = weights.order0, every * max(begin, 1), np.full(lanes, float(max(begin - 1, 0)))
        low12, here, zero = np.full(lanes, 0xFFF), np.full(lanes, float(begin)), np.zeros(lanes)
        for i in range(begin, end, PIECE):
            j = min(end, i + PIECE)
            kinds, hits2, hits1 = np.empty((j - i, lanes), dtype=np.int32), np.empty((j - i, lanes), dtype=bool), np.empty((j - i, lanes), dtype=bool)
            for t in range(j - i):
                kind = np.add(contexts.foresee(), weights.lane, out=kinds[t])
                upto2, total = weights.upto2.take(kind), weights.upto1.take(kind)
                unit = np.floor(come.span / total)
                value = np.floor(come.code / unit)
                hit, fresh = value >= order0, value >= here
                hit2 = hit & (value < upto2)
                found = seen.take(row + np.maximum(np.minimum(value, most), zero).astype(np.int64))
                start = np.where(fresh, here, found >> ID_BITS & low12)
                width = np.where(fresh, ones, found >> ID_BITS + 12)
                now = np.where(fresh, listed.take(next_fresh, mode="clip"), found & _ID).astype(np.int32)
                which = np.flatnonzero(hit)
                if len(which):
                    two, upper = hit2[which], upto2[which]
                    start[which] = np.where(two, order0[which], upper)
                    width[which] = np.where(two, upper - order0[which], total[which] - upper)
                    now[which] = np.where(two, contexts.g2[which], contexts.g1[which])
                next_fresh += fresh & ~hit
                n = lanes if i + t < short else lanes - 1
                come.narrow(n, (unit * start)[:n], (unit * width)[:n])
                sheet[i + t] = now
                is2, is1 = contexts.g2 == now, contexts.g1 == now
                hits2[t], hits1[t] = is2, is1 & ~is2
                contexts.learn(now, is1, is2)
            weights.count(kinds, hits2, hits1)
    return sheet


def decode(segment: bytes, n_ids: int, blocks: slice = slice(None), lanes: int = LANES) -> np.ndarray:
    """Ids of a segment, or of some of its blocks; raises ValueError where it is no segment or a checksum fails."""
    if segment[:4] != MAGIC:
        raise ValueError("no segment")
    whole = int(np.frombuffer(segment, dtype="<u4", count=1, offset=4)[0])
    table = np.frombuffer(segment, dtype="<u4", count=HEAD * whole, offset=8).reshape(whole, HEAD).astype(np.int64)
    ends = (8 + 4 * HEAD * whole + np.cumsum(table[:, 2] + table[:, 3]))[blocks]
    table, out = table[blocks], []
    for i in range(0, len(table), lanes):
        some = table[i : i + lanes]
        cuts = list(zip(ends[i : i + lanes].tolist(), some[:, 2].tolist(), some[:, 3].tolist(), strict=True))
        lists, coded = [segment[e - n - m : e - n] for e, m, n in cuts], [segment[e - n : e] for e, _, n in cuts]
        with np.errstate(all="ignore"):  # what a damaged block says is caught by its checksum
            sheet = np.ascontiguousarray(_decoded(lists, some[:, 1], coded, some[:, 0], prior(n_ids)).T)
        for k, (n, *_, crc) in enumerate(some.tolist()):
            if zlib.crc32(sheet[k, :n].astype("<u4").tobytes()) != crc:
                raise ValueError(f"block {i + k} is damaged")
            out.append(sheet[k, :n])
    return np.concatenate(out).astype(np.uint32) if out else np.zeros(0, dtype=np.uint32)
