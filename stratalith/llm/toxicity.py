"""Toxicity: a bidirectional GRU with attention pooling over character and word inputs, trained in numpy.

A word's input is its hashed word vector beside the mean of its hashed character 3-gram vectors. A text is cut into
overlapping windows; the network scores every window, and the text's score is that of its worst window. As labels
belong to texts, training alternates: the windows of toxic texts that score highest stand for them, all windows of
clean texts are clean.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import renamed
from .tokens import U64, Chunk, mixed, released, text_chunks

WINDOW, STRIDE = 32, 24
WORD_ROWS, CHAR_ROWS, WORD_DIM, CHAR_DIM, HIDDEN = 1 << 16, 1 << 12, 4, 8, 6


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


@dataclass
class Inputs:
    """Distinct words of some texts (word row, character rows) and each text's windows of positions."""

    word_rows: np.ndarray  # of each distinct word
    char_rows: np.ndarray  # of all 3-grams of the distinct words, one word after the other
    char_cuts: np.ndarray  # start of each distinct word's 3-grams
    windows: np.ndarray  # (n, WINDOW) index of a distinct word, -1: none
    doc: np.ndarray  # text of each window


def inputs_of(texts: list[bytes]) -> Inputs:
    """Words are lower-cased texts' runs of non-blank bytes; a text of no words has one empty window."""
    c = Chunk([t.lower() for t in texts])
    h = c.word_hashes()
    distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    starts, ends = c.w_starts[first], c.w_ends[first]
    # Character 3-grams with a blank on either side of the word: one for each byte of the word.
    size = ends - starts
    cuts = np.concatenate(([0], np.cumsum(size)))[:-1]
    at = np.arange(int(size.sum())) - np.repeat(cuts - starts, size)
    where = np.repeat(np.arange(len(size)), size)
    b = c.buf.astype(np.int64)
    left = np.where(at == starts[where], 0x20, b[np.maximum(at - 1, 0)])
    right = np.where(at == ends[where] - 1, 0x20, b[np.minimum(at + 1, len(b) - 1)] if len(b) else 0)
    grams = (left << 16 | b[at] << 8 | right).astype(U64)
    bounds, n = c.bounds(), c.n_words
    per = np.maximum(1, -(-(n - (WINDOW - STRIDE)) // STRIDE))
    doc = np.repeat(np.arange(c.n), per)
    order = np.arange(len(doc)) - np.repeat(np.concatenate(([0], np.cumsum(per)))[:-1], per)
    begin = bounds[doc] + order * STRIDE
    pos = begin[:, None] + np.arange(WINDOW)
    wins = np.where(pos < bounds[doc + 1][:, None], inverse[np.minimum(pos, max(len(inverse) - 1, 0))] if len(inverse) else -1, -1)
    return Inputs((distinct % U64(WORD_ROWS)).astype(np.int64), (mixed(grams) % U64(CHAR_ROWS)).astype(np.int64), cuts, wins, doc)


class BiGRU:
    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        d = WORD_DIM + CHAR_DIM
        f = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
        self.p = {
            "word": np.zeros((WORD_ROWS, WORD_DIM), dtype=np.float32),
            "char": f(CHAR_ROWS, CHAR_DIM, s=0.3),
            "wx": f(2, d, 3 * HIDDEN, s=0.4),
            "bias": np.zeros((2, 3 * HIDDEN), dtype=np.float32),
            "wh": f(2, HIDDEN, 3 * HIDDEN, s=0.3),
            "att": f(2 * HIDDEN, 2 * HIDDEN, s=0.3),
            "att_v": f(2 * HIDDEN, s=0.3),
            "out": f(2 * HIDDEN, s=0.3),
            "out_b": np.full(1, -1.0, dtype=np.float32),
        }
        self.scale, self.shift = 1.0, 0.0  # of a text's worst logit

    def calibrate(self, worst: np.ndarray, toxic: np.ndarray, steps: int = 300) -> float:
        """Platt scaling of texts' worst logits, toxic texts weighing 15 % in all; the loss that is left."""
        mid = worst.mean()
        u, a, b = (worst - mid) / (worst.std() + 1e-6), 1.0, 0.0
        w = np.where(toxic, 0.15 / toxic.mean(), 0.85 / (~toxic).mean()) / len(worst)
        for _ in range(steps):
            gap = (_sigmoid(a * u + b) - toxic) * w
            a, b = max(0.1, a - 2.0 * (gap @ u)), b - 2.0 * gap.sum()
        self.scale = a / (worst.std() + 1e-6)
        self.shift = b - self.scale * mid
        return float((w * np.logaddexp(0, np.where(toxic, -1, 1) * (a * u + b))).sum())

    def embedded(self, x: Inputs) -> np.ndarray:
        """A row per distinct word, and a last one of zeros for no word."""
        out = np.zeros((len(x.word_rows) + 1, WORD_DIM + CHAR_DIM), dtype=np.float32)
        if len(x.word_rows):
            out[:-1, :WORD_DIM] = self.p["word"][x.word_rows]
            sizes = np.diff(np.concatenate((x.char_cuts, [len(x.char_rows)])))
            out[:-1, WORD_DIM:] = np.add.reduceat(self.p["char"][x.char_rows], x.char_cuts) / sizes[:, None]
        return out

    def forward(self, words: np.ndarray, wins: np.ndarray, keep: bool = False):
        """Logit of each window; keep: and what backward() needs."""
        p, H = self.p, HIDDEN
        n, T = wins.shape
        there = (wins >= 0).astype(np.float32)
        states, steps = np.zeros((T, n, 2 * H), dtype=np.float32), ([], [])
        for side in (0, 1):
            table = words @ p["wx"][side] + p["bias"][side]
            h = np.zeros((n, H), dtype=np.float32)
            for t in range(T) if side == 0 else range(T - 1, -1, -1):
                gx, gh = table[wins[:, t]], h @ p["wh"][side]
                zr = _sigmoid(gx[:, : 2 * H] + gh[:, : 2 * H])
                z, r = zr[:, :H], zr[:, H:]
                c = np.tanh(gx[:, 2 * H :] + r * gh[:, 2 * H :])
                on = there[:, t, None]
                new = h + on * z * (c - h)
                if keep:
                    steps[side].append((t, h, z, r, c, gh[:, 2 * H :], on))
                h = new
                states[t, :, side * H : side * H + H] = h
        hidden = np.tanh(states.reshape(T * n, 2 * H) @ p["att"])
        e = (hidden @ p["att_v"]).reshape(T, n)
        e = np.where(there.T > 0, e, -30.0)
        a = np.exp(e - e.max(0))
        a *= there.T
        a /= np.maximum(a.sum(0), 1e-9)
        pooled = (a[:, :, None] * states).sum(0)
        logit = pooled @ p["out"] + p["out_b"][0]
        return (logit, (states, steps, hidden, a, pooled)) if keep else logit

    def backward(self, x: Inputs, words: np.ndarray, wins: np.ndarray, kept, d_logit: np.ndarray) -> dict:
        p, H = self.p, HIDDEN
        states, steps, hidden, a, pooled = kept
        T, n, _ = states.shape
        g = {"out": pooled.T @ d_logit, "out_b": np.array([d_logit.sum()])}
        d_pooled = d_logit[:, None] * p["out"]
        d_states = a[:, :, None] * d_pooled
        d_a = (states * d_pooled).sum(2)
        d_e = a * (d_a - (a * d_a).sum(0))
        g["att_v"] = hidden.T @ d_e.reshape(-1)
        d_hidden = d_e.reshape(-1)[:, None] * p["att_v"] * (1 - hidden**2)
        g["att"] = states.reshape(T * n, 2 * H).T @ d_hidden
        d_states = d_states + (d_hidden @ p["att"].T).reshape(T, n, 2 * H)
        g["wh"], g["wx"], g["bias"] = np.zeros_like(p["wh"]), np.zeros_like(p["wx"]), np.zeros_like(p["bias"])
        d_words = np.zeros_like(words)
        for side in (0, 1):
            d_table = np.zeros((len(words), 3 * H), dtype=np.float32)
            d_h, d_all = np.zeros((n, H), dtype=np.float32), np.zeros((T, n, 3 * H), dtype=np.float32)
            for t, h, z, r, c, ghc, on in reversed(steps[side]):
                d_h = d_h + d_states[t, :, side * H : side * H + H]
                d_c = d_h * on * z * (1 - c**2)
                d_z = d_h * on * (c - h) * z * (1 - z)
                d_r = d_c * ghc * r * (1 - r)
                d_gh = np.concatenate([d_z, d_r, d_c * r], axis=1)
                g["wh"][side] += h.T @ d_gh
                d_gx = np.concatenate([d_z, d_r, d_c], axis=1)
                d_all[t] = d_gx
                d_h = d_h * (1 - on * z) + d_gh @ p["wh"][side].T
            where = wins.T.ravel()
            order = np.argsort(where, kind="stable")
            cuts = np.flatnonzero(np.concatenate(([True], np.diff(where[order]) > 0)))
            d_table[where[order][cuts]] = np.add.reduceat(d_all.reshape(T * n, 3 * H)[order], cuts)
            g["wx"][side] = words.T @ d_table
            g["bias"][side] = d_table.sum(0)
            d_words += d_table @ p["wx"][side].T
        g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        used = np.flatnonzero(np.abs(d_words[:-1]).sum(1) > 0)
        np.add.at(g["word"], x.word_rows[used], d_words[used, :WORD_DIM])
        sizes = np.diff(np.concatenate((x.char_cuts, [len(x.char_rows)])))
        each = d_words[:-1, WORD_DIM:] / np.maximum(sizes, 1)[:, None]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        live = np.zeros(len(sizes), dtype=bool)
        live[used] = True
        live = live[owner]
        np.add.at(g["char"], x.char_rows[live], each[owner[live]])
        return g

    def score_windows(self, x: Inputs, most: int = 4096) -> np.ndarray:
        words = self.embedded(x)
        parts = [self.forward(words, x.windows[i : i + most]) for i in range(0, len(x.windows), most)]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.float32)

    def score_texts(self, texts: list[bytes]) -> np.ndarray:
        """Score of each text: of its worst window."""
        if not texts:
            return np.zeros(0)
        x = inputs_of(texts)
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, x.doc, self.score_windows(x))
        return _sigmoid(self.scale * worst.astype(np.float64) + self.shift)


def _suspicion(x: Inputs, toxic: np.ndarray) -> np.ndarray:
    """First guess of a window: the largest log odds of a word, by its presence and its 3-grams' in toxic and clean texts."""
    n_words, n = len(x.word_rows), len(toxic)
    flat = x.windows.ravel()
    pairs = np.unique(np.repeat(x.doc, WINDOW)[flat >= 0] * np.int64(max(n_words, 1)) + flat[flat >= 0])
    doc, word = pairs // max(n_words, 1), pairs % max(n_words, 1)
    sizes = np.diff(np.concatenate((x.char_cuts, [len(x.char_rows)])))

    def odds(rows_of, rows):
        """Log odds of each row; a few texts' (text, row) pairs at a time."""
        counts = np.zeros((2, rows), dtype=np.int64)
        for begin in range(0, n, 100):
            i, j = np.searchsorted(doc, [begin, begin + 100])
            seen = np.unique(rows_of(doc[i:j], word[i:j]))
            bad = toxic[seen // rows]
            counts += [np.bincount(seen[k] % rows, minlength=rows) for k in (bad, ~bad)]
        return np.log((counts[0] + 0.5) / (toxic.sum() + 1)) - np.log((counts[1] + 0.5) / (n - toxic.sum() + 1))

    def grams_of(doc, word):
        times = sizes[word]
        at = np.arange(int(times.sum())) - np.repeat(np.concatenate(([0], np.cumsum(times)))[:-1] - x.char_cuts[word], times)
        return np.repeat(doc, times) * np.int64(CHAR_ROWS) + x.char_rows[at]

    if not n_words:
        return np.full(len(x.windows), -9.0)
    grams = odds(grams_of, CHAR_ROWS)
    by_word = odds(lambda doc, word: doc * np.int64(n_words) + word, n_words) + 2 * np.add.reduceat(grams[x.char_rows], x.char_cuts) / sizes
    return np.append(by_word, -9.0)[x.windows].max(1)


def _worst(x: Inputs, n: int, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest window score of each text, and the window that has it."""
    order = np.lexsort((-score, x.doc))
    first = order[np.searchsorted(x.doc[order], np.arange(n))]
    return score[first], first


def _evidence(x: Inputs, toxic: np.ndarray, texts: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of the word table, over the given texts: how far the log odds of its words in toxic against clean texts
    pass ``least`` standard errors (negative: clean; 0: they do not), and the number of texts with them."""
    flat = x.windows.ravel()
    doc = np.repeat(x.doc, WINDOW)
    use = (flat >= 0) & texts[doc]
    pairs = np.unique(doc[use] * np.int64(WORD_ROWS) + x.word_rows[flat[use]])
    row, bad = pairs % WORD_ROWS, toxic[pairs // WORD_ROWS]
    a, b = (np.bincount(row[k], minlength=WORD_ROWS) + 0.5 for k in (bad, ~bad))
    no_a, no_b = (toxic & texts).sum() + 1 - a, (~toxic & texts).sum() + 1 - b
    z = np.log(a * no_b / (b * no_a)) / np.sqrt(1 / a + 1 / no_a + 1 / b + 1 / no_b)
    return np.sign(z) * np.maximum(0, np.abs(z) - least), np.bincount(row, minlength=WORD_ROWS)


def _kept_back(toxic: np.ndarray, rng, part: int = 4) -> np.ndarray:
    """Every ``part``th text of each label, by chance; none where a label has fewer."""
    order, keep = rng.permutation(len(toxic)), np.zeros(len(toxic), dtype=bool)
    for label in (False, True):
        some = order[toxic[order] == label]
        if len(some) < part:
            return np.zeros(len(toxic), dtype=bool)
        keep[some[: len(some) // part]] = True
    return keep


def train(texts: list[bytes], toxic: np.ndarray, rounds: int = 3, passes: int = 3, size: int = 128, rate: float = 0.01, least: float = 2.5, seed: int = 1) -> BiGRU:
    """Fit on texts with labels 0 / 1; the same texts give the same network.

    A quarter of the texts of each label is kept back: the network is calibrated on them, and that of the round with the
    least loss on them stays (with fewer than 4 texts of a label, calibration takes all texts and the last round stays).
    Word vectors start from, and are learnt for, the words whose evidence passes ``least`` standard errors in 3 texts or more;
    all other words speak through their 3-grams. Fewer than 800 texts go round more often, as if they were 800.
    """
    net, rng = BiGRU(seed), np.random.default_rng(seed)
    toxic = np.asarray(toxic, dtype=bool)
    if not toxic.any() or toxic.all():
        return net
    x = inputs_of(texts)
    back = _kept_back(toxic, rng)
    fit = ~back
    clean = np.flatnonzero((~toxic & fit)[x.doc])
    evidence, seen = _evidence(x, toxic, fit, least)
    evidence[seen < 3] = 0
    silent = evidence == 0
    net.p["word"][:, 0] = np.clip(evidence, -3, 3)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    of = x.doc[fit[x.doc]]
    inside = Inputs(x.word_rows, x.char_rows, x.char_cuts, x.windows[fit[x.doc]], (np.cumsum(fit) - 1)[of])
    # The first guess of a toxic text's window: most evidence; ties by the likeliest word.
    score = np.append(net.p["word"][:, 0][x.word_rows], 0.0)[x.windows].sum(1)
    score[fit[x.doc]] += 0.001 * _suspicion(inside, toxic[fit])
    step, best = 0, (np.inf, None)
    judged = back if back.any() else fit
    for _ in range(rounds):
        _, worst = _worst(x, len(texts), score)
        chosen = worst[toxic & fit]
        for _ in range(max(passes, -(-passes * 800 // len(texts)))):
            rows = np.unique(np.concatenate([chosen, worst[~toxic & fit], rng.choice(clean, min(len(clean), 2 * len(chosen)), replace=False)]))
            y = np.isin(rows, chosen).astype(np.float32)
            shuffle = rng.permutation(len(rows))
            for i in range(0, len(rows), size):
                pick = shuffle[i : i + size]
                used, where = np.unique(x.windows[rows[pick]], return_inverse=True)  # -1 first, if there
                local = _subset(x, used[used >= 0])
                wins = where.reshape(len(pick), WINDOW) - int(used[0] == -1)
                words = net.embedded(local)
                logit, kept = net.forward(words, wins, keep=True)
                d = ((_sigmoid(logit) - y[pick]) / len(pick)).astype(np.float32)
                g = net.backward(local, words, wins, kept, d)
                g["word"][silent] = 0
                step += 1
                for k, v in net.p.items():
                    m = moments[k]
                    m[0] = 0.9 * m[0] + 0.1 * g[k]
                    m[1] = 0.99 * m[1] + 0.01 * g[k] ** 2
                    v -= (rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        score = net.score_windows(x)
        loss = net.calibrate(_worst(x, len(texts), score)[0][judged], toxic[judged])
        if loss < best[0] or not back.any():
            best = (loss, {k: v.copy() for k, v in net.p.items()}, net.scale, net.shift)
    _, net.p, net.scale, net.shift = best
    return net


def _subset(x: Inputs, words: np.ndarray) -> Inputs:
    sizes = np.diff(np.concatenate((x.char_cuts, [len(x.char_rows)])))[words]
    cuts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    at = np.arange(int(sizes.sum())) - np.repeat(cuts - x.char_cuts[words], sizes)
    return Inputs(x.word_rows[words], x.char_rows[at], cuts, x.windows[:0], x.doc[:0])


def _held(ids: list) -> list[bool]:
    return [zlib.crc32(str(i).encode()) % 5 == 0 for i in ids]


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = 3_000) -> BiGRU:
    """Network fitted on at most ``max_labelled`` labelled texts that are not held out (the first by hash of the id, half of each label).

    Held out: crc32 of the id as text, modulo 5, is 0. Rows with a null id or label are left out; without labels the
    network stays as it began.
    """
    known = renamed(labels, id=id_col, toxic=label_col).where("id IS NOT NULL AND toxic IN (0, 1)").where(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0).select("id", F.col("toxic").cast("int").alias("toxic"))
    half = max_labelled // 2
    chosen = known.where("toxic = 0").orderBy(F.xxhash64("id"), "id").limit(half).unionByName(known.where("toxic = 1").orderBy(F.xxhash64("id"), "id").limit(half))
    rows = renamed(docs, id=id_col, text=text_col).join(F.broadcast(chosen), "id").select("id", "toxic", F.coalesce("text", F.lit("")).alias("text")).collect()
    rows.sort(key=lambda r: (r.id, r.toxic, r.text))
    return train([r.text.encode() for r in rows], np.array([r.toxic for r in rows], dtype=int))


def _scorer(net: BiGRU):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_chunks(batch.column("text")):
                score = net.score_texts(texts)
                some = batch.column("id")[part].to_pylist()
                yield pa.record_batch({"id": pa.array(some, pa.int64()), "held_out": _held(some), "score": score, "predicted": pa.array((score >= 0.5).astype(np.int32))})

    return run


def score_toxicity(docs: DataFrame, net: BiGRU, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, held_out, score, predicted; every overlapping window of the whole text is scored.

    A null or empty text is one window of no words; a null id counts as the text "None" for held_out; repeated rows
    score alike; an empty table gives no rows; other columns are ignored.
    """
    rows = renamed(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text")
    return rows.mapInArrow(released(_scorer(net)), "id long, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def op9_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_toxicity(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
