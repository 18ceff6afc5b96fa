"""Quality rules by line labelling: a linear-chain CRF marks each line as content or boilerplate.

Features of a line come from its bytes (shares of symbols, capitals, digits, repeated words and so on); the
transition scores let neighbours speak for a line. Viterbi decoding labels the lines of a text, and the share of
its words in content lines decides whether it stays. Base rules on the whole text come first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import renamed
from .tokens import U64, Chunk, as_bytes, mixed, released, span_hashes, text_chunks, windows, within

SYMBOLS = b"#*$%&|<>"
#: Byte classes: 0 blank, 1 lower, 2 upper, 3 digit, 4 symbol, 5 other ASCII, 6 first byte beyond ASCII, 7 continuation byte.
_CLASS = np.full(256, 5, dtype=np.int64)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A], _CLASS[0xC0:], _CLASS[0x80:0xC0] = 1, 2, 3, 6, 7
_CLASS[list(SYMBOLS)] = 4
FEATURES = ("bias", "symbols", "capitals", "digits", "marks", "same_as_before", "in_repeats", "duplicate", "blank", "log_words", "full_stop", "word_length")


@dataclass
class Lines:
    """Lines of a chunk: doc, words and features of each; base counts of each document."""

    doc: np.ndarray
    words: np.ndarray
    x: np.ndarray
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray


def _seen_before(doc: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether an equal key stands earlier in the same document."""
    first = np.unique(mixed(keys + doc.astype(U64) * U64(0x9E3779B97F4A7C15)), return_index=True)[1]
    seen = np.ones(len(keys), dtype=bool)
    seen[first] = False
    return seen


def lines_of(texts: list[bytes], window: int = 8) -> Lines:
    c = Chunk(texts)
    ends = np.flatnonzero(c.buf == 0x0A)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    doc = np.searchsorted(c.ends, starts, "right")
    n, m = len(ends), len(c.w_starts)
    kinds = np.bincount(np.repeat(np.arange(n) * 8, ends - starts + 1) + _CLASS[c.buf], minlength=8 * n).reshape(n, 8)
    w_line = np.searchsorted(ends, c.w_starts, "left")
    words = np.bincount(w_line, minlength=n)
    h = c.word_hashes()
    again = np.zeros(m, dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (w_line[1:] == w_line[:-1])
    covered = np.zeros(m, dtype=bool)
    if m >= window:
        pos = np.flatnonzero(within(c.w_doc, window))
        keys = mixed(windows(h, window)[pos] + c.w_doc[pos].astype(U64) * U64(0x9E3779B97F4A7C15))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(pos), dtype=bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        edge = np.zeros(m + 1, dtype=np.int64)
        np.add.at(edge, pos[twice], 1)
        np.add.at(edge, pos[twice] + window, -1)
        covered = np.cumsum(edge[:m]) > 0
    has = words > 0
    duplicate = np.zeros(n, dtype=bool)
    duplicate[has] = _seen_before(doc[has], span_hashes(c.buf, starts[has], ends[has]))
    chars = kinds[:, 1:7].sum(1)
    some = np.maximum(chars, 1)
    of_words = np.maximum(words, 1)
    last = np.zeros(n, dtype=np.uint8)
    at = np.flatnonzero(np.concatenate((w_line[1:] != w_line[:-1], [True]))) if m else np.zeros(0, dtype=int)
    last[w_line[at]] = c.buf[c.w_ends[at] - 1]
    x = np.stack(
        [
            np.ones(n),
            np.minimum(1, 4 * kinds[:, 4] / some),
            kinds[:, 2] / some,
            kinds[:, 3] / some,
            np.minimum(1, 4 * kinds[:, 5] / some),
            np.bincount(w_line, weights=again, minlength=n) / of_words,
            np.bincount(w_line, weights=covered, minlength=n) / of_words,
            duplicate,
            ~has,
            np.log1p(words) / 5,
            np.isin(last, list(b".!?:;")),
            np.minimum(chars / of_words / 10, 3),
        ],
        axis=1,
    )
    per_doc = lambda values: np.bincount(doc, weights=values, minlength=c.n).astype(np.int64)
    return Lines(doc, words, x, c.n_words.astype(np.int64), per_doc(chars), per_doc(kinds[:, 4]), per_doc(duplicate), np.bincount(c.w_doc, weights=covered, minlength=c.n).astype(np.int64))


@dataclass
class LineCRF:
    """Scores of content against boilerplate: emission weights by feature, and transition[from, to]; state 1 is content."""

    emission: np.ndarray
    transition: np.ndarray

    @classmethod
    def neutral(cls) -> LineCRF:
        """All content: what is left to say without labels."""
        weights = np.zeros(len(FEATURES))
        weights[0] = 1.0
        return cls(weights, np.zeros((2, 2)))

    def decode(self, doc: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Viterbi: the best labels of each document's lines, all documents in step."""
        n = len(doc)
        label = np.zeros(n, dtype=bool)
        if not n:
            return label
        score = x @ self.emission
        starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        lengths = np.diff(np.concatenate((starts, [n])))
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        t = self.transition
        best = np.stack([np.zeros(len(starts)), score[starts]], axis=1)
        back = np.zeros((n, 2), dtype=bool)
        for step in range(1, int(lengths[0])):
            live = int(np.searchsorted(-lengths, -step, "left"))
            at = starts[:live] + step
            zero, one = best[:live, 0], best[:live, 1]
            to0, to1 = np.stack([zero + t[0, 0], one + t[1, 0]]), np.stack([zero + t[0, 1], one + t[1, 1]])
            back[at, 0], back[at, 1] = to0[1] > to0[0], to1[1] > to1[0]
            best[:live] = np.stack([to0.max(0), to1.max(0) + score[at]], axis=1)
        state = best[:, 1] >= best[:, 0]
        for step in range(int(lengths[0]) - 1, -1, -1):
            live = int(np.searchsorted(-lengths, -step, "left"))
            at = starts[:live] + step
            label[at] = state[:live]
            state[:live] = np.where(state[:live], back[at, 1], back[at, 0])
        return label


def train_crf(sequences: list[tuple[np.ndarray, np.ndarray]], rounds: int = 300, rate: float = 0.1, ridge: float = 1e-4) -> LineCRF:
    """Maximum likelihood of the labels (0 / 1 by line) by forward-backward and Adam; long texts are cut into runs of 64 lines for the fit."""
    runs = [(x[i : i + 64], y[i : i + 64]) for x, y in sequences for i in range(0, len(y), 64)]
    runs.sort(key=lambda r: -len(r[1]))
    if not runs:
        return LineCRF.neutral()
    size, most = len(runs), len(runs[0][1])
    x, y, on = np.zeros((most, size, len(FEATURES))), np.zeros((most, size), dtype=int), np.zeros((most, size), dtype=bool)
    for j, (fx, fy) in enumerate(runs):
        x[: len(fy), j], y[: len(fy), j], on[: len(fy), j] = fx, fy, True
    total = on.sum()
    balance = np.where(y == 1, 0.75 / max((y[on] == 1).mean(), 1e-3), 0.25 / max((y[on] == 0).mean(), 1e-3)) * on
    weight = balance.sum(0) / np.maximum(on.sum(0), 1)  # of a run; content counts three times as much as boilerplate, however many lines each has
    theta, m, v = np.zeros(len(FEATURES) + 4), 0.0, 0.0
    for step in range(1, rounds + 1):
        w, t = theta[:-4], theta[-4:].reshape(2, 2)
        e = np.stack([np.zeros((most, size)), x @ w], axis=2)
        alpha, beta = np.zeros((most, size, 2)), np.zeros((most, size, 2))
        alpha[0] = e[0]
        for k in range(1, most):
            moved = np.logaddexp(alpha[k - 1, :, :1] + t[0], alpha[k - 1, :, 1:] + t[1]) + e[k]
            alpha[k] = np.where(on[k][:, None], moved, alpha[k - 1])
        for k in range(most - 2, -1, -1):
            ahead = e[k + 1] + beta[k + 1]
            moved = np.logaddexp(t[:, 0] + ahead[:, :1], t[:, 1] + ahead[:, 1:])
            beta[k] = np.where(on[k + 1][:, None], moved, beta[k])
        z = np.logaddexp(alpha[-1, :, 0], alpha[-1, :, 1])
        p1 = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z) * on
        gap = (p1 - y) * on * weight
        grad = np.concatenate([np.einsum("ks,ksf->f", gap, x), np.zeros(4)])
        both = on[1:]
        for a in (0, 1):
            for b in (0, 1):
                p = np.exp(alpha[:-1, :, a] + t[a, b] + e[1:, :, b] + beta[1:, :, b] - z) * both
                grad[len(FEATURES) + 2 * a + b] = ((p - ((y[:-1] == a) & (y[1:] == b)) * both) * weight).sum()
        grad = grad / total + ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return LineCRF(theta[:-4], theta[-4:].reshape(2, 2))


def _line_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, good = as_bytes(batch.column("text")), batch.column("good").to_pylist()
        found = [lines_of([t]) for t in texts]
        yield pa.record_batch({"good": pa.array(good, pa.int32()), "x": pa.array([f.x.astype("<f4").tobytes() for f in found], pa.binary())})


def fit_line_crf(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 2_000) -> LineCRF:
    """CRF fitted on at most ``max_labelled`` labelled documents (the first by hash of the id, half of each label).

    Lines of a document labelled 1 are content, of one labelled 0 boilerplate. Rows with a null id or label are
    left out; without both labels, the model calls everything content.
    """
    known = renamed(labels, id=id_col, good=label_col).where("id IS NOT NULL AND good IN (0, 1)").select("id", F.col("good").cast("int").alias("good"))
    half = max_labelled // 2
    chosen = known.where("good = 0").orderBy(F.xxhash64("id"), "id").limit(half).unionByName(known.where("good = 1").orderBy(F.xxhash64("id"), "id").limit(half))
    rows = renamed(docs, id=id_col, text=text_col).join(F.broadcast(chosen), "id").select("good", "text")
    got = rows.mapInArrow(released(_line_features), "good int, x binary").collect()
    sequences = []
    for r in got:
        x = np.frombuffer(r.x, dtype="<f4").reshape(-1, len(FEATURES)).astype(float)
        sequences.append((x, np.full(len(x), r.good)))
    if len({r.good for r in got}) < 2:
        return LineCRF.neutral()
    sequences.sort(key=lambda s: (len(s[1]), s[0].tobytes()))  # the fit does not depend on the order of tasks
    return train_crf(sequences)


LINE_COLUMNS = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lines long, content_share double, kept boolean"


def _judge(crf: LineCRF, least_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for part, texts in text_chunks(batch.column("text")):
                f = lines_of(texts)
                content = crf.decode(f.doc, f.x)
                n = len(f.n_words)
                share = np.bincount(f.doc, weights=f.words * content, minlength=n) / np.maximum(f.n_words, 1)
                failed = (f.n_words < 20) | (100 * f.n_repeat_words > 30 * f.n_words)
                yield pa.record_batch(
                    {
                        "id": ids[part],
                        "n_words": f.n_words,
                        "word_chars": f.word_chars,
                        "n_symbols": f.n_symbols,
                        "n_dup_lines": f.n_dup_lines,
                        "n_repeat_words": f.n_repeat_words,
                        "base_failed": failed,
                        "n_lines": np.bincount(f.doc, minlength=n),
                        "content_share": share,
                        "kept": ~failed & (share >= least_share),
                    }
                )

    return run


def quality_rules(docs: DataFrame, crf: LineCRF, id_col: str = "doc_id", text_col: str = "text", least_share: float = 0.5) -> DataFrame:
    """One row per input row: id_col, base counts, base_failed, n_lines, content_share, kept.

    Null and empty texts have no words and fail the base rules; null ids and repeated rows are judged like others;
    an empty table gives no rows; other columns are ignored.
    """
    rows = renamed(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text")
    return rows.mapInArrow(released(_judge(crf, least_share)), LINE_COLUMNS).withColumnRenamed("id", id_col)


def op7_quality_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs, fit_line_crf(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
