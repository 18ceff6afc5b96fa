"""Quality classifier by co-training of two views.

The text view sees hashed character 3-grams and shares of symbols, capitals, repeats and so on; the metadata view
sees source, language and length. In each round both views score all documents, and each hands the documents it is surest
of, the same share of either label by rank, to the other, as sums over them: a view is a least-squares discriminant, so the
sums of its features and of their products by label are all that it learns from. Labels handed over weigh as much as they
beat chance on kept-back documents. Both views are calibrated on labelled documents that neither was fitted
on, combined there, and the combination scores every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_rules import FEATURES, lines_of
from .storage import renamed
from .tokens import released, text_chunks

GRAMS, SOURCES, LANGS, LENGTHS = 1024, 256, 64, 24
TEXT_SIZE, META_SIZE = GRAMS + len(FEATURES) + 1, SOURCES + LANGS + LENGTHS


def text_view(texts: list[bytes]) -> np.ndarray:
    """A row per text: square roots of hashed 3-gram shares, word-weighted means of the line features, log of the words."""
    n = len(texts)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=n)
    b = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.uint32)
    out = np.zeros((n, TEXT_SIZE), dtype=np.float32)
    if len(b) >= 3:
        doc = np.repeat(np.arange(n), sizes)
        code = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(22)
        same = doc[:-2] == doc[2:]
        counts = np.bincount((doc[:-2] * GRAMS + code)[same], minlength=n * GRAMS).reshape(n, GRAMS)
        out[:, :GRAMS] = 4 * np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    f = lines_of(texts)
    whole = np.maximum(f.n_words, 1)
    for j in range(len(FEATURES)):
        out[:, GRAMS + j] = 4 * np.bincount(f.doc, weights=f.x[:, j] * f.words, minlength=n) / whole
    out[:, -1] = np.log1p(f.n_words) / 3
    return out


def meta_view(langs: list, sources: list, n_chars: list) -> np.ndarray:
    """A row per document: language, source and binary magnitude of n_chars, one hot; null is a value of its own."""
    out = np.zeros((len(langs), META_SIZE), dtype=np.float32)
    rows = np.arange(len(langs))
    known: dict = {}

    def place(value, size):
        if (value, size) not in known:
            known[value, size] = 0 if value is None else 1 + zlib.crc32(str(value).encode()) % (size - 1)
        return known[value, size]

    out[rows, [place(v, SOURCES) for v in sources]] = 1
    out[rows, [SOURCES + place(v, LANGS) for v in langs]] = 1
    out[rows, [SOURCES + LANGS + (0 if v is None else min(LENGTHS - 1, 1 + max(0, int(v)).bit_length())) for v in n_chars]] = 1
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3, steps: int = 100, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression, by Adam on all rows."""
    weight = np.ones(len(y)) if weight is None else weight
    weight = (weight / weight.sum()).astype(np.float32)
    theta = np.zeros(x.shape[1] + 1)
    m = v = np.zeros_like(theta)
    for step in range(1, steps + 1):
        gap = (_sigmoid(x @ theta[:-1].astype(np.float32) + theta[-1]) - y) * weight
        g = np.append(gap @ x, gap.sum())
        g[:-1] += ridge * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:-1].astype(np.float32), float(theta[-1])


@dataclass
class View:
    weights: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0
    low: float = -np.inf  # raw scores up to it are surely 0
    high: float = np.inf  # from it on surely 1
    trust: tuple[float, float] = (0.0, 0.0)  # how far labels 0 and 1 so given beat chance: 0 not at all, 1 always right

    def raw(self, x):
        return x @ self.weights + self.bias

    def logit(self, x):
        """Calibrated."""
        return self.scale * self.raw(x) + self.shift

    def calibrate(self, x, y):
        w, b = logistic(self.raw(x)[:, None].astype(np.float32), y, ridge=1e-3, steps=300, rate=0.05)
        self.scale, self.shift = max(0.0, float(w[0])), b

    def rank(self, x, y, part):
        """Bars that the lowest and highest ``part`` of each label's number of rows pass, and the trust in either side."""
        raw = self.raw(x).astype(np.float64)
        s, n = np.sort(raw), [max(1, int(part * (y == label).sum())) for label in (0, 1)]
        edge = 1e-4 * s.std()
        self.low, self.high = s[n[0] - 1] + edge, s[-n[1]] - edge
        if self.low >= self.high:
            self.low, self.high = -np.inf, np.inf
        trust = []
        for label, sure in enumerate((raw <= self.low, raw >= self.high)):
            rate = (y == label).mean()
            right = ((y[sure] == label).sum() + rate) / (sure.sum() + 1)
            trust.append(float(max(0.0, (right - rate) / max(1 - rate, 1e-9))))
        self.trust = tuple(trust)


@dataclass
class CoTrained:
    text: View
    meta: View
    mix: np.ndarray  # weights of the two calibrated logits
    bias: float
    exchanged: list[tuple[int, int]] = field(default_factory=list)  # by round: labels given by text, by metadata

    def probability(self, xt, xm):
        a, b = self.text.logit(xt), self.meta.logit(xm)
        return _sigmoid(a), _sigmoid(b), _sigmoid(a * self.mix[0] + b * self.mix[1] + self.bias)


def products(x: np.ndarray) -> np.ndarray:
    """Sum over rows of the products of all features and a constant 1; its last cell is the number of rows."""
    x = np.concatenate([x, np.ones((len(x), 1), dtype=x.dtype)], axis=1)
    return (x.T @ x).astype(np.float64)


def discriminant(labelled: list[np.ndarray], given: list[np.ndarray], trust: tuple[float, float] = (1.0, 1.0), share: float = 0.5, ridge: float = 1e-3) -> View:
    """Least squares of -1 and 1 on products() of each label. Given documents of a label weigh together at most ``share`` of the
    labelled ones, times the trust in them."""
    a, b = 0.0, 0.0
    for sign, own, more, sure in zip((-1, 1), labelled, given, trust, strict=True):
        whole = own + more * (sure * share * min(1.0, own[-1, -1] / max(more[-1, -1], 1.0)))
        whole = whole / max(whole[-1, -1], 1.0)  # both labels weigh alike
        a, b = a + whole, b + sign * whole[-1]
    theta = np.linalg.solve(a + ridge * np.eye(len(a)), b)
    return View(theta[:-1].astype(np.float32), float(theta[-1]))


def sure_rows(views: dict[str, View], xt: np.ndarray, xm: np.ndarray) -> dict[str, list[np.ndarray]]:
    """For each view that is to learn, the rows that the other is sure of, by label."""
    p, q = views["text"].raw(xt), views["meta"].raw(xm)
    return {"meta": [p <= views["text"].low, p >= views["text"].high], "text": [q <= views["meta"].low, q >= views["meta"].high]}


def co_train(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, exchange, rounds: int = 3, part: float = 0.1) -> CoTrained:
    """``y``: labels 0 / 1 of the rows of xt and xm; every fourth row is kept for calibration.

    A view is sure of the rows that rank beyond ``part`` of each label's kept-back rows. ``exchange(views)``: for each view the products() of the documents given to it, by label.
    """
    hold = np.arange(len(y)) % 4 == 3
    data, views, exchanged = {"text": xt, "meta": xm}, {}, []
    labelled = {name: [products(x[~hold & (y == label)]) for label in (0, 1)] for name, x in data.items()}
    given = {name: [np.zeros_like(g) for g in labelled[name]] for name in data}
    trust = dict.fromkeys(data, (0.0, 0.0))
    for turn in range(rounds + 1):
        for name, x in data.items():
            views[name] = discriminant(labelled[name], given[name], trust[name])
            views[name].calibrate(x[hold], y[hold])
            views[name].rank(x[hold], y[hold], part)
        if turn == rounds:
            break
        before, given = given, exchange(views)
        trust = {"text": views["meta"].trust, "meta": views["text"].trust}
        exchanged.append(tuple(int(sum(g[-1, -1] for g in given[taker])) for taker in ("meta", "text")))
        if all(np.array_equal(a, b) for name in given for a, b in zip(given[name], before[name], strict=True)):
            break
    both = np.stack([views["text"].logit(xt[hold]), views["meta"].logit(xm[hold])], axis=1).astype(np.float32)
    mix, bias = logistic(both, y[hold], ridge=1e-3, steps=300)
    return CoTrained(views["text"], views["meta"], np.maximum(mix, 0), bias, exchanged)


COLUMNS = ("id", "text", "lang", "source", "n_chars")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in text_chunks(batch.column("text")):
            xt = text_view(texts)
            xm = meta_view(*(batch.column(c)[part].to_pylist() for c in ("lang", "source", "n_chars")))
            yield pa.record_batch({"id": batch.column("id")[part], "label": batch.column("label")[part], "xt": pa.array([r.astype("<f2").tobytes() for r in xt], pa.binary()), "xm": pa.array([np.packbits(r > 0).tobytes() for r in xm], pa.binary())})


def _rows(docs: DataFrame, id_col, text_col, lang_col, source_col, n_chars_col) -> DataFrame:
    rows = renamed(docs, id=id_col, text=text_col, lang=lang_col, source=source_col, n_chars=n_chars_col)
    return rows.select(F.col("id").cast("long").alias("id"), "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))


#: Sums go to the driver in pieces, each summed up in two steps so that no group has a row for every task.
PIECES, TASKS = 16, 256
#: Partitions that a task sums up where there are many: what is shuffled goes with the tasks, some 8 MB each.
JOINED = 16


def few_tasks(rows: DataFrame) -> DataFrame:
    """``rows``, read whole by two tasks a core, or by one for each JOINED partitions where that is more."""
    return rows.coalesce(max(2 * rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions() // JOINED))


def half(sums: np.ndarray) -> np.ndarray:
    """The upper triangle of products(), which are symmetric, end to end."""
    return sums[np.triu_indices(len(sums))]


def whole(flat: np.ndarray, n: int) -> np.ndarray:
    """half() undone."""
    out = np.zeros((n, n))
    out[np.triu_indices(n)] = flat
    return out + np.triu(out, 1).T


def _exchange(rows: DataFrame, labelled: set[int]):
    """exchange() of co_train() over all of ``rows`` but the labelled ids (at most those of the fit)."""

    def given(views: dict[str, View]) -> dict[str, list[np.ndarray]]:
        sizes = {"text": TEXT_SIZE + 1, "meta": META_SIZE + 1}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {(name, label): np.zeros((n, n)) for name, n in sizes.items() for label in (0, 1)}
            for batch in batches:
                for part, texts in text_chunks(batch.column("text")):
                    free = np.array([i not in labelled for i in batch.column("id")[part].to_pylist()], dtype=bool)
                    x = {"text": text_view(texts), "meta": meta_view(*(batch.column(c)[part].to_pylist() for c in ("lang", "source", "n_chars")))}
                    for name, by_label in sure_rows(views, x["text"], x["meta"]).items():
                        for label, which in enumerate(by_label):
                            if (which & free).any():
                                sums[name, label] += products(x[name][which & free])
            salt = TaskContext.get().partitionId() // TASKS
            for (name, label), total in sums.items():
                if total[-1, -1]:
                    for k, piece in enumerate(np.array_split(half(total), PIECES)):
                        yield pa.record_batch({"view": [name], "label": pa.array([label], pa.int32()), "piece": pa.array([k], pa.int32()), "salt": pa.array([salt], pa.int32()), "sums": pa.array([piece.tobytes()], pa.binary())})

        def summed(table: pa.Table) -> pa.Table:
            total = np.sum([np.frombuffer(b, dtype=np.float64) for b in table.column("sums").to_pylist()], axis=0)
            return table.slice(0, 1).set_column(table.schema.get_field_index("sums"), "sums", pa.array([total.tobytes()], pa.binary()))

        schema = "view string, label int, piece int, salt int, sums binary"
        found = few_tasks(rows.select("id", "text", "lang", "source", "n_chars")).mapInArrow(released(run), schema)
        for keys in (["view", "label", "piece", "salt"], ["view", "label", "piece"]):
            found = found.groupBy(*keys).applyInArrow(summed, schema)
        out = {name: [np.zeros((n, n)), np.zeros((n, n))] for name, n in sizes.items()}
        pieces: dict = {}
        for r in found.collect():
            pieces.setdefault((r["view"], r.label), {})[r.piece] = np.frombuffer(r.sums, dtype=np.float64)
        for (name, label), some in pieces.items():
            out[name][label] = whole(np.concatenate([some[k] for k in range(PIECES)]), sizes[name])
        return out

    return given


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", n_chars_col: str = "n_chars", label_col: str = "quality", max_labelled: int = 3_000, **how) -> CoTrained | None:
    """Classifier fitted on at most ``max_labelled`` labelled documents, the first by hash of the id, and all other documents.

    Rows with a null id or label are left out of the labelled ones; None where there are not two labels to learn. The
    sums of a round depend on the order of tasks in their last digits only.
    """
    rows = _rows(docs, id_col, text_col, lang_col, source_col, n_chars_col)
    known = renamed(labels, id=id_col, label=label_col).where("id IS NOT NULL AND label IN (0, 1)").select(F.col("id").cast("long").alias("id"), F.col("label").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    got = rows.join(F.broadcast(chosen), "id").mapInArrow(released(_features), "id long, label int, xt binary, xm binary").collect()
    got.sort(key=lambda r: (zlib.crc32(str(r.id).encode()), r.id, r.xt))
    xt = np.frombuffer(b"".join(r.xt for r in got), dtype="<f2").astype(np.float32).reshape(len(got), TEXT_SIZE)
    xm = np.unpackbits(np.frombuffer(b"".join(r.xm for r in got), dtype=np.uint8)).astype(np.float32).reshape(len(got), META_SIZE)
    y = np.array([r.label for r in got], dtype=float)
    if len(y) < 8 or len(set(y[np.arange(len(y)) % 4 == 3])) < 2 or len(set(y[np.arange(len(y)) % 4 != 3])) < 2:
        return None
    return co_train(xt, xm, y, _exchange(rows, {r.id for r in got}), **how)


def _scorer(model: CoTrained | None, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_chunks(batch.column("text")):
                if model is None:
                    a = b = p = np.ones(len(texts))
                else:
                    meta = meta_view(*(batch.column(c)[part].to_pylist() for c in ("lang", "source", "n_chars")))
                    a, b, p = (v.astype(np.float64) for v in model.probability(text_view(texts), meta))
                yield pa.record_batch({"id": batch.column("id")[part], "text_score": a, "meta_score": b, "score": p, "kept": p >= threshold})

    return run


def score_quality(docs: DataFrame, model: CoTrained | None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", n_chars_col: str = "n_chars", threshold: float = 0.5) -> DataFrame:
    """One row per input row: id_col, text_score, meta_score, score (1: good), kept.

    Null text is empty; other nulls are values of their own; null ids and repeated rows are scored like others. Without a
    model (no labels to learn from) every score is 1. An empty table gives no rows; other columns are ignored.
    """
    rows = _rows(docs, id_col, text_col, lang_col, source_col, n_chars_col)
    return rows.mapInArrow(released(_scorer(model, threshold)), "id long, text_score double, meta_score double, score double, kept boolean").withColumnRenamed("id", id_col)


def good_documents(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """The documents that the classifier keeps, all columns as they were; rows that share an id are judged by each text.

    A row stays with the verdict of its own columns: the score runs beside the row, without a join.
    """
    model = fit_quality(docs, labels, **columns)
    names = {"id_col": "doc_id", "text_col": "text", "lang_col": "lang", "source_col": "source", "n_chars_col": "n_chars"} | columns
    judge = _scorer(model, 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.record_batch({c: batch.column(names[f"{c}_col"]) for c in COLUMNS})
            own = own.set_column(0, "id", pa.nulls(batch.num_rows, pa.int64()))
            kept = [v for out in judge([own]) for v in out.column("kept").to_pylist()]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)


def op2_quality_classifier(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_quality(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
