"""Boosted trees over binned features, grown leaf by leaf, every sum of gradients a Spark job over all rows."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import spread, staged

MISSING = 255
#: Gradients and weights are whole multiples of their largest value / 2^20, so sums do not depend on the order of rows.
STEPS = 1 << 20


@dataclass
class Node:
    """A leaf, or a split: bins up to ``cut`` of ``feature`` go to ``left``; missing values where ``lost_left`` says."""

    depth: int
    rows: int
    value: float
    feature: int = -1
    cut: int = 0
    lost_left: bool = False
    gain: float = 0.0
    sides: tuple = ()
    known: bool = False
    left: int = -1
    right: int = -1


@dataclass
class Tree:
    nodes: list[Node] = field(default_factory=list)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Node at which each row of bins comes to rest."""
        at = np.zeros(len(x), int)
        todo = [(0, np.arange(len(x)))]
        while todo:
            i, who = todo.pop()
            node = self.nodes[i]
            if node.left < 0:
                at[who] = i
                continue
            b = x[who, node.feature]
            left = np.where(b == MISSING, node.lost_left, b <= node.cut)
            todo += [(node.left, who[left]), (node.right, who[~left])]
        return at

    def values(self, x: np.ndarray) -> np.ndarray:
        return np.array([n.value for n in self.nodes])[self.leaves(x)]


def best_split(c: np.ndarray, w: np.ndarray, g: np.ndarray, least: int) -> tuple | None:
    """(gain, cut, missing goes left, (rows, w, g) left, right) of one feature's 256 bins; the first of equal gains."""
    total = np.array([c.sum(), w.sum(), g.sum()], dtype=float)
    if total[1] <= 0:
        return None
    sums = np.stack([c[:MISSING], w[:MISSING], g[:MISSING]]).astype(float).cumsum(1)
    lost = np.array([c[MISSING], w[MISSING], g[MISSING]], dtype=float)
    best = None
    for lost_left in (False, True) if lost[0] else (False,):
        left = sums + lost[:, None] * lost_left
        right = total[:, None] - left
        fit = (left[0] >= least) & (right[0] >= least) & (left[1] > 0) & (right[1] > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(fit, left[2] ** 2 / left[1] + right[2] ** 2 / right[1] - total[2] ** 2 / total[1], -np.inf)
        k = int(gain.argmax())
        if gain[k] > 1e-9 * max(1.0, total[1]) and (best is None or gain[k] > best[0]):
            best = float(gain[k]), k, lost_left, tuple(left[:, k].tolist()), tuple(right[:, k].tolist())
    return best


def _edges(rows: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Upper ends of the bins of each feature: its quantiles, in a sketch of bounded size."""
    at = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.when(~F.isnan(c), F.col(c)), at, 20_000).alias(c) for c in features]).first()
    return [np.unique(np.array(found[c] or [], dtype=float)) for c in features]


def _bins(columns: list[np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
    out = np.full((len(columns[0]), len(edges)), MISSING, np.uint8)
    for j, (x, e) in enumerate(zip(columns, edges, strict=True)):
        ok = ~np.isnan(x)
        out[ok, j] = np.searchsorted(e, x[ok], side="left")
    return out


def _grown(tree: Tree, leaves: int) -> list[int]:
    """Splits that best-first growth takes among the nodes looked into so far, the largest gain first.

    A node's split depends on its own rows only, so growth leaf by leaf is a choice among splits found level by level.
    """
    heap, taken = [(-tree.nodes[0].gain, 0)], []
    while heap and len(taken) < leaves - 1:
        gain, i = heapq.heappop(heap)
        if gain >= 0:
            break
        taken.append(i)
        node = tree.nodes[i]
        for child in (node.left, node.right):
            if child >= 0 and tree.nodes[child].known:
                heapq.heappush(heap, (-tree.nodes[child].gain, child))
    return taken


def _pruned(tree: Tree, leaves: int) -> Tree:
    """``tree`` with the splits of best-first growth alone."""
    keep, out = set(_grown(tree, leaves)), Tree()

    def copy(i: int) -> int:
        n = tree.nodes[i]
        at = len(out.nodes)
        out.nodes.append(Node(n.depth, n.rows, n.value, n.feature, n.cut, n.lost_left))
        if i in keep:
            out.nodes[at].left, out.nodes[at].right = copy(n.left), copy(n.right)
        return at

    copy(0)
    return out


@dataclass
class Fitted:
    """Edges of the bins, and for each model its starting value and trees. Called with a DataFrame it adds ``prediction``."""

    features: list[str]
    edges: list[np.ndarray]
    start: list[float | None]
    trees: list[list[Tree]]
    losses: list[list[float]]

    def __call__(self, df: DataFrame, fold: str | None = None) -> DataFrame:
        """``prediction`` by the first model, or by the one that did not see the row's fold; null where nothing was fitted."""
        edges, start, trees = self.edges, self.start, self.trees

        @F.pandas_udf("double")
        def predict(which: pd.Series, *columns: pd.Series) -> pd.Series:
            x, m = _bins([c.to_numpy(dtype=float) for c in columns], edges), which.to_numpy()
            out = np.full(len(m), np.nan)
            for k in np.unique(m[(m >= 0) & (m < len(start))]):
                if start[k] is not None:
                    who = m == k
                    out[who] = start[k] + sum((t.values(x[who]) for t in trees[k]), np.zeros(who.sum()))
            return pd.Series(out).where(~np.isnan(out), None)

        which = F.coalesce(F.col(fold).cast("int"), F.lit(-1)) if fold else F.lit(0)
        return df.withColumn("prediction", predict(which, *[F.col(c).cast("double") for c in self.features]))


def fitted(
    train: DataFrame, features: list[str], label: str, rounds: int = 500, leaves: int = 63, step: float = 0.05, least: int = 20, bins: int = 255,
    patience: int | None = 10, weight: str | None = None, fold: str | None = None, k: int = 1, every: int = 1,
) -> Fitted:
    """Least-squares boosting: each tree grows by the leaf of the largest gain up to ``leaves``, ``least`` rows a leaf.

    With ``fold`` (0..k-1) the k models that each leave one fold out are fitted in the same passes. A tenth of the rows, by a
    hash of features and label, is kept back; a model stops after ``patience`` rounds without a better loss there
    (None: no rows are kept back). The staged scores are brought up to date after ``every`` rounds. Rows with a null or NaN label are left out; missing features have a bin of their own. A
    pass gives one row of 256 sums for each task, open leaf and feature; the driver sees a row for each open leaf.
    """
    if bins > MISSING:
        raise ValueError(f"at most {MISSING} bins")
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    rows = train.select(*[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(features)], F.col(label).cast("double").alias("y"), w.alias("w"), (F.col(fold) if fold else F.lit(-1)).cast("int").alias("fold"))
    rows = rows.where(F.col("y").isNotNull() & ~F.isnan("y") & (F.col("w") > 0))
    names = [f"x{j}" for j in range(len(features))]
    edges = _edges(rows, names, bins)
    held = F.pmod(F.xxhash64(*names, "y"), F.lit(10)) == 0 if patience else F.lit(False)
    models = range(k if fold else 1)
    mine = [(F.col("fold") != m) & ~F.col("held") if fold else ~F.col("held") for m in models]

    def stored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _bins([b[c].to_numpy(dtype=float) for c in names], edges)
            yield pd.DataFrame({"x": [r.tobytes() for r in x], "y": b["y"], "w": b["w"], "fold": b["fold"].fillna(-1).astype("int32"), "held": b["held"]})

    rows = spread(rows.withColumn("held", held))  # a table of one small file was one task in every pass
    state = staged(rows.mapInPandas(stored, "x binary, y double, w double, fold int, held boolean"))
    sums = state.agg(*[F.sum(F.when(c, F.col("y") * F.col("w"))).alias(f"s{m}") for m, c in enumerate(mine)], *[F.sum(F.when(c, F.col("w"))).alias(f"w{m}") for m, c in enumerate(mine)], F.max("w").alias("top"), F.min("y").alias("lo"), F.max("y").alias("hi")).first()
    start = [sums[f"s{m}"] / sums[f"w{m}"] if sums[f"w{m}"] else None for m in models]
    out = Fitted(features, edges, start, [[] for _ in models], [[] for _ in models])
    live = {m for m in models if start[m] is not None}
    if not live:
        return out
    top, unit = sums["top"], ((sums["hi"] - sums["lo"]) or 1.0) / STEPS
    scores = [f"s{m}" for m in models]  # a column each: a row is never an object of Python
    state = state.select("*", *[F.lit(start[m] if m in live else 0.0).alias(scores[m]) for m in models])
    fresh: list[list[Tree]] = [[] for _ in models]  # trees that the staged scores do not hold yet

    def arrays(b: pd.DataFrame, fresh: list[list[Tree]]) -> tuple:
        x = np.frombuffer(b"".join(b["x"]), np.uint8).reshape(len(b), len(features))
        score = b[scores].to_numpy(copy=True)
        for m, trees in enumerate(fresh):
            for t in trees:
                score[:, m] += t.values(x)
        return x, score

    def histograms(growing: dict[int, Tree], wanted: dict[int, list[int]], fresh: list[list[Tree]]):
        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = {}
            for b in batches:
                x, score = arrays(b, fresh)
                w = np.rint(b["w"].to_numpy() / top * STEPS)
                for m, ids in wanted.items():
                    use = ~b["held"].to_numpy() & (b["fold"].to_numpy() != m)
                    slot = np.full(len(growing[m].nodes), -1)
                    slot[ids] = np.arange(len(ids))
                    at = slot[growing[m].leaves(x)]
                    use &= at >= 0
                    g = np.rint((b["y"].to_numpy() - score[:, m]) / unit * b["w"].to_numpy() / top)[use]
                    cells = found.setdefault(m, np.zeros((3, len(ids), len(features), 256)))
                    for j in range(len(features)):
                        key = at[use] * 256 + x[use, j]
                        for part, v in zip(cells, (None, w[use], g), strict=True):
                            part[:, j] += np.bincount(key, v, minlength=len(ids) * 256).reshape(len(ids), 256)
            for m, cells in found.items():
                seen = np.argwhere(cells[0].any(2))
                if len(seen):
                    yield pd.DataFrame({"model": m, "leaf": [wanted[m][i] for i, _ in seen], "feature": seen[:, 1], **{n: [cells[p, i, j].astype(np.int64) for i, j in seen] for p, n in enumerate("cwg")}})

        def split(pdf: pd.DataFrame) -> pd.DataFrame:
            s = best_split(*[np.sum(np.stack(pdf[n].to_numpy()), 0) for n in "cwg"], least)
            row = pdf.loc[0, ["model", "leaf", "feature"]].tolist()
            gain, cut, lost, left, right = s or (0.0, 0, False, (0.0,) * 3, (0.0,) * 3)
            return pd.DataFrame([[*row, gain, cut, lost, list(left), list(right)]], columns=["model", "leaf", "feature", "gain", "cut", "lost_left", "l", "r"])

        kinds = "model int, leaf int, feature int"
        each = state.mapInPandas(task, f"{kinds}, c array<long>, w array<long>, g array<long>").groupBy("model", "leaf", "feature").applyInPandas(split, f"{kinds}, gain double, cut int, lost_left boolean, l array<double>, r array<double>")
        return each.groupBy("model", "leaf").agg(F.max_by(F.struct("feature", "gain", "cut", "lost_left", "l", "r"), F.struct("gain", -F.col("feature"))).alias("s")).collect()

    def value(side) -> float:
        return step * side[2] * unit / (side[1] / STEPS) if side[1] else 0.0

    for turn in range(rounds):
        growing = {m: Tree([Node(0, 0, 0.0)]) for m in live}
        wanted = {m: [0] for m in live}
        while wanted:
            for r in histograms(growing, wanted, fresh):
                node = growing[r.model].nodes[r.leaf]
                node.feature, node.gain, node.cut, node.lost_left, node.sides = r.s.feature, r.s.gain, r.s.cut, r.s.lost_left, (r.s.l, r.s.r)
            following = {}
            for m, ids in wanted.items():
                for i in ids:
                    growing[m].nodes[i].known = True
            for m, tree in growing.items():
                for i in _grown(tree, leaves):
                    node = tree.nodes[i]
                    if node.left < 0:
                        node.left, node.right = len(tree.nodes), len(tree.nodes) + 1
                        for side in node.sides:  # a side too small to split is known as it is
                            tree.nodes.append(Node(node.depth + 1, int(side[0]), value(side), known=side[0] < 2 * least))
                            if not tree.nodes[-1].known:
                                following.setdefault(m, []).append(len(tree.nodes) - 1)
            wanted = following
        for m, tree in growing.items():
            tree = _pruned(tree, leaves)
            if tree.nodes[0].left < 0:
                live.discard(m)
            else:
                out.trees[m].append(tree)
                fresh[m].append(tree)
        if patience and live:
            for m, loss in _losses(state, arrays, fresh, sorted(live)).items():
                out.losses[m].append(loss)
                best = int(np.argmin(out.losses[m]))
                if len(out.losses[m]) - 1 - best >= patience:
                    out.trees[m] = out.trees[m][: best + 1]
                    live.discard(m)
        if not live:
            break
        if (turn + 1) % every == 0 and turn + 1 < rounds:
            state, fresh = _rescored(state, arrays, fresh), [[] for _ in models]
    return out


def _rescored(state: DataFrame, arrays: Callable, fresh: list[list[Tree]]) -> DataFrame:
    def task(batches):
        for b in batches:
            score = arrays(b, fresh)[1]
            yield b.assign(**{f"s{m}": score[:, m] for m in range(score.shape[1])})

    return staged(state.mapInPandas(task, state.schema))


def _losses(state: DataFrame, arrays: Callable, fresh: list[list[Tree]], live: list[int]) -> dict[int, float]:
    """Mean squared error of each live model on its rows kept back."""

    def task(batches):
        for b in batches:
            _, score = arrays(b, fresh)
            for m in live:
                use = b["fold"].to_numpy() != m
                yield pd.DataFrame({"model": [m], "e": [float((b["w"] * (b["y"] - score[:, m]) ** 2)[use].sum())], "w": [float(b["w"][use].sum())]})

    sums = state.where("held").mapInPandas(task, "model int, e double, w double").groupBy("model").agg(F.sum("e").alias("e"), F.sum("w").alias("w")).collect()
    return {r.model: r.e / r.w for r in sums if r.w}


def out_of_fold(rows: DataFrame, features: list[str], label: str, k: int, fold: str = "fold", **how) -> DataFrame:
    """Rows with prediction, each by the model fitted on the other folds; all k are fitted in the same passes."""
    return fitted(rows, features, label, fold=fold, k=k, **how)(rows, fold)
