"""Estimates from neighbours, folds, regressions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def idw(near: DataFrame, values: DataFrame, value: str = "y", id_col: str = "id") -> DataFrame:
    """query, estimate, n: mean of the neighbours' values by 1 / (distance + 1e-6)."""
    known = values.where(F.col(value).isNotNull()).select(F.col(id_col).alias("id"), F.col(value).alias("__y"))
    w = 1 / (F.col("distance") + 1e-6)
    return near.join(known, "id").groupBy("query").agg((F.sum(w * F.col("__y")) / F.sum(w)).alias("estimate"), F.count(F.lit(1)).alias("n"))


def tiered(first: DataFrame, second: DataFrame, least: int = 2) -> DataFrame:
    """query, estimate, tier: of the first tier where it has enough neighbours, else of the second."""
    a = first.select("query", F.col("estimate").alias("e1"), F.col("n").alias("n1"))
    b = second.select("query", F.col("estimate").alias("e2"))
    enough = F.coalesce(F.col("n1") >= least, F.lit(False))
    return b.join(a, "query", "full").select("query", F.when(enough, F.col("e1")).otherwise(F.col("e2")).alias("estimate"), F.when(enough, 1).otherwise(2).alias("tier"))


# ---- folds ----
def contiguous_folds(rows: DataFrame, order: list[str], k: int = 10, out: str = "fold") -> DataFrame:
    """Rows with fold 0..k-1: blocks of the order, equal in rows. Places are counted by range partitions, then within them."""
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    from .staging import staged

    parts = staged(parts)
    sizes = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__p")) - F.col("__n"))  # a row per partition
    n = F.broadcast(sizes.agg(F.sum("__n").alias("__all")))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy("__i")) - 1
    placed = parts.withColumn("__k", inside).join(F.broadcast(before.drop("__n")), "__p").crossJoin(n)
    return placed.withColumn(out, F.floor((F.col("__k") + F.col("__before")) * k / F.col("__all")).cast("int")).drop("__p", "__i", "__k", "__before", "__all")


def hashed_folds(rows: DataFrame, key: str, k: int = 10, seed: int = 0, out: str = "fold") -> DataFrame:
    """Rows with fold 0..k-1 by hash of the key: shuffled, and the same again for the same key."""
    return rows.withColumn(out, F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(k)).cast("int"))


def grouped_folds(rows: DataFrame, group: str, k: int = 10, out: str = "fold", max_groups: int = 200_000) -> DataFrame:
    """Rows with fold 0..k-1, a group whole in one: groups by falling size, each to the lightest fold (ties: the first).

    Sizes are counted by Spark; the greedy deal goes over one row per group on the driver, at most ``max_groups``.
    """
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).limit(max_groups + 1).collect()
    if len(sizes) > max_groups:
        raise ValueError(f"more than {max_groups} groups")
    load, dealt = [0] * k, []
    for r in sorted(sizes, key=lambda r: (-r.n, r[group] is None, r[group])):
        f = load.index(min(load))
        load[f] += r.n
        dealt.append((r[group], f))
    spark = rows.sparkSession
    kind = dict(rows.dtypes)[group]
    table = spark.createDataFrame(dealt, f"__g {kind}, {out} int")
    return rows.join(F.broadcast(table), rows[group].eqNullSafe(F.col("__g"))).drop("__g")


# ---- regressions ----
#: Rows of a task of boosted(): about 60 MB as the trees hold them.
BOOSTED_ROWS = 250_000


def boosted(train: DataFrame, features: list[str], label: str, rounds: int = 100, depth: int = 3, step: float = 0.05, subsample: float = 0.8, weight: str | None = None, seed: int = 0):
    """Fitted pipeline: gradient-boosted trees (depth 6 stands for the histogram kind with 63 leaves)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    from .staging import staged

    columns = list(dict.fromkeys([*features, label, *([weight] if weight else [])]))
    rows = staged(train.select(*columns))
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // BOOSTED_ROWS))
    # Each tree reads all rows again: as many rows a task whatever the input's files are, in an order of their own for the draws.
    rows = rows.repartition(parts).sortWithinPartitions(*columns)
    gbt = GBTRegressor(featuresCol="__x", labelCol=label, predictionCol="prediction", maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=subsample, seed=seed)
    if weight:
        gbt = gbt.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="keep"), gbt]).fit(rows)


def ridge(train: DataFrame, features: list[str], label: str, penalties=tuple(10 ** (-3 + 0.25 * i) for i in range(25)), folds: int = 5, weight: str | None = None, seed: int = 0):
    """Fitted pipeline: linear regression on standardised features, the L2 penalty chosen by cross-validation."""
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    lr = LinearRegression(featuresCol="__x", labelCol=label, elasticNetParam=0.0)
    if weight:
        lr = lr.setWeightCol(weight)
    grid = ParamGridBuilder().addGrid(lr.regParam, list(penalties)).build()
    cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol=label, metricName="mae"), numFolds=folds, seed=seed, parallelism=4)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="keep"), cv]).fit(train)


def perceptron(train: DataFrame, features: list[str], label: str, hidden=(128, 32), epochs: int = 200, alpha: float = 1.0, patience: int = 10, seed: int = 0) -> Callable[[DataFrame], DataFrame]:
    """Function that adds ``prediction``: a small network fitted on all rows, by limited-memory BFGS.

    An epoch is a pass over the staged rows in which each task sums its rows' gradients; the sums are added in groups of
    tasks, so the driver sees some square root of them, each as large as the network. A tenth of the rows, by a hash of
    their values, is kept back: the weights of the least error there stay, and after ``patience`` epochs without a better
    one fitting ends. Rows with a null or NaN in features or label are not fitted on; they, and all rows where none are
    left to fit on, get a null prediction.
    """
    from .staging import staged

    rows = train.select(*[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(features)], F.col(label).cast("double").alias("y"))
    names = rows.columns
    rows = staged(rows.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in names)).withColumn("held", F.pmod(F.xxhash64(*names), F.lit(10)) == 9))
    at = rows.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in names for f in (F.avg, F.stddev_pop)], F.sum((~F.col("held")).cast("long")).alias("n")).first()
    n = at["n"] or 0
    mean = np.array([at[f"avg_{c}"] or 0.0 for c in names])
    scale = np.array([at[f"stddev_pop_{c}"] or 0.0 for c in names]) + 1e-9
    sizes = [len(features), *hidden, 1]
    shapes = [s for a, b in zip(sizes, sizes[1:], strict=False) for s in ((a, b), (b,))]
    rng = np.random.default_rng(seed)
    flat = np.concatenate([(rng.normal(0, np.sqrt(2 / s[0]), s) if len(s) == 2 else np.zeros(s)).ravel() for s in shapes])
    inner = np.concatenate([np.full(int(np.prod(s)), float(len(s) == 2)) for s in shapes])  # the penalty spares the offsets

    def error(p: np.ndarray) -> tuple[float, np.ndarray, float | None]:
        """Mean loss and gradient on the rows fitted on, mean squared error on those kept back."""

        def task(batches):
            total = np.zeros(3 + len(p))
            for b in batches:
                z = (b[names].to_numpy() - mean) / scale
                held = b["held"].to_numpy()
                acts = _forward(p, shapes, z[:, :-1])
                g = (acts[-1][:, 0] - z[:, -1])[:, None]
                total[:3] += ((g[~held] ** 2).sum() / 2, (g[held] ** 2).sum(), held.sum())
                total[3:] += _gradient(p, shapes, [a[~held] for a in acts], g[~held])
            yield pd.DataFrame({"s": [total]})

        t = _added(rows.mapInPandas(task, "s array<double>"))
        return t[0] / n + alpha / 2 / n * (inner * p**2).sum(), t[3:] / n + alpha / n * inner * p, t[1] / t[2] if t[2] else None

    best = (np.inf, flat)
    if n:
        loss, grad, kept_back = error(flat)
        pairs, wait, passes = [], 0, 1
        while passes < epochs and wait < patience and np.abs(grad).max() > 1e-6:
            move, size = _direction(grad, pairs), 1.0 if pairs else min(1.0, 1 / np.abs(grad).sum())
            while passes < epochs:
                got = error(flat + size * move)
                passes += 1
                if got[0] <= loss + 1e-4 * size * grad @ move:
                    break
                size /= 4
            else:
                break
            if (got[1] - grad) @ move > 0:
                pairs = [*pairs[-9:], (size * move, got[1] - grad)]
            flat, (loss, grad, kept_back) = flat + size * move, got
            now = loss if kept_back is None else kept_back
            if now < best[0] - 1e-4:
                best, wait = (now, flat), 0
            else:
                wait += 1
        if best[0] == np.inf:
            best = (0.0, flat)
    weights = best[1]

    def predict(*columns: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(dtype=float) for c in columns], 1)
        out = _forward(weights, shapes, (x - mean[:-1]) / scale[:-1])[-1][:, 0] * scale[-1] + mean[-1]
        return pd.Series(out).where(~np.isnan(x).any(1) & bool(n), None)

    udf = F.pandas_udf(predict, "double")
    return lambda df: df.withColumn("prediction", udf(*[F.col(c).cast("double") for c in features]))


def _layers(p: np.ndarray, shapes: list[tuple]) -> list[np.ndarray]:
    return [part.reshape(s) for part, s in zip(np.split(p, np.cumsum([int(np.prod(s)) for s in shapes])[:-1]), shapes, strict=True)]


def _forward(p: np.ndarray, shapes: list[tuple], x: np.ndarray) -> list[np.ndarray]:
    """Input and output of each layer; all but the last are rectified."""
    acts, parts = [x], _layers(p, shapes)
    for i in range(0, len(parts), 2):
        x = acts[-1] @ parts[i] + parts[i + 1]
        acts.append(np.maximum(x, 0) if i + 2 < len(parts) else x)
    return acts


def _gradient(p: np.ndarray, shapes: list[tuple], acts: list[np.ndarray], g: np.ndarray) -> np.ndarray:
    """Sum over rows of the loss's gradient, ``g`` being that of the output."""
    parts, out = _layers(p, shapes), []
    for i in range(len(parts) // 2 - 1, -1, -1):
        out = [(acts[i].T @ g).ravel(), g.sum(0), *out]
        g = (g @ parts[2 * i].T) * (acts[i] > 0)
    return np.concatenate(out)


def _direction(grad: np.ndarray, pairs: list[tuple]) -> np.ndarray:
    """Downhill by the last steps and changes of the gradient (two-loop recursion)."""
    q, taken = grad.copy(), []
    for s, y in reversed(pairs):
        a = (s @ q) / (s @ y)
        q -= a * y
        taken.append(a)
    if pairs:
        s, y = pairs[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(pairs, reversed(taken), strict=True):
        q += s * (a - (y @ q) / (s @ y))
    return -q


def _added(sums: DataFrame) -> np.ndarray:
    """Sum of the arrays of ``s``, one a task: in groups of tasks first, so that the driver adds few."""

    def task(batches):
        total = None
        for b in batches:
            part = np.sum(np.stack(b["s"].to_numpy()), 0)
            total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"s": [total]})

    tasks = sums.rdd.getNumPartitions()
    if tasks > 64:
        sums = sums.repartition(int(tasks**0.5)).mapInPandas(task, "s array<double>")
    return np.sum([r.s for r in sums.collect()], 0)


def out_of_fold(rows: DataFrame, fit: Callable[[DataFrame], object], k: int = 10, fold: str = "fold") -> DataFrame:
    """Rows with prediction, each by a model fitted on the other folds. ``fit``: DataFrame -> model (transform) or function."""
    out = None
    for f in range(k):
        model = fit(rows.where(F.col(fold) != f))
        held = rows.where(F.col(fold) == f)
        part = model.transform(held) if hasattr(model, "transform") else model(held)
        part = part.select(*rows.columns, "prediction")
        out = part if out is None else out.unionByName(part)
    return out


def held_out_cluster(rows: DataFrame, inside: Column, fit: Callable[[DataFrame], object], work: str, stratum: str) -> DataFrame:
    """work, stratum, n, p250, p500, p750: estimates of the cluster's rows by work, by a model that saw no row of the cluster.

    ``fit`` gets the rows where ``inside`` is not true. ``stats.spearman`` of stratum and p500 says whether the model tells the
    strata's order. A work of several strata has a row in each.
    """
    from .staging import staged
    from .stats import five_numbers

    rows = staged(rows)  # fitting, scoring and the list of works each read them
    model = fit(rows.where(~F.coalesce(inside, F.lit(False))))
    held = rows.where(inside)
    scored = model.transform(held) if hasattr(model, "transform") else model(held)
    return five_numbers(scored, [work, stratum], "prediction", (0.25, 0.5, 0.75)).select(work, stratum, "n", "p250", "p500", "p750")


def ablation(rows: DataFrame, groups: dict[str, list[str]], fit: Callable[[DataFrame, list[str]], object], label: str, k: int = 5) -> DataFrame:
    """groups, mae: cross-validated error of each feature group alone, and of all."""
    out = None
    for name, features in {**groups, "all": [f for g in groups.values() for f in g]}.items():
        scored = out_of_fold(rows, lambda d, fs=features: fit(d, fs), k)
        one = scored.agg(F.avg(F.abs(F.col("prediction") - F.col(label))).alias("mae")).select(F.lit(name).alias("features"), "mae")
        out = one if out is None else out.unionByName(one)
    return out


def importances(model, features: list[str], spark) -> DataFrame:
    """feature, importance of a fitted boosted(), the largest first."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(sorted(zip(features, values, strict=True), key=lambda p: (-p[1], p[0])), "feature string, importance double")


def principal_components(rows: DataFrame, features: list[str], k: int = 5) -> tuple[DataFrame, list[float]]:
    """Rows with pc (array), and each component's share of the variance; signs are arbitrary."""
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from .features import z_scores

    z = z_scores(rows, features)
    x = VectorAssembler(inputCols=[f"{f}_z" for f in features], outputCol="__x").transform(z)
    model = PCA(k=k, inputCol="__x", outputCol="__pc").fit(x)
    return model.transform(x).withColumn("pc", vector_to_array("__pc")).drop("__x", "__pc", *[f"{f}_z" for f in features]), model.explainedVariance.toArray().tolist()


def truncated_svd(weights: DataFrame, k: int = 50, extra: int = 10, powers: int = 2, seed: int = 0) -> DataFrame:
    """doc, v: rows of a sparse matrix (doc, term, w) in its first k left directions, times singular values; signs are arbitrary.

    A randomised range finder: every term draws ``k + extra`` normal numbers from its own hash, so documents are summed
    without a table of terms; ``powers`` passes to the terms and back turn the range towards the large directions. Tall tables
    are made orthonormal by the triangular factor of their rows, stacked from task to task; only such factors, of
    ``k + extra`` rows, meet the driver. There is no bound on documents or terms. Exact up to rounding where the matrix has
    no more than ``k + extra`` independent rows, else as near as the singular values fall off beyond them. Cells that repeat
    are added; null documents, terms and weights go. v is as long as the smaller of k and the rank.
    """
    from .staging import staged

    wide = k + extra
    cells = staged(weights.where("doc IS NOT NULL AND term IS NOT NULL AND w IS NOT NULL").groupBy("doc", "term").agg(F.sum(F.col("w").cast("double")).alias("w")))

    def summed(rows: DataFrame, key: str, width: int) -> DataFrame:
        """key, v: sum of w times the vector v."""
        sums = rows.groupBy(key).agg(*[F.sum(F.col("w") * F.col("v")[j]).alias(f"__{j}") for j in range(width)])
        return staged(sums.select(key, F.array(*[f"__{j}" for j in range(width)]).alias("v")))

    def times(rows: DataFrame, right: np.ndarray) -> DataFrame:
        def task(batches):
            for b in batches:
                yield b.assign(v=list(np.stack(b["v"].to_numpy()) @ right))

        return rows.mapInPandas(task, rows.schema)

    def orthonormal(rows: DataFrame) -> tuple[DataFrame, int]:
        """Rows in an orthonormal base of their columns' range; twice, as once loses digits where columns are nearly alike."""
        width = 0
        for _ in range(2):
            _, size, right = np.linalg.svd(_triangle(rows))
            width = int((size > 1e-10 * size[0]).sum()) if len(size) and size[0] > 0 else 0
            rows = staged(times(rows, right[:width].T / size[:width]))
            if not width:
                break
        return rows, width

    def normal(j: int) -> Column:
        u = [(F.pmod(F.xxhash64(F.lit(seed), F.lit(2 * j + i), "term"), F.lit(1 << 52)) + 0.5) / (1 << 52) for i in (0, 1)]
        return F.sqrt(-2 * F.log(u[0])) * F.cos(2 * np.pi * u[1])

    draws = cells.select("term").distinct().select("term", F.array(*[normal(j) for j in range(wide)]).alias("v"))
    base, width = orthonormal(summed(cells.join(draws, "term"), "doc", wide))
    for _ in range(powers):
        if not width:
            break
        terms, width = orthonormal(summed(cells.join(base, "doc"), "term", width))
        base, width = orthonormal(summed(cells.join(terms, "term"), "doc", width))
    if not width:
        return cells.select("doc").distinct().select("doc", F.array().cast("array<double>").alias("v"))
    small = _triangle(summed(cells.join(base, "doc"), "term", width))  # of the terms in the base: its right directions turn it
    _, size, right = np.linalg.svd(small)
    keep = min(k, int((size > 1e-10 * size[0]).sum()))
    return times(base, right[:keep].T * size[:keep]).select("doc", "v")


def _triangle(rows: DataFrame) -> np.ndarray:
    """Triangular factor of the tall matrix whose rows are ``v``: each task's, then those of groups of tasks, then all."""

    def task(batches):
        held = None
        for b in batches:
            part = np.stack(b["v"].to_numpy())
            held = np.linalg.qr(part if held is None else np.vstack([held, part]), "r")
        if held is not None:
            yield pd.DataFrame({"v": list(held)})

    factors, tasks = rows.select("v").mapInPandas(task, "v array<double>"), rows.rdd.getNumPartitions()
    if tasks > 64:
        factors = factors.repartition(int(tasks**0.5)).mapInPandas(task, "v array<double>")
    found = [r.v for r in factors.collect()]
    return np.linalg.qr(np.array(found), "r") if found else np.zeros((0, 0))


def anchor_weight(width: Column, least: float = 50.0) -> Column:
    return 1 / F.greatest(width, F.lit(least))
