"""Boosted trees against a plain loop over values."""

import numpy as np
import pandas as pd
import pytest

from stratalith.operators import boosting, model


def plain(x, y, rounds, leaves, step, least):
    """Trees grown leaf by leaf over all cuts between values."""
    score = np.full(len(y), y.mean())
    for _ in range(rounds):
        parts = [np.arange(len(y))]

        def cut(who):
            g, best = (y - score)[who], (1e-9, None)
            for j in range(x.shape[1]):
                for v in np.unique(x[who, j])[:-1]:
                    left = x[who, j] <= v
                    if left.sum() >= least and (~left).sum() >= least:
                        gain = g[left].sum() ** 2 / left.sum() + g[~left].sum() ** 2 / (~left).sum() - g.sum() ** 2 / len(g)
                        if gain > best[0] * (1 + 1e-9):
                            best = gain, left
            return best

        cuts = [cut(parts[0])]
        while len(parts) < leaves:
            i = max(range(len(parts)), key=lambda i: cuts[i][0] if cuts[i][1] is not None else -1)
            if cuts[i][1] is None:
                break
            who, left = parts[i], cuts[i][1]
            parts[i : i + 1] = [who[left], who[~left]]
            cuts[i : i + 1] = [cut(who[left]), cut(who[~left])]
        residual = y - score
        for who in parts:
            score[who] += step * residual[who].mean()
    return score


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(5)
    x = np.stack([rng.integers(0, 60, 400), rng.integers(0, 9, 400)], 1).astype(float)
    return x, 10 * np.sin(x[:, 0] / 9) + x[:, 1] ** 2 + rng.normal(0, 1, 400)


def test_trees_are_the_plain_loop_s(spark, sample):
    x, y = sample
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(y)), "a": x[:, 0], "b": x[:, 1], "y": y})).repartition(3)
    fit = boosting.fitted(df, ["a", "b"], "y", rounds=3, leaves=12, step=0.3, least=10, patience=None, every=2)
    assert all(sum(n.left < 0 for n in t.nodes) <= 12 for t in fit.trees[0])
    got = fit(df).orderBy("id").toPandas()["prediction"].to_numpy()
    assert np.abs(got - plain(x, y, 3, 12, 0.3, 10)).max() < 1e-3


def test_folds_fitted_together_are_those_fitted_alone(spark, sample):
    x, y = sample
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(y)), "a": x[:, 0], "b": x[:, 1], "y": y, "fold": np.arange(len(y)) % 2}))
    how = dict(rounds=2, leaves=6, step=0.3, least=10, patience=None)
    got = {r.id: r.prediction for r in boosting.out_of_fold(df, ["a", "b"], "y", 2, **how).collect()}
    for f in (0, 1):
        use = np.arange(len(y)) % 2 != f
        alone = boosting.fitted(df.where(f"fold <> {f}"), ["a", "b"], "y", **how)
        assert {r.id: pytest.approx(r.prediction, abs=1e-3) for r in alone(df.where(f"fold = {f}")).collect()} == {i: v for i, v in got.items() if i % 2 == f}
        assert len(alone.trees[0]) == 2 and alone.start[0] == pytest.approx(y[use].mean())


def test_it_stops_on_rows_kept_back(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame(pd.DataFrame({"a": rng.normal(size=600), "y": rng.normal(size=600)}))
    fit = boosting.fitted(df, ["a"], "y", rounds=40, leaves=31, step=0.5, least=5, patience=2)
    assert len(fit.losses[0]) < 40 and len(fit.trees[0]) == int(np.argmin(fit.losses[0])) + 1


def test_missing_values_weights_and_nothing(spark):
    rows = [(None if i % 3 == 0 else float(i % 2), 5.0 if i % 3 == 0 else float(i % 2), 1.0) for i in range(90)] + [(1.0, None, 1.0), (1.0, float("nan"), 1.0), (1.0, 1e6, 0.0)]
    df = spark.createDataFrame(rows, "a double, y double, w double")
    fit = boosting.fitted(df, ["a"], "y", rounds=1, leaves=3, step=1.0, least=5, patience=None, weight="w")
    got = {(r.a, round(r.prediction, 3)) for r in fit(df).collect()}
    assert got == {(None, 5.0), (0.0, 0.0), (1.0, 1.0)}
    empty = boosting.fitted(df.limit(0), ["a"], "y", weight="w")
    assert {r.prediction for r in empty(df).collect()} == {None} and empty(df.limit(0)).count() == 0


def test_held_out_error_is_no_worse_than_level_by_level(spark, sample):
    x, y = sample
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y, "fold": np.arange(len(y)) % 2}))
    # the other kind takes its first tree whole, so both run until the step no longer tells (0.8^25 < 0.004)
    error = lambda scored: scored.selectExpr("avg(abs(prediction - y)) AS e").first().e
    leafwise = error(boosting.out_of_fold(df, ["a", "b"], "y", 2, rounds=25, step=0.2, least=5, patience=None))
    level = error(model.out_of_fold(df, lambda t: model.boosted(t, ["a", "b"], "y", rounds=25, depth=6, step=0.2, subsample=1.0), 2))
    assert leafwise <= 1.05 * level


def test_boosted_deals_the_rows_of_one_file_out(spark, tmp_path, monkeypatch):
    """No task reads all rows, in whatever files they lie; the draws, and so the trees, are the same in a second run."""
    monkeypatch.setattr(model, "BOOSTED_ROWS", 500, raising=False)
    spark.range(6000).selectExpr("double(id % 97) AS a", "double(id % 11) AS b", "double(id % 97 + 3 * (id % 11)) AS y").coalesce(1).write.parquet(str(tmp_path / "rows"))
    rows, seen = spark.read.parquet(str(tmp_path / "rows")), []
    from pyspark.ml import Pipeline

    fit = Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, df: seen.append(df) or fit(self, df))
    first, second = (model.boosted(rows, ["a", "b"], "y", rounds=3).stages[-1].toDebugString.split("\n")[1:] for _ in range(2))
    sizes = [len(p) for p in seen[0].rdd.glom().collect()]
    assert sum(sizes) == 6000 and len(sizes) >= 12 and max(sizes) <= 600
    assert first == second
