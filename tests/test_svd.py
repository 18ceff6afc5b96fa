"""Truncated SVD against numpy's."""

import numpy as np
import pytest

from stratalith.operators import model


def cells(x):
    return [(int(i), f"t{j}", float(x[i, j])) for i, j in np.argwhere(x)]


def compare(spark, x, k, tolerance, **how):
    got = {r.doc: np.array(r.v) for r in model.truncated_svd(spark.createDataFrame(cells(x), "doc long, term string, w double"), k, **how).collect()}
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    k = min(k, int((s > 1e-10 * s[0]).sum()))
    want = (u * s)[:, :k]
    assert set(got) == {int(i) for i in np.unique(np.argwhere(x)[:, 0])} and all(len(v) == k for v in got.values())
    mine = np.stack([got.get(i, np.zeros(k)) for i in range(len(x))])
    assert np.abs(mine) == pytest.approx(np.abs(want), abs=tolerance)
    assert mine @ mine.T == pytest.approx(want @ want.T, abs=10 * tolerance)


def test_directions_that_stand_out_are_numpy_s(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 6)) * [9, 7, 5, 4, 3, 2] @ rng.normal(size=(6, 70)) + rng.normal(size=(150, 70)) / 50
    x[rng.random(x.shape) < 0.02] = 0
    u, s, _ = np.linalg.svd(x)
    compare(spark, x, 3, 1e-4 * s[0], extra=8, powers=2)


def test_a_matrix_of_low_rank_is_exact(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (40, 3)) @ rng.integers(-3, 4, (3, 12)) * 1.0
    compare(spark, x, 8, 1e-8, extra=2, powers=1)


def test_gaps_repeats_and_nothing(spark):
    kind = "doc string, term string, w double"
    rows = [("a", "x", 1.0), ("a", "x", 2.0), ("b", "y", 4.0), (None, "x", 1.0), ("a", None, 1.0), ("c", "x", None)]
    got = {r.doc: sorted(abs(v) for v in r.v) for r in model.truncated_svd(spark.createDataFrame(rows, kind), 5, extra=2).collect()}
    assert got == {"a": pytest.approx([0, 3], abs=1e-9), "b": pytest.approx([0, 4], abs=1e-9)}
    assert model.truncated_svd(spark.createDataFrame([], kind), 2).count() == 0
    assert [r.v for r in model.truncated_svd(spark.createDataFrame([("a", "x", 0.0)], kind), 2).collect()] == [[]]
