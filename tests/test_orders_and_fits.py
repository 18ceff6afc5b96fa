"""Order cycles, exact p and the perceptron against plain versions."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratalith.operators import constraints, model, stats


def reach(edges):
    """Pairs (a, b) where a way leads from a to b."""
    got = set(edges)
    while True:
        more = got | {(a, d) for a, b in got for c, d in edges if b == c}
        if more == got:
            return got
        got = more


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles_are_mutual_reach(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(30), r.randrange(30)) for _ in range(30 + 6 * seed)] + [(40, 41), (41, 42), (42, 40), (42, 50), (50, 51), (51, 50), (7, 7)]
    way = reach({(a, b) for a, b in edges if a != b})
    want = {a: min(b for x, b in way if x == a and (b, a) in way) for a, b in way if (a, a) in way}
    df = spark.createDataFrame([*edges, *edges[:3], (None, 1), (1, None)], "src int, dst int")
    got = constraints.order_cycles(df).collect()
    assert len(got) == len(want) and {r.node: r.cycle for r in got} == want


def test_no_edges_no_cycles(spark):
    empty = spark.createDataFrame([], "src string, dst string")
    assert constraints.order_cycles(empty).count() == 0
    assert constraints.order_cycles(spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "a")], "src string, dst string")).count() == 0


def test_conflicts_name_a_cycle_of_three(spark):
    works = spark.createDataFrame([(w, None, None, None, None) for w in "abcd"], "work string, lo double, hi double, not_before double, not_after double")
    edges = spark.createDataFrame([("b", "c"), ("c", "a"), ("a", "b"), ("c", "d")], "src string, dst string")
    got = {tuple(r) for r in constraints.conflicts(works, edges).collect()}
    assert got == {(w, "a", "order cycle") for w in "abc"}


def test_exact_p_is_enumeration(spark):
    r = random.Random(4)
    rows, want = [], {}
    for g in range(6):
        n1, n2 = r.randrange(1, 5), r.randrange(1, 7)
        v = r.sample(range(1000), n1 + n2)
        rows += [(g, float(x), i < n1) for i, x in enumerate(v)]
        u_of = lambda side: sum(a > b for a in side for b in set(v) - set(side))  # noqa: E731, B023
        all_u = [u_of(s) for s in itertools.combinations(v, n1)]
        u = u_of(v[:n1])
        want[g] = min(1.0, 2 * min(sum(x >= u for x in all_u), sum(x <= u for x in all_u)) / len(all_u))
    rows += [(6, 1.0, True), (6, 1.0, False), (6, 2.0, True), (7, 3.0, True), (8, 5.0, True), (8, 5.0, False), (9, None, True)] + [(10, float(i), i % 2 == 0) for i in range(18)]
    got = {x.g: x for x in stats.mann_whitney(spark.createDataFrame(rows, "g int, v double, s boolean"), ["g"], "v", F.col("s")).collect()}
    assert {g: got[g].p for g in want} == pytest.approx(want) and all(got[g].exact for g in want)
    assert got[6].p == pytest.approx(math.erfc(abs(got[6].z) / math.sqrt(2))) and not got[6].exact  # ties
    assert got[7].p is None and got[8].p is None and 9 not in got
    assert not got[10].exact and 0.5 < got[10].p < 1


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(1)
    shapes = [(3, 4), (4,), (4, 1), (1,)]
    p, x, y = rng.normal(size=21), rng.normal(size=(20, 3)), rng.normal(size=20)
    loss = lambda p: ((model._forward(p, shapes, x)[-1][:, 0] - y) ** 2).sum() / 2
    acts = model._forward(p, shapes, x)
    got = model._gradient(p, shapes, acts, acts[-1] - y[:, None])
    slope = [(loss(p + 1e-6 * e) - loss(p - 1e-6 * e)) / 2e-6 for e in np.eye(21)]
    assert got == pytest.approx(slope, abs=1e-5)


def test_perceptron_learns_a_curve_from_all_rows_and_takes_gaps(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-2, 2, 1500)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": np.abs(x) * 100}))
    odd = spark.createDataFrame([(None, 1.0), (1.0, None), (float("nan"), 2.0)], "x double, y double")
    fit = model.perceptron(df.union(odd), ["x"], "y", hidden=(16,), epochs=60, alpha=0.01)  # of 8 units too few may start on one side of the bend
    assert fit(df).selectExpr("avg(abs(prediction - y)) AS e").first().e < 8  # a line is off by 50
    assert [r.prediction is None for r in fit(odd).collect()] == [True, False, True]
    nothing = model.perceptron(odd.where("x > 5"), ["x"], "y", hidden=(2,))
    assert {r.prediction for r in nothing(odd).collect()} == {None}


def test_sums_of_many_tasks_are_added_in_groups(spark):
    df = spark.range(0, 200, 1, 100).groupBy("id").count().repartition(100).select(F.array(F.col("id").cast("double"), F.lit(1.0)).alias("s"))
    assert model._added(df).tolist() == [19900.0, 200.0]
