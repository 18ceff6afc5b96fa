"""Operators that go over several tasks, against dense or brute-force versions."""

import math
import random

import duckdb
import numpy as np
import pytest

from stratalith.operators import gibbs, graph, neighbours, spectral, stats
from stratalith.plans import catalogue
from tests.compare import tables
from tests.test_operators import works_frame

SF = "/root/testdata/sf0.01"


# ---- second eigenvector ----
def dense_fiedler(pairs):
    names = sorted({x for p in pairs for x in p[:2]})
    at, w = {n: i for i, n in enumerate(names)}, np.zeros((len(names),) * 2)
    for a, b, x in pairs:
        if a != b:
            w[at[a], at[b]] += x
            w[at[b], at[a]] += x
    d = 1 / np.sqrt(w.sum(1))
    values, vectors = np.linalg.eigh(np.eye(len(names)) - d[:, None] * w * d)
    f = vectors[:, 1] * d
    assert values[2] - values[1] > 1e-5 and abs(values[1]) > 1e-9
    return dict(zip(names, f if f[0] <= 0 else -f, strict=True))


def test_fiedler_of_suppliers_is_numpy_s(spark):
    con = duckdb.connect()
    tables(con, SF)
    s = "(SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem)"
    pairs = con.sql(f"SELECT x.s, y.s, count(*) FROM {s} x JOIN {s} y ON x.o = y.o AND x.s < y.s GROUP BY 1, 2").fetchall()
    got = {r.node: r.fiedler for r in catalogue.QUERIES["fiedler_suppliers"](spark, SF).collect()}
    want = dense_fiedler(pairs)
    assert got.keys() == want.keys() and all(got[n] == pytest.approx(want[n], abs=2e-6) for n in want)


@pytest.mark.parametrize("name", ["path", "grid", "names", "two", "repeated"])
def test_fiedler_of_small_graphs(spark, name):
    r = random.Random(4)
    pairs = {
        "path": [(i, i + 1, 1.0 + i % 3) for i in range(20)],
        "grid": [(10 * i + j, 10 * i + j + s, 1.0) for i in range(4) for j in range(7) for s in ((1, 10) if i < 3 else (1,))],
        "names": [(f"n{a:02d}", f"n{b:02d}", r.random()) for a in range(25) for b in range(a + 1, 25) if r.random() < 0.3 or b == a + 1],
        "two": [(1, 2, 5.0), (2, 3, 1.0)],
        "repeated": [(1, 2, 5.0), (2, 1, 2.0), (2, 3, 1.0), (3, 3, 9.0), (3, 4, 2.0), (4, 5, 0.5), (5, 6, 3.0)],
    }[name]
    df = spark.createDataFrame([*pairs, (pairs[0][0], pairs[1][1], None), (pairs[0][0], pairs[1][1], -1.0)], f"a {'string' if name == 'names' else 'long'}, b {'string' if name == 'names' else 'long'}, affinity double")
    got, want = {x.node: x.fiedler for x in spectral.fiedler(df).collect()}, dense_fiedler(pairs)
    assert got.keys() == want.keys() and all(got[n] == pytest.approx(want[n], abs=1e-6) for n in want)


def test_fiedler_of_nothing_and_of_two_parts(spark):
    df = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (4, 5, 1.0)], "a long, b long, affinity double")
    assert spectral.fiedler(df.limit(0)).count() == 0
    got = {r.node: r.fiedler for r in spectral.fiedler(df).collect()}
    assert len({round(got[n], 6) for n in (1, 2, 3)}) == 1 and len({round(got[n], 6) for n in (4, 5)}) == 1 and got[1] * got[4] < 0


# ---- forest ----
@pytest.mark.parametrize("seed", range(3))
def test_forest_is_kruskal_s(spark, seed):
    r = random.Random(seed)
    pairs = {(min(a, b), max(a, b)): r.randrange(1, 4) for a, b in ((r.randrange(300), r.randrange(300)) for _ in range(500)) if a != b}
    pairs |= {(400 + i, 401 + i): i % 5 for i in range(60)}  # a long path
    part, want = {}, set()

    def top(x):
        while part.setdefault(x, x) != x:
            x = part[x]
        return x

    for (a, b), c in sorted(pairs.items(), key=lambda p: (-p[1], p[0])):
        if top(a) != top(b):
            part[top(a)] = top(b)
            want.add((a, b, c))
    df = spark.createDataFrame([(*(k if i % 2 else k[::-1]), c) for i, (k, c) in enumerate(pairs.items())] + [(7, 7, 99)], "a long, b long, cnt long")
    assert {tuple(x) for x in graph.spanning_forest(df).collect()} == want
    assert graph.spanning_forest(df.limit(0)).count() == 0


# ---- neighbours ----
def near_by_all_pairs(points, queries, k, metric, mode):
    out = set()
    for q, x, g in queries:
        found = []
        for i, y, h in points:
            if i == q or (mode and (g == h) != (mode == "same")):
                continue
            if metric == "delta":
                d = sum(abs(a - b) for a, b in zip(x, y, strict=True)) / len(x)
            elif metric == "cosine":
                n = math.hypot(*x) * math.hypot(*y)
                d = 1 - sum(a * b for a, b in zip(x, y, strict=True)) / n if n else 1.0
            else:
                d = math.dist(x, y)
            found.append((round(d, 6), i))
        out |= {(q, r + 1, i, d) for r, (d, i) in enumerate(sorted(found)[:k])}
    return out


@pytest.fixture(scope="module")
def points():
    r = random.Random(8)
    centres = [[r.uniform(-20, 20) for _ in range(4)] for _ in range(12)]
    out = [(i, [round(8 * (x + r.gauss(0, 1))) / 8 for x in centres[i % 12]], ["p", "q", None][i % 3]) for i in range(500)]
    out += [(500 + i, [3.0, 4.0, 0.0, 1.0], "p") for i in range(150)]  # a crowd at one point
    return [*out, (700, [0.0] * 4, "q"), (701, [0.0] * 4, "p")]


@pytest.mark.parametrize("metric, mode", [("euclidean", None), ("euclidean", "other"), ("cosine", None), ("cosine", "same"), ("delta", None)])
def test_nearest_is_brute_force(spark, points, metric, mode):
    df = spark.createDataFrame([*points, (800, None, "p")], "id long, v array<double>, grp string").repartition(4)
    queries = [p for p in points if p[0] % 10 == 0]
    got = neighbours.nearest(df.where("id % 10 = 0"), df, 5, metric, group="grp", mode=mode, pivots=16, shard=40, block=30).collect()
    want = near_by_all_pairs(points, queries, 5, metric, mode)
    assert {(r.query, r.rank, round(r.distance, 6)) for r in got} == {(q, r, d) for q, r, _, d in want}
    # Numbers of three binary digits: distances that are equal are equal in floats, but for cosines.
    assert len({(r.query, r.rank, r.id) for r in got} & {(q, r, i) for q, r, i, _ in want}) >= (0.97 if metric == "cosine" else 1) * len(want)


def test_nearest_compares_fewer_than_all_pairs(spark, points):
    compared = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame(points, "id long, v array<double>, grp string")
    neighbours.nearest(df.where("id % 10 = 0"), df, 5, pivots=16, shard=100, compared=compared).collect()
    assert 0 < compared.value < 0.5 * len(points) * len([p for p in points if p[0] % 10 == 0])


def test_nearest_of_nothing(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], "a")], "id long, v array<double>, grp string")
    assert neighbours.nearest(df, df.limit(0), 3).count() == 0 and neighbours.nearest(df.limit(0), df, 3).count() == 0 and neighbours.nearest(df, df, 3).count() == 0


# ---- quantiles ----
@pytest.mark.parametrize("bins, most", [(4, 3), (16, 50), (1024, 10_000)])
def test_quantiles_of_a_single_group(spark, bins, most):
    r = random.Random(6)
    values = [r.choice([0.0, -1.5, 7.25]) if r.random() < 0.3 else r.gauss(0, 1) * 10 ** r.uniform(-3, 3) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    at = (0.0, 0.025, 0.25, 0.5, 0.77, 1.0)
    (got,) = stats.quantiles(df, [], "v", at, bins, most).collect()
    assert (got.n, got.min, got.max) == (2000, min(values), max(values)) and got.q == pytest.approx(np.quantile(values, at).tolist(), rel=1e-12)


def test_quantiles_by_group_with_odd_values(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("a", float(i)) for i in range(100)] + [("b", 5.0)] * 60 + [(None, x) for x in (-inf, 1.0, 2.0, 1e308, -1e308, inf, nan)] + [("c", None), ("d", 1.0), ("d", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    for most in (2, 1000):
        got = {r.g: r for r in stats.quantiles(df, ["g"], "v", (0.5, 0.9), 8, most).collect()}
        assert set(got) == {"a", "b", None, "d"}
        assert got["a"].q == pytest.approx([49.5, 89.1]) and got["b"].q == [5.0, 5.0] and got["d"].q == pytest.approx([1.5, 1.9])
        assert got[None].q[0] == 2.0 and got[None].n == 7
    five = {r.g: r for r in stats.five_numbers(df, ["g"], "v").collect()}
    assert five["c"].n == 0 and five["c"].p500 is None and five["a"].p250 == 24.75
    assert stats.five_numbers(df.where("g = 'a'"), [], "v").first().p500 == 49.5
    assert stats.quantiles(df.limit(0), ["g"], "v", (0.5,)).count() == 0


# ---- sampler ----
def test_colours_part_neighbours(spark):
    r = random.Random(3)
    edges = {(f"w{r.randrange(60)}", f"w{r.randrange(60)}") for _ in range(150)} | {("hub", f"w{i}") for i in range(60)} | {("x", "x")}
    got = {c.node: c.colour for c in gibbs.coloured(spark.createDataFrame(sorted(edges), "src string, dst string")).collect()}
    assert set(got) == {x for e in edges for x in e if e[0] != e[1]} and all(got[a] != got[b] for a, b in edges if a != b)
    assert max(got.values()) < 15


def test_draws_have_the_moments_of_the_chain(spark):
    """Two orders, a terminus on either side and an anchor: many short chains against a long one in one process."""
    nan = np.nan
    rows = [(450, nan, nan, 3, nan, nan), (400, nan, nan, 3, nan, nan), (300, nan, nan, 3, 350, nan), (900, nan, nan, 3, nan, 200), (300, 100, 200, 4, nan, nan)]
    fixed = (420.0, 80.0**2, 120.0**2)
    want = gibbs.chain(works_frame(rows), np.array([[0, 1], [2, 1]]), 30_000, 1000, 1, 5, fixed=fixed)
    none = lambda x: None if x != x else float(x)
    works = spark.createDataFrame([(i, *map(none, x)) for i, x in enumerate(rows)], "work long, m double, lo double, hi double, n_chunks double, not_before double, not_after double")
    edges = spark.createDataFrame([(0, 1), (2, 1), (0, 99)], "src long, dst long")
    drawn = gibbs.draws(works, edges, chains=1200, iterations=11, burn=7, thin=1, fixed=fixed).toPandas()
    t = drawn.pivot(index=["chain", "sweep"], columns="work", values="t")[[str(i) for i in range(5)]].to_numpy()
    assert len(t) == 1200 * 4 and (t[:, 0] <= t[:, 1]).all() and (t[:, 2] <= t[:, 1]).all() and (t[:, 2] >= 350).all() and (t[:, 3] <= 200).all()
    assert t.mean(0) == pytest.approx(want.mean(0), abs=5) and t.std(0) == pytest.approx(want.std(0), rel=0.08)


def test_draws_move_mu_var_and_noise_as_the_chain_does(spark):
    """The same few sweeps from the same start, many chains of either kind: they need not have settled to be alike."""
    r = np.random.default_rng(2)
    rows = [(float(x), np.nan, np.nan, 2, np.nan, np.nan) for x in r.normal(500, 120, 40)]
    w = works_frame(rows)
    want = np.stack([gibbs.chain(w, np.zeros((0, 2), int), 8, 7, 1, 100 + k)[0] for k in range(600)])
    works = spark.createDataFrame([(i, x[0], None, None, 2.0, None, None) for i, x in enumerate(rows)], "work long, m double, lo double, hi double, n_chunks double, not_before double, not_after double")
    empty = spark.createDataFrame([], "src string, dst string")
    drawn = gibbs.draws(works, empty, chains=600, iterations=8, burn=7, thin=1).toPandas()
    got = drawn.pivot(index="chain", columns="work", values="t")[[str(i) for i in range(40)]].to_numpy()
    off = (got.mean(0) - want.mean(0)) / np.sqrt(got.var(0) / 600 + want.var(0) / 600)
    assert got.shape == (600, 40) and np.abs(off).max() < 4.5 and (got.std(0) / want.std(0)).mean() == pytest.approx(1, abs=0.03)
    # What mu, var and noise have been shows in the mean and the spread of each chain's dates.
    for f in (lambda t: t.mean(1), lambda t: t.std(1)):
        a, b = f(got), f(want)
        assert abs(a.mean() - b.mean()) < 4.5 * np.sqrt(a.var() / 600 + b.var() / 600) and a.std() == pytest.approx(b.std(), rel=0.12)
    assert gibbs.draws(works.limit(0), empty, chains=2, iterations=2, burn=0).count() == 0


def test_draws_are_the_same_again(spark):
    works = spark.createDataFrame([(w, 100.0 * i, None, None, 4.0, None, None) for i, w in enumerate("abcd")], "work string, m double, lo double, hi double, n_chunks double, not_before double, not_after double")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")  # a cycle: the middle branch, and an end
    one, two = (sorted(map(tuple, gibbs.draws(w, edges, chains=3, iterations=4, burn=1, thin=2, colours_a_plan=k).collect())) for k, w in ((1, works), (2, works.repartition(3))))
    assert [x[:3] for x in one] == [x[:3] for x in two] and [x[3] for x in one] == pytest.approx([x[3] for x in two]) and len(one) == 3 * 2 * 4
    assert all(math.isfinite(x[3]) for x in one)
