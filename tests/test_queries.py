"""Every query that has SQL says what the SQL says; the others are compared with a brute-force version."""

import duckdb
import numpy as np
import pytest

from stratalith.plans import catalogue
from tests.compare import rows, tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    tables(con, SF)
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, con, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), con.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


#: Queries without SQL, each with a test of its own here or in test_operators.
ELSEWHERE = {"spanning_forest", "grouped_folds", "gbt_cv", "histogram_gbt_cv", "held_out_cluster", "ridge_fit", "mlp_fit", "feature_ablation", "feature_importance", "pca_scores", "svd_lengths", "fiedler_order", "fiedler_suppliers", "gibbs_posterior"}


def test_every_query_has_sql_or_a_test():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == ELSEWHERE


def test_spanning_forest_is_kruskal_s(spark, con):
    s = "(SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem)"
    pairs = con.sql(f"SELECT x.s, y.s, count(*) FROM {s} x JOIN {s} y ON x.o = y.o AND x.s < y.s GROUP BY 1, 2").fetchall()
    part, want = {i: i for p in pairs for i in p[:2]}, set()
    for a, b, n in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if part[a] != part[b]:
            want.add((a, b, n))
            part = {i: part[b] if c == part[a] else c for i, c in part.items()}
    assert {tuple(r) for r in catalogue.QUERIES["spanning_forest"](spark, SF).collect()} == want


def test_grouped_folds_deal_the_largest_first(spark, con):
    load, fold = [0] * 5, {}
    for g, n in con.sql("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, 1").fetchall():
        fold[g] = load.index(min(load))
        load[fold[g]] += n
    got = catalogue.QUERIES["grouped_folds"](spark, SF).collect()
    assert len(got) == con.sql("SELECT count(*) FROM customer").fetchall()[0][0] and all(r.fold == fold[r.c_nationkey] for r in got)


@pytest.fixture(scope="module")
def chunks(spark):
    """x1, x2, y of the regression queries; x1 is nearly y / 100."""
    from stratalith.plans.model_queries import _chunk_rows

    return _chunk_rows(spark, SF).select("c_custkey", "x1", "x2", "y").toPandas()


@pytest.mark.parametrize("name", ["gbt_cv", "histogram_gbt_cv", "ridge_fit", "mlp_fit"])
def test_regressions_beat_the_mean_by_far(spark, chunks, name):
    plain = (chunks["y"] - chunks["y"].mean()).abs().mean()
    (got,) = catalogue.QUERIES[name](spark, SF).collect()
    assert got.n == len(chunks) and 0 < got.mae < 0.6 * plain
    if name == "ridge_fit":
        x = np.column_stack([np.ones(len(chunks)), chunks["x1"], chunks["x2"]])
        least = np.abs(x @ np.linalg.lstsq(x, chunks["y"], rcond=None)[0] - chunks["y"]).mean()
        assert got.mae == pytest.approx(least, rel=0.1)


def test_held_out_cluster_tells_the_order_of_its_strata(spark, con):
    """Against least squares over the same rows outside the cluster, medians by customer and ranks in pandas."""
    o = con.sql("SELECT o_custkey AS c, c_mktsegment = 'BUILDING' AS held, count(*) AS n, sum(l_quantity) AS q, avg(l_discount) AS d, sum(l_extendedprice) AS y FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, o_orderkey").df()
    x = np.column_stack([np.ones(len(o)), o["n"], o["q"], o["d"]])
    fit = np.linalg.lstsq(x[~o["held"]], o["y"][~o["held"]], rcond=None)[0]
    works = o.assign(p=x @ fit)[o["held"]].groupby("c").agg(n=("n", "mean"), p=("p", "median"))
    want = np.corrcoef(works["n"].round().rank(), works["p"].rank())[0, 1]
    (got,) = catalogue.QUERIES["held_out_cluster"](spark, SF).collect()
    assert got.n == len(works) and want > 0.5 and abs(got.rho - want) < 0.2


def test_features_that_say_more_count_for_more(spark, chunks):
    got = {r.feature: r.importance for r in catalogue.QUERIES["feature_importance"](spark, SF).collect()}
    assert got["x1"] > 0.6 and sum(got.values()) == pytest.approx(1, abs=1e-3)
    mae = {r.features: r.mae for r in catalogue.QUERIES["feature_ablation"](spark, SF).collect()}
    assert set(mae) == {"first", "second", "all"} and mae["first"] < mae["second"]


def test_principal_components_are_numpy_s(spark, chunks):
    x = chunks[["x1", "x2", "y"]].to_numpy()
    z = (x - x.mean(0)) / (x.std(0) + 1e-9)
    _, _, v = np.linalg.svd(z - z.mean(0), full_matrices=False)
    want = dict(zip(chunks["c_custkey"], np.abs(z @ v[:2].T), strict=True))
    got = catalogue.QUERIES["pca_scores"](spark, SF).collect()
    assert len(got) == len(chunks) and all([r.pc1, r.pc2] == pytest.approx(want[r.c_custkey], abs=1e-4) for r in got)


def test_svd_lengths_are_numpy_s(spark, con):
    counts = con.sql("SELECT o_custkey AS doc, o_orderpriority AS term, count(*) AS n FROM orders GROUP BY 1, 2").df().pivot(index="doc", columns="term", values="n").fillna(0)
    tf = counts.div(counts.sum(1), axis=0) * np.log((len(counts) + 1) / ((counts > 0).sum() + 1))
    x = tf.to_numpy() / np.maximum(np.linalg.norm(tf, axis=1), 1e-300)[:, None]
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    want = dict(zip(counts.index, np.linalg.norm(u[:, :3] * s[:3], axis=1), strict=True))
    got = catalogue.QUERIES["svd_lengths"](spark, SF).collect()
    assert len(got) == len(want) and all(r.length == pytest.approx(want[r.doc], abs=1e-5) for r in got)


def test_fiedler_order_is_numpy_s(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("embedding", "label").toPandas()
    mean = {str(k): np.stack(g["embedding"].tolist()).astype(float).mean(0) for k, g in rows.groupby("label")}
    names = sorted(mean)
    v = np.stack([mean[n] / np.linalg.norm(mean[n]) for n in names])
    d = 1 - v @ v.T
    near = [set(np.argsort(np.where(np.arange(len(names)) == i, np.inf, d[i]), kind="stable")[: min(10, len(names) - 1)]) for i in range(len(names))]
    pairs = {(min(i, j), max(i, j)): (j in near[i]) + (i in near[j]) for i in range(len(names)) for j in near[i]}
    dist = {p: d[p] * n / 2 for p, n in pairs.items()}
    w, middle = np.zeros(d.shape), np.mean(list(dist.values()))
    for (i, j), x in dist.items():
        w[i, j] = w[j, i] = np.exp(-x / middle)
    deg = 1 / np.sqrt(w.sum(1))
    values, vectors = np.linalg.eigh(np.eye(len(names)) - deg[:, None] * w * deg)
    want = vectors[:, 1] * deg
    got = {r.node: r.fiedler for r in catalogue.QUERIES["fiedler_order"](spark, SF).collect()}
    assert values[2] - values[1] > 1e-6 and [got[n] for n in names] == pytest.approx(list(want if want[0] <= 0 else -want), abs=2e-5)


def test_sampled_dates_keep_their_bounds_and_orders(spark):
    got = {r.work: r for r in catalogue.QUERIES["gibbs_posterior"](spark, SF).collect()}
    assert got and all(r.lo95 <= r.median <= r.hi95 for r in got.values())
    assert all(r.median >= 100 for w, r in got.items() if int(w) % 7 == 0 and int(w) % 6 != 1) and all(r.median <= 600 for w, r in got.items() if int(w) % 11 == 0 and int(w) % 6)
    assert all(got[w].median <= got[str(int(w) + 1)].median + 1e-6 for w in got if int(w) % 6 == 0 and str(int(w) + 1) in got)


def test_entry_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
