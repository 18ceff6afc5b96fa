"""Operators whose cost grew faster than their input: results in several blocks, and plans."""

import random

import pytest
from pyspark.sql import functions as F

from stratalith.operators import boosting, constraints, features, graph, resolve, spectral, stats
from stratalith.plans import graph_queries
from stratalith.sources import readers
from tests.test_scaled import dense_fiedler


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fiedler_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(spectral, "_NODES", 8)
    monkeypatch.setattr(spectral, "_EDGES", 16)
    monkeypatch.setattr(spectral, "_OPEN", 2)
    monkeypatch.setattr(spectral.math, "isqrt", lambda n: 1000)
    r = random.Random(5)
    pairs = [(a, b, 1.0 + r.random()) for a in range(40) for b in range(a + 1, 40) if b == a + 1 or r.random() < 0.15]
    got = {x.node: x.fiedler for x in spectral.fiedler(spark.createDataFrame(pairs, "a long, b long, affinity double")).collect()}
    want = dense_fiedler(pairs)
    assert got.keys() == want.keys() and all(got[n] == pytest.approx(want[n], abs=1e-6) for n in want)


def test_fiedler_lays_edges_once_and_writes_once_a_round(spark, monkeypatch):
    made, turns, write, best = [], [], spectral.staged, spectral._best
    monkeypatch.setattr(spectral, "staged", lambda df: made.append(write(df)) or made[-1])
    monkeypatch.setattr(spectral, "_best", lambda *a: turns.append(a) or best(*a))
    pairs = [(a, b, 1.0) for a in range(12) for b in range(a + 1, 12) if (a + b) % 3 and a // 6 == b // 6] + [(2, 3, 1.0), (3, 2, 1.0)]  # of two parts
    got = {x.node: x.fiedler for x in spectral.fiedler(spark.createDataFrame(pairs, "a long, b long, affinity double")).collect()}
    assert got.keys() == set(range(12)) and {len({round(got[n], 6) for n in part}) for part in (range(6), range(6, 12))} == {1} and got[0] * got[6] < 0
    assert sum("r" in df.columns for df in made) == len(turns) + 1  # residuals were written apart in each round
    laid = [df for df in made if {"i", "j"} <= set(df.columns)]
    assert sum(len(x.i) // 4 for df in laid for x in df.collect()) == len({(min(a, b), max(a, b)) for a, b, _ in pairs})  # edges lay in both directions


def test_level_pairs_of_one_base_are_not_grouped(spark):
    r = random.Random(3)
    works = [(w, f"a base {r.randrange(6)}", r.choice([None, 0, 1, 2, 3])) for w in [*range(80), *range(30), *range(10)]] + [(200 + i, "of one level", 2) for i in range(5)] + [(None, "a base 1", 1), (3, "short", 1), (4, "short", 2)]
    want = {}
    for a, base, l1 in works:
        for b, other, l2 in works:
            if base == other and len(base) >= 6 and (l1 or 0) < (l2 or 0) and None not in (a, b) and a != b:
                want[a, b] = min(base, want.get((a, b), base))
    df = spark.createDataFrame(works, "work long, base string, level int")
    for block in (3, 8192):
        out = constraints.level_pairs(df, block=block)
        got = [tuple(x) for x in out.collect()]
        assert sorted(got) == sorted((*k, v) for k, v in want.items())
    assert plan(out).startswith("Union")  # pairs were grouped, so shuffled and spilled


def test_files_of_level_pairs_stay_small(spark, tmp_path):
    works = spark.range(4000).select(F.col("id").alias("work"), F.concat(F.lit("a base "), F.col("id") % 4).alias("base"), (F.xxhash64("id") % 5).alias("level"))
    constraints.level_pairs(works).write.parquet(f"{tmp_path}/pairs")
    n, size = spark.read.parquet(f"{tmp_path}/pairs").count(), sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet"))
    assert n > 1_000_000 and size < 0.5 * n  # more than a byte a pair, as later works came in another order for each level


@pytest.mark.parametrize("most", [40, 1 << 26])
def test_disjoint_sends_queries_where_they_match(spark, most):
    r = random.Random(6)
    ends = lambda: (r.choice([None, *range(20)]), r.choice([None, *range(15, 40)]))
    rows, queries = [(k, *ends()) for k in range(150)] + [(900, 30, 5)], [(k, *ends()) for k in range(0, 40, 2)] + [(901, 35, 4)]
    want = sorted((x, y) for x, xl, xh in queries for y, yl, yh in rows if x != y and ((None not in (xh, yl) and xh < yl) or (None not in (yh, xl) and yh < xl)))
    out = resolve.disjoint(spark.createDataFrame(queries, "x long, xl long, xh long"), spark.createDataFrame(rows, "y long, yl long, yh long"), most=most)
    assert sorted((x.x, x.y) for x in out.collect()) == want
    assert "__i" not in plan(out)  # every block of queries met every block of rows


def test_scored_pairs_join_once_an_end(spark):
    assert plan(graph_queries._scored(spark, "/root/testdata/sf0.001")).count("Join Inner") == 2  # breadth and supplier joined apart


def test_order_cycles_broadcast_nothing(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 7), (7, 6)], "src long, dst long")
    out = constraints.order_cycles(edges)
    assert sorted(tuple(x) for x in out.select("node", "cycle").collect()) == [(1, 1), (2, 1), (3, 1), (6, 6), (7, 6)]
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_tf_idf_joins_terms_alone(spark):
    counts = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("b", "x", 1), (None, "x", 1)], "doc string, term string, cnt long")
    out = features.tf_idf(counts, features.document_frequency(counts))
    assert {(r.doc, r.term) for r in out.collect()} == {("a", "x"), ("a", "y"), ("b", "x")}
    assert plan(out).count("Join Inner") + plan(out).count("Join Cross") <= 2  # sums by document were joined too


def test_matched_segments_read_files_once(spark):
    rows = [("f", ["a:1", "a:2"], ["b:7"], ["s", "t", "u"], []), ("f", None, ["c:3"], ["s"], ["v", "w"])]
    m = spark.createDataFrame(rows, "file string, root_segnr array<string>, par_segnr array<string>, root_segtext array<string>, par_segtext array<string>")
    out = readers.matched_segments(m)
    assert sorted(tuple(x) for x in out.collect()) == [("a", 1, "s", "f", 0, 0), ("a", 2, "t", "f", 0, 1), ("c", 3, "v", "f", 1, 0)]
    assert "Union" not in plan(out)


@pytest.mark.parametrize("loo", [False, True])
def test_small_groups_are_solved_alike_in_tasks(spark, monkeypatch, loo):
    r = random.Random(4)
    pairs = [(g, a, b, r.randrange(5)) for g in (1, 2, None) for a in range(10) for b in range(a, 10) if r.random() < 0.25] + [(4, 1, 2, 3)]
    labels = [(g, n, r.choice([None, r.random() * 100])) for g in (1, 2, None) for n in range(12)] + [(4, 1, 7.0), (4, 3, None), (5, 1, None)]
    p, c = spark.createDataFrame(pairs, "grp long, a long, b long, cnt long"), spark.createDataFrame(labels, "grp long, node long, y double")

    def rows(**how):
        return sorted(str((x.grp, x.node, x.x if x.x is None else round(x.x, 4), x.labelled)) for x in graph.harmonic_by_group(p, c, leave_one_out=loo, **how).collect())

    want = rows(most=0)  # by joins
    assert loo or want == rows(most=4)  # groups of both kinds
    monkeypatch.setattr(graph, "harmonic", None)  # every group went through its joins and rounds
    assert rows() == want


def test_robust_z_leaves_rows_where_they_are(spark):
    rows = spark.createDataFrame([("a", float(x * x)) for x in range(30)] + [("b", 1.0), ("b", None), (None, 2.0)], "g string, x double")
    out = stats.robust_z(rows, ["g"], "x")
    assert sum(r.g == "a" for r in out.collect()) == 30
    run = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in run and "hashpartitioning" not in run  # a group's rows were sorted in one task


def test_boosting_deals_out_a_table_of_one_file(spark, monkeypatch):
    made, write = [], boosting.staged
    monkeypatch.setattr(boosting, "staged", lambda df: made.append((df.rdd.getNumPartitions(), df.schema)) or write(df))
    rows = spark.range(0, 300, 1, 1).select((F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), (F.col("id") % 2).cast("int").alias("fold"))
    rows = rows.withColumn("y", F.col("a") * 2 + F.col("b"))
    one, two = (boosting.fitted(rows, ["a", "b"], "y", rounds=2, leaves=3, fold="fold", k=2, every=e) for e in (1, 9))
    assert one.trees == two.trees and all(len(t) == 2 for t in one.trees)  # whichever way scores are kept
    assert made[0][0] >= spark.sparkContext.defaultParallelism  # one task did every pass
    assert not any(f.dataType.typeName() == "array" for _, s in made for f in s)  # rows were objects
