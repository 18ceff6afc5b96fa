"""Hand-made cases, and operators against plain loops."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratalith.functions import text as T
from stratalith.functions import years as Y
from stratalith.operators import constraints, features, gibbs, graph, model, resolve, sequence, serve, stats
from stratalith.sources import readers, writers


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("r")).first().r


def test_ids_and_numbers(spark):
    rows = spark.createDataFrame([("a",), ("a:b:12",), ("a:x",)], "s string").select(T.text_id(F.col("s")), T.line_no(F.col("s"))).collect()
    assert [tuple(r) for r in rows] == [("a", None), ("a:b", 12), ("a", None)]
    rows = spark.createDataFrame([("1,200",), ("",), ("c. 300",), (None,)], "s string").select(T.number(F.col("s"))).collect()
    assert [r[0] for r in rows] == [1200.0, None, None, None]


def test_intervals(spark):
    df = spark.createDataFrame([(499.0, 300.0), (100.0, None)], "nb double, na double")
    got = df.select(Y.interval(F.col("nb"), F.col("na")).alias("i"), Y.midpoint(F.col("nb"), F.col("na")).alias("m")).collect()
    assert (got[0].i.lo, got[0].i.hi, got[0].m) == (300.0, 499.0, 399.5) and got[1].i is None and got[1].m is None
    assert one(spark, Y.era(F.col("x")), x=-120.5) == "120 BCE" and one(spark, Y.era(F.col("x")), x=33.2) == "33 CE"


def test_words(spark):
    df = spark.createDataFrame([("Dharma, (rāja) a-b x1 '.| 's ॥",), (None,)], "s string")
    got = [r[0] for r in df.select(T.words(F.col("s"))).collect()]
    assert got == [["dharma", "rāja", "'s"], []]
    assert one(spark, T.plain_words(F.col("s")), s="-A' b-c .") == ["a", "b-c"]


def test_folding_and_commentary(spark):
    df = spark.createDataFrame([("Bhāṣya on Sūtra",), (None,)], "s string").select(T.folded(F.col("s")).alias("f"))
    assert [r.f for r in df.collect()] == ["bhasya on sutra", None]
    got = df.select(T.commentary(F.col("f")).alias("c")).collect()
    assert (got[0].c.level, got[0].c.base) == (1, "onsutra") and got[1].c.level is None
    assert one(spark, T.display_title(F.lit("w1"), F.col("t")), t="unknown: Some text") == "Some text (w1)"


def test_longest_prefix(spark):
    r = random.Random(3)
    keys = sorted({"".join(r.choice("ab") for _ in range(r.randrange(1, 5))) for _ in range(12)})
    ids = ["".join(r.choice("abc") for _ in range(r.randrange(0, 8))) for _ in range(80)] + [None]
    got = resolve.longest_prefix(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame([(k,) for k in keys], "k string"), "id", "k").collect()
    assert len(got) == len(ids)
    for row in got:
        want = max((k for k in keys if row.id is not None and row.id.startswith(k)), key=len, default=None)
        assert row.key == want


def test_first_listed_prefix(spark):
    got = resolve.first_listed_prefix(spark.createDataFrame([("chupsb1",), ("x",)], "id string"), ["chup", "chupsb"], "id").collect()
    assert [r.group for r in got] == ["chup", "x"]


def test_consecutive_distinct_is_the_loop(spark):
    r = random.Random(1)
    seqs = {k: [r.choice(["A", "B", "", "C"]) for _ in range(30)] for k in range(5)}
    df = spark.createDataFrame([(k, i, v) for k, s in seqs.items() for i, v in enumerate(s)], "k int, i int, v string")
    got = {(x.k, x.i) for x in sequence.consecutive_distinct(df, ["k"], ["i"], "v").collect()}
    want = set()
    for k, s in seqs.items():
        before = None
        for i, v in enumerate(s):
            if v and v == before:
                continue
            before = v
            want.add((k, i))
    assert got == want


def test_runs_close_at_the_end(spark):
    df = spark.createDataFrame([(1, 0, True), (1, 1, True), (2, 0, False), (2, 1, True)], "s int, i int, f boolean")
    got = sequence.run_summary(sequence.runs(df, ["s"], ["i"], F.col("f")), ["s"]).collect()
    assert {(r.s, r.mean_length) for r in got} == {(1, 3.0), (2, 2.0)}


def test_chunks_are_dense_after_the_drop(spark):
    df = spark.createDataFrame([("t", i, 10 if i < 100 or i >= 200 else 1) for i in range(301)], "t string, i int, n int")
    got = sequence.chunk_rows(sequence.chunks(df, ["t"], ["i"], 100, F.col("n"), 200), ["t"], "i").orderBy("chunk").collect()
    assert [(r.chunk, r.first, r.last, r.middle) for r in got] == [(0, 0, 99, 50), (1, 200, 299, 250)]


def test_as_of(spark):
    rows = spark.createDataFrame([("d", 9, "x"), ("d", 10, "y"), ("e", 1, "z")], "d string, i int, what string")
    marks = spark.createDataFrame([("d", 0, "one"), ("d", 10, "two")], "d string, s int, label string")
    got = {r.what: r.label for r in sequence.as_of(rows, marks, ["d"], "i", "s", "label", "(start)").collect()}
    assert got == {"x": "one", "y": "two", "z": "(start)"}


def test_spearman_with_ties(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 3)], "x int, y int")
    assert stats.spearman(df, [], "x", "y").first().rho == pytest.approx(0.8333, abs=1e-4)


def test_quantiles(spark):
    got = stats.five_numbers(spark.createDataFrame([(1, v) for v in (1.0, 2.0, 3.0, 4.0)], "g int, v double"), ["g"], "v").first()
    assert (got.p250, got.p500) == (1.75, 2.5)


def test_mann_whitney_by_hand(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, True), (2.0, False), (5.0, False)], "v double, s boolean")
    got = stats.mann_whitney(df, [], "v", F.col("s")).first()
    assert got.u == 0.5 and got.z < 0


def test_edges_keep_nodes_of_self_pairs(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b")], "r string, p string")
    assert graph.edges(df, "r", "p", {}).count() == 1
    assert {(r.node, r.cnt) for r in graph.node_counts(df, "r", "p").collect()} == {("a", 3), ("b", 1)}


def _path(spark):
    return spark.createDataFrame([("a", "b", 1), ("b", "c", 1)], "a string, b string, cnt int"), spark.createDataFrame([("a", 0.0), ("c", 100.0)], "node string, y double")


def test_harmonic_path(spark):
    pairs, labels = _path(spark)
    assert {r.node: r.x for r in graph.harmonic(pairs, labels, lam=1e-9).collect()}["b"] == pytest.approx(50, abs=1e-3)
    grouped = graph.harmonic_by_group(pairs.withColumn("grp", F.lit("g")), labels.withColumn("grp", F.lit("g")), lam=1e-9)
    assert {r.node: r.x for r in grouped.collect()}["b"] == pytest.approx(50, abs=1e-3)


def test_harmonic_isolated_node_takes_its_prior(spark):
    pairs, labels = _path(spark)
    prior = spark.createDataFrame([("z", 500.0)], "node string, prior double")
    labels = labels.unionByName(spark.createDataFrame([("z", None)], "node string, y double"))
    assert {r.node: r.x for r in graph.harmonic(pairs, labels, 0.05, prior).collect()}["z"] == pytest.approx(500)
    assert {r.node: r.x for r in graph.harmonic(pairs, labels, 0.05, prior, shrink_isolated=True).collect()}["z"] == pytest.approx(500 * 0.05 / 1.05)


def dense_harmonic(pairs, y, lam, prior):
    """x by node of the system solved whole."""
    names = sorted({n for a, b, _ in pairs for n in (a, b)} | set(y))
    at = {n: i for i, n in enumerate(names)}
    w = np.zeros((len(names),) * 2)
    for a, b, n in pairs:
        w[at[a], at[b]] += np.log1p(n)
        w[at[b], at[a]] += np.log1p(n)
    known = {n for n in names if y.get(n) is not None}
    m, c = np.eye(len(names)), np.zeros(len(names))
    for n in names:
        i = at[n]
        if n in known or not w[i].any():
            c[i] = y[n] if n in known else prior
        else:
            m[i] = (1 + lam) * m[i] - w[i] / w[i].sum()
            c[i] = lam * prior
    return dict(zip(names, np.linalg.solve(m, c), strict=True))


@pytest.mark.parametrize("name", [lambda i: i, lambda i: f"n{i:02d}"])
def test_harmonic_is_the_dense_solution(spark, name):
    r = random.Random(8)
    kind = "string" if isinstance(name(0), str) else "long"
    pairs = [(name(a), name(b), r.randrange(1, 9)) for a in range(30) for b in range(a + 1, 30) if r.random() < 0.12]
    labels = {name(0): 0.0, name(5): 50.0, name(11): 90.0, name(29): 10.0}
    df, known = spark.createDataFrame(pairs, f"a {kind}, b {kind}, cnt int"), spark.createDataFrame(list(labels.items()), f"node {kind}, y double")
    for lam in (0.5, 0.02):
        got = {x.node: x.x for x in graph.harmonic(df, known, lam).collect()}
        assert got == pytest.approx(dense_harmonic(pairs, labels, lam, np.mean(list(labels.values()))), abs=1e-5)
    group = {name(i): f"g{i % 3}" for i in range(30)}
    inside = [p for p in pairs if group[p[0]] == group[p[1]]]
    y = {name(i): float(r.randrange(100)) if i % 3 < 2 and i % 2 else None for i in range(30)}  # no label in g2
    rows = spark.createDataFrame([(group[a], a, b, n) for a, b, n in inside], f"grp string, a {kind}, b {kind}, cnt int")
    members = spark.createDataFrame([(group[n], n, v) for n, v in y.items()], f"grp string, node {kind}, y double")
    of = lambda g, ys: dense_harmonic([p for p in inside if group[p[0]] == g], {n: v for n, v in ys.items() if group[n] == g}, 0.05, np.median([v for n, v in ys.items() if v is not None and group[n] == g]))
    want = {n: v for g in ("g0", "g1") for n, v in of(g, y).items()}
    got = {x.node: x for x in graph.harmonic_by_group(rows, members).collect()}
    assert set(got) == set(group) and all(got[n].grp == group[n] and got[n].labelled == (y[n] is not None) for n in got)
    assert {n: x.x for n, x in got.items() if x.x is not None} == pytest.approx(want, abs=1e-5) and all(got[n].x is None for n in got if group[n] == "g2")
    out = {x.node: x.x for x in graph.harmonic_by_group(rows, members, leave_one_out=True).collect()}
    assert out == pytest.approx({n: of(group[n], {**y, n: None})[n] for n, v in y.items() if v is not None}, abs=1e-5)


def test_components_and_forest(spark):
    r = random.Random(5)
    pairs = sorted({tuple(sorted(r.sample(range(30), 2))) for _ in range(28)})
    df = spark.createDataFrame([(a, b, (7 * a + 3 * b) % 5) for a, b in pairs], "a long, b long, cnt long")
    parent = {n: n for p in pairs for n in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    want_forest = set()
    for a, b, c in sorted(((a, b, (7 * a + 3 * b) % 5) for a, b in pairs), key=lambda e: (-e[2], e[0], e[1])):
        if find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
            want_forest.add((a, b, c))
    assert {(x.node, x.component) for x in graph.components(df).collect()} == {(n, find(n)) for n in parent}
    assert {tuple(x) for x in graph.spanning_forest(df).collect()} == want_forest
    named = df.select(F.format_string("n%02d", "a").alias("a"), F.format_string("n%02d", "b").alias("b"), "cnt")
    assert {tuple(x) for x in graph.spanning_forest(named).collect()} == {(f"n{a:02d}", f"n{b:02d}", c) for a, b, c in want_forest}
    assert graph.spanning_forest(df.limit(0)).count() == 0


def works_frame(rows):
    w = pd.DataFrame(rows, columns=["m", "lo", "hi", "n_chunks", "not_before", "not_after"])
    w["mid"], w["f"] = (w["lo"] + w["hi"]) / 2, np.sqrt(1 + 4 / w["n_chunks"])
    w["p_anchor"] = (1 / np.maximum((w["hi"] - w["lo"]) / 3.3, 25) ** 2).fillna(0)
    return w.fillna({"not_before": -np.inf, "not_after": np.inf})


def test_sampler_has_the_closed_form_s_moments():
    nan = np.nan
    w = works_frame([(300, nan, nan, 1, nan, nan), (300, 100, 200, 4, nan, nan), (800, nan, nan, 9, nan, nan)])
    mu, var, noise = 500.0, 100.0**2, 150.0**2
    got = gibbs.chain(w, np.zeros((0, 2), dtype=int), 6000, 500, 1, 3, fixed=(mu, var, noise))
    own = 1 / (noise * w["f"] ** 2)
    precision = own + 1 / var + w["p_anchor"]
    mean = (w["m"] * own + mu / var + (w["mid"] * w["p_anchor"]).fillna(0)) / precision
    assert got.mean(0) == pytest.approx(mean.to_numpy(), abs=5) and got.std(0) == pytest.approx((precision**-0.5).to_numpy(), rel=0.05)


def test_sampler_under_constraints_is_rejection_sampling_s():
    nan = np.nan
    w = works_frame([(450, nan, nan, 3, nan, nan), (400, nan, nan, 3, nan, nan), (300, nan, nan, 3, 350, nan), (900, nan, nan, 3, nan, 200)])
    mu, var, noise = 420.0, 80.0**2, 120.0**2
    got = gibbs.chain(w, np.array([[0, 1], [2, 1]]), 40_000, 1000, 1, 5, fixed=(mu, var, noise))
    own = (1 / (noise * w["f"] ** 2)).to_numpy()
    precision = own + 1 / var
    free = np.random.default_rng(1).normal((w["m"].to_numpy() * own + mu / var) / precision, precision**-0.5, (400_000, 4))[:, :3]
    want = free[(free[:, 0] < free[:, 1]) & (free[:, 2] < free[:, 1]) & (free[:, 2] > 350)]
    assert (got[:, 0] <= got[:, 1]).all() and (got[:, 2] <= got[:, 1]).all() and (got[:, 2] >= 350).all() and (got[:, 3] <= 200).all()
    assert got[:, :3].mean(0) == pytest.approx(want.mean(0), abs=4) and got[:, :3].std(0) == pytest.approx(want.std(0), rel=0.06)
    # Far out in a tail the draws stay close to the bound, by the normal's own tail.
    far = gibbs.chain(works_frame([(900, nan, nan, 3, nan, -4000)]), np.zeros((0, 2), dtype=int), 4000, 200, 1, 5, fixed=(mu, var, noise))
    sd = precision[3] ** -0.5
    z = (4000 + (900 * own[3] + mu / var) / precision[3]) / sd
    assert (-4000 - far.mean()) == pytest.approx(sd / z, rel=0.15)


def test_sampler_ends_where_orders_contradict():
    w = works_frame([(100, np.nan, np.nan, 1, np.nan, np.nan)] * 3)
    edges = np.array([[0, 1], [1, 2], [2, 0]])
    got = gibbs.chain(w, edges, 200, 50, 1, 1)
    assert got.shape == (150, 3) and np.isfinite(got).all()
    assert len(set(gibbs.colours(3, edges).tolist())) == 3 and gibbs.colours(4, np.array([[0, 1], [2, 2]])).tolist()[2:] == [0, 0]


def test_bounds_stop_on_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    known = spark.createDataFrame([("a", 10.0, 20.0)], "node string, lo double, hi double")
    got = {r.node: (r.lo, r.hi) for r in graph.bounds(e, known).collect()}
    assert got["b"][0] == 10.0 and got["c"][1] == 20.0


def test_constraints(spark):
    works = spark.createDataFrame([("a", 0.0, 10.0), ("b", None, None)], "work string, lo double, hi double")
    rows = [(0, 1, "anchor", "a", "5", "9"), (1, 1, "anchor", "a", "6", "8"), (0, 2, "not_before", "b", "3", ""), (0, 3, "not_after", "b", "7", ""), (0, 4, "not_after", "b", "5", ""), (0, 5, "order", "a", "b", ""), (0, 6, "order", "b", "a", "")]
    c = spark.createDataFrame(rows, "src int, line int, type string, arg1 string, arg2 string, arg3 string")
    got = {r.work: (r.lo, r.hi, r.not_before, r.not_after) for r in constraints.applied(works, c).collect()}
    assert got == {"a": (6.0, 8.0, None, None), "b": (None, None, 3.0, 5.0)}
    edges = constraints.order_edges(works, c)
    assert edges.count() == 2
    assert {r.kind for r in constraints.conflicts(constraints.applied(works, c), edges).collect()} == {"order both ways"}


def test_sampler_obeys_constraints_and_ends_on_a_cycle(spark):
    works = spark.createDataFrame([(w, m, 4.0, None, None, nb, na) for w, m, nb, na in (("a", 500.0, None, None), ("b", 300.0, None, None), ("c", 400.0, 600.0, 700.0))], "work string, m double, n_chunks double, lo double, hi double, not_before double, not_after double")
    order = spark.createDataFrame([("a", "b")], "src string, dst string")
    got = {r.work: r for r in gibbs.posterior(gibbs.draws(works, order, chains=40, iterations=12, burn=6, thin=1)).collect()}
    assert 600 <= got["c"].median <= 700 and got["a"].median <= got["b"].median + 2
    cycle = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    assert gibbs.posterior(gibbs.draws(works, cycle, chains=1, iterations=4, burn=1)).count() == 3


def test_grouped_folds_keep_groups_whole(spark):
    df = spark.createDataFrame([(g, i) for g in range(7) for i in range(g + 1)], "g int, i int")
    got = model.grouped_folds(df, "g", 3).groupBy("g").agg(F.count_distinct("fold").alias("n")).collect()
    assert {r.n for r in got} == {1}


def test_tf_idf_rows_have_length_one(spark):
    c = spark.createDataFrame([("d1", "a", 2), ("d1", "b", 1), ("d2", "a", 1), ("d3", "c", 4)], "doc string, term string, cnt long")
    got = features.tf_idf(c).groupBy("doc").agg(F.sum(F.col("w") * F.col("w")).alias("l")).collect()
    assert all(r.l == pytest.approx(1) or r.l == 0 for r in got)


def test_points_and_search(spark):
    results = spark.createDataFrame([("SA_GV05_x", "anchor", "4", "-100.4", "-310", "90", "Bhūmi (old)"), ("SA_ZZ_y", "m", "1", "x", "1", "2", "t")], "work string, source string, n_chunks string, post_median string, lo95 string, hi95 string, title string")
    genres = spark.createDataFrame([("GV05", "Lane")], "code string, genre string")
    p = serve.points(results, genres)
    assert p.count() == 1 and p.first().likely == "c. 325 BCE – 100 CE"
    assert serve.found(p, " bhumi ").count() == 1 and serve.found(p, "nothing").count() == 0 and serve.found_range(p, "").first().n == 1


def test_readers(spark, tmp_path):
    import gzip
    import json

    with gzip.open(tmp_path / "m.ndjson.gz", "wt") as f:
        f.write(json.dumps({"root_segnr": ["a:1", "a:2"], "par_segnr": ["b:7"], "root_segtext": ["x"], "par_segtext": ["y"], "score": 0.5}) + "\n\nnot json\n" + json.dumps({"root_segnr": [], "par_segnr": ["b:1"]}) + "\n")
    m = readers.matches(spark, str(tmp_path / "m.ndjson.gz"))
    assert m.count() == 2
    e = readers.match_endpoints(m).collect()
    assert [(r.root, r.par, r.score, r.root_len) for r in e] == [("a", "b", 0.5, 0)]
    assert {(r.text, r.line, r.seg_text) for r in readers.matched_segments(m).collect()} == {("a", 1, "x"), ("b", 7, "y")}
    (tmp_path / "seg").mkdir()
    seg = [{"original": "o", "analyzed": "a b", "full_analysis": [{"lemma": "l", "tag": "Case=Nom"}]}, {"original": "p"}]
    (tmp_path / "seg/t1.json").write_text(json.dumps(seg))
    (tmp_path / "seg/t1_analyzed.json").write_text(json.dumps(seg))
    (tmp_path / "seg/t2.json").write_text(json.dumps([{"original": "q"}]))
    got = readers.segments(spark, str(tmp_path / "seg")).collect()
    assert [(r.text, r.ord, r.original) for r in got] == [("t1", 0, "o"), ("t1", 1, "p")]
    (tmp_path / "c.tsv").write_text("type\targ1\targ2\n" + 'anchor\tw"1\t5\t9\tnote\n\norder\tw1\tw2\n')
    got = readers.constraints(spark, [str(tmp_path / "none.tsv"), str(tmp_path / "c.tsv")]).orderBy("line").collect()
    assert [(r.type, r.arg1, r.arg2, r.arg3, r.note) for r in got] == [("anchor", 'w"1', "5", "9", "note"), ("order", "w1", "w2", "", "")]
    (tmp_path / "T.json").write_text(json.dumps({"T1": {"time_from": 400, "title": "x"}}))
    assert readers.json_map(spark, str(tmp_path / "T.json"), "struct<time_from:int,title:string>").first().time_from == 400
    (tmp_path / "names").mkdir()
    (tmp_path / "names/SA_a__ZH_b_01.json").write_text("x")
    assert readers.names(spark, str(tmp_path / "names"), r"^(SA_.*?)__ZH_[^_]*_(\d+)\.json$", ["sa", "num"]).first()[1:] == ("SA_a", "01")
    (tmp_path / "meta.tsv").write_text('File name\tt\ta\tnb\tna\n"w1"\t"T"\tA\t"1,200"\t900\n\t\t\t\t\n')
    row = readers.metadata(spark, str(tmp_path / "meta.tsv")).collect()
    assert [(r.work, r.nb, r.na) for r in row] == [("w1", 900.0, 1200.0)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("ā", 2.5), ("b", 1.5)], "work string, est double")
    writers.tsv(df, str(tmp_path / "o"), {"est": 0}, ["est"], one_file=True)
    text = next((tmp_path / "o").glob("*.csv")).read_text()
    assert text == "work\test\nā\t2.0\nb\t2.0\n" or text == "work\test\nb\t2.0\nā\t2.0\n"
    writers.dated(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    writers.json_lines(df, str(tmp_path / "j"))
    assert "ā" in "".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))
