"""Top-k search, collocations and source divergence against brute force, and their edge cases."""

import collections
import itertools
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalith.llm import collocations as co
from stratalith.llm import registry
from stratalith.llm import source_divergence as sd
from stratalith.llm import topk_search as tk
from tests.compare import rows, tables

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_topk_search", "op12_phrase_collocations", "op13_source_divergence"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    tables(con, SF)
    got, want = registry.queries()[name](spark, SF).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    assert len(got) > 0 or name == "op12_phrase_collocations"


# ---- top k ----
def best_products(vectors, queries, k):
    out = []
    for q, qv in queries:
        scores = sorted((-sum(a * b for a, b in zip(qv, v, strict=True)), i) for i, v in vectors if i != q and len(v) == len(qv))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def vectors_of(r, kind):
    def one(i):
        if kind == "lengths":
            size = 10 ** r.uniform(0, 3)
            return [round(size * r.gauss(0, 1)) for _ in range(6)]
        if kind == "copies":
            return [[40, 3, 0, -9, 1, 5], [40, 3, 0, -9, 1, 6], [-7, 0, 0, 2, 31, 4]][r.randrange(3)] if i % 4 else [r.randrange(-40, 40) for _ in range(6)]
        if kind == "huge":
            return [r.randrange(-(2**29), 2**29) for _ in range(6)]
        return [r.randrange(-9, 9) for _ in range(6 if i % 3 else 4)] if i % 11 else [0] * 6

    return [(i, one(i)) for i in range(400)]


@pytest.mark.parametrize("kind", ["lengths", "copies", "huge", "mixed"])
def test_top_k_is_brute_force(spark, kind):
    vectors = vectors_of(random.Random(kind), kind)
    queries = [x for x in vectors if x[0] % 5 == 0]
    df = spark.createDataFrame(vectors, "id long, v array<long>").repartition(5)
    got = tk.top_k(df.where("id % 5 = 0"), df, 7, shard=64, block=16, bucket=16)
    assert sorted(tuple(r) for r in got.select("query", "rank", "id", "score").collect()) == best_products(vectors, queries, 7)


def test_top_k_prunes_by_coordinates_and_lengths(monkeypatch):
    """Both ways of pruning are taken, each leaves vectors out, and none that counts."""
    r = np.random.default_rng(3)
    base = r.integers(-60, 60, 16)  # crowds of like length and unlike direction
    v = np.concatenate([r.integers(-20, 20, (300, 16)), np.repeat([r.permutation(base) for _ in range(6)], 40, axis=0) + r.integers(-1, 2, (240, 16))])
    v = v[np.argsort(-np.linalg.norm(v, axis=1), kind="stable")]
    ids, seen = np.arange(len(v)), collections.Counter()
    products, coordinates = tk._products, tk.Bucket.by_coordinates

    def counted(q, bucket, some, bound):
        out = products(q, bucket, some, bound)
        seen["verified"] += out.size
        return out

    def narrowed(self, q, cosine, focus=3):
        out = coordinates(self, q, cosine, focus)
        seen["left by coordinates"] += len(out)
        seen["of"] += len(self.ids)
        return out

    monkeypatch.setattr(tk, "_products", counted)
    monkeypatch.setattr(tk.Bucket, "by_coordinates", narrowed)
    row = lambda a, b: {"dim": 16, "ids": ids[a:b].tobytes(), "width": 8, "data": v[a:b].astype("i8").tobytes(), "high": float(np.linalg.norm(v[a:b], axis=1).max()), "bars": np.full(b - a, tk.NONE).tobytes()}
    own, best = tk.searched(row(0, 60), [row(a, min(a + 32, len(v))) for a in range(0, len(v), 32)], 5)
    got = sorted(zip(own[best.rows].tolist(), best.ids.tolist(), best.scores.tolist(), strict=True))
    want = sorted((q, i, s) for q, _, i, s in best_products([(i, x.tolist()) for i, x in enumerate(v)], [(i, v[i].tolist()) for i in range(60)], 5))
    assert got == want and 0 < seen["left by coordinates"] < seen["of"] and seen["verified"] < 0.7 * 60 * len(v)


def test_top_k_edge_cases(spark):
    odd = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (6, []), (7, [0.5, -0.26]), (20, [1.0, 1.0]), (20, [2.0, 1.0]), (None, [9.0, 9.0]), (8, [1e300, -1e300]), (40, []), (1, [1.0, 2.0])]
    df = spark.createDataFrame(odd, "vec_id long, embedding array<double>").withColumn("id", F.lit("x")).withColumn("v", F.lit(1)).withColumn("score", F.lit(0))
    got = tk.integer_vectors(df)
    assert sorted((r.id, list(r.v)) for r in got.where("id <> 8").collect()) == [(1, [64, 128]), (1, [64, 128]), (6, []), (7, [32, -17]), (20, [64, 64]), (20, [128, 64]), (40, [])]
    found = tk.top_k(got.where("id % 20 = 0"), got, 3).collect()
    assert [(r.id, r.score) for r in sorted(found, key=lambda r: r["rank"]) if r["query"] == 20] == [(1, 12288), (1, 12288), (7, 960)]
    assert [(r.id, r.score) for r in found if r["query"] == 40] == [(6, 0)]
    assert tk.top_k(got.where("id = 0"), got).count() == 0 and tk.top_k(got.where("id = 99"), got.where("id = 99")).count() == 0


def test_top_k_of_a_crowd_of_equal_vectors(spark):
    df = spark.range(3000).select("id", F.array(*[F.lit(x).cast("long") for x in (3, -1, 2)]).alias("v"))
    got = tk.top_k(df.where("id % 500 = 0"), df, 4, shard=512, bucket=64, block=2).collect()
    for q in range(0, 3000, 500):
        assert [(r.id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r["query"] == q] == [(i, 14) for i in range(5) if i != q][:4]


# ---- collocations ----
def phrases(docs, least, longest, top):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i, m in itertools.product(range(len(w)), range(1, longest + 1)):
                if i + m <= len(w):
                    f[lang, tuple(w[i : i + m])] += 1
    out = collections.defaultdict(list)
    for (lang, g), a in f.items():
        if len(g) < 2 or a < least:
            continue
        if any(len(h) > len(g) and c >= a and c >= least and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) for (x, h), c in f.items() if x == lang):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g)))
        out[lang].append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]], n[lang]))
    return sorted((lang, r + 1, p.decode(), -a, left, right, n, -s) for lang, found in out.items() for r, (s, a, p, left, right, n) in enumerate(sorted(found)[:top]))


@pytest.fixture(scope="module")
def prose():
    r = random.Random(5)
    words = ["a", "b", "C", "été", "the", "of", "x" * 300, "é", " ", "ß"]
    docs = [(r.choice(["en", "fr", None, "und"]), "".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", ". ", "\n", "\x0b", "!"]) for _ in range(r.randrange(0, 60)))) for _ in range(120)]
    docs += [("en", "a a a a a a a"), ("en", None), (None, ""), ("fr", " \t\n . "), ("en", "the of the of the of the of the of"), ("en", "the of the of the of the of the of"), ("fr", "one long run " * 4000)]
    return docs


@pytest.mark.parametrize("shard_bytes, held", [(1 << 10, 10**6), (1 << 24, 10**6), (1 << 12, 0), (1 << 12, 15)])
def test_collocations_are_brute_force(spark, prose, shard_bytes, held):
    df = spark.createDataFrame([(t, x, 1, 2) for x, t in prose], "text string, lang string, n long, word long").repartition(3)
    got = co.collocations(df, least=4, longest=5, top=30, shard_bytes=shard_bytes, held=held)
    assert sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == phrases(prose, 4, 5, 30)


def test_shards_look_frequent_words_up_where_these_fit_a_task(spark, prose, monkeypatch):
    """No row for each word of each shard goes from join to shard; beyond ``held`` words it does."""
    df, asked, group = spark.createDataFrame([(t, x) for x, t in prose], "text string, lang string"), [], type(spark.range(1).groupBy("id"))
    cogroup = group.cogroup
    monkeypatch.setattr(group, "cogroup", lambda *a: asked.append(1) or cogroup(*a))
    co.collocations(df, least=4, shard_bytes=1 << 12, held=10**6)
    assert not asked
    co.collocations(df, least=4, longest=2, shard_bytes=1 << 12, held=2)
    assert asked


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame([(None, None), ("", "en"), (" . ", "en"), ("one", "en")], "text string, lang string")
    assert co.collocations(df, least=1).count() == 0 and co.collocations(df.limit(0)).count() == 0


def test_suffix_order_and_grams():
    r = np.random.default_rng(2)
    ids = r.integers(0, 4, 300)
    left = np.where(ids > 0, co.links_left(np.append((ids[:-1] > 0) & (ids[1:] > 0), False)), 0)
    heads = [tuple(ids[i : i + min(left[i], 5)].tolist()) for i in range(len(ids))]
    order, shared = co.suffixes(ids, left, 5)
    placed = [heads[i] for i in order if left[i]]
    assert all(placed.count(h) == 1 or placed.index(h) + placed.count(h) - 1 == len(placed) - 1 - placed[::-1].index(h) for h in set(placed))
    for i in range(1, len(order)):
        a, b = heads[order[i - 1]], heads[order[i]]
        assert shared[i] == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    for m, grams, counts in co.gram_counts(ids, left, [2, 3, 5]):
        want = collections.Counter(tuple(ids[i : i + m].tolist()) for i in range(len(ids)) if left[i] >= m)
        assert {tuple(g): c for g, c in zip(grams.tolist(), counts.tolist(), strict=True)} == want and len(grams) == len(want)


# ---- divergence ----
def divergences(docs, least, top):
    docs = [((t or "").translate(LOWER), x or "", s or "") for t, x, s in docs]
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t) for t, _, _ in docs]
    df = collections.Counter((x, w) for (_, x, _), ws in zip(docs, words, strict=True) for w in set(ws))
    kept = {k for k, n in df.items() if n >= least}
    out = []
    for lang in {x for _, x, _ in docs}:
        terms = sorted((w for x, w in kept if x == lang), key=str.encode)
        counts = {s: collections.Counter(w for (_, x, s2), ws in zip(docs, words, strict=True) if x == lang and s2 == s for w in ws if (lang, w) in kept) for s in {s for _, x, s in docs if x == lang}}
        whole = sum(counts.values(), collections.Counter())
        p = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(terms)) for w in terms}
        ps, q = {s: p(c) for s, c in counts.items()}, p(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pairs = sorted((-sum(f(ps[s][w], ps[o][w]) for w in terms), o.encode()) for o in counts if o != s)
            out += [(lang, s, "pair", o.decode(), -v, r + 1) for r, (v, o) in enumerate(pairs)]
            best = sorted((-f(ps[s][w], q[w]), w.encode()) for w in terms if counts[s][w] and ps[s][w] > q[w])[:top]
            out += [(lang, s, "term", w.decode(), -v, r + 1) for r, (v, w) in enumerate(best)]
    return sorted(out)


@pytest.fixture(scope="module")
def sourced():
    r = random.Random(9)
    vocabulary = ["alpha", "Beta", "été", "ÉTÉ", "x", "日本", "don't", "a1b", *(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60))]
    docs = [(" ".join(r.choice(vocabulary[k % 7 :]) for _ in range(r.randrange(0, 40))), r.choice(["en", "fr"]), f"s{k}") for k in range(9) for _ in range(r.randrange(1, 9))]
    docs += [("hot " * 3000, "en", "s0"), (None, None, None), ("", "en", None), ("12 34", "fr", "none"), ("alpha alpha", None, "s1"), ("rare", "de", "only"), ("rare", "de", "other"), ("alpha", "en", "s0"), ("alpha", "en", "s0")]
    return docs


@pytest.mark.parametrize("team, lap, span", [(1, 1, 7), (2, 2, 16), (3, 1, 65_536), (8, 8, 65_536)])
def test_divergence_is_brute_force(spark, sourced, team, lap, span):
    df = spark.createDataFrame([(*d, 1, 2) for d in sourced], "text string, lang string, source string, term long, gid long").repartition(3)
    got = sd.source_divergence(df, team=team, lap=lap, span=span, top=12, shard_bytes=2000)
    assert sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()) == divergences(sourced, 3, 12)


def test_divergence_of_nothing(spark):
    df = spark.createDataFrame([("a b", "en", "x")], "text string, lang string, source string")
    assert sd.source_divergence(df.limit(0)).count() == 0 and sd.source_divergence(df).count() == 0


@pytest.mark.parametrize("seats", [2, 3, 6, 7, 16])
def test_every_two_seats_meet_once(spark, seats):
    even = seats + seats % 2
    df = spark.range(seats).crossJoin(spark.range(even - 1).withColumnRenamed("id", "round"))
    got = df.withColumn("other", sd.opponent(F.col("id"), F.col("round"), F.lit(even))).where(F.col("other") < seats).withColumn("stays", sd.stays(F.col("id"), F.col("other"))).collect()
    met = collections.Counter(frozenset((r.id, r.other)) for r in got if r.stays)
    assert met == {frozenset(p): 1 for p in itertools.combinations(range(seats), 2)}
    assert all(sum(r.round == k and r.id == s for r in got) <= 1 for k in range(even - 1) for s in range(seats))


def test_large_counts_are_exact():
    got = sd._probabilities(np.array([0, 10**12, 9 * 10**15]), 10**16 + 7)
    assert got.tolist() == [1 + 10**9 * (c + 1) // (10**16 + 7) for c in (0, 10**12, 9 * 10**15)]


def test_rare_phrases_are_sifted_out_before_they_are_merged(spark):
    """A frequent phrase never goes; most of the others do, which shards handed over before."""
    r = np.random.default_rng(8)
    ids = np.where(r.random(60_000) < 0.1, 0, r.integers(1, 2000, 60_000)).astype(np.int32)
    ids[:9000].reshape(-1, 9)[:, 2:7] = [1, 2, 3, 4, 5]
    shards = spark.createDataFrame([(k, bytearray(co._zip(part))) for k, part in enumerate(np.array_split(ids, 3))], "shard long, coded binary")
    for m in (2, 3):
        whole = co.gram_counts(ids.astype(np.int64), co._may_be(ids, m, []), [m])
        count = {tuple(g): n for _, grams, counts in whole for g, n in zip(grams.tolist(), counts.tolist(), strict=True)}
        full = co._full_counters(shards, m, spark.sparkContext.broadcast([]), 16, 100)
        left = co.sifted(ids, co._may_be(ids, m, []), m, full)
        kept = {tuple(g): n for _, grams, counts in co.gram_counts(ids[left > 0].astype(np.int64), left[left > 0], [m]) for g, n in zip(grams.tolist(), counts.tolist(), strict=True)}
        often = {g for g, n in count.items() if n >= 110}  # the shards are cut inside of some phrases
        assert len(often) >= 5 - m + 1 and all(kept[g] == count[g] for g in often) and len(kept) < len(count) / 100
