"""Exact, near and passage de-duplication against brute force, and their edge cases."""

import collections
import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from stratalith.llm import exact_dedup, near_dedup, substring_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(7)
    base = [prose(r, r.randrange(30, 200)) for _ in range(40)]
    out = list(base)
    for t in base[:12]:
        w = t.split()
        w[len(w) // 2] = "changed"
        out += [" ".join(w), t.upper(), t]
    passage = prose(r, 60)
    out += [prose(r, 20) + " " + passage + "\n" + prose(r, 15) for _ in range(4)]
    out += ["", None, "one", "one", "a b c", "x" * 200_000, " \t\n ", passage, prose(r, 12)]
    r.shuffle(out)
    return list(enumerate(out))


def frame(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    if extra:  # names that the operators give
        df = df.withColumn("kept", F.lit("mine")).withColumn("h", F.lit(1)).withColumn("class_id", F.lit("x")).withColumn("keep_id", F.lit(0))
    return df


def ascii_lower(t):
    return (t or "").encode().lower()


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_equals_brute_force(spark, texts, keep):
    groups = collections.defaultdict(list)
    for i, t in texts:
        groups[ascii_lower(t)].append(i)
    best = min if keep == "smallest" else max
    got = exact_dedup.exact_duplicates(frame(spark, texts, True), keep=keep).collect()
    assert len(got) == len(texts)
    by_id = dict(texts)
    for r in got:
        g = groups[ascii_lower(by_id[r.doc_id])]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (best(g), len(g), r.doc_id == best(g), hashlib.sha256(ascii_lower(by_id[r.doc_id])).hexdigest())


def test_exact_compares_bytes_when_hashes_collide(spark, texts):
    got = exact_dedup.exact_duplicates(frame(spark, texts), hash_of=lambda t: F.lit(b"same")).collect()
    want = exact_dedup.exact_duplicates(frame(spark, texts)).collect()
    assert sorted(got) == sorted(want)


def test_exact_keeps_columns_and_handles_null_and_repeated_ids(spark):
    df = frame(spark, [(1, "A"), (1, "A"), (2, "a"), (None, "a"), (None, "q"), (3, "b")], True)
    got = exact_dedup.exact_dedup(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 1), (False, 3), (True, 0), (True, 0)]
    assert got[0].__fields__ == df.columns
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def brute_passages(rows, k=13):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for j in range(len(w) - k + 1):
            g = tuple(w[j : j + k])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in words:
        cut = [False] * len(w)
        for j in range(len(w) - k + 1):
            if i is not None and first[tuple(w[j : j + k])] < i:
                cut[j : j + k] = [True] * k
        out.append((i, len(w), sum(cut), b" ".join(x for x, c in zip(w, cut) if not c).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("how", [{}, {"batch_bytes": 4000, "bucket_windows": 300}])
def test_passages_equal_brute_force(spark, texts, how):
    rows = [*texts, (None, texts[0][1]), (5, dict(texts)[5])]
    got = substring_dedup.repeated_passages(frame(spark, rows, True), **how).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=repr) == brute_passages(rows)
    assert all(sum(s.end - s.start for s in r.removed) == r.n_removed for r in got)


def test_removal_is_what_the_automaton_finds(monkeypatch):
    import numpy as np
    import pyarrow as pa

    r = random.Random(13)
    shared = prose(r, 30)
    rows = [(i, f"{prose(r, 20)} {shared if i % 2 else ''} {prose(r, 9)}") for i in range(8)]
    docs = pa.table({"batch": pa.array([0] * 8, pa.int32()), "id": [i for i, _ in rows], "text": [t for _, t in rows]})
    answers = substring_dedup._answer(substring_dedup._sender(13, 3)(docs))
    remove = lambda: substring_dedup._remover(13, 3)(docs, answers).column("n_removed").to_pylist()
    want = [n for _, _, n, _ in brute_passages(rows)]
    assert remove() == want and sum(want) == 90
    monkeypatch.setattr(substring_dedup, "_ALPHABET", 4)  # words of two symbols
    assert remove() == want
    found = substring_dedup._occurrences
    monkeypatch.setattr(substring_dedup, "_occurrences", lambda *how: tuple(x[:0] for x in found(*how)))
    assert sum(remove()) == 0
    monkeypatch.setattr(substring_dedup, "_occurrences", found)
    real = substring_dedup.ahocorasick.Automaton

    class Blind:
        def __init__(self, *how):
            self.real = real(*how)

        def __getattr__(self, name):
            return getattr(self.real, name)

        def iter(self, text):
            return iter(())

    monkeypatch.setattr(substring_dedup.ahocorasick, "Automaton", Blind)  # an automaton that hits nothing
    assert sum(remove()) == 0
    monkeypatch.undo()
    c = substring_dedup.Chunk([b"one two one", b"two three"])
    spelled, symbols = substring_dedup._spelled(c, np.zeros(5, dtype=np.uint64))  # all hashes the same
    assert symbols == 1 and spelled[0] == spelled[2] and spelled[1] == spelled[3] and len(set(spelled)) == 3


def test_passages_of_an_empty_table(spark):
    assert substring_dedup.repeated_passages(frame(spark, [])).count() == 0


def test_near_classes_equal_brute_force(spark, texts):
    grams = {}
    for i, t in texts:
        w = (t or "").lower().encode().split()
        grams[i] = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])
    weights = near_dedup.idf_weights(frame(spark, texts).select("text"))
    df = collections.Counter(g for c in grams.values() for g in c)
    n = len(texts)
    import math

    assert len(weights.keys) == sum(v >= 2 for v in df.values())
    weight = {g: 1 + math.log(min(1000, n / v)) / (2 * math.log(1000)) for g, v in df.items()}
    parent = {i: i for i in grams}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(grams), 2):
        common = sum(min(grams[a][g], grams[b][g]) * weight[g] for g in grams[a].keys() & grams[b].keys())
        total = sum(k * weight[g] for c in (grams[a], grams[b]) for g, k in c.items())
        if total and common / (total - common) >= 0.8:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = near_dedup.near_duplicates(frame(spark, texts, True)).collect()
    assert len(got) == len(texts)
    assert {r.doc_id: r.class_id for r in got} == {i: find(i) for i in grams}
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_near_keeps_columns_and_null_ids(spark):
    t = " ".join(f"w{i}" for i in range(60))
    df = frame(spark, [(4, t), (2, t + " end"), (None, t), (9, None), (8, "")], True)
    got = near_dedup.near_dedup(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == [(False, 2), (False, 8), (False, 9), (True, 0)]
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_a_large_group_of_copies_is_one_class(spark):
    r = random.Random(3)
    t = prose(r, 120).split()
    rows = []
    for i in range(600):
        w = list(t)
        w[r.randrange(len(w))] = f"v{i % 40}"
        rows.append((i, " ".join(w)))
    got = near_dedup.near_duplicates(frame(spark, rows)).collect()
    assert sum(r.kept for r in got) == 1


def brute_links(rows):
    """Pairs of ids whose texts' weighted Jaccard similarity is 0.8 or more, of (id, text)."""
    grams, owners = {}, collections.defaultdict(list)
    for i, t in rows:
        w = (t or "").lower().encode().split()
        grams[i] = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])
        for g in grams[i]:
            owners[g].append(i)
    weight = {g: float(near_dedup.idf(len(rows), len(v))) for g, v in owners.items()}
    common = collections.Counter()
    for g, v in owners.items():
        for a, b in itertools.combinations(sorted(v), 2):
            common[a, b] += min(grams[a][g], grams[b][g]) * weight[g]
    total = {i: sum(k * weight[g] for g, k in c.items()) for i, c in grams.items()}
    return [p for p, x in common.items() if x >= 0.8 * (total[p[0]] + total[p[1]] - x)]


def test_recall_on_the_documents(spark):
    """Classes of small tables against all pairs."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    links = brute_links(rows)
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert len(links) > 50 and sum(got[a] == got[b] for a, b in links) >= 0.99 * len(links)
    want = classes(dict(rows), links)
    assert all(want[i] == want[got[i]] for i in got)


def crowd(spark, sets):
    """Documents that share all their bands: samples, and vectors of weight 1."""
    import numpy as np

    samples = spark.createDataFrame([(i, [7] * near_dedup.SAMPLES) for i in sets], "id long, samples array<int>")
    vectors = [(i, near_dedup.packed(np.array(sorted(v), dtype=np.uint32), np.ones(len(v)), 1.0)) for i, v in sets.items()]
    return samples, spark.createDataFrame([(i, bytearray(v)) for i, v in vectors], "id long, vector binary")


def classes(ids, links):
    of = {i: i for i in ids}

    def find(x):
        return x if of[x] == x else find(of[x])

    for a, b in links:
        x, y = find(a), find(b)
        of[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_finds_those_like_a_linked_member_only(spark):
    # Each version is like the next alone; 2 is like the end 1, 4 like the end 5, and 3 only like 2 and 4.
    sets = {i: set(range(10 * i, 10 * i + 100)) for i in range(1, 6)}
    got = near_dedup.similar_pairs(*crowd(spark, sets), 1.0, 0.8).collect()
    assert set(classes(sets, [(r.a, r.b) for r in got]).values()) == {1}


@pytest.mark.parametrize("how", [{}, {"block": 16}])
def test_near_classes_of_a_crowded_bucket(spark, how):
    r = random.Random(11)
    sets = {0: set(range(100)), 999: set(range(5000, 5100))}  # ends that nobody is like
    for i in range(1, 160):  # pairs of drifting versions, and some alone
        start = 200 * (i % 40) + 8 * r.randrange(8)
        sets[i] = set(range(start, start + 100))
    want = classes(sets, [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    got = near_dedup.similar_pairs(*crowd(spark, sets), 1.0, 0.8, **how).collect()
    assert all(r.similarity >= 0.8 for r in got) and classes(sets, [(r.a, r.b) for r in got]) == want


def test_samples_of_similar_documents_agree_often_enough():
    assert near_dedup.least_alike(0.8) == 15 and near_dedup.least_alike(1.0) == near_dedup.SAMPLES


def test_samples_estimate_weighted_jaccard():
    import numpy as np

    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 2**52, 400, dtype=np.uint64))
    a, b = keys[:300], keys[100:400]
    wa, wb = np.ones(len(a)), np.ones(len(b)) * 1.0
    s = [near_dedup.samples_of(k, w, np.array([0])) for k, w in ((a, wa), (b, wb), (a, wa * 1.0))]
    assert (s[0] == s[2]).all()
    assert abs((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.25
