"""Chat formatting, mixing, quality, tokenizers and toxicity."""

import collections
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalith.llm import chat_format, mixing, quality_classifier, quality_rules, range_coder, sentencepiece_codec, token_binary, tokens, toxicity
from tests.compare import rows, tables
from tests.llm.test_dedup import brute_links, classes

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\n", "one", "x" * 100_000, "a  b\tc d\u0085 e", "é日本😀 ▁ \x1c y", "<|endoftext|> </s>[INST]", "repeat " * 500]


def frame(spark, texts, extra=False):
    df = spark.createDataFrame([(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 5}", None) for i, t in enumerate(texts)], DOCS)
    if extra:
        for c in ("size", "score", "kept", "ids", "n_tokens", "src", "id"):
            df = df.withColumn(c, F.lit("mine"))
    return df


# ---- words ----
def test_words_are_those_of_bytes_split():
    r = random.Random(1)
    texts = ["".join(r.choice(" \t\n\x0b\x0c\r\x1cab é") for _ in range(r.randrange(40))).encode() for _ in range(300)]
    c = tokens.Chunk(texts)
    assert [w for t in texts for w in t.split()] == c.words()
    assert c.n_words.tolist() == [len(t.split()) for t in texts]
    by_hash = collections.defaultdict(set)
    for h, w in zip(c.word_hashes().tolist(), c.words()):
        by_hash[h].add(w)
    assert all(len(v) == 1 for v in by_hash.values()) and len(by_hash) == len(set(c.words()))


# ---- chat ----
def test_chat_equals_sql(spark):
    con = duckdb.connect()
    tables(con, SF)
    assert rows(chat_format.op1_chat_formatting(spark, SF).toPandas()) == rows(con.sql(chat_format.OP1_SQL).df())


def test_chat_round_trip_of_hostile_texts():
    r = random.Random(2)
    marks = ["</s>", "<s>", "[INST] ", " [/INST]", "<<SYS>>\n", "\n<</SYS>>", "[ROLE x] ", " [/ROLE]", "\\", "]", "a", "\n", "😀"]
    for _ in range(500):
        turns = [(r.choice(["user", "assistant", "system", "", "a]b\\", "tool"]), "".join(r.choice(marks) for _ in range(r.randrange(6)))) for _ in range(r.randrange(1, 5))]
        out = chat_format.render(turns)
        assert chat_format.parse(out.text, len(chat_format.BOS)) == turns
        assert [chat_format.unescaped(out.text[a:b]) for a, b in out.spans] == [t for role, t in turns if role == "assistant"]
    assert chat_format.render([("user", "plain"), ("assistant", "text")]).n_escaped == 0


def test_chat_parts_say_the_same(spark):
    df = spark.createDataFrame([(c, t, ["user", "assistant", None][t % 3], None if t == 2 else f"text {t} </s> \\") for c in (1, None) for t in range(40)], "conv_id long, turn long, role string, text string").withColumn("part", F.lit("mine"))
    whole, cut = (chat_format.read_back(chat_format.format_conversations(df, part_chars=n)).orderBy("conv_id").collect() for n in (10**6, 50))
    assert whole == cut and len(whole) == 2 and whole[0].n_turns == 40
    assert chat_format.read_back(chat_format.format_conversations(df.limit(0))).count() == 0


# ---- mixing ----
def test_mixing_takes_its_targets(spark):
    r = random.Random(4)
    texts = [" ".join("w" for _ in range(r.randrange(0, 300))) for _ in range(200)] + [None, ""]
    df = frame(spark, texts, True)
    for block in (7, 64, 5000):
        m = mixing.mix(df, block_words=block)
        got = mixing.taken_words(m).collect()
        assert len(got) == len(texts)
        sizes = {i: len((t or "").split()) for i, t in enumerate(texts)}
        assert all(g.size == sizes[g.doc_id] and 0 <= g.taken <= 2 * g.size for g in got)
        per = collections.defaultdict(lambda: [0, 0, 0.0])
        source = {i: None if i % 4 == 0 else f"s{i % 5}" for i in range(len(texts))}
        for g in got:
            p = per[source[g.doc_id]]
            p[0] += g.size
            p[1] += g.taken
            p[2] = g.target
        names = sorted(per, key=lambda s: (s is None, s or ""))
        want = mixing.water_filled([per[s][0] for s in names], mixing.cycled_weights(names), 1.5 * sum(sizes.values()), 2)
        assert [per[s][2] for s in names] == pytest.approx(want)
        assert all(abs(per[s][1] - per[s][2]) <= 1 for s in names)
        slots = m.slots.collect()
        assert len({s.slot for s in slots}) == len(slots)
        assert sorted(got) == sorted(mixing.taken_words(mixing.mix(df, block_words=block)).collect())


def test_water_filling():
    assert mixing.water_filled([10, 100, 100], [3, 1, 2], 150, 2) == pytest.approx([20, 130 / 3, 260 / 3])
    assert mixing.water_filled([], [], 0, 2) == []


def test_schedule_keeps_the_weights_all_along(spark):
    m = mixing.mix(frame(spark, ["w " * 50 for _ in range(300)]), block_words=10)
    slots = sorted((s.slot, s.src) for s in m.slots.collect())
    n = {s.src: s.n_blocks for s in m.sources.collect()}
    total, seen = sum(n.values()), collections.Counter()
    for k, (_, src) in enumerate(slots, 1):
        seen[src] += 1
        assert all(abs(seen[s] - k * n[s] / total) < 8 for s in n)


def test_mixed_documents_keep_columns(spark):
    df = frame(spark, ["a b c", None, "d e f g", ""], True)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} <= {0, 2}
    assert mixing.mixed_documents(df.limit(0)).count() == 0
    odd = frame(spark, [*ODD, *ODD], True)
    odd = odd.withColumn("doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") % 7)).unionByName(odd)
    words = odd.select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    got = mixing.mixed_documents(odd, block_words=3).select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert abs(got - 1.5 * words) <= 8


def brute_mix(spark, rows, block, share=1.5, epochs=2, seed=7):
    """Pieces (doc_id, text) of a mix in order; the shuffle's hashes are Spark's."""
    df = spark.createDataFrame([(i, t, s) for i, t, s in rows], "id long, text string, source string")
    marked = df.select("*", mixing.mark_of("id", "text").alias("mark")).withColumn("u", F.xxhash64(F.lit(seed), "mark")).collect()
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    buckets = -(-len(rows) // mixing.LAYOUT_DOCS)
    streams = {s: sorted((r for r in marked if r.source == s), key=lambda r: (r.u % buckets, r.u)) for s in names}
    words = {s: [(r.id, r.text, k) for r in v for k in range(len((r.text or "").split()))] for s, v in streams.items()}
    sizes = [len(words[s]) for s in names]
    takes = [min(round(t), epochs * n) for t, n in zip(mixing.water_filled(sizes, mixing.cycled_weights(names), share * sum(sizes), epochs), sizes)]
    counts = [-(-t // block) for t in takes]
    bounds = np.cumsum(counts) / sum(counts)
    rank, order = [0] * len(names), []
    for slot in range(sum(counts)):
        k = min(int(np.searchsorted(bounds, (slot + 1) * mixing.GOLDEN % 1.0, "right")), len(names) - 1)
        if rank[k] < counts[k]:
            order.append((k, rank[k]))
        rank[k] += 1
    late = [(b * len(names) + k, k, b) for k in range(len(names)) for b in range(rank[k], counts[k])]
    order += [(k, b) for _, k, b in sorted(late)]
    out = []
    for k, b in order:
        taken = [words[names[k]][i % sizes[k]] + (i // sizes[k],) for i in range(b * block, min((b + 1) * block, takes[k]))]
        for (i, t, e), some in itertools.groupby(taken, key=lambda w: (w[0], w[1], w[3])):
            at = [w[2] for w in some]
            cuts = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)] + [len(t)]
            out.append((i, t[0 if at[0] == 0 else cuts[at[0]] : cuts[at[-1] + 1]]))
    return out


@pytest.mark.parametrize("block", [5, 64])
def test_mixed_documents_are_the_schedule_in_order(spark, block):
    r = random.Random(21)
    texts = [" ".join("".join(r.choice("abé") for _ in range(3)) for _ in range(r.randrange(90))) + r.choice(["", "\n", "  "]) for _ in range(60)]
    rows = [(i, t, None if i % 4 == 0 else f"s{i % 5}") for i, t in enumerate(texts)]
    got = [(g.doc_id, g.text) for g in mixing.mixed_documents(frame(spark, texts, True), block_words=block).collect()]
    assert got == brute_mix(spark, rows, block)


# ---- quality ----
def brute_lines(t):
    t = t or ""
    w = t.encode().split()
    seen, dup = set(), 0
    for line in t.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    n = collections.Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
    cov = [0] * len(w)
    for j in range(len(w) - 7):
        if n[tuple(w[j : j + 8])] > 1:
            cov[j : j + 8] = [1] * 8
    return len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t)), dup, sum(cov)


def test_line_counts_equal_brute_force(spark):
    r = random.Random(5)
    texts = ODD + ["".join(r.choice("ab #é\n$ ") for _ in range(r.randrange(200))) for _ in range(100)]
    got = quality_rules.quality_rules(frame(spark, texts, True), quality_rules.LineCRF.neutral()).collect()
    assert len(got) == len(texts)
    for g in got:
        want = brute_lines(texts[g.doc_id])
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (g.base_failed and g.kept)


def test_viterbi_equals_brute_force():
    import itertools

    rng = np.random.default_rng(1)
    crf = quality_rules.LineCRF(rng.normal(size=len(quality_rules.FEATURES)), rng.normal(size=(2, 2)))
    doc, xs = [], []
    for d in range(20):
        n = int(rng.integers(1, 7))
        doc += [d] * n
        xs.append(rng.normal(size=(n, len(quality_rules.FEATURES))))
    got = crf.decode(np.array(doc), np.concatenate(xs))
    at = 0
    for x in xs:
        e = x @ crf.emission
        best = max(itertools.product((0, 1), repeat=len(e)), key=lambda y: sum(e[i] * y[i] for i in range(len(e))) + sum(crf.transition[a, b] for a, b in zip(y, y[1:])))
        assert tuple(got[at : at + len(e)].astype(int)) == best
        at += len(e)


def labelled(spark):
    r = random.Random(6)
    good = [" ".join("".join(r.choice("aeioubcdfg") for _ in range(r.randrange(2, 8))) for _ in range(60)) + "." for _ in range(60)]
    bad = [" ".join(w.upper() + "!!" for w in t.split()) for t in good[:20]] + [" ".join([t.split()[0]] * 60) for t in good[20:30]]
    docs = spark.createDataFrame([(i, t, "en", "s1", len(t)) for i, t in enumerate(good + bad)], DOCS)
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(90)] + [(None, 1, 0), (95, None, 1)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_line_crf_learns(spark):
    docs, labels = labelled(spark)
    got = quality_rules.quality_rules(docs, quality_rules.fit_line_crf(docs, labels)).collect()
    assert all((g.content_share >= 0.5) == (g.doc_id < 60) for g in got)


def test_co_training_learns_and_keeps_columns(spark):
    docs, labels = labelled(spark)
    kept = quality_classifier.good_documents(docs, labels)
    assert kept.columns == docs.columns
    assert sum(r.doc_id < 60 for r in kept.collect()) >= 57 and sum(r.doc_id >= 60 for r in kept.collect()) <= 3
    odd = frame(spark, ODD, True)
    model = quality_classifier.fit_quality(docs, labels)
    assert quality_classifier.score_quality(odd, model).count() == len(ODD)
    assert quality_classifier.fit_quality(docs, labels.limit(0)) is None
    assert all(r.kept for r in quality_classifier.score_quality(odd, None).collect())


def test_quality_on_rows_it_was_not_fitted_on(spark):
    """The fit in Spark is that of all rows at once, and rows that were kept back are told apart."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = quality_classifier.fit_quality(docs, labels.where(~held))
    got = {r.doc_id: r for r in quality_classifier.score_quality(docs, model).collect()}
    back = labels.where(held & F.col("quality").isNotNull()).collect()
    good = np.array([r.quality for r in back]) == 1
    said = np.array([got[r.doc_id].kept for r in back])
    assert (said == good).mean() >= 0.97 > max(good.mean(), 1 - good.mean()) + 0.05 and said[good].mean() >= 0.98
    rows = docs.collect()
    text = quality_classifier.text_view([(r.text or "").encode() for r in rows])
    meta = quality_classifier.meta_view([r.lang for r in rows], [r.source for r in rows], [r.n_chars for r in rows])
    views, some = {"text": model.text, "meta": model.meta}, {r.doc_id for r in back}
    free = np.array([r.doc_id not in some for r in rows])
    slim = quality_classifier._rows(docs, "doc_id", "text", "lang", "source", "n_chars")
    found = quality_classifier._exchange(slim, some)(views)
    want = quality_classifier.sure_rows(views, text, meta)
    assert sum(w.sum() for v in want.values() for w in v) > 100
    for name, x in (("text", text), ("meta", meta)):
        for label in (0, 1):
            assert np.allclose(found[name][label], quality_classifier.products(x[want[name][label] & free]), rtol=1e-3, atol=1e-2)


def test_views_teach_each_other():
    """Few labels, and metadata that tells quality apart: the text view learns more with rounds than without, each time."""
    gains = []
    for seed in (5, 6, 7):
        rng = np.random.default_rng(seed)

        def drawn(n, rng=rng):
            y = np.repeat([0.0, 1.0], n // 2)[rng.permutation(n)]
            text = rng.normal(size=(n, 40)) + (0.35 * (2 * y - 1))[:, None]
            meta = np.eye(4)[np.where(rng.random(n) < 0.95, y * 2, 2 - y * 2).astype(int) + rng.integers(0, 2, n)] + rng.normal(0, 0.01, (n, 4))
            return text.astype(np.float32), meta.astype(np.float32), y

        (xt, xm, y), (ut, um, _), (tt, _, ty) = drawn(48), drawn(4000), drawn(4000)

        def exchange(views, ut=ut, um=um):
            return {name: [quality_classifier.products((ut if name == "text" else um)[w]) for w in rows] for name, rows in quality_classifier.sure_rows(views, ut, um).items()}

        alone, taught = (quality_classifier.co_train(xt, xm, y, exchange, rounds=r, part=0.2) for r in (0, 3))
        gains.append(np.subtract(*(np.mean((m.text.raw(tt) > 0) == ty) for m in (taught, alone))))
        assert all(a > 0 and b > 0 for a, b in taught.exchanged)
    assert min(gains) > 0 and np.mean(gains) > 0.05


def test_labels_no_better_than_chance_weigh_nothing():
    rng = np.random.default_rng(6)
    y = (np.arange(400) % 5 > 0).astype(float)
    view = quality_classifier.View(np.ones(1, dtype=np.float32), 0.0)
    view.rank((1 - 2 * y + rng.normal(size=400) / 9)[:, None].astype(np.float32), y, 0.1)
    assert view.trust == (0.0, 0.0)
    view.rank((2 * y - 1 + rng.normal(size=400) / 9)[:, None].astype(np.float32), y, 0.1)
    assert view.trust == pytest.approx(((8 + 0.2) / 9 * 1.25 - 0.25, (32 + 0.8) / 33 * 5 - 4))  # 8 and 32 rows, all right
    view.rank(np.zeros((400, 1), dtype=np.float32), y, 0.1)  # all alike: sure of none
    assert view.low == -np.inf and view.high == np.inf


def test_quality_of_odd_tables(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    odd = frame(spark, ODD, True).withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id") % 2))
    model = quality_classifier.fit_quality(docs.unionByName(odd.select(docs.columns)), labels)
    assert quality_classifier.score_quality(odd, model).count() == len(ODD) and quality_classifier.score_quality(odd.limit(0), model).count() == 0
    crf = quality_rules.fit_line_crf(docs, labels)
    assert quality_rules.quality_rules(odd, crf).count() == len(ODD) and quality_rules.quality_rules(odd.limit(0), crf).count() == 0
    net = toxicity.fit_toxicity(odd, labels.limit(0))
    assert toxicity.score_toxicity(odd, net).count() == len(ODD) and toxicity.score_toxicity(odd.limit(0), net).count() == 0


def test_line_rules_on_rows_they_were_not_fitted_on(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    crf = quality_rules.fit_line_crf(docs, labels.where(~held))
    got = quality_rules.quality_rules(docs, crf).join(labels.where(held), "doc_id").select((F.col("content_share") >= 0.5).cast("int").alias("said"), "quality").collect()
    good = np.mean([r.quality for r in got])
    assert np.mean([r.said == r.quality for r in got]) >= 0.95 > good + 0.05


# ---- tokenizers ----
def test_sentencepiece_ids_are_the_library_s(spark):
    import sentencepiece

    r = random.Random(8)
    texts = ODD + ["".join(r.choice(" abth▁e\né😀<>s") for _ in range(r.randrange(60))) for _ in range(300)]
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    df = frame(spark, texts, True)
    got = {g.doc_id: g for g in sentencepiece_codec.encoded(df).collect()}
    assert all(got[i].ids == library.encode(t or "") for i, t in enumerate(texts))
    back = {g.doc_id: g.text for g in sentencepiece_codec.decoded(spark.createDataFrame(list(got.values()))).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(texts))
    assert all(g.same == ("▁" not in (texts[g.doc_id] or "")) for g in sentencepiece_codec.round_trip(df).collect())


def test_unigram_viterbi_is_the_library_s():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(sentencepiece_codec.default_model(), "rb") as f:
        proto.ParseFromString(f.read())
    r = random.Random(9)
    for p in proto.pieces:
        if p.type == 1:
            p.score = -8 - r.random() * 4 - (0 if len(p.piece) > 1 else 3)
    proto.trainer_spec.model_type = sentencepiece_codec.UNIGRAM
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    encoder = sentencepiece_codec.Encoder(sentencepiece_codec.Pieces(proto.SerializeToString()))
    texts = ["the theatre then thereby", "international relations", "a b c", "unbelievable stories of thousands"]
    ids, n = encoder.encode([t.encode() for t in texts])
    cuts = np.concatenate(([0], np.cumsum(n)))
    for i, t in enumerate(texts):
        assert ids[cuts[i] : cuts[i + 1]].tolist() == library.encode(t)


def test_range_coder_round_trip_and_checksums():
    rng = np.random.default_rng(3)
    some = [[], [7], [0], rng.integers(0, 50257, 3000), [5] * 5000, np.tile(rng.integers(0, 50257, 300), 9), [50256] * 10, rng.zipf(1.3, 20_000) % 50257, np.arange(4096), np.repeat(np.arange(700), 3)]
    for a in some:
        a = np.array(a, dtype=int)
        for block, lanes in ((256, 4096), (2048, 3), (100, 7)):
            coded = range_coder.encode(a, 50257, block, lanes)
            assert (range_coder.decode(coded, 50257) == a).all() and (range_coder.decode(coded, 50257, lanes=2) == a).all()
    many = rng.integers(0, 120_000, 9000)
    assert (range_coder.decode(range_coder.encode(many, 120_000), 120_000) == many).all()
    a = np.arange(5000) % 3000
    coded = range_coder.encode(a, 50257, 256)
    assert (range_coder.decode(coded, 50257, slice(3, 5)) == a[768:1280]).all()
    for where in (-50, -3000, 300, 3):
        damaged = bytearray(coded)
        damaged[where] ^= 1
        with pytest.raises(ValueError):
            range_coder.decode(bytes(damaged), 50257)


def test_range_coder_learns():
    rng = np.random.default_rng(4)
    phrases = [rng.integers(0, 50257, 40) for _ in range(3)]
    a = np.concatenate([phrases[i] for i in rng.integers(0, 3, 400)])
    assert 8 * len(range_coder.encode(a, 50257)) < 4 * len(a)
    assert 8 * len(range_coder.encode(rng.zipf(1.5, 50_000) % 50257, 50257)) < 10 * 50_000


def test_words_that_share_a_hash_keep_their_ids():
    from stratalith.llm.word_ids import WordIds

    class Sizes(WordIds):
        hashes_of = staticmethod(lambda buf, a, b: (b - a).astype(np.uint64) % np.uint64(3))

        def begins(self, buf):
            return buf[1:] == 0x20

        def tokenised(self, words):
            n = np.array([len(w) for w in words])
            return np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.uint32), n

    for remembered in (1, 5, 1000):
        s = Sizes(remembered)
        for texts in ([b"abc abc def de", b"", b"xyz"], [b"abc", b"abd abc"], [b"longer words and more of them"]):
            ids, n = s.encode(texts)
            assert bytes(ids.astype(np.uint8)) == b"".join(texts) and n.tolist() == list(map(len, texts))


def test_words_met_are_not_tokenised_again_and_letters_go_to_the_model_alone():
    """A word keeps its slot beside those that would have the same one; what the model gives for letters is what the library gives."""
    bpe = token_binary.ByteLevelBPE(open(token_binary.default_tokenizer()).read())
    bpe.remembered = 3000
    bpe.forget()
    r, asked, tokenised, by_pattern = random.Random(3), [], bpe.tokenised, []
    letters = "abcdefzABZéßñÀÖØöøÿĀſŁœ"
    words = list(dict.fromkeys(r.choice([" ", " ", ""]) + "".join(r.choice(letters) for _ in range(r.randrange(1, 9))) for _ in range(2000)))
    text = "\n".join(words) + " it's × ÷ ª µ a×b 12ab <|endoftext|>x \u00a0é"
    bpe.tokenised = lambda w: asked.append(len(w)) or tokenised(w)
    first, again = bpe.encode([text.encode()])[0], bpe.encode([text.encode()])[0]
    assert len(asked) == 1 and first.tolist() == again.tolist() == bpe.tokenizer.encode(text, add_special_tokens=False).ids
    pattern = bpe.by_pattern
    bpe.by_pattern = lambda w: by_pattern.extend(w) or pattern(w)
    flat, n = tokenised([w.encode() for w in words])
    assert not by_pattern and n.sum() == len(flat)
    assert flat.tolist() == [i for w in words for i in bpe.tokenizer.encode(w, add_special_tokens=False).ids]


def test_long_texts_are_cut_where_words_begin():
    bpe = token_binary._of(open(token_binary.default_tokenizer()).read())
    r = random.Random(12)
    for text in (" ".join("".join(r.choice("abcé ") for _ in range(r.randrange(9))) for _ in range(4000)), "x" * 30_000, "a\u00a0 \n b<|endoftext|> " * 900):
        raw = text.encode()
        runs = list(bpe.runs(raw, 700))
        assert b"".join(runs) == raw
        ids = [i for run in runs for i in bpe.encode([run])[0].tolist()]
        assert ids == bpe.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_table(spark, tmp_path):
    df = frame(spark, ODD, True)
    path = f"file://{tmp_path}/tokens"
    token_binary.write_tokens(df, path, segment_ids=500)
    library = token_binary._of(open(token_binary.default_tokenizer()).read()).tokenizer
    starts = {(r.part, r.seq): r.start for r in token_binary.segment_starts(spark, path).collect()}
    at = 0
    for g in sorted(token_binary.read_tokens(spark, path).collect(), key=lambda g: g.doc_id):
        want = library.encode(ODD[g.doc_id] or "", add_special_tokens=False).ids + [2]
        assert g.ids == want and g.n_tokens == len(want) and starts[g.part, g.seq] + g.before == at
        at += len(want)
    crcs = {g.doc_id: g.ids_crc32 for g in token_binary.read_tokens(spark, path, digest=True).collect()}
    assert crcs == {g.doc_id: zlib.crc32(np.array(g.ids, dtype="<u4").tobytes()) for g in token_binary.read_tokens(spark, path).collect()}
    twice = df.unionByName(df.where("doc_id = 1")).unionByName(df.where("doc_id < 3").withColumn("doc_id", F.lit(None).cast("long")))
    token_binary.write_tokens(twice, path + "-twice", segment_ids=200)
    got = token_binary.read_tokens(spark, path + "-twice").select("doc_id", "ids").collect()
    assert len(got) == len(ODD) + 4 and all(g.ids == library.encode(ODD[g.doc_id] or "", add_special_tokens=False).ids + [2] for g in got if g.doc_id is not None)
    token_binary.write_tokens(df.limit(0), path + "-none")
    assert token_binary.read_tokens(spark, path + "-none").count() == 0


def test_token_table_has_the_library_s_added_token(spark, tmp_path):
    from tokenizers import Tokenizer

    end = "<|endoftext|>"
    texts = [*ODD, end, f"one{end}two", f"one  {end} two", f"a {end}{end}\n b", f"\n{end}\u0085{end} é", "<|endoftext", f"x {end[:-1]} {end}"]
    path = f"file://{tmp_path}/tokens"
    token_binary.write_tokens(frame(spark, texts), path)
    library = Tokenizer.from_file(token_binary.default_tokenizer())
    got = {g.doc_id: g.ids for g in token_binary.read_tokens(spark, path).collect()}
    assert got == {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    assert 50256 in got[len(ODD)]


# ---- toxicity ----
def test_gradients():
    rng = np.random.default_rng(1)
    net = toxicity.BiGRU(2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = toxicity.inputs_of([b"a bad word here", b"some other text of words " * 12])
    y = np.array([1.0, *[0.0] * (len(x.windows) - 1)])

    def loss():
        z = net.forward(net.embedded(x).astype(np.float64), x.windows)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    words = net.embedded(x).astype(np.float64)
    z, kept = net.forward(words, x.windows, keep=True)
    g = net.backward(x, words, x.windows, kept, (1 / (1 + np.exp(-z)) - y) / len(y))
    for name in ("wx", "wh", "bias", "att", "att_v", "out", "out_b"):
        flat, i = net.p[name].reshape(-1), int(rng.integers(net.p[name].size))
        old = flat[i]
        flat[i] = old + 1e-3
        up = loss()
        flat[i] = old - 1e-3
        down = loss()
        flat[i] = old
        assert (up - down) / 2e-3 == pytest.approx(g[name].reshape(-1)[i], abs=2e-3)


def test_toxicity_learns(spark):
    r = random.Random(11)
    clean = [" ".join("".join(r.choice("aeioubcdfg") for _ in range(r.randrange(2, 8))) for _ in range(80)) for _ in range(240)]
    texts = []
    for i, t in enumerate(clean):
        w = t.split()
        if i % 2:
            for _ in range(4):
                w[r.randrange(len(w))] = r.choice(["zzork", "zzmoron", "zzscum"])
        texts.append(" ".join(w))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    net = toxicity.fit_toxicity(docs, labels)
    got = toxicity.score_toxicity(docs, net).collect()
    held = [g for g in got if g.held_out]
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 5 == 0) for g in got)
    assert np.mean([g.predicted == g.doc_id % 2 for g in held]) > 0.9
    odd = toxicity.score_toxicity(frame(spark, ODD, True), net).collect()
    assert len(odd) == len(ODD) and all(0 <= g.score <= 1 for g in odd)


def test_toxicity_of_rows_it_was_not_fitted_on(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.op9_toxicity(spark, sf).where("held_out").join(labels.where("toxic IS NOT NULL"), "doc_id").collect()
    toxic, said = np.array([r.toxic for r in got]) == 1, np.array([r.predicted for r in got]) == 1
    assert said[toxic].mean() > 0.5 and np.mean(said == toxic) > 1 - toxic.mean()


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 56, 57, 100, 1000):
        x = toxicity.inputs_of([(" ".join(f"w{i}" for i in range(n))).encode()])
        assert len(set(x.windows.ravel()) - {-1}) == n


# ---- pipeline ----
def test_pipeline_equals_its_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "near dedup", "source mixing", "sentencepiece"]
    out = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = quality_classifier.score_quality(docs, quality_classifier.fit_quality(docs, labels)).where("kept").select("doc_id")
    good = {r.doc_id: r for r in docs.join(scored, "doc_id").collect()}
    first = {}
    for i in sorted(good):
        first.setdefault(ascii_key(good[i].text), i)
    left = sorted(first.values())
    near = classes(left, brute_links([(i, good[i].text) for i in left]))
    stay = [i for i in left if near[i] == i]
    assert len(docs.collect()) > len(good) > len(left) > len(stay)
    pieces = brute_mix(spark, [(i, good[i].text, good[i].source) for i in stay], 1024)
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    assert sorted((r.doc_id, r.ids) for r in out) == sorted((i, library.encode(t)) for i, t in pieces)


def ascii_key(t):
    return (t or "").encode().lower()
