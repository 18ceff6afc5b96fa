"""Training-data operators whose cost went with tasks or passes instead of rows."""

import numpy as np

from stratalith.llm import quality_classifier


def test_sums_of_products_go_with_tasks_and_by_half(spark):
    x = np.random.default_rng(1).normal(size=(9, 6)).astype(np.float32)
    sums = quality_classifier.products(x)
    assert len(quality_classifier.half(sums)) == 28
    assert np.array_equal(quality_classifier.whole(quality_classifier.half(sums), 7), sums)
    rows = spark.range(500).repartition(100)
    few = quality_classifier.few_tasks(rows)  # each partition had sums of its own
    assert few.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism and few.count() == 500


def test_near_dedup_writes_few_files_where_there_are_many_partitions(spark):
    """Each step wrote a file for each shuffle partition that had a row."""
    from pathlib import Path

    from stratalith.llm.near_dedup import near_duplicates
    from stratalith.operators.staging import shared_folder

    words = np.random.default_rng(5).choice([f"w{k}" for k in range(300)], size=(120, 30))
    words[60:90, 1:] = words[:30, 1:]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(words.tolist())], "doc_id long, text string").repartition(40)
    there = Path(f"{shared_folder(spark).removeprefix('file:').replace('//', '/')}/stratalith")
    before, conf = set(there.iterdir()) if there.exists() else set(), {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        assert near_duplicates(docs).where("NOT kept").count() == 30
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    files = [len(list(d.glob("part-*"))) for d in set(there.iterdir()) - before]
    assert len(files) > 8 and max(files) <= spark.sparkContext.defaultParallelism


def test_mixing_runs_its_python_in_one_kind_of_worker(spark):
    from stratalith.llm.mixing import mix

    docs = spark.createDataFrame([(k, "a b c " * k, "xyz"[k % 3]) for k in range(50)], "doc_id long, text string, source string")
    plan = mix(docs).pieces._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "EvalPython" not in plan


def test_words_are_known_by_their_ends(spark):
    """Hashes and comparisons went over each byte of a text; and a word before a sign such as % was not met again without it."""
    from stratalith.llm import token_binary
    from stratalith.llm.word_ids import end_bytes

    words = [b"a", b"ab", b"abcdefgh", b"abcdefghi", b"abcdefghijklmnop", b"abcdefghijklmnopq", b"abcdefghXijklmnop"]
    n = np.array(list(map(len, words)))
    first, last = end_bytes(np.frombuffer(b"".join(words), np.uint8), np.cumsum(n) - n, n)
    assert first.tolist() == [int.from_bytes(w[:8], "little") for w in words] and last.tolist() == [int.from_bytes(w[-8:], "little") for w in words]
    bpe = token_binary.ByteLevelBPE(open(token_binary.default_tokenizer()).read())
    text = "nding nding%%% nding, abcdefghijklmnopq abcdefghXijklmnop a$b it's* <|endoftext|> é&&& ééééééééé éééééééééé\n#tag 5% x"
    assert bpe.encode([text.encode()])[0].tolist() == bpe.tokenizer.encode(text, add_special_tokens=False).ids
    known = bpe.hash.n
    bpe.encode([b" nding$$$ nding&&"])
    assert bpe.hash.n == known + 2  # the signs
