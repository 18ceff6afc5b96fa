"""Counts of terms and marks as feature rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import spread, staged


def term_counts(rows: DataFrame, doc: str, terms: Column, clean: Callable[[Column], Column] | None = None) -> DataFrame:
    """doc, term, cnt of an array of terms by row; counted in each task before the shuffle.

    ``clean`` makes a term of each element, null for none: as a row of its own an element stays in compiled code.
    """
    each = spread(rows.select(F.col(doc).alias("doc"), terms.alias("terms"))).select("doc", F.explode("terms").alias("term"))
    if clean:
        each = each.select("doc", clean(F.col("term")).alias("term")).where("term IS NOT NULL")
    return each.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("cnt"))


def document_frequency(counts: DataFrame, least: int = 1, most_share: float = 1.0) -> DataFrame:
    """term, df within a band of document frequencies (a share of all documents above)."""
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= least)
    if most_share < 1:
        n = F.broadcast(counts.agg(F.count_distinct("doc").alias("__n")))
        df = df.crossJoin(n).where(F.col("df") <= F.col("__n") * most_share).drop("__n")
    return df


def top_terms(counts: DataFrame, k: int) -> DataFrame:
    """term, total: the k most frequent; ties by term."""
    return counts.groupBy("term").agg(F.sum("cnt").alias("total")).orderBy(F.desc("total"), "term").limit(k)


def tf_idf(counts: DataFrame, terms: DataFrame | None = None, smooth: bool = True, normalised: bool = True) -> DataFrame:
    """doc, term, w: n / (all terms of the doc) * idf, divided by the row's length.

    idf = ln((N + 1) / (df + 1)), or ln(N / df) unsmoothed. ``terms`` (term, df) narrows the vocabulary; totals still count all terms.
    ``counts`` are read more than once: with ``terms``, which are mostly made from them, the caller stages them.
    """
    counts = (staged(counts) if terms is None else counts).where("doc IS NOT NULL")
    n = F.broadcast(counts.agg(F.count_distinct("doc").alias("__n")))
    df = terms if terms is not None else document_frequency(counts)
    idf = F.ln((F.col("__n") + 1) / (F.col("df") + 1)) if smooth else F.ln(F.col("__n") / F.col("df"))
    # Totals and lengths are sums over a document's rows, which one shuffle by document brings together.
    doc = Window.partitionBy("doc")
    whole = counts.withColumn("__total", F.sum("cnt").over(doc))
    w = whole.join(df.crossJoin(n).select("term", idf.alias("__idf")), "term").select("doc", "term", (F.col("cnt") / F.col("__total") * F.col("__idf")).alias("w"))
    if not normalised:
        return w
    length = w.withColumn("__l", F.sqrt(F.sum(F.col("w") * F.col("w")).over(doc)))
    return length.select("doc", "term", F.when(F.col("__l") > 0, F.col("w") / F.col("__l")).otherwise(0.0).alias("w"))


def frequency_vectors(counts: DataFrame, terms: list[str]) -> DataFrame:
    """doc, total, v: relative frequencies of listed terms, in their order, as an array."""
    cells = [F.coalesce(F.sum(F.when(F.col("term") == t, F.col("cnt"))), F.lit(0)) / F.sum("cnt") for t in terms]
    return counts.groupBy("doc").agg(F.sum("cnt").alias("total"), F.array(*cells).alias("v"))


def z_scores(rows: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows with <column>_z = (x - mean) / (population deviation + 1e-9), overall or by group."""
    by = by or []
    sums = rows.groupBy(*by).agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = rows.join(sums, by) if by else rows.crossJoin(F.broadcast(sums))
    for c in columns:
        out = out.withColumn(f"{c}_z", (F.col(c) - F.col(f"__m_{c}")) / (F.col(f"__s_{c}") + 1e-9))
    return out.drop(*[f"__{n}_{c}" for c in columns for n in "ms"])


def z_vectors(vectors: DataFrame, id_col: str = "doc", v: str = "v") -> DataFrame:
    """Vectors with each place standardised over all rows."""
    long = vectors.select(id_col, F.posexplode(v).alias("i", "x"))
    sums = long.groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    table = F.broadcast(sums.agg(F.sort_array(F.collect_list(F.struct("i", "m", "s"))).alias("__t")))  # a row per place
    return vectors.crossJoin(table).withColumn(v, F.zip_with(v, "__t", lambda x, t: (x - t.m) / (t.s + 1e-9))).drop("__t")


def rates(rows: DataFrame, by: list[str], marks: dict[str, Column], total: Column | None = None) -> DataFrame:
    """by, n, and a rate of each mark: rows where it holds, divided by all (or by a sum)."""
    whole = F.sum(total) if total is not None else F.count(F.lit(1))
    return rows.groupBy(*by).agg(whole.alias("n"), *[(F.sum(F.when(c, 1).otherwise(0)) / whole).alias(name) for name, c in marks.items()])


def weighted_means(rows: DataFrame, by: list[str], values: list[str], weight: str) -> DataFrame:
    """by, weight, and each value's weighted mean."""
    return rows.groupBy(*by).agg(F.sum(weight).alias(weight), *[(F.sum(F.col(v) * F.col(weight)) / F.sum(weight)).alias(v) for v in values])


def mean_word_length(rows: DataFrame, by: list[str], lengths: Column) -> DataFrame:
    """by, chars, words, mean_length from struct(chars, words)."""
    out = rows.select(*by, lengths.alias("__l")).groupBy(*by).agg(F.sum("__l.chars").alias("chars"), F.sum("__l.words").alias("words"))
    return out.withColumn("mean_length", F.col("chars") / F.nullif("words", F.lit(0)))


def imputed(rows: DataFrame, columns: list[str], train: Column | None = None) -> DataFrame:
    """Rows with nulls replaced by the column's median (over the training rows)."""
    source = rows if train is None else rows.where(train)
    medians = F.broadcast(source.agg(*[F.median(c).alias(f"__{c}") for c in columns]))
    out = rows.crossJoin(medians)
    for c in columns:
        out = out.withColumn(c, F.coalesce(c, f"__{c}"))
    return out.drop(*[f"__{c}" for c in columns])


def rank_of_groups(rows: DataFrame, by: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
