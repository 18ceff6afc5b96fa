"""Operators over ordered rows: segments of texts, tokens of segments, events of users.

``by`` names the columns of a sequence and ``order`` those of its order; give a total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def consecutive_distinct(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value is not the one just before; blank and null values stay and break a run."""
    before = F.lag(value).over(_w(by, order))
    v = F.col(value)
    return rows.withColumn("__before", before).where(v.isNull() | (v == "") | F.col("__before").isNull() | (v != F.col("__before"))).drop("__before")


def without_speaker_lines(segments: DataFrame, lemmas: tuple, most: int = 3) -> DataFrame:
    """Segments that were analysed and are no short line ending in a verb of saying."""
    last = F.element_at("full_analysis", -1).lemma
    speaks = (F.size("full_analysis") <= most) & F.coalesce(last.isin(*lemmas), F.lit(False))
    return segments.where(F.coalesce(F.size("full_analysis") > 0, F.lit(False))).where(~speaks)


def first_seen(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by a given order (partial minima before the shuffle, no sort of a key's rows)."""
    place = F.struct(*order)
    first = F.min_by(F.struct(*[F.col(c) for c in rows.columns]), place)
    return rows.groupBy(*key).agg(first.alias("__r")).select("__r.*")


def chunks(rows: DataFrame, by: list[str], order: list[str], size: int, weight: Column | None = None, least: float = 0) -> DataFrame:
    """Rows with chunk (dense, from 0): ``size`` rows each; chunks whose summed weight is below ``least`` go before they are numbered."""
    raw = rows.withColumn("__raw", F.floor((F.row_number().over(_w(by, order)) - 1) / size))
    kept = raw.groupBy(*by, "__raw").agg(F.sum(weight if weight is not None else F.lit(1)).alias("__n")).where(F.col("__n") >= least)
    numbered = kept.withColumn("chunk", F.row_number().over(_w(by, ["__raw"])) - 1).drop("__n")
    return raw.join(numbered, [*by, "__raw"]).drop("__raw")


def chunk_rows(chunked: DataFrame, by: list[str], ord_col: str) -> DataFrame:
    """A row per chunk: first, last and middle ordinal, rows."""
    listed = chunked.groupBy(*by, "chunk").agg(F.sort_array(F.collect_list(ord_col)).alias("__o"))
    return listed.select(*by, "chunk", F.element_at("__o", 1).alias("first"), F.element_at("__o", -1).alias("last"), F.element_at("__o", (F.floor(F.size("__o") / 2) + 1).cast("int")).alias("middle"), F.size("__o").cast("long").alias("n"))


def ngrams(rows: DataFrame, by: list[str], order: list[str], term: str, n: int) -> DataFrame:
    """by, gram, cnt: runs of n terms in a row; a null term (masked) breaks them."""
    w = _w(by, order)
    terms = [F.col(term), *[F.lead(term, i).over(w) for i in range(1, n)]]
    marked = rows.select(*by, *[t.alias(f"__{i}") for i, t in enumerate(terms)])
    whole = marked.where(" AND ".join(f"__{i} IS NOT NULL" for i in range(n)))
    return whole.groupBy(*by, F.concat_ws("_", *[f"__{i}" for i in range(n)]).alias("gram")).agg(F.count(F.lit(1)).alias("cnt"))


def masked(rows: DataFrame, terms: DataFrame, term: str) -> DataFrame:
    """Rows with term nulled where ``terms`` (a small table) lacks it."""
    known = F.broadcast(terms.select(F.col(term).alias("__t")).distinct())
    return rows.join(known, rows[term] == F.col("__t"), "left").drop(term).withColumnRenamed("__t", term)


def transitions(rows: DataFrame, by: list[str], order: list[str], symbol: str, begin: str = "BOL", end: str = "EOL") -> DataFrame:
    """by, src, dst, cnt: neighbouring symbols of each sequence, with its begin and end; never across sequences."""
    w = _w(by, order)
    step = rows.select(*by, F.col(symbol).alias("__s"), F.lag(symbol).over(w).alias("__before"), F.lead(F.lit(1)).over(w).alias("__more"))
    pairs = F.array(F.struct(F.coalesce("__before", F.lit(begin)).alias("src"), F.col("__s").alias("dst")), F.when(F.col("__more").isNull(), F.struct(F.col("__s").alias("src"), F.lit(end).alias("dst"))))
    each = step.select(*by, F.explode(F.filter(pairs, lambda p: p.isNotNull())).alias("p"))
    return each.groupBy(*by, "p.src", "p.dst").agg(F.count(F.lit(1)).alias("cnt"))


def transition_rates(counts: DataFrame, by: list[str], symbols: tuple) -> DataFrame:
    """by and a column B_src_dst for every pair of symbols: its share of the sequence's transitions."""
    total = F.sum("cnt")
    cells = [F.coalesce(F.sum(F.when((F.col("src") == a) & (F.col("dst") == b), F.col("cnt"))), F.lit(0)) / total for a in symbols for b in symbols]
    return counts.groupBy(*by).agg(*[c.alias(f"B_{a}_{b}") for c, (a, b) in zip(cells, ((a, b) for a in symbols for b in symbols), strict=True)])


def runs(rows: DataFrame, by: list[str], order: list[str], flag: Column) -> DataFrame:
    """by, length: of each run of flagged rows, which ends with its sequence."""
    w = _w(by, order).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("__f", flag).withColumn("__island", F.sum(F.when(F.col("__f"), 0).otherwise(1)).over(w))
    return marked.where("__f").groupBy(*by, "__island").agg(F.count(F.lit(1)).alias("length")).drop("__island")


def run_summary(runs: DataFrame, by: list[str], add: int = 1, long: int = 3) -> DataFrame:
    """by, n_runs, mean_length, long_share: lengths counted with ``add`` (the row that closes a compound)."""
    n = F.col("length") + add
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_runs"), F.avg(n).alias("mean_length"), F.avg((n >= long).cast("double")).alias("long_share"))


def as_of(rows: DataFrame, marks: DataFrame, by: list[str], at: str, start: str, label: str, default: str | None = None) -> DataFrame:
    """``rows`` with the label of the last mark at or before them. Rows and marks of a key are merged in one sort, never multiplied."""
    a = rows.select(*by, F.col(at).alias("__at"), F.struct(*rows.columns).alias("__row"), F.lit(None).cast(dict(marks.dtypes)[label]).alias("__label"), F.lit(1).alias("__kind"))
    b = marks.select(*by, F.col(start).alias("__at"), F.lit(None).cast(rows.select(F.struct(*rows.columns).alias("r")).schema["r"].dataType).alias("__row"), F.col(label).alias("__label"), F.lit(0).alias("__kind"))
    w = Window.partitionBy(*by).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    filled = a.unionByName(b).withColumn("__last", F.last("__label", ignorenulls=True).over(w)).where("__kind = 1")
    value = F.coalesce("__last", F.lit(default)) if default is not None else F.col("__last")
    return filled.select("__row.*", value.alias(label))


def position_index(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("pos", F.row_number().over(_w(by, order)) - 1)
