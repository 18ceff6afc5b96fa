"""Statistics by group. Deviations are of the population; quantiles are exact and interpolated."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.years import normal_cdf
from .staging import staged


def quantiles(rows: DataFrame, by: list[str], value: str, at: tuple[float, ...], bins: int = 1024, most: int = 10_000) -> DataFrame:
    """by, n, min, max and q (array, in the order of ``at``): exact interpolated quantiles of groups of any size.

    Selection by histograms that refine: the interval that holds a wanted rank is cut into bins, whose counts, least and greatest
    values come from partial sums; the bin with the rank is the next interval. At most ``most`` values, or equal ones, end it,
    so no task ever holds a group. Nulls are left out; NaN counts as the greatest. Groups by null keys are groups.
    """
    x = F.col("x")
    base = staged(rows.where(F.col(value).isNotNull()).select(F.struct(F.lit(0).alias("__all"), *by).alias("k"), F.col(value).cast("double").alias("x")))
    groups = staged(base.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("min"), F.max("x").alias("max")))
    places = [F.lit(float(p)) * (F.col("n") - 1) for p in at]
    ranks = F.array_distinct(F.array(*[f(p).cast("long") for p in places for f in (F.floor, F.ceil)]))
    now = groups.select("k", F.explode(ranks).alias("r"), F.col("min").alias("lo"), F.col("max").alias("hi"), F.lit(0).cast("long").alias("before"), F.col("n").alias("size"))
    ready = now.limit(0)
    while True:
        now = staged(now)
        wide = now.where((F.col("lo") < F.col("hi")) & (F.col("size") > most))
        ready = ready.union(now.where((F.col("lo") >= F.col("hi")) | (F.col("size") <= most)))
        if wide.isEmpty():
            break
        cut = wide.select("k", "lo", "hi").distinct()
        # The ends have bins of their own, so every pass gets on, whatever lies between them. Halves cannot overflow.
        share = (x / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        middle = F.when((F.col("hi") < float("inf")) & (F.col("lo") > float("-inf")), 1 + F.floor(share * (bins - 2))).otherwise(F.lit(1))
        inside = base.join(cut, "k").where((x >= F.col("lo")) & (x <= F.col("hi"))).withColumn("bin", F.when(x == F.col("lo"), 0).when(x == F.col("hi"), bins).otherwise(middle).cast("int"))
        counted = inside.groupBy("k", "lo", "bin").agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("b_lo"), F.max("x").alias("b_hi"))
        below = F.sum("c").over(Window.partitionBy("k", "lo").orderBy("bin")) - F.col("c")  # a row per bin
        found = wide.join(counted.withColumn("below", below), ["k", "lo"]).where((F.col("r") >= F.col("before") + F.col("below")) & (F.col("r") < F.col("before") + F.col("below") + F.col("c")))
        now = found.select("k", "r", F.col("b_lo").alias("lo"), F.col("b_hi").alias("hi"), (F.col("before") + F.col("below")).alias("before"), F.col("c").alias("size"))
    narrow = ready.where("lo < hi")
    held = base.join(narrow.select("k", "lo", "hi").distinct(), "k").where((x >= F.col("lo")) & (x <= F.col("hi"))).groupBy("k", "lo").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    values = narrow.join(held, ["k", "lo"]).select("k", "r", F.element_at("xs", (F.col("r") - F.col("before") + 1).cast("int")).alias("x"))
    values = values.union(ready.where("lo >= hi").select("k", "r", "lo"))
    out = groups.join(values.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("r", "x"))).alias("v")), "k")

    def between(p):
        lo, hi = F.floor(p).cast("long"), F.ceil(p).cast("long")
        return F.when(lo == hi, F.col("v")[lo]).otherwise((hi - p) * F.col("v")[lo] + (p - lo) * F.col("v")[hi])

    return out.select(*[F.col(f"k.`{c}`").alias(c) for c in by], "n", "min", "max", F.array(*map(between, places)).alias("q"))


def five_numbers(rows: DataFrame, by: list[str], value: str, at=(0.025, 0.25, 0.5, 0.75, 0.975)) -> DataFrame:
    """by, n, min, p<per mille of each quantile>, max. A group without values has n = 0 and nulls."""
    all_ = rows.select(*by).distinct() if by else rows.agg(F.lit(0).alias("__one")).select()
    got = quantiles(rows, by, value, at)
    names = [f"p{round(1000 * q)}" for q in at]
    got = got.select(*[F.col(c).alias(f"__by_{c}") for c in by], "n", "min", *[F.col("q")[i].alias(name) for i, name in enumerate(names)], "max")
    same = [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by] or [F.lit(True)]
    return all_.join(got, same, "left").select(*by, F.coalesce("n", F.lit(0)).cast("long").alias("n"), "min", *names, "max")


def group_summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"))


def robust_z(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Rows with z = (x - median) / (1.4826 * median |x - median| + 1e-9) of their group. Medians by selection: no group is held or sorted in one task."""

    def with_median(df: DataFrame, of: str, name: str) -> DataFrame:
        # Staged, its size is known: where it is small the rows stay where they are, and are not dealt out by group.
        med = staged(quantiles(df, by, of, (0.5,)).select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("q")[0].alias(name)))
        return df.join(med, [F.col(c) == F.col(f"__by_{c}") for c in by]).drop(*[f"__by_{c}" for c in by])

    off = with_median(rows, value, "__med").withColumn("__off", F.abs(F.col(value) - F.col("__med")))
    return with_median(off, "__off", "__mad").withColumn("z", (F.col(value) - F.col("__med")) / (1.4826 * F.col("__mad") + 1e-9)).drop("__med", "__off", "__mad")


def average_ranks(rows: DataFrame, by: list[str], value: str, out: str = "rank") -> DataFrame:
    """Rows with the rank of their value in its group, ties sharing the mean rank. Ranks are counted over distinct values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*by).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.select(*[F.col(b).alias(f"__by_{b}") for b in by], "__v", (F.sum("__n").over(w) - (F.col("__n") - 1) / 2).alias(out))
    cond = [F.col(b).eqNullSafe(F.col(f"__by_{b}")) for b in by] + [F.col(value) == F.col("__v")]
    return rows.join(ranked, cond, "left").drop("__v", *[f"__by_{b}" for b in by])


def spearman(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, n, rho: rank correlation with mean ranks of ties; null where a side does not vary."""
    whole = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    keys = by or ["__all"]
    if not by:
        whole = whole.withColumn("__all", F.lit(1))
    r = average_ranks(average_ranks(whole, keys, x, "__rx"), keys, y, "__ry")
    return r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), _corr("__rx", "__ry").alias("rho")).drop(*([] if by else ["__all"]))


def _corr(x: str, y: str) -> Column:
    """Pearson correlation of the rows that have both; null where a side does not vary, where ``corr`` itself divides by zero."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(both, F.col(x))) * F.stddev_pop(F.when(both, F.col(y))))


def pearson(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"), _corr(x, y).alias("r"))


@lru_cache(4096)
def _rank_sum_tail(few: int, many: int) -> np.ndarray:
    """P(U >= u) for u = 0 .. few * many without ties: subsets of the ranks counted by size and sum, a rank at a time."""
    ways = np.zeros((few + 1, few * (few + 1) // 2 + few * many + 1))
    ways[0, 0] = 1
    for rank in range(1, few + many + 1):
        for k in range(min(few, rank), 0, -1):
            ways[k, rank:] += ways[k - 1, :-rank]
    of_u = ways[few, few * (few + 1) // 2 :]
    return of_u[::-1].cumsum()[::-1] / math.comb(few + many, few)


@F.pandas_udf(DoubleType())
def _exact_p(n1: pd.Series, n2: pd.Series, u: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(c) else min(1.0, 2 * _rank_sum_tail(int(min(a, b)), int(max(a, b)))[round(max(c, a * b - c))]) for a, b, c in zip(n1, n2, u, strict=True)], dtype="float64")


def mann_whitney(rows: DataFrame, by: list[str], value: str, side: Column, few: int = 8, many: int = 200) -> DataFrame:
    """by, n1, n2, u, z, p, exact: U of the rows where ``side`` holds against the others, its normal score with tie and continuity
    correction, and the two-sided p.

    p is exact where no values tie, the smaller side has at most ``few`` rows and the larger at most ``many``; else it is the
    normal tail of z. Where a side is empty, and where all values tie, p is null.
    """
    keys = by or ["__all"]
    whole = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v"), side.alias("__s"))
    if not by:
        whole = whole.withColumn("__all", F.lit(1))
    counts = whole.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n"), F.sum(F.when(F.col("__s"), 1).otherwise(0)).alias("__n1"))
    w = Window.partitionBy(*keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("__r", F.sum("__n").over(w) - (F.col("__n") - 1) / 2)
    sums = ranked.groupBy(*keys).agg(F.sum("__n1").alias("n1"), F.sum(F.col("__n") - F.col("__n1")).alias("n2"), F.sum(F.col("__r") * F.col("__n1")).alias("__rs"), F.sum(F.pow(F.col("__n").cast("double"), 3) - F.col("__n")).alias("__ties"))
    u = F.col("__rs") - F.col("n1") * (F.col("n1") + 1) / 2
    n = F.col("n1") + F.col("n2")
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * ((n + 1) - F.col("__ties") / F.nullif(n * (n - 1), F.lit(0))))
    mid = F.col("n1") * F.col("n2") / 2
    z = F.sign(u - mid) * F.greatest(F.lit(0.0), F.abs(u - mid) - 0.5) / F.nullif(sd, F.lit(0.0))
    small = (F.col("__ties") == 0) & F.least("n1", "n2").between(1, few) & (F.greatest("n1", "n2") <= many)
    scored = sums.select(*by, "n1", "n2", u.alias("u"), z.alias("z"), small.alias("exact"))
    exact, tail = _exact_p("n1", "n2", F.when(F.col("exact"), F.col("u"))), 2 * normal_cdf(-F.abs("z"))
    return scored.select(*by, "n1", "n2", "u", "z", F.when(F.col("exact"), exact).when(F.least("n1", "n2") > 0, tail).alias("p"), "exact")


def eta_squared(rows: DataFrame, group: str, value: str) -> DataFrame:
    """One row, eta2: between-group share of the variance. One pass of sums by group."""
    by = rows.where(F.col(value).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    n = F.sum("n")
    mean = F.sum(F.col("n") * F.col("m")) / n
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) / n - mean * mean
    return by.agg((between / F.nullif(between + F.sum(F.col("n") * F.col("v")) / n, F.lit(0.0))).alias("eta2"))


def error_summary(rows: DataFrame, by: list[str], error: Column, within=(50, 100, 200, 300, 500)) -> DataFrame:
    """by, n, mae, median_ae, within_<t> (%)."""
    e = rows.select(*by, F.abs(error).alias("__e")).where("__e IS NOT NULL")
    return e.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("__e").alias("mae"), F.median("__e").alias("median_ae"), *[(100 * F.avg((F.col("__e") <= t).cast("double"))).alias(f"within_{t}") for t in within])


def interval_score(rows: DataFrame, by: list[str], x: str, lo: str, hi: str) -> DataFrame:
    """by, n, in_range (%), edge_mean, edge_median, mae_mid of estimates against intervals."""
    from ..functions.years import edge_error

    known = rows.where(f"`{x}` IS NOT NULL AND `{lo}` IS NOT NULL AND `{hi}` IS NOT NULL")
    e = known.select(*by, edge_error(F.col(x), F.col(lo), F.col(hi)).alias("__e"), F.abs(F.col(x) - (F.col(lo) + F.col(hi)) / 2).alias("__m"))
    return e.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (100 * F.avg((F.col("__e") == 0).cast("double"))).alias("in_range"), F.avg("__e").alias("edge_mean"), F.median("__e").alias("edge_median"), F.avg("__m").alias("mae_mid"))


def width_summary(rows: DataFrame, width: Column, at=(100, 200, 400)) -> DataFrame:
    w = rows.select(width.alias("__w")).where("__w IS NOT NULL")
    return w.agg(F.min("__w").alias("min"), F.median("__w").alias("median"), F.avg("__w").alias("mean"), F.max("__w").alias("max"), *[(100 * F.avg((F.col("__w") >= t).cast("double"))).alias(f"at_least_{t}") for t in at])


def histogram(rows: DataFrame, value: str, step: float, origin: float | None = None) -> DataFrame:
    """bin (from its lower edge), n: bins of equal width from ``origin`` (the least value)."""
    if origin is None:
        least = F.broadcast(rows.agg(F.min(value).alias("__o")))
        rows = rows.crossJoin(least)
    else:
        rows = rows.withColumn("__o", F.lit(float(origin)))
    some = rows.where(F.col(value).isNotNull())
    return some.groupBy((F.col("__o") + F.floor((F.col(value) - F.col("__o")) / step) * step).alias("bin")).agg(F.count(F.lit(1)).alias("n")).orderBy("bin")


def group_residuals(rows: DataFrame, group: str, values: list[str]) -> DataFrame:
    """Rows with <value>_res: value less its group's mean; means are summed before they are joined."""
    means = rows.groupBy(group).agg(*[F.avg(v).alias(f"__m_{v}") for v in values])
    out = rows.join(means, group)
    for v in values:
        out = out.withColumn(f"{v}_res", F.col(v) - F.col(f"__m_{v}"))
    return out.drop(*[f"__m_{v}" for v in values])


def fallback(rows: DataFrame, levels: list[str], value: str, least: int = 2, statistic: str = "mean") -> DataFrame:
    """Rows with prior and level: the statistic of the finest level with enough known values ("all": of everything)."""
    how = {"mean": F.avg, "median": F.median}[statistic]
    out = rows
    for k, level in enumerate(levels):
        per = rows.where(F.col(value).isNotNull()).groupBy(F.col(level).alias(f"__k{k}")).agg(F.count(F.lit(1)).alias(f"__n{k}"), how(value).alias(f"__s{k}"))
        out = out.join(per, F.col(level) == F.col(f"__k{k}"), "left")
    out = out.crossJoin(F.broadcast(rows.agg(how(value).alias("__all"))))
    prior, name = F.col("__all"), F.lit("all")
    for k in range(len(levels) - 1, -1, -1):
        enough = F.col(f"__n{k}") >= least
        prior, name = F.when(enough, F.col(f"__s{k}")).otherwise(prior), F.when(enough, levels[k]).otherwise(name)
    return out.select(*[rows[c] for c in rows.columns], prior.alias("prior"), name.alias("level"))


def without_self(rows: DataFrame, by: list[str], value: str, least: int = 1) -> DataFrame:
    """Rows with loo: the mean of the others of their group, in closed form; null where they are fewer than ``least``."""
    sums = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.sum(value).alias("__s"), F.count(F.lit(1)).alias("__n"))
    joined = rows.join(sums, by, "left")
    own = F.col(value).isNotNull()
    n = F.col("__n") - F.when(own, 1).otherwise(0)
    s = F.col("__s") - F.coalesce(F.col(value), F.lit(0))
    return joined.withColumn("loo", F.when(n >= least, s / n)).drop("__s", "__n")


def tally(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def worst(rows: DataFrame, by_size: Column, n: int, *tie: str) -> DataFrame:
    """The n rows of largest size."""
    return rows.orderBy(by_size.desc(), *tie).limit(n)
