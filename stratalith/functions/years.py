"""Column functions over signed years and intervals of them; negative years are BCE. Unknown is null, never NaN."""

from __future__ import annotations

import statistics

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def interval(nb: Column, na: Column) -> Column:
    """struct(lo, hi), swapped where reversed; null unless both ends are known."""
    return F.when(nb.isNotNull() & na.isNotNull(), F.struct(F.least(nb, na).cast("double").alias("lo"), F.greatest(nb, na).cast("double").alias("hi")))


def midpoint(nb: Column, na: Column) -> Column:
    return (nb + na) / 2


def width(nb: Column, na: Column) -> Column:
    return na - nb


def clamped(x: Column, lo: Column, hi: Column) -> Column:
    """x within its bounds; reversed bounds change places; an unknown bound does not bind."""
    both = lo.isNotNull() & hi.isNotNull()
    low, high = F.when(both, F.least(lo, hi)).otherwise(lo), F.when(both, F.greatest(lo, hi)).otherwise(hi)
    return F.greatest(low, F.least(high, x))


def interpolated(x: Column, x0: float, x1: float, y0: float, y1: float) -> Column:
    """Linear between two points, level beyond them."""
    part = (F.greatest(F.lit(float(x0)), F.least(F.lit(float(x1)), x)) - x0) / (x1 - x0)
    return y0 + part * (y1 - y0)


def outward(lo: Column, hi: Column, step: int = 25) -> Column:
    """struct(lo, hi) rounded outward to whole steps."""
    return F.struct((F.floor(lo / step) * step).cast("long").alias("lo"), (F.ceil(hi / step) * step).cast("long").alias("hi"))


def era(year: Column) -> Column:
    """"-120" reads "120 BCE"; halves round to even."""
    n = F.bround(year, 0).cast("long")
    return F.when(n < 0, F.concat((-n).cast("string"), F.lit(" BCE"))).otherwise(F.concat(n.cast("string"), F.lit(" CE")))


def edge_error(x: Column, lo: Column, hi: Column) -> Column:
    """0 within the interval, else the distance to its nearer end."""
    return F.when((x >= lo) & (x <= hi), F.lit(0.0)).otherwise(F.least(F.abs(x - lo), F.abs(x - hi)))


def overlaps(lo: Column, hi: Column, from_: float, to: float) -> Column:
    return (hi >= from_) & (lo <= to)


def order_of(x_lo: Column, x_hi: Column, y_lo: Column, y_hi: Column) -> Column:
    """Which of two intervals that do not meet is the older; null if they do."""
    return F.when(x_hi < y_lo, "x_older").when(y_hi < x_lo, "y_older")


@F.pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    n = statistics.NormalDist()
    return z.map(lambda v: None if pd.isna(v) else n.cdf(v))


@F.pandas_udf(DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    n = statistics.NormalDist()
    return p.map(lambda v: None if pd.isna(v) or not 0 < v < 1 else n.inv_cdf(v))
