"""Rules that every operator shares: nulls, returns, guards, ranks, normal distribution.

Missing is NULL, never NaN. Division is ``try_divide``. All tables are long:
one row per (date, code); a new code is a new row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def over(keys: Sequence[str] | str, order: Sequence[str] | str) -> WindowSpec:
    keys, order = ([keys] if isinstance(keys, str) else keys), ([order] if isinstance(order, str) else order)
    return Window.partitionBy(*keys).orderBy(*order)


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    """The current row and the ``n - 1`` before it."""
    return w.rowsBetween(-(n - 1), Window.currentRow)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def null_if_nan(c: str | Column) -> Column:
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(math.inf)), c)


def ratio(a: str | Column, b: str | Column) -> Column:
    """NULL where the denominator is zero or NULL."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def change(price: str | Column, w: WindowSpec, k: int = 1, pad: bool = False) -> Column:
    """Relative change over ``k`` rows; ``pad`` carries prices over gaps, so that a gap counts as no change."""
    if not pad:
        return ratio(price, F.lag(col(price), k).over(w)) - 1
    # the last price up to k rows back is the carried price of that row
    back = F.last(col(price), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -k))
    return ratio(F.last(col(price), ignorenulls=True).over(so_far(w)), back) - 1


def guarded(agg: Column, x: str | Column, w: WindowSpec, least: int) -> Column:
    """A rolling aggregate that needs ``least`` values that aren't null."""
    return F.when(F.count(col(x)).over(w) >= least, agg.over(w))


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def z_score(x: str | Column, w: WindowSpec, ddof: int = 0) -> Column:
    """Cross-sectional or rolling z-score; NULL without spread."""
    sd = F.stddev_pop(col(x)) if ddof == 0 else F.stddev_samp(col(x))
    return F.when(sd.over(w) > 0, (col(x) - F.avg(col(x)).over(w)) / sd.over(w))


def keep_last(df: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """One row per key, the last by ``seq``."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() for c in seq))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def percent_rank_avg(x: str | Column, keys: Sequence[str]) -> Column:
    """Average-tie percentile rank among the rows of ``keys`` that aren't null."""
    w = Window.partitionBy(*keys, col(x).isNull())
    ties = Window.partitionBy(*keys, col(x))
    return F.when(col(x).isNotNull(), (F.rank().over(w.orderBy(col(x))) + (F.count(F.lit(1)).over(ties) - 1) / 2) / F.count(F.lit(1)).over(w))


def expanding_rank(x: str, w: WindowSpec) -> Column:
    """Average-tie percentile rank of the current value among all up to it.

    For one series per key (thousands of rows); the values so far are an array.
    """
    seen = F.collect_list(col(x)).over(so_far(w))
    below = F.size(F.filter(seen, lambda v: v < F.col(x)))
    same = F.size(F.filter(seen, lambda v: v == F.col(x)))
    return F.when(F.col(x).isNotNull(), (below + (same + 1) / 2) / F.size(seen))


def tertile(p: Column) -> Column:
    """0, 1, 2 for (0, 1/3], (1/3, 2/3], (2/3, 1]."""
    return F.when(p <= 1 / 3, 0.0).when(p <= 2 / 3, 1.0).when(p.isNotNull(), 2.0)


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, from a continued fraction far out and a series near zero.

    Spark has no error function; this one is within 1e-12 everywhere.
    """
    a = F.abs(x)
    # density * sum of a^(2k+1) / (1 3 5 ... (2k+1)), for a <= 3.5
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(70)),
        F.struct(a.alias("t"), a.alias("s")),
        lambda acc, k: F.struct((acc["t"] * a * a / (2 * k + 1)).alias("t"), (acc["s"] + acc["t"] * a * a / (2 * k + 1)).alias("s")),
        lambda acc: acc["s"],
    )
    density = F.exp(-a * a / 2) / math.sqrt(2 * math.pi)
    # the tail's continued fraction, from the inside out
    tail = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), a, lambda acc, k: a + k / acc)
    upper = F.when(a <= 3.5, F.lit(0.5) - density * series).otherwise(density / tail)
    return F.when(x.isNotNull(), F.when(x > 0, 1 - upper).otherwise(upper))


def normal_ppf(p: float) -> float:
    return NormalDist().inv_cdf(p)


def normal_cdf_value(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def running_product(x: Column, w: WindowSpec) -> Column:
    return F.product(x).over(so_far(w))


def unbiased_skew(x: str | Column) -> Column:
    n = F.count(col(x))
    return F.when(n > 2, F.skewness(col(x)) * F.sqrt(n * (n - 1)) / (n - 2))


def unbiased_kurtosis(x: str | Column) -> Column:
    """Bias-corrected, 3 for a normal distribution."""
    n = F.count(col(x))
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(col(x)) + 6) + 3)
