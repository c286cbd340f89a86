"""Volatility, spread and flow measures over bars (symbol, ts, open, high, low, close, volume, dollar)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import guarded, normal_cdf, ratio, trailing
from .labels import ewm_std

def by_bar():
    return Window.partitionBy("symbol").orderBy("ts")

KEYS = ["symbol", "ts"]


def parkinson_vol(bars: DataFrame, window: int = 20) -> DataFrame:
    d = bars.withColumn("_x", F.log(F.col("high") / F.col("low")) ** 2)
    return d.select(*KEYS, F.sqrt(guarded(F.avg("_x"), "_x", trailing(by_bar(), window), window) / (4 * math.log(2))).alias("parkinson"))


def garman_klass_vol(bars: DataFrame, window: int = 20) -> DataFrame:
    x = 0.5 * F.log(F.col("high") / F.col("low")) ** 2 - (2 * math.log(2) - 1) * F.log(F.col("close") / F.col("open")) ** 2
    d = bars.withColumn("_x", x)
    return d.select(*KEYS, F.sqrt(F.greatest(F.lit(0.0), guarded(F.avg("_x"), "_x", trailing(by_bar(), window), window))).alias("garman_klass")).withColumn("garman_klass", F.when(F.count(F.lit(1)).over(trailing(by_bar(), window)) >= window, F.col("garman_klass")))


def amihud_illiquidity(bars: DataFrame, window: int = 20) -> DataFrame:
    r = F.abs(ratio("close", F.lag("close").over(by_bar())) - 1)
    d = bars.withColumn("_x", F.try_divide(r, F.col("dollar")))
    return d.select(*KEYS, guarded(F.avg("_x"), "_x", trailing(by_bar(), window), window).alias("amihud"))


def roll_spread(bars: DataFrame, window: int = 20) -> DataFrame:
    d = bars.withColumn("_d", F.col("close") - F.lag("close").over(by_bar()))
    d = d.withColumn("_l", F.lag("_d").over(by_bar()))
    both = F.when(F.col("_d").isNotNull() & F.col("_l").isNotNull(), 1)
    w = trailing(by_bar(), window)
    cov = F.when(F.count(both).over(w) >= window, F.covar_samp("_d", "_l").over(w))
    return d.select(*KEYS, F.when(cov.isNotNull(), 2 * F.sqrt(F.greatest(-cov, F.lit(0.0)))).alias("roll_spread"))


def corwin_schultz_spread(bars: DataFrame) -> DataFrame:
    k = 3 - 2 * math.sqrt(2)
    beta = F.log(F.col("high") / F.col("low")) ** 2 + F.log(F.lag("high").over(by_bar()) / F.lag("low").over(by_bar())) ** 2
    hi, lo = F.lag("high").over(by_bar()), F.lag("low").over(by_bar())
    gamma = F.when(hi.isNotNull(), F.log(F.greatest(F.col("high"), hi) / F.least(F.col("low"), lo)) ** 2)
    d = bars.select(*KEYS, beta.alias("_b"), gamma.alias("_g"))
    alpha = (math.sqrt(2) - 1) / k * F.sqrt("_b") - F.sqrt(F.col("_g") / k)
    e = F.exp(F.greatest(alpha, F.lit(0.0)))
    return d.select(*KEYS, F.when(alpha.isNotNull(), 2 * (e - 1) / (1 + e)).alias("corwin_schultz"))


def vpin(bars: DataFrame, window: int = 50, sigma_span: int = 50) -> DataFrame:
    """Bulk-volume classification: the share bought is the normal probability of the scaled price change."""
    d = bars.withColumn("_d", F.col("close") - F.lag("close").over(by_bar()))
    d = d.join(ewm_std(d, "_d", sigma_span, out="_s"), KEYS)
    bought = normal_cdf(F.try_divide("_d", "_s"))
    d = d.withColumn("_i", F.col("volume") * F.abs(2 * bought - 1))
    w = trailing(by_bar(), window)
    return d.select(*KEYS, F.try_divide(guarded(F.sum("_i"), "_i", w, window), guarded(F.sum("volume"), "volume", w, window)).alias("vpin"))


def rsi(bars: DataFrame, window: int = 14) -> DataFrame:
    d = bars.withColumn("_d", F.col("close") - F.lag("close").over(by_bar()))
    d = d.withColumns({"_g": F.greatest("_d", F.lit(0.0)), "_l": F.greatest(-F.col("_d"), F.lit(0.0))})
    d = d.withColumns({c: F.when(F.col("_d").isNotNull(), F.col(c)) for c in ("_g", "_l")})
    w = trailing(by_bar(), window)
    g, l = (guarded(F.avg(c), c, w, window) for c in ("_g", "_l"))
    return d.select(*KEYS, F.when(l == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(g, l))).alias("rsi"))


def efficiency_ratio(series: DataFrame, window: int = 60, value: str = "level") -> DataFrame:
    """(date, er): net over total movement; NULL without movement."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    d = series.withColumn("_d", F.abs(F.col(value) - F.lag(value).over(w)))
    moved = guarded(F.sum("_d"), "_d", trailing(w, window), window)
    return d.select("date", F.try_divide(F.abs(F.col(value) - F.lag(value, window).over(w)), moved).alias("er"))


def frac_diff_weights(d: float, thresh: float = 1e-5) -> list[float]:
    """Binomial weights down to ``thresh``, oldest first."""
    w, k = [1.0], 1
    while abs(nxt := -w[-1] * (d - k + 1) / k) >= thresh:
        w.append(nxt)
        k += 1
    return w[::-1]


def frac_diff(series: DataFrame, d: float, thresh: float = 1e-5, value: str = "close") -> DataFrame:
    """(symbol, ts, frac_diff): fixed-width convolution; rows before the full width are dropped."""
    weights = frac_diff_weights(d, thresh)
    n = len(weights)
    frame = F.collect_list(value).over(by_bar().rowsBetween(-(n - 1), Window.currentRow))
    lit = F.array(*map(F.lit, weights))
    s = series.where(F.col(value).isNotNull()).select(*KEYS, frame.alias("_x"))
    return s.where(F.size("_x") == n).select(*KEYS, F.aggregate(F.zip_with("_x", lit, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b).alias("frac_diff"))


def causal_direction(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, rho, score, role) by entropies of standardised residuals, two aggregations over all rows.

    A positive score points from the feature to the target; a correlation of 1 scores 0.
    """
    full = df.where(F.col(target).isNotNull())
    long = full.select(F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x"), F.col(target).cast("double").alias("y")) for f in features))).alias("e")).select("e.*").where("x is not null")
    m = long.groupBy("feature").agg(F.avg("x").alias("mx"), F.stddev_pop("x").alias("sx"), F.avg("y").alias("my"), F.stddev_pop("y").alias("sy"), F.corr("x", "y").alias("rho"))
    d = long.join(F.broadcast(m), "feature")  # one row per feature
    zx, zy = F.try_divide(F.col("x") - F.col("mx"), F.col("sx")), F.try_divide(F.col("y") - F.col("my"), F.col("sy"))
    root = F.sqrt(F.greatest(1 - F.col("rho") ** 2, F.lit(0.0)))
    parts = {"x": zx, "y": zy, "xy": F.try_divide(zx - F.col("rho") * zy, root), "yx": F.try_divide(zy - F.col("rho") * zx, root)}
    g = d.groupBy("feature", "rho").agg(*(a.alias(f"{k}{n}") for n, u in parts.items() for k, a in (("c", F.avg(F.log(F.cosh(u)))), ("g", F.avg(u * F.exp(-u * u / 2))))))
    # The constants of the maximum-entropy approximation
    k1, k2, gamma = 79.047, 7.4129, 0.37457
    h = lambda n: 0.5 * (1 + math.log(2 * math.pi)) - k1 * (F.col(f"c{n}") - gamma) ** 2 - k2 * F.col(f"g{n}") ** 2
    score = F.when(F.abs("rho") >= 1 - 1e-12, 0.0).otherwise((h("y") + h("xy")) - (h("x") + h("yx")))
    return g.select("feature", "rho", score.alias("score")).withColumn("role", F.when(F.col("score") > 0, "cause").otherwise("effect"))


def collider_bias_beta(beta: float, delta: float, gamma: float) -> float:
    return (beta - delta * gamma) / (1 + gamma**2)


