"""Mean reversion, unit roots, cointegration and filters.

What sums express stays in SQL. Unit-root regressions and Kalman filters are
small dense problems per series: they run as grouped maps or ordered folds.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import ordered_fold


def _lagged(series: DataFrame, key: str, value: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy("ts")
    d = series.where(F.col(value).isNotNull()).withColumn("_l", F.lag(value).over(w))
    return d.withColumn("_d", F.col(value) - F.col("_l")).where("_l is not null")


def half_life(series: DataFrame, key: str = "symbol", value: str = "close") -> DataFrame:
    """(key, half_life): -ln 2 / ln(1 + b) of the change on the level; infinite without reversion."""
    g = _lagged(series, key, value).groupBy(key).agg(F.regr_slope("_d", "_l").alias("_b"))
    rho = F.greatest(F.lit(1e-6), 1 + F.col("_b"))
    return g.select(key, F.when(F.col("_b").isNull() | (rho >= 1), F.lit(math.inf)).otherwise(-math.log(2) / F.log(rho)).alias("half_life"))


def ou_params(series: DataFrame, key: str = "symbol", value: str = "close") -> DataFrame:
    """(key, theta, mu, sigma) of a mean-reverting process; sigma from residual sums, no second pass."""
    g = _lagged(series, key, value).groupBy(key).agg(F.regr_slope("_d", "_l").alias("b"), F.regr_intercept("_d", "_l").alias("a"), F.regr_syy("_d", "_l").alias("yy"), F.regr_sxy("_d", "_l").alias("xy"), F.count("_d").alias("n"))
    sse = F.greatest(F.lit(0.0), F.col("yy") - F.col("b") * F.col("xy"))
    return g.select(key, (-F.col("b")).alias("theta"), F.try_divide(-F.col("a"), F.col("b")).alias("mu"), F.sqrt(sse / (F.col("n") - 1)).alias("sigma"))


def hurst_exponent(series: DataFrame, max_lag: int = 100, key: str = "symbol", value: str = "close") -> DataFrame:
    """(key, hurst): slope of ln deviation of lagged differences on ln lag, lags 2 to min(max_lag, n / 2) - 1; NULL under 20 values."""
    w = Window.partitionBy(key).orderBy("ts")
    lags = range(2, max_lag)
    d = series.where(F.col(value).isNotNull()).select(key, *((F.col(value) - F.lag(value, k).over(w)).alias(f"d{k}") for k in lags))
    g = d.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *(F.stddev_pop(f"d{k}").alias(f"s{k}") for k in lags))
    long = g.select(key, "n", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"s{k}").alias("s")) for k in lags))).alias("e")).select(key, "n", "e.*")
    ok = (F.col("k") < F.least(F.lit(max_lag), F.floor(F.col("n") / 2))) & (F.col("s") > 0) & (F.col("n") >= 20)
    return long.groupBy(key).agg(F.regr_slope(F.when(ok, F.log("s")), F.when(ok, F.log("k"))).alias("hurst"))


def variance_ratio(series: DataFrame, lags: tuple[int, ...] = (2, 4, 8, 16), key: str = "symbol", value: str = "close") -> DataFrame:
    """(key, lag, vr): variance of q-step changes over q times that of one step; NULL under 2 q changes or without variation.

    Changes are differences of the values as they are; give logarithms for log changes.
    """
    w = Window.partitionBy(key).orderBy("ts")
    x = F.col(value)
    d = series.where(x.isNotNull()).select(key, (x - F.lag(x).over(w)).alias("r1"), *((x - F.lag(x, q).over(w)).alias(f"r{q}") for q in lags))
    g = d.groupBy(key).agg(F.count("r1").alias("n"), F.var_samp("r1").alias("v"), *(F.var_samp(f"r{q}").alias(f"v{q}") for q in lags))
    ratios = (F.struct(F.lit(q).alias("lag"), F.when(F.col("n") >= 2 * q, F.try_divide(F.col(f"v{q}"), q * F.col("v"))).alias("vr")) for q in lags)
    return g.select(key, F.explode(F.array(*ratios)).alias("e")).select(key, "e.*")


# The response surface of Dickey-Fuller p-values with a constant (MacKinnon 1994): break, lower and
# upper polynomial in the statistic, and where the p-value is 0 or 1.
SURFACE = {"star": -1.61, "min": -18.83, "max": 2.74, "small": (2.1659, 1.4412, 0.038269), "large": (1.7339, 0.93202, -0.12745, -0.010368)}


def adf_statistic(x: np.ndarray, max_lag: int | None = None) -> float:
    """The augmented Dickey-Fuller statistic with a constant; the lag by AIC over one common sample."""
    x = np.asarray(x, float)
    n = len(x)
    if n < 12 or x.std() == 0:
        return math.nan
    top = max_lag if max_lag is not None else min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)
    dx = np.diff(x)

    def fit(lag: int, skip: int) -> tuple[float, float]:
        y = dx[skip:]
        cols = [x[skip:-1], *(dx[skip - i : -i] for i in range(1, lag + 1)), np.ones(len(y))]
        a = np.column_stack(cols)
        beta, *_ = np.linalg.lstsq(a, y, rcond=None)
        resid = y - a @ beta
        sse = float(resid @ resid)
        aic = len(y) * math.log(max(sse, 1e-300) / len(y)) + 2 * a.shape[1]
        cov = np.linalg.pinv(a.T @ a)[0, 0] * sse / max(1, len(y) - a.shape[1])
        return aic, float(beta[0] / math.sqrt(max(cov, 1e-300)))

    best = min(range(top + 1), key=lambda k: fit(k, top)[0])
    return fit(best, best)[1]


def adf_p(stat: float) -> float:
    from statistics import NormalDist

    s = SURFACE
    if stat != stat:
        return math.nan
    if stat > s["max"]:
        return 1.0
    if stat < s["min"]:
        return 0.0
    coef = s["small"] if stat <= s["star"] else s["large"]
    return NormalDist().cdf(sum(c * stat**i for i, c in enumerate(coef)))


def adf(series: DataFrame, key: str = "symbol", value: str = "close") -> DataFrame:
    """(key, stat, p): one series per group in memory; series of bars, not of ticks."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        s = adf_statistic(f.sort_values("ts")[value].dropna().to_numpy())
        return pd.DataFrame({key: [f[key].iloc[0]], "stat": [s], "p": [adf_p(s)]})

    kind = dict(series.dtypes)[key]
    return series.select(key, "ts", value).groupBy(key).applyInPandas(run, f"`{key}` {kind}, stat double, p double")


# The 5 % critical value with a constant by sample size n, as a polynomial in 1/n (MacKinnon 2010).
CRITICAL_5 = (-2.86154, -2.8903, -4.234, -40.040)


def frac_diff_table(series: DataFrame, grid: tuple[float, ...] = tuple(i / 10 for i in range(11)), thresh: float = 1e-5, value: str = "close") -> DataFrame:
    """(symbol, d, stat, p, critical, corr, stationary) of the fractionally differenced series, per order ``d``.

    Under ten values or without variation an order isn't stationary and has no
    statistics. One symbol's differenced series is in memory at a time.
    """
    from .microstructure import frac_diff

    parts = [frac_diff(series, d, thresh, value).join(series.select("symbol", "ts", F.col(value).alias("x")), ["symbol", "ts"]).withColumn("d", F.lit(float(d))) for d in grid]
    every = series.select("symbol").distinct().withColumn("d", F.explode(F.array(*map(F.lit, map(float, grid)))))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("ts")
        y, n, row = f["frac_diff"].to_numpy(float), len(f), {"symbol": f["symbol"].iloc[0], "d": f["d"].iloc[0]}
        if n < 10 or y.std() == 0:
            return pd.DataFrame([row | {"stat": None, "p": None, "critical": None, "corr": None, "stationary": False}])
        stat = adf_statistic(y)
        critical = sum(c / n**i for i, c in enumerate(CRITICAL_5))
        return pd.DataFrame([row | {"stat": stat, "p": adf_p(stat), "critical": critical, "corr": float(np.corrcoef(f["x"], y)[0, 1]), "stationary": bool(stat < critical)}])

    found = both.groupBy("symbol", "d").applyInPandas(run, "symbol string, d double, stat double, p double, critical double, corr double, stationary boolean")
    return every.join(found, ["symbol", "d"], "left").withColumn("stationary", F.coalesce("stationary", F.lit(False)))


def least_d(table: DataFrame) -> DataFrame:
    """(symbol, d, corr): the smallest stationary order of ``frac_diff_table``; NULL where none is."""
    return table.groupBy("symbol").agg(F.min(F.when(F.col("stationary"), F.struct("d", "corr"))).alias("x")).select("symbol", "x.d", "x.corr")


def align(y: DataFrame, x: DataFrame, value: str = "close") -> DataFrame:
    """(ts, y, x): common times with both values."""
    return y.select("ts", F.col(value).alias("y")).join(x.select("ts", F.col(value).alias("x")), "ts").where("y is not null and x is not null")


def hedge_ratios(pairs: DataFrame, key: str = "pair") -> DataFrame:
    """(key, ols, tls): slopes of y on x, by least squares and orthogonal to the line."""
    g = pairs.groupBy(key).agg(F.regr_slope("y", "x").alias("ols"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.covar_samp("x", "y").alias("c"))
    d = F.col("vy") - F.col("vx")
    return g.select(key, "ols", F.try_divide(d + F.sqrt(d * d + 4 * F.col("c") ** 2), 2 * F.col("c")).alias("tls"))


def spread(pairs: DataFrame, beta: DataFrame, key: str = "pair") -> DataFrame:
    return pairs.join(beta, key).withColumn("spread", F.col("y") - F.col("ols") * F.col("x"))


def cadf(pairs: DataFrame, key: str = "pair") -> DataFrame:
    """(key, beta, stat, p): unit-root test of the residuals of y on x; the p-value is that of one series, as if the residuals were observed."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("ts")
        y, x = f["y"].to_numpy(float), f["x"].to_numpy(float)
        ok = len(y) >= 12 and x.std() > 0
        b = float(np.cov(x, y)[0, 1] / x.var(ddof=1)) if ok else math.nan
        s = adf_statistic(y - b * x - (y - b * x).mean()) if ok else math.nan
        return pd.DataFrame({key: [f[key].iloc[0]], "beta": [b], "stat": [s], "p": [adf_p(s)]})

    kind = dict(pairs.dtypes)[key]
    return pairs.select(key, "ts", "y", "x").groupBy(key).applyInPandas(run, f"`{key}` {kind}, beta double, stat double, p double")


# 95 % critical values of the trace statistic with a constant, by number of common trends.
TRACE_95 = (3.8415, 15.4943, 29.7961, 47.8545, 69.8189, 95.7542)


def johansen(prices: np.ndarray, k_ar_diff: int = 1) -> dict:
    """Trace statistics (rank 0 first), their critical values, eigenvalues and vectors of one basket, on the driver."""
    x = np.asarray(prices, float)
    dx = np.diff(x, axis=0)
    z = np.hstack([dx[k_ar_diff - i : len(dx) - i] for i in range(1, k_ar_diff + 1)]) if k_ar_diff else np.zeros((len(dx), 0))
    y, level = dx[k_ar_diff:], x[k_ar_diff:-1]
    y, level, z = (a - a.mean(axis=0) for a in (y, level, z))
    if z.shape[1]:
        y, level = (a - z @ np.linalg.lstsq(z, a, rcond=None)[0] for a in (y, level))
    n = len(y)
    s00, s11, s01 = y.T @ y / n, level.T @ level / n, y.T @ level / n
    m = np.linalg.solve(s11, s01.T @ np.linalg.solve(s00, s01))
    values, vectors = np.linalg.eig(m)
    order = np.argsort(-values.real)
    values, vectors = np.clip(values.real[order], 0, 1 - 1e-12), vectors.real[:, order]
    trace = [float(-n * np.log(1 - values[r:]).sum()) for r in range(len(values))]
    return {"trace": trace, "critical": [TRACE_95[len(values) - 1 - r] for r in range(len(values))], "values": values, "vectors": vectors}


class Kalman:
    """Regression with drifting coefficients: beta and alpha follow random walks."""

    def __init__(self, delta: float = 1e-4, r: float = 1e-3):
        self.q, self.r = delta / (1 - delta), r
        self.beta = self.alpha = 0.0
        self.p = (1.0, 0.0, 1.0)  # of (beta, beta), (beta, alpha), (alpha, alpha)
        self.drift = 0.0  # none before the first row

    def step(self, ts, y, x):
        p0, p1, p2 = self.p[0] + self.drift, self.p[1], self.p[2] + self.drift
        self.drift = self.q
        e = y - (self.beta * x + self.alpha)
        g0, g1 = p0 * x + p1, p1 * x + p2
        s = g0 * x + g1 + self.r
        k0, k1 = g0 / s, g1 / s
        self.beta += k0 * e
        self.alpha += k1 * e
        self.p = (p0 - k0 * g0, p1 - k0 * g1, p2 - k1 * g1)
        return (ts, self.beta, self.alpha, e, math.sqrt(s), e / math.sqrt(s))


def kalman_hedge(pairs: DataFrame, key: str = "pair", delta: float = 1e-4, r: float = 1e-3) -> DataFrame:
    """(key, ts, beta, alpha, innovation, sd, z) of y on x, row after row."""
    kind = dict(pairs.dtypes)["ts"]
    d = pairs.where("y is not null and x is not null")
    out = ordered_fold(d, [key], ["ts"], lambda: Kalman(delta, r), ["ts", "y", "x"], f"`at` {kind}, beta double, alpha double, innovation double, sd double, z double")
    return out.withColumnRenamed("at", "ts")
