"""Equity panels: returns, momentum, universe, factors. Long tables keyed by (date, code)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import change, clip, col, guarded, keep_last, over, ratio, so_far, trailing, z_score

def by_code():
    return over("code", "date")

def by_date():
    return Window.partitionBy("date")


# Market codes of common stock.
COMMON_MARKETS = ("0111", "0112", "0113")


def month_end_rows(df: DataFrame, date: str = "date", by: Sequence[str] = (), max_back: int | None = None) -> DataFrame:
    """Rows of the last date of each month; none where it lies more than ``max_back`` days before the month's end."""
    month = F.trunc(date, "MM")
    last = df.groupBy(*by, month.alias("_m")).agg(F.max(date).alias(date))
    if max_back is not None:
        last = last.where(F.datediff(F.last_day("_m"), F.col(date)) <= max_back)
    return df.join(last.drop("_m"), [*by, date], "left_semi")


def forward_returns(px: DataFrame, price: str = "close", pad: bool = False) -> DataFrame:
    """(date, code, fwd_ret): what the next row brings; an outcome, not a feature."""
    back = px.select("date", "code", change(price, by_code(), pad=pad).alias("ret"))
    return back.select("date", "code", F.lead("ret").over(by_code()).alias("fwd_ret"))


def trailing_momentum(px: DataFrame, lookback: int = 12, skip: int = 1, price: str = "close") -> DataFrame:
    m = ratio(F.lag(price, skip).over(by_code()), F.lag(price, lookback).over(by_code())) - 1
    return px.select("date", "code", m.alias("momentum"))


def filter_common_stocks(listed: DataFrame) -> DataFrame:
    market = next((c for c in ("Mkt", "MarketCode") if c in listed.columns), None)
    return listed.where(F.col(market).isin(*COMMON_MARKETS)) if market else listed


def select_universe(px: DataFrame, top_n: int = 500, min_obs: int = 12, turnover: str = "turnover") -> DataFrame:
    """Top codes by median turnover over the full period; looks ahead, for exploration only."""
    g = px.groupBy("code").agg(F.count(turnover).alias("obs"), F.percentile(turnover, 0.5).alias("median_turnover"))
    return g.where(F.col("obs") >= min_obs).orderBy(F.desc("median_turnover"), "code").limit(top_n)


def point_in_time_universe(px: DataFrame, top_n: int = 300, lookback: int = 12, min_obs: int = 6, turnover: str = "turnover") -> DataFrame:
    """(date, code, member): top codes by trailing median turnover among those that trade on the date."""
    w = trailing(by_code(), lookback)
    med = F.when((F.count(turnover).over(w) >= min_obs) & F.col(turnover).isNotNull(), F.percentile(turnover, 0.5).over(w))
    ranked = px.select("date", "code", med.alias("_med"))
    rn = F.row_number().over(Window.partitionBy("date").orderBy(F.desc_nulls_last("_med"), "code"))
    return ranked.withColumn("_rn", rn).select("date", "code", (F.col("_med").isNotNull() & (F.col("_rn") <= top_n)).alias("member"))


def universe_members(mask: DataFrame) -> DataFrame:
    return mask.where("member").select("code").distinct()


def apply_universe_mask(factor: DataFrame, mask: DataFrame, value: str = "value") -> DataFrame:
    joined = factor.join(mask.select("date", "code", "member"), ["date", "code"], "left")
    return joined.withColumn(value, F.when(F.col("member"), F.col(value))).drop("member")


def market_cap(price: Column, shares: Column, treasury: Column | None = None) -> Column:
    """Price times shares less treasury stock; one missing side counts 0, no shares give NULL."""
    t = treasury if treasury is not None else F.lit(None).cast("double")
    net = F.when(shares.isNotNull() | t.isNotNull(), F.coalesce(shares, F.lit(0.0)) - F.coalesce(t, F.lit(0.0)))
    return F.when(net > 0, price * net)


def value_quality_size_factors(pit: DataFrame, lookback: int = 12, skip: int = 1, adjusted: str = "adj_close") -> DataFrame:
    """Ratios over one joined row of price and point-in-time facts, larger being cheaper, better or smaller.

    ``pit``: date, code, close (raw), and of ShOutFY, TrShFY, FEPS, Eq, CFO, FSales,
    FDivAnn, FNP, TA, FOP, EqAR, NP what there is (a missing column is NULL);
    with an ``adjusted`` price there is momentum, too.
    """
    have = set(pit.columns)
    f = lambda name: F.col(name) if name in have else F.lit(None).cast("double")
    cap = market_cap(F.col("close"), f("ShOutFY"), f("TrShFY"))
    out = {
        "earnings_yield": ratio(f("FEPS"), "close"),
        "book_to_market": ratio(f("Eq"), cap),
        "cf_yield": ratio(f("CFO"), cap),
        "sales_yield": ratio(f("FSales"), cap),
        "div_yield": ratio(f("FDivAnn"), "close"),
        "roe": ratio(f("FNP"), f("Eq")),
        "roa": ratio(f("FNP"), f("TA")),
        "op_margin": ratio(f("FOP"), f("FSales")),
        "equity_ratio": f("EqAR"),
        "accruals": ratio(f("CFO") - f("NP"), f("TA")),
        "size": F.when(cap > 0, -F.log(cap)),
    }
    if adjusted in have:
        by = by_code()
        out["momentum"] = ratio(F.lag(adjusted, skip).over(by), F.lag(adjusted, lookback).over(by)) - 1
    return pit.select("date", "code", *(c.alias(name) for name, c in out.items()))


def low_volatility(px: DataFrame, window: int = 12, price: str = "close", pad: bool = True) -> DataFrame:
    r = px.select("date", "code", change(price, by_code(), pad=pad).alias("_r"))
    w = trailing(by_code(), window)
    return r.select("date", "code", (-guarded(F.stddev_samp("_r"), "_r", w, max(2, window // 2))).alias("low_vol"))


def residual_momentum(returns: DataFrame, window: int = 36, length: int = 12, skip: int = 1, standardize: bool = True) -> DataFrame:
    """Sum of residuals against the market over rows t-length to t-1-skip, the regression over the ``window`` rows before t.

    ``returns`` has (date, code, ret, market). Needs the full window. With a
    fixed fit per row, the sums of residuals and of their squares follow from
    rolling sums, so that no row is revisited.
    """
    w = by_code().rowsBetween(-window, -1)
    seg = by_code().rowsBetween(-length, -1 - skip)
    both = F.col("ret").isNotNull() & F.col("market").isNotNull()
    y, x = F.when(both, F.col("ret")), F.when(both, F.col("market"))
    b, a = F.regr_slope(y, x).over(w), F.regr_intercept(y, x).over(w)
    n = F.count(y)
    m = F.count(y).over(seg)
    total = F.sum(y).over(seg) - a * m - b * F.sum(x).over(seg)
    sums = returns.select("date", "code", n.over(w).alias("_n"), a.alias("_a"), b.alias("_b"), m.alias("_m"), total.alias("_t"), *(F.sum(e).over(seg).alias(k) for k, e in (("_yy", y * y), ("_xx", x * x), ("_xy", x * y), ("_y", y), ("_x", x))))
    c = F.col
    squares = c("_yy") + c("_m") * c("_a") ** 2 + c("_b") ** 2 * c("_xx") - 2 * c("_a") * c("_y") - 2 * c("_b") * c("_xy") + 2 * c("_a") * c("_b") * c("_x")
    var = (squares - c("_t") ** 2 / c("_m")) / (c("_m") - 1)
    value = F.when(var > 1e-18, c("_t") / F.sqrt(var)) if standardize else c("_t")
    return sums.select("date", "code", F.when((c("_n") >= window) & (c("_m") > 1), value).alias("resid_mom"))


def zscore_cross_section(df: DataFrame, value: str = "value", winsor: float | None = 3.0, ddof: int = 0) -> DataFrame:
    z = z_score(value, by_date(), ddof)
    return df.withColumn(value, clip(z, -winsor, winsor) if winsor else z)


def sector_neutralize(df: DataFrame, sectors: DataFrame, value: str = "value") -> DataFrame:
    """Less the mean of the date's sector; codes without one form a sector of their own. ``sectors``: (code, sector)."""
    known = df.join(sectors.select("code", F.col("sector").cast("string").alias("_s")), "code", "left").withColumn("_s", F.coalesce("_s", F.lit("NA")))
    return known.withColumn(value, F.col(value) - F.avg(value).over(Window.partitionBy("date", "_s"))).drop("_s")


def residualize(df: DataFrame, target: str, controls: Sequence[str], out: str = "resid") -> DataFrame:
    """Residuals of a per-date regression with intercept; NULL under k + 3 complete rows.

    One control stays in SQL; more go through the normal equations, whose sums
    are aggregated per date, so that only k x k numbers per date meet in a task.
    """
    k = len(controls)
    full = F.col(target).isNotNull()
    for c in controls:
        full = full & F.col(c).isNotNull()
    n = F.count(F.when(full, 1)).over(by_date())
    if k == 1:
        y, x = F.when(full, F.col(target)), F.when(full, F.col(controls[0]))
        fit = F.regr_intercept(y, x).over(by_date()) + F.regr_slope(y, x).over(by_date()) * x
        return df.withColumn(out, F.when(n >= k + 3, y - fit))
    terms = [F.lit(1.0), *(F.col(c).cast("double") for c in controls)]
    sums = df.where(full).groupBy("date").agg(F.count(F.lit(1)).alias("_n"), F.array(*(F.sum(a * b) for a in terms for b in terms)).alias("_a"), F.array(*(F.sum(a * F.col(target)) for a in terms)).alias("_b"))

    @F.pandas_udf("array<double>")
    def solve(a, b):
        import numpy as np
        import pandas as pd

        return pd.Series([np.linalg.lstsq(np.reshape(x, (k + 1, k + 1)), np.asarray(y), rcond=None)[0] for x, y in zip(a, b)])

    beta = sums.where(F.col("_n") >= k + 3).select("date", solve("_a", "_b").alias("_beta"))
    fit = sum((F.col("_beta")[i] * t for i, t in enumerate(terms)), F.lit(0.0))
    return df.join(beta, "date", "left").withColumn(out, F.when(full, F.col(target) - fit)).drop("_beta")


def quantile_weights(df: DataFrame, value: str = "value", quantile: float = 0.2, min_names: int = 20, long_only: bool = False) -> DataFrame:
    """(date, code, weight): equal weights long the top and short the bottom ``max(1, floor(n q))`` names.

    No weights under ``min_names`` names. Ties go by code; a name in both groups is short.
    """
    d = df.where(F.col(value).isNotNull())
    n = F.count(F.lit(1)).over(by_date())
    k = F.greatest(F.lit(1), F.floor(n * quantile))
    up = F.row_number().over(Window.partitionBy("date").orderBy(F.desc(value), "code"))
    down = F.row_number().over(Window.partitionBy("date").orderBy(value, F.desc("code")))
    d = d.select("date", "code", n.alias("_n"), k.alias("_k"), up.alias("_up"), down.alias("_down")).where(F.col("_n") >= max(2, min_names))
    side = F.when(F.col("_up") <= F.col("_k"), 1 / F.col("_k"))
    if not long_only:
        side = F.when(F.col("_down") <= F.col("_k"), -1 / F.col("_k")).otherwise(side)
    return d.select("date", "code", side.alias("weight")).where("weight is not null")


def long_short_returns(factor: DataFrame, fwd: DataFrame, value: str = "value", quantile: float = 0.2, costs_bps: float = 0.0, min_names: int = 20) -> DataFrame:
    """(date, gross, turnover, net): sum of weight times next return, less costs on the change of weights.

    A date without weights resets them. Absent returns count 0. Turnover pairs
    each name with the previous date by position, so that a name that leaves
    is charged on the date after its last one.
    """
    w = quantile_weights(factor, value, quantile, min_names)
    dates = factor.select("date").distinct().withColumn("_pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")))
    w = w.join(dates, "date")
    after = w.select((F.col("_pos") + 1).alias("_pos"), "code", F.col("weight").alias("held"))
    live = w.select("_pos").distinct()
    # leavers are charged only where the next date has weights
    both = w.select("_pos", "code", "weight").join(after.join(live, "_pos", "left_semi"), ["_pos", "code"], "full").fillna(0.0, ["weight", "held"])
    both = both.join(dates, "_pos").join(fwd.select("date", "code", "fwd_ret"), ["date", "code"], "left")
    g = both.groupBy("date").agg(F.sum(F.col("weight") * F.coalesce("fwd_ret", F.lit(0.0))).alias("gross"), F.sum(F.abs(F.col("weight") - F.col("held"))).alias("turnover"))
    return g.withColumn("net", F.col("gross") - costs_bps / 1e4 * F.col("turnover"))


def back_adjust(px: DataFrame, factor: str = "adj_factor", fields: Sequence[str] = ("close",)) -> DataFrame:
    """Prices times all later split factors; a null factor is 1."""
    later = by_code().rowsBetween(1, Window.unboundedFollowing)
    cum = F.coalesce(F.product(F.coalesce(F.col(factor), F.lit(1.0))).over(later), F.lit(1.0))
    return px.withColumn("_cum", cum).withColumns({f"adj_{f}": F.col(f) * F.col("_cum") for f in fields}).drop("_cum")


def mean_of_available(frames: Sequence[DataFrame], value: str = "value") -> DataFrame:
    """Per (date, code), the mean of whatever frames have a value."""
    out = frames[0].select("date", "code", value)
    for f in frames[1:]:
        out = out.unionByName(f.select("date", "code", value))
    return out.groupBy("date", "code").agg(F.avg(value).alias(value))


def rank_ic(df: DataFrame, a: str, b: str) -> DataFrame:
    """(date, ic): rank correlation per date over complete rows, average ties."""
    from ..functions.semantics import percent_rank_avg

    full = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    r = full.select("date", percent_rank_avg(a, ["date"]).alias("_a"), percent_rank_avg(b, ["date"]).alias("_b"))
    return r.groupBy("date").agg(F.corr("_a", "_b").alias("ic"))


def assemble_panel(snapshots: DataFrame, value: str, seq: Sequence[str]) -> DataFrame:
    return keep_last(snapshots, ["date", "code"], seq).select("date", "code", value)


def to_wide(panel: DataFrame, value: str, codes: Sequence[str] | None = None) -> DataFrame:
    """Export only: one column per code."""
    return panel.groupBy("date").pivot("code", list(codes) if codes else None).agg(F.first(value))


def to_long(wide: DataFrame, value: str = "value") -> DataFrame:
    return wide.unpivot(["date"], [c for c in wide.columns if c != "date"], "code", value)


def price_features(px: DataFrame, vol_window: int = 20, mom_lookback: int = 252, mom_skip: int = 21, rev_window: int = 5, price: str = "close") -> DataFrame:
    """Returns, log returns, annual volatility, momentum and reversal of one dense panel."""
    r = px.withColumn("ret", change(price, by_code(), pad=True))
    w = trailing(by_code(), vol_window)
    p = col(price)
    return r.select(
        "date",
        "code",
        "ret",
        F.when(F.col("ret") > -1, F.log1p("ret")).alias("log_ret"),
        (guarded(F.stddev_samp("ret"), "ret", w, vol_window // 2) * 252**0.5).alias("vol"),
        (ratio(F.lag(p, mom_skip).over(by_code()), F.lag(p, mom_lookback).over(by_code())) - 1).alias("momentum"),
        (-(ratio(p, F.lag(p, rev_window).over(by_code())) - 1)).alias("reversal"),
    )


def rolling_adv(px: DataFrame, window: int = 20, least: int = 5, turnover: str = "turnover") -> DataFrame:
    return px.select("date", "code", guarded(F.avg(turnover), turnover, trailing(by_code(), window), least).alias("adv"))


def coverage_by_date(df: DataFrame, value: str = "value") -> DataFrame:
    return df.groupBy("date").agg(F.avg(F.col(value).isNotNull().cast("double")).alias("coverage"))


def equal_weight_market(px: DataFrame, price: str = "close", pad: bool = True) -> DataFrame:
    """(date, ret, level): the mean return of each date, compounded; one row per date."""
    r = px.select("date", change(price, by_code(), pad=pad).alias("_r")).groupBy("date").agg(F.avg("_r").alias("ret"))
    w = so_far(Window.partitionBy(F.lit(0)).orderBy("date"))
    return r.withColumn("level", F.product(1 + F.coalesce("ret", F.lit(0.0))).over(w))
