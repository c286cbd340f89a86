"""Small studies on top of the operators: factor legs, lead and lag, targeting, searches, cross-checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import change, clip, guarded, percent_rank_avg, ratio, so_far, trailing, z_score
from .joins import asof_backward, interval_join
from .panels import long_short_returns, sector_neutralize, zscore_cross_section
from .statistics import expanding_tertile, expected_max_sharpe, psr, time_decayed_sharpe, track_moments


def factor_returns(signal: DataFrame, fwd: DataFrame, q: float = 0.2, min_assets: int = 5, value: str = "value") -> DataFrame:
    """(date, ret): mean next return of percentile ranks from 1 - q up, less that of ranks up to q; NULL under ``min_assets`` names."""
    d = signal.where(F.col(value).isNotNull()).select("date", "code", percent_rank_avg(value, ["date"]).alias("_p")).join(fwd.select("date", "code", "fwd_ret"), ["date", "code"], "left")
    g = d.groupBy("date").agg(F.count("_p").alias("_n"), F.avg(F.when(F.col("_p") >= 1 - q, F.col("fwd_ret"))).alias("_t"), F.avg(F.when(F.col("_p") <= q, F.col("fwd_ret"))).alias("_b"))
    return g.select("date", F.when(F.col("_n") >= min_assets, F.col("_t") - F.col("_b")).alias("ret"))


def leg_decomposition(signal: DataFrame, fwd: DataFrame, q: float = 0.2, value: str = "value") -> DataFrame:
    """(date, top, bottom, universe): mean next returns of names that have one; it conditions on the outcome, for diagnosis only."""
    d = signal.join(fwd, ["date", "code"]).where(F.col(value).isNotNull() & F.col("fwd_ret").isNotNull())
    d = d.select("date", "fwd_ret", percent_rank_avg(value, ["date"]).alias("_p"))
    return d.groupBy("date").agg(F.avg(F.when(F.col("_p") > 1 - q, F.col("fwd_ret"))).alias("top"), F.avg(F.when(F.col("_p") <= q, F.col("fwd_ret"))).alias("bottom"), F.avg("fwd_ret").alias("universe"))


def orthogonalize(df: DataFrame, a: str, b: str, least: int = 10, out: str = "orth") -> DataFrame:
    """Per date, what b leaves of a, as a z-score (n - 1); a itself under ``least`` complete rows."""
    w = Window.partitionBy("date")
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    y, x = F.when(both, F.col(a)), F.when(both, F.col(b))
    beta = F.try_divide(F.covar_samp(y, x).over(w), F.var_samp(x).over(w))
    d = df.withColumn("_r", F.when(F.count(y).over(w) >= least, y - beta * x))
    return d.withColumn(out, F.coalesce(z_score("_r", w, 1), F.when(F.count("_r").over(w) == 0, F.col(a)))).drop("_r")


def quantile_turnover(before: DataFrame, after: DataFrame, on: tuple[str, ...] = ("date", "code")) -> DataFrame:
    """(date, changed): share of the members before that are no members after; two tables of members."""
    d = before.select(*on).withColumn("_b", F.lit(1)).join(after.select(*on).withColumn("_a", F.lit(1)), list(on), "left")
    return d.groupBy("date").agg((1 - F.count("_a") / F.count("_b")).alias("changed"))


def factor_correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """(corr, n): mean over dates of the cross-section correlation."""
    return df.groupBy("date").agg(F.corr(a, b).alias("_c")).agg(F.avg("_c").alias("corr"), F.count("_c").alias("n"))


def flow_lead_lag(flows: DataFrame, index: DataFrame) -> DataFrame:
    """(same, ahead, up, down): correlation of weekly flows with the index's return of the same and the next week, and mean next returns by the flow's sign."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    d = asof_backward(flows, index.withColumnRenamed("date", "_d"), "date", "_d", ["close"])
    d = d.withColumn("_r", change("close", w)).withColumn("_next", F.lead("_r").over(w))
    up = F.col("net_flow") > 0
    return d.agg(F.corr("net_flow", "_r").alias("same"), F.corr("net_flow", "_next").alias("ahead"), F.avg(F.when(up, F.col("_next"))).alias("up"), F.avg(F.when(~up, F.col("_next"))).alias("down"))


def vol_target_weights(vol: DataFrame, cap: float = 3.0, value: str = "vol") -> DataFrame:
    """(date, weight): the median volatility over the date's, between 0 and the cap; uses the whole sample's median."""
    m = vol.agg(F.percentile(value, 0.5).alias("_m"))
    return vol.join(F.broadcast(m)).select("date", clip(F.try_divide("_m", F.col(value)), 0.0, cap).alias("weight"))


def regression_alpha(df: DataFrame, y: str, x: str) -> DataFrame:
    """(alpha, beta, t): intercept with its t-statistic, from sums."""
    g = df.agg(F.regr_intercept(y, x).alias("alpha"), F.regr_slope(y, x).alias("beta"), F.regr_count(y, x).alias("n"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.regr_avgx(y, x).alias("mx"))
    s2 = (F.col("syy") - F.col("sxy") ** 2 / F.col("sxx")) / (F.col("n") - 2)
    return g.select("alpha", "beta", (F.col("alpha") / F.sqrt(s2 * (1 / F.col("n") + F.col("mx") ** 2 / F.col("sxx")))).alias("t"))


def residual_alpha(pairs: DataFrame, a: str, b: str, out: str = "resid") -> DataFrame:
    """b less what a explains of it, over all rows."""
    m = pairs.agg(F.corr(a, b).alias("_c"), F.stddev_samp(a).alias("_sa"), F.stddev_samp(b).alias("_sb"))
    return pairs.join(F.broadcast(m)).withColumn(out, F.col(b) - F.col("_c") * F.try_divide("_sb", "_sa") * F.col(a)).drop("_c", "_sa", "_sb")


def seasonality(returns: DataFrame, top: int = 3) -> DataFrame:
    """(month, mean): the best calendar months."""
    return returns.groupBy(F.month("date").alias("month")).agg(F.avg("ret").alias("mean")).orderBy(F.desc("mean"), "month").limit(top)


def shifted_crosscheck(ours: DataFrame, theirs: DataFrame, shift: int = 0) -> DataFrame:
    """(corr, same_sign, n) of two monthly series, theirs ``shift`` months later."""
    a = ours.select(F.trunc("date", "MM").alias("_m"), F.col("ret").alias("a"))
    b = theirs.select(F.add_months(F.trunc("date", "MM"), -shift).alias("_m"), F.col("ret").alias("b"))
    return a.join(b, "_m").where("a is not null and b is not null").agg(F.corr("a", "b").alias("corr"), F.avg((F.signum("a") == F.signum("b")).cast("double")).alias("same_sign"), F.count(F.lit(1)).alias("n"))


def pair_candidates(liquidity: DataFrame, sectors: DataFrame, per_sector: int = 8) -> DataFrame:
    """(sector, a, b): pairs among the most liquid names of each sector; at most ``per_sector`` choose 2 each."""
    d = liquidity.join(sectors, "code")
    d = d.withColumn("_k", F.row_number().over(Window.partitionBy("sector").orderBy(F.desc("turnover"), "code"))).where(F.col("_k") <= per_sector)
    return d.select("sector", F.col("code").alias("a")).join(d.select("sector", F.col("code").alias("b")), "sector").where("a < b")


def event_returns(prices: DataFrame, windows: DataFrame) -> DataFrame:
    """(code, side, start, end, total): compound return of each leg inside its holding window, times its side."""
    w = Window.partitionBy("code").orderBy("date")
    r = prices.select("date", "code", (ratio("close", F.lag("close").over(w)) - 1).alias("_r"))
    d = interval_join(r, windows, "date", "start", "end", by=["code"], unit="month").where(F.col("date") > F.col("start"))
    return d.groupBy("code", "side", "start", "end").agg((F.col("side") * (F.product(1 + F.coalesce("_r", F.lit(0.0))) - 1)).alias("total"))


def nav_on_next_label(returns: DataFrame) -> DataFrame:
    """(date, nav): the value after a date's return stands at the next date, so that its change there is that return."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    return returns.select(F.lead("date").over(w).alias("date"), F.product(1 + F.coalesce("ret", F.lit(0.0))).over(so_far(w)).alias("nav")).where("date is not null")


def move_health(px: DataFrame, limit: float = 0.08) -> DataFrame:
    """(code, n, start, end, jumps): rows, range, and how many moves exceed the limit."""
    w = Window.partitionBy("code").orderBy("date")
    d = px.withColumn("_m", F.abs(change("close", w)))
    return d.groupBy("code").agg(F.count("close").alias("n"), F.min("date").alias("start"), F.max("date").alias("end"), F.count_if(F.col("_m") > limit).alias("jumps"))


def invested_share(weights: DataFrame, dates: DataFrame) -> DataFrame:
    """(share): dates with a position over all dates."""
    d = dates.select("date").distinct().join(weights.select("date").distinct().withColumn("_w", F.lit(1)), "date", "left")
    return d.agg((F.count("_w") / F.count(F.lit(1))).alias("share"))


def order_rows(equity: DataFrame, lots: DataFrame) -> DataFrame:
    """Orders of both kinds as one table (kind, code, quantity, notional)."""
    a = equity.select(F.lit("equity").alias("kind"), "code", F.col("shares").cast("double").alias("quantity"), "notional")
    return a.unionByName(lots.select(F.lit("lots").alias("kind"), "code", F.col("lots").alias("quantity"), F.col("filled").alias("notional")))


def two_sided(returns: DataFrame, by: list[str], variance: float, n_trials: int, halflife: float = 36.0, ann: float = 12.0, value: str = "ret", least: int = 8) -> DataFrame:
    """(by, sharpe, decayed, dsr, side): the better of a record and its mirror image; ``side`` is 1 or -1.

    NULL under ``least`` returns or without variance. The trials' variance and number are given.
    """
    m = track_moments(returns, by, value)
    best = F.lit(expected_max_sharpe(n_trials, variance))
    up = psr(F.col("sr"), best, F.col("n_obs"), F.col("skew"), F.col("kurt"))
    down = psr(-F.col("sr"), best, F.col("n_obs"), -F.col("skew"), F.col("kurt"))
    late = time_decayed_sharpe(returns, by, halflife, ann, value).withColumnRenamed("decayed_sharpe", "_late")
    d = m.join(late, by).withColumns({"_up": up, "_down": down, "_ok": (F.col("n_obs") >= least) & F.col("sr").isNotNull()})
    keep = lambda c: F.when(F.col("_ok"), c)
    return d.select(*by, keep(F.col("sr") * ann**0.5).alias("sharpe"), keep(F.col("_late")).alias("decayed"), keep(F.greatest("_up", "_down")).alias("dsr"), keep(F.when(F.col("_up") >= F.col("_down"), 1).otherwise(-1)).alias("side"))


def evaluate_factor(factor: DataFrame, sectors: DataFrame, fwd: DataFrame, quantile: float = 0.2, costs_bps: float = 15.0, min_names: int = 20, least: int = 8, ann: float = 12.0) -> DataFrame:
    """(n, mean, sharpe, sharpe_ann) of a factor made neutral to sectors, scaled and traded long and short; NULL under ``least`` dates.

    ``factor``: date, code, value.
    """
    z = zscore_cross_section(sector_neutralize(factor, sectors))
    r = long_short_returns(z, fwd, quantile=quantile, costs_bps=costs_bps, min_names=min_names)
    g = r.agg(F.count("net").alias("n"), F.avg("net").alias("mean"), F.stddev_samp("net").alias("_sd"))
    ok = (F.col("n") >= least) & (F.col("_sd") > 0)
    sr = F.when(ok, F.col("mean") / F.col("_sd"))
    return g.select("n", F.when(ok, F.col("mean")).alias("mean"), sr.alias("sharpe"), (sr * ann**0.5).alias("sharpe_ann"))


def split_evidence(returns: DataFrame, split: str, by: list[str], ann: float = 12.0, value: str = "ret", least: int = 8) -> DataFrame:
    """(by, sharpe_in, sharpe_out, psr_out, hit_out): a record before and from ``split`` on; NULL under ``least`` returns."""
    late = F.col("date") >= F.lit(split).cast("timestamp")
    d = returns.where(F.col(value).isNotNull())
    before, after = (track_moments(d.where(c), by, value).where((F.col("n_obs") >= least) & F.col("sr").isNotNull()) for c in (~late, late))
    hit = d.where(late).groupBy(*by).agg(F.avg((F.col(value) > 0).cast("double")).alias("_hit"))
    a = before.select(*by, (F.col("sr") * ann**0.5).alias("sharpe_in"))
    b = after.join(hit, by).select(*by, (F.col("sr") * ann**0.5).alias("sharpe_out"), psr(F.col("sr"), F.lit(0.0), F.col("n_obs"), F.col("skew"), F.col("kurt")).alias("psr_out"), F.col("_hit").alias("hit_out"))
    return d.select(*by).distinct().join(a, by, "left").join(b, by, "left")


def align_sleeves(base: DataFrame, other: DataFrame) -> DataFrame:
    """(date, base, other): returns of the same month, each from a calendar of its own, at the base's date.

    The other sleeve's last row of a month counts; months without both drop out.
    """
    month = F.trunc("date", "MM").alias("_m")
    o = other.groupBy(month).agg(F.max_by("ret", "date").alias("other"))
    b = base.groupBy(month).agg(F.min("date").alias("date"), F.min_by("ret", "date").alias("base"))
    return b.join(o, "_m").where("base is not null and other is not null").select("date", "base", "other")


def mask_to_days(mask: DataFrame, days: DataFrame) -> DataFrame:
    """(date, code, member): a month's members (date, code, member) on every later day up to the next month's; no member before or if absent.

    One row per day and name that is ever a member. Days find their month by one
    as-of over dates alone, so that a name missing from the newest month isn't carried on.
    """
    months = mask.select(F.col("date").alias("_m")).distinct()
    placed = asof_backward(days.select("date").distinct(), months.withColumn("_at", F.col("_m")), "date", "_m", ["_at"])
    names = mask.where("member").select("code").distinct()
    packed = placed.agg(F.collect_list(F.struct("date", "_at")).alias("_d"))  # one row: days of a calendar
    grid = names.join(F.broadcast(packed)).select("code", F.explode("_d").alias("d")).select("d.date", "code", "d._at")
    now = mask.select(F.col("date").alias("_at"), "code", "member")
    return grid.join(now, ["_at", "code"], "left").select("date", "code", F.coalesce("member", F.lit(False)).alias("member"))


def mask_out(factor: DataFrame, events: DataFrame, value: str = "value") -> DataFrame:
    """A factor without its values where ``events`` (date, code, flagged) are flagged."""
    d = factor.join(events.where("flagged").select("date", "code", F.lit(True).alias("_f")).distinct(), ["date", "code"], "left")
    return d.withColumn(value, F.when(F.col("_f").isNull(), F.col(value))).drop("_f")


def own_momentum_labels(returns: DataFrame, lookback: int = 12, min_periods: int = 36) -> DataFrame:
    """(date, ret, sign, tertile): a track record beside the sign and the tertile so far of its own past ``lookback`` returns."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    past = w.rowsBetween(-lookback, -1)
    trail = F.when(F.count("ret").over(past) == lookback, F.sum("ret").over(past))
    d = returns.select("date", "ret", trail.alias("trail"))
    t = expanding_tertile(d.select("date", "trail"), "trail", min_periods, out="tertile")
    return d.join(t, "date").select("date", "ret", F.when(F.col("trail") != 0, F.signum("trail")).alias("sign"), "tertile")


def volatility_targets(bars: DataFrame, horizon: int = 6) -> DataFrame:
    """(symbol, ts, rv5, rv10, rv_h, absret, ret, logvol, cur_logvol, t_vol, t_ret): features known at each bar and the outcomes ``horizon`` bars ahead.

    Rows with a missing value drop out. The outcomes are the log deviation and the return of the next ``horizon`` bars.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    d = bars.select("symbol", "ts", "close", "volume", (ratio("close", F.lag("close").over(w)) - 1).alias("ret"))
    d = d.withColumns({n: guarded(F.stddev_samp("ret"), "ret", trailing(w, k), k) for n, k in (("rv5", 5), ("rv10", 10), ("rv_h", horizon))})
    log = lambda c: F.when(F.col(c) > 0, F.log(c))
    d = d.withColumns({"absret": F.abs("ret"), "logvol": log("volume"), "cur_logvol": log("rv_h"), "t_ret": ratio(F.lead("close", horizon).over(w), "close") - 1})
    d = d.withColumn("t_vol", F.lead("cur_logvol", horizon).over(w))
    return d.select("symbol", "ts", "rv5", "rv10", "rv_h", "absret", "ret", "logvol", "cur_logvol", "t_vol", "t_ret").dropna()


def r_squared(predictions: DataFrame, actual: str = "y", predicted: str = "pred") -> DataFrame:
    """(r2, n): one less squared errors over squared deviations from the mean."""
    a, p = F.col(actual), F.col(predicted)
    d = predictions.where(a.isNotNull() & p.isNotNull())
    return d.agg((1 - F.try_divide(F.sum((a - p) ** 2), F.var_pop(a) * F.count(a))).alias("r2"), F.count(F.lit(1)).alias("n"))
