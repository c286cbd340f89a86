"""More named queries: strategies, sizing, disclosures, calendars and studies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import backtest as bt
from ..operators import bars as B
from ..operators import fundamentals as fd
from ..operators import labels, panels, production
from ..operators import market_facts as mf
from ..operators import statistics as st
from ..operators import strategies as sg
from ..operators import studies as sd
from . import relations as R
from .recursions import normal_cdf
from .registry import BOOK, FWD, LS, MOM, NEUTRAL, REGIME, _regime, _weights, momentum_factor, query, rounded, weights_sql

RET = "rets AS (SELECT date, code, close, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS r FROM panel)"

# Sizing and labels


@query(f"SELECT o_orderkey, round(2 * {normal_cdf('z')} - 1, 6) AS size FROM (SELECT o_orderkey, (p - 0.5) / sqrt(p * (1 - p)) AS z FROM (SELECT o_orderkey, greatest(1e-9, least(1 - 1e-9, o_orderkey % 101 / 100.0::DOUBLE)) AS p FROM orders))")
def bet_size(s, d):
    return rounded(R.read(s, d, "orders").select("o_orderkey", labels.bet_size(F.col("o_orderkey") % 101 / 100.0).alias("size")))


@query(f"SELECT o_orderkey, round(side * greatest(0.0, least(1.0, 2 * {normal_cdf('z')} - 1)), 6) AS position FROM (SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 1.0 ELSE -1.0 END AS side, (p - 0.5) / sqrt(p * (1 - p)) AS z FROM (SELECT o_orderkey, o_custkey, greatest(1e-9, least(1 - 1e-9, o_orderkey % 101 / 100.0::DOUBLE)) AS p FROM orders))")
def meta_position(s, d):
    side = F.when(F.col("o_custkey") % 2 == 0, 1.0).otherwise(-1.0)
    return rounded(R.read(s, d, "orders").select("o_orderkey", labels.meta_position(side, F.col("o_orderkey") % 101 / 100.0).alias("position")))


@query(f"WITH {R.BARS} SELECT symbol, ts AS t0, t1 FROM (SELECT symbol, ts, lead(ts, 7) OVER (PARTITION BY symbol ORDER BY ts) AS t1 FROM bars) WHERE t1 IS NOT NULL")
def vertical_barriers(s, d):
    b = R.bars(s, d)
    return labels.vertical_barriers(b, b.select("symbol", F.col("ts").alias("t0")), 7)


@query(f"""WITH {R.TRADES}, n AS (SELECT symbol, price, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) - 1 AS n FROM trades), b AS (SELECT symbol, n // 20 AS bar, arg_max(price, n) AS close, count(*) AS k FROM n GROUP BY 1, 2 HAVING count(*) = 20 AND arg_max(price, n) > 0),
r AS (SELECT symbol, bar, ln(close) - ln(lag(close) OVER (PARTITION BY symbol ORDER BY bar)) AS r FROM b), l AS (SELECT *, lag(r) OVER (PARTITION BY symbol ORDER BY bar) AS l FROM r),
m AS (SELECT symbol, count(r) AS n, corr(r, l) AS ac, avg(r) AS mean FROM l GROUP BY 1), c AS (SELECT symbol, any_value(n) AS n, abs(any_value(ac)) AS ac, avg((r - mean) ** 2) AS m2, avg((r - mean) ** 3) AS m3, avg((r - mean) ** 4) AS m4 FROM l JOIN m USING (symbol) WHERE r IS NOT NULL GROUP BY 1)
SELECT symbol, n, round(ac, 6) AS autocorr, round(m4 / m2 ** 2 - 3, 6) AS excess_kurtosis, round(n / 6 * (m3 ** 2 / m2 ** 3 + (m4 / m2 ** 2 - 3) ** 2 / 4), 4) AS jarque_bera FROM c""")
def bar_statistics(s, d):
    g = B.bar_statistics(B.tick_bars(R.trades(s, d), 20).where("close > 0"))
    return rounded(g.withColumn("jarque_bera", F.round("jarque_bera", 4)))


@query(f"WITH {R.BARS} SELECT symbol, date_trunc('week', ts)::TIMESTAMP AS ts, arg_max(close, ts) AS close FROM bars GROUP BY 1, 2")
def weekly_last(s, d):
    return B.resample_last(R.bars(s, d), "week", ("symbol",))


# Strategies


@query(f"WITH {R.PANEL}, g AS (SELECT date, code, open / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS g FROM panel), gap AS (SELECT date, code, 1.0 / count(*) OVER (PARTITION BY date) AS w FROM g WHERE g <= -0.1), low AS (SELECT date, code, -1.0 / count(*) OVER (PARTITION BY date) AS w FROM g WHERE g <= -0.3) SELECT date, code, round(sum(w), 6) AS weight FROM (SELECT date, code, w * 0.75 AS w FROM gap UNION ALL SELECT date, code, w * 0.25 FROM low) GROUP BY 1, 2 HAVING abs(sum(w)) > 1e-15")
def strategy_composite(s, d):
    return rounded(sg.Composite([sg.GapReversal(0.1), sg.GapReversal(0.3, side=-1)], [0.75, 0.25]).weights(R.panel(s, d)))


@query(f"WITH {R.PANEL}, z AS (SELECT date, code, CASE WHEN row_number() OVER (ORDER BY date) >= 13 THEN (close - avg(close) OVER w) / nullif(stddev_pop(close) OVER w, 0) END AS z FROM panel WHERE code = 1 WINDOW w AS (ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) SELECT date, code, round(greatest(-1.0, least(1.0, -z / 2)), 6) AS weight FROM z WHERE z <> 0")
def strategy_linear_mean_reversion(s, d):
    return rounded(sg.LinearMeanReversion(1, 12).weights(R.panel(s, d)))


@query(f"WITH {R.PANEL}, {REGIME}, sig AS (SELECT date, CASE WHEN regime = 2 THEN NULL ELSE regime END AS value FROM reg) SELECT p.date, 3 AS code, -1.0::DOUBLE AS weight FROM (SELECT DISTINCT date FROM panel) p ASOF JOIN sig ON p.date >= sig.date WHERE value > 0.5")
def strategy_signal_timing(s, d):
    signal = _regime(s, d).select("date", F.when(F.col("regime") != 2, F.col("regime")).alias("value"))
    return sg.SignalTiming(signal, 3, 0.5, side=-1).weights(R.panel(s, d))


@query(f"WITH {R.PANEL}, days AS (SELECT date, code, (code * 7 + month(date) * 13) % 60 AS days FROM panel WHERE code % 9 <> 0), l AS (SELECT date, code, days > 2 AND days <= 20 AS l FROM days), n AS (SELECT *, sum(l::INT) OVER (PARTITION BY date) AS nl, count(*) OVER (PARTITION BY date) AS n FROM l) SELECT date, code, round(CASE WHEN l THEN 1.0 / nl ELSE -1.0 / (n - nl) END, 6) AS weight FROM n WHERE nl > 0 AND nl < n")
def strategy_earnings_runup(s, d):
    p = R.panel(s, d)
    days = p.where("code % 9 <> 0").select("date", "code", ((F.col("code") * 7 + F.month("date") * 13) % 60).alias("days"))
    return rounded(sg.EarningsRunup(days).weights(p))


@query(f"WITH {R.PANEL}, {MOM}, {R.SECTORS}, {NEUTRAL}, r AS (SELECT date, code, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY value DESC, code) AS up FROM z WHERE value IS NOT NULL) SELECT date, code, round(CASE WHEN up <= greatest(1, floor(n * 0.1)) THEN 1 / greatest(1, floor(n * 0.1)) ELSE 0 END - 1 / n, 6) AS weight FROM r WHERE n >= 5")
def strategy_cross_sectional_long(s, d):
    return rounded(sg.CrossSectional(momentum_factor(s, d), 0.1, long_only=True).weights(R.panel(s, d)))


@query(f"""WITH {R.PANEL}, p AS (SELECT date, max(close) FILTER (code = 1) AS y, max(close) FILTER (code = 2) AS x FROM panel WHERE code IN (1, 2) GROUP BY 1 HAVING count(DISTINCT code) = 2),
b AS (SELECT *, row_number() OVER (ORDER BY date) AS n, covar_pop(y, x) OVER w / nullif(var_pop(x) OVER w, 0) AS b, avg(y) OVER w AS my, avg(x) OVER w AS mx, var_pop(y) OVER w AS vy, var_pop(x) OVER w AS vx, covar_pop(y, x) OVER w AS c FROM p WINDOW w AS (ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
z AS (SELECT *, (y - b * x - my + b * mx) / sqrt(vy - 2 * b * c + b * b * vx) AS z FROM b WHERE n >= 14 AND b > 0)
SELECT date, unnest([1, 2])::BIGINT AS code, round(unnest([-sign(z) * y, sign(z) * b * x]) / (y + b * x), 6) AS weight FROM z WHERE abs(z) >= 1""")
def strategy_hedged_pair(s, d):
    return rounded(sg.CointegratedPair(1, 2, 12, 1.0, max_p=None).weights(R.panel(s, d)).withColumn("code", F.col("code").cast("long")))


@query(f"WITH {BOOK}, g AS (SELECT date, sum(abs(weight)) AS g FROM weights GROUP BY 1) SELECT date, code, round(weight / g, 6) AS weight FROM weights JOIN g USING (date)")
def normalized_gross(s, d):
    return rounded(sg.normalize_gross(_weights(s, d).drop("strategy")))


# Regimes and track records


@query(f"WITH {R.DAILY}, v AS (SELECT date, CASE WHEN count(ret) OVER w >= 5 THEN stddev_samp(ret) OVER w END AS v FROM daily WINDOW w AS (ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)), r AS (SELECT a.date, a.v, count(b.v) AS n, (sum((b.v < a.v)::INT) + (sum((b.v = a.v)::INT) + 1) / 2.0) / count(b.v) AS p FROM v a JOIN v b ON b.date <= a.date GROUP BY a.date, a.v) SELECT date, CASE WHEN n >= 24 AND v IS NOT NULL THEN CASE WHEN p <= 1 / 3 THEN 0.0 WHEN p <= 2 / 3 THEN 1.0 ELSE 2.0 END END::DOUBLE AS regime FROM r")
def volatility_regime(s, d):
    return st.vol_regime(R.daily(s, d), 10, 24)


@query(f"WITH {R.SLEEVES}, e AS (SELECT date, strategy, exp(sum(ln(1 + ret)) OVER (PARTITION BY strategy ORDER BY date)) AS e FROM sleeves) SELECT date, strategy, round(ln(e), 6) AS log_equity FROM e")
def equity(s, d):
    return rounded(bt.equity_curve(R.sleeves(s, d), ["strategy"], "ret").select("date", "strategy", F.log("equity").alias("log_equity")))


@query(f"WITH {R.PANEL}, {MOM}, {R.SECTORS}, {NEUTRAL}, {FWD}, {weights_sql('z', 0.2, 5)}, {LS} SELECT 'mom' AS strategy, date, bps, round(gross, 6) AS gross, round(turnover, 6) AS turnover, round(gross - bps / 1e4 * turnover, 6) AS net FROM ls CROSS JOIN (SELECT unnest([0.0, 15.0, 50.0])::DOUBLE AS bps)")
def repriced(s, d):
    r = panels.long_short_returns(momentum_factor(s, d), panels.forward_returns(R.panel(s, d)), quantile=0.2, min_names=5)
    return rounded(bt.reprice(r.withColumn("strategy", F.lit("mom")), [0.0, 15.0, 50.0]))


STRESS = [("spring", "1995-03-01", "1995-06-01"), ("two_years", "1996-01-01", "1998-01-01")]


@query(f"WITH {R.SLEEVES}, w AS (SELECT * FROM (VALUES {', '.join(f'({n!r}, TIMESTAMP {a!r}, TIMESTAMP {b!r})' for n, a, b in STRESS)}) v(n, lo, hi)) SELECT strategy, n AS window, round(product(1 + ret) - 1, 6) AS total FROM sleeves JOIN w ON date >= lo AND date < hi GROUP BY 1, 2")
def stress_returns(s, d):
    return rounded(bt.stress_returns(R.sleeves(s, d), STRESS, ["strategy"], "ret"))


# Normal quantiles at 3/4 and at 1 - 1 / 4e, Euler's constant
BEST = "0.2 * ((1 - 0.5772156649015329) * 0.6744897501960817 + 0.5772156649015329 * 1.3287219496247633) AS best"


@query(f"WITH {R.SLEEVES}, m AS (SELECT strategy, count(ret) AS n, avg(ret) / stddev_samp(ret) AS sr, skewness(ret) AS sk, kurtosis(ret) + 3 AS ku FROM sleeves GROUP BY 1), z AS (SELECT strategy, sr, (abs(sr) - best) * sqrt(n - 1) / sqrt(1 - sk * sr + (ku - 1) / 4 * sr * sr) AS z FROM m CROSS JOIN (SELECT {BEST})), dec AS (SELECT strategy, pow(0.5, (row_number() OVER (PARTITION BY strategy ORDER BY date DESC) - 1) / 36.0) AS w, ret FROM sleeves), late AS (SELECT strategy, sum(w * ret) / sum(w) / sqrt(sum(w * ret * ret) / sum(w) - (sum(w * ret) / sum(w)) ** 2) * sqrt(12) AS late FROM dec GROUP BY 1) SELECT strategy, round(sr * sqrt(12), 6) AS sharpe, round(late, 6) AS decayed, round({normal_cdf('z')}, 6) AS dsr, CASE WHEN sr >= 0 THEN 1 ELSE -1 END AS side FROM z JOIN late USING (strategy)")
def two_sided(s, d):
    """Both sides face the same threshold and spread, so that the side is the sign of the record."""
    return rounded(sd.two_sided(R.sleeves(s, d), ["strategy"], 0.04, 4))


@query(f"WITH {R.SLEEVES}, x AS (SELECT strategy, date >= TIMESTAMP '1996-01-01' AS late, count(ret) AS n, avg(ret) / stddev_samp(ret) AS sr, skewness(ret) AS sk, kurtosis(ret) + 3 AS ku, avg((ret > 0)::INT) AS hit FROM sleeves GROUP BY 1, 2), y AS (SELECT *, sr * sqrt(n - 1) / sqrt(1 - sk * sr + (ku - 1) / 4 * sr * sr) AS z FROM x WHERE n >= 8) SELECT strategy, round(max(sr * sqrt(12)) FILTER (NOT late), 6) AS sharpe_in, round(max(sr * sqrt(12)) FILTER (late), 6) AS sharpe_out, round(max({normal_cdf('z')}) FILTER (late), 6) AS psr_out, round(max(hit) FILTER (late), 6) AS hit_out FROM y GROUP BY 1")
def split_evidence(s, d):
    return rounded(sd.split_evidence(R.sleeves(s, d), "1996-01-01", ["strategy"]))


@query(f"WITH {R.PANEL}, {MOM}, {R.SECTORS}, {NEUTRAL}, {FWD}, {weights_sql('z', 0.2, 5)}, {LS}, net AS (SELECT gross - 0.0015 * turnover AS net FROM ls) SELECT count(net) AS n, round(avg(net), 6) AS mean, round(avg(net) / stddev_samp(net), 6) AS sharpe, round(avg(net) / stddev_samp(net) * sqrt(12), 6) AS sharpe_ann FROM net")
def evaluate_factor(s, d):
    p = R.panel(s, d)
    factor = panels.trailing_momentum(p).withColumnRenamed("momentum", "value")
    return rounded(sd.evaluate_factor(factor, R.sectors(s, d), panels.forward_returns(p), min_names=5))


@query(f"WITH {R.SLEEVES}, o AS (SELECT month(date) AS m, year(date) AS y, ret FROM sleeves WHERE strategy = 's1' AND month(date) % 4 <> 0) SELECT date, round(s.ret, 6) AS base, round(o.ret, 6) AS other FROM sleeves s JOIN o ON o.m = month(date) AND o.y = year(date) WHERE strategy = 's0'")
def align_sleeves(s, d):
    r = R.sleeves(s, d)
    other = r.where("strategy = 's1' and month(date) % 4 <> 0").select(F.last_day("date").cast("timestamp").alias("date"), "ret")
    early = other.select(F.date_sub("date", 9).cast("timestamp").alias("date"), (F.col("ret") + 1).alias("ret"))  # an earlier row of the month, not to count
    return rounded(sd.align_sleeves(r.where("strategy = 's0'"), other.union(early)))


@query(f"WITH {R.PANEL}, m AS (SELECT date, code, turnover > 300000 AS member FROM panel WHERE month(date) % 3 = 1), a AS (SELECT d.date, max(m.date) AS at FROM (SELECT DISTINCT date FROM panel) d LEFT JOIN (SELECT DISTINCT date FROM m) m ON m.date <= d.date GROUP BY 1) SELECT a.date, n.code, coalesce(m.member, false) AS member FROM a CROSS JOIN (SELECT DISTINCT code FROM m WHERE member) n LEFT JOIN m ON m.date = a.at AND m.code = n.code")
def mask_to_days(s, d):
    p = R.panel(s, d)
    return sd.mask_to_days(p.where("month(date) % 3 = 1").select("date", "code", (F.col("turnover") > 300000).alias("member")), p)


@query(f"WITH {R.PANEL}, {MOM} SELECT date, code, CASE WHEN NOT coalesce((code + month(date)) % 4 = 0, false) THEN round(value, 6) END AS value FROM mom")
def mask_out(s, d):
    m = panels.trailing_momentum(R.panel(s, d)).withColumnRenamed("momentum", "value")
    events = R.panel(s, d).select("date", "code", ((F.col("code") + F.month("date")) % 4 == 0).alias("flagged"))
    return rounded(sd.mask_out(m, events).select("date", "code", "value"))


@query(f"WITH {R.SLEEVES}, t AS (SELECT date, ret, CASE WHEN count(ret) OVER w = 6 THEN sum(ret) OVER w END AS t FROM sleeves WHERE strategy = 's2' WINDOW w AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)), r AS (SELECT a.date, a.ret, a.t, count(b.t) AS n, (sum((b.t < a.t)::INT) + (sum((b.t = a.t)::INT) + 1) / 2.0) / count(b.t) AS p FROM t a JOIN t b ON b.date <= a.date GROUP BY 1, 2, 3) SELECT date, round(ret, 6) AS ret, CASE WHEN t <> 0 THEN sign(t) END::DOUBLE AS sign, CASE WHEN n >= 12 AND t IS NOT NULL THEN CASE WHEN p <= 1 / 3 THEN 0.0 WHEN p <= 2 / 3 THEN 1.0 ELSE 2.0 END END::DOUBLE AS tertile FROM r")
def own_momentum_labels(s, d):
    return rounded(sd.own_momentum_labels(R.sleeves(s, d).where("strategy = 's2'"), 6, 12))


@query(f"""WITH {R.BARS}, x AS (SELECT symbol, ts, close, volume, close / nullif(lag(close) OVER w, 0) - 1 AS ret FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
v AS (SELECT *, CASE WHEN count(ret) OVER w5 >= 5 THEN stddev_samp(ret) OVER w5 END AS rv5, CASE WHEN count(ret) OVER w10 >= 10 THEN stddev_samp(ret) OVER w10 END AS rv10, CASE WHEN count(ret) OVER w6 >= 6 THEN stddev_samp(ret) OVER w6 END AS rv_h FROM x
  WINDOW w5 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), w10 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), w6 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
y AS (SELECT *, abs(ret) AS absret, CASE WHEN volume > 0 THEN ln(volume) END AS logvol, CASE WHEN rv_h > 0 THEN ln(rv_h) END AS cur_logvol, lead(close, 6) OVER w / nullif(close, 0) - 1 AS t_ret FROM v WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
t AS (SELECT *, lead(cur_logvol, 6) OVER (PARTITION BY symbol ORDER BY ts) AS t_vol FROM y)
SELECT symbol, ts, {', '.join(f'round({c}, 6) AS {c}' for c in ('rv5', 'rv10', 'rv_h', 'absret', 'ret', 'logvol', 'cur_logvol', 't_vol', 't_ret'))} FROM t WHERE rv5 IS NOT NULL AND rv10 IS NOT NULL AND rv_h IS NOT NULL AND ret IS NOT NULL AND logvol IS NOT NULL AND cur_logvol IS NOT NULL AND t_vol IS NOT NULL AND t_ret IS NOT NULL""")
def volatility_targets(s, d):
    return rounded(sd.volatility_targets(R.bars(s, d)))


# Disclosures and market facts


@query(f"WITH {R.FUND}, o AS (SELECT * FROM fund WHERE FEPS IS NOT NULL QUALIFY row_number() OVER (PARTITION BY Code, DiscDate ORDER BY DiscNo DESC) = 1), p AS (SELECT Code, DiscDate, FEPS, lag(FEPS) OVER w * (CASE WHEN year(lag(DiscDate) OVER w) < 1995 AND year(DiscDate) >= 1995 THEN 0.5 ELSE 1 END) AS prev FROM o WINDOW w AS (PARTITION BY Code ORDER BY DiscDate)) SELECT Code, DiscDate, round((FEPS - prev) / nullif(abs(prev), 0), 6) AS revision FROM p WHERE prev <> 0")
def dividend_forecast_revision(s, d):
    f = R.fund(s, d)
    dates = s.createDataFrame([("1992-01-01", 1.0), ("1995-01-01", 0.5)], "d string, cum double").select(F.to_date("d").alias("date"), "cum")
    splits = f.select("Code").distinct().join(F.broadcast(dates))  # two rows
    return rounded(fd.dividend_forecast_revision(f, splits, "FEPS"))


@query(f"WITH {R.FUND}, x AS (SELECT Code, DiscDate, DiscNo, EPS / nullif(FEPS, 0) AS s FROM fund), o AS (SELECT * FROM x WHERE s IS NOT NULL QUALIFY row_number() OVER (PARTITION BY Code, DiscDate ORDER BY DiscNo DESC) = 1), b AS (SELECT Code, DiscDate, s - lag(s) OVER (PARTITION BY Code ORDER BY DiscDate) AS b FROM o) SELECT Code, DiscDate, round(b, 6) AS buyback FROM b WHERE b IS NOT NULL")
def buyback_intensity(s, d):
    return rounded(fd.buyback_intensity(R.fund(s, d).withColumns({"TrShFY": F.col("EPS"), "ShOutFY": F.col("FEPS")})))


@query(f"WITH {R.PANEL} SELECT date, code, NOT (coalesce(close >= high, false) AND month(date) % 2 = 0 OR coalesce(close <= low, false) AND month(date) % 2 = 1 OR coalesce(volume = 0, false)) AS tradable FROM panel")
def tradability_mask(s, d):
    even = F.month("date") % 2 == 0
    return mf.tradability_mask(R.panel(s, d).withColumns({"ul": even.cast("int"), "ll": (~even).cast("int")}))


@query(f"WITH {BOOK} SELECT date, round(CASE WHEN sum(greatest(-weight, 0)) > 0 THEN sum(CASE WHEN code % 3 = 0 THEN greatest(-weight, 0) ELSE 0 END) / sum(greatest(-weight, 0)) ELSE 1 END, 6) AS coverage FROM weights GROUP BY 1")
def short_notional_coverage(s, d):
    p = R.panel(s, d)
    return rounded(mf.short_notional_coverage(_weights(s, d), p.where("code % 2 = 1 or code % 3 = 0").select("date", "code", (F.col("code") % 3 == 0).alias("shortable"))))


@query(f"WITH {R.PANEL}, {RET}, v AS (SELECT date, code, stddev_samp(r) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS v FROM rets) SELECT date, code, round(greatest(10, 10 + coalesce(v * 500, 0)), 6) AS bps FROM v")
def vol_scaled_costs(s, d):
    w = Window.partitionBy("code").orderBy("date")
    r = R.panel(s, d).withColumn("r", F.col("close") / F.lag("close").over(w) - 1)
    return rounded(r.select("date", "code", mf.vol_scaled_cost_bps(F.stddev_samp("r").over(w.rowsBetween(-11, 0))).alias("bps")))


@query(f"WITH {R.PANEL}, x AS (SELECT date, code, CASE WHEN (code + month(date)) % 5 = 0 THEN close END AS close FROM panel) SELECT date, code, round(last_value(close IGNORE NULLS) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS close FROM x")
def carry_limited(s, d):
    p = R.panel(s, d).select("date", "code", F.when((F.col("code") + F.month("date")) % 5 == 0, F.col("close")).alias("close"))
    return rounded(mf.carry_limited(p, "close", ["code"], 2))


# Studies


@query(f"WITH {R.PANEL}, {MOM}, c AS (SELECT date, corr(value, turnover) AS c FROM mom JOIN panel USING (date, code) GROUP BY 1) SELECT round(avg(c), 6) AS corr, count(c) AS n FROM c WHERE NOT isnan(c)")
def factor_correlation(s, d):
    p = R.panel(s, d)
    m = panels.trailing_momentum(p).join(p.select("date", "code", "turnover"), ["date", "code"])
    return rounded(sd.factor_correlation(m, "momentum", "turnover"))


@query(f"WITH {R.PANEL}, a AS (SELECT date, code FROM panel WHERE turnover > 300000), b AS (SELECT date, code FROM panel WHERE volume > 200) SELECT a.date, round(1 - count(b.code) / count(*), 6) AS changed FROM a LEFT JOIN b USING (date, code) GROUP BY 1")
def quantile_turnover(s, d):
    p = R.panel(s, d)
    return rounded(sd.quantile_turnover(p.where("turnover > 300000"), p.where("volume > 200")))


@query(f"WITH {R.SLEEVES}, a AS (SELECT date, ret FROM sleeves WHERE strategy = 's0'), b AS (SELECT date, ret FROM sleeves WHERE strategy = 's1') SELECT round(corr(a.ret, b.ret), 6) AS corr, round(avg((sign(a.ret) = sign(b.ret))::INT), 6) AS same_sign, count(*) AS n FROM a JOIN b ON a.date = b.date - INTERVAL 1 MONTH")
def shifted_crosscheck(s, d):
    r = R.sleeves(s, d)
    return rounded(sd.shifted_crosscheck(r.where("strategy = 's0'"), r.where("strategy = 's1'"), 1))


@query(f"WITH {R.SLEEVES}, x AS (SELECT date, max(ret) FILTER (strategy = 's0') AS a, max(ret) FILTER (strategy = 's1') AS b FROM sleeves WHERE strategy IN ('s0', 's1') GROUP BY 1 HAVING count(*) = 2), m AS (SELECT corr(a, b) * stddev_samp(b) / stddev_samp(a) AS k FROM x) SELECT date, round(b - k * a, 6) AS resid FROM x CROSS JOIN m")
def residual_alpha(s, d):
    r = R.sleeves(s, d)
    pairs = r.where("strategy = 's0'").select("date", F.col("ret").alias("a")).join(r.where("strategy = 's1'").select("date", F.col("ret").alias("b")), "date")
    return rounded(sd.residual_alpha(pairs, "a", "b").select("date", "resid"))


@query(f"WITH {R.SLEEVES} SELECT date, round(ln(nav), 6) AS log_nav FROM (SELECT lead(date) OVER (ORDER BY date) AS date, product(1 + ret) OVER (ORDER BY date) AS nav FROM sleeves WHERE strategy = 's0') WHERE date IS NOT NULL")
def nav_on_next_label(s, d):
    return rounded(sd.nav_on_next_label(R.sleeves(s, d).where("strategy = 's0'")).select("date", F.log("nav").alias("log_nav")))


@query(f"WITH {BOOK} SELECT round((SELECT count(DISTINCT date) FROM weights) / (SELECT count(DISTINCT date) FROM panel), 6) AS share")
def invested_share(s, d):
    return rounded(sd.invested_share(_weights(s, d), R.panel(s, d)))


@query(f"WITH {R.SLEEVES} SELECT date AS month, round(ln(product(1 + ret) OVER (ORDER BY date)), 6) AS log_nav FROM sleeves WHERE strategy = 's3'")
def month_chain(s, d):
    return rounded(production.month_chain(R.sleeves(s, d).where("strategy = 's3'").select(F.col("date").alias("month"), "ret")).select("month", F.log("nav").alias("log_nav")))
