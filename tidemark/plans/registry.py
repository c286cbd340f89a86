"""Named queries over the test tables, with the SQL that must give the same rows.

Doubles are rounded on both sides, as sums in another order differ in their last
digits. Queries without SQL are searches and fits (lag choice, eigenvalues).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import backtest as bt
from ..operators import bars as B
from ..operators import fundamentals as fd
from ..operators import joins, labels, microstructure, panels, portfolio, production
from ..operators import market_facts as mf
from ..operators import statistics as st
from ..operators import strategies as sg
from ..operators import studies as sd
from ..operators import timeseries as tm
from ..sources import store
from . import recursions as X
from . import relations as R

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "momentum_long_short_net"


def query(sql: str = ""):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


MOM = "mom AS (SELECT date, code, lag(close, 1) OVER c / lag(close, 12) OVER c - 1 AS value FROM panel WINDOW c AS (PARTITION BY code ORDER BY date))"
FWD = "fwd AS (SELECT date, code, lead(ret) OVER (PARTITION BY code ORDER BY date) AS fwd_ret FROM (SELECT date, code, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS ret FROM panel))"
NEUTRAL = """neutral AS (SELECT date, code, value - avg(value) OVER (PARTITION BY date, coalesce(sector::VARCHAR, 'NA')) AS value FROM mom LEFT JOIN sectors USING (code)),
z AS (SELECT date, code, CASE WHEN value IS NULL THEN NULL ELSE greatest(-3.0, least(3.0, (value - avg(value) OVER d) / nullif(stddev_pop(value) OVER d, 0))) END AS value FROM neutral WINDOW d AS (PARTITION BY date))"""


def weights_sql(source: str, q: float, least: int) -> str:
    return f"""ranked AS (SELECT date, code, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY value DESC, code) AS up,
  row_number() OVER (PARTITION BY date ORDER BY value, code DESC) AS down FROM {source} WHERE value IS NOT NULL),
weights AS (SELECT date, code, CASE WHEN down <= k THEN -1.0 / k WHEN up <= k THEN 1.0 / k END AS weight FROM (SELECT *, greatest(1, floor(n * {q})) AS k FROM ranked WHERE n >= {least}) WHERE down <= k OR up <= k)"""


LS = """pos AS (SELECT date, row_number() OVER (ORDER BY date) AS p FROM (SELECT DISTINCT date FROM panel)),
w AS (SELECT p, code, weight FROM weights JOIN pos USING (date)),
flow AS (SELECT coalesce(w.p, h.p) AS p, coalesce(w.code, h.code) AS code, coalesce(weight, 0) AS weight, coalesce(held, 0) AS held
  FROM w FULL JOIN (SELECT p + 1 AS p, code, weight AS held FROM w WHERE p + 1 IN (SELECT p FROM w)) h ON w.p = h.p AND w.code = h.code),
ls AS (SELECT date, sum(weight * coalesce(fwd_ret, 0)) AS gross, sum(abs(weight - held)) AS turnover FROM flow JOIN pos USING (p) LEFT JOIN fwd USING (date, code) GROUP BY date)"""


def momentum_factor(s, d):
    m = panels.trailing_momentum(R.panel(s, d)).withColumnRenamed("momentum", "value")
    return panels.zscore_cross_section(panels.sector_neutralize(m, R.sectors(s, d)))


@query(f"WITH {R.PANEL}, {MOM}, {R.SECTORS}, {NEUTRAL}, {FWD}, {weights_sql('z', 0.2, 5)}, {LS} SELECT date, round(gross, 6) AS gross, round(turnover, 6) AS turnover, round(gross - 0.0015 * turnover, 6) AS net FROM ls")
def momentum_long_short_net(s, d):
    p = R.panel(s, d)
    return rounded(panels.long_short_returns(momentum_factor(s, d), panels.forward_returns(p), costs_bps=15.0, min_names=5))


@query(f"WITH {R.PANEL}, {FWD} SELECT date, code, round(fwd_ret, 6) AS fwd_ret FROM fwd")
def forward_returns(s, d):
    return rounded(panels.forward_returns(R.panel(s, d)))


@query(f"WITH {R.PANEL}, {MOM} SELECT date, code, round(value, 6) AS momentum FROM mom")
def momentum(s, d):
    return rounded(panels.trailing_momentum(R.panel(s, d)))


@query(f"WITH {R.PANEL}, g AS (SELECT date, code, CASE WHEN code % 3 <> month(date) % 3 THEN close END AS close FROM panel), f AS (SELECT date, code, last_value(close IGNORE NULLS) OVER (PARTITION BY code ORDER BY date) AS c FROM g) SELECT date, code, round(c / lag(c) OVER (PARTITION BY code ORDER BY date) - 1, 6) AS ret FROM f")
def ret_pad(s, d):
    from ..functions.semantics import change

    g = R.panel(s, d).withColumn("close", F.when(F.col("code") % 3 != F.month("date") % 3, F.col("close")))
    return rounded(g.select("date", "code", change("close", panels.by_code(), pad=True).alias("ret")))


@query(f"WITH {R.PANEL}, g AS (SELECT date, code, CASE WHEN code % 3 <> month(date) % 3 THEN close END AS close FROM panel) SELECT date, code, round(close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1, 6) AS ret FROM g")
def ret_nopad(s, d):
    from ..functions.semantics import change

    g = R.panel(s, d).withColumn("close", F.when(F.col("code") % 3 != F.month("date") % 3, F.col("close")))
    return rounded(g.select("date", "code", change("close", panels.by_code()).alias("ret")))


@query(f"WITH {R.PANEL}, r AS (SELECT date, code, close, close / lag(close) OVER c - 1 AS ret FROM panel WINDOW c AS (PARTITION BY code ORDER BY date)) SELECT date, code, round(ret, 6) AS ret, round(ln(1 + ret), 6) AS log_ret, round(CASE WHEN count(ret) OVER v >= 10 THEN stddev_samp(ret) OVER v * sqrt(252) END, 6) AS vol, round(lag(close, 21) OVER c / lag(close, 60) OVER c - 1, 6) AS momentum, round(-(close / lag(close, 5) OVER c - 1), 6) AS reversal FROM r WINDOW c AS (PARTITION BY code ORDER BY date), v AS (PARTITION BY code ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def price_features(s, d):
    return rounded(panels.price_features(R.panel(s, d), mom_lookback=60))


@query(f"WITH {R.PANEL}, r AS (SELECT date, code, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS ret FROM panel) SELECT date, code, round(CASE WHEN count(ret) OVER v >= 6 THEN -stddev_samp(ret) OVER v END, 6) AS low_vol FROM r WINDOW v AS (PARTITION BY code ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)")
def low_volatility(s, d):
    return rounded(panels.low_volatility(R.panel(s, d)))


@query(f"""WITH {R.PANEL}, r AS (SELECT date, code, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS ret FROM panel),
m AS (SELECT *, avg(ret) OVER (PARTITION BY date) AS market, row_number() OVER (PARTITION BY code ORDER BY date) AS n FROM r),
f AS (SELECT code, date, n, regr_slope(ret, market) OVER w AS b, regr_intercept(ret, market) OVER w AS a, count(ret) OVER w AS k FROM m WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 36 PRECEDING AND 1 PRECEDING)),
e AS (SELECT f.code, f.date, f.k, sum(m.ret - f.a - f.b * m.market) AS t, stddev_samp(m.ret - f.a - f.b * m.market) AS sd, count(m.ret) AS c FROM f LEFT JOIN m ON m.code = f.code AND m.n BETWEEN f.n - 12 AND f.n - 2 AND m.ret IS NOT NULL GROUP BY ALL)
SELECT date, code, round(CASE WHEN k >= 36 AND c > 1 AND sd > 1e-9 THEN t / sd END, 5) AS resid_mom FROM e""")
def residual_momentum(s, d):
    r = R.panel(s, d).select("date", "code", (F.col("close") / F.lag("close").over(panels.by_code()) - 1).alias("ret"))
    r = r.withColumn("market", F.avg("ret").over(panels.by_date()))
    return rounded(panels.residual_momentum(r), 5)


@query(f"WITH {R.PANEL}, {MOM}, {R.SECTORS}, {NEUTRAL} SELECT date, code, round(value, 6) AS value FROM z")
def neutralise_zscore(s, d):
    return rounded(momentum_factor(s, d).select("date", "code", "value"))


@query(f"WITH {R.PANEL}, x AS (SELECT date, code, close AS y, ln(turnover) AS x FROM panel) SELECT date, code, round(CASE WHEN count(*) OVER w >= 4 THEN y - regr_intercept(y, x) OVER w - regr_slope(y, x) OVER w * x END, 4) AS resid FROM x WINDOW w AS (PARTITION BY date)")
def residualise_one(s, d):
    p = R.panel(s, d).select("date", "code", F.col("close").alias("y"), F.log("turnover").alias("x"))
    return rounded(panels.residualize(p, "y", ["x"]).select("date", "code", "resid"), 4)


@query(f"""WITH {R.PANEL}, x AS (SELECT date, code, close AS y, ln(turnover) AS a, ln(volume) AS b FROM panel),
m AS (SELECT date, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(y, a) AS ya, covar_pop(y, b) AS yb FROM x GROUP BY 1)
SELECT date, code, round(y - my - (ya * bb - yb * ab) / (aa * bb - ab * ab) * (a - ma) - (yb * aa - ya * ab) / (aa * bb - ab * ab) * (b - mb), 4) AS resid FROM x JOIN m USING (date)""")
def residualise_many(s, d):
    p = R.panel(s, d).select("date", "code", F.col("close").alias("y"), F.log("turnover").alias("a"), F.log("volume").alias("b"))
    return rounded(panels.residualize(p, "y", ["a", "b"]).select("date", "code", "resid"), 4)


@query(f"""WITH {R.PANEL}, m AS (SELECT date, code, CASE WHEN count(turnover) OVER w >= 6 THEN median(turnover) OVER w END AS med FROM panel WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT date, code, (med IS NOT NULL AND row_number() OVER (PARTITION BY date ORDER BY med DESC NULLS LAST, code) <= 20) AS member FROM m""")
def universe_point_in_time(s, d):
    return panels.point_in_time_universe(R.panel(s, d), top_n=20)


@query(f"WITH {R.PANEL} SELECT code, count(turnover) AS obs, round(median(turnover), 6) AS median_turnover FROM panel GROUP BY code HAVING count(turnover) >= 12 ORDER BY median(turnover) DESC, code LIMIT 25")
def universe_full_period(s, d):
    return rounded(panels.select_universe(R.panel(s, d), top_n=25))


@query(f"WITH {R.PANEL}, {MOM}, {R.SECTORS}, {NEUTRAL}, {weights_sql('z', 0.2, 20)} SELECT date, code, round(weight, 6) AS weight FROM weights")
def quantile_weights(s, d):
    return rounded(panels.quantile_weights(momentum_factor(s, d)))


@query(f"WITH {R.PANEL}, a AS (SELECT *, CASE WHEN month(date) = 6 THEN 0.9 END AS f FROM panel) SELECT date, code, round(close * coalesce(product(coalesce(f, 1.0)) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1.0), 6) AS adj_close FROM a")
def back_adjust(s, d):
    p = R.panel(s, d).withColumn("adj_factor", F.when(F.month("date") == 6, 0.9))
    return rounded(panels.back_adjust(p).select("date", "code", "adj_close"))


RANK = "(rank() OVER (PARTITION BY date ORDER BY {c}) + (count(*) OVER (PARTITION BY date, {c}) - 1) / 2.0) / count(*) OVER (PARTITION BY date)"


@query(f"WITH {R.PANEL}, {MOM}, {FWD}, x AS (SELECT date, value AS a, fwd_ret AS b FROM mom JOIN fwd USING (date, code) WHERE value IS NOT NULL AND fwd_ret IS NOT NULL), r AS (SELECT date, {RANK.format(c='a')} AS ra, {RANK.format(c='b')} AS rb FROM x) SELECT date, round(corr(ra, rb), 6) AS ic FROM r GROUP BY date")
def rank_ic(s, d):
    p = R.panel(s, d)
    return rounded(panels.rank_ic(panels.trailing_momentum(p).join(panels.forward_returns(p), ["date", "code"]), "momentum", "fwd_ret"))


@query(f"WITH {R.PANEL}, {MOM} SELECT date, round(avg((value IS NOT NULL)::INT), 6) AS coverage FROM mom GROUP BY date")
def coverage_by_date(s, d):
    return rounded(panels.coverage_by_date(panels.trailing_momentum(R.panel(s, d)), "momentum"))


@query(f"WITH {R.PANEL}, r AS (SELECT date, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS r FROM panel), m AS (SELECT date, avg(r) AS ret FROM r GROUP BY date) SELECT date, round(ret, 6) AS ret, round(ln(product(1 + coalesce(ret, 0)) OVER (ORDER BY date)), 6) AS level FROM m")
def equal_weight_market(s, d):
    m = panels.equal_weight_market(R.panel(s, d))
    return m.select("date", F.round("ret", 6).alias("ret"), F.round(F.log("level"), 6).alias("level"))


@query(f"WITH {R.PANEL} SELECT date, code, round(CASE WHEN count(turnover) OVER w >= 5 THEN avg(turnover) OVER w END, 6) AS adv FROM panel WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def rolling_adv(s, d):
    return rounded(panels.rolling_adv(R.panel(s, d)))


@query("SELECT l_suppkey AS code, l_shipdate::TIMESTAMP AS date, round(sum(l_quantity), 2) AS volume FROM lineitem WHERE (l_suppkey, l_shipdate) IN (SELECT (l_suppkey, max(l_shipdate)) FROM lineitem GROUP BY l_suppkey, date_trunc('month', l_shipdate) HAVING last_day(max(l_shipdate)) - max(l_shipdate)::DATE <= 7) GROUP BY 1, 2")
def month_end_rows(s, d):
    li = R.read(s, d, "lineitem").select(F.col("l_suppkey").alias("code"), F.col("l_shipdate").alias("date"), "l_quantity")
    return rounded(panels.month_end_rows(li, by=["code"], max_back=7).groupBy("code", "date").agg(F.sum("l_quantity").alias("volume")), 2)


@query(f"WITH {R.PANEL} SELECT date, round(max(CASE WHEN code = 0 THEN close END), 6) AS \"0\", round(max(CASE WHEN code = 1 THEN close END), 6) AS \"1\" FROM panel GROUP BY date")
def pivot_wide(s, d):
    return rounded(panels.to_wide(R.panel(s, d), "close", [0, 1]))


@query(f"WITH {R.PANEL} SELECT date, code, coalesce(close >= high, false) AND month(date) % 2 = 0 OR coalesce(volume = 0, false) AS no_buy, coalesce(close <= low, false) AND month(date) % 2 = 1 OR coalesce(volume = 0, false) AS no_sell FROM panel")
def limit_lock(s, d):
    even = F.month("date") % 2 == 0
    return mf.limit_lock_flags(R.panel(s, d).withColumns({"ul": even.cast("int"), "ll": (~even).cast("int")}))


# As-of joins and disclosures


@query(f"WITH {R.FUND}, {R.QUARTERS}, g AS (SELECT DISTINCT Code, date FROM fund CROSS JOIN quarters), f AS (SELECT Code, DiscDate, arg_max(FEPS, DiscNo) AS FEPS FROM fund GROUP BY 1, 2) SELECT g.date, g.Code AS code, f.FEPS AS FEPS FROM g ASOF LEFT JOIN f ON g.Code = f.Code AND g.date - 1 >= f.DiscDate")
def asof_backward(s, d):
    return fd.point_in_time(R.fund(s, d), R.quarter_ends(s, d), ["FEPS"])


@query(ORACLE_SQL["asof_backward"])
def asof_backward_bucketed(s, d):
    return fd.point_in_time(R.fund(s, d), R.quarter_ends(s, d), ["FEPS"], bucket="year")


@query(f"WITH {R.FUND}, {R.QUARTERS}, g AS (SELECT DISTINCT Code, date FROM fund CROSS JOIN quarters), f AS (SELECT Code, DiscDate, arg_max(FEPS > 250000, DiscNo) AS ok FROM fund GROUP BY 1, 2) SELECT g.date, g.Code AS code, coalesce(f.ok AND (g.date - 4) - f.DiscDate <= 60, false) AS shortable FROM g ASOF LEFT JOIN f ON g.Code = f.Code AND g.date - 4 >= f.DiscDate")
def asof_tolerance_shortable(s, d):
    from ..functions.semantics import keep_last

    f = keep_last(R.fund(s, d), ["Code", "DiscDate"], ["DiscNo"])
    margin = f.select("Code", F.col("DiscDate").alias("Date"), F.when(F.col("FEPS") > 250000, 1.0).otherwise(0.0).alias("ShrtStdVol"))
    grid = R.fund(s, d).select(F.col("Code").alias("code")).distinct().crossJoin(F.broadcast(R.quarter_ends(s, d)))  # a few quarters
    return mf.shortable_mask(margin, grid)


@query(f"WITH {R.DAILY}, q AS (SELECT DISTINCT date_trunc('day', date)::DATE AS date FROM daily), e AS (SELECT date_trunc('day', date)::DATE AS d, avg(level) AS value FROM daily GROUP BY 1) SELECT q.date, round(e.value, 6) AS value FROM q ASOF LEFT JOIN e ON q.date - 1 >= e.d")
def asof_series(s, d):
    e = R.daily(s, d).groupBy(F.to_date("date").alias("date")).agg(F.avg("level").alias("value"))
    return rounded(mf.asof_series(e, e))


@query(f"WITH {R.FUND}, f AS (SELECT Code, DiscDate, arg_max(FEPS, DiscNo) AS x FROM fund GROUP BY 1, 2), r AS (SELECT Code, DiscDate, (x - lag(x) OVER w) / nullif(abs(lag(x) OVER w), 0) AS revision FROM f WINDOW w AS (PARTITION BY Code ORDER BY DiscDate)) SELECT Code, DiscDate, round(revision, 6) AS revision FROM r WHERE revision IS NOT NULL")
def forecast_revision(s, d):
    return rounded(fd.forecast_revision(R.fund(s, d)))


@query(f"WITH {R.FUND} SELECT Code, DiscDate, round((EPS - FEPS) / abs(FEPS), 6) AS surprise FROM fund WHERE FEPS <> 0")
def earnings_surprise(s, d):
    return rounded(fd.earnings_surprise(R.fund(s, d)))


@query(f"WITH {R.FUND}, f AS (SELECT DISTINCT Code, CurPerType, DiscDate FROM fund), g AS (SELECT Code, DiscDate, DiscDate - lag(DiscDate) OVER (PARTITION BY Code, CurPerType ORDER BY DiscDate) AS gap FROM f) SELECT Code, DiscDate, gap - 365 AS delay FROM g WHERE gap BETWEEN 300 AND 430")
def announcement_delay(s, d):
    return fd.announcement_delay(R.fund(s, d))


@query(f"WITH {R.FUND}, {R.QUARTERS}, m AS (SELECT DISTINCT Code, DiscDate FROM fund), c AS (SELECT Code, month(DiscDate) AS m, count(*) AS n FROM m GROUP BY 1, 2), u AS (SELECT Code, m FROM c QUALIFY row_number() OVER (PARTITION BY Code ORDER BY n DESC, m) <= 4), f AS (SELECT Code, min(DiscDate) AS first FROM m GROUP BY 1) SELECT date, f.Code AS code, first <= date AND month(date + INTERVAL 1 MONTH) IN (SELECT u.m FROM u WHERE u.Code = f.Code) AS expected FROM f CROSS JOIN quarters")
def expected_announcement_month(s, d):
    return fd.expected_announcement_month(R.fund(s, d), R.quarter_ends(s, d))


@query(f"WITH {R.FUND}, {R.QUARTERS}, m AS (SELECT DISTINCT Code, DiscDate FROM fund), g AS (SELECT Code, DiscDate, DiscDate - lag(DiscDate) OVER (PARTITION BY Code ORDER BY DiscDate) AS gap FROM m), u AS (SELECT Code, coalesce(greatest(60.0, least(130.0, median(gap))), 91.0) AS gap FROM g GROUP BY 1), x AS (SELECT u.Code, gap, date FROM u CROSS JOIN quarters) SELECT x.date, x.Code AS code, round((m.DiscDate - x.date) + x.gap, 6) AS days FROM x ASOF LEFT JOIN m ON x.Code = m.Code AND x.date >= m.DiscDate")
def days_to_next_announcement(s, d):
    return rounded(fd.days_to_next_announcement(R.fund(s, d), R.quarter_ends(s, d)))


@query(f"WITH {R.FUND} SELECT Code, DiscDate, max(DiscNo) AS DiscNo, round(arg_max(FEPS, DiscNo), 6) AS FEPS FROM fund GROUP BY 1, 2")
def dedup_last(s, d):
    from ..functions.semantics import keep_last

    return rounded(keep_last(R.fund(s, d), ["Code", "DiscDate"], ["DiscNo"]).select("Code", "DiscDate", "DiscNo", "FEPS"))


@query("SELECT d::DATE AS date FROM range(DATE '1995-01-02', DATE '1996-12-31', INTERVAL 1 DAY) t(d) WHERE dayofweek(d) BETWEEN 1 AND 5 AND d NOT IN (SELECT o_orderdate FROM orders WHERE o_totalprice > 400000)")
def anti_missing_dates(s, d):
    had = R.read(s, d, "orders").where("o_totalprice > 400000").select(F.to_date("o_orderdate").alias("date"))
    return store.missing_dates(store.candidate_dates(s, "daily", "1995-01-02", "1996-12-30"), had)


@query(f"WITH {R.PANEL}, a AS (SELECT date, avg(close) AS v FROM panel WHERE code % 2 = 0 GROUP BY 1), b AS (SELECT date, sum(volume) AS v FROM panel WHERE code % 2 = 1 AND month(date) > 2 GROUP BY 1) SELECT coalesce(a.date, b.date) AS date, round(a.v, 6) AS v, round(b.v, 6) AS v_dup1 FROM a FULL JOIN b ON a.date = b.date")
def merge_full_outer(s, d):
    p = R.panel(s, d)
    a, b = p.where("code % 2 = 0").groupBy("date").agg(F.avg("close").alias("v")), p.where("code % 2 = 1 AND month(date) > 2").groupBy("date").agg(F.sum("volume").alias("v"))
    return rounded(store.merge_series([a, b]))


@query(f"WITH {R.PANEL}, l AS (SELECT date, code, unnest(['close', 'volume']) AS field, unnest([close, CASE WHEN code % 5 > 0 THEN volume END]) AS value FROM panel), n AS (SELECT count(DISTINCT date) AS d, count(DISTINCT code) AS c FROM panel) SELECT field, count(DISTINCT date) FILTER (value IS NOT NULL) AS days, count(DISTINCT code) FILTER (value IS NOT NULL) AS codes, min(date) FILTER (value IS NOT NULL) AS start, max(date) FILTER (value IS NOT NULL) AS \"end\", round(1 - count(value) / (SELECT d * c FROM n), 6) AS null_share, true AS same_calendar FROM l GROUP BY field")
def health_check(s, d):
    p = R.panel(s, d).withColumn("volume", F.when(F.col("code") % 5 > 0, F.col("volume")))
    return rounded(store.health_check(p, ["close", "volume"]))


# Bars

DOLLAR_SQL = f"""WITH RECURSIVE {R.TRADES}, t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS n FROM trades),
fold AS (SELECT symbol, 1::BIGINT AS n, price * volume AS total, 0::BIGINT AS bar, (price * volume >= 5000)::INT AS closed FROM t WHERE n = 1
UNION ALL SELECT t.symbol, t.n, CASE WHEN f.closed = 1 THEN 0 ELSE f.total END + t.price * t.volume, f.bar + f.closed, ((CASE WHEN f.closed = 1 THEN 0 ELSE f.total END + t.price * t.volume) >= 5000)::INT FROM fold f JOIN t ON t.symbol = f.symbol AND t.n = f.n + 1),
x AS (SELECT f.symbol, f.bar AS bar_id, t.price, t.volume, t.ts, t.seq, f.closed FROM fold f JOIN t USING (symbol, n))
SELECT symbol, bar_id, arg_min(price, row(ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, row(ts, seq)) AS close, round(sum(volume), 6) AS volume, round(sum(price * volume), 6) AS dollar, round(sum(price * volume) / sum(volume), 6) AS vwap, count(*) AS n_ticks, min(ts) AS start_time, max(ts) AS close_time FROM x GROUP BY 1, 2 HAVING max(closed) = 1"""


@query(DOLLAR_SQL)
def dollar_bars(s, d):
    return rounded(B.dollar_bars(R.trades(s, d), 5000.0))


@query(DOLLAR_SQL.replace("price * volume >= 5000", "volume >= 200").replace("price * volume AS total", "volume AS total").replace("+ t.price * t.volume", "+ t.volume").replace(">= 5000", ">= 200"))
def volume_bars(s, d):
    return rounded(B.volume_bars(R.trades(s, d), 200.0))


@query(f"WITH {R.TRADES}, t AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) - 1) // 40 AS bar_id FROM trades) SELECT symbol, bar_id, arg_min(price, row(ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, row(ts, seq)) AS close, round(sum(volume), 4) AS volume, round(sum(price * volume), 4) AS dollar, round(sum(price * volume) / sum(volume), 4) AS vwap, count(*) AS n_ticks, min(ts) AS start_time, max(ts) AS close_time FROM t GROUP BY 1, 2 HAVING count(*) = 40")
def tick_bars(s, d):
    return rounded(B.tick_bars(R.trades(s, d), 40), 4)


@query(X.IMBALANCE_BARS)
def dollar_imbalance_bars(s, d):
    return rounded(B.dollar_imbalance_bars(R.trades(s, d), 3000.0), 4)


@query(f"WITH {R.TRADES}, t AS (SELECT *, price - lag(price) OVER w AS step FROM trades WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)) SELECT symbol, seq, coalesce(last_value(CASE WHEN step <> 0 THEN sign(step) END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, seq), 1)::DOUBLE AS sign FROM t")
def tick_rule(s, d):
    return B.with_tick_rule(R.trades(s, d)).select("symbol", "seq", "sign")


@query(f"WITH {R.TRADES}, t AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) - 1) // 40 AS bar_id, price - lag(price) OVER (PARTITION BY symbol ORDER BY ts, seq) AS step FROM trades), u AS (SELECT *, CASE side WHEN 'buy' THEN 1 WHEN 'sell' THEN -1 ELSE coalesce(last_value(CASE WHEN step <> 0 THEN sign(step) END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, seq), 1) END AS s FROM t) SELECT symbol, bar_id, round(sum(s * volume) / sum(volume), 6) AS flow FROM u GROUP BY 1, 2 HAVING count(*) = 40")
def order_flow_per_bar(s, d):
    t = R.trades(s, d)
    return rounded(B.order_flow_per_bar(t, B.tick_bars(t, 40, close_seq=True)))


@query(f"WITH {R.TRADES}, t AS (SELECT *, sum(volume) OVER w AS c, price - lag(price) OVER w AS step FROM trades WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)), u AS (SELECT symbol, floor((c - volume) / 500)::BIGINT AS bucket, volume, CASE side WHEN 'buy' THEN 1 WHEN 'sell' THEN -1 ELSE coalesce(last_value(CASE WHEN step <> 0 THEN sign(step) END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, seq), 1) END AS s FROM t), g AS (SELECT symbol, bucket, sum(s * volume) AS i, sum(volume) AS v FROM u GROUP BY 1, 2) SELECT symbol, bucket, round(CASE WHEN count(*) OVER w = 5 THEN sum(abs(i)) OVER w / sum(v) OVER w END, 6) AS vpin FROM g WINDOW w AS (PARTITION BY symbol ORDER BY bucket ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def volume_bucket_vpin(s, d):
    return rounded(B.volume_bucket_vpin(R.trades(s, d), 500.0, 5))


W20 = "PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW"


@query(f"WITH {R.BARS} SELECT symbol, ts, round(CASE WHEN count(*) OVER w >= 20 THEN sqrt(avg(ln(high / low) ** 2) OVER w / (4 * ln(2))) END, 6) AS parkinson FROM bars WINDOW w AS ({W20})")
def parkinson_vol(s, d):
    return rounded(microstructure.parkinson_vol(R.bars(s, d)))


@query(f"WITH {R.BARS} SELECT symbol, ts, round(CASE WHEN count(*) OVER w >= 20 THEN sqrt(greatest(0, avg(0.5 * ln(high / low) ** 2 - (2 * ln(2) - 1) * ln(close / open) ** 2) OVER w)) END, 6) AS garman_klass FROM bars WINDOW w AS ({W20})")
def garman_klass_vol(s, d):
    return rounded(microstructure.garman_klass_vol(R.bars(s, d)))


@query(f"WITH {R.BARS}, x AS (SELECT symbol, ts, abs(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1) / nullif(dollar, 0) AS x FROM bars) SELECT symbol, ts, round(CASE WHEN count(x) OVER w >= 20 THEN avg(x) OVER w END, 9) AS amihud FROM x WINDOW w AS ({W20})")
def amihud_illiquidity(s, d):
    return rounded(microstructure.amihud_illiquidity(R.bars(s, d)), 9)


@query(f"WITH {R.BARS}, x AS (SELECT symbol, ts, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM bars), y AS (SELECT *, lag(p) OVER (PARTITION BY symbol ORDER BY ts) AS q FROM x) SELECT symbol, ts, round(CASE WHEN count(p + q) OVER w >= 20 THEN 2 * sqrt(greatest(-covar_samp(p, q) OVER w, 0)) END, 5) AS roll_spread FROM y WINDOW w AS ({W20})")
def roll_spread(s, d):
    return rounded(microstructure.roll_spread(R.bars(s, d)), 5)


@query(f"WITH {R.BARS}, x AS (SELECT symbol, ts, ln(high / low) ** 2 + ln(lag(high) OVER w / lag(low) OVER w) ** 2 AS b, CASE WHEN lag(high) OVER w IS NOT NULL THEN ln(greatest(high, lag(high) OVER w) / least(low, lag(low) OVER w)) ** 2 END AS g FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)), a AS (SELECT symbol, ts, (sqrt(2) - 1) / (3 - 2 * sqrt(2)) * sqrt(b) - sqrt(g / (3 - 2 * sqrt(2))) AS a FROM x) SELECT symbol, ts, round(CASE WHEN a IS NOT NULL THEN 2 * (exp(greatest(a, 0)) - 1) / (1 + exp(greatest(a, 0))) END, 6) AS corwin_schultz FROM a")
def corwin_schultz_spread(s, d):
    return rounded(microstructure.corwin_schultz_spread(R.bars(s, d)))


@query(f"WITH {R.BARS}, x AS (SELECT symbol, ts, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM bars), y AS (SELECT symbol, ts, CASE WHEN count(p) OVER w >= 14 THEN avg(CASE WHEN p IS NOT NULL THEN greatest(p, 0) END) OVER w END AS g, CASE WHEN count(p) OVER w >= 14 THEN avg(CASE WHEN p IS NOT NULL THEN greatest(-p, 0) END) OVER w END AS l FROM x WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)) SELECT symbol, ts, round(CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END, 5) AS rsi FROM y")
def rsi(s, d):
    return rounded(microstructure.rsi(R.bars(s, d)), 5)


@query(X.VPIN)
def vpin(s, d):
    return rounded(microstructure.vpin(R.bars(s, d), 20, 20))


@query(X.FRAC_DIFF)
def frac_diff(s, d):
    return rounded(microstructure.frac_diff(R.bars(s, d), 0.4, 1e-2))


@query(X.CAUSAL)
def causal_direction(s, d):
    li = R.read(s, d, "lineitem")
    return rounded(microstructure.causal_direction(li, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"))


@query(f"WITH {R.DAILY}, x AS (SELECT date, level, abs(level - lag(level) OVER (ORDER BY date)) AS m FROM daily) SELECT date, round(abs(level - lag(level, 24) OVER (ORDER BY date)) / nullif(CASE WHEN count(m) OVER w >= 24 THEN sum(m) OVER w END, 0), 6) AS er FROM x WINDOW w AS (ORDER BY date ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)")
def efficiency_ratio(s, d):
    return rounded(microstructure.efficiency_ratio(R.daily(s, d), 24))


# Labels


@query(f"WITH {R.LABELS}, f AS (SELECT symbol, min(t0) AS first FROM labels3 GROUP BY 1) SELECT b.symbol, b.ts, count(l.t0) AS n FROM bars b JOIN f ON f.symbol = b.symbol AND b.ts >= f.first LEFT JOIN labels3 l ON l.symbol = b.symbol AND b.ts BETWEEN l.t0 AND l.t1 GROUP BY 1, 2")
def label_concurrency(s, d):
    return labels.concurrency(R.bars(s, d), R.labels(s, d))


CONC = f"WITH {R.LABELS}, c AS (SELECT b.symbol, b.ts, b.close, count(*) AS n FROM bars b JOIN labels3 l ON l.symbol = b.symbol AND b.ts BETWEEN l.t0 AND l.t1 GROUP BY 1, 2, 3)"


@query(f"{CONC} SELECT l.symbol, l.t0, l.t1, round(avg(1.0 / c.n), 6) AS uniqueness FROM labels3 l JOIN c ON c.symbol = l.symbol AND c.ts BETWEEN l.t0 AND l.t1 GROUP BY 1, 2, 3")
def label_uniqueness(s, d):
    return rounded(labels.average_uniqueness(R.bars(s, d), R.labels(s, d)))


@query(f"{CONC}, r AS (SELECT symbol, ts, ln(close) - ln(lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS lr FROM bars), w AS (SELECT l.symbol, l.t0, l.t1, abs(sum(lr / n)) AS w FROM labels3 l JOIN c ON c.symbol = l.symbol AND c.ts BETWEEN l.t0 AND l.t1 JOIN r ON r.symbol = c.symbol AND r.ts = c.ts GROUP BY 1, 2, 3) SELECT symbol, t0, t1, round(w * count(*) OVER s / sum(w) OVER s, 5) AS weight FROM w WINDOW s AS (PARTITION BY symbol)")
def label_weights_by_return(s, d):
    return rounded(labels.weights_by_return(R.bars(s, d), R.labels(s, d)), 5)


@query(f"{CONC}, u AS (SELECT l.symbol, l.t0, l.t1, avg(1.0 / c.n) AS u FROM labels3 l JOIN c ON c.symbol = l.symbol AND c.ts BETWEEN l.t0 AND l.t1 GROUP BY 1, 2, 3) SELECT symbol, t0, t1, round(greatest(0, 1 - 0.5 + 0.5 / sum(u) OVER (PARTITION BY symbol) * sum(u) OVER (PARTITION BY symbol ORDER BY t0, t1 ROWS UNBOUNDED PRECEDING)), 6) AS decay FROM u")
def label_time_decay(s, d):
    return rounded(labels.time_decay(labels.average_uniqueness(R.bars(s, d), R.labels(s, d)), 0.5).drop("uniqueness"))


@query(f"WITH {R.LABELS} SELECT l.symbol, b.ts, l.t0, l.t1 FROM labels3 l JOIN bars b ON b.symbol = l.symbol AND b.ts BETWEEN l.t0 AND l.t1")
def interval_indicator(s, d):
    return labels.indicator(R.bars(s, d), R.labels(s, d)).select("symbol", "ts", "t0", "t1")


BARRIER = f"""WITH {R.LABELS}, p AS (SELECT l.symbol, l.t0, l.t1, b.ts, b.close / e.close - 1 AS m FROM labels3 l JOIN bars e ON e.symbol = l.symbol AND e.ts = l.t0 JOIN bars b ON b.symbol = l.symbol AND b.ts BETWEEN l.t0 AND l.t1),
h AS (SELECT symbol, t0, t1, min(CASE WHEN m > 0.2 THEN ts END) AS pt, min(CASE WHEN m < -0.2 THEN ts END) AS sl FROM p GROUP BY 1, 2, 3),
k AS (SELECT symbol, t0, least(pt, sl, t1) AS touch, CASE WHEN sl = least(pt, sl, t1) THEN 'sl' WHEN pt = least(pt, sl, t1) THEN 'pt' ELSE 't1' END AS kind FROM h)"""


@query(f"{BARRIER} SELECT k.symbol, k.t0, k.touch, k.kind, round(p.m, 6) AS ret, sign(p.m)::INT AS label FROM k JOIN p ON p.symbol = k.symbol AND p.t0 = k.t0 AND p.ts = k.touch")
def triple_barrier_bins(s, d):
    e = R.labels(s, d).withColumns({"trgt": F.lit(0.2), "side": F.lit(None).cast("double")})
    return rounded(labels.get_bins(labels.get_events(R.bars(s, d), e, 1.0, 1.0), R.bars(s, d)))


# Track records


@query(f"WITH {R.SLEEVES} SELECT strategy, count(ret) AS n_obs, round(avg(ret) / stddev_samp(ret), 6) AS sr, round(skewness(ret), 5) AS skew, round(kurtosis(ret) + 3, 5) AS kurt FROM sleeves GROUP BY 1")
def track_moments(s, d):
    m = st.track_moments(R.sleeves(s, d), ["strategy"])
    return m.select("strategy", "n_obs", F.round("sr", 6).alias("sr"), F.round("skew", 5).alias("skew"), F.round("kurt", 5).alias("kurt"))


@query(X.DEFLATED)
def deflated_sharpe_table(s, d):
    return rounded(st.deflated_sharpe_table(R.sleeves(s, d), "strategy"))


@query(f"WITH {R.SLEEVES}, c AS (SELECT strategy, date, product(1 + ret) OVER (PARTITION BY strategy ORDER BY date) AS c FROM sleeves), p AS (SELECT strategy, c / max(c) OVER (PARTITION BY strategy ORDER BY date) - 1 AS dd FROM c) SELECT strategy, round(min(dd), 6) AS maxdd FROM p GROUP BY 1")
def max_drawdown(s, d):
    return rounded(st.max_drawdown(R.sleeves(s, d), ["strategy"]))


@query(f"WITH {R.SLEEVES}, p AS (SELECT *, ntile(3) OVER (PARTITION BY strategy ORDER BY date) AS part FROM sleeves) SELECT strategy, part::INT AS part, round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(12), 6) AS sharpe FROM p GROUP BY 1, 2")
def subperiod_sharpes(s, d):
    return rounded(st.subperiod_sharpes(R.sleeves(s, d), ["strategy"]))


@query(f"WITH {R.SLEEVES}, a AS (SELECT strategy, ret, 0.5 ** ((row_number() OVER (PARTITION BY strategy ORDER BY date DESC) - 1) / 36.0) AS w FROM sleeves), g AS (SELECT strategy, sum(w * ret) / sum(w) AS m, sum(w * ret * ret) / sum(w) AS q FROM a GROUP BY 1) SELECT strategy, round(m / sqrt(q - m * m) * sqrt(12), 5) AS decayed_sharpe FROM g")
def time_decayed_sharpe(s, d):
    return rounded(st.time_decayed_sharpe(R.sleeves(s, d), ["strategy"]), 5)


@query(f"WITH {R.SLEEVES} SELECT strategy, round(avg(ret) FILTER (date < '1998-01-01') / stddev_samp(ret) FILTER (date < '1998-01-01') * sqrt(12), 6) AS pre, round(avg(ret) FILTER (date >= '1998-01-01') / stddev_samp(ret) FILTER (date >= '1998-01-01') * sqrt(12), 6) AS post FROM sleeves GROUP BY 1")
def pre_post_sharpe(s, d):
    return rounded(st.pre_post_sharpe(R.sleeves(s, d), ["strategy"], "1998-01-01"))


@query(X.PBO)
def pbo(s, d):
    return rounded(st.pbo(R.sleeves(s, d)))


@query(f"WITH {R.DAILY}, v AS (SELECT date, level FROM daily), r AS (SELECT a.date, count(b.level) AS n, (sum((b.level < a.level)::INT) + (sum((b.level = a.level)::INT) + 1) / 2.0) / count(*) AS p FROM v a JOIN v b ON b.date <= a.date GROUP BY a.date, a.level) SELECT date, CASE WHEN n >= 24 THEN CASE WHEN p <= 1 / 3 THEN 0.0 WHEN p <= 2 / 3 THEN 1.0 ELSE 2.0 END END::DOUBLE AS regime FROM r")
def expanding_tertile(s, d):
    return st.expanding_tertile(R.daily(s, d), "level", 24)


REGIME = "reg AS (SELECT DISTINCT date_trunc('quarter', date)::TIMESTAMP AS date, (quarter(date) % 3)::DOUBLE AS regime FROM panel)"


def _regime(s, d):
    return R.panel(s, d).select(F.date_trunc("quarter", "date").alias("date"), (F.quarter("date") % 3).cast("double").alias("regime")).distinct()


@query(f"WITH {R.SLEEVES}, {REGIME} SELECT regime, count(ret) AS n, round(avg(ret), 6) AS mean, round(avg(ret) / stddev_samp(ret) * sqrt(12), 6) AS sharpe FROM sleeves s ASOF JOIN reg r ON s.date >= r.date WHERE strategy = 's1' GROUP BY 1")
def regime_breakdown(s, d):
    return rounded(st.regime_breakdown(R.sleeves(s, d).where("strategy = 's1'"), _regime(s, d), 12.0))


@query(f"WITH {R.SLEEVES}, x AS (SELECT strategy, date, ret, month(date) % 3 AS regime FROM sleeves), m AS (SELECT *, avg(ret) OVER w AS a, count(ret) OVER w AS n, dense_rank() OVER (ORDER BY date) - 1 AS p FROM x WINDOW w AS (PARTITION BY strategy, regime ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT date, arg_max(strategy, row(a, strategy)) FILTER (n >= 6 AND a > 0 AND p >= 24) AS sleeve FROM m GROUP BY date")
def walk_forward(s, d):
    x = R.sleeves(s, d).withColumnRenamed("strategy", "sleeve")
    return st.walk_forward_assignment(x, x.select("date", (F.month("date") % 3).alias("regime")).distinct())


SPANS = [("1995-03-01", "1995-06-30"), ("1995-05-01", "1995-09-30"), ("1997-01-01", "1997-02-28")]


@query("WITH l AS (SELECT o_orderkey AS id, o_orderdate::DATE AS t0, (o_orderdate + INTERVAL 40 DAY)::DATE AS t1 FROM orders), s(a, b) AS (VALUES " + ", ".join(f"(DATE '{a}', DATE '{b}')" for a, b in SPANS) + ") SELECT id, t0, t1 FROM l WHERE NOT EXISTS (SELECT 1 FROM s WHERE t0 <= b AND t1 >= a)")
def interval_purge(s, d):
    lab = R.read(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("t0"), F.date_add(F.to_date("o_orderdate"), 40).alias("t1"))
    spans = s.createDataFrame(SPANS, "start string, end string").select(F.to_date("start").alias("start"), F.to_date("end").alias("end"))
    return st.purged_train(lab, spans)


@query(X.SPLITS)
def cpcv_splits(s, d):
    w = Window.partitionBy(F.lit(0)).orderBy("t0", "symbol")
    lab = R.labels(s, d).withColumn("pos", (F.row_number().over(w) - 1).cast("long"))
    return st.cpcv_splits(lab.select("pos", "t0", "t1"), 6, 2, 0.01)


# Time series


@query(f"WITH {R.BARS}, x AS (SELECT symbol, close - lag(close) OVER w AS d, lag(close) OVER w AS l FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)), g AS (SELECT symbol, regr_slope(d, l) AS b FROM x GROUP BY 1) SELECT symbol, round(CASE WHEN 1 + b >= 1 THEN 'inf'::DOUBLE ELSE -ln(2) / ln(greatest(1e-6, 1 + b)) END, 5) AS half_life FROM g")
def half_life(s, d):
    return rounded(tm.half_life(R.bars(s, d)), 5)


@query(f"WITH {R.BARS}, x AS (SELECT symbol, close - lag(close) OVER w AS d, lag(close) OVER w AS l FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)), g AS (SELECT symbol, regr_slope(d, l) AS b, regr_intercept(d, l) AS a FROM x GROUP BY 1) SELECT x.symbol, round(-any_value(b), 5) AS theta, round(-any_value(a) / any_value(b), 4) AS mu, round(stddev_samp(d - a - b * l), 5) AS sigma FROM x JOIN g USING (symbol) WHERE l IS NOT NULL GROUP BY 1")
def ou_params(s, d):
    o = tm.ou_params(R.bars(s, d))
    return o.select("symbol", F.round("theta", 5).alias("theta"), F.round("mu", 4).alias("mu"), F.round("sigma", 5).alias("sigma"))


@query(f"WITH {R.BARS}, x AS (SELECT symbol, ts, close AS x FROM bars), r AS (SELECT symbol, x - lag(x, 1) OVER w AS r1, x - lag(x, 2) OVER w AS r2, x - lag(x, 4) OVER w AS r4 FROM x WINDOW w AS (PARTITION BY symbol ORDER BY ts)) SELECT symbol, unnest([2, 4])::INT AS lag, round(unnest([var_samp(r2) / (2 * var_samp(r1)), var_samp(r4) / (4 * var_samp(r1))]), 6) AS vr FROM r GROUP BY symbol")
def variance_ratio(s, d):
    return rounded(tm.variance_ratio(R.bars(s, d), (2, 4)))


def _pairs(s, d):
    b = R.bars(s, d)
    x = b.where("symbol = 'click'").select("ts", F.col("close").alias("x"))
    return b.where("symbol <> 'click'").select(F.col("symbol").alias("pair"), "ts", F.col("close").alias("y")).join(x, "ts")


@query(f"WITH {R.BARS}, p AS (SELECT y.symbol AS pair, y.close AS y, x.close AS x FROM bars y JOIN bars x USING (ts) WHERE x.symbol = 'click' AND y.symbol <> 'click'), g AS (SELECT pair, regr_slope(y, x) AS ols, var_samp(y) - var_samp(x) AS d, covar_samp(x, y) AS c FROM p GROUP BY 1) SELECT pair, round(ols, 6) AS ols, round((d + sqrt(d * d + 4 * c * c)) / (2 * c), 4) AS tls FROM g")
def hedge_ratios(s, d):
    h = tm.hedge_ratios(_pairs(s, d))
    return h.select("pair", F.round("ols", 6).alias("ols"), F.round("tls", 4).alias("tls"))


@query(X.KALMAN)
def kalman_hedge(s, d):
    return rounded(tm.kalman_hedge(_pairs(s, d)))


@query()
def adf_test(s, d):
    return rounded(tm.adf(R.bars(s, d)), 4)


@query()
def cointegration_test(s, d):
    return rounded(tm.cadf(_pairs(s, d)), 4)


@query(X.HURST)
def hurst_exponent(s, d):
    return rounded(tm.hurst_exponent(R.bars(s, d), 40), 5)


@query(X.EWM_VOLATILITY)
def ewm_volatility(s, d):
    return rounded(labels.get_vol(R.bars(s, d), 20))


# Replay and strategies


def _weights(s, d):
    return panels.quantile_weights(momentum_factor(s, d)).withColumn("strategy", F.lit("mom"))


BOOK = f"{R.PANEL}, {MOM}, {R.SECTORS}, {NEUTRAL}, {weights_sql('z', 0.2, 20)}"
REPLAY = f"""WITH {R.PANEL}, {MOM}, {R.SECTORS}, {NEUTRAL}, {FWD}, {weights_sql('z', 0.2, 20)},
pos AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS p FROM (SELECT DISTINCT date FROM panel)),
names AS (SELECT DISTINCT code FROM weights), grid AS (SELECT date, p, code, coalesce(weight, 0) AS w FROM pos CROSS JOIN names LEFT JOIN weights USING (date, code)),
dl AS (SELECT g.*, w - coalesce(lag(w) OVER (PARTITION BY code ORDER BY p), 0) AS delta FROM grid g),
rt AS (SELECT code, p - 1 AS p, r FROM (SELECT date, code, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS r FROM panel) JOIN pos USING (date)),
b AS (SELECT dl.date, dl.p, sum(w * coalesce(r, 0)) AS gross, sum(abs(delta)) AS turnover, sum(CASE WHEN w < 0 THEN -w ELSE 0 END) AS short, sum((w <> 0)::INT) AS n_names FROM dl LEFT JOIN rt ON rt.code = dl.code AND rt.p = dl.p GROUP BY 1, 2),
a AS (SELECT count(*) / ((max(date)::DATE - min(date)::DATE) / 365.25) AS ann FROM pos)"""


@query(f"{REPLAY} SELECT 'mom' AS strategy, date, round(gross, 6) AS gross, round(turnover, 6) AS turnover, round(turnover * 0.0015, 6) AS cost, round(short * 0.0115 / ann, 6) AS borrow, round(gross - turnover * 0.0015 - short * 0.0115 / ann, 6) AS net, n_names::BIGINT AS n_names FROM b CROSS JOIN a WHERE p < (SELECT max(p) FROM pos)")
def backtest_net(s, d):
    r = bt.backtest(_weights(s, d), R.panel(s, d), borrow_bps=115.0, pad=False)
    return rounded(r.drop("blocked", "capacity"))


@query(X.frictions(BOOK))
def backtest_frictions(s, d):
    p = R.panel(s, d)
    even = F.month("date") % 2 == 0
    flags = mf.limit_lock_flags(p.withColumns({"ul": even.cast("int"), "ll": (~even).cast("int"), "high": F.col("close"), "low": F.col("close")}))
    costs = p.select("date", "code", (10 + F.col("code") % 7).cast("double").alias("bps"))
    r = bt.backtest(_weights(s, d), p, execution_lag=1, flags=flags, cost_panel=costs, borrow_bps=115.0, band=0.01, adv=panels.rolling_adv(p))
    return rounded(r)


@query(X.rebalance_band(BOOK))
def rebalance_band(s, d):
    w = _weights(s, d)
    return rounded(bt.apply_rebalance_band(w, w.select("date").distinct(), 0.02))


@query(X.open_fill(BOOK))
def open_fill(s, d):
    p = R.panel(s, d)
    w = _weights(s, d).withColumn("date", F.last_day("date").cast("timestamp"))
    return rounded(bt.open_fill_backtest(w, p.select("date", "code", "open"), borrow_bps=115.0))


@query(f"WITH {R.PANEL}, g AS (SELECT date, code, open / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS g FROM panel) SELECT date, code, round(1.0 / count(*) OVER (PARTITION BY date), 6) AS weight FROM g WHERE g <= -0.1")
def strategy_gap_reversal(s, d):
    return rounded(sg.GapReversal(0.1).weights(R.panel(s, d)))


@query("SELECT DISTINCT o_orderdate::TIMESTAMP AS date, 7::BIGINT AS code, 1.0::DOUBLE AS weight FROM orders WHERE day(o_orderdate) >= 25 OR day(o_orderdate) <= 3")
def strategy_calendar(s, d):
    days = R.read(s, d, "orders").select(F.col("o_orderdate").alias("date"), F.lit(7).cast("long").alias("code"), F.lit(1.0).alias("close")).distinct()
    return sg.CalendarTiming(7).weights(days)


@query(f"WITH {R.PANEL}, p AS (SELECT date, ln(max(close) FILTER (code = 1)) - ln(max(close) FILTER (code = 2)) AS x FROM panel WHERE code IN (1, 2) GROUP BY 1 HAVING count(DISTINCT code) = 2), z AS (SELECT date, CASE WHEN row_number() OVER (ORDER BY date) >= 14 THEN (x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0) END AS z FROM p WINDOW w AS (ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) SELECT date, unnest([1, 2])::BIGINT AS code, unnest([-0.5 * sign(z), 0.5 * sign(z)])::DOUBLE AS weight FROM z WHERE abs(z) > 1.5")
def strategy_pairs(s, d):
    return sg.Pairs(1, 2, 12, 1.5).weights(R.panel(s, d)).withColumn("code", F.col("code").cast("long"))


TSMOM = "vol AS (SELECT date, code, CASE WHEN count(r) OVER w >= 20 THEN greatest(0.05, stddev_samp(r) OVER w * sqrt(12)) END AS vol FROM (SELECT date, code, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS r FROM panel) WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 35 PRECEDING AND CURRENT ROW)), ts AS (SELECT date, code, close / lag(close, 12) OVER (PARTITION BY code ORDER BY date) - 1 AS m FROM panel), tsmom AS (SELECT date, code, sign(m) * 0.1 / vol / count(*) OVER (PARTITION BY date) AS weight FROM ts JOIN vol USING (date, code) WHERE m <> 0 AND vol > 0)"


def _tsmom(s, d):
    p = R.panel(s, d)
    return sg.tsmom_weights(p, sg.annualized_vol(p, 36, ann=12.0))


@query(f"WITH {R.PANEL}, {TSMOM} SELECT date, code, round(weight, 6) AS weight FROM tsmom WHERE weight <> 0")
def strategy_tsmom(s, d):
    return rounded(_tsmom(s, d))


@query(f"WITH {R.PANEL}, {MOM}, {R.SECTORS}, {NEUTRAL}, {weights_sql('z', 0.2, 20)}, {TSMOM} SELECT date, code, round(sum(weight) / 2, 6) AS weight FROM (SELECT date, code, weight FROM weights UNION ALL SELECT date, code, weight FROM tsmom WHERE weight <> 0) GROUP BY 1, 2 HAVING sum(weight) <> 0")
def blend_weights(s, d):
    return rounded(sg.blend_weights([_weights(s, d), _tsmom(s, d)]))


@query(f"WITH {R.PANEL}, {TSMOM}, {REGIME} SELECT t.date, code, round(weight * CASE regime WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0 END, 6) AS weight FROM (SELECT * FROM tsmom WHERE weight <> 0) t ASOF JOIN reg r ON t.date >= r.date WHERE regime IN (0, 1)")
def strategy_regime_gated(s, d):
    return rounded(sg.RegimeGated(sg.Replay(_tsmom(s, d)), _regime(s, d), sizing={0.0: 1.0, 1.0: 0.5}).weights(R.panel(s, d)))


@query(f"WITH {R.PANEL}, {MOM}, {R.SECTORS}, {NEUTRAL}, {weights_sql('z', 0.2, 20)}, {TSMOM}, {REGIME} SELECT t.date, code, round(weight, 6) AS weight FROM (SELECT date, code, weight, 0.0 AS of FROM tsmom WHERE weight <> 0 UNION ALL SELECT date, code, weight, 1.0 FROM weights) t ASOF JOIN reg r ON t.date >= r.date WHERE regime = of")
def strategy_regime_switch(s, d):
    return rounded(sg.RegimeSwitch(_regime(s, d), {0.0: sg.Replay(_tsmom(s, d)), 1.0: sg.Replay(_weights(s, d))}).weights(R.panel(s, d)))


@query()
def strategy_cointegrated_pair(s, d):
    return rounded(sg.CointegratedPair(1, 2, 24, 1.0, max_p=0.2).weights(R.panel(s, d)))


@query()
def strategy_johansen(s, d):
    return rounded(sg.JohansenBasket([1, 2, 3], 36, 0.5).weights(R.panel(s, d)), 4)


# Production and portfolio


@query(f"WITH {R.PANEL}, w AS (SELECT code, (code % 11 - 3) / 100.0 AS weight FROM (SELECT DISTINCT code FROM panel)), p AS (SELECT code, arg_max(close, date) AS price FROM panel GROUP BY 1) SELECT code, (floor(weight * 1e8 / price / 100 * (1 + 1e-9)) * 100)::BIGINT AS shares, round(floor(weight * 1e8 / price / 100 * (1 + 1e-9)) * 100 * price, 2) AS notional FROM w JOIN p USING (code) WHERE weight > 0 AND floor(weight * 1e8 / price / 100 * (1 + 1e-9)) > 0")
def equity_orders(s, d):
    p = R.panel(s, d)
    w = p.select("code").distinct().withColumn("weight", (F.col("code") % 11 - 3) / 100.0)
    return rounded(production.equity_orders(w, p.groupBy("code").agg(F.max_by("close", "date").alias("price")), 1e8, 100), 2)


@query(f"WITH {R.PANEL}, k AS (SELECT code, date AS after FROM panel WHERE month(date) = 3), o AS (SELECT date, code, CASE WHEN (code + month(date)) % 3 > 0 THEN open END AS open FROM panel), c AS (SELECT date, row_number() OVER (ORDER BY date) AS p FROM (SELECT DISTINCT date FROM panel)), f AS (SELECT k.code, k.after, o.date, o.open FROM k JOIN c a ON a.date = k.after JOIN c b ON b.p BETWEEN a.p + 1 AND a.p + 5 JOIN o ON o.code = k.code AND o.date = b.date AND o.open IS NOT NULL) SELECT k.code, k.after, min(f.date) AS fill_date, round(arg_min(f.open, f.date), 6) AS fill FROM k LEFT JOIN f ON f.code = k.code AND f.after = k.after GROUP BY 1, 2")
def next_open_fills(s, d):
    p = R.panel(s, d)
    keys = p.where("month(date) = 3").select("code", F.col("date").alias("after"))
    return rounded(production.next_open_fills(keys, p.select("date", "code", F.when((F.col("code") + F.month("date")) % 3 > 0, F.col("open")).alias("open"))))


@query(f"WITH {R.SLEEVES}, c AS (SELECT strategy, date, product(1 + ret) OVER (PARTITION BY strategy ORDER BY date) AS c FROM sleeves), p AS (SELECT strategy, date, c / greatest(1, max(c) OVER (PARTITION BY strategy ORDER BY date)) - 1 AS dd FROM c), g AS (SELECT strategy, arg_max(dd, date) AS dd FROM p GROUP BY 1) SELECT strategy, round(dd, 6) AS drawdown, CASE WHEN dd <= -0.15 THEN 'STOP' WHEN dd <= -0.12 THEN 'DERISK' WHEN dd <= -0.08 THEN 'ALERT' ELSE 'OK' END AS status FROM g")
def drawdown_status(s, d):
    return rounded(production.drawdown_status(R.sleeves(s, d), ["strategy"]))


@query(f"WITH {R.PANEL}, e AS (SELECT code, min(date) AS entry_date, arg_min(close, date) AS entry_px FROM panel WHERE date >= '1995-01-01' GROUP BY 1), dates AS (SELECT DISTINCT date FROM panel), g AS (SELECT code, date, entry_date, entry_px FROM e CROSS JOIN dates), m AS (SELECT g.*, last_value(p.close IGNORE NULLS) OVER (PARTITION BY g.code ORDER BY g.date) AS px FROM g LEFT JOIN panel p USING (code, date)) SELECT date, round(sum(CASE WHEN date >= entry_date AND px IS NOT NULL THEN 1000 * (px / entry_px - 1) ELSE 0 END), 4) AS pnl FROM m GROUP BY 1")
def pnl_curve(s, d):
    p = R.panel(s, d)
    e = p.where(F.col("date") >= F.lit("1995-01-01").cast("timestamp")).groupBy("code").agg(F.min("date").alias("entry_date"), F.min_by("close", "date").alias("entry_px")).withColumn("notional", F.lit(1000.0))
    return rounded(production.daily_pnl_curve(e, p), 4)


@query(f"WITH {R.SLEEVES}, g AS (SELECT strategy, avg(ret) AS m, var_samp(ret) AS v, count(ret) / ((max(date)::DATE - min(date)::DATE) / 365.25) AS ann FROM sleeves GROUP BY 1) SELECT strategy, round(m / v, 5) AS full, round(m / v / 2, 5) AS used, round(m * m / v / 2 * ann, 5) AS growth, round((m / v / 2 * m - (m / v / 2) ** 2 * v / 2) * ann, 5) AS growth_used, round(ann, 5) AS ann_factor FROM g")
def kelly(s, d):
    return rounded(portfolio.kelly(R.sleeves(s, d), ["strategy"]), 5)


@query("WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT a.i::INT AS i, b.i::INT AS j, round(covar_pop(a.x, b.x), 6) AS cov, count(*) AS n FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY 1, 2")
def vector_covariance(s, d):
    return rounded(portfolio.vector_moments(R.read(s, d, "embeddings")))


@query(f"WITH {R.PANEL}, v AS (SELECT date, code, (code % 5)::DOUBLE AS side FROM panel WHERE month(date) IN (1, 7)) SELECT date, code, round(side, 6) AS weight FROM v WHERE side > 0")
def filter_in_list(s, d):
    p = R.panel(s, d).where(F.month("date").isin(1, 7))
    return p.select("date", "code", (F.col("code") % 5).cast("double").alias("weight")).where("weight > 0")


@query(f"WITH {R.PANEL}, a AS (SELECT code, avg(close) AS target FROM panel WHERE month(date) = 1 AND code % 2 = 0 GROUP BY 1), b AS (SELECT code, avg(close) AS held FROM panel WHERE month(date) = 2 AND code % 3 = 0 GROUP BY 1) SELECT coalesce(a.code, b.code) AS code, round(coalesce(target, 0), 6) AS target, round(coalesce(held, 0), 6) AS held FROM a FULL JOIN b ON a.code = b.code")
def join_full_weights(s, d):
    p = R.panel(s, d)
    mean = lambda c: p.where(c).groupBy("code").agg(F.avg("close").alias("weight"))
    return rounded(joins.full_weights(mean("month(date) = 1 AND code % 2 = 0"), mean("month(date) = 2 AND code % 3 = 0")))


# Studies


@query(f"WITH {R.PANEL}, {MOM}, {FWD}, x AS (SELECT date, code, value FROM mom WHERE value IS NOT NULL), r AS (SELECT date, code, {RANK.format(c='value')} AS p FROM x) SELECT date, round(CASE WHEN count(*) >= 5 THEN avg(fwd_ret) FILTER (p >= 0.8) - avg(fwd_ret) FILTER (p <= 0.2) END, 6) AS ret FROM r LEFT JOIN fwd USING (date, code) GROUP BY date")
def factor_returns(s, d):
    p = R.panel(s, d)
    return rounded(sd.factor_returns(panels.trailing_momentum(p).withColumnRenamed("momentum", "value"), panels.forward_returns(p)))


@query(f"WITH {R.PANEL}, {MOM}, {FWD}, x AS (SELECT date, value, fwd_ret FROM mom JOIN fwd USING (date, code) WHERE value IS NOT NULL AND fwd_ret IS NOT NULL), r AS (SELECT date, fwd_ret, {RANK.format(c='value')} AS p FROM x) SELECT date, round(avg(fwd_ret) FILTER (p > 0.8), 6) AS top, round(avg(fwd_ret) FILTER (p <= 0.2), 6) AS bottom, round(avg(fwd_ret), 6) AS universe FROM r GROUP BY date")
def leg_decomposition(s, d):
    p = R.panel(s, d)
    return rounded(sd.leg_decomposition(panels.trailing_momentum(p).withColumnRenamed("momentum", "value"), panels.forward_returns(p)))


@query(f"WITH {R.PANEL}, x AS (SELECT date, code, ln(close) AS a, ln(volume) AS b FROM panel), g AS (SELECT date, code, a, CASE WHEN count(*) OVER w >= 10 THEN a - covar_samp(a, b) OVER w / var_samp(b) OVER w * b END AS r FROM x WINDOW w AS (PARTITION BY date)) SELECT date, code, round(coalesce((r - avg(r) OVER w) / nullif(stddev_samp(r) OVER w, 0), CASE WHEN count(r) OVER w = 0 THEN a END), 5) AS orth FROM g WINDOW w AS (PARTITION BY date)")
def orthogonalize(s, d):
    x = R.panel(s, d).select("date", "code", F.log("close").alias("a"), F.log("volume").alias("b"))
    return rounded(sd.orthogonalize(x, "a", "b").select("date", "code", "orth"), 5)


@query(f"WITH {R.SLEEVES}, p AS (SELECT date, max(ret) FILTER (strategy = 's0') AS a, max(ret) FILTER (strategy = 's1') AS b FROM sleeves GROUP BY 1), g AS (SELECT regr_intercept(b, a) AS alpha, regr_slope(b, a) AS beta, regr_count(b, a) AS n, regr_sxx(b, a) AS sxx, regr_syy(b, a) AS syy, regr_sxy(b, a) AS sxy, regr_avgx(b, a) AS mx FROM p) SELECT round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(alpha / sqrt((syy - sxy * sxy / sxx) / (n - 2) * (1.0 / n + mx * mx / sxx)), 5) AS t FROM g")
def regression_alpha(s, d):
    x = R.sleeves(s, d).groupBy("date").agg(F.max(F.when(F.col("strategy") == "s0", F.col("ret"))).alias("a"), F.max(F.when(F.col("strategy") == "s1", F.col("ret"))).alias("b"))
    r = sd.regression_alpha(x, "b", "a")
    return r.select(F.round("alpha", 6).alias("alpha"), F.round("beta", 6).alias("beta"), F.round("t", 5).alias("t"))


@query(f"WITH {R.SLEEVES} SELECT month(date)::INT AS month, round(avg(ret), 6) AS mean FROM sleeves GROUP BY 1 ORDER BY avg(ret) DESC, 1 LIMIT 3")
def seasonality(s, d):
    return rounded(sd.seasonality(R.sleeves(s, d)))


@query(f"WITH {R.PANEL}, {R.SECTORS}, l AS (SELECT sector, code, row_number() OVER (PARTITION BY sector ORDER BY sum(turnover) DESC, code) AS k FROM panel JOIN sectors USING (code) GROUP BY 1, 2) SELECT x.sector, x.code AS a, y.code AS b FROM l x JOIN l y ON x.sector = y.sector AND x.code < y.code WHERE x.k <= 8 AND y.k <= 8")
def pair_candidates(s, d):
    t = R.panel(s, d).groupBy("code").agg(F.sum("turnover").alias("turnover"))
    return sd.pair_candidates(t, R.sectors(s, d))


@query(f"WITH {R.PANEL}, r AS (SELECT code, date, close, abs(close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1) AS m FROM panel) SELECT code, count(close) AS n, min(date) AS start, max(date) AS \"end\", count(*) FILTER (m > 0.08) AS jumps FROM r GROUP BY 1")
def move_health(s, d):
    return sd.move_health(R.panel(s, d))


@query(f"WITH {R.PANEL}, w AS (SELECT code, min(date) AS s, min(date) + INTERVAL 5 MONTH AS e, CASE WHEN code % 2 = 0 THEN 1.0 ELSE -1.0 END AS side FROM panel GROUP BY 1), r AS (SELECT code, date, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS r FROM panel) SELECT w.code, side::DOUBLE AS side, s AS start, e::TIMESTAMP AS \"end\", round(side * (product(1 + coalesce(r, 0)) - 1), 5) AS total FROM w JOIN r ON r.code = w.code AND r.date > s AND r.date <= e GROUP BY w.code, side, s, e")
def event_returns(s, d):
    p = R.panel(s, d)
    w = p.groupBy("code").agg(F.min("date").alias("start")).withColumns({"end": F.col("start") + F.expr("interval 5 months"), "side": F.when(F.col("code") % 2 == 0, 1.0).otherwise(-1.0)})
    return rounded(sd.event_returns(p, w), 5)


@query(f"WITH {R.DAILY}, r AS (SELECT date, level / lag(level) OVER (ORDER BY date) - 1 AS ret FROM daily), v AS (SELECT date, stddev_samp(ret) OVER (ORDER BY date ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS vol FROM r) SELECT date, round(CASE WHEN vol <> 0 THEN greatest(0.0, least(3.0, (SELECT quantile_cont(vol, 0.5) FROM v) / vol)) END, 6) AS weight FROM v")
def vol_target_weights(s, d):
    w = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(-23, 0)
    return rounded(sd.vol_target_weights(R.daily(s, d).select("date", F.stddev_samp("ret").over(w).alias("vol"))))


# Streams


def _streamed(s, d, make, name):
    """Runs a stream over the events to its end, into a written table that is read back."""
    import tempfile
    import uuid

    root = s.conf.get("spark.checkpoint.dir", None)
    if not root and not s.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = root or f"file://{tempfile.mkdtemp()}"
    at = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    schema = R.read(s, d, "events").schema
    source = s.readStream.schema(schema).parquet(f"{d}/event[s].parquet")  # a pattern, as a stream wants a folder or a pattern
    side = F.when(F.col("event_type") == "purchase", "buy").when(F.col("event_type") == "error", "sell")
    ticks = source.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), (1 + F.col("user_id") % 10).cast("double").alias("volume"), side.alias("side"))
    out = make(ticks)
    q = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.schema(out.schema).parquet(f"{at}/out")


@query(ORACLE_SQL["dollar_bars"])
def stream_dollar_bars(s, d):
    from ..streaming.stateful import stream_bars

    return rounded(_streamed(s, d, lambda t: stream_bars(t, 5000.0), "bars"))


@query(ORACLE_SQL["tick_rule"])
def stream_tick_rule(s, d):
    from ..streaming.stateful import stream_tick_rule as rule

    return _streamed(s, d, rule, "rule").select("symbol", "seq", "sign")


# Margin, flows, factors and orders

MARGIN = "margin AS (SELECT o_orderdate::DATE AS \"Date\", o_custkey AS \"Code\", sum(o_totalprice) AS \"LongVol\", sum(o_orderkey % 7 * 1000.0) AS \"ShrtVol\" FROM orders GROUP BY 1, 2)"


def _margin(s, d):
    o = R.read(s, d, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("Date"), F.col("o_custkey").alias("Code")).agg(F.sum("o_totalprice").alias("LongVol"), F.sum(F.col("o_orderkey") % 7 * 1000.0).alias("ShrtVol"))


@query(f'WITH {MARGIN} SELECT "Date", "Code", round(("LongVol" - "ShrtVol") / nullif("LongVol" + "ShrtVol", 0), 8) AS margin_imbalance, round("ShrtVol" / nullif("LongVol", 0), 8) AS short_to_long FROM margin')
def margin_imbalance(s, d):
    return rounded(mf.margin_imbalance(_margin(s, d)), 8)


@query('SELECT o_orderdate::DATE AS "CalcDate", o_custkey AS "Code", round(sum(o_totalprice / 1e7), 8) AS short_interest FROM orders GROUP BY 1, 2')
def short_interest(s, d):
    reports = R.read(s, d, "orders").select(F.to_date("o_orderdate").alias("CalcDate"), F.col("o_custkey").alias("Code"), (F.col("o_totalprice") / 1e7).alias("ShrtPosToSO"))
    return rounded(mf.short_interest(reports), 8)


@query("""WITH t AS (SELECT o_orderdate::DATE AS d, o_orderpriority AS p, sum(o_totalprice) FILTER (o_orderstatus = 'P') AS e, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS w, sum(o_totalprice) FILTER (o_orderstatus = 'O') AS n FROM orders GROUP BY 1, 2)
SELECT d AS "Date", p AS "S33", round((coalesce(w, 0) + coalesce(n, 0)) / nullif(coalesce(e, 0) + coalesce(w, 0) + coalesce(n, 0), 0), 8) AS sector_short_ratio FROM t""")
def sector_short_ratio(s, d):
    part = lambda status: F.sum(F.when(F.col("o_orderstatus") == status, F.col("o_totalprice")))
    t = R.read(s, d, "orders").groupBy(F.to_date("o_orderdate").alias("Date"), F.col("o_orderpriority").alias("S33")).agg(part("P").alias("SellExShortVa"), part("F").alias("ShrtWithResVa"), part("O").alias("ShrtNoResVa"))
    return rounded(mf.sector_short_ratio(t), 8)


FLOWS = """flows AS (SELECT o_orderpriority AS section, last_day(o_orderdate)::DATE AS e, o_orderdate::DATE AS p, sum(CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END) AS bal, sum(o_totalprice) AS tot FROM orders GROUP BY 1, 2, 3),
latest AS (SELECT e AS date, arg_max(bal, p) AS bal, arg_max(tot, p) AS tot FROM flows WHERE section = '1-URGENT' GROUP BY 1)"""


def _flows(s, d):
    o = R.read(s, d, "orders")
    signed = F.when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    return o.groupBy(F.col("o_orderpriority").alias("Section"), F.last_day("o_orderdate").alias("EnDate"), F.to_date("o_orderdate").alias("PubDate")).agg(F.sum(signed).alias("FrgnBal"), F.sum("o_totalprice").alias("FrgnTot"))


@query(f"WITH {FLOWS} SELECT date, round(bal, 4) AS net_flow FROM latest")
def section_net_flow(s, d):
    return rounded(mf.section_net_flow(_flows(s, d), "Frgn", "1-URGENT"), 4)


@query(f"WITH {FLOWS} SELECT date, round(bal / nullif(tot, 0), 8) AS intensity FROM latest")
def net_flow_intensity(s, d):
    return rounded(mf.net_flow_intensity(_flows(s, d), "Frgn", "1-URGENT"), 8)


@query(f"""WITH {R.PANEL}, f AS (SELECT *, volume * 100 AS sh, CASE WHEN code % 5 > 0 THEN volume * (code % 3) * 60 END AS tr FROM panel),
g AS (SELECT *, CASE WHEN coalesce(sh, 0) - coalesce(tr, 0) > 0 THEN close * (coalesce(sh, 0) - coalesce(tr, 0)) END AS cap FROM f)
SELECT date, code, round(open / 10 / close, 8) AS earnings_yield, round(turnover / cap, 8) AS book_to_market, round(high * 100 / cap, 8) AS cf_yield, round(volume * 10 / cap, 8) AS sales_yield, round(low / 50 / close, 8) AS div_yield,
round(open / turnover, 8) AS roe, round(open / (turnover * 2), 8) AS roa, round(open * 1.5 / (volume * 10), 8) AS op_margin, round(low / high, 8) AS equity_ratio, round((high * 100 - low) / (turnover * 2), 8) AS accruals, round(-ln(cap), 8) AS size,
round(lag(close, 1) OVER w / lag(close, 12) OVER w - 1, 8) AS momentum FROM g WINDOW w AS (PARTITION BY code ORDER BY date)""")
def value_quality_size_factors(s, d):
    c = F.col
    facts = {
        "ShOutFY": c("volume") * 100, "TrShFY": F.when(c("code") % 5 > 0, c("volume") * (c("code") % 3) * 60), "FEPS": c("open") / 10, "Eq": c("turnover"), "CFO": c("high") * 100, "FSales": c("volume") * 10,
        "FDivAnn": c("low") / 50, "FNP": c("open"), "TA": c("turnover") * 2, "FOP": c("open") * 1.5, "EqAR": c("low") / c("high"), "NP": c("low"), "adj_close": c("close"),
    }
    return rounded(panels.value_quality_size_factors(R.panel(s, d).withColumns(facts)), 8)


HELD = "target AS (SELECT code, close / sum(close) OVER () AS weight FROM panel WHERE date = '1997-01-01'), held AS (SELECT code, close / sum(close) OVER () AS weight FROM panel WHERE date = '1996-12-01')"


def _book(s, d, month):
    p = R.panel(s, d).where(F.col("date") == F.lit(month).cast("timestamp"))
    total = p.agg(F.sum("close").alias("_total"))
    return p.join(F.broadcast(total)).select("code", (F.col("close") / F.col("_total")).alias("weight"))


@query(f"WITH {R.PANEL}, {HELD}, b AS (SELECT coalesce(t.code, h.code) AS code, coalesce(t.weight, 0) AS t, coalesce(h.weight, 0) AS h FROM target t FULL JOIN held h ON t.code = h.code) SELECT code, round(CASE WHEN abs(t - h) >= 0.002 THEN t ELSE h END, 8) AS weight FROM b WHERE CASE WHEN abs(t - h) >= 0.002 THEN t ELSE h END <> 0")
def banded_weights(s, d):
    return rounded(production.banded_weights(_book(s, d, "1997-01-01"), _book(s, d, "1996-12-01"), 0.002), 8)


@query("SELECT o_orderkey, round_even(o_totalprice / ((o_custkey + 1) * 10.0), 0)::BIGINT AS contracts FROM orders")
def hedge_contracts(s, d):
    return R.read(s, d, "orders").select("o_orderkey", production.hedge_contracts(F.col("o_totalprice"), F.col("o_custkey") + 1.0).alias("contracts"))


@query("""WITH c AS (SELECT o_orderdate::DATE AS announce, (o_orderdate + INTERVAL 30 DAY)::DATE AS effective, o_custkey::VARCHAR AS out_code, CASE o_orderstatus WHEN 'F' THEN 'periodic' WHEN 'O' THEN 'demotion' ELSE 'delisting' END AS out_kind, o_orderkey::VARCHAR AS in_code, CASE o_orderpriority WHEN '1-URGENT' THEN 'extraordinary' WHEN '2-HIGH' THEN 'periodic' ELSE 'succession' END AS in_kind FROM orders)
SELECT announce, effective, in_code || '0' AS code, in_kind AS kind, 1 AS side FROM c WHERE in_kind <> 'succession' UNION ALL SELECT announce, effective, out_code || '0', out_kind, -1 FROM c WHERE out_kind <> 'delisting'""")
def index_change_legs(s, d):
    o = R.read(s, d, "orders")
    kind = lambda c, values, rest: F.coalesce(*(F.when(F.col(c) == k, v) for k, v in values.items()), F.lit(rest))
    changes = o.select(
        F.to_date("o_orderdate").alias("announce"), F.date_add(F.to_date("o_orderdate"), 30).alias("effective"), F.col("o_custkey").alias("out_code"), kind("o_orderstatus", {"F": "periodic", "O": "demotion"}, "delisting").alias("out_kind"),
        F.col("o_orderkey").alias("in_code"), kind("o_orderpriority", {"1-URGENT": "extraordinary", "2-HIGH": "periodic"}, "succession").alias("in_kind"),
    )
    return sg.index_change_legs(changes)


@query()
def frac_diff_table(s, d):
    return rounded(tm.frac_diff_table(R.bars(s, d), (0.2, 0.4, 0.6, 0.8, 1.0), 1e-2), 4)


from . import more  # noqa: E402,F401  more queries, by the decorator above
