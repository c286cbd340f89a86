"""SQL of the queries whose operators are recursions and iterations.

Recursions are recursive common table expressions or sums over pairs of rows,
the normal distribution is its power series, and combinations are bit masks.
"""

from __future__ import annotations

from . import relations as R


def normal_cdf(x: str) -> str:
    """The power series of odd powers over double factorials; beyond 8 the value is 0 or 1 to 15 digits."""
    a = f"abs({x})"
    series = f"list_sum(list_transform(range(0, 150), lambda k: exp((2 * k + 1) * ln({a}) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi()) - {a} * {a} / 2))) / sqrt(2 * pi())"
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {a} > 8 THEN ({x} > 0)::INT::DOUBLE WHEN {a} < 1e-200 THEN 0.5 ELSE 0.5 + sign({x}) * {series} END)"


def ewm_std(source: str, value: str, span: int, out: str) -> str:
    """(symbol, ts, out) from ``source`` by sums over all earlier rows; rows without a value age the weights."""
    keep = 1 - 2 / (span + 1)
    return f"""{out}_n AS (SELECT symbol, ts, {value} AS x, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM {source}),
{out}_w AS (SELECT i.symbol, i.ts, sum(pow({keep!r}, i.n - j.n)) AS w, sum(pow({keep!r}, 2 * (i.n - j.n))) AS w2, sum(pow({keep!r}, i.n - j.n) * j.x) AS wx, sum(pow({keep!r}, i.n - j.n) * j.x * j.x) AS wxx
  FROM {out}_n i LEFT JOIN {out}_n j ON i.symbol = j.symbol AND j.n <= i.n AND j.x IS NOT NULL GROUP BY 1, 2),
{out}_s AS (SELECT symbol, ts, CASE WHEN w - w2 / w > 1e-12 THEN sqrt(greatest(wxx - wx * wx / w, 0) / (w - w2 / w)) END AS {out} FROM {out}_w)"""


EWM_VOLATILITY = f"""WITH {R.BARS}, r AS (SELECT symbol, ts, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS r FROM bars),
{ewm_std('r', 'r', 20, 'vol')} SELECT symbol, ts, round(vol, 6) AS vol FROM vol_s"""

VPIN = f"""WITH {R.BARS}, d AS (SELECT symbol, ts, volume, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS d FROM bars),
{ewm_std('d', 'd', 20, 'sd')}, z AS (SELECT symbol, ts, volume, d / nullif(sd, 0) AS z FROM d JOIN sd_s USING (symbol, ts)),
i AS (SELECT symbol, ts, volume, volume * abs(2 * {normal_cdf('z')} - 1) AS i FROM z)
SELECT symbol, ts, round(CASE WHEN count(i) OVER w >= 20 AND count(volume) OVER w >= 20 THEN sum(i) OVER w / sum(volume) OVER w END, 6) AS vpin FROM i WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""

FRAC_DIFF = f"""WITH RECURSIVE {R.BARS}, w AS (SELECT 0 AS k, 1.0::DOUBLE AS w UNION ALL SELECT k + 1, -w * (0.4 - k) / (k + 1) FROM w WHERE abs(w * (0.4 - k) / (k + 1)) >= 0.01),
x AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM bars WHERE close IS NOT NULL)
SELECT a.symbol, a.ts, round(sum(w.w * b.close), 6) AS frac_diff FROM x a JOIN w ON a.n >= (SELECT count(*) FROM w) JOIN x b ON b.symbol = a.symbol AND b.n = a.n - w.k GROUP BY 1, 2"""

HURST = f"""WITH {R.BARS}, x AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n, count(*) OVER (PARTITION BY symbol) AS total FROM bars WHERE close IS NOT NULL),
s AS (SELECT a.symbol, k, any_value(a.total) AS total, stddev_pop(a.close - b.close) AS s FROM x a CROSS JOIN (SELECT unnest(range(2, 40)) AS k) JOIN x b ON b.symbol = a.symbol AND b.n = a.n - k WHERE k < least(40, floor(a.total / 2)) GROUP BY 1, 2)
SELECT symbol, round(regr_slope(ln(s), ln(k)) FILTER (total >= 20), 5) AS hurst FROM s WHERE s > 0 GROUP BY 1"""

IMBALANCE_BARS = f"""WITH RECURSIVE {R.TRADES}, st AS (SELECT *, price - lag(price) OVER (PARTITION BY symbol ORDER BY ts, seq) AS step FROM trades),
t AS (SELECT symbol, ts, seq, price, volume, row_number() OVER w AS n, price * volume * coalesce(CASE side WHEN 'buy' THEN 1.0 WHEN 'sell' THEN -1.0 END, last_value(CASE WHEN step <> 0 THEN sign(step) END IGNORE NULLS) OVER w, 1.0) AS inc FROM st WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
fold AS (SELECT symbol, n, inc::DOUBLE AS total, 0::BIGINT AS bar, (abs(inc) >= 3000)::INT AS closed FROM t WHERE n = 1
UNION ALL SELECT t.symbol, t.n, CASE WHEN f.closed = 1 THEN 0 ELSE f.total END + t.inc, f.bar + f.closed, (abs(CASE WHEN f.closed = 1 THEN 0 ELSE f.total END + t.inc) >= 3000)::INT FROM fold f JOIN t ON t.symbol = f.symbol AND t.n = f.n + 1),
x AS (SELECT f.symbol, f.bar AS bar_id, f.total, t.price, t.volume, t.ts, t.seq, f.closed FROM fold f JOIN t USING (symbol, n))
SELECT symbol, bar_id, round(arg_min(price, row(ts, seq)), 4) AS open, round(max(price), 4) AS high, round(min(price), 4) AS low, round(arg_max(price, row(ts, seq)), 4) AS close, round(sum(volume), 4) AS volume, round(sum(price * volume), 4) AS dollar, round(sum(price * volume) / sum(volume), 4) AS vwap, count(*) AS n_ticks, min(ts) AS start_time, max(ts) AS close_time, round(max(total) FILTER (closed = 1), 4) AS imbalance FROM x GROUP BY 1, 2 HAVING max(closed) = 1"""

KALMAN = f"""WITH RECURSIVE {R.BARS}, p AS (SELECT y.symbol AS pair, ts, y.close AS y, x.close AS x, row_number() OVER (PARTITION BY y.symbol ORDER BY ts) AS n FROM bars y JOIN bars x USING (ts) WHERE x.symbol = 'click' AND y.symbol <> 'click'),
q AS (SELECT 0.0001 / (1 - 0.0001) AS q),
k AS (SELECT pair, ts, n, y AS e, x * x + 1 + 0.001 AS s, x / (x * x + 1.001) * y AS beta, y / (x * x + 1.001) AS alpha,
  1 - x * x / (x * x + 1.001) AS p0, -x / (x * x + 1.001) AS p1, 1 - 1 / (x * x + 1.001) AS p2 FROM p WHERE n = 1
UNION ALL SELECT pair, ts, n, e, s, beta + g0 / s * e, alpha + g1 / s * e, p0 - g0 * g0 / s, p1 - g0 * g1 / s, p2 - g1 * g1 / s FROM (
  SELECT *, g0 * x + g1 + 0.001 AS s FROM (
    SELECT p.pair, p.ts, p.n, p.x, p.y - (k.beta * p.x + k.alpha) AS e, k.beta, k.alpha, k.p0 + q AS p0, k.p1, k.p2 + q AS p2, (k.p0 + q) * p.x + k.p1 AS g0, k.p1 * p.x + k.p2 + q AS g1 FROM k JOIN p ON p.pair = k.pair AND p.n = k.n + 1 CROSS JOIN q)))
SELECT pair, ts, round(beta, 6) AS beta, round(alpha, 6) AS alpha, round(e, 6) AS innovation, round(sqrt(s), 6) AS sd, round(e / sqrt(s), 6) AS z FROM k"""


def entropy(x: str) -> str:
    # The constants of the maximum-entropy approximation
    return f"(0.5 * (1 + ln(2 * pi())) - 79.047 * (avg(ln((exp({x}) + exp(-({x}))) / 2)) - 0.37457) ** 2 - 7.4129 * avg({x} * exp(-({x}) * ({x}) / 2)) ** 2)"


CAUSAL = f"""WITH x AS (SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_discount, l_tax])::DOUBLE AS x, l_extendedprice::DOUBLE AS y FROM lineitem WHERE l_extendedprice IS NOT NULL),
m AS (SELECT feature, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy, corr(x, y) AS rho FROM x WHERE x IS NOT NULL GROUP BY 1),
z AS (SELECT feature, rho, (x - mx) / sx AS zx, (y - my) / sy AS zy FROM x JOIN m USING (feature) WHERE x IS NOT NULL),
u AS (SELECT feature, rho, zx, zy, (zx - rho * zy) / sqrt(1 - rho * rho) AS zxy, (zy - rho * zx) / sqrt(1 - rho * rho) AS zyx FROM z),
s AS (SELECT feature, rho, CASE WHEN abs(rho) >= 1 - 1e-12 THEN 0 ELSE ({entropy('zy')} + {entropy('zxy')}) - ({entropy('zx')} + {entropy('zyx')}) END AS score FROM u GROUP BY 1, 2)
SELECT feature, round(rho, 6) AS rho, round(score, 6) AS score, CASE WHEN score > 0 THEN 'cause' ELSE 'effect' END AS role FROM s"""

PBO = f"""WITH {R.SLEEVES}, d AS (SELECT date, ntile(8) OVER (ORDER BY date) - 1 AS block FROM (SELECT date FROM sleeves WHERE ret IS NOT NULL GROUP BY 1 HAVING count(DISTINCT strategy) = (SELECT count(DISTINCT strategy) FROM sleeves))),
m AS (SELECT m FROM (SELECT unnest(range(0, 256)) AS m) WHERE bit_count(m) = 4),
sr AS (SELECT m, strategy, avg(ret) FILTER (m >> block & 1 = 1) / stddev_samp(ret) FILTER (m >> block & 1 = 1) AS ins, avg(ret) FILTER (m >> block & 1 = 0) / stddev_samp(ret) FILTER (m >> block & 1 = 0) AS oos FROM sleeves JOIN d USING (date) CROSS JOIN m GROUP BY 1, 2),
r AS (SELECT m, rank() OVER (PARTITION BY m ORDER BY oos) / (count(*) OVER (PARTITION BY m) + 1) AS omega, row_number() OVER (PARTITION BY m ORDER BY ins DESC, strategy) AS best FROM sr)
SELECT round(avg((omega <= 0.5)::INT), 6) AS pbo, count(*) AS n_combos FROM r WHERE best = 1"""

SHARPES = f"""m AS (SELECT strategy, count(ret) AS n, avg(ret) / stddev_samp(ret) AS sr, skewness(ret) AS sk, kurtosis(ret) + 3 AS ku FROM sleeves GROUP BY 1),
trials AS (SELECT count(*) AS k, var_samp(sr) AS v FROM m),
halves AS (SELECT p, 0 AS i, -9.0::DOUBLE AS lo, 9.0::DOUBLE AS hi FROM (SELECT unnest([1 - 1 / k, 1 - 1 / (k * exp(1))]) AS p FROM trials)
  UNION ALL SELECT p, i + 1, CASE WHEN c < p THEN mid ELSE lo END, CASE WHEN c < p THEN hi ELSE mid END FROM (SELECT *, {normal_cdf('mid')} AS c FROM (SELECT *, (lo + hi) / 2 AS mid FROM halves)) WHERE i < 55),
best AS (SELECT sqrt(any_value(v)) * ((1 - 0.5772156649015329) * min((lo + hi) / 2) + 0.5772156649015329 * max((lo + hi) / 2)) AS best FROM halves CROSS JOIN trials WHERE i = 55)"""

DEFLATED = f"""WITH RECURSIVE {R.SLEEVES}, {SHARPES}, z AS (SELECT strategy, n, sr, sqrt(n - 1) / sqrt(1 - sk * sr + (ku - 1) / 4 * sr * sr) AS f, best FROM m CROSS JOIN best)
SELECT strategy, n AS n_obs, round(sr, 6) AS sr, round({normal_cdf('(sr * f)')}, 6) AS psr, round({normal_cdf('((sr - best) * f)')}, 6) AS dsr FROM z"""

SPLITS = f"""WITH {R.LABELS}, l AS (SELECT row_number() OVER (ORDER BY t0, symbol) - 1 AS pos, t0, t1, count(*) OVER () AS n FROM labels3),
g AS (SELECT *, ntile(6) OVER (ORDER BY pos) - 1 AS grp FROM l),
c AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS split_id, a, b FROM (SELECT unnest(range(0, 6)) AS a) CROSS JOIN (SELECT unnest(range(0, 6)) AS b) WHERE a < b),
k AS (SELECT split_id, a AS grp, 0 AS block, a, b FROM c UNION ALL SELECT split_id, b, CASE WHEN b = a + 1 THEN 0 ELSE 1 END, a, b FROM c),
test AS (SELECT split_id, block, pos, t0, t1, n FROM g JOIN k USING (grp)),
spans AS (SELECT split_id, min(t0) AS lo, max(t1) AS hi, max(pos) AS last, max(pos) + ceil(any_value(n) * 0.01) AS emb FROM test GROUP BY split_id, block)
SELECT split_id::INT AS split_id, pos, 'test' AS role FROM test UNION ALL
SELECT split_id::INT, pos, 'train' FROM g JOIN c ON grp <> a AND grp <> b WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.split_id = c.split_id AND ((g.t0 <= s.hi AND g.t1 >= s.lo) OR (g.pos > s.last AND g.pos <= s.emb)))"""


def rebalance_band(weights: str) -> str:
    return f"""WITH RECURSIVE {weights}, dates AS (SELECT date, row_number() OVER (ORDER BY date) AS n FROM (SELECT DISTINCT date FROM weights)),
grid AS (SELECT date, n, code, coalesce(weight, 0)::DOUBLE AS t FROM dates CROSS JOIN (SELECT DISTINCT code FROM weights) LEFT JOIN weights USING (date, code)),
h AS (SELECT n, date, code, CASE WHEN abs(t) >= 0.02 THEN t ELSE 0 END AS held FROM grid WHERE n = 1
UNION ALL SELECT g.n, g.date, g.code, CASE WHEN abs(g.t - h.held) >= 0.02 THEN g.t ELSE h.held END FROM h JOIN grid g ON g.code = h.code AND g.n = h.n + 1)
SELECT 'mom' AS strategy, date, code, round(held, 6) AS weight FROM h WHERE held <> 0"""


def open_fill(weights: str) -> str:
    return f"""WITH {weights}, w0 AS (SELECT last_day(date)::TIMESTAMP AS date, code, weight FROM weights),
seq AS (SELECT date, fill, lead(fill) OVER (ORDER BY date) AS next_fill, row_number() OVER (ORDER BY date) AS p FROM (SELECT d.date, min(o.date) AS fill FROM (SELECT DISTINCT date FROM w0) d JOIN (SELECT DISTINCT date FROM panel) o ON o.date > d.date GROUP BY 1)),
w AS (SELECT code, p, weight FROM w0 JOIN seq USING (date)),
b AS (SELECT coalesce(w.p, h.p) AS p, coalesce(w.code, h.code) AS code, coalesce(w.weight, 0) AS weight, coalesce(h.weight, 0) AS held FROM w FULL JOIN (SELECT code, p + 1 AS p, weight FROM w) h ON w.code = h.code AND w.p = h.p),
g AS (SELECT s.date, fill, next_fill, sum(weight * coalesce(o1.open / nullif(o0.open, 0) - 1, 0)) AS gross, sum(abs(weight - held)) AS turnover, sum(CASE WHEN weight < 0 THEN -weight ELSE 0 END) AS short
  FROM b JOIN seq s USING (p) LEFT JOIN panel o0 ON o0.code = b.code AND o0.date = fill LEFT JOIN panel o1 ON o1.code = b.code AND o1.date = next_fill WHERE next_fill IS NOT NULL GROUP BY 1, 2, 3),
c AS (SELECT *, turnover * 0.0015 AS cost, short * 0.0115 * (next_fill::DATE - fill::DATE) / 365.25 AS borrow FROM g)
SELECT 'mom' AS strategy, date, fill, next_fill, round(gross, 6) AS gross, round(turnover, 6) AS turnover, round(cost, 6) AS cost, round(borrow, 6) AS borrow, round(gross - cost - borrow, 6) AS net FROM c"""


def frictions(weights: str) -> str:
    """Blocks by month, dead band, cost per name with the row that executes one row later, borrow, capacity."""
    return f"""WITH RECURSIVE {weights}, pos AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS p, count(*) OVER () - 1 AS last FROM (SELECT DISTINCT date FROM panel)),
px AS (SELECT date, p, code, volume = 0 OR month(date) % 2 = 0 AS no_buy, volume = 0 OR month(date) % 2 = 1 AS no_sell, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS r,
  CASE WHEN count(turnover) OVER a >= 5 THEN avg(turnover) OVER a END AS adv, (10 + code % 7)::DOUBLE AS bps FROM panel JOIN pos USING (date) WINDOW a AS (PARTITION BY code ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
md AS (SELECT p, median(bps) AS bps FROM px GROUP BY 1), total AS (SELECT median(bps) AS bps FROM px),
grid AS (SELECT g.date, g.p, g.code, coalesce(w.weight, 0)::DOUBLE AS t, coalesce(x.no_buy, false) AS no_buy, coalesce(x.no_sell, false) AS no_sell
  FROM (SELECT * FROM pos CROSS JOIN (SELECT DISTINCT code FROM weights)) g LEFT JOIN weights w ON w.date = g.date AND w.code = g.code LEFT JOIN px x ON x.code = g.code AND x.p = g.p + 1),
s AS (SELECT date, p, code, t, no_buy, no_sell, 0.0::DOUBLE AS before FROM grid WHERE p = 0
  UNION ALL SELECT g.date, g.p, g.code, g.t, g.no_buy, g.no_sell, CASE WHEN (s.t > s.before AND s.no_buy) OR (s.t < s.before AND s.no_sell) OR abs(s.t - s.before) < 0.01 THEN s.before ELSE s.t END FROM s JOIN grid g ON g.code = s.code AND g.p = s.p + 1),
h AS (SELECT *, (t > before AND no_buy) OR (t < before AND no_sell) AS stopped FROM s),
k AS (SELECT *, CASE WHEN stopped OR abs(t - before) < 0.01 THEN before ELSE t END AS held FROM h),
b AS (SELECT k.date, k.p, sum(held * coalesce(r.r, 0)) AS gross, sum(abs(held - before)) AS turnover, sum(abs(held - before) * coalesce(x.bps, md.bps, total.bps) / 1e4) AS cost, sum(CASE WHEN held < 0 THEN -held ELSE 0 END) AS short,
  sum((held <> 0)::INT) AS n_names, sum(stopped::INT) AS blocked, min(CASE WHEN held <> 0 AND a.adv > 0 THEN 0.1 * a.adv / abs(held) END) AS capacity
  FROM k LEFT JOIN px r ON r.code = k.code AND r.p = k.p + 2 LEFT JOIN px x ON x.code = k.code AND x.p = k.p + 1 LEFT JOIN md ON md.p = k.p + 1 CROSS JOIN total LEFT JOIN px a ON a.code = k.code AND a.p = k.p GROUP BY 1, 2),
y AS (SELECT count(*) / ((max(date)::DATE - min(date)::DATE) / 365.25) AS ann FROM pos)
SELECT 'mom' AS strategy, date, round(gross, 6) AS gross, round(turnover, 6) AS turnover, round(cost, 6) AS cost, round(short * 0.0115 / ann, 6) AS borrow, round(gross - cost - short * 0.0115 / ann, 6) AS net, n_names::BIGINT AS n_names, blocked::BIGINT AS blocked, round(capacity, 6) AS capacity FROM b CROSS JOIN y WHERE p + 2 <= (SELECT max(last) FROM pos)"""
