"""Hand-computed expectations."""

import datetime as dt
import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import semantics as sem
from tidemark.operators import backtest as bt
from tidemark.operators import bars as B
from tidemark.operators import fundamentals as fd
from tidemark.operators import joins, labels, panels, portfolio, production
from tidemark.operators import market_facts as mf
from tidemark.operators import statistics as st
from tidemark.operators import strategies as sg
from tidemark.operators import timeseries as tm
from tidemark.sources import parsers, store

T0 = dt.datetime(2024, 1, 1)


def day(n):
    return T0 + dt.timedelta(days=n)


def ticks(spark, prices, volumes=None, sides=None):
    v = volumes or [1.0] * len(prices)
    s = sides or [None] * len(prices)
    rows = [("X", T0 + dt.timedelta(seconds=i), i, float(p), float(q), e) for i, (p, q, e) in enumerate(zip(prices, v, s))]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, seq long, price double, volume double, side string")


def panel(spark, columns, **more):
    rows = [(day(i), code, float(p) if p is not None else None) for code, prices in columns.items() for i, p in enumerate(prices)]
    return spark.createDataFrame(rows, "date timestamp, code string, close double")


def column(df, name, by="date", **where):
    for k, v in where.items():
        df = df.where(F.col(k) == v)
    return [r[name] for r in df.orderBy(by).collect()]


P6 = [100, 101, 102, 101, 100, 101]


def test_bars(spark):
    t = ticks(spark, P6)
    rows = B.dollar_bars(t, 200).orderBy("bar_id").collect()
    assert len(rows) == 3
    assert (rows[0]["open"], rows[0]["high"], rows[0]["low"], rows[0]["close"], rows[0]["dollar"], rows[0]["n_ticks"]) == (100, 101, 100, 101, 201, 2)
    assert [r["n_ticks"] for r in B.tick_bars(t, 2).collect()] == [2, 2, 2]
    assert B.volume_bars(t, 3).count() == 2
    for make in (B.dollar_bars, B.tick_bars, B.volume_bars):
        with pytest.raises(ValueError):
            make(t, 0)


def test_tick_rule_and_imbalance(spark):
    t = ticks(spark, [100, 101, 101, 100, 100, 102])
    assert column(B.with_tick_rule(t), "sign", "seq") == [1, 1, 1, -1, -1, 1]
    one = B.dollar_imbalance_bars(ticks(spark, [100] * 4, sides=["buy", "sell", "sell", "sell"]), 200).collect()
    assert len(one) == 1 and one[0]["imbalance"] == -200
    with pytest.raises(ValueError):
        B.dollar_imbalance_bars(t, 10, "other")


def test_order_flow_per_bar(spark):
    """Ticks of one time belong to the first bar that closes then, unless the bars name their last ticks; 0 without ticks."""
    t = ticks(spark, [100] * 5, volumes=[1.0, 2, 3, 4, 5], sides=["buy", "sell", "buy", "buy", "sell"]).withColumn("ts", F.lit(T0) + F.expr("make_dt_interval(0, 0, 0, seq div 4)"))
    assert [r["flow"] for r in B.order_flow_per_bar(t, B.tick_bars(t, 2, close_seq=True)).orderBy("bar_id").collect()] == pytest.approx([-1 / 3, 1])
    assert [r["flow"] for r in B.order_flow_per_bar(t, B.tick_bars(t, 2)).orderBy("bar_id").collect()] == pytest.approx([0.6, 0])


def test_returns_and_momentum(spark):
    p = panel(spark, {"A": [100, 110, 121]})
    assert column(panels.forward_returns(p), "fwd_ret") == pytest.approx([0.1, 0.1, None])
    p = panel(spark, {"A": [100, 110, 121, 133.1]})
    assert column(panels.trailing_momentum(p, 2, 1), "momentum") == pytest.approx([None, None, 0.1, 0.1])
    gap = panel(spark, {"A": [100, None, 110]})
    w = panels.by_code()
    assert column(gap.select("date", sem.change("close", w, pad=True).alias("r")), "r") == pytest.approx([None, 0.0, 0.1])
    assert column(gap.select("date", sem.change("close", w).alias("r")), "r") == [None, None, None]


def test_universe(spark):
    listed = spark.createDataFrame([("1", "0111"), ("2", "0109"), ("3", "0112")], "Code string, Mkt string")
    assert {r["Code"] for r in panels.filter_common_stocks(listed).collect()} == {"1", "3"}
    t = panel(spark, {"A": [1, 1], "B": [9, 9], "C": [5, None]}).withColumnRenamed("close", "turnover")
    assert [r["code"] for r in panels.select_universe(t, 2, 2).collect()] == ["B", "A"]
    t = panel(spark, {"A": [100, 100], "B": [50, 50], "D": [1, 500]}).withColumnRenamed("close", "turnover")
    m = panels.point_in_time_universe(t, 2, 1, 1)
    assert column(m, "member", code="D") == [False, True]


def test_normal_distribution(spark):
    xs = [-9.0, -5.0, -3.6, -3.4, -1.0, 0.0, 0.5, 2.0, 3.49, 3.51, 8.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", sem.normal_cdf(F.col("x")).alias("p"))
    for r in df.collect():
        assert r["p"] == pytest.approx(sem.normal_cdf_value(r["x"]), abs=1e-12)


def test_point_in_time(spark):
    fund = spark.createDataFrame([("X", dt.date(2024, 1, 15), 1, 10.0), ("X", dt.date(2024, 4, 20), 2, 20.0)], "Code string, DiscDate date, DiscNo long, EPS double")
    days = [dt.date(2024, 1, 10), dt.date(2024, 1, 15), dt.date(2024, 1, 31), dt.date(2024, 4, 19), dt.date(2024, 4, 30)]
    dates = spark.createDataFrame([(d,) for d in days], "date date")
    for bucket in (None, "month"):
        assert column(fd.point_in_time(fund, dates, ["EPS"], bucket=bucket), "EPS") == [None, None, 10.0, 10.0, 20.0]


def test_announcement_delay(spark):
    rows = [("X", "FY", dt.date(2023, 5, 10)), ("X", "FY", dt.date(2024, 5, 20)), ("Y", "FY", dt.date(2022, 5, 10)), ("Y", "FY", dt.date(2024, 4, 29))]
    f = spark.createDataFrame(rows, "Code string, CurPerType string, DiscDate date")
    assert [(r["Code"], r["delay"]) for r in fd.announcement_delay(f).collect()] == [("X", 11)]


def test_guidance(spark):
    d = dt.date
    rows = [("X", "FY", d(2021, 5, 1), d(2021, 3, 31), d(2022, 3, 31), 90.0, 100.0), ("X", "FY", d(2022, 5, 1), d(2022, 3, 31), d(2023, 3, 31), 120.0, 100.0), ("X", "FY", d(2023, 5, 1), d(2023, 3, 31), d(2024, 3, 31), 120.0, 130.0)]
    f = spark.createDataFrame(rows, "Code string, CurPerType string, DiscDate date, CurFYEn date, NxtFYEn date, EPS double, NxFEPS double")
    got = fd.guidance_conservatism(f).collect()
    assert len(got) == 1 and got[0]["conservatism"] == pytest.approx(0.2)


def test_limit_lock(spark):
    rows = [(day(0), "A", 9.0, 10.0, 8.0, 0, 0, 5.0), (day(1), "A", 10.0, 10.0, 9.0, 1, 0, 5.0), (day(2), "A", 9.5, 10.0, 9.0, 1, 0, 5.0), (day(1), "B", 8.0, 9.0, 8.0, 0, 1, 5.0), (day(2), "B", 8.0, 9.0, 7.0, 0, 0, 0.0)]
    px = spark.createDataFrame(rows, "date timestamp, code string, close double, high double, low double, ul int, ll int, volume double")
    f = {(r["code"], r["date"]): (r["no_buy"], r["no_sell"]) for r in mf.limit_lock_flags(px).collect()}
    assert f == {("A", day(0)): (False, False), ("A", day(1)): (True, False), ("A", day(2)): (False, False), ("B", day(1)): (False, True), ("B", day(2)): (True, True)}


def test_margin(spark):
    m = spark.createDataFrame([(day(0), "A", 30.0, 10.0), (day(0), "B", 0.0, 0.0)], "Date timestamp, Code string, LongVol double, ShrtVol double")
    r = {x["Code"]: x for x in mf.margin_imbalance(m).collect()}
    assert r["A"]["margin_imbalance"] == 0.5 and r["A"]["short_to_long"] == pytest.approx(1 / 3) and r["B"]["margin_imbalance"] is None


def test_uniqueness_and_concurrency(spark):
    b = spark.createDataFrame([("X", day(i), 100.0 + i) for i in range(6)], "symbol string, ts timestamp, close double")
    e = spark.createDataFrame([("X", day(0), day(3)), ("X", day(2), day(5))], "symbol string, t0 timestamp, t1 timestamp")
    assert column(labels.concurrency(b, e), "n", "ts") == [1, 1, 2, 2, 1, 1]
    u = labels.average_uniqueness(b, e)
    assert column(u, "uniqueness", "t0") == [0.75, 0.75]
    assert column(labels.uniqueness_from_indicator(labels.indicator(b, e)), "uniqueness", "t0") == [0.75, 0.75]
    assert column(labels.time_decay(u, 1.0), "decay", "t0") == [1, 1]
    assert len(labels.sequential_bootstrap([(0, 3), (2, 5)], 5, 1)) == 5


def barrier_events(spark, bars_df):
    return spark.createDataFrame([("X", day(0), day(5), 0.02, None)], "symbol string, t0 timestamp, t1 timestamp, trgt double, side double")


@pytest.mark.parametrize(("path", "label", "ret"), [([100, 101, 103, 102, 100, 100, 100], 1, 0.03), ([100, 99, 97, 98, 100, 100, 100], -1, -0.03)])
def test_barriers(spark, path, label, ret):
    b = spark.createDataFrame([("X", day(i), float(p)) for i, p in enumerate(path)], "symbol string, ts timestamp, close double")
    r = labels.get_bins(labels.get_events(b, barrier_events(spark, b), 1, 1), b).collect()
    assert len(r) == 1 and r[0]["label"] == label and r[0]["ret"] == pytest.approx(ret) and r[0]["touch"] == day(2)


def test_barriers_pessimistic(spark):
    b = spark.createDataFrame([("X", day(i), 100.0, 103.0 if i == 1 else 100.0, 97.0 if i == 1 else 100.0) for i in range(7)], "symbol string, ts timestamp, close double, high double, low double")
    e = labels.get_events(b, barrier_events(spark, b), 1, 1, use_range=True)
    r = labels.get_bins_at_barrier(e, b, 1, 1).collect()[0]
    assert (r["kind"], r["label"]) == ("sl", -1) and r["ret"] == pytest.approx(-0.02)


def test_purge_and_embargo(spark):
    lab = spark.createDataFrame([(i, i, i + 2) for i in range(10)], "pos int, t0 int, t1 int")
    spans = spark.createDataFrame([(3, 5)], "start int, end int")
    assert sorted(r["pos"] for r in st.purged_train(lab, spans).collect()) == [0, 6, 7, 8, 9]
    emb = lambda test, size: sorted(r["pos"] for r in st.embargo_positions(spark.createDataFrame([(x,) for x in test], "pos int"), size, 10).collect())
    assert emb([3, 4, 5], 2) == [6, 7] and emb([1, 2, 7], 1) == [3, 8] and emb([9], 2) == []


def test_cpcv(spark):
    lab = spark.createDataFrame([(i, day(i), day(i)) for i in range(60)], "pos long, t0 timestamp, t1 timestamp")
    s = st.cpcv_splits(lab, 6, 2)
    test = s.where("role = 'test'")
    assert st.cpcv_paths(6, 2) == (15, 5)
    assert {r["count"] for r in test.groupBy("pos").count().collect()} == {5}
    assert {r["count"] for r in test.groupBy("split_id").count().collect()} == {20}
    assert s.groupBy("split_id", "pos").count().where("count > 1").count() == 0
    with pytest.raises(ValueError):
        st.cpcv_splits(lab, 3, 3)


def test_deflation():
    assert st.expected_max_sharpe(10, 1.0) == pytest.approx(1.5745, abs=0.02)
    n = st.min_track_record_length(0.1, 0.0, 0.0, 3.0)
    assert st.psr_value(0.1, 0.0, round(n), 0.0, 3.0) == pytest.approx(0.95, abs=1e-3)
    assert st.deflated_sharpe(0.2, 0.01, 100, 250, 0, 3) < st.deflated_sharpe(0.2, 0.01, 2, 250, 0, 3)


def test_pbo(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(240, 10))
    frame = lambda m: spark.createDataFrame([(f"s{j}", day(i), float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])], "strategy string, date timestamp, ret double")
    blocks, omegas = np.array_split(x, 8), []
    for half in combinations(range(8), 4):
        ins, oos = (np.vstack([blocks[b] for b in range(8) if (b in half) == side]) for side in (True, False))
        best = (ins.mean(0) / ins.std(0, ddof=1)).argmax()
        sr = oos.mean(0) / oos.std(0, ddof=1)
        omegas.append(((sr < sr[best]).sum() + 1) / 11)
    r = st.pbo(frame(x)).first()
    assert r["n_combos"] == 70 and r["pbo"] == pytest.approx(np.mean(np.array(omegas) <= 0.5))
    x[:, 3] += 0.5
    assert st.pbo(frame(x)).first()["pbo"] < 0.2
    with pytest.raises(ValueError):
        st.pbo_cscv(frame(x), 7)


def replay(spark, **kw):
    p = panel(spark, {"A": [100, 110, 99, 108.9]})
    w = p.select("date", "code", F.lit(1.0).alias("weight"), F.lit("s").alias("strategy"))
    return bt.backtest(w, p, costs_bps=0.0, **kw)


def test_replay_lag(spark):
    assert column(replay(spark), "gross") == pytest.approx([0.1, -0.1, 0.1])
    assert column(replay(spark, execution_lag=1), "gross") == pytest.approx([-0.1, 0.1])


def test_replay_blocks_and_band(spark):
    p = panel(spark, {"A": [100, 100, 110, 110]})
    w = p.select("date", "code", F.lit(1.0).alias("weight"), F.lit("s").alias("strategy"))
    flags = spark.createDataFrame([(day(0), "A", True, False)], "date timestamp, code string, no_buy boolean, no_sell boolean")
    r = bt.backtest(w, p, costs_bps=15.0, flags=flags).orderBy("date").collect()
    assert (r[0]["gross"], r[0]["blocked"], r[0]["turnover"]) == (0, 1, 0)
    assert r[1]["gross"] == pytest.approx(0.1) and r[1]["turnover"] == 1 and r[1]["net"] == pytest.approx(0.1 - 0.0015)
    none = flags.withColumn("no_buy", F.lit(False))
    assert column(bt.backtest(w, p, flags=none), "net") == column(bt.backtest(w, p), "net") == column(bt.backtest(w, p, band=0.0), "net")
    const = p.select("date", "code", F.lit(15.0).alias("bps"))
    assert column(bt.backtest(w, p, cost_panel=const), "net") == pytest.approx(column(bt.backtest(w, p), "net"))


def test_borrow(spark):
    p = panel(spark, {"A": [100, 100, 100, 100]})
    w = p.select("date", "code", F.lit(-1.0).alias("weight"), F.lit("s").alias("strategy"))
    r = bt.backtest(w, p, costs_bps=0.0, borrow_bps=120.0, ann=12.0).orderBy("date").collect()
    assert r[0]["borrow"] == pytest.approx(120 / 1e4 / 12)


def test_tsmom(spark):
    rows = [(day(31 * i), c, a + (b - a) * i / 14) for c, a, b in (("UP", 100.0, 160.0), ("DN", 100.0, 70.0), ("FLAT", 50.0, 50.0)) for i in range(15)]
    m = spark.createDataFrame(rows, "date timestamp, code string, close double")
    vol = m.select("date", "code", F.when(F.col("code") == "UP", 0.2).otherwise(0.4).alias("vol")).where("code <> 'FLAT'")
    last = {r["code"]: r["weight"] for r in sg.tsmom_weights(m, vol).where(F.col("date") == day(31 * 14)).collect()}
    assert last == pytest.approx({"UP": 0.25, "DN": -0.125})


def test_orders(spark):
    frame = lambda d, c: spark.createDataFrame([(k, float(v)) for k, v in d.items()], f"code string, {c} double")
    held, target = {"A": 0.0167, "B": 0.0167, "C": 0.002, "X": 0.0167}, {"A": 0.018, "B": 0.044, "D": 0.0167}
    got = {r["code"]: r["weight"] for r in production.banded_weights(frame(target, "weight"), frame(held, "weight"), 0.0025).collect()}
    assert got == pytest.approx({"A": 0.0167, "B": 0.044, "C": 0.002, "D": 0.0167})
    w = frame({"A": 0.4, "B": 0.1, "C": -0.3, "D": -0.2, "E": 0.001}, "weight")
    px = frame({"A": 2000, "B": 50000, "C": 1000, "D": 1, "E": 9000}, "price")
    assert {r["code"]: r["shares"] for r in production.equity_orders(w, px, 600_000).collect()} == {"A": 120, "B": 1}
    assert production.short_notional(w, 600_000).first()[0] == pytest.approx(300_000)
    h = spark.range(1).select(*(production.hedge_contracts(F.lit(float(x)), F.lit(40_000.0)).alias(f"h{i}") for i, x in enumerate((300_000, 150_000)))).first()
    assert (h["h0"], h["h1"]) == (1, 0)
    lot = production.lot_orders(frame({"Z": 0.55}, "weight"), frame({"Z": 400_000}, "price"), 300_000, {"Z": 1.0})
    assert (lot.first()["lots"], lot.first()["shortfall"]) == (0, pytest.approx(165_000))
    small = production.lot_orders(frame({"Z": 0.3}, "weight"), frame({"Z": 400_000}, "price"), 300_000, {"Z": 1.0}, {"Z": 0.1}).first()
    assert small["lots"] == pytest.approx(0.2)


def test_drawdown_status(spark):
    rows = [("a", day(31 * i), r) for i, r in enumerate([0.05, -0.09, 0.0, 0.0])] + [("b", day(31 * i), r) for i, r in enumerate([0.0, -0.10, -0.04, -0.03])] + [("c", day(0), None)]
    s = {r["k"]: (r["status"], r["drawdown"]) for r in production.drawdown_status(spark.createDataFrame(rows, "k string, date timestamp, ret double"), ["k"]).collect()}
    assert s["a"] == ("ALERT", pytest.approx(-0.09)) and s["b"][0] == "STOP" and s["c"][0] == "DATA-ERROR"


def test_asof_series_ignores_the_future(spark):
    def run(after):
        rows = [(dt.date(2024, 1, 1 + i), float(i if i < 7 else after)) for i in range(12) if i != 5]
        s = spark.createDataFrame(rows, "date date, value double")
        dates = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (5, 7, 9)], "date date")
        return column(mf.asof_series(s, dates), "value")

    assert run(7) == [3.0, 4.0, 7.0] and run(99) == [3.0, 4.0, 99.0]


@pytest.mark.parametrize("name", ["trailing_momentum", "low_volatility", "price_features", "rolling_adv"])
def test_features_ignore_the_future(spark, name):
    rng = np.random.default_rng(1)
    a = (100 * np.exp(np.cumsum(rng.normal(0, 0.02, 40)))).tolist()
    b = a[:30] + [x * 3 for x in a[30:]]
    make = getattr(panels, name)
    one, two = (make(panel(spark, {"A": x}).withColumn("turnover", F.col("close"))).where(F.col("date") < day(30)).orderBy("date").collect() for x in (a, b))
    assert one == two


def test_portfolio():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)) + 0.5 * rng.normal(size=(300, 1))
    cov = np.cov(x.T)
    for w in (portfolio.min_variance_weights(cov), portfolio.hrp_weights(cov), portfolio.nco_weights(cov)):
        assert w.sum() == pytest.approx(1)
    d = portfolio.denoise_covariance(cov, 300 / 8)
    assert np.allclose(d, d.T) and np.linalg.eigvalsh(d).min() > 0
    assert np.diag(d) == pytest.approx(np.diag(cov))


def test_unit_roots():
    rng = np.random.default_rng(3)
    e = rng.normal(size=500)
    walk, mean = np.cumsum(e), np.zeros(500)
    for i in range(1, 500):
        mean[i] = 0.5 * mean[i - 1] + e[i]
    assert tm.adf_p(tm.adf_statistic(mean)) < 0.01 < tm.adf_p(tm.adf_statistic(walk))
    j = tm.johansen(np.column_stack([walk, walk + rng.normal(size=500)]))
    assert j["trace"][0] > j["critical"][0]


def test_kalman_finds_the_slope(spark):
    rng = np.random.default_rng(4)
    x = np.cumsum(rng.normal(size=400)) + 50
    rows = [("p", day(i), float(2 * x[i] + 1 + rng.normal(0, 0.1)), float(x[i])) for i in range(400)]
    k = tm.kalman_hedge(spark.createDataFrame(rows, "pair string, ts timestamp, y double, x double"))
    assert column(k, "beta", "ts")[-1] == pytest.approx(2, abs=0.2)


def test_csv_numbers(spark):
    d = spark.createDataFrame([("1.5K", "2M", "-3.2%", "1,234.5", "x")], "a string, b string, c string, d string, e string")
    r = d.select(*(parsers.scaled_number(c).alias(c) for c in d.columns)).first()
    assert (r["a"], r["b"], r["c"], r["d"], r["e"]) == (1500, 2e6, -3.2, 1234.5, None)


def test_records_and_candles(spark):
    r = parsers.records(spark, [{"Date": "2024-01-05", "Code": "72030", "C": "110", "PubReason": {"a": 1}}, {"Date": "20240109", "Code": "130A0", "C": "-"}]).orderBy("Date").collect()
    assert (r[0]["Date"], r[0]["C"], r[0]["PubReason"], r[1]["Code"], r[1]["C"]) == (dt.date(2024, 1, 5), 110.0, '{"a": 1}', "130A0", None)
    c = parsers.parse_candles(spark.createDataFrame([('[["1","2","0.5","1.5","10","1704067200000"],["9","9","9","9","9","1704067200000"]]',)], "ohlcv string")).collect()
    assert len(c) == 1 and c[0]["open"] == 1.0


def test_store_is_idempotent(spark, tmp_path):
    raw, silver = f"{tmp_path}/raw", f"{tmp_path}/silver"
    q = "Date date, Code string, C double, AdjFactor double"
    spark.createDataFrame([(dt.date(2024, 1, 4), "7203", 100.0, 1.0), (dt.date(2024, 1, 5), "7203", 50.0, 0.5)], q).write.parquet(f"{raw}/a")
    raw_all = f"{raw}/*"
    assert store.materialize_long(spark, raw_all, silver) == 2
    assert store.materialize_long(spark, raw_all, silver) == 0
    spark.createDataFrame([(dt.date(2025, 1, 8), "7203", 51.0, 1.0), (dt.date(2024, 1, 9), "9984", 7.0, 1.0)], q).write.parquet(f"{raw}/b")
    assert store.materialize_long(spark, raw_all, silver) == 2
    p = store.load(spark, silver, ["C", "AdjFactor"])
    assert p.count() == 4
    adj = panels.back_adjust(p.where("code = '7203'"))
    assert column(adj, "adj_close") == [50, 50, 51]


def test_ledger(spark, tmp_path):
    from tidemark.plans.trials import TrialLedger

    led = TrialLedger(spark, f"{tmp_path}/trials")
    with pytest.raises(ValueError):
        led.preregister("s", "short", "short")
    with pytest.raises(KeyError):
        led.record_result("nobody", 1.0, 10, 0.0, 3.0)
    t = led.preregister("s", "a hypothesis", "a rationale of it")
    assert led.trial_count("s") == 0
    led.record_result(t, 0.1, 100, 0.0, 3.0)
    with pytest.raises(ValueError):
        led.record_result(t, 0.2, 100, 0.0, 3.0)
    for _ in range(2):
        led.log_trial("s", "x", {"a": 1}, 0.2, 100, 0.0, 3.0, "a hypothesis", "a rationale of it")
    assert led.trial_count("s") == 2 and led.sharpe_variance("s") == pytest.approx(0.005)
    assert led.log_scan_trials("s", 3, "a hypothesis", "a rationale of it") == 3 and led.log_scan_trials("s", 3, "a hypothesis", "a rationale of it") == 0
    assert 0 < led.deflated_sharpe(t) < 1


def test_judge(spark, tmp_path):
    from tidemark.plans.judge import judge_grid, to_html
    from tidemark.plans.trials import TrialLedger

    rng = np.random.default_rng(5)
    p = panel(spark, {c: (100 * np.exp(np.cumsum(rng.normal(0.001 * k, 0.02, 80)))).tolist() for k, c in enumerate("ABCDE")})
    grid = [sg.Replay(p.select("date", "code", F.when(F.col("code") == c, 1.0).otherwise(0.0).alias("weight")), f"only_{c}") for c in "AE"]
    v = judge_grid(grid, p, "scope", "some hypothesis", "some rationale", TrialLedger(spark, f"{tmp_path}/t"))
    assert v.n_trials == 2 and v.best == "only_E" and "only_A" in v.markdown and "<table>" in to_html(v)


def test_rest_source(spark, tmp_path):
    from tidemark.sources.connectors import register

    register(spark)
    (tmp_path / "p").write_text('{"data": [{"a": 1}], "pagination_key": "2"}')
    (tmp_path / "p.2").write_text('{"data": [{"a": 2}]}')
    d = spark.read.format("rest").option("url", f"file:{tmp_path}/p").option("page_param", "page").load()
    assert sorted(r["record"] for r in d.collect()) == ['{"a": 1}', '{"a": 2}']


def test_streams_equal_batches(spark, tmp_path):
    from tidemark.streaming.stateful import stream_bars

    rng = np.random.default_rng(6)
    t = ticks(spark, (100 + rng.normal(size=60).cumsum()).tolist())
    schema = t.schema
    for i in range(3):
        t.where(f"seq >= {20 * i} and seq < {20 * (i + 1)}").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = stream_bars(s, 500).writeStream.format("memory").queryName("streamed").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [tuple(r) for r in spark.sql("select * from streamed order by bar_id").collect()]
    assert got == [tuple(r) for r in B.dollar_bars(t, 500).orderBy("bar_id").collect()] and got


def test_joins_helpers(spark):
    a = spark.createDataFrame([(1, 5), (2, 9)], "k int, t int")
    assert joins.anti(a, a.where("k = 1"), ["k"]).count() == 1
    assert joins.densify(panel(spark, {"A": [1, 2], "B": [3]})).count() == 4
    assert math.isinf(st.min_track_record_length(0.0, 0.1, 0, 3))


def test_coerce_leaves_unknown_columns_alone(spark):
    r = parsers.records(spark, [{"DisclosedDate": "2024-02-01", "LTD": "20240308", "ProductCategory": "OPT", "IV": "0.21", "FrgnBal": "-5", "Code": "0123", "NP": "-"}]).first()
    assert str(r["DisclosedDate"]) == "2024-02-01" and str(r["LTD"]) == "2024-03-08" and r["ProductCategory"] == "OPT" and r["Code"] == "0123"
    assert r["IV"] == 0.21 and r["FrgnBal"] == -5.0 and r["NP"] is None


def test_pbo_common_dates_and_ties(spark):
    rows = [(f"s{k}", f"2020-01-{i + 1:02d}", float((i * (k + 3)) % 7 - 3)) for k in range(3) for i in range(20)]
    frame = lambda r: spark.createDataFrame(r, "strategy string, date string, ret double")
    whole = st.pbo(frame(rows), 4).first()
    extra = [*rows, ("s0", "2020-02-01", 9.0), ("s1", "2020-02-02", None)]  # dates that not all strategies have
    assert st.pbo(frame(extra), 4).first() == whole and whole["n_combos"] == 6
    assert st.pbo(frame([r for r in rows if r[1] < "2020-01-08"]), 4).first()["pbo"] is None
    assert st.pbo(frame([r for r in rows if r[0] == "s0"]), 4).first()["pbo"] is None
    twins = [(s, d, float(i % 5 - 1)) for s in ("a", "b") for i, d in enumerate(f"2020-01-{i + 1:02d}" for i in range(20))]
    assert {round(r["omega"], 6) for r in st.pbo_cscv(frame(twins), 4).collect()} == {round(1 / 3, 6)}


def test_time_decay_without_uniqueness(spark):
    u = spark.createDataFrame([("a", i, i + 1, 0.0) for i in range(3)], "symbol string, t0 long, t1 long, uniqueness double")
    assert column(labels.time_decay(u, 0.5), "decay", "t0") == [1, 1, 1]


def test_index_change_legs(spark):
    from tidemark.operators import strategies

    rows = [("2024-01-05", "2024-04-01", "1111", "periodic", "2222", "periodic"), (None, "2024-05-01", "3333", "delisting", "444A", "extraordinary"), ("2024-02-01", "2024-06-01", "5555", "demotion", "6666", "succession")]
    legs = strategies.index_change_legs(spark.createDataFrame(rows, "announce string, effective string, out_code string, out_kind string, in_code string, in_kind string")).collect()
    assert {(r["code"], r["kind"], r["side"]) for r in legs} == {("22220", "periodic", 1), ("11110", "periodic", -1), ("444A0", "extraordinary", 1), ("55550", "demotion", -1)}


def test_purged_cv_predict_tests_every_label_once(spark):
    class Mean:
        def fit(self, x, y):
            self.value, self.n = y.mean(), len(y)

        def predict(self, x):
            return np.full(len(x), self.value)

    rows = [(i, float(i % 7), float(i)) for i in range(60)]
    features = spark.createDataFrame(rows, "pos long, x double, y double")
    spans = spark.createDataFrame([(i, i, i + 2) for i in range(60)], "pos long, t0 long, t1 long")
    got = {r["pos"]: r["pred"] for r in bt.purged_cv_predict(features, spans, Mean, ["x"], 6, 0.05).collect()}
    assert sorted(got) == list(range(60))
    for k in range(6):  # the mean of what neither meets the fold nor lies in the 3 positions behind it
        lo, hi = 10 * k, 10 * k + 9
        train = [i for i in range(60) if not (i <= hi + 2 and i + 2 >= lo) and not (hi < i <= hi + 3)]
        assert got[lo] == pytest.approx(np.mean(train)) and got[hi] == got[lo]


def test_frac_diff_table(spark):
    import pandas as pd

    rng = np.random.default_rng(4)
    walk, noise = np.cumsum(rng.normal(size=400)), rng.normal(size=400)
    frame = pd.DataFrame([(s, i, float(x)) for s, xs in (("walk", walk), ("noise", noise)) for i, x in enumerate(xs)], columns=["symbol", "ts", "close"])
    table = tm.frac_diff_table(spark.createDataFrame(frame), (0.0, 0.5, 1.0), 1e-2)
    got = {(r["symbol"], r["d"]): r for r in table.collect()}
    assert not got["walk", 0.0]["stationary"] and got["walk", 1.0]["stationary"] and got["noise", 0.0]["stationary"]
    assert got["walk", 0.0]["corr"] == pytest.approx(1.0) and got["walk", 1.0]["critical"] == pytest.approx(-2.869, abs=0.01)
    least = {r["symbol"]: r["d"] for r in tm.least_d(table).collect()}
    assert least["noise"] == 0.0 and least["walk"] > 0


def test_value_factors_follow_forecasts(spark):
    rows = [(m, 1, 100.0 + m, 10.0, 4.0, 5.0, 50.0, 20.0, 0.0, 100.0 + m) for m in range(14)]
    pit = spark.createDataFrame(rows, "date int, code int, close double, ShOutFY double, TrShFY double, FEPS double, FNP double, NP double, Eq double, adj_close double")
    r = panels.value_quality_size_factors(pit).orderBy("date").collect()
    assert r[0]["earnings_yield"] == pytest.approx(0.05) and r[0]["roe"] is None and r[0]["size"] == pytest.approx(-math.log(600)) and r[0]["div_yield"] is None
    assert r[0]["momentum"] is None and r[13]["momentum"] == pytest.approx(112 / 101 - 1)


def test_bars_of_batches_equal_bars_of_ticks():
    rng = np.random.default_rng(5)
    n = 3000
    ts, price, volume = pd.date_range("2024-01-01", periods=n, freq="s"), rng.uniform(90, 110, n), rng.integers(0, 5, n).astype(float)
    for signed in (False, True):
        inc = price * volume * (rng.choice([-1.0, 1.0], n) if signed else 1)
        for threshold in (1.0, 777.0, 20000.0, 1e12):
            one, many = (B.ThresholdBar(threshold, signed) for _ in range(2))
            want = [b for row in zip(ts, price.tolist(), volume.tolist(), inc.tolist()) if (b := one.step(*row)) is not None]
            cuts = [0, 1, 2, 700, 701, 2999, n]
            got = [b for a, z in zip(cuts, cuts[1:]) for b in many.run(ts.array[a:z], price[a:z], volume[a:z], inc[a:z])]
            assert got == want and many.total == one.total


def test_settings(tmp_path, monkeypatch):
    from tidemark.sources.settings import get_env

    file = tmp_path / ".env"
    file.write_text("# a comment\n\nTM_A = 'one'\nTM_B=two=2\nTM_C=file\nno value\n")
    monkeypatch.setenv("TM_C", "set")
    for name in ("TM_A", "TM_B"):
        monkeypatch.setenv(name, "")
        monkeypatch.delenv(name)
    assert [get_env(n, path=str(file)) for n in ("TM_A", "TM_B", "TM_C", "TM_D")] == ["one", "two=2", "set", None]
    assert get_env("TM_D", "other", str(tmp_path / "absent")) == "other"
    for name in ("TM_A", "TM_B"):
        monkeypatch.delenv(name)


def test_external_series(spark, tmp_path):
    from tidemark.sources import external as ex

    spark.createDataFrame([(day(0), "1"), (day(0) + dt.timedelta(hours=5), "2"), (day(1), "x"), (day(2), "4")], "date timestamp, close string").write.parquet(str(tmp_path / "a.parquet"))
    got = ex.load_external_prices(spark, str(tmp_path), {"a": "a.parquet", "b": "absent"}, start="2024-01-01", end="2024-01-02")
    assert [(r.key, r.value) for r in got.orderBy("date").collect()] == [("a", 2.0), ("a", None)]
    assert ex.load_external_prices(spark, str(tmp_path), {"a": "a.parquet"}, keys=["c"]).count() == 0
    spark.createDataFrame([(day(0), 1.5, 9.0)], "date timestamp, vix double, vix_dup4 double").write.parquet(str(tmp_path / "m"))
    assert [tuple(r)[1:] for r in ex.load_macro(spark, str(tmp_path / "m")).collect()] == [("vix", 1.5)]
    assert ex.load_macro(spark, str(tmp_path / "none")).count() == 0


def test_publisher(spark, tmp_path):
    import sqlite3

    from tidemark.sources.publish import Publisher, decode_file, encode_file

    connect = lambda: sqlite3.connect(tmp_path / "db")
    c = connect()
    c.executescript("create table months (month text primary key, ret real); create table files (path text primary key, content text, encoding text)")
    p = Publisher(connect)
    rows = lambda *r: spark.createDataFrame(list(r), "month string, ret double")
    assert p.replace("months", rows(("a", 1.0), ("b", None))) == 2
    p.upsert("months", rows(("b", 2.0), ("c", 3.0)), ["month"])
    assert c.execute("select * from months order by 1").fetchall() == [("a", 1.0), ("b", 2.0), ("c", 3.0)]
    with pytest.raises(sqlite3.IntegrityError):
        p.replace("months", rows(("z", 1.0), ("z", 1.0)))
    assert c.execute("select count(*) from months").fetchone() == (3,)  # rolled back
    files = {"a.json": "ä".encode(), "b.parquet": b"\xff\x00"}
    p.put_files("files", files)
    p.put_files("files", files)
    assert {n: decode_file(t, e) for n, t, e in c.execute("select * from files")} == files
    assert encode_file("b.bin", b"\x00") == ("AA==", "base64")


def test_dashboard_and_previous_weights(spark):
    from tidemark.plans import judge

    intended = spark.createDataFrame([("2024-01", "s", "A", 0.1), ("2024-02", "s", "B", 0.2), ("2024-02", "t", "C", 0.3), ("2024-03", "s", "D", 0.4)], "month string, sleeve string, code string, weight double")
    assert [tuple(r) for r in production.previous_weights(intended, "2024-03", "s").collect()] == [("B", 0.2)]
    assert production.previous_weights(intended, "2024-01", "s").count() == 0
    daily = spark.createDataFrame([("2024-01-02", None)], "date string, net double")
    got = judge.dashboard({"ok": 1}, intended.select("month", "weight").where("code in ('A', 'D')"), daily, intended)
    assert got["latest"] == "2024-03" and [o["code"] for o in got["orders"]] == ["D"] and got["daily"] == [{"date": "2024-01-02", "net": None}]
    page = judge.index_page([("a<b", 2, 0.5), ("c", 3, 0.1)], ["c"])
    assert "5 trials" in page and "a&lt;b" in page and "c.html" in page and "b.html" not in page


def test_kelly_summary():
    assert portfolio.kelly_summary({"full": 2.0, "used": 1.0, "growth": 0.2, "growth_used": 0.15}) == "f*=2.00, used 1.00; growth a year +15.0%, full +20.0%"


def test_store_round(spark, tmp_path):
    raw, silver, features = (str(tmp_path / n) for n in ("raw", "silver", "features"))
    rows = [((T0 + dt.timedelta(days=i)).date().isoformat(), "7203", 100.0 + i, 1.0) for i in range(40)]
    spark.createDataFrame(rows, "Date string, Code string, C double, AdjFactor double").write.parquet(raw)
    store.materialize_all(spark, raw, silver, features)
    f = store.load_feature(spark, features, "ret", "2024-01-02", "2024-01-03")
    assert f.columns == ["date", "code", "ret"] and f.count() == 2
    assert store.load_feature(spark, features, "level").columns == ["date", "level"]
    assert store.load_feature(spark, features, "nothing") is None


def test_mask_to_days_ends_with_the_month(spark):
    from tidemark.operators import studies

    mask = spark.createDataFrame([(day(10), "A", True), (day(10), "B", False), (day(20), "B", True)], "date timestamp, code string, member boolean")
    days = spark.createDataFrame([(day(n),) for n in (5, 10, 15, 25)], "date timestamp")
    got = {(r.date.day - 1, r.code): r.member for r in studies.mask_to_days(mask, days).collect()}
    assert [got[(n, "A")] for n in (5, 10, 15, 25)] == [False, True, True, False]
    assert [got[(n, "B")] for n in (5, 10, 15, 25)] == [False, False, False, True]


def test_r_squared(spark):
    from tidemark.operators import studies

    d = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 2.0), (4.0, None)], "y double, pred double")
    r = studies.r_squared(d).first()
    assert r.n == 3 and math.isclose(r.r2, 0.5)


def test_cointegrated_pair_by_hand(spark):
    rng = np.random.default_rng(3)
    n, look = 60, 20
    x = 50 + np.cumsum(rng.normal(0, 1, n))
    y = 2 * x + 5 + rng.normal(0, 1, n)
    px = panel(spark, {"A": y.tolist(), "B": x.tolist()})
    want = {}
    for t in range(look + 1, n):
        a, b = y[t - look + 1 : t + 1], x[t - look + 1 : t + 1]
        beta = np.polyfit(b, a, 1)[0]
        s = a - beta * b
        z = (s[-1] - s.mean()) / s.std()
        if beta > 0 and abs(z) >= 1.0 and tm.adf_p(tm.adf_statistic(s - s.mean())) <= 0.5:
            want[day(t)] = -np.sign(z) * y[t] / (y[t] + beta * x[t])
    got = {r.date: r.weight for r in sg.CointegratedPair("A", "B", look, 1.0, max_p=0.5).weights(px).where("code = 'A'").collect()}
    assert want and got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    k, filtered = tm.Kalman(), {}
    for t in range(n):
        _, beta, _, _, _, z = k.step(None, y[t], x[t])
        if t > look and abs(z) >= 0.5 and beta > 0:
            filtered[day(t)] = -np.sign(z) * y[t] / (y[t] + beta * x[t])
    got = {r.date: r.weight for r in sg.CointegratedPair("A", "B", look, 0.5, max_p=None, method="kalman").weights(px).where("code = 'A'").collect()}
    assert filtered and got.keys() == filtered.keys() and all(math.isclose(got[d], filtered[d], rel_tol=1e-9) for d in filtered)


def test_johansen_basket_by_hand(spark):
    rng = np.random.default_rng(4)
    n, look = 50, 30
    a = 100 + np.cumsum(rng.normal(0, 1, n))
    prices = np.column_stack([a, a + 20 + rng.normal(0, 0.5, n), 60 + np.cumsum(rng.normal(0, 1, n))])
    px = panel(spark, {c: prices[:, i].tolist() for i, c in enumerate("ABC")})
    want = {}
    for t in range(look + 1, n):
        w = prices[t - look + 1 : t + 1]
        j = tm.johansen(w)
        s = w @ j["vectors"][:, 0]
        z = (s[-1] - s.mean()) / s.std()
        if sum(p > q for p, q in zip(j["trace"], j["critical"])) and abs(z) >= 0.5:
            money = -np.sign(z) * j["vectors"][:, 0] * w[-1]
            want[day(t)] = (money / np.abs(money).sum()).tolist()
    rows = sg.JohansenBasket(list("ABC"), look, 0.5).weights(px).collect()
    got = {d: [r.weight for r in sorted(rows, key=lambda r: r.code) if r.date == d] for d in {r.date for r in rows}}
    assert want and got.keys() == want.keys() and all(np.allclose(got[d], want[d]) for d in want)


def test_timing_goes_by_dates_not_by_rows_of_the_name(spark):
    px = panel(spark, {"A": [1.0, 2.0, 3.0]})
    signal = spark.createDataFrame([(day(1), 1.0)], "date timestamp, value double")
    assert [r.date for r in sg.SignalTiming(signal, "Z").weights(px).orderBy("date").collect()] == [day(1), day(2)]
    assert sg.CalendarTiming("Z").weights(px).count() == 3


def test_dividend_revision_over_a_split(spark):
    f = spark.createDataFrame([("A", dt.date(2024, 1, 10), 40.0), ("A", dt.date(2024, 4, 10), 20.0), ("A", dt.date(2024, 7, 10), 25.0)], "Code string, DiscDate date, FDivAnn double")
    cum = spark.createDataFrame([("A", dt.date(2024, 1, 1), 1.0), ("A", dt.date(2024, 3, 1), 0.5)], "Code string, date date, cum double")
    assert column(fd.dividend_forecast_revision(f, cum), "revision", "DiscDate") == [0.0, 0.25]
    assert column(fd.dividend_forecast_revision(f), "revision", "DiscDate") == [-0.5, 0.25]


def test_guidance_counts_disclosures_without_a_surprise(spark):
    ends = [dt.date(y, 3, 31) for y in range(2018, 2025)]
    rows = [("A", dt.date(e.year, 5, 10), "FY", 120.0, 100.0, e, ends[i + 1] if i != 3 else ends[i]) for i, e in enumerate(ends[:-1])]
    d = fd.guidance_conservatism(spark.createDataFrame(rows, "Code string, DiscDate date, CurPerType string, EPS double, NxFEPS double, CurFYEn date, NxtFYEn date"))
    assert [r.DiscDate.year for r in d.orderBy("DiscDate").collect()] == [2020, 2021, 2022, 2023]  # 2022 has none of its own, two before it


def test_variance_ratio_of_differences(spark):
    x = [1.0, 3.0, 2.0, 5.0, 4.0, 7.0]
    rows = [("X", day(i), v) for i, v in enumerate(x)]
    got = {r.lag: r.vr for r in tm.variance_ratio(spark.createDataFrame(rows, "symbol string, ts timestamp, close double"), (2, 4)).collect()}
    a = np.array(x)
    assert math.isclose(got[2], np.var(a[2:] - a[:-2], ddof=1) / (2 * np.var(np.diff(a), ddof=1))) and got[4] is None


def test_band_without_holdings_and_hedge_without_shorts(spark):
    w = spark.createDataFrame([("A", 0.001), ("B", 0.2)], "code string, weight double")
    assert production.banded_weights(w, w.limit(0), 0.01).count() == 2
    h = spark.createDataFrame([(-5e5, 1e3), (5e5, 0.0), (5e5, 1e4)], "s double, p double").select(production.hedge_contracts(F.col("s"), F.col("p")).alias("n"))
    assert [r.n for r in h.collect()] == [0, 0, 5]
