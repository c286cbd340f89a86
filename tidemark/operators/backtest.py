"""Replay of weights: blocked orders, dead bands, costs, borrow, capacity; fills at the close or the next open.

Weights are (strategy, date, code, weight) on rebalance dates; prices are
(date, code, close[, open]). Carrying is a recursion per (strategy, code), so it
is spread over names; sums by date come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import change, so_far
from .folds import ordered_fold


def _positions(dates: DataFrame) -> DataFrame:
    """(date, pos) over distinct dates; one row per date."""
    return dates.select("date").distinct().withColumn("pos", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1).cast("long"))


def target_grid(weights: DataFrame, dates: DataFrame, keep_from_first: bool = True) -> DataFrame:
    """(strategy, code, date, pos, target): every name of a strategy at every date, absent as 0."""
    names = weights.select("strategy", "code").distinct()
    calendar = _positions(dates)
    packed = calendar.agg(F.collect_list(F.struct("date", "pos")).alias("_d"))  # one row: rebalance dates, thousands at most
    grid = names.join(F.broadcast(packed)).select("strategy", "code", F.explode("_d").alias("d")).select("strategy", "code", "d.date", "d.pos")
    return grid.join(weights.select("strategy", "date", "code", F.col("weight").alias("target")), ["strategy", "date", "code"], "left").fillna(0.0, ["target"])


class Carry:
    """Held weight of one name: an order against a block isn't filled, one inside the band isn't sent."""

    def __init__(self, band: float = 0.0):
        self.band, self.held = band, 0.0

    def step(self, date, pos, target, no_buy, no_sell):
        before, delta = self.held, target - self.held
        blocked = bool(delta > 0 and no_buy or delta < 0 and no_sell)
        if not blocked and abs(delta) >= self.band:
            self.held = target
        return (date, pos, before, self.held, int(blocked and delta != 0))


def carry_weights(grid: DataFrame, band: float = 0.0, flags: DataFrame | None = None) -> DataFrame:
    """(strategy, code, date, pos, before, held, blocked). A recursion only where orders can fail to be filled."""
    if flags is None and not band:
        before = F.coalesce(F.lag("target").over(Window.partitionBy("strategy", "code").orderBy("pos")), F.lit(0.0))
        return grid.select("strategy", "code", "date", "pos", before.alias("before"), F.col("target").alias("held"), F.lit(0).alias("blocked"))
    if flags is None:
        grid = grid.withColumns({"no_buy": F.lit(False), "no_sell": F.lit(False)})
    else:
        grid = grid.join(flags.select("date", "code", "no_buy", "no_sell"), ["date", "code"], "left").fillna(False, ["no_buy", "no_sell"])
    kind = dict(grid.dtypes)["date"]
    out = ordered_fold(grid, ["strategy", "code"], ["pos"], lambda: Carry(band), ["date", "pos", "target", "no_buy", "no_sell"], f"date {kind}, pos long, before double, held double, blocked int")
    return out


def apply_rebalance_band(weights: DataFrame, dates: DataFrame, band: float) -> DataFrame:
    """(strategy, date, code, weight) after the dead band; zeros are dropped."""
    held = carry_weights(target_grid(weights, dates), band)
    return held.where(F.col("held") != 0).select("strategy", "date", "code", F.col("held").alias("weight"))


def one_way_cost(costs: DataFrame | None, bps: float) -> tuple[DataFrame | None, Column]:
    """Costs per name in basis points; a missing name costs the date's median, a missing date the panel's."""
    if costs is None:
        return None, F.lit(bps)
    by_date = costs.groupBy("date").agg(F.percentile("bps", 0.5).alias("_dm"))
    total = costs.agg(F.percentile("bps", 0.5).alias("_pm"))
    return costs.select("date", "code", F.col("bps").alias("_bps")).join(by_date, "date", "full").join(F.broadcast(total)), F.coalesce("_bps", "_dm", "_pm")


def backtest(
    weights: DataFrame,
    prices: DataFrame,
    costs_bps: float = 15.0,
    execution_lag: int = 0,
    flags: DataFrame | None = None,
    cost_panel: DataFrame | None = None,
    borrow_bps: float = 0.0,
    band: float = 0.0,
    adv: DataFrame | None = None,
    participation: float = 0.1,
    ann: float | None = None,
    pad: bool = True,
) -> DataFrame:
    """(strategy, date, gross, turnover, cost, borrow, net, n_names, blocked, capacity): one row per strategy and date with an outcome.

    A date's weights earn the return of the step that begins ``execution_lag``
    rows later; blocks and costs are those of the row that executes. ``borrow_bps``
    a year is charged on short gross. Capacity is the capital whose positions stay
    within ``participation`` of the least liquid name's turnover.
    """
    px = prices.select("date", "code", change("close", Window.partitionBy("code").orderBy("date"), pad=pad).alias("_r"))
    calendar = _positions(prices)
    if execution_lag < 0:
        raise ValueError("the lag can't be negative")
    if execution_lag:
        early = calendar.select("date", F.lag("date", execution_lag).over(Window.partitionBy(F.lit(0)).orderBy("pos")).alias("_d"))
        flags, cost_panel = (None if t is None else t.join(early, "date").where("_d is not null").drop("date").withColumnRenamed("_d", "date") for t in (flags, cost_panel))
    held = carry_weights(target_grid(weights, prices.select("date").distinct()), band, flags)
    n = calendar.agg(F.max("pos").alias("_last"), F.datediff(F.max("date"), F.min("date")).alias("_days"), F.count(F.lit(1)).alias("_n"))
    ret = px.join(calendar, "date").select("code", (F.col("pos") - 1 - execution_lag).alias("pos"), "_r")
    d = held.join(ret, ["code", "pos"], "left").withColumn("_delta", F.col("held") - F.col("before"))
    table, bps = one_way_cost(cost_panel, costs_bps)
    if table is not None:
        d = d.join(table.select("date", "code", "_bps"), ["date", "code"], "left").join(table.select("date", "_dm", "_pm").distinct(), "date", "left")
    d = d.withColumn("_cost", F.abs("_delta") * bps / 1e4)
    limit = F.lit(None).cast("double")
    if adv is not None:
        d = d.join(adv.select("date", "code", "adv"), ["date", "code"], "left")
        limit = F.min(F.when((F.col("held") != 0) & (F.col("adv") > 0), participation * F.col("adv") / F.abs("held")))
    g = d.groupBy("strategy", "date", "pos").agg(
        F.sum(F.col("held") * F.coalesce("_r", F.lit(0.0))).alias("gross"),
        F.sum(F.abs("_delta")).alias("turnover"),
        F.sum("_cost").alias("cost"),
        F.sum(F.when(F.col("held") < 0, -F.col("held")).otherwise(0.0)).alias("_short"),
        F.sum((F.col("held") != 0).cast("long")).alias("n_names"),
        F.sum("blocked").alias("blocked"),
        limit.alias("capacity"),
    )
    rows_a_year = F.lit(ann) if ann else F.when(F.col("_n") < 3, 252.0).otherwise(F.col("_n") / (F.col("_days") / 365.25))
    g = g.join(F.broadcast(n)).where(F.col("pos") + 1 + execution_lag <= F.col("_last"))
    g = g.withColumn("borrow", F.col("_short") * borrow_bps / 1e4 / rows_a_year)
    return g.select("strategy", "date", "gross", "turnover", "cost", "borrow", (F.col("gross") - F.col("cost") - F.col("borrow")).alias("net"), "n_names", "blocked", "capacity")


def open_fill_backtest(weights: DataFrame, opens: DataFrame, costs_bps: float = 15.0, borrow_bps: float = 0.0) -> DataFrame:
    """(strategy, date, fill, next_fill, gross, turnover, cost, borrow, net): filled at the first open after each decision.

    ``opens``: (date, code, open). Positions run from fill to fill; the last decision is dropped.
    """
    decisions = weights.select("strategy", "date").distinct()
    days = opens.select(F.col("date").alias("day")).distinct()
    ahead = Window.partitionBy(F.lit(0)).orderBy("_t", "_k").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    both = decisions.select("date").distinct().select(F.col("date").alias("_t"), F.lit(1).alias("_k"), F.lit(None).cast(dict(days.dtypes)["day"]).alias("_d")).unionByName(days.select(F.col("day").alias("_t"), F.lit(0).alias("_k"), F.col("day").alias("_d")))
    fills = both.withColumn("fill", F.first("_d", ignorenulls=True).over(ahead)).where("_k = 1").select(F.col("_t").alias("date"), "fill")
    seq = decisions.join(fills, "date").where("fill is not null").withColumn("next_fill", F.lead("fill").over(Window.partitionBy("strategy").orderBy("date")))
    seq = seq.withColumn("_pos", F.row_number().over(Window.partitionBy("strategy").orderBy("date")))
    w = weights.join(seq, ["strategy", "date"]).select("strategy", "code", "_pos", "weight")
    prev = w.select("strategy", "code", (F.col("_pos") + 1).alias("_pos"), F.col("weight").alias("held"))
    d = w.join(prev, ["strategy", "code", "_pos"], "full").fillna(0.0, ["weight", "held"]).join(seq, ["strategy", "_pos"])
    d = d.where("next_fill is not null")
    p = opens.select("code", F.col("date").alias("fill"), F.col("open").alias("_o0")), opens.select("code", F.col("date").alias("next_fill"), F.col("open").alias("_o1"))
    d = d.join(p[0], ["code", "fill"], "left").join(p[1], ["code", "next_fill"], "left").withColumn("_r", F.try_divide("_o1", "_o0") - 1)
    g = d.groupBy("strategy", "date", "fill", "next_fill").agg(
        F.sum(F.col("weight") * F.coalesce("_r", F.lit(0.0))).alias("gross"),
        F.sum(F.abs(F.col("weight") - F.col("held"))).alias("turnover"),
        F.sum(F.when(F.col("weight") < 0, -F.col("weight")).otherwise(0.0)).alias("_short"),
    )
    g = g.withColumns({"cost": F.col("turnover") * costs_bps / 1e4, "borrow": F.col("_short") * borrow_bps / 1e4 * F.datediff("next_fill", "fill") / 365.25})
    return g.select("strategy", "date", "fill", "next_fill", "gross", "turnover", "cost", "borrow", (F.col("gross") - F.col("cost") - F.col("borrow")).alias("net"))


def equity_curve(returns: DataFrame, by: list[str], value: str = "net") -> DataFrame:
    w = so_far(Window.partitionBy(*by).orderBy("date"))
    return returns.withColumn("equity", F.product(1 + F.coalesce(F.col(value), F.lit(0.0))).over(w))


def reprice(results: DataFrame, bps: list[float]) -> DataFrame:
    """Net returns for a grid of costs: gross less cost times turnover."""
    grid = F.explode(F.array(*map(F.lit, map(float, bps)))).alias("bps")
    return results.select("strategy", "date", "gross", "turnover", grid).withColumn("net", F.col("gross") - F.col("bps") / 1e4 * F.col("turnover"))


def stress_returns(returns: DataFrame, windows: list[tuple[str, str, str]], by: list[str], value: str = "net") -> DataFrame:
    """(by, window, total): compound return in each [lo, hi)."""
    spark = returns.sparkSession
    t = spark.createDataFrame(windows, "window string, lo string, hi string")
    d = returns.join(F.broadcast(t), (F.col("date") >= F.col("lo").cast("timestamp")) & (F.col("date") < F.col("hi").cast("timestamp")))
    return d.groupBy(*by, "window").agg((F.product(1 + F.coalesce(F.col(value), F.lit(0.0))) - 1).alias("total"))


def cpcv_backtest(features: DataFrame, splits: DataFrame, model_factory, columns: list[str]) -> DataFrame:
    """(split_id, pos, pred): fit and predict per split; the model is the caller's, one split's rows in memory.

    ``features``: pos, columns, y and perhaps w (sample weight). ``splits``: split_id, pos, role.
    """
    import pandas as pd

    weighted = "w" in features.columns

    def run(f: pd.DataFrame) -> pd.DataFrame:
        train, test = f[f["role"] == "train"], f[f["role"] == "test"]
        if train.empty or test.empty:
            return pd.DataFrame({"split_id": [], "pos": [], "pred": []})
        model = model_factory()
        model.fit(train[columns].to_numpy(), train["y"].to_numpy(), **({"sample_weight": train["w"].to_numpy()} if weighted else {}))
        return pd.DataFrame({"split_id": test["split_id"], "pos": test["pos"], "pred": model.predict(test[columns].to_numpy()).astype(float)})

    d = splits.join(features, "pos")
    return d.groupBy("split_id").applyInPandas(run, "split_id int, pos long, pred double")


def purged_cv_predict(features: DataFrame, labels: DataFrame, model_factory, columns: list[str], n_splits: int = 6, embargo_pct: float = 0.01) -> DataFrame:
    """(pos, pred): out-of-fold predictions of a purged k-fold; every label is tested once.

    ``features``: pos, columns, y and perhaps w. ``labels``: pos, t0, t1.
    """
    from .statistics import cpcv_splits

    return cpcv_backtest(features, cpcv_splits(labels, n_splits, 1, embargo_pct), model_factory, columns).select("pos", "pred")


def cpcv_path_sharpes(predictions: DataFrame, realised: DataFrame) -> DataFrame:
    """(path, sharpe): path p takes each position's p-th prediction; position times realised return."""
    path = F.row_number().over(Window.partitionBy("pos").orderBy("split_id")) - 1
    d = predictions.withColumn("path", path).join(realised.select("pos", "ret"), "pos").withColumn("_x", F.col("pred") * F.col("ret"))
    return d.groupBy("path").agg(F.try_divide(F.avg("_x"), F.stddev_samp("_x")).alias("sharpe"))


def path_summary(paths: DataFrame) -> DataFrame:
    s = F.col("sharpe")
    return paths.agg(F.avg(s).alias("mean"), F.coalesce(F.stddev_samp(s), F.lit(0.0)).alias("std"), F.min(s).alias("min"), F.max(s).alias("max"), F.avg((s < 0).cast("double")).alias("frac_negative"))
