"""Orders, fills and the profit-and-loss record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import so_far
from .joins import full_weights


def banded_weights(target: DataFrame, held: DataFrame, band: float) -> DataFrame:
    """(code, weight): the held weight where the change is smaller than the band; zeros are dropped. With nothing held, the targets."""
    any_held = held.agg((F.count(F.lit(1)) > 0).alias("_any"))
    d = full_weights(target, held).join(F.broadcast(any_held))  # one row
    keep = F.col("_any") & (F.abs(F.col("target") - F.col("held")) < band)
    w = F.when(keep, F.col("held")).otherwise(F.col("target"))
    return d.select("code", w.alias("weight")).where("weight <> 0")


def equity_orders(weights: DataFrame, prices: DataFrame, capital: float, lot: int = 1) -> DataFrame:
    """(code, shares, notional): long orders in whole lots; orders of none are dropped."""
    d = weights.where("weight > 0").join(prices.select("code", "price"), "code").where("price > 0")
    # a relative 1e-9 keeps quotients that are whole but for rounding
    n = F.floor(F.col("weight") * capital / F.col("price") / lot * (1 + 1e-9)) * lot
    return d.select("code", n.cast("long").alias("shares"), (n * F.col("price")).alias("notional")).where("shares > 0")


def short_notional(weights: DataFrame, capital: float) -> DataFrame:
    return weights.agg(F.coalesce(F.sum(F.when(F.col("weight") < 0, -F.col("weight") * capital)), F.lit(0.0)).alias("short_notional"))


def hedge_contracts(notional: Column, index_price: Column, multiplier: float = 10.0) -> Column:
    """Rounded half to even; none without a positive notional and price."""
    n = F.bround(F.try_divide(notional, index_price * multiplier), 0).cast("long")
    return F.when((notional > 0) & (index_price > 0), n).otherwise(F.lit(0).cast("long"))


def lot_orders(weights: DataFrame, prices: DataFrame, capital: float, lot_units: dict[str, float], lot_steps: dict[str, float] | None = None) -> DataFrame:
    """(code, lots, filled, shortfall): orders rounded half to even to lot steps."""
    spark = weights.sparkSession
    steps = lot_steps or {}
    units = spark.createDataFrame([(k, float(v), float(steps.get(k, 1.0))) for k, v in lot_units.items()], "code string, unit double, step double")
    d = weights.join(F.broadcast(units), "code").join(prices.select("code", "price"), "code")
    one = F.col("price") * F.col("unit")
    lots = F.bround(F.col("weight") * capital / one / F.col("step"), 0) * F.col("step")
    return d.select("code", lots.alias("lots"), (lots * one).alias("filled"), (F.col("weight") * capital - lots * one).alias("shortfall"))


def next_open_fills(keys: DataFrame, opens: DataFrame, max_days: int = 5) -> DataFrame:
    """(key, after, fill_date, fill): first open within ``max_days`` rows of the calendar after a decision; unfilled keys stay.

    ``keys``: (code, after). ``opens``: (date, code, open).
    """
    w = Window.partitionBy(F.lit(0)).orderBy("_t", "_k")
    cal = opens.select("date").distinct()
    pos = cal.select("date", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")).alias("pos"))
    both = keys.select(F.col("after").alias("_t")).distinct().select("_t", F.lit(1).alias("_k"), F.lit(None).cast("int").alias("pos")).unionByName(pos.select(F.col("date").alias("_t"), F.lit(0).alias("_k"), "pos"))
    at = both.withColumn("_p", F.coalesce(F.last("pos", ignorenulls=True).over(so_far(w)), F.lit(0))).where("_k = 1").select(F.col("_t").alias("after"), "_p")
    d = keys.join(at, "after").withColumn("pos", F.explode(F.sequence(F.col("_p") + 1, F.col("_p") + max_days)))
    d = d.join(pos, "pos", "left").join(opens.select("date", "code", "open"), ["date", "code"], "left")
    ok = F.when(F.col("open").isNotNull(), F.col("date"))
    return d.groupBy("code", "after").agg(F.min(ok).alias("fill_date"), F.min_by("open", ok).alias("fill"))


def apply_actual_fills(fills: DataFrame, actual: DataFrame) -> DataFrame:
    """Actual prices where there are any, and the slippage against the model's."""
    d = fills.join(actual.select("code", F.col("fill").alias("_a")), "code", "left")
    return d.withColumn("slippage", F.try_divide("_a", "fill") - 1).withColumn("fill", F.coalesce("_a", "fill")).drop("_a")


def positions_pnl(notional: DataFrame, returns: DataFrame) -> DataFrame:
    """(pnl): sum of notional times return, missing returns as 0."""
    d = notional.join(returns.select("code", "ret"), "code", "left")
    return d.agg(F.coalesce(F.sum(F.col("notional") * F.coalesce("ret", F.lit(0.0))), F.lit(0.0)).alias("pnl"))


def drawdown_status(returns: DataFrame, by: list[str], alert: float = -0.08, derisk: float = -0.12, stop: float = -0.15, value: str = "ret") -> DataFrame:
    """(by, drawdown, status): last drawdown from a peak that starts at 1; any missing month is a DATA-ERROR."""
    w = so_far(Window.partitionBy(*by).orderBy("date"))
    d = returns.withColumn("_c", F.product(1 + F.coalesce(F.col(value), F.lit(0.0))).over(w))
    d = d.withColumn("_dd", F.col("_c") / F.greatest(F.lit(1.0), F.max("_c").over(w)) - 1)
    g = d.groupBy(*by).agg(F.max_by("_dd", "date").alias("drawdown"), F.count_if(F.col(value).isNull()).alias("_bad"))
    x = F.col("drawdown")
    status = F.when(F.col("_bad") > 0, "DATA-ERROR").when(x <= stop, "STOP").when(x <= derisk, "DERISK").when(x <= alert, "ALERT").otherwise("OK")
    return g.select(*by, "drawdown", status.alias("status"))


def daily_pnl_curve(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """(date, pnl): positions (code, notional, entry_px, entry_date) marked at the last known price; zero before the entry."""
    w = so_far(Window.partitionBy("code").orderBy("date"))
    days = prices.select("date").distinct().agg(F.collect_set("date").alias("_d"))  # one row: the dates of a curve
    grid = positions.join(F.broadcast(days)).select("code", "notional", "entry_px", "entry_date", F.explode("_d").alias("date"))
    d = grid.join(prices.select("date", "code", F.col("close").alias("_c")), ["date", "code"], "left").withColumn("_p", F.last("_c", ignorenulls=True).over(w))
    gain = F.when((F.col("date") >= F.col("entry_date")) & F.col("_p").isNotNull(), F.col("notional") * (F.col("_p") / F.col("entry_px") - 1)).otherwise(0.0)
    return d.groupBy("date").agg(F.sum(gain).alias("pnl"))


def month_chain(months: DataFrame) -> DataFrame:
    """(month, nav): chain-linked monthly returns."""
    return months.select("month", F.product(1 + F.col("ret")).over(so_far(Window.partitionBy(F.lit(0)).orderBy("month"))).alias("nav"))


def previous_weights(intended: DataFrame, month: str, sleeve: str) -> DataFrame:
    """(code, weight): what a sleeve intended in the last month on record before ``month``; empty without one.

    ``intended``: month, sleeve, code, weight. The month is the last of any sleeve.
    """
    before = intended.where(F.col("month") < month)
    last = before.agg(F.max("month").alias("_last"))
    return before.join(F.broadcast(last), F.col("month") == F.col("_last")).where(F.col("sleeve") == sleeve).select("code", "weight")  # one row
