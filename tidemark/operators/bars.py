"""Information-driven bars from ticks (symbol, ts, seq, price, volume, side)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import so_far
from .folds import ordered_fold

def by_tick():
    return Window.partitionBy("symbol").orderBy("ts", "seq")

BAR = "bar_id long, open double, high double, low double, close double, volume double, dollar double, vwap double, n_ticks long, start_time timestamp, close_time timestamp"


class ThresholdBar:
    """Adds up increments; closes a bar where their size reaches the threshold and starts again from zero."""

    def __init__(self, threshold: float, signed: bool = False):
        if not threshold > 0:
            raise ValueError("the threshold must be positive")
        self.threshold, self.signed, self.n_bars = threshold, signed, 0
        self.reset()

    def reset(self) -> None:
        self.total, self.n, self.volume, self.dollar = 0.0, 0, 0.0, 0.0
        self.open = self.start = None
        self.high, self.low = -math.inf, math.inf

    def step(self, ts, price, volume, increment):
        if self.n == 0:
            self.open, self.start = price, ts
        self.n += 1
        self.high, self.low = max(self.high, price), min(self.low, price)
        self.volume += volume
        self.dollar += price * volume
        self.total += increment
        if (abs(self.total) if self.signed else self.total) < self.threshold:
            return None
        return self._close(ts, price)

    def _close(self, ts, price):
        bar = (self.n_bars, self.open, self.high, self.low, price, self.volume, self.dollar, self.dollar / self.volume if self.volume else None, self.n, self.start, ts)
        bar += (self.total,) * self.signed
        self.n_bars += 1
        self.reset()
        return bar

    def _end(self, increments: np.ndarray, start: int) -> int | None:
        """Adds up from ``start`` on, in growing pieces; where the open bar closes."""
        size = 64
        while start < len(increments):
            sums = np.cumsum(np.concatenate(([self.total], increments[start : start + size])))[1:]  # one after another, as ``step`` adds
            hit = ~((np.abs(sums) if self.signed else sums) < self.threshold)
            if hit.any():
                at = int(hit.argmax())
                self.total = float(sums[at])
                return start + at
            self.total, start, size = float(sums[-1]), start + len(sums), size * 4
        return None

    def run(self, ts, price, volume, increment) -> list[tuple]:
        """The bars that close within one batch: work per bar, not per tick. The same bars as ``step`` gives."""
        price, volume, increment = (np.asarray(c, float) for c in (price, volume, increment))
        dollar, bars, i = price * volume, [], 0
        while i < len(price):
            if self.n == 0:
                self.open, self.start = float(price[i]), ts[i]
            end = self._end(increment, i)
            stop = len(price) if end is None else end + 1
            self.n += stop - i
            self.high, self.low = max(self.high, float(np.fmax.reduce(price[i:stop]))), min(self.low, float(np.fmin.reduce(price[i:stop])))
            self.volume = float(np.cumsum(np.concatenate(([self.volume], volume[i:stop])))[-1])
            self.dollar = float(np.cumsum(np.concatenate(([self.dollar], dollar[i:stop])))[-1])
            if end is not None:
                bars.append(self._close(ts[end], float(price[end])))
            i = stop
        return bars


def _check(threshold: float) -> None:
    if not threshold > 0:
        raise ValueError("the threshold must be positive")


def _fold(trades: DataFrame, increment: Column, threshold: float, signed: bool = False) -> DataFrame:
    _check(threshold)
    ticks = trades.withColumn("_inc", increment.cast("double"))
    schema = BAR + ", imbalance double" * signed
    return ordered_fold(ticks, ["symbol"], ["ts", "seq"], lambda: ThresholdBar(threshold, signed), ["ts", "price", "volume", "_inc"], schema)


def volume_bars(trades: DataFrame, threshold: float) -> DataFrame:
    return _fold(trades, F.col("volume"), threshold)


def dollar_bars(trades: DataFrame, threshold: float) -> DataFrame:
    return _fold(trades, F.col("price") * F.col("volume"), threshold)


def tick_bars(trades: DataFrame, threshold: float, close_seq: bool = False) -> DataFrame:
    """Bars of ``ceil(threshold)`` ticks: the only kind with a closed form, so no recursion; an unfinished bar is dropped. ``close_seq`` adds the last tick's ``seq``."""
    _check(threshold)
    k = math.ceil(threshold)
    t = trades.withColumn("bar_id", F.floor((F.row_number().over(by_tick()) - 1) / k))
    at = F.struct("ts", "seq")
    g = t.groupBy("symbol", "bar_id").agg(
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.sum("volume").alias("volume"),
        F.sum(F.col("price") * F.col("volume")).alias("dollar"),
        F.count(F.lit(1)).alias("n_ticks"),
        F.min("ts").alias("start_time"),
        F.max("ts").alias("close_time"),
        *[F.max_by("seq", at).alias("close_seq")] * close_seq,
    )
    g = g.where(F.col("n_ticks") == k).withColumn("vwap", F.try_divide("dollar", "volume"))
    return g.select("symbol", *(c.strip().split()[0] for c in BAR.split(",")), *["close_seq"] * close_seq)


def with_tick_rule(trades: DataFrame, init: int = 1, out: str = "sign") -> DataFrame:
    """Adds the sign of the price change; no change carries the sign before, the first tick has ``init``."""
    d = trades.withColumn("_step", F.col("price") - F.lag("price").over(by_tick()))
    sign = F.last(F.when(F.col("_step") != 0, F.signum("_step")), ignorenulls=True).over(so_far(by_tick()))
    return d.withColumn(out, F.coalesce(sign, F.lit(float(init)))).drop("_step")


def with_signed_flow(trades: DataFrame, out: str = "sign") -> DataFrame:
    """The side where it is known, the tick rule elsewhere."""
    d = with_tick_rule(trades, out="_rule")
    side = F.lower("side")
    return d.withColumn(out, F.when(side == "buy", 1.0).when(side == "sell", -1.0).otherwise(F.col("_rule"))).drop("_rule")


def dollar_imbalance_bars(trades: DataFrame, threshold: float, sign_method: str = "auto") -> DataFrame:
    if sign_method not in ("auto", "tick"):
        raise ValueError(f"unknown sign method {sign_method!r}")
    d = with_signed_flow(trades) if sign_method == "auto" else with_tick_rule(trades)
    return _fold(d, F.col("sign") * F.col("price") * F.col("volume"), threshold, signed=True)


def order_flow_per_bar(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """(symbol, bar_id, flow): signed over total volume of the ticks in (last close, close]; 0 for an empty bar.

    A bar closes behind all ticks of its ``close_time``, or, where it has ``close_seq``, behind that one of them.
    """
    d = with_signed_flow(trades).select("symbol", "ts", "seq", "sign", "volume", F.lit(0).alias("_end"), F.lit(0).alias("_k"))
    known = "close_seq" in bars.columns
    closes = bars.select("symbol", F.col("close_time").alias("ts"), *[F.col("close_seq").alias("seq")] * known, "bar_id", F.lit(0 if known else 1).alias("_end"), F.lit(1).alias("_k"))
    both = d.unionByName(closes, allowMissingColumns=True)
    # from the end, so that the frame grows: one up to unboundedFollowing is added up anew for every row
    back = Window.partitionBy("symbol").orderBy(*(F.desc(c) for c in ("ts", "_end", "seq", "_k", "bar_id")))
    placed = both.withColumn("bar_id", F.last("bar_id", ignorenulls=True).over(so_far(back))).where("bar_id is not null")
    flow = F.try_divide(F.sum(F.col("sign") * F.col("volume")), F.sum("volume"))
    return placed.groupBy("symbol", "bar_id").agg(F.coalesce(flow, F.lit(0.0)).alias("flow"))


def volume_bucket_vpin(trades: DataFrame, bucket_volume: float, window: int = 50) -> DataFrame:
    """(symbol, bucket, vpin) over buckets of equal volume and known or inferred sides."""
    d = with_signed_flow(trades).withColumn("_cum", F.sum("volume").over(so_far(by_tick())))
    d = d.withColumn("bucket", F.floor((F.col("_cum") - F.col("volume")) / bucket_volume))
    g = d.groupBy("symbol", "bucket").agg(F.sum(F.col("sign") * F.col("volume")).alias("_imb"), F.sum("volume").alias("_vol"))
    w = Window.partitionBy("symbol").orderBy("bucket").rowsBetween(-(window - 1), Window.currentRow)
    full = F.count(F.lit(1)).over(w) == window
    return g.select("symbol", "bucket", F.when(full, F.sum(F.abs("_imb")).over(w) / F.sum("_vol").over(w)).alias("vpin"))


def bar_statistics(bars: DataFrame) -> DataFrame:
    """(symbol, n, autocorr, excess_kurtosis, jarque_bera) of log returns of closes."""
    w = Window.partitionBy("symbol").orderBy("bar_id")
    r = bars.withColumn("_r", F.log(F.col("close")) - F.log(F.lag("close").over(w)))
    r = r.withColumn("_l", F.lag("_r").over(w)).where("_r is not null")
    g = r.groupBy("symbol").agg(F.count("_r").alias("n"), F.abs(F.corr("_r", "_l")).alias("autocorr"), F.skewness("_r").alias("_s"), F.kurtosis("_r").alias("excess_kurtosis"))
    return g.select("symbol", "n", "autocorr", "excess_kurtosis", (F.col("n") / 6 * (F.col("_s") ** 2 + F.col("excess_kurtosis") ** 2 / 4)).alias("jarque_bera"))


def resample_last(series: DataFrame, unit: str, by: tuple[str, ...] = (), ts: str = "ts", value: str = "close") -> DataFrame:
    """Last value per hour, day, week or month."""
    return series.groupBy(*by, F.date_trunc(unit, F.col(ts)).alias(ts)).agg(F.max_by(value, F.col(ts)).alias(value))

