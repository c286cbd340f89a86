"""Strategies: what a panel says up to each date, as weights (date, code, weight).

A strategy is any object with a name and ``weights(panel) -> DataFrame``. Every
frame ends at the current row, so that a weight never knows later rows.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import clip, guarded, ratio, trailing
from .joins import asof_backward
from .panels import quantile_weights
from .timeseries import kalman_hedge


class Strategy(ABC):
    name = "strategy"

    @abstractmethod
    def weights(self, panel: DataFrame) -> DataFrame:
        """(date, code, weight) for every date with a position; ``panel`` has date, code, close and perhaps open."""

    def tagged(self, panel: DataFrame) -> DataFrame:
        return self.weights(panel).withColumn("strategy", F.lit(self.name))


def _code() -> Window:
    return Window.partitionBy("code").orderBy("date")


class GapReversal(Strategy):
    """Names whose open fell ``threshold`` below the close before, in the last ``hold`` rows; equal weights."""

    def __init__(self, threshold: float = 0.1, hold: int = 1, side: int = 1):
        self.threshold, self.hold, self.side, self.name = threshold, hold, side, f"gap_{threshold}_{hold}"

    def weights(self, panel: DataFrame) -> DataFrame:
        gap = ratio("open", F.lag("close").over(_code())) - 1
        d = panel.withColumn("_g", (gap <= -self.threshold).cast("int"))
        d = d.withColumn("_hit", F.max("_g").over(trailing(_code(), self.hold))).where((F.col("_hit") == 1) & F.col("close").isNotNull())
        return d.select("date", "code", (F.lit(float(self.side)) / F.count(F.lit(1)).over(Window.partitionBy("date"))).alias("weight"))


class SignalTiming(Strategy):
    """One name, held while the last signal known exceeds the threshold; a null signal is flat. ``signal``: date, value."""

    def __init__(self, signal: DataFrame, code, threshold: float = 0.0, side: int = 1, name: str = "signal"):
        self.signal, self.code, self.threshold, self.side, self.name = signal, code, threshold, side, name

    def weights(self, panel: DataFrame) -> DataFrame:
        days = panel.select("date").distinct().withColumn("code", F.lit(self.code))
        d = asof_backward(days, self.signal.withColumnRenamed("date", "_d"), "date", "_d", ["value"])
        return d.where(F.col("value") > self.threshold).select("date", "code", F.lit(float(self.side)).alias("weight"))


class CalendarTiming(Strategy):
    """One name around the turn of the month."""

    def __init__(self, code, dom_start: int = 25, dom_end: int = 3, side: int = 1, name: str = "calendar"):
        self.code, self.dom_start, self.dom_end, self.side, self.name = code, dom_start, dom_end, side, name

    def weights(self, panel: DataFrame) -> DataFrame:
        dom = F.dayofmonth("date")
        d = panel.select("date").distinct().where((dom >= self.dom_start) | (dom <= self.dom_end))
        return d.select("date", F.lit(self.code).alias("code"), F.lit(float(self.side)).alias("weight"))


def pair_frame(panel: DataFrame, a, b) -> DataFrame:
    """(date, pa, pb) of dates with both prices, both positive."""
    return panel.where(F.col("code").isin(a, b)).groupBy("date").agg(F.max(F.when(F.col("code") == a, F.col("close"))).alias("pa"), F.max(F.when(F.col("code") == b, F.col("close"))).alias("pb")).where("pa > 0 and pb > 0")


class Pairs(Strategy):
    """Half a unit on either leg against the z-score of the log ratio."""

    def __init__(self, a, b, lookback: int = 60, entry: float = 1.5, name: str = "pairs"):
        self.a, self.b, self.lookback, self.entry, self.name = a, b, lookback, entry, name

    def weights(self, panel: DataFrame) -> DataFrame:
        w = Window.partitionBy(F.lit(0)).orderBy("date")
        d = pair_frame(panel, self.a, self.b).withColumn("_x", F.log("pa") - F.log("pb"))
        look = trailing(w, self.lookback)
        sd = F.stddev_pop("_x").over(look)
        z = F.when((F.row_number().over(w) >= self.lookback + 2) & (sd > 0), (F.col("_x") - F.avg("_x").over(look)) / sd)
        d = d.withColumn("_z", z).where(F.abs("_z") > self.entry)
        legs = F.array(F.struct(F.lit(self.a).alias("code"), (-0.5 * F.signum("_z")).alias("weight")), F.struct(F.lit(self.b).alias("code"), (0.5 * F.signum("_z")).alias("weight")))
        return d.select("date", F.explode(legs).alias("leg")).select("date", "leg.code", "leg.weight")


class EarningsRunup(Strategy):
    """Long names with ``lag`` to ``pre`` days to their announcement, short the rest; flat where a side is empty. ``days``: date, code, days."""

    def __init__(self, days: DataFrame, pre: int = 20, lag: int = 2, name: str = "runup"):
        self.days, self.pre, self.lag, self.name = days, pre, lag, name

    def weights(self, panel: DataFrame) -> DataFrame:
        d = self.days.join(panel.select("date").distinct(), "date", "left_semi").where("days is not null")
        d = d.withColumn("_long", (F.col("days") > self.lag) & (F.col("days") <= self.pre))
        by = Window.partitionBy("date")
        n_long, n = F.sum(F.col("_long").cast("int")).over(by), F.count(F.lit(1)).over(by)
        w = F.when(F.col("_long"), 1 / n_long).otherwise(-1 / (n - n_long))
        return d.withColumns({"_nl": n_long, "_n": n}).where((F.col("_nl") > 0) & (F.col("_nl") < F.col("_n"))).select("date", "code", w.alias("weight"))


class CrossSectional(Strategy):
    """Top against bottom quantile of a factor (date, code, value); ``long_only``: the top against the whole universe, equally weighted."""

    def __init__(self, factor: DataFrame, quantile: float = 0.2, name: str = "cross_sectional", long_only: bool = False, min_names: int = 5):
        self.factor, self.quantile, self.name, self.long_only, self.min_names = factor, quantile, name, long_only, min_names

    def weights(self, panel: DataFrame) -> DataFrame:
        w = quantile_weights(self.factor, "value", self.quantile, self.min_names, self.long_only)
        if not self.long_only:
            return w
        hedge = F.lit(-1.0) / F.count(F.lit(1)).over(Window.partitionBy("date"))
        universe = self.factor.where("value is not null").select("date", "code", hedge.alias("_h"))
        d = universe.join(w.select("date").distinct(), "date", "left_semi").join(w, ["date", "code"], "left")
        return d.select("date", "code", (F.col("_h") + F.coalesce("weight", F.lit(0.0))).alias("weight")).where(F.abs("weight") > 1e-15)


class LinearMeanReversion(Strategy):
    """One name, against the z-score of its price, bounded; from ``lookback`` + 1 prices on, flat without variation."""

    def __init__(self, code, lookback: int = 60, scale: float = 2.0, cap: float = 1.0, name: str = "linear_mr"):
        self.code, self.lookback, self.scale, self.cap, self.name = code, lookback, scale, cap, name

    def weights(self, panel: DataFrame) -> DataFrame:
        d = panel.where((F.col("code") == self.code) & F.col("close").isNotNull())
        w = trailing(_code(), self.lookback)
        sd = F.stddev_pop("close").over(w)
        z = F.when((F.row_number().over(_code()) > self.lookback) & (sd > 0), (F.col("close") - F.avg("close").over(w)) / sd)
        return d.select("date", "code", clip(-z / self.scale, -self.cap, self.cap).alias("weight")).where("weight <> 0")


class CointegratedPair(Strategy):
    """Price of ``a`` less the hedge ratio times that of ``b``, against its z-score from ``entry`` on; gross 1 in money.

    Over the last ``lookback`` dates with both prices (two more must exist), a unit-root
    test of the residuals must give at most ``max_p`` (None: no test), and with it the
    half-life at most ``max_half_life``. The hedge ratio and the z-score are
    those of the window (``rolling_ols``) or of a filter over all dates so far (``kalman``);
    a ratio that isn't positive is flat.
    """

    def __init__(self, a, b, lookback: int = 60, entry: float = 1.5, max_p: float | None = 0.05, max_half_life: float | None = None, method: str = "rolling_ols", name: str = "cointegrated"):
        if method not in ("rolling_ols", "kalman"):
            raise ValueError(f"unknown method {method!r}")
        self.a, self.b, self.lookback, self.entry, self.max_p, self.max_half_life, self.method, self.name = a, b, lookback, entry, max_p, max_half_life, method, name

    def weights(self, panel: DataFrame) -> DataFrame:
        max_p, max_half = self.max_p, self.max_half_life

        @F.pandas_udf("beta double, z double, ok boolean")
        def judge(ys: pd.Series, xs: pd.Series) -> pd.DataFrame:
            import numpy as np

            from .timeseries import adf_p, adf_statistic

            rows = []
            for y, x in zip(ys, xs):
                y, x = np.asarray(y, float), np.asarray(x, float)
                b = np.cov(x, y, ddof=0)[0, 1] / x.var() if x.var() > 0 else np.nan
                s = y - b * x
                z = (s[-1] - s.mean()) / s.std() if s.std() > 0 else np.nan
                ok = True
                if max_p is not None:
                    ok = bool(adf_p(adf_statistic(s - s.mean())) <= max_p)
                    if ok and max_half is not None:
                        rho = max(1 + np.polyfit(s[:-1], np.diff(s), 1)[0], 1e-6)
                        ok = bool(rho < 1 and -np.log(2) / np.log(rho) <= max_half)
                rows.append((b, z, ok))
            return pd.DataFrame(rows, columns=["beta", "z", "ok"])

        by = Window.partitionBy(F.lit(0)).orderBy("date")
        w = trailing(by, self.lookback)
        pairs = pair_frame(panel, self.a, self.b)
        d = pairs.select("date", "pa", "pb", F.row_number().over(by).alias("_n"), F.collect_list("pa").over(w).alias("_y"), F.collect_list("pb").over(w).alias("_x"))
        d = d.where(F.col("_n") >= self.lookback + 2).select("date", "pa", "pb", judge("_y", "_x").alias("j")).select("date", "pa", "pb", "j.*").where("ok")
        if self.method == "kalman":
            filtered = kalman_hedge(pairs.select(F.lit(0).alias("pair"), F.col("date").alias("ts"), F.col("pa").alias("y"), F.col("pb").alias("x")))
            d = d.drop("beta", "z").join(filtered.select(F.col("ts").alias("date"), "beta", "z"), "date")
        d = d.where((F.col("beta") > 0) & ~F.isnan("beta") & ~F.isnan("z") & (F.abs("z") >= self.entry))
        side = F.when(F.col("z") > 0, -1.0).otherwise(1.0)
        hedge = F.col("beta") * F.col("pb")
        gross = F.col("pa") + hedge
        legs = F.array(F.struct(F.lit(self.a).alias("code"), (side * F.col("pa") / gross).alias("weight")), F.struct(F.lit(self.b).alias("code"), (-side * hedge / gross).alias("weight")))
        return d.select("date", F.explode(legs).alias("leg")).select("date", "leg.code", "leg.weight")


class JohansenBasket(Strategy):
    """Against the z-score of the prices' strongest cointegrating combination, where the trace test finds a relation; gross 1 in money.

    Over the last ``lookback`` dates with all prices; two more must exist.
    """

    def __init__(self, codes: Sequence, lookback: int = 120, entry: float = 1.5, name: str = "johansen"):
        self.codes, self.lookback, self.entry, self.name = list(codes), lookback, entry, name

    def weights(self, panel: DataFrame) -> DataFrame:
        codes, entry = self.codes, self.entry

        @F.pandas_udf("array<double>")
        def judge(windows: pd.Series) -> pd.Series:
            import numpy as np

            from .timeseries import johansen

            out = []
            for rows in windows:
                x = np.stack([np.asarray(r, float) for r in rows])
                try:
                    j = johansen(x)
                except np.linalg.LinAlgError:
                    out.append(None)
                    continue
                v = j["vectors"][:, 0]
                s = x @ v
                z = (s[-1] - s.mean()) / s.std() if s.std() > 0 else 0.0
                ok = any(t > c for t, c in zip(j["trace"], j["critical"])) and abs(z) >= entry
                money = v * x[-1]
                out.append(((-1.0 if z > 0 else 1.0) * money / np.abs(money).sum()).tolist() if ok and np.abs(money).sum() > 0 else None)
            return pd.Series(out)

        p = panel.where(F.col("code").isin(codes) & (F.col("close") > 0)).groupBy("date").agg(*(F.max(F.when(F.col("code") == c, F.col("close"))).alias(f"p{i}") for i, c in enumerate(codes)))
        p = p.dropna()
        by = Window.partitionBy(F.lit(0)).orderBy("date")
        w = trailing(by, self.lookback)
        d = p.select("date", F.row_number().over(by).alias("_n"), F.collect_list(F.array(*(f"p{i}" for i in range(len(codes))))).over(w).alias("_w")).where(F.col("_n") >= self.lookback + 2)
        d = d.select("date", judge("_w").alias("_v")).where("_v is not null")
        legs = F.array(*(F.struct(F.lit(c).alias("code"), F.col("_v")[i].alias("weight")) for i, c in enumerate(codes)))
        return d.select("date", F.explode(legs).alias("leg")).select("date", "leg.code", "leg.weight")


class Replay(Strategy):
    """Weights that exist already."""

    def __init__(self, table: DataFrame, name: str = "replay"):
        self.table, self.name = table, name

    def weights(self, panel: DataFrame) -> DataFrame:
        return self.table.select("date", "code", "weight")


class Composite(Strategy):
    """Weighted sum of strategies; zeros are dropped."""

    def __init__(self, strategies: Sequence[Strategy], shares: Sequence[float] | None = None, name: str = "composite"):
        self.strategies, self.name = list(strategies), name
        self.shares = list(shares) if shares else [1 / len(self.strategies)] * len(self.strategies)

    def weights(self, panel: DataFrame) -> DataFrame:
        parts = [s.weights(panel).withColumn("weight", F.col("weight") * k) for s, k in zip(self.strategies, self.shares)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.groupBy("date", "code").agg(F.sum("weight").alias("weight")).where(F.abs("weight") > 1e-15)


class RegimeGated(Strategy):
    """A strategy scaled by the last regime known: by ``sizing``, else on in ``allowed`` ones. ``regime``: date, regime."""

    def __init__(self, base: Strategy, regime: DataFrame, allowed: Sequence | None = None, sizing: Mapping | None = None, name: str = "gated"):
        if allowed is None and sizing is None:
            raise ValueError("it needs allowed regimes or sizes")
        self.base, self.regime, self.name = base, regime, name
        self.sizes = dict(sizing) if sizing is not None else {k: 1.0 for k in allowed}

    def weights(self, panel: DataFrame) -> DataFrame:
        d = asof_backward(self.base.weights(panel), self.regime.withColumnRenamed("date", "_d"), "date", "_d", ["regime"])
        size = F.lit(0.0)
        for k, v in self.sizes.items():
            size = F.when(F.col("regime") == k, float(v)).otherwise(size)
        return d.select("date", "code", (F.col("weight") * size).alias("weight")).where("weight <> 0")


class RegimeSwitch(Strategy):
    """Routes each date to the strategy of the last regime known; an unknown regime is flat."""

    def __init__(self, regime: DataFrame, mapping: Mapping, name: str = "switch"):
        self.regime, self.mapping, self.name = regime, dict(mapping), name

    def weights(self, panel: DataFrame) -> DataFrame:
        parts = [s.weights(panel).withColumn("_for", F.lit(k)) for k, s in self.mapping.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        d = asof_backward(out, self.regime.withColumnRenamed("date", "_d"), "date", "_d", ["regime"])
        return d.where(F.col("regime") == F.col("_for")).select("date", "code", "weight")


def normalize_gross(weights: DataFrame) -> DataFrame:
    gross = F.sum(F.abs("weight")).over(Window.partitionBy("date"))
    return weights.withColumn("_g", gross).where("_g > 0").withColumn("weight", F.col("weight") / F.col("_g")).drop("_g")


def annualized_vol(px: DataFrame, window: int = 63, floor: float = 0.05, ann: float = 252.0) -> DataFrame:
    r = px.select("date", "code", (ratio("close", F.lag("close").over(_code())) - 1).alias("_r"))
    v = guarded(F.stddev_samp("_r"), "_r", trailing(_code(), window), max(20, window // 2)) * ann**0.5
    return r.select("date", "code", F.when(v.isNotNull(), F.greatest(F.lit(floor), v)).alias("vol"))


def tsmom_weights(monthly: DataFrame, vol: DataFrame, lookback: int = 12, vol_target: float = 0.1) -> DataFrame:
    """Sign of own momentum, scaled to a target volatility, shared among the names that have both and aren't flat."""
    m = ratio("close", F.lag("close", lookback).over(_code())) - 1
    d = monthly.select("date", "code", m.alias("_m")).join(vol.select("date", "code", "vol"), ["date", "code"]).where("_m <> 0 and vol > 0")
    w = F.signum("_m") * vol_target / F.col("vol") / F.count(F.lit(1)).over(Window.partitionBy("date"))
    return d.select("date", "code", w.alias("weight")).where("weight <> 0")


def blend_weights(sets: Sequence[DataFrame]) -> DataFrame:
    """Mean over all sets, absent ones counting 0; names that net to zero are dropped."""
    out = sets[0].select("date", "code", "weight")
    for s in sets[1:]:
        out = out.unionByName(s.select("date", "code", "weight"))
    return out.groupBy("date", "code").agg((F.sum("weight") / len(sets)).alias("weight")).where("weight <> 0")


def inverse_vol_shares(sleeves: DataFrame, window: int = 36, least: int = 12) -> DataFrame:
    """(date, sleeve, share) from the volatility of the rows before each date; equal where one is unknown."""
    before = Window.partitionBy("sleeve").orderBy("date").rowsBetween(-window, -1)
    d = sleeves.withColumn("_v", F.when(F.count("ret").over(before) >= least, F.stddev_samp("ret").over(before)))
    by = Window.partitionBy("date")
    inv = F.try_divide(F.lit(1.0), "_v")
    known = F.count("_v").over(by) == F.count(F.lit(1)).over(by)
    return d.select("date", "sleeve", F.when(known, inv / F.sum(inv).over(by)).otherwise(1 / F.count(F.lit(1)).over(by)).alias("share"))


def exchange_code(code: Column) -> Column:
    """Four-character codes as the data source has them: a zero behind."""
    return F.concat(code.cast("string"), F.lit("0"))


def index_change_legs(changes: DataFrame) -> DataFrame:
    """(announce, effective, code, kind, side): additions (1) and removals (-1) of an index that funds have to trade.

    ``changes``: announce, effective, out_code, out_kind, in_code, in_kind. Additions
    are periodic or extraordinary, removals periodic or demotions; successions make
    no demand, and the price of a delisting is held by its bid.
    """
    # Kinds that are traded
    sides = (("in", 1, ("periodic", "extraordinary")), ("out", -1, ("periodic", "demotion")))
    legs = F.array(*(F.when(F.col(f"{x}_kind").isin(*kinds), F.struct(exchange_code(F.col(f"{x}_code")).alias("code"), F.col(f"{x}_kind").alias("kind"), F.lit(side).alias("side"))) for x, side, kinds in sides))
    return changes.select("announce", "effective", F.explode(F.filter(legs, lambda x: x.isNotNull())).alias("leg")).select("announce", "effective", "leg.*")


def locate(dates: DataFrame, anchors: DataFrame, anchor: str, offset: int = 0) -> DataFrame:
    """Adds ``pos`` and ``day``: the first trading day at or after the anchor, ``offset`` rows on."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    cal = dates.select("date").distinct().withColumn("pos", F.row_number().over(w) - 1)
    ahead = Window.partitionBy(F.lit(0)).orderBy("_t", "_k").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    both = anchors.select(F.col(anchor).alias("_t")).distinct().select("_t", F.lit(0).alias("_k"), F.lit(None).cast("int").alias("pos")).unionByName(cal.select(F.col("date").alias("_t"), F.lit(1).alias("_k"), "pos"))
    first = both.withColumn("_p", F.first("pos", ignorenulls=True).over(ahead)).where("_k = 0").select(F.col("_t").alias(anchor), (F.col("_p") + offset).alias("pos"))
    return anchors.join(first, anchor, "left").join(cal.withColumnRenamed("date", "day"), "pos", "left")


def holding_windows(legs: DataFrame, dates: DataFrame, start: str = "announce", end: str = "effective", start_offset: int = 0, end_offset: int = -3) -> DataFrame:
    """(code, side, start, end): legs with both ends on the calendar, in order."""
    a = locate(dates, legs.where(F.col(start).isNotNull() & F.col(end).isNotNull()), start, start_offset).withColumnsRenamed({"day": "_s", "pos": "_ps"})
    b = locate(dates, a, end, end_offset).withColumnsRenamed({"day": "_e"})
    return b.where(F.col("_s") <= F.col("_e")).select("code", "side", F.col("_s").alias("start"), F.col("_e").alias("end"))


def window_weights(windows: DataFrame, dates: DataFrame) -> DataFrame:
    """(date, code, weight): equal weights per date and side over open windows; names that net to zero are dropped."""
    from .joins import interval_join

    d = interval_join(dates.select("date").distinct(), windows, "date", "start", "end", unit="month").select("date", "code", "side").distinct()
    w = F.col("side") / F.count(F.lit(1)).over(Window.partitionBy("date", "side"))
    return d.select("date", "code", w.alias("w")).groupBy("date", "code").agg(F.sum("w").alias("weight")).where(F.abs("weight") > 1e-15)
