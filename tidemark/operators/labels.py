"""Labels over price paths, and weights for samples that overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import normal_cdf, so_far
from .folds import ordered_fold
from .joins import interval_join


class EwmStd:
    """Exponentially weighted standard deviation, adjusted weights, bias-corrected; nulls age the weights."""

    def __init__(self, span: float):
        self.decay = 1 - 2 / (span + 1)
        self.w = self.w2 = self.mean = self.m2 = 0.0

    def step(self, ts, x):
        missing = x is None or x != x
        if self.w:
            self.w, self.w2, self.m2 = self.w * self.decay, self.w2 * self.decay**2, self.m2 * self.decay
        if not missing:
            w = self.w + 1.0
            delta = x - self.mean
            self.mean += delta / w
            self.m2 += delta * (x - self.mean)
            self.w, self.w2 = w, self.w2 + 1.0
        free = self.w - self.w2 / self.w if self.w else 0.0
        return (ts, (self.m2 / free) ** 0.5 if free > 1e-12 else None)


def ewm_std(df: DataFrame, value: str, span: float, key: str = "symbol", ts: str = "ts", out: str = "ewm_std") -> DataFrame:
    kind = dict(df.dtypes)[ts]
    got = ordered_fold(df, [key], [ts], lambda: EwmStd(span), [ts, value], f"`_at` {kind}, `{out}` double")
    return got.withColumnRenamed("_at", ts)


def get_vol(bars: DataFrame, span: float = 100, lookback: int = 1) -> DataFrame:
    """(symbol, ts, vol): exponentially weighted deviation of returns over ``lookback`` bars."""
    w = Window.partitionBy("symbol").orderBy("ts")
    r = bars.withColumn("_r", F.try_divide(F.col("close"), F.lag("close", lookback).over(w)) - 1)
    return ewm_std(r, "_r", span, out="vol")


def vertical_barriers(bars: DataFrame, events: DataFrame, num_bars: int) -> DataFrame:
    """(symbol, t0, t1): the time ``num_bars`` ahead; events too near the end are dropped."""
    w = Window.partitionBy("symbol").orderBy("ts")
    ahead = bars.select("symbol", F.col("ts").alias("t0"), F.lead("ts", num_bars).over(w).alias("t1"))
    return events.select("symbol", "t0").join(ahead.where("t1 is not null"), ["symbol", "t0"])


def touches(bars: DataFrame, events: DataFrame, pt: float, sl: float, use_range: bool = False, unit: str = "day") -> DataFrame:
    """Adds ``t_pt`` and ``t_sl``: the first bar in [t0, t1] past ``pt`` or ``sl`` times the target, strictly.

    ``events``: symbol, t0, t1, trgt, side (+1 or -1). With ``use_range``, highs
    and lows count as well, from the bar after the entry on.
    """
    entry = events.join(bars.select("symbol", F.col("ts").alias("t0"), F.col("close").alias("_p0")), ["symbol", "t0"])
    cols = ["close", "high", "low"] if use_range else ["close"]
    path = interval_join(bars.select("symbol", "ts", *cols), entry, "ts", "t0", "t1", by=["symbol"], unit=unit)
    move = lambda c: (F.col(c) / F.col("_p0") - 1) * F.col("side")
    up = down = move("close")
    if use_range:
        later = F.col("ts") > F.col("t0")
        best = F.when(F.col("side") > 0, move("high")).otherwise(move("low"))
        worst = F.when(F.col("side") > 0, move("low")).otherwise(move("high"))
        up, down = F.when(later, best), F.when(later, worst)
    hit_pt = F.when(up > pt * F.col("trgt"), F.col("ts")) if pt > 0 else F.lit(None).cast("timestamp")
    hit_sl = F.when(down < -sl * F.col("trgt"), F.col("ts")) if sl > 0 else F.lit(None).cast("timestamp")
    first = path.groupBy("symbol", "t0").agg(F.min(hit_pt).alias("t_pt"), F.min(hit_sl).alias("t_sl"))
    return events.join(first, ["symbol", "t0"], "left")


def get_events(bars: DataFrame, events: DataFrame, pt: float, sl: float, min_ret: float = 0.0, use_range: bool = False, unit: str = "day") -> DataFrame:
    """(symbol, t0, t1, trgt, side, touch, kind): the first barrier met; the stop wins a tie.

    ``events``: symbol, t0, trgt, t1 (the vertical barrier, perhaps null: the last bar), side (null: both ways alike).
    """
    last = bars.groupBy("symbol").agg(F.max("ts").alias("_last"))
    e = events.where(F.col("trgt") > min_ret).join(last, "symbol").withColumns({"_vertical": F.col("t1"), "t1": F.coalesce("t1", "_last"), "_meta": F.col("side").isNotNull(), "side": F.coalesce(F.col("side").cast("double"), F.lit(1.0))})
    t = touches(bars, e, pt, sl, use_range, unit)
    touch = F.least("t_pt", "t_sl", "_vertical")
    kind = F.when(F.col("t_sl") == touch, "sl").when(F.col("t_pt") == touch, "pt").when(touch.isNotNull(), "t1")
    return t.select("symbol", "t0", "t1", "trgt", "side", "_meta", touch.alias("touch"), kind.alias("kind")).where("touch is not null")


def get_bins(events: DataFrame, bars: DataFrame) -> DataFrame:
    """(symbol, t0, touch, kind, ret, label): the return up to the touch; labels are signs, or 0/1 where a side was given."""
    p = bars.select("symbol", "ts", "close")
    d = events.join(p.toDF("symbol", "t0", "_p0"), ["symbol", "t0"]).join(p.toDF("symbol", "touch", "_p1"), ["symbol", "touch"])
    ret = (F.col("_p1") / F.col("_p0") - 1) * F.when(F.col("_meta"), F.col("side")).otherwise(1.0)
    d = d.withColumn("ret", ret)
    label = F.when(F.col("_meta"), (F.col("ret") > 0).cast("int")).otherwise(F.signum("ret").cast("int"))
    return d.select("symbol", "t0", "touch", "kind", "ret", label.alias("label"))


def get_bins_at_barrier(events: DataFrame, bars: DataFrame, pt: float, sl: float) -> DataFrame:
    """As ``get_bins``, for barriers met inside bars: a profit is filled at its barrier, a stop there or at a worse close."""
    d = get_bins(events, bars).join(events.select("symbol", "t0", "trgt", "_meta"), ["symbol", "t0"])
    ret = F.when(F.col("kind") == "pt", pt * F.col("trgt")).when(F.col("kind") == "sl", F.least(-sl * F.col("trgt"), F.col("ret"))).otherwise(F.col("ret"))
    d = d.withColumn("ret", ret)
    return d.withColumn("label", F.when(F.col("_meta"), (F.col("ret") > 0).cast("int")).otherwise(F.signum("ret").cast("int"))).drop("trgt", "_meta")


def bet_size(prob: Column, num_classes: int = 2, eps: float = 1e-9) -> Column:
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), prob))
    return 2 * normal_cdf((p - 1 / num_classes) / F.sqrt(p * (1 - p))) - 1


def meta_position(side: Column, prob: Column, num_classes: int = 2) -> Column:
    return side * F.greatest(F.lit(0.0), F.least(F.lit(1.0), bet_size(prob, num_classes)))


def concurrency(bars: DataFrame, events: DataFrame) -> DataFrame:
    """(symbol, ts, n): labels active at each bar, from the earliest start on.

    Starts count +1 and ends -1 in one running sum: no interval join, whatever the overlap.
    """
    start = events.select("symbol", F.col("t0").alias("ts"), F.lit(1).alias("d"), F.lit(0).alias("k"))
    end = events.select("symbol", F.col("t1").alias("ts"), F.lit(-1).alias("d"), F.lit(2).alias("k"))
    first = events.groupBy("symbol").agg(F.min("t0").alias("_first"))
    bar = bars.select("symbol", "ts", F.lit(0).alias("d"), F.lit(1).alias("k"))
    w = so_far(Window.partitionBy("symbol").orderBy("ts", "k"))
    swept = bar.union(start).union(end).withColumn("n", F.sum("d").over(w)).where("k = 1")
    return swept.join(first, "symbol").where(F.col("ts") >= F.col("_first")).select("symbol", "ts", "n")


def _per_label(bars: DataFrame, events: DataFrame, value: Column) -> DataFrame:
    """(symbol, t0, t1, s, n): sum of ``value`` over the bars of each label, by differences of running sums."""
    w = so_far(Window.partitionBy("symbol").orderBy("ts", "_k"))
    c = bars.select("symbol", "ts", value.alias("_v"), F.lit(1).alias("_k"))
    ids = events.select("symbol", "t0", "t1").distinct()
    ends = ids.select("symbol", F.explode(F.array(F.struct(F.col("t0").alias("ts"), F.lit(0).alias("_k")), F.struct(F.col("t1").alias("ts"), F.lit(2).alias("_k")))).alias("e")).select("symbol", "e.ts", "e._k").distinct()
    both = c.unionByName(ends, allowMissingColumns=True)
    sums = both.select("symbol", "ts", "_k", F.coalesce(F.sum("_v").over(w), F.lit(0.0)).alias("_s"), F.count("_v").over(w).alias("_n")).where("_k <> 1")
    at = lambda k, t: sums.where(F.col("_k") == k).select("symbol", F.col("ts").alias(t), F.col("_s").alias(f"_s{k}"), F.col("_n").alias(f"_n{k}"))
    d = ids.join(at(0, "t0"), ["symbol", "t0"]).join(at(2, "t1"), ["symbol", "t1"])
    return d.select("symbol", "t0", "t1", (F.col("_s2") - F.col("_s0")).alias("s"), (F.col("_n2") - F.col("_n0")).alias("n"))


def average_uniqueness(bars: DataFrame, events: DataFrame) -> DataFrame:
    """(symbol, t0, t1, uniqueness): mean of 1/concurrency over the bars of each label."""
    c = concurrency(bars, events)
    return _per_label(c, events, F.try_divide(F.lit(1.0), "n")).select("symbol", "t0", "t1", F.try_divide("s", "n").alias("uniqueness"))


def weights_by_return(bars: DataFrame, events: DataFrame, normalize: bool = True) -> DataFrame:
    """(symbol, t0, t1, weight): size of the log returns inside each label, shared among the labels of a bar."""
    w = Window.partitionBy("symbol").orderBy("ts")
    r = bars.withColumn("_lr", F.log(F.col("close")) - F.log(F.lag("close").over(w)))
    c = concurrency(bars, events).join(r.select("symbol", "ts", "_lr"), ["symbol", "ts"])
    d = _per_label(c, events, F.try_divide("_lr", "n")).withColumn("weight", F.abs("s"))
    if normalize:
        all_ = Window.partitionBy("symbol")
        d = d.withColumn("weight", F.try_divide(F.col("weight") * F.count(F.lit(1)).over(all_), F.sum("weight").over(all_)))
    return d.select("symbol", "t0", "t1", "weight")


def time_decay(uniqueness: DataFrame, last_weight: float = 1.0) -> DataFrame:
    """Adds ``decay``: linear in cumulative uniqueness, 1 for the newest; a negative ``last_weight`` blots the oldest out; without any uniqueness all are 1."""
    w = Window.partitionBy("symbol").orderBy("t0", "t1")
    cum, total = F.sum("uniqueness").over(so_far(w)), F.sum("uniqueness").over(Window.partitionBy("symbol"))
    if last_weight >= 0:
        slope = F.try_divide(F.lit(1.0 - last_weight), total)
    else:
        slope = F.try_divide(F.lit(1.0), (last_weight + 1) * total)
    return uniqueness.withColumn("decay", F.when(total == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - slope * total + slope * cum)))


def indicator(bars: DataFrame, events: DataFrame, unit: str = "day") -> DataFrame:
    """(symbol, ts, t0, t1): the ones of the bar by label matrix, sparse."""
    return interval_join(bars.select("symbol", "ts"), events.select("symbol", "t0", "t1"), "ts", "t0", "t1", by=["symbol"], unit=unit)


def uniqueness_from_indicator(ones: DataFrame) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol", "ts"))
    return ones.withColumn("_n", n).groupBy("symbol", "t0", "t1").agg(F.avg(1 / F.col("_n")).alias("uniqueness"))


def sequential_bootstrap(spans: list[tuple[int, int]], size: int | None = None, seed: int | None = None) -> list[int]:
    """Draws labels one after another, the likelier the more unique given the draws so far.

    Sequential by nature and on the driver: ``spans`` are (first, last) bar
    positions of a bounded sample of labels.
    """
    import numpy as np

    rng = np.random.default_rng(seed)
    n_bars = 1 + max(e for _, e in spans)
    drawn, out = np.zeros(n_bars), []
    for _ in range(size or len(spans)):
        cum = np.concatenate(([0.0], np.cumsum(1 / (1 + drawn))))
        mean = np.array([(cum[e + 1] - cum[s]) / (e + 1 - s) for s, e in spans])
        k = int(rng.choice(len(spans), p=mean / mean.sum()))
        s, e = spans[k]
        drawn[s : e + 1] += 1
        out.append(k)
    return out
