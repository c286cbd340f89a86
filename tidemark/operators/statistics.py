"""Track records and multiple testing: Sharpe ratios, deflation, overfitting, regimes, splits."""

from __future__ import annotations

import math
from itertools import combinations
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import col, expanding_rank, guarded, normal_cdf, normal_cdf_value, normal_ppf, so_far, tertile, trailing, unbiased_kurtosis, unbiased_skew

EULER = 0.5772156649015329


def sharpe(x: str | Column, ann: float = 1.0) -> Column:
    return F.when(F.stddev_samp(col(x)) > 0, F.avg(col(x)) / F.stddev_samp(col(x))) * math.sqrt(ann)


def track_moments(returns: DataFrame, by: list[str], value: str = "ret") -> DataFrame:
    """(by, n_obs, sr, skew, kurt): bias-corrected moments, kurtosis 3 for a normal distribution."""
    return returns.groupBy(*by).agg(F.count(value).alias("n_obs"), sharpe(value).alias("sr"), unbiased_skew(value).alias("skew"), unbiased_kurtosis(value).alias("kurt"))


def psr(sr: Column, benchmark: Column, n: Column, skew: Column, kurt: Column) -> Column:
    spread = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
    return F.when(spread > 0, normal_cdf((sr - benchmark) * F.sqrt(n - 1) / F.sqrt(spread)))


def psr_value(sr: float, benchmark: float, n: int, skew: float, kurt: float) -> float:
    spread = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
    return normal_cdf_value((sr - benchmark) * math.sqrt(n - 1) / math.sqrt(spread)) if spread > 0 else math.nan


def expected_max_sharpe(n_trials: int, variance: float) -> float:
    if n_trials < 2 or variance <= 0:
        return 0.0
    return math.sqrt(variance) * ((1 - EULER) * normal_ppf(1 - 1 / n_trials) + EULER * normal_ppf(1 - 1 / (n_trials * math.e)))


def deflated_sharpe(sr: float, variance: float, n_trials: int, n: int, skew: float, kurt: float) -> float:
    return psr_value(sr, expected_max_sharpe(n_trials, variance), n, skew, kurt)


def deflated_sharpe_table(returns: DataFrame, by: str, value: str = "ret") -> DataFrame:
    """(by, sr, psr, dsr): every track record against the best of as many trials as there are records."""
    m = track_moments(returns, [by], value).where("sr is not null")
    trials = m.agg(F.count(F.lit(1)).alias("_k"), F.coalesce(F.var_samp("sr"), F.lit(0.0)).alias("_v"))
    z = lambda p: _ppf(p)
    best = F.when(F.col("_k") >= 2, F.sqrt("_v") * ((1 - EULER) * z(1 - 1 / F.col("_k")) + EULER * z(1 - 1 / (F.col("_k") * math.e)))).otherwise(0.0)
    d = m.join(F.broadcast(trials)).withColumn("_best", best)  # one row
    args = (F.col("n_obs"), F.col("skew"), F.col("kurt"))
    return d.select(by, "n_obs", "sr", psr(F.col("sr"), F.lit(0.0), *args).alias("psr"), psr(F.col("sr"), F.col("_best"), *args).alias("dsr"))


def _ppf(p: Column) -> Column:
    """Inverse normal distribution of a column, by bisection on the distribution function; 60 halvings of (-9, 9)."""

    @F.pandas_udf("double")
    def inverse(x):
        nd = NormalDist()
        return x.map(lambda v: nd.inv_cdf(v) if 0 < v < 1 else None)

    return inverse(p)


def min_track_record_length(sr: float, benchmark: float, skew: float, kurt: float, prob: float = 0.95) -> float:
    if sr <= benchmark:
        return math.inf
    return 1 + (1 - skew * sr + (kurt - 1) / 4 * sr * sr) * (normal_ppf(prob) / (sr - benchmark)) ** 2


def min_backtest_length(n_trials: int, target_sr_ann: float = 1.0) -> float:
    return (expected_max_sharpe(n_trials, 1.0) / target_sr_ann) ** 2


def max_drawdown(returns: DataFrame, by: list[str], value: str = "ret", from_one: bool = False) -> DataFrame:
    """(by, maxdd). The peak starts at the first value, or at 1 with ``from_one``."""
    w = Window.partitionBy(*by).orderBy("date")
    d = returns.withColumn("_c", F.product(1 + F.coalesce(F.col(value), F.lit(0.0))).over(so_far(w)))
    peak = F.max("_c").over(so_far(w))
    if from_one:
        peak = F.greatest(F.lit(1.0), peak)
    return d.withColumn("_dd", F.col("_c") / peak - 1).groupBy(*by).agg(F.min("_dd").alias("maxdd"))


def time_decayed_sharpe(returns: DataFrame, by: list[str], halflife: float = 36.0, ann: float = 12.0, value: str = "ret") -> DataFrame:
    age = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("date"))) - 1
    d = returns.where(F.col(value).isNotNull()).withColumn("_w", F.pow(F.lit(0.5), age / halflife))
    x, w = F.col(value), F.col("_w")
    g = d.groupBy(*by).agg(F.sum(w).alias("_s"), F.sum(w * x).alias("_1"), F.sum(w * x * x).alias("_2"))
    mean = F.col("_1") / F.col("_s")
    var = F.col("_2") / F.col("_s") - mean * mean
    return g.select(*by, F.when(var > 1e-18, mean / F.sqrt(var) * math.sqrt(ann)).alias("decayed_sharpe"))


def subperiod_sharpes(returns: DataFrame, by: list[str], k: int = 3, ann: float = 12.0, value: str = "ret") -> DataFrame:
    """(by, part, sharpe): k consecutive parts, the first ones longer by one row where they can't be equal."""
    d = returns.where(F.col(value).isNotNull()).withColumn("part", F.ntile(k).over(Window.partitionBy(*by).orderBy("date")))
    return d.groupBy(*by, "part").agg(sharpe(value, ann).alias("sharpe"))


def pre_post_sharpe(returns: DataFrame, by: list[str], split: str, ann: float = 12.0, value: str = "ret") -> DataFrame:
    before = F.col("date") < F.lit(split).cast("timestamp")
    return returns.groupBy(*by).agg(sharpe(F.when(before, F.col(value)), ann).alias("pre"), sharpe(F.when(~before, F.col(value)), ann).alias("post"))


def weighted_track(returns: DataFrame, hold: str) -> DataFrame:
    """(strategy, hit): share of gains while invested."""
    return returns.where(F.col(hold) > 0).groupBy("strategy").agg(F.avg((F.col("ret") > 0).cast("double")).alias("hit"))


def robustness_score(worst_sub: Column, positive_share: Column, max_dd: Column, turnover: Column) -> Column:
    """0 to 1, for display: the worst subperiod's Sharpe ratio (-1 to 1), the share of positive ones, drawdown (0 to 30 %), turnover (0 to 2)."""
    bound = lambda c: F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), F.lit(0.0))
    # The weights of the four parts, and their ranges
    return 0.4 * bound((worst_sub + 1) / 2) + 0.2 * positive_share + 0.2 * bound(1 - F.abs(max_dd) / 0.3) + 0.2 * bound(1 - turnover / 2)


def pbo_cscv(returns: DataFrame, n_splits: int = 8) -> DataFrame:
    """(combo, best, omega, logit): for each half of the blocks, how its best strategy ranks in the other half.

    ``returns``: strategy, date, ret. Each (strategy, block) is reduced to n,
    sum and sum of squares first; the halves are combined from those. Only dates that
    all strategies have count; under two strategies or ``2 * n_splits`` dates there
    are no rows.
    """
    if n_splits % 2 or n_splits < 2:
        raise ValueError("the number of blocks must be even")
    spark = returns.sparkSession
    full = returns.where("ret is not null")
    k = full.select("strategy").distinct().agg(F.count(F.lit(1)).alias("_k"))
    common = full.groupBy("date").agg(F.countDistinct("strategy").alias("_has")).join(F.broadcast(k)).where("_has = _k and _k >= 2").select("date")  # k: one row
    enough = common.agg((F.count(F.lit(1)) >= 2 * n_splits).alias("_ok"))
    dates = common.join(F.broadcast(enough)).where("_ok").select("date").withColumn("block", F.ntile(n_splits).over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1)
    stats = full.join(dates, "date").groupBy("strategy", "block").agg(F.count("ret").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q"))
    sides = [(c, b, b in half) for c, half in enumerate(combinations(range(n_splits), n_splits // 2)) for b in range(n_splits)]
    combos = spark.createDataFrame(sides, "combo int, block int, ins boolean")  # n_splits * C(n_splits, half) rows
    g = stats.join(F.broadcast(combos), "block").groupBy("combo", "strategy", "ins").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    var = (F.col("q") - F.col("n") * mean * mean) / (F.col("n") - 1)
    g = g.withColumn("sr", F.when(F.col("n") > 1, F.when(var > 1e-18, mean / F.sqrt(var)).otherwise(F.lit(-math.inf))))
    w = g.groupBy("combo", "strategy").agg(F.max(F.when(F.col("ins"), F.col("sr"))).alias("is_sr"), F.max(F.when(~F.col("ins"), F.col("sr"))).alias("oos_sr"))
    by = Window.partitionBy("combo")
    rank = F.rank().over(by.orderBy("oos_sr"))  # 1 and those strictly below
    w = w.withColumns({"_r": rank, "_n": F.count(F.lit(1)).over(by), "_best": F.row_number().over(by.orderBy(F.desc("is_sr"), "strategy"))})
    best = w.where("_best = 1").withColumn("omega", F.col("_r") / (F.col("_n") + 1))
    return best.select("combo", F.col("strategy").alias("best"), "omega", F.log(F.col("omega") / (1 - F.col("omega"))).alias("logit"))


def pbo(returns: DataFrame, n_splits: int = 8) -> DataFrame:
    """(pbo, n_combos): share of halves whose best strategy isn't above the middle of the other half; NULL where there are too few strategies or dates."""
    return pbo_cscv(returns, n_splits).agg(F.avg((F.col("omega") <= 0.5).cast("double")).alias("pbo"), F.count(F.lit(1)).alias("n_combos"))


def purged_train(labels: DataFrame, spans: DataFrame) -> DataFrame:
    """Labels (t0, t1) that overlap no test span (start, end); both closed."""
    from .joins import overlap_anti

    return overlap_anti(labels, spans, "t0", "t1", "start", "end")


def embargo_positions(test: DataFrame, size: int, n: int) -> DataFrame:
    """(pos): the ``size`` positions behind each run of consecutive test positions, below ``n``, none of them tested."""
    w = Window.partitionBy(F.lit(0)).orderBy("pos")
    runs = test.select("pos").distinct().withColumn("_g", F.col("pos") - F.row_number().over(w)).groupBy("_g").agg(F.max("pos").alias("_e"))
    out = runs.select(F.explode(F.sequence(F.col("_e") + 1, F.col("_e") + size)).alias("pos")).where(F.col("pos") < n).distinct() if size > 0 else test.select("pos").limit(0)
    return out.join(test.select("pos"), "pos", "left_anti")


def cpcv_splits(labels: DataFrame, n_splits: int = 6, n_test: int = 2, embargo_pct: float = 0.0) -> DataFrame:
    """(split_id, pos, role): every combination of test groups; training labels are purged and embargoed.

    ``labels``: pos (0..n-1 in order of t0), t0, t1. Test groups that touch form
    one span from its first start to its last end.
    """
    if not 1 <= n_test < n_splits:
        raise ValueError("test groups must be fewer than groups")
    spark = labels.sparkSession
    # groups from positions alone: the first n % n_splits groups have one label more
    n = labels.agg(F.count(F.lit(1)).alias("_n"))
    size, more = F.floor(F.col("_n") / n_splits), F.col("_n") % n_splits
    wide = more * (size + 1)
    grp = F.when(F.col("pos") < wide, F.floor(F.col("pos") / (size + 1))).otherwise(more + F.floor((F.col("pos") - wide) / F.greatest(size, F.lit(1))))
    grouped = labels.join(F.broadcast(n)).withColumn("grp", grp.cast("int")).drop("_n")  # n: one row
    rows = []
    for s, combo in enumerate(combinations(range(n_splits), n_test)):
        block = -1
        for i, g in enumerate(combo):
            block += i == 0 or g != combo[i - 1] + 1
            rows.append((s, g, block))
    combos = spark.createDataFrame(rows, "split_id int, grp int, block int")
    test = grouped.join(F.broadcast(combos), "grp")
    spans = test.groupBy("split_id", "block").agg(F.min("t0").alias("start"), F.max("t1").alias("end"), F.max("pos").alias("_last"))
    total = labels.agg(F.count(F.lit(1)).alias("_n"))
    spans = spans.join(total).withColumn("_emb", F.col("_last") + F.ceil(F.col("_n") * embargo_pct)).drop("_n")
    every = grouped.join(F.broadcast(combos.select("split_id").distinct()))
    train = every.join(combos.select("split_id", "grp"), ["split_id", "grp"], "left_anti")
    x, s = train.alias("x"), F.broadcast(spans).alias("s")  # at most splits x test groups rows
    hit = (F.col("x.split_id") == F.col("s.split_id")) & (((F.col("x.t0") <= F.col("s.end")) & (F.col("x.t1") >= F.col("s.start"))) | ((F.col("x.pos") > F.col("s._last")) & (F.col("x.pos") <= F.col("s._emb"))))
    train = x.join(s, hit, "left_anti")
    return test.select("split_id", "pos", F.lit("test").alias("role")).unionByName(train.select("split_id", "pos", F.lit("train").alias("role")))


def cpcv_paths(n_splits: int, n_test: int) -> tuple[int, int]:
    return math.comb(n_splits, n_test), math.comb(n_splits - 1, n_test - 1)


def expanding_tertile(series: DataFrame, value: str = "value", min_periods: int = 252, out: str = "regime") -> DataFrame:
    """(date, regime): tertile of the rank among all values so far; NULL under ``min_periods`` values."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    p = F.when(F.count(value).over(so_far(w)) >= min_periods, expanding_rank(value, w))
    return series.withColumn("_p", p).select("date", tertile(F.col("_p")).alias(out))


def trend_regime(level: DataFrame, window: int = 60, min_periods: int = 252) -> DataFrame:
    from .microstructure import efficiency_ratio

    return expanding_tertile(efficiency_ratio(level, window), "er", min_periods)


def vol_regime(level: DataFrame, window: int = 60, min_periods: int = 252) -> DataFrame:
    """(date, regime): tertile so far of the market's volatility over ``window`` returns, at least half of them (and five) known."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    v = level.select("date", guarded(F.stddev_samp("ret"), "ret", trailing(w, window), max(5, window // 2)).alias("vol"))
    return expanding_tertile(v, "vol", min_periods)


def regime_breakdown(returns: DataFrame, regime: DataFrame, ann: float = 252.0) -> DataFrame:
    """(regime, n, mean, sharpe): returns by the last regime known at their date."""
    from .joins import asof_backward

    labelled = asof_backward(returns, regime.where("regime is not null").withColumnRenamed("date", "_d"), "date", "_d", ["regime"])
    return labelled.where("regime is not null and ret is not null").groupBy("regime").agg(F.count("ret").alias("n"), F.avg("ret").alias("mean"), sharpe("ret", ann).alias("sharpe"))


def walk_forward_assignment(sleeves: DataFrame, regime: DataFrame, min_obs: int = 6, warmup: int = 24) -> DataFrame:
    """(date, sleeve): the sleeve with the best positive mean so far in the date's regime; NULL (flat) where none qualifies."""
    d = sleeves.join(regime, "date")
    before = Window.partitionBy("sleeve", "regime").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({"_m": F.avg("ret").over(before), "_n": F.count("ret").over(before)})
    pos = F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1
    dates = d.select("date").distinct().withColumn("_pos", pos)
    ok = (F.col("_n") >= min_obs) & (F.col("_m") > 0) & (F.col("_pos") >= warmup)
    g = d.join(dates, "date").groupBy("date").agg(F.max_by(F.when(ok, F.col("sleeve")), F.when(ok, F.struct("_m", "sleeve"))).alias("sleeve"))
    return g


