"""Margin, short interest, investor flows, and the frictions of trading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import keep_last, ratio
from .joins import asof_backward


def margin_imbalance(weekly: DataFrame) -> DataFrame:
    both = F.col("LongVol") + F.col("ShrtVol")
    return weekly.select("Date", "Code", ratio(F.col("LongVol") - F.col("ShrtVol"), both).alias("margin_imbalance"), ratio("ShrtVol", "LongVol").alias("short_to_long"))


def short_interest(positions: DataFrame) -> DataFrame:
    """Sum over reporters."""
    return positions.groupBy("CalcDate", "Code").agg(F.sum("ShrtPosToSO").alias("short_interest"))


def sector_short_ratio(table: DataFrame) -> DataFrame:
    short = F.coalesce("ShrtWithResVa", F.lit(0.0)) + F.coalesce("ShrtNoResVa", F.lit(0.0))
    return table.select("Date", "S33", ratio(short, F.coalesce("SellExShortVa", F.lit(0.0)) + short).alias("sector_short_ratio"))


def section_net_flow(flows: DataFrame, investor: str = "Frgn", section: str = "TokyoNagoya") -> DataFrame:
    d = keep_last(flows.where(F.col("Section") == section), ["EnDate"], ["PubDate"])
    return d.select(F.col("EnDate").alias("date"), F.col(f"{investor}Bal").alias("net_flow"))


def net_flow_intensity(flows: DataFrame, investor: str = "Frgn", section: str = "TokyoNagoya") -> DataFrame:
    d = keep_last(flows.where(F.col("Section") == section), ["EnDate"], ["PubDate"])
    return d.select(F.col("EnDate").alias("date"), ratio(f"{investor}Bal", f"{investor}Tot").alias("intensity"))


def limit_lock_flags(px: DataFrame) -> DataFrame:
    """(date, code, no_buy, no_sell): closed at the limit it is locked at; no volume blocks both; nulls never block.

    ``px``: date, code, close, high, low, ul, ll and perhaps volume.
    """
    on = lambda c: F.coalesce(c, F.lit(False))
    still = on(F.col("volume") == 0) if "volume" in px.columns else F.lit(False)
    buy = on((F.col("ul") == 1) & (F.col("close") >= F.col("high"))) | still
    sell = on((F.col("ll") == 1) & (F.col("close") <= F.col("low"))) | still
    return px.select("date", "code", buy.alias("no_buy"), sell.alias("no_sell"))


def tradability_mask(px: DataFrame) -> DataFrame:
    if not {"ul", "ll", "high", "low"} <= set(px.columns):
        return px.select("date", "code", F.lit(True).alias("tradable"))
    return limit_lock_flags(px).select("date", "code", (~(F.col("no_buy") | F.col("no_sell"))).alias("tradable"))


def shortable_mask(margin: DataFrame, grid: DataFrame, lag_days: int = 4, tolerance_days: int = 60) -> DataFrame:
    """(date, code, shortable): the last loanable flag ``lag_days`` before, while it is no older than the tolerance.

    Without an issue type, a positive standard short volume makes a stock loanable.
    """
    loan = F.col("ShrtStdVol") > 0
    if "IssType" in margin.columns:
        loan = F.when(F.col("IssType").isNull(), loan).otherwise(F.col("IssType").cast("string") == "2")
    obs = margin.select(F.col("Code").alias("code"), F.col("Date").alias("_obs"), F.coalesce(loan, F.lit(False)).alias("shortable"))
    cut = grid.select("date", "code").withColumn("_cut", F.date_sub("date", lag_days))
    out = asof_backward(cut, obs, "_cut", "_obs", ["shortable"], by=["code"], tolerance_days=tolerance_days)
    return out.select("date", "code", F.coalesce("shortable", F.lit(False)).alias("shortable"))


def vol_scaled_cost_bps(vol: Column, base_bps: float = 10.0, k: float = 0.05) -> Column:
    return F.greatest(F.lit(base_bps), F.lit(base_bps) + F.coalesce(vol * (k * 1e4), F.lit(0.0)))


def short_notional_coverage(weights: DataFrame, shortable: DataFrame) -> DataFrame:
    """(date, coverage): shortable part of each date's short weight; 1 without shorts."""
    d = weights.join(shortable.select("date", "code", "shortable"), ["date", "code"], "left")
    short = F.when(F.col("weight") < 0, -F.col("weight")).otherwise(0.0)
    g = d.groupBy("date").agg(F.sum(short).alias("_s"), F.sum(F.when(F.coalesce("shortable", F.lit(False)), short).otherwise(0.0)).alias("_c"))
    return g.select("date", F.when(F.col("_s") > 0, F.col("_c") / F.col("_s")).otherwise(1.0).alias("coverage"))


def asof_series(series: DataFrame, dates: DataFrame, lag_days: int = 1, value: str = "value", ffill: bool = True) -> DataFrame:
    """(date, value): an external daily series as known ``lag_days`` before each date; with ``ffill``, its last value that isn't null."""
    s = series.where(F.col(value).isNotNull()) if ffill else series
    cut = dates.select("date").distinct().withColumn("_cut", F.date_sub("date", lag_days))
    return asof_backward(cut, s.withColumnRenamed("date", "_d"), "_cut", "_d", [value]).select("date", value)


def carry_limited(df: DataFrame, value: str, keys: list[str], limit: int) -> DataFrame:
    """LOCF over at most ``limit`` rows."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(-limit, Window.currentRow)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))
