"""Disclosures: point-in-time facts and what they announce. Column names of the facts are the vendor's."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import keep_last, ratio
from .joins import asof_backward

DISCLOSED = ("Code", "DiscDate", "DiscNo")


def union_mirrors(*mirrors: DataFrame) -> DataFrame:
    """Several mirrors of the disclosures; the last copy of (Code, DiscDate, DiscNo) stays."""
    out = mirrors[0].withColumn("_src", F.lit(0))
    for i, m in enumerate(mirrors[1:], 1):
        out = out.unionByName(m.withColumn("_src", F.lit(i)), allowMissingColumns=True)
    return keep_last(out, DISCLOSED, ["_src"]).drop("_src")


def point_in_time(fund: DataFrame, dates: DataFrame, fields: Sequence[str], lag_days: int = 1, codes: DataFrame | None = None, bucket: str | None = None) -> DataFrame:
    """(date, code, fields): what was disclosed ``lag_days`` or more before each rebalance date.

    The grid has every code of ``fund`` (or of ``codes``) at every date.
    """
    names = (codes if codes is not None else fund).select("Code").distinct()
    days = dates.select("date").distinct().agg(F.collect_set("date").alias("_d"))  # rebalance dates: hundreds
    grid = names.join(F.broadcast(days)).select("Code", F.explode("_d").alias("date")).withColumn("_cut", F.date_sub("date", lag_days))
    facts = fund.withColumns({f: F.expr(f"try_cast(`{f}` as double)") for f in fields})
    seq = ["DiscNo"] if "DiscNo" in fund.columns else []
    out = asof_backward(grid, facts, "_cut", "DiscDate", fields, by=["Code"], seq=seq, bucket=bucket)
    return out.select("date", F.col("Code").alias("code"), *fields)


def _ordered(fund: DataFrame, field: str) -> DataFrame:
    d = fund.where(F.col(field).isNotNull())
    return keep_last(d, ["Code", "DiscDate"], ["DiscNo"]) if "DiscNo" in fund.columns else d.dropDuplicates(["Code", "DiscDate"])


def by_disclosure():
    return Window.partitionBy("Code").orderBy("DiscDate")



def forecast_revision(fund: DataFrame, field: str = "FEPS") -> DataFrame:
    """(Code, DiscDate, revision): change against the forecast before, relative to its size."""
    d = _ordered(fund, field)
    prev = F.lag(field).over(by_disclosure())
    return d.select("Code", "DiscDate", ratio(F.col(field) - prev, F.abs(prev)).alias("revision")).where("revision is not null")


def earnings_surprise(fund: DataFrame, actual: str = "EPS", forecast: str = "FEPS") -> DataFrame:
    """Every disclosure row with both numbers; repeated disclosures all stay."""
    return fund.select("Code", "DiscDate", ratio(F.col(actual) - F.col(forecast), F.abs(F.col(forecast))).alias("surprise")).where("surprise is not null")


def dividend_forecast_revision(fund: DataFrame, cumulative: DataFrame | None = None, field: str = "FDivAnn") -> DataFrame:
    """As ``forecast_revision``, the previous forecast rescaled by the split factors between the two dates.

    ``cumulative``: (Code, date, cum), the cumulative factor, 1 before its first date: a split in two
    takes it from 1 to 0.5, and half the dividend is then no revision.
    """
    d = _ordered(fund, field)
    if cumulative is None:
        d = d.withColumn("_cum", F.lit(1.0))
    else:
        d = asof_backward(d, cumulative.withColumnRenamed("cum", "_cum"), "DiscDate", "date", ["_cum"], by=["Code"]).withColumn("_cum", F.coalesce("_cum", F.lit(1.0)))
    step = F.lag("_cum").over(by_disclosure())
    scale = F.when(step != 0, F.col("_cum") / step).otherwise(1.0)
    prev = F.lag(field).over(by_disclosure()) * scale
    return d.select("Code", "DiscDate", ratio(F.col(field) - prev, F.abs(prev)).alias("revision")).where("revision is not null")


def buyback_intensity(fund: DataFrame) -> DataFrame:
    """Change of the share of treasury stock."""
    d = _ordered(fund.withColumn("_share", ratio("TrShFY", "ShOutFY")), "_share")
    return d.select("Code", "DiscDate", (F.col("_share") - F.lag("_share").over(by_disclosure())).alias("buyback")).where("buyback is not null")


def guidance_conservatism(fund: DataFrame, n_years: int = 3, min_years: int = 2) -> DataFrame:
    """Mean surprise of full years against the guidance of the disclosure before, over the last ``n_years`` full-year disclosures.

    Guidance counts if it was for this year (where both year ends are columns). A
    disclosure without a surprise still takes one of the ``n_years`` places.
    """
    fy = fund.where((F.col("CurPerType") == "FY") & F.col("DiscDate").isNotNull())
    fy = keep_last(fy, ["Code", "DiscDate"], ["DiscNo"] if "DiscNo" in fund.columns else ["CurFYEn"] if "CurFYEn" in fund.columns else ["EPS"])
    w = Window.partitionBy("Code").orderBy("DiscDate")
    prior = F.lag("NxFEPS").over(w)
    if {"NxtFYEn", "CurFYEn"} <= set(fund.columns):
        prior = F.when(F.lag("NxtFYEn").over(w) == F.col("CurFYEn"), prior)
    d = fy.select("Code", "DiscDate", ratio(F.col("EPS") - prior, F.abs(prior)).alias("_s"))
    last = w.rowsBetween(-(n_years - 1), Window.currentRow)
    return d.select("Code", "DiscDate", F.when(F.count("_s").over(last) >= min_years, F.avg("_s").over(last)).alias("conservatism")).where("conservatism is not null")


def announcement_delay(fund: DataFrame, lo_days: int = 300, hi_days: int = 430, doc_contains: str = "FinancialStatements") -> DataFrame:
    """Days later than a year after the same quarter's last disclosure; gaps outside [lo, hi] are dropped."""
    d = fund.where(F.col("DocType").contains(doc_contains)) if "DocType" in fund.columns else fund
    d = d.select("Code", "CurPerType", "DiscDate").distinct()
    gap = F.datediff("DiscDate", F.lag("DiscDate").over(Window.partitionBy("Code", "CurPerType").orderBy("DiscDate")))
    return d.withColumn("_gap", gap).where(F.col("_gap").between(lo_days, hi_days)).select("Code", "DiscDate", (F.col("_gap") - 365).cast("long").alias("delay"))


def expected_announcement_month(fund: DataFrame, dates: DataFrame, top: int = 4) -> DataFrame:
    """(date, code, expected): next month is one of the code's ``top`` usual months; false before its first disclosure."""
    months = fund.select("Code", "DiscDate").distinct()
    counts = months.groupBy("Code", F.month("DiscDate").alias("_m")).agg(F.count(F.lit(1)).alias("_n"))
    usual = counts.withColumn("_rn", F.row_number().over(Window.partitionBy("Code").orderBy(F.desc("_n"), "_m"))).where(F.col("_rn") <= top)
    first = months.groupBy("Code").agg(F.min("DiscDate").alias("_first"))
    codes = usual.groupBy("Code").agg(F.collect_set("_m").alias("_months")).join(first, "Code")
    days = dates.select("date").distinct().agg(F.collect_set("date").alias("_d"))
    grid = codes.join(F.broadcast(days)).withColumn("date", F.explode("_d"))
    hit = F.array_contains("_months", F.month(F.add_months("date", 1))) & (F.col("_first") <= F.col("date"))
    return grid.select("date", F.col("Code").alias("code"), hit.alias("expected"))


def days_to_next_announcement(fund: DataFrame, dates: DataFrame, default_interval: float = 91.0) -> DataFrame:
    """(date, code, days): last disclosure plus the code's median interval (60 to 130, else the default), less the date."""
    d = fund.select("Code", "DiscDate").distinct()
    gap = F.datediff("DiscDate", F.lag("DiscDate").over(by_disclosure()))
    usual = d.withColumn("_gap", gap).groupBy("Code").agg(F.percentile("_gap", 0.5).alias("_gap"))
    usual = usual.select("Code", F.coalesce(F.greatest(F.lit(60.0), F.least(F.lit(130.0), F.col("_gap"))), F.lit(default_interval)).alias("_gap"))
    days = dates.select("date").distinct().agg(F.collect_set("date").alias("_d"))
    grid = usual.join(F.broadcast(days)).select("Code", "_gap", F.explode("_d").alias("date"))
    last = asof_backward(grid, d.withColumn("_last", F.col("DiscDate")), "date", "DiscDate", ["_last"], by=["Code"])
    return last.select("date", F.col("Code").alias("code"), (F.datediff("_last", "date") + F.col("_gap")).alias("days"))
