"""Vendor payloads to typed tables. Bad values are NULL; an empty payload is an empty table with its schema."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRADES = "ts timestamp, seq long, price double, volume double, side string"
CANDLES = "ts timestamp, open double, high double, low double, close double, volume double"

# Columns of the vendor's payloads that hold dates, and those that hold text.
DATE_COLUMNS = ("Date", "DiscDate", "CalcDate", "PubDate", "StDate", "EnDate", "CurPerSt", "CurPerEn", "CurFYSt", "CurFYEn", "NxtFYSt", "NxtFYEn", "AppDate", "DisclosedDate", "CurrentPeriodEndDate", "CurrentFiscalYearEndDate", "PrevRptDate", "LTD", "SQD")
# Columns of numbers, by payload; per investor type there are four.
NUMBER_COLUMNS = frozenset(
    "O H L C UL LL Vo Va AdjFactor AdjO AdjH AdjL AdjC AdjVo Open High Low Close Volume TurnoverValue UpperLimit LowerLimit AdjustmentFactor "
    "AdjustmentOpen AdjustmentHigh AdjustmentLow AdjustmentClose AdjustmentVolume "
    "Sales OP OdP NP EPS DEPS BPS Eq EqAR TA CFO CFI CFF CashEq FSales FOP FOdP FNP FEPS FDivAnn DivAnn ShOutFY TrShFY AvgSh "
    "NetSales OperatingProfit OrdinaryProfit Profit EarningsPerShare BookValuePerShare Equity EquityToAssetRatio TotalAssets "
    "ShrtVol LongVol ShrtNegVol LongNegVol ShrtStdVol LongStdVol ShrtOut ShrtOutChg ShrtOutRatio LongOut LongOutChg LongOutRatio SLRatio "
    "ShrtNegOut ShrtNegOutChg ShrtStdOut ShrtStdOutChg LongNegOut LongNegOutChg LongStdOut LongStdOutChg SellExShortVa ShrtWithResVa ShrtNoResVa "
    "ShrtPosToSO ShrtPosShares ShrtPosUnits PrevRptRatio EO EH EL EC AO AH AL AC OI VoOA Strike Settle Theo BaseVol UnderPx IV IR".split()
) | {f"{who}{what}" for who in "Prop Brk Tot Ind Frgn SecCo InvTr BusCo OthCo InsCo Bank TrstBnk OthFin".split() for what in ("Sell", "Buy", "Tot", "Bal")}
PRICE_PRIORITY = ("AdjC", "AdjustmentClose", "C", "Close")


def mixed_date(c: str | Column) -> Column:
    """ISO or compact dates, with or without a time behind."""
    t = F.trim((F.col(c) if isinstance(c, str) else c).cast("string"))
    return F.coalesce(F.to_date(F.try_to_timestamp(F.substring(t, 1, 10), F.lit("yyyy-MM-dd"))), F.to_date(F.try_to_timestamp(F.substring(t, 1, 8), F.lit("yyyyMMdd"))))


def number(c: str) -> Column:
    return F.expr(f"try_cast(trim(cast(`{c}` as string)) as double)")


def records(spark: SparkSession, rows: Iterable[Mapping], columns: Sequence[str] = ()) -> DataFrame:
    """Records with whatever keys as a table of typed columns; nested values become JSON text."""
    rows = [{k: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False) if isinstance(v, (dict, list)) else str(v) for k, v in r.items()} for r in rows]
    names = list(dict.fromkeys([*columns, *(k for r in rows for k in r)]))
    schema = ", ".join(f"`{n}` string" for n in names) or "`Code` string"
    return coerce(spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema))


def coerce(df: DataFrame) -> DataFrame:
    """Known dates and numbers are cast, what doesn't parse becomes NULL; all other columns stay as they are."""
    out = [mixed_date(c).alias(c) if c in DATE_COLUMNS else number(c).alias(c) if c in NUMBER_COLUMNS else F.col(f"`{c}`") for c in df.columns]
    return df.select(*out)


def price_column(columns: Sequence[str]) -> str:
    for c in PRICE_PRIORITY:
        if c in columns:
            return c
    raise KeyError(f"no price column among {list(columns)}")


def parse_trades(df: DataFrame) -> DataFrame:
    """Raw trades (timestamp in ms, price, amount, side) as ticks; ``seq`` keeps the order of arrival."""
    seq = F.col("seq") if "seq" in df.columns else F.monotonically_increasing_id()
    amount = number("amount") if "amount" in df.columns else number("volume")
    side = F.lower("side") if "side" in df.columns else F.lit(None).cast("string")
    return df.select(F.timestamp_millis(F.col("timestamp").cast("long")).alias("ts"), seq.cast("long").alias("seq"), number("price").alias("price"), amount.alias("volume"), side.alias("side"))


def parse_transactions(df: DataFrame) -> DataFrame:
    return parse_trades(df.withColumnsRenamed({"executed_at": "timestamp", "transaction_id": "seq"}))


def parse_candles(df: DataFrame, column: str = "ohlcv") -> DataFrame:
    """JSON arrays of [open, high, low, close, volume, ms]; of candles of one time the first stays."""
    rows = df.select(F.posexplode(F.from_json(column, "array<array<string>>")).alias("_n", "_r"))
    typed = rows.select("_n", F.timestamp_millis(F.col("_r")[5].cast("long")).alias("ts"), *(F.expr(f"try_cast(_r[{i}] as double)").alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"))))
    first = F.row_number().over(Window.partitionBy("ts").orderBy("_n"))
    return typed.withColumn("_k", first).where("_k = 1").drop("_k", "_n")


# Headers of one exporter's CSV files.
CSV_HEADERS = {"日付け": "date", "日付": "date", "終値": "close", "始値": "open", "高値": "high", "安値": "low", "出来高": "volume", "変化率 %": "change_pct", "Date": "date", "Price": "close", "Open": "open", "High": "high", "Low": "low", "Vol.": "volume", "Change %": "change_pct"}


def scaled_number(c: str) -> Column:
    """Numbers with thousands separators, a per-cent sign, or K, M, B behind (which multiply)."""
    t = F.upper(F.regexp_replace(F.trim(F.col(c).cast("string")), "[,%\\s]", ""))
    n = F.regexp_extract(t, r"^([+-]?[0-9]*\.?[0-9]+)([KMB]?)$", 1)
    scale = F.regexp_extract(t, r"^([+-]?[0-9]*\.?[0-9]+)([KMB]?)$", 2)
    factor = F.when(scale == "K", 1e3).when(scale == "M", 1e6).when(scale == "B", 1e9).otherwise(1.0)
    return F.when(n != "", n.cast("double") * factor)


def clean_csv(df: DataFrame, keep_ohlcv: bool = True) -> DataFrame:
    d = df.withColumnsRenamed({c: CSV_HEADERS[c.strip("﻿ ")] for c in df.columns if c.strip("﻿ ") in CSV_HEADERS})
    keep = [c for c in (["date", "open", "high", "low", "close", "volume", "change_pct"] if keep_ohlcv else ["date", "close"]) if c in d.columns]
    day = F.coalesce(mixed_date("date"), F.to_date(F.try_to_timestamp("date", F.lit("yyyy年MM月dd日"))), F.to_date(F.try_to_timestamp("date", F.lit("MM/dd/yyyy"))))
    return d.select(day.alias("date"), *(scaled_number(c).alias(c) for c in keep if c != "date")).where("date is not null")


def read_csv_any(spark: SparkSession, path: str) -> DataFrame:
    """UTF-8 first; where that gives no known header, Shift-JIS."""
    for encoding in ("UTF-8", "Shift_JIS"):
        df = spark.read.csv(path, header=True, encoding=encoding)
        if any(c.strip("﻿ ") in CSV_HEADERS for c in df.columns):
            return df
    return df


def suffix_date(c: Column) -> Column:
    """The date of names like x_20240105; NULL otherwise."""
    d = F.regexp_extract(c, r"_(\d{8})$", 1)
    return F.when(d != "", d)


def plain_date(c: Column) -> Column:
    d = F.regexp_extract(c, r"^(\d{8})$", 1)
    return F.when(d != "", d)
