"""External daily series under canonical keys, as one long table (date, key, value)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import exists, union_all

# Canonical macro keys and their columns; duplicates of prices and of the volatility index aren't taken.
MACRO = {
    "jp_10y": "japan_10y_yield",
    "jp_policy": "japan_policy_rate",
    "us_10y": "us_10y_yield",
    "us_ff": "us_federal_funds_rate",
    "jp_cpi": "japan_cpi",
    "us_cpi": "us_cpi",
    "us_core_cpi": "us_core_cpi",
    "vix": "vix",
    "gbpjpy": "gbp_jpy",
}

EMPTY = "date date, key string, value double"


def _between(c: Column, start: str | None, end: str | None) -> Column:
    """Inclusive on both ends; an open end doesn't bound."""
    low = c >= F.lit(start).cast("date") if start else F.lit(True)
    return low & (c <= F.lit(end).cast("date")) if end else low


def _long(table: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """One row per date and key; of several rows of a date the last in time counts."""
    values = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.expr(f"try_cast(`{c}` as double)").alias("value")) for k, c in columns.items()))).alias("e")
    d = table.select(F.col("date").cast("timestamp").alias("_t"), values).select("_t", "e.key", "e.value")
    return d.groupBy(F.to_date("_t").alias("date"), "key").agg(F.max_by("value", "_t").alias("value"))


def load_external_prices(spark: SparkSession, folder: str, files: Mapping[str, str], keys: Sequence[str] | None = None, field: str = "close", start: str | None = None, end: str | None = None) -> DataFrame:
    """(date, key, value): one field of the price files (date, open, high, low, close, ...) of a catalog {key: file name}.

    Unknown keys, missing files and files without the field are skipped.
    """
    parts = []
    for key in files if keys is None else [k for k in keys if k in files]:
        path = f"{folder}/{files[key]}"
        if exists(spark, path):
            table = spark.read.parquet(path)
            if field in table.columns:
                parts.append(_long(table, {key: field}))
    out = union_all(parts) if parts else spark.createDataFrame([], EMPTY)
    return out.where(_between(F.col("date"), start, end))


def load_macro(spark: SparkSession, path: str, keys: Sequence[str] | None = None, start: str | None = None, end: str | None = None, columns: Mapping[str, str] = MACRO) -> DataFrame:
    """(date, key, value): the macro columns of one wide table (date, ...) under their canonical keys; empty without the file."""
    if not exists(spark, path):
        return spark.createDataFrame([], EMPTY)
    table = spark.read.parquet(path)
    have = {k: c for k, c in columns.items() if c in table.columns and (keys is None or k in keys)}
    if not have:
        return spark.createDataFrame([], EMPTY)
    return _long(table, have).where(_between(F.col("date"), start, end))
