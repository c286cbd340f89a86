"""The engine's relations over the test tables, in Spark and as SQL text of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, d: str) -> DataFrame:
    """Monthly prices of suppliers: one row per (month, supplier)."""
    p = F.col("l_extendedprice") / F.col("l_quantity")
    return read(spark, d, "lineitem").groupBy(F.date_trunc("month", "l_shipdate").alias("date"), F.col("l_suppkey").alias("code")).agg(
        F.avg(p).alias("close"), F.max(p).alias("high"), F.min(p).alias("low"), F.min_by(p, F.struct("l_shipdate", p)).alias("open"), F.sum("l_extendedprice").alias("turnover"), F.sum("l_quantity").alias("volume")
    )


PANEL = """panel AS (
  SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS date, l_suppkey AS code, avg(l_extendedprice / l_quantity) AS close,
         max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
         arg_min(l_extendedprice / l_quantity, row(l_shipdate, l_extendedprice / l_quantity)) AS open,
         sum(l_extendedprice) AS turnover, sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2)"""


def trades(spark: SparkSession, d: str) -> DataFrame:
    side = F.when(F.col("event_type") == "purchase", "buy").when(F.col("event_type") == "error", "sell")
    return read(spark, d, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), (1 + F.col("user_id") % 10).cast("double").alias("volume"), side.alias("side"))


TRADES = """trades AS (
  SELECT event_type AS symbol, ts::TIMESTAMP AS ts, event_id AS seq, value AS price, (1 + user_id % 10)::DOUBLE AS volume,
         CASE event_type WHEN 'purchase' THEN 'buy' WHEN 'error' THEN 'sell' END AS side FROM events)"""


def bars(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars of trades."""
    at = F.struct("ts", "seq")
    t = trades(spark, d).groupBy("symbol", F.date_trunc("hour", "ts").alias("h")).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"), F.sum(F.col("price") * F.col("volume")).alias("dollar"))
    return t.withColumnRenamed("h", "ts").where("low > 0")


BARS = (
    TRADES
    + """, bars AS (
  SELECT symbol, date_trunc('hour', ts)::TIMESTAMP AS ts, arg_min(price, row(ts, seq)) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, row(ts, seq)) AS close, sum(volume) AS volume, sum(price * volume) AS dollar
  FROM trades GROUP BY 1, date_trunc('hour', ts) HAVING min(price) > 0)"""
)


def fund(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(F.col("o_custkey").alias("Code"), F.col("o_orderdate").cast("date").alias("DiscDate"), F.col("o_orderkey").alias("DiscNo"), F.col("o_totalprice").alias("FEPS"), (F.col("o_totalprice") * 0.9 + F.col("o_orderkey") % 7 * 1000).alias("EPS"), F.col("o_orderpriority").alias("CurPerType"))


FUND = """fund AS (
  SELECT o_custkey AS Code, o_orderdate::DATE AS DiscDate, o_orderkey AS DiscNo, o_totalprice AS FEPS,
         o_totalprice * 0.9 + o_orderkey % 7 * 1000 AS EPS, o_orderpriority AS CurPerType FROM orders)"""


def quarter_ends(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(F.last_day(F.date_trunc("quarter", "o_orderdate")).alias("date")).distinct()


QUARTERS = "quarters AS (SELECT DISTINCT last_day(date_trunc('quarter', o_orderdate))::DATE AS date FROM orders)"


def sectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "supplier").join(F.broadcast(read(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("code"), F.col("n_regionkey").alias("sector"))  # nations: 25 rows


SECTORS = "sectors AS (SELECT s_suppkey AS code, n_regionkey AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def labels(spark: SparkSession, d: str) -> DataFrame:
    """Every bar's label lasts five bars."""
    w = Window.partitionBy("symbol").orderBy("ts")
    return bars(spark, d).withColumn("t1", F.lead("ts", 5).over(w)).where("t1 IS NOT NULL").select("symbol", F.col("ts").alias("t0"), "t1")


LABELS = (
    BARS
    + """, labels3 AS (
  SELECT symbol, ts AS t0, t1 FROM (
    SELECT symbol, ts, lead(ts, 5) OVER w AS t1 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))
  WHERE t1 IS NOT NULL)"""
)


def daily(spark: SparkSession, d: str) -> DataFrame:
    """A market series: the mean value of each hour's events, as level and return."""
    g = read(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("date")).agg(F.avg("value").alias("level"))
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    return g.withColumn("ret", F.col("level") / F.lag("level").over(w) - 1)


DAILY = """daily AS (
  SELECT date, level, level / lag(level) OVER (ORDER BY date) - 1 AS ret FROM (
    SELECT date_trunc('hour', ts)::TIMESTAMP AS date, avg(value) AS level FROM events GROUP BY 1))"""


def sleeves(spark: SparkSession, d: str) -> DataFrame:
    """Monthly returns of five strategies: the mean returns of suppliers by sector."""
    from ..operators.panels import by_code

    p = panel(spark, d)
    r = p.select("date", "code", (F.col("close") / F.lag("close").over(by_code()) - 1).alias("r")).join(sectors(spark, d), "code")
    return r.groupBy(F.concat(F.lit("s"), F.col("sector").cast("string")).alias("strategy"), "date").agg(F.avg("r").alias("ret")).where("ret is not null")


SLEEVES = (
    PANEL
    + ", "
    + SECTORS
    + """, sleeves AS (
  SELECT 's' || sector AS strategy, date, avg(r) AS ret FROM (
    SELECT date, code, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS r FROM panel) JOIN sectors USING (code)
  GROUP BY 1, 2 HAVING avg(r) IS NOT NULL)"""
)
