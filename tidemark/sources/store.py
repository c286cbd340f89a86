"""Storage layers: raw by date, silver long tables, features; manifests and incremental refresh."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.semantics import keep_last
from ..operators.joins import anti
from ..operators.panels import back_adjust, equal_weight_market, price_features
from ..operators.statistics import vol_regime

# Raw column names and the fields they hold.
FIELDS = {"O": "open", "H": "high", "L": "low", "C": "close", "Vo": "volume", "Va": "turnover", "AdjFactor": "adj_factor", "UL": "ul", "LL": "ll"}


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def resolve_field(name: str) -> str:
    return FIELDS.get(name, {"AdjC": "adj_close", "AdjO": "adj_open", "AdjH": "adj_high", "AdjL": "adj_low"}.get(name, name))


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """All raw files of a folder as one long table, whatever columns each has."""
    raw = spark.read.option("mergeSchema", True).parquet(path)
    keep = [c for c in raw.columns if c in FIELDS]
    return raw.select(F.to_date("Date").alias("date"), F.col("Code").cast("string").alias("code"), *(F.col(c).cast("double").alias(FIELDS[c]) for c in keep)).where("code is not null")


def materialize_long(spark: SparkSession, raw_path: str, silver_path: str, seq: Sequence[str] = (), incremental: bool = True) -> int:
    """Adds the raw dates that the silver table lacks, for all its fields; returns how many dates.

    One row per (date, code), the last one; partitions by year are replaced as a
    whole, so that a second run finds nothing to do and a failed one is repeated.
    """
    raw = read_raw(spark, raw_path)
    had = spark.read.parquet(silver_path) if incremental and exists(spark, silver_path) else None
    if had is not None and set(raw.columns) <= set(had.columns):
        new = anti(raw, had, ["date"])
    else:
        new, had = raw, None
    dates = new.select("date").distinct().count()
    if not dates:
        return 0
    new = keep_last(new, ["date", "code"], list(seq) or [c for c in ("volume", "close") if c in new.columns]).withColumn("year", F.year("date"))
    if had is not None:
        years = new.select("year").distinct()
        new = new.unionByName(had.join(F.broadcast(years), "year", "left_semi"), allowMissingColumns=True)  # years: a handful
        staged = f"{silver_path}_staged"
        new.write.mode("overwrite").partitionBy("year").parquet(staged)
        new = spark.read.parquet(staged)
    mode = new.repartition("year").sortWithinPartitions("code", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if had is not None else "static")
    mode.partitionBy("year").parquet(silver_path)
    return dates


def load(spark: SparkSession, path: str, fields: Sequence[str], start: str | None = None, end: str | None = None, codes: Sequence[str] | None = None) -> DataFrame:
    """(date, code, fields) between two dates; filters and columns reach the scan."""
    d = spark.read.parquet(path)
    if start:
        d = d.where((F.col("date") >= F.lit(start).cast("date")) & (F.col("year") >= int(start[:4])))
    if end:
        d = d.where((F.col("date") <= F.lit(end).cast("date")) & (F.col("year") <= int(end[:4])))
    if codes is not None:
        d = d.where(F.col("code").isin(list(codes)))
    return d.select("date", "code", *map(resolve_field, fields))


def rebuild_adjusted(panel: DataFrame, fields: Sequence[str] = ("close", "open", "high", "low")) -> DataFrame:
    return back_adjust(panel, "adj_factor", [f for f in fields if f in panel.columns])


def health_check(panel: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, days, codes, start, end, null_share, same_calendar): one pass; the calendar is compared with that of close."""
    long = panel.unpivot(["date", "code"], list(fields), "field", "value")
    n = panel.agg(F.countDistinct("date").alias("_d"), F.countDistinct("code").alias("_c"))
    have = F.col("value").isNotNull()
    g = long.groupBy("field").agg(F.countDistinct(F.when(have, F.col("date"))).alias("days"), F.countDistinct(F.when(have, F.col("code"))).alias("codes"), F.min(F.when(have, F.col("date"))).alias("start"), F.max(F.when(have, F.col("date"))).alias("end"), F.count("value").alias("_n"))
    close = g.where("field = 'close'").select(F.col("days").alias("_cd"))
    return g.join(F.broadcast(n)).join(F.broadcast(close), how="left").select("field", "days", "codes", "start", "end", (1 - F.col("_n") / (F.col("_d") * F.col("_c"))).alias("null_share"), (F.col("days") == F.col("_cd")).alias("same_calendar"))


def materialize_features(spark: SparkSession, panel: DataFrame, path: str) -> None:
    """Price features as floats, and the market's regimes."""
    f = price_features(panel)
    f.select("date", "code", *(F.col(c).cast("float").alias(c) for c in f.columns[2:])).withColumn("year", F.year("date")).write.mode("overwrite").partitionBy("year").parquet(f"{path}/features")
    build_regime(panel).write.mode("overwrite").parquet(f"{path}/regime")


def load_feature(spark: SparkSession, path: str, name: str, start: str | None = None, end: str | None = None) -> DataFrame | None:
    """(date, code, name) of the price features, or (date, name) of the market's regimes; None where neither is there."""
    for table in ("features", "regime"):
        if exists(spark, f"{path}/{table}"):
            d = spark.read.parquet(f"{path}/{table}")
            if name in d.columns:
                if start:
                    d = d.where(F.col("date") >= F.lit(start).cast("date"))
                if end:
                    d = d.where(F.col("date") <= F.lit(end).cast("date"))
                return d.select(*(c for c in ("date", "code") if c in d.columns), name)
    return None


def materialize_all(spark: SparkSession, raw: str, silver: str, features: str) -> DataFrame:
    """The daily round: new dates into the silver table, adjusted prices and features from it; the dates added."""
    added = materialize_long(spark, raw, silver)
    panel = spark.read.parquet(silver)
    if "adj_factor" in panel.columns:
        panel = rebuild_adjusted(panel)
    materialize_features(spark, panel, features)
    return added


def build_regime(panel: DataFrame, vol_window: int = 60, trend_window: int = 200, min_periods: int = 252) -> DataFrame:
    """(date, ret, level, vol_regime, trend_up)."""
    m = equal_weight_market(panel)
    w = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(-(trend_window - 1), Window.currentRow)
    trend = F.when(F.count("level").over(w) >= trend_window, F.col("level") > F.avg("level").over(w))
    return m.withColumn("trend_up", trend).join(vol_regime(m, vol_window, min_periods).withColumnRenamed("regime", "vol_regime"), "date")


def candidate_dates(spark: SparkSession, cadence: str, start: str, end: str) -> DataFrame:
    """(date): business days, or Fridays for the cadence ``weekly``."""
    d = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    dow = F.dayofweek("date")
    return d.where(dow == 6 if cadence == "weekly" else dow.between(2, 6))


def missing_dates(candidates: DataFrame, fetched: DataFrame) -> DataFrame:
    return anti(candidates, fetched, ["date"])


class Manifest:
    """Which dates of which dataset were fetched, empty results included: an append-only table."""

    SCHEMA = "dataset string, date date, status string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], self.SCHEMA)

    def fetched(self, dataset: str) -> DataFrame:
        return self.table().where(F.col("dataset") == dataset).select("date").distinct()

    def mark(self, dataset: str, dates: DataFrame, status: str = "ok") -> None:
        """Adds dates that aren't marked yet."""
        new = anti(dates.select("date"), self.fetched(dataset), ["date"])
        new.select(F.lit(dataset).alias("dataset"), "date", F.lit(status).alias("status")).coalesce(1).write.mode("append").parquet(self.path)


class Updater:
    """Fetches what the manifest lacks, dataset after dataset; a failure of one doesn't stop the others.

    ``datasets``: name to (cadence, fetch), where fetch(dates) gives a frame to
    append under ``base/name``, or None for no rows.
    """

    def __init__(self, spark: SparkSession, base: str, datasets: dict[str, tuple[str, Callable[[DataFrame], DataFrame | None]]], start: str):
        self.spark, self.base, self.datasets, self.start = spark, base, datasets, start
        self.manifest = Manifest(spark, f"{base}/_manifest")

    def plan(self, name: str, until: str) -> DataFrame:
        return missing_dates(candidate_dates(self.spark, self.datasets[name][0], self.start, until), self.manifest.fetched(name))

    def update(self, until: str) -> dict[str, str]:
        status = {}
        for name, (_, fetch) in self.datasets.items():
            try:
                plan = self.plan(name, until)
                n = plan.count()
                if n:
                    got = fetch(plan)
                    if got is not None:
                        got.write.mode("append").parquet(f"{self.base}/{name}")
                    self.manifest.mark(name, plan)
                status[name] = f"OK {n}"
            except Exception as e:  # noqa: BLE001  one vendor's outage must not stop the rest; the status says so
                status[name] = f"FAIL {type(e).__name__}: {e}"
        return status


def validate_overlap(old: DataFrame, new: DataFrame, min_overlap: int = 5, lookback: int = 60, tolerance: float = 0.02) -> DataFrame:
    """(n, median_diff, ok) over the last common dates of (date, close)."""
    d = old.select("date", F.col("close").alias("a")).join(new.select("date", F.col("close").alias("b")), "date").where("a <> 0 and b is not null")
    last = d.orderBy(F.desc("date")).limit(lookback)
    g = last.agg(F.count(F.lit(1)).alias("n"), F.percentile(F.abs(F.col("b") / F.col("a") - 1), 0.5).alias("median_diff"))
    return g.withColumn("ok", (F.col("n") >= min_overlap) & (F.coalesce("median_diff", F.lit(1.0)) <= tolerance))


def merge_new_dates(old: DataFrame, new: DataFrame, cutoff: str | Column | None = None) -> DataFrame:
    """Old rows as they are, and new ones after the last old date and before the cutoff (today); changes in per cent, over the seam too."""
    end = F.to_date(F.current_timestamp()) if cutoff is None else F.lit(cutoff).cast("date") if isinstance(cutoff, str) else cutoff
    last = old.agg(F.max("date").alias("_last"))
    add = new.join(F.broadcast(last)).where((F.coalesce(F.col("date") > F.col("_last"), F.lit(True))) & (F.col("date") < end)).drop("_last")
    both = old.withColumn("_new", F.lit(False)).unionByName(add.withColumn("_new", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    pct = F.round((F.try_divide(F.col("close"), F.lag("close").over(w)) - 1) * 100, 2)
    old_pct = F.col("change_pct") if "change_pct" in both.columns else F.lit(None).cast("double")
    return both.withColumn("change_pct", F.when(F.col("_new"), pct).otherwise(old_pct)).drop("_new")


def merge_series(frames: Sequence[DataFrame]) -> DataFrame:
    """Full outer join on date; a column that clashes gets the suffix _dup and its frame's number."""
    out = frames[0]
    for i, f in enumerate(frames[1:], 1):
        out = out.join(f.withColumnsRenamed({c: f"{c}_dup{i}" for c in f.columns if c != "date" and c in out.columns}), "date", "full")
    return out


def forward_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns if c in df.columns})


def null_report(df: DataFrame) -> DataFrame:
    """(column, nulls, share) in one pass."""
    n = F.count(F.lit(1))
    g = df.agg(n.alias("_n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("long").alias("nulls")) for c in df.columns))).alias("e")
    return g.select("_n", rows).select("e.column", "e.nulls", F.try_divide("e.nulls", "_n").alias("share"))


def list_series(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(key, rows, start, end, status) for every key of a catalog; MISSING without rows."""
    spark = series.sparkSession
    catalog = spark.createDataFrame([(k,) for k in keys], "key string")
    g = series.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("start"), F.max("date").alias("end"))
    return catalog.join(g, "key", "left").select("key", F.coalesce("rows", F.lit(0)).alias("rows"), "start", "end", F.when(F.col("rows") > 0, "OK").otherwise("MISSING").alias("status"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


