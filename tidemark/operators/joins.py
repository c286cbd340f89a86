"""As-of, interval and calendar joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    values: Sequence[str],
    by: Sequence[str] = (),
    seq: Sequence[str] = (),
    strict: bool = False,
    tolerance_days: int | None = None,
    bucket: str | None = None,
) -> DataFrame:
    """Each left row with the latest right row at or before it (before it, if ``strict``).

    Both sides are one relation in time order, and the last right row is carried
    forward: one shuffle on ``by``, no range join. ``seq`` orders right rows of
    one time. A matched row brings its nulls along. Rows older than
    ``tolerance_days`` don't match.

    With ``bucket`` ("month", "year"), time is cut into buckets that are carried
    in parallel; the last right row of each bucket crosses over through a table
    of one row per key and bucket. Use it where one key holds a large share of
    the rows.
    """
    names = [f"_v{i}" for i in range(len(values))]
    keys = list(by)
    row = F.struct(F.col(right_on).alias("_at"), *(F.col(v).alias(n) for v, n in zip(values, names)))
    ts = "_ts"
    rank = F.array(*(F.col(c).cast("double") for c in seq)) if seq else F.array(F.lit(0.0))
    sides = left.select(F.struct("*").alias("_l"), *keys, F.col(left_on).alias(ts), F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast("array<double>").alias("_seq"))
    sides = sides.unionByName(right.where(F.col(right_on).isNotNull()).select(row.alias("_r"), *keys, F.col(right_on).alias(ts), F.lit(1 if strict else 0).alias("_side"), rank.alias("_seq")), allowMissingColumns=True)
    order = [ts, "_side", "_seq"]
    if bucket:
        sides = sides.withColumn("_b", F.date_trunc(bucket, F.col(ts).cast("timestamp")))
        w = Window.partitionBy(*keys, "_b").orderBy(*order)
        carried = F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        ends = sides.where(F.col("_r").isNotNull()).groupBy(*keys, "_b").agg(F.max_by("_r", F.struct(*order)).alias("_end"))
        every = sides.select(*keys, "_b").distinct().join(ends, [*keys, "_b"], "left")
        before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        every = every.select(*keys, "_b", F.last("_end", ignorenulls=True).over(before).alias("_before"))
        found = sides.withColumn("_c", carried).join(every, [*keys, "_b"]).withColumn("_hit", F.coalesce("_c", "_before"))
    else:
        w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = sides.withColumn("_hit", F.last("_r", ignorenulls=True).over(w))
    hit = F.col("_hit")
    if tolerance_days is not None:
        hit = F.when(F.datediff(F.col(ts), F.col("_hit._at")) <= tolerance_days, F.col("_hit"))
    out = found.where(F.col("_l").isNotNull()).withColumn("_hit", hit)
    return out.select("_l.*", *(F.col("_hit")[n].alias(v if v not in left.columns else f"{v}_asof") for v, n in zip(values, names)))


def calendar_positions(dates: DataFrame, date: str = "date") -> DataFrame:
    """(date, pos): the distinct dates with their positions from 0; one row per trading day."""
    return dates.select(date).distinct().withColumn("pos", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(date)) - 1).cast("long"))


def densify(facts: DataFrame, date: str = "date", code: str = "code") -> DataFrame:
    """The grid of all dates and codes, facts where there are any; rows before a code's first date stay null."""
    dates, codes = facts.select(date).distinct(), facts.select(code).distinct()
    calendar = dates.agg(F.array_sort(F.collect_set(date)).alias("_dates"))  # one row: trading days, thousands at most
    return codes.join(F.broadcast(calendar)).select(F.explode("_dates").alias(date), code).join(facts, [date, code], "left")


def interval_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, by: Sequence[str] = (), unit: str = "day") -> DataFrame:
    """Points inside closed spans. Both sides meet in buckets of ``unit``, so that the range test is no nested loop."""
    step = F.expr(f"interval 1 {unit}")
    cut = lambda c: F.date_trunc(unit, F.col(c).cast("timestamp"))
    spread = spans.where(F.col(start) <= F.col(end)).withColumn("_b", F.explode(F.sequence(cut(start), cut(end), step)))
    return points.withColumn("_b", cut(at)).join(spread, [*by, "_b"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("_b")


def overlap_anti(labels: DataFrame, spans: DataFrame, t0: str, t1: str, start: str, end: str) -> DataFrame:
    """Labels whose closed interval meets none of a few test spans; spans are merged first, a handful of rows."""
    w = Window.partitionBy(F.lit(0)).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    merged = spans.withColumn("_new", F.coalesce((F.col(start) > reach).cast("int"), F.lit(1))).withColumn("_g", F.sum("_new").over(w)).groupBy("_g").agg(F.min(start).alias("_s"), F.max(end).alias("_e"))
    return labels.join(merged, (F.col(t0) <= F.col("_e")) & (F.col(t1) >= F.col("_s")), "left_anti")


def anti(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right.select(*on).distinct(), list(on), "left_anti")


def full_weights(target: DataFrame, held: DataFrame, on: Sequence[str] = ("code",)) -> DataFrame:
    """(keys, target, held): full outer join of two weight tables (column weight), absent as 0."""
    t, h = target.select(*on, F.col("weight").alias("target")), held.select(*on, F.col("weight").alias("held"))
    return t.join(h, list(on), "full").fillna(0.0, ["target", "held"])


def coalesced(c: Column, value: float) -> Column:
    return F.coalesce(c, F.lit(value))
