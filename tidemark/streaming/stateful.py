"""Streams of ticks: threshold bars, tick rule and Kalman hedge with the state of the batch folds.

A key's fold is its state. Ticks of a micro-batch are sorted by time before they
pass; a bar is emitted when it closes, an unfinished one stays in the state, so
that a stream that has seen all ticks has emitted exactly the batch's bars.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.bars import BAR, ThresholdBar
from ..operators.timeseries import Kalman


def stateful_fold(stream: DataFrame, key: str, order: list[str], make: Callable[[], object], inputs: list[str], schema: str) -> DataFrame:
    """(key, what ``step`` gives), over a stream; the fold is kept per key between micro-batches."""
    kind = dict(stream.dtypes)[key]
    names = [key, *(c.strip().split()[0].strip("`") for c in schema.split(","))]

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold = pickle.loads(state.get[0]) if state.exists else make()
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        out = [(k[0], *got) for row in zip(*(rows[c].tolist() for c in inputs)) if (got := fold.step(*row)) is not None]
        state.update((pickle.dumps(fold),))
        yield pd.DataFrame(out, columns=names)

    slim = stream.select(*dict.fromkeys([key, *order, *inputs]))
    return slim.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, {schema}", "fold binary", "append", GroupStateTimeout.NoTimeout)


def stream_bars(trades: DataFrame, threshold: float, kind: str = "dollar") -> DataFrame:
    inc = {"dollar": F.col("price") * F.col("volume"), "volume": F.col("volume"), "tick": F.lit(1.0)}[kind]
    d = trades.withColumn("_inc", inc.cast("double"))
    return stateful_fold(d, "symbol", ["ts", "seq"], lambda: ThresholdBar(threshold), ["ts", "price", "volume", "_inc"], BAR)


class TickSign:
    """Sign of the last price change."""

    def __init__(self, init: int = 1):
        self.price, self.sign = None, float(init)

    def step(self, ts, seq, price):
        if self.price is not None and price != self.price:
            self.sign = 1.0 if price > self.price else -1.0
        self.price = price
        return (ts, seq, self.sign)


def stream_tick_rule(trades: DataFrame, init: int = 1) -> DataFrame:
    return stateful_fold(trades, "symbol", ["ts", "seq"], lambda: TickSign(init), ["ts", "seq", "price"], "ts timestamp, seq long, sign double")


def stream_kalman(pairs: DataFrame, delta: float = 1e-4, r: float = 1e-3) -> DataFrame:
    return stateful_fold(pairs, "pair", ["ts"], lambda: Kalman(delta, r), ["ts", "y", "x"], "ts timestamp, beta double, alpha double, innovation double, sd double, z double")


def stream_candles(trades: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Time bars; a window is emitted once the watermark has passed it, later ticks are dropped."""
    at = F.struct("ts", "seq")
    return (
        trades.withWatermark("ts", late)
        .groupBy("symbol", F.window("ts", width))
        .agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"))
        .select("symbol", F.col("window.start").alias("start"), "open", "high", "low", "close", "volume")
    )


def upsert_sink(path: str, keys: list[str]):
    """For ``foreachBatch``: adds rows whose keys the table lacks, so that a repeated micro-batch changes nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        from ..operators.joins import anti
        from ..sources.store import exists

        spark = batch.sparkSession
        new = batch.dropDuplicates(keys)
        if exists(spark, path):
            new = anti(new, spark.read.parquet(path), keys)
        new.write.mode("append").parquet(path)

    return write
