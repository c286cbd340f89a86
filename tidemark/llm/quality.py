"""Quality scores: random Fourier features, ridge regression, isotonic calibration.

Document statistics are standardised with moments over all documents and mapped
to ``WIDTH`` random Fourier features, which approximate a Gaussian kernel. Every
partition of the labelled rows sums its share of the normal equations; the sums
are added up by blocks of rows, in two levels, and the driver solves one system
of ``WIDTH + 1`` unknowns. Scores are calibrated by pooling adjacent violators
over ``SCORE_BINS`` bins of the raw score, counted over all labelled rows; a row's
raw score there comes from the other ``FOLDS - 1`` folds, as a fit flatters its
own rows.

Defined results: a null or empty text has the statistics of an empty text and a
score like any other; labels of one document that disagree are averaged; null
labels and labels of unknown documents count for nothing; without labels of
both kinds the score is their mean, or 0.5 without any.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, held_out, table, utf8

WIDTH, BANDWIDTH, RIDGE, FOLDS, SCORE_BINS, BLOCK, SALTS = 256, 2.0, 1e-3, 4, 512, 16, 32
#: A score of at least this predicts label 1.
CUT = 0.7


def _bytes(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode("latin-1"))] = True
    return out


UPPER, LOWER, DIGIT = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes("abcdefghijklmnopqrstuvwxyz"), _bytes("0123456789")
SPACE, STOP, SYMBOL, LOUD, BAR = _bytes(" \t\r\n\v\f"), _bytes(".,;:?"), _bytes("#$%&*@^~=+<>{}[]\\/_`"), _bytes("!"), _bytes("|")
HIGH = np.arange(256) >= 128
CLASSES = np.stack([UPPER, LOWER, DIGIT, SPACE, STOP, SYMBOL, LOUD, BAR, HIGH]).astype(float)
N_STATISTICS = 21


def statistics(text: bytes) -> np.ndarray:
    """Shares and sizes of a whole text; finite for every text."""
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = max(1, len(text))
    shares = CLASSES @ seen / size
    words = text.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts = Counter(words)
    lines = text.split(b"\n")
    distinct = len(set(lines))
    letters = max(1e-9, shares[0] + shares[1])
    return np.array(
        [
            *shares,
            shares[0] / letters,
            np.log1p(len(text)),
            np.log1p(len(words)),
            lengths.mean(),
            lengths.std(),
            np.log1p(lengths.max()),
            len(counts) / n,
            np.sqrt(max(counts.values(), default=0) / n),
            sum(map(eq, words, words[1:])) / n,
            1 - distinct / len(lines),
            np.log1p(n / len(lines)),
            (lengths <= 3).sum() / n,
        ]
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([statistics(t) for t in utf8(b.column(1))]).astype(np.float32)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_STATISTICS).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["doc_id", "x"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(slim, run, "doc_id long, x array<float>")


class Features:
    """The random map, fixed by its seed, behind standardisation."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, width: int = WIDTH, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        self.w = rng.normal(size=(len(mean), width)) / np.sqrt(len(mean) / 2) / BANDWIDTH
        self.phase = rng.uniform(0, 2 * np.pi, width)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.phase)) * np.cos(z @ self.w + self.phase), np.ones((len(x), 1))])


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(len(column), -1)


def moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    aggs = [f(F.col("x")[i].cast("double")).alias(f"{k}{i}") for i in range(N_STATISTICS) for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    r = rows.agg(*aggs).first()
    return tuple(np.array([r[f"{k}{i}"] or 0.0 for i in range(N_STATISTICS)]) for k in "ms")


def _add(key: str):
    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, float) for x in t["part"].to_pylist())
        keys = [t[c].slice(0, 1).combine_chunks() for c in key.split()]
        return pa.Table.from_arrays([*keys, pa.array([total.tobytes()], pa.binary())], [*key.split(), "part"])

    return add


def normal_equations(labelled: DataFrame, features: Features, width: int = WIDTH) -> np.ndarray:
    """Per fold, the normal matrix with the right side as its last column, summed by partitions; ``labelled`` has x, y and fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((FOLDS, width + 1, width + 2))
        for b in batches:
            z, y, fold = features(matrix(b.column(0))), np.asarray(b.column(1), dtype=float), np.asarray(b.column(2))
            for k in range(FOLDS):
                mine = z[fold == k]
                total[k, :, :-1] += mine.T @ mine
                total[k, :, -1] += mine.T @ y[fold == k]
        flat = total.reshape(-1, width + 2)
        blocks = [flat[i : i + BLOCK].tobytes() for i in range(0, len(flat), BLOCK)]
        salt = TaskContext.get().partitionId() % SALTS
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([salt] * len(blocks), pa.int32()), pa.array(blocks, pa.binary())], ["block", "salt", "part"])

    parts = arrow_map(labelled.select("x", "y", "fold"), run, "block int, salt int, part binary")
    parts = parts.groupBy("block", "salt").applyInArrow(_add("block salt"), "block int, salt int, part binary")
    parts = parts.select("block", "part").groupBy("block").applyInArrow(_add("block"), "block int, part binary")
    rows = sorted(parts.collect(), key=lambda r: r["block"])  # FOLDS x (WIDTH + 1) x (WIDTH + 2) numbers in all
    if not rows:
        return np.zeros((FOLDS, width + 1, width + 2))
    return np.frombuffer(b"".join(r["part"] for r in rows), float).reshape(FOLDS, width + 1, width + 2)


def solve(a: np.ndarray) -> np.ndarray:
    """Ridge weights from summed normal equations; the last feature is 1, so that its square counts the rows."""
    n = len(a)
    return np.linalg.solve(a[:, :-1] + RIDGE * max(1.0, a[-1, -2] / 100) * np.eye(n), a[:, -1])


def isotonic(n: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Increasing shares of ones per bin, by pooling adjacent violators; half a row of each kind is added to every pool."""
    pools: list[list[float]] = []
    for k, (a, b) in enumerate(zip(n, ones)):
        pools.append([a, b, k + 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            a, b, end = pools.pop()
            pools[-1][0] += a
            pools[-1][1] += b
            pools[-1][2] = end
    out, at = np.zeros(len(n)), 0
    for a, b, end in pools:
        out[at:end], at = (b + 0.5) / (a + 1.0), end
    return np.maximum.accumulate(out)


def bin_of(raw: np.ndarray) -> np.ndarray:
    """Bins of raw scores, which are about 0 to 1."""
    return np.clip((np.asarray(raw) + 0.25) / 1.5 * SCORE_BINS, 0, SCORE_BINS - 1).astype(np.int64)


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per input row."""
    spark = docs.sparkSession
    rows = Scratch(spark, "quality").keep(with_statistics(docs))
    features = Features(*moments(rows))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where(F.col("y").isNotNull())
    known = known.groupBy("doc_id").agg(F.avg("y").alias("y")).where(~held_out(F.col("doc_id")))
    labelled = rows.join(known, "doc_id").select("x", "y", (F.crc32(F.concat(F.lit("fold"), F.col("doc_id").cast("string"))) % FOLDS).cast("int").alias("fold"))
    sums = normal_equations(labelled, features)
    weights = solve(sums.sum(axis=0))
    without = np.stack([solve(sums.sum(axis=0) - sums[k]) for k in range(FOLDS)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, ones = np.zeros(SCORE_BINS), np.zeros(SCORE_BINS)
        for b in batches:
            k = bin_of((features(matrix(b.column(0))) * without[np.asarray(b.column(2))]).sum(axis=1))
            n += np.bincount(k, minlength=SCORE_BINS)
            ones += np.bincount(k, np.asarray(b.column(1), dtype=float), minlength=SCORE_BINS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at]), pa.array(ones[at])], ["bin", "n", "ones"])

    bins = arrow_map(labelled, count, "bin int, n double, ones double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).collect()
    n, ones = np.zeros(SCORE_BINS), np.zeros(SCORE_BINS)
    for r in bins:
        n[r["bin"]], ones[r["bin"]] = r["n"], r["ones"]
    level = isotonic(n, ones) if n.sum() else np.full(SCORE_BINS, 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = features(matrix(b.column(1))) @ weights
            score = np.interp((np.clip(raw, -0.25, 1.25) + 0.25) / 1.5 * SCORE_BINS - 0.5, np.arange(SCORE_BINS), level)
            # within a pool the raw score orders documents, by at most a ten-thousandth
            score = np.clip(score + 1e-4 * (np.clip(raw, 0, 1) - 0.5), 0, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= CUT).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = arrow_map(rows, run, "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_quality(spark, sf_dir):
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
