"""Language identification as inference of a multilingual mixture.

Learning counts byte 3-grams of letters per language over all rows that may be
learned from, in ``BINS`` hashed bins, so that a model is ``BINS`` numbers per
language whatever the corpus holds. For a document, expectation-maximisation
estimates the proportions of the languages from the 3-grams' likelihoods.
Language sets are grown from the likeliest language; the one with the steepest
gain joins next, and only if the likelihood gains more than the penalty for one more parameter,
``0.5 ln(number of 3-grams)``.

Defined results: ``und`` with score 0 for a null or empty text or one without a
letter, and for every text if there is nothing to learn from; equal texts have
equal results; very long texts are counted whole, in bounded pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, held_out, is_held_out, table, utf8

BINS = 1 << 16
STEPS = 12
#: Bytes of a text that are hashed at once.
PIECE = 1 << 22
LETTER = re.compile(r"[^\W\d_]")
#: A-Z to a-z; every other ASCII character but a-z to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def trigram_codes(text: bytes) -> Iterator[np.ndarray]:
    """Bins of the 3-grams of a text with a space on both sides, in pieces; runs of spaces count once."""
    for at in range(0, max(1, len(text)), PIECE):
        b = np.frombuffer(b" " + text[max(0, at - 2 * (at > 0)) : at + PIECE].translate(FOLD) + b" ", np.uint8).astype(np.uint32)
        keep = np.ones(len(b), bool)
        keep[1:] = (b[1:] != 32) | (b[:-1] != 32)
        b = b[keep]
        if len(b) >= 3:
            yield (((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) * np.uint32(2_654_435_761) >> 16).astype(np.uint16)


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """Log-likelihoods of the bins by language, from every document with a language that isn't held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            texts, langs = utf8(b.column(0)), b.column(1).to_pylist()
            for lang in set(langs):
                own = counts.setdefault(lang, np.zeros(BINS, np.int64))
                for codes in trigram_codes(b"  ".join(t for t, x in zip(texts, langs) if x == lang)):
                    own += np.bincount(codes, minlength=BINS)
        for lang, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], ["lang", "bin", "n"])

    slim = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("text").cast("string").alias("text"), "lang")
    counts = arrow_map(slim, run, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    # one row per language: its bins, at most BINS of them
    rows = counts.groupBy("lang").agg(F.collect_list(F.struct("bin", "n")).alias("bins")).collect()
    model = {}
    for r in sorted(rows, key=lambda r: r["lang"]):
        own = np.full(BINS, 0.5)
        for b, n in r["bins"]:
            own[b] += n
        model[r["lang"]] = np.log(own / own.sum())
    return model


def fit(p: np.ndarray, n: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Proportions of the columns of ``p`` (likelihoods of the rows, seen ``n`` times), and the log-likelihood."""
    share = np.full(p.shape[1], 1 / p.shape[1])
    if p.shape[1] > 1:
        for _ in range(steps):
            mix = p @ share
            share = share * ((n / mix) @ p) / n.sum()
    return share, float(n @ np.log(p @ share))


def counted(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The bins that a text has, and how often."""
    pieces = list(trigram_codes(text)) if len(text) <= PIECE else None
    if pieces is None:
        total = sum(np.bincount(codes, minlength=BINS) for codes in trigram_codes(text))
        bins = np.flatnonzero(total)
        return bins, total[bins].astype(float)
    if not pieces:
        return np.zeros(0, np.int64), np.zeros(0)
    codes = np.sort(pieces[0], kind="stable")  # a radix sort for 16 bits
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first], np.diff(np.append(first, len(codes))).astype(float)


def mixture(text: bytes, table: np.ndarray, likelihood: np.ndarray) -> list[tuple[int, float]]:
    """(language, proportion) of the selected set, largest first; empty if there is no 3-gram.

    ``table`` holds log-likelihoods, bins by languages; ``likelihood`` their
    exponentials. The likelihood is concave in the proportions, so that a
    language whose mean likelihood ratio to the mixture is 1 or less can't gain.
    """
    bins, n = counted(text)
    if not len(bins):
        return []
    p, alone, size = likelihood[bins], n @ table[bins], n.sum()
    chosen = [int(np.argmax(alone))]
    value, share, penalty = float(alone[chosen[0]]), np.ones(1), 0.5 * np.log(size)
    while len(chosen) < p.shape[1]:
        ratio = (n / (p[:, chosen] @ share)) @ p / size
        ratio[chosen] = 0
        k = int(np.argmax(ratio))
        if ratio[k] <= 1:
            break
        after, got = fit(p[:, [*chosen, k]], n)
        if got - value <= penalty:
            break
        chosen, value, share = [*chosen, k], got, after
    return sorted(zip(chosen, share.tolist()), key=lambda x: (-x[1], x[0]))


PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, languages string"


def identify(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages): one row per input row; score is the language's proportion.

    ``languages`` lists the selected set with proportions, largest first.
    """
    names = list(model)
    logs = np.stack([model[x] for x in names], axis=1) if names else np.zeros((BINS, 0))
    shared = docs.sparkSession.sparkContext.broadcast(logs)  # BINS numbers per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value
        likelihood = np.exp(logs)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                found = mixture(text, logs, likelihood) if names and LETTER.search(text.decode()) else []
                lang, score = (names[found[0][0]], min(1.0, found[0][1])) if found else ("und", 0.0)
                rows.append((doc_id, is_held_out(doc_id), lang, score, ",".join(f"{names[i]}:{s:.3f}" for i, s in found)))
            kinds = [pa.int64(), pa.bool_(), pa.string(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in PREDICTED.split(", ")])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, PREDICTED)


#: A document of which no language has this share is rejected.
LEAST_SHARE = 0.3


def keep_identified(docs: DataFrame, model: dict[str, np.ndarray], least: float = LEAST_SHARE) -> DataFrame:
    """The rows of ``docs`` with a language that makes up ``least`` of the text; without a model, those with a letter."""
    logs = np.stack(list(model.values()), axis=1) if model else np.zeros((BINS, 0))
    shared = docs.sparkSession.sparkContext.broadcast(logs)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value
        likelihood = np.exp(logs)
        for b in batches:
            keep = []
            for text in utf8(b.column(at)):
                ok = bool(LETTER.search(text.decode()))
                if ok and logs.shape[1]:
                    found = mixture(text, logs, likelihood)
                    ok = bool(found) and found[0][1] >= least
                keep.append(ok)
            yield b.filter(pa.array(keep, pa.bool_()))

    return arrow_map(docs, run, docs.schema)


def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))
