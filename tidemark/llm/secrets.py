"""Secret scans: known shapes, and a battery of randomness tests.

Known shapes are assignments, access keys and hexadecimal runs. What they leave
of a run of 20 or more characters of an encoding is tested besides, whole and in
pieces: without ``+ /`` (as base64url), without ``- _`` (as base64), and letters
and digits alone, so that a key counts for itself within an address or a path.
A ``=`` ends a run, but for padding. A piece's encoding is the smallest alphabet
that holds it. Four tests then ask whether it could be something else than
random, each with a p-value that is small for random characters only:

- chi-squared uniformity: characters of a ``PART`` of the alphabet would be used as evenly,
- likelihood: text would have characters as rare in text as these (the
  likelihood ratio of the even to the text's use bounds that probability),
- serial correlation: neighbours that go together (``ORDERED``) would look as unrelated,
- runs: a sequence that switches between the alphabet's halves rarely, or nearly
  always (``SWITCH``), would switch as often.

A secret must be none of the four, so the largest p-value is the piece's (an
intersection-union test), times the number of ways its run was cut. Of
overlapping pieces the one with the least value counts.

The false-discovery rate over all pieces of all documents is held at ``FDR`` by
the step-up rule on weighted p-values, the weights growing with length. What it
needs is a histogram of p-values by length class, ``P_BINS`` x ``CLASSES``
counts whatever the corpus holds; a first scan counts it, a second one decides.

Defined results: a null or empty text has no spans, an empty table no rows;
copies and rows with the same or a null id are scanned each for itself and have
equal spans; only the id and the text are read, so that further columns may have
any name (``redact_secrets`` hands them through). Spans are in code points, ends
exclusive; texts and runs are tested whole, however long.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, table, utf8

# The known shapes and the least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KINDS = ["assign", "access", "hex", "random"]
#: One of these stands in every assignment.
WORDS = [b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"]

LEAST_RUN = 20
RUN = re.compile(rf"([A-Za-z0-9+/_-]{{{LEAST_RUN},}})(={{0,2}})")
#: How a run is cut into pieces.
CUTS = [re.compile(rf"[{chars}]{{{LEAST_RUN},}}") for chars in ("A-Za-z0-9+/", "A-Za-z0-9_-", "A-Za-z0-9")]
#: Characters of runs stay, the others become spaces.
FOLD = bytes(b if chr(b).isalnum() and b < 128 or chr(b) in "+/_-" else 32 for b in range(256))
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Alphabets from small to large: the first that holds a piece is its encoding.
ENCODINGS = {
    "hex": DIGITS + "abcdef",
    "HEX": DIGITS + "ABCDEF",
    "lower letters": LOWER,
    "upper letters": UPPER,
    "base32": UPPER + "234567",
    "lower": LOWER + DIGITS,
    "upper": UPPER + DIGITS,
    "letters": UPPER + LOWER,
    "base62": UPPER + LOWER + DIGITS,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
}
# Per cent of the letters a to z in running text.
LETTERS = [8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074]
#: The share of a character class in text that could look like a run.
DIGIT_SHARE, OTHER_SHARE, UPPER_SHARE = 0.10, 0.02, 0.10
#: What random characters are told from: the part of an alphabet, the correlation, the least and largest chance of a switch.
PART, ORDERED, SWITCH = 0.2, 0.9, (0.1, 0.95)
FDR, P_BINS, CLASSES = 0.01, 400, 8


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _text_share(alphabet: str) -> np.ndarray:
    one_case = alphabet.lower() == alphabet or alphabet.upper() == alphabet
    share = np.array([LETTERS[ord(c.lower()) - 97] * (1.0 if c.islower() or one_case else UPPER_SHARE) if c.isalpha() else 0.0 for c in alphabet])
    digits, others = [c.isdigit() for c in alphabet], [not c.isalnum() for c in alphabet]
    share *= (1 - DIGIT_SHARE * any(digits)) / share.sum()
    share[digits] = DIGIT_SHARE / max(1, sum(digits))
    if any(others):
        share[others] = OTHER_SHARE / sum(others)
    return share / share.sum()


def _table(alphabet: str) -> tuple[np.ndarray, int, np.ndarray]:
    rank = np.full(128, -1, np.int64)
    rank[[ord(c) for c in alphabet]] = range(len(alphabet))
    return rank, len(alphabet), -np.log(len(alphabet) * _text_share(alphabet))


#: Per encoding: ranks by character, their number, and the logarithm of how much likelier a character is than in text.
TABLES = {name: _table(a) for name, a in ENCODINGS.items()}
SETS = {name: frozenset(a) for name, a in ENCODINGS.items()}


def encoding_of(piece: str) -> str | None:
    used = set(piece)
    return next((name for name, chars in SETS.items() if used <= chars), None)


def binomial_tail(n: int, k: int, p: float) -> float:
    """The probability of ``k`` or more of ``n``: the bound by relative entropy, 1 below the mean."""
    share = k / n
    if share <= p:
        return 1.0
    away = share * math.log(share / p) + ((1 - share) * math.log((1 - share) / (1 - p)) if share < 1 else 0.0)
    return math.exp(-n * away)


def battery(piece: str) -> tuple[str, float, float, float, float] | None:
    """(encoding, p of uniformity, likelihood, serial correlation, runs), small for random characters; None without an encoding."""
    name = encoding_of(piece)
    if name is None or len(piece) < LEAST_RUN:
        return None
    rank, k, likelier = TABLES[name]
    x = rank[np.frombuffer(piece.encode(), np.uint8)]
    n = len(x)
    counts = np.bincount(x, minlength=k).astype(float)
    chi2 = k / n * float((counts**2).sum()) - n
    excess = n * (1 / PART - 1)
    even = normal_tail((k - 1 + excess - chi2) / math.sqrt(2 * (k - 1) + 4 * excess))
    text = math.exp(-max(0.0, float(counts @ likelier)))
    c = x - x.mean()
    r = abs(float((c[1:] * c[:-1]).sum()) / max(1e-9, float((c * c).sum())))
    serial = normal_tail((ORDERED - r) / math.sqrt((1 - ORDERED**2) / n))
    high = x >= k / 2
    switches = int((high[1:] != high[:-1]).sum())
    runs = max(binomial_tail(n - 1, switches, SWITCH[0]), binomial_tail(n - 1, n - 1 - switches, 1 - SWITCH[1]))
    return name, even, text, serial, runs


def length_class(n: int) -> int:
    return min(CLASSES - 1, int(math.log2(n / LEAST_RUN) * 2))


def p_bin(p: float) -> int:
    """Bins of -log10 p, twenty a unit; a bin's p is its upper end."""
    return min(P_BINS - 1, int(-math.log10(min(1.0, max(p, 1e-300))) * 20))


def weight(c: int) -> float:
    return 2.0 ** (c / 4)


def pieces(run: str) -> list[tuple[int, int]]:
    """The run in one piece, and what the cuts leave of it; each piece once."""
    found = {(0, len(run)): None} | {m.span(): None for cut in CUTS for m in cut.finditer(run)}
    return list(found)


def tested(text: str, base: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, length class, bin of p) of the pieces of what the known shapes leave of each run."""
    taken = sorted((s, e) for s, e, _ in base)
    at = 0
    for m in RUN.finditer(text):
        start, body, end = m.start(), m.end(1), m.end()
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        for s, e in [*takewhile(lambda x: x[0] < end, taken[at:]), (end, end)]:
            lo, hi, start = start, min(s, body), max(start, e)
            if hi - lo < LEAST_RUN:
                continue
            cut = pieces(text[lo:hi])
            scored = [(max(got[1:]) * min(len(cut), 1 + len(CUTS)), i, j) for i, j in cut if (got := battery(text[lo + i : lo + j]))]
            free = np.ones(hi - lo, bool)
            for p, i, j in sorted(scored):
                if free[i:j].all():
                    free[i:j] = False
                    pad = len(m.group(2)) if lo + j == body and s >= end and (j - i + len(m.group(2))) % 4 == 0 else 0
                    yield lo + i, lo + j + pad, length_class(j - i), p_bin(p)


def known(text: str, has_word: bool) -> list[tuple[int, int, str]]:
    found = []
    if has_word:
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_ASSIGN]
    found += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return found


def scan(raw: bytes) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, int, int]]]:
    """Known shapes and tested runs. Most texts have neither a long run nor a word of assignments, and end there."""
    long_run = max(map(len, raw.translate(FOLD).split()), default=0) >= 16
    lower = raw.lower()
    has_word = any(w in lower for w in WORDS)
    if not (long_run or has_word):
        return [], []
    text = raw.decode()
    base = known(text, has_word)
    return base, list(tested(text, base)) if long_run else []


def discovery(counts: dict[tuple[int, int], int]) -> dict[int, int]:
    """The least bin that is a discovery, per length class, from counts by (class, bin)."""
    total = sum(counts.values())
    if not total:
        return {}
    mean = sum(n * weight(c) for (c, _), n in counts.items()) / total
    q = sorted((10 ** (-b / 20) / (weight(c) / mean), n) for (c, b), n in counts.items())
    seen, cut = 0, 0.0
    for i, (value, n) in enumerate(q):
        seen += n
        if (i + 1 == len(q) or q[i + 1][0] > value) and value * total / seen <= FDR:
            cut = value
    return {c: next((b for b in range(P_BINS) if 10 ** (-b / 20) / (weight(c) / mean) <= cut), P_BINS) for c in range(CLASSES)}


def count_runs(docs: DataFrame) -> dict[tuple[int, int], int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for raw in utf8(b.column(0)):
                seen.update((c, p) for _, _, c, p in scan(raw)[1])
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())], ["c", "p", "n"])

    rows = arrow_map(docs.select(F.col("text").cast("string").alias("text")), run, "c int, p int, n long").groupBy("c", "p").agg(F.sum("n").alias("n"))
    return {(r["c"], r["p"]): r["n"] for r in rows.collect()}  # CLASSES x P_BINS at most


def spans_of(raw: bytes, cuts: dict[int, int]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Known shapes, and all spans; by start, then kind."""
    base, runs = scan(raw)
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    base.sort(key=order)
    more = [(s, e, "random") for s, e, c, p in runs if p >= cuts.get(c, P_BINS)]
    return base, sorted(base + more, key=order)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per input row: counts of the known shapes, their digest, and all spans."""
    cuts = discovery(count_runs(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        for b in batches:
            rows = []
            for doc_id, raw in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                base, spans = spans_of(raw, cuts)
                n = Counter(k for _, _, k in base)
                rows.append((doc_id, n["assign"], n["access"], n["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in FOUND.split(", ")])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, FOUND)


def redact(raw: bytes, cuts: dict[int, int]) -> bytes:
    """The text with each group of overlapping spans replaced by ``[kind]`` of its first."""
    _, spans = spans_of(raw, cuts)
    if not spans:
        return raw
    text, out, at = raw.decode(), [], 0
    groups: list[list] = []
    for s, e, k in spans:
        if groups and s < groups[-1][1]:
            groups[-1][1] = max(groups[-1][1], e)
        else:
            groups.append([s, e, k])
    for s, e, k in groups:
        out += [text[at:s], f"[{k}]"]
        at = e
    return "".join([*out, text[at:]]).encode()


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``; secrets in the text are replaced, null stays null."""
    cuts = discovery(count_runs(docs.select(F.col(text_col).alias("text"))))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if t is None else redact(t, cuts).decode() for t in b.column(at).cast(pa.binary()).to_pylist()]
            columns = list(b.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return arrow_map(docs, run, docs.schema)


def op4_secrets(spark, sf_dir):
    return scan_secrets(table(spark, sf_dir, "documents"))
