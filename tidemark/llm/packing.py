"""Packing token streams into windows by non-negative least squares.

A document gives its full windows at once and one tail shorter than a window.
The tails' histogram has ``window - 1`` bins whatever the corpus holds; it is
all that reaches the driver. There, combinations of two or three lengths that
fill a window are enumerated, non-negative least squares solves how often to
repeat each so that the histogram is used up, the counts are rounded down to
what the bins hold, and the residual tails follow each other greedily in one
stream that is cut at window boundaries. Only the last window is padded.

The plan holds a bounded number of rank intervals per length. Each tail gets
its rank among the tails of its length (lengths are salted by document, so
that a length that a third of all documents have is ranked by many tasks) and
looks up its window and offset.

Defined results: a null or empty text is the end id alone; rows with equal or
null ids are packed as documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, table

WINDOW, END_ID = 1024, 0
#: Salts of a length: tails of one length are ranked in so many groups.
SALTS = 256
#: Rows are encoded together until they hold so many bytes or are so many: fewer distinct segments in all.
CHUNK_BYTES, CHUNK_ROWS = 8 << 20, 8192
#: Bytes of a segment that the library encodes.
LONG = 4096
#: White space of Python's that some pattern engines don't take for white space, or the reverse.
ODD_SPACE = re.compile(r"[^\S \n\t\r]")
#: Kinds of bytes: 1 white space, 2 those that odd white space begins with.
KIND = np.zeros(256, np.uint8)
KIND[[chr(c).encode()[0] for c in range(0x3100) if ODD_SPACE.match(chr(c))]] = 2
KIND[list(b" \n\t\r")] = 1


class SegmentEncoder:
    """Token ids of a byte-level BPE file, as bytes of little-endian unsigned 32-bit ids.

    The pattern of this kind of model never puts white space after another
    character into one token, so that the ids of a text are those of its
    segments (white space and what follows it) one after another. Texts are
    encoded many at a time and each distinct segment once; finding the distinct
    ones and putting their ids in a row is left to Arrow. Texts with special
    strings or unusual white space are encoded whole by the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.fast = _same_ranks(self.tok)
        self.lengths = np.array([len(self.fast.decode_single_token_bytes(i)) for i in range(self.fast.max_token_value + 1)])

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        return self.encode(pa.array(texts, pa.string()))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text; null as empty. Arrow finds the distinct segments and puts their ids in a row."""
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        offsets, data = _parts(texts)
        kinds = KIND[data]
        odd = {int(i) for i in np.searchsorted(offsets, np.flatnonzero(kinds == 2), side="right") - 1}
        raws = {i: texts[i].as_py() for i in odd}
        odd = {i for i, raw in raws.items() if ODD_SPACE.search(raw.decode())}
        whole = data.tobytes()
        for special in self.special:
            at = whole.find(special)
            while at >= 0:
                odd.add(int(np.searchsorted(offsets, at, side="right")) - 1)
                at = whole.find(special, at + 1)
        if odd:
            apart = np.zeros(len(texts), bool)
            apart[list(odd)] = True
            plain = iter(self._plain(*_parts(texts.filter(pa.array(~apart)))))
            return [self.whole(texts[i].as_py().decode()) if one else next(plain) for i, one in enumerate(apart.tolist())]
        return self._plain(offsets, data, kinds)

    def _plain(self, offsets: np.ndarray, data: np.ndarray, kinds: np.ndarray | None = None) -> list[bytes]:
        if not len(data):
            return [b""] * (len(offsets) - 1)
        white = (KIND[data] if kinds is None else kinds) == 1
        first = np.empty(len(data), bool)  # a segment begins with a text or a run of white space
        first[1:] = white[1:] & ~white[:-1]
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(first)
        ends = pa.py_buffer(np.append(starts, len(data)))
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, ends, pa.py_buffer(data)]).dictionary_encode()
        at, raw = _parts(self.segments(coded.dictionary).take(coded.indices))
        cuts, raw = at[np.searchsorted(starts, offsets)].tolist(), memoryview(raw)
        return [bytes(raw[i:j]) for i, j in zip(cuts, cuts[1:])]

    def segments(self, distinct: pa.Array) -> pa.Array:
        """Ids of segments, encoded in one go: behind another character, each starts a token of its own if it starts with white space.

        A line feed is put before those that don't, and its token taken away.
        Those that end in white space go to the library, and long ones, as
        tiktoken's pattern engine stops the worker at a million spaces.
        """
        at, data = _parts(distinct)
        if (apart := (KIND[data[at[1:] - 1]] == 1) | (np.diff(at) > LONG)).any():
            plain, rest = self.segments(distinct.filter(pa.array(~apart))), distinct.filter(pa.array(apart))
            place = np.empty(len(apart), np.int64)
            place[~apart], place[apart] = np.arange(len(plain)), np.arange(len(plain), len(apart))
            return pa.concat_arrays([plain, pa.array([self.whole(s.decode()) for s in rest.to_pylist()], pa.large_binary())]).take(pa.array(place))
        bare = KIND[data[at[:-1]]] != 1
        spaced = np.insert(data, at[:-1][bare], ord("\n"))
        ids = np.array(self.fast.encode_ordinary(spaced.tobytes().decode()), "<u4")
        token_ends = np.cumsum(self.lengths[ids])
        ends = np.searchsorted(token_ends, at[1:] + np.cumsum(bare)) + 1  # tokens up to the end of each segment
        feeds = (np.append(0, ends[:-1]) if len(ends) else ends)[bare]
        raw = np.delete(ids, feeds)
        cuts = np.append(0, ends - np.cumsum(bare))
        return pa.Array.from_buffers(pa.large_binary(), len(distinct), [None, pa.py_buffer(4 * cuts), pa.py_buffer(raw)])


def _parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and bytes of large binary values without nulls."""
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return at - at[0], np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]


def _same_ranks(tok):
    """The same vocabulary for tiktoken, whose merging of a segment is several times as fast.

    Ids must follow the order of merging, else the two would differ.
    """
    import json

    import public_tokenizers
    import tiktoken

    model = json.loads(tok.to_str())["model"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in printable)}
    special = {t.content for t in tok.get_added_tokens_decoder().values()}
    ranks = {bytes(char[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if any(model["vocab"][x] >= model["vocab"][y] for x, y in zip(made, made[1:])):
        raise ValueError("ids don't follow the order of merging")
    return tiktoken.Encoding("segments", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def encoder(path: str) -> SegmentEncoder:
    return SegmentEncoder(path)


def combinations_filling(window: int) -> np.ndarray:
    """All multisets of two or three lengths with the window as their sum; a pair has length 0 in front."""
    a, b = np.meshgrid(np.arange(window // 3 + 1), np.arange(window // 2 + 1), indexing="ij")
    c = window - a - b
    ok = (a <= b) & (b <= c) & (b > 0) & (c < window)
    return np.stack([a[ok], b[ok], c[ok]], axis=1)


def nnls_counts(histogram: np.ndarray, combos: np.ndarray, steps: int = 200) -> np.ndarray:
    """How often to repeat each combination, x >= 0 with the least ``|A x - histogram|``.

    A column of A has a one for each member, so that products with A and its
    transpose are sums over three members; accelerated projected gradient.
    """
    n, rate = len(histogram), 1.0 / (3.0 * np.bincount(combos.ravel(), minlength=len(histogram))[1:].max())
    use = combos > 0
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        used = np.bincount(combos[use], (np.broadcast_to(y[:, None], combos.shape))[use], minlength=n)
        grad = ((used - histogram)[combos] * use).sum(axis=1)
        after, t2 = np.maximum(0, y - rate * grad), (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = after + (t - 1) / t2 * (after - x), after, t2
    return x


def make_plan(counts: dict[int, int], window: int) -> dict:
    """Rank intervals per length: in an interval, rank k stands in window ``first + (k - low) // per`` at one of ``per`` offsets.

    Ranks beyond a length's intervals are residual: the k-th of them starts at
    ``start + k * length`` of the stream, whose windows follow the planned ones.
    """
    left = np.zeros(window + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    total = left.copy()
    combos = combinations_filling(window)
    combos = combos[((left[combos] > 0) | (combos == 0)).all(axis=1)]
    intervals: dict[int, list[tuple[int, int, int, tuple[int, ...]]]] = {}
    first = 0
    if len(combos):
        x = nnls_counts(left.astype(float), combos)
        # rounded down by weight; then what rounding left, again by weight
        for share in (np.floor(x), np.full(len(x), np.inf)):
            for i in np.argsort(-x, kind="stable"):
                members = [int(m) for m in combos[i] if m]
                times = {m: members.count(m) for m in members}
                n = int(min(share[i], *(left[m] // k for m, k in times.items())))
                if n <= 0:
                    continue
                at = 0
                for m, k in sorted(times.items()):
                    low = int(total[m] - left[m])
                    intervals.setdefault(m, []).append((low, low + n * k, first, tuple(at + j * m for j in range(k))))
                    left[m] -= n * k
                    at += k * m
                first += n
    start, residual = 0, {}
    for length in range(window - 1, 0, -1):
        residual[length] = (int(total[length] - left[length]), start)
        start += length * int(left[length])
    return {"window": window, "intervals": intervals, "residual": residual, "first": first, "windows": first + -(-start // window)}


def place(plan: dict, length: int, rank: int) -> list[tuple[int, int, int, int]]:
    """(start in the tail, length, window, offset) of each piece of a tail; at most two pieces."""
    low, start = plan["residual"][length]
    if rank >= low:
        at, window = start + (rank - low) * length, plan["window"]
        w, off = divmod(at, window)
        one = min(length, window - off)
        return [(0, one, plan["first"] + w, off)] + ([(one, length - one, plan["first"] + w + 1, 0)] if one < length else [])
    spans = plan["intervals"][length]
    i = int(np.searchsorted([s[0] for s in spans], rank, side="right")) - 1
    lo, _, first, offsets = spans[i]
    k = rank - lo
    return [(0, length, first + k // len(offsets), offsets[k % len(offsets)])]


TAILS = "doc_id long, doc_tokens long, crcs array<long>, tail int, tail_crc long, ids binary, salt int"


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, pa.Array]]:
    """Ids and texts of several batches at a time."""
    held: list[pa.RecordBatch] = []
    size = rows = 0
    for b in batches:
        held.append(b)
        size, rows = size + b.nbytes, rows + b.num_rows
        if size >= CHUNK_BYTES or rows >= CHUNK_ROWS:
            yield _joined(held)
            held, size, rows = [], 0, 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple[list, pa.Array]:
    ids = [i for b in held for i in b.column(0).to_pylist()]
    return ids, pa.concat_arrays([b.column(1).cast(pa.large_binary()) for b in held])


def tokenize(docs: DataFrame, path: str, window: int, end_id: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, step, end, row = encoder(path), 4 * window, np.array([end_id], "<u4").tobytes(), 0
        for ids, texts in chunks(batches):
            rows = []
            for doc_id, raw in zip(ids, enc.encode(texts)):
                raw += end
                full = len(raw) // step
                crcs = [zlib.crc32(raw[i * step : i * step + step]) for i in range(full)]
                tail = raw[full * step :]
                rows.append((doc_id, len(raw) // 4, crcs, len(tail) // 4, zlib.crc32(tail), tail, (zlib.crc32(b"%d %d" % (doc_id or 0, zlib.crc32(tail))) + row) % SALTS))
                row += 1  # equal rows are dealt, too
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.binary(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in TAILS.split(", ")])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(slim, run, TAILS)


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row per piece.

    Windows 0 to n-1 are the planned ones, the residual stream's, then the full
    windows. ``offset`` is gapless within a window.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    tails = scratch.keep(tokenize(docs, path, window, end_id))
    groups = tails.groupBy("tail", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("crcs")).alias("full"))
    groups = scratch.keep(groups)
    lengths = groups.groupBy("tail").agg(F.sum("n").alias("n"), F.sum("full").alias("full")).collect()  # one row per length
    plan = make_plan({r["tail"]: r["n"] for r in lengths if r["tail"]}, window)
    before = 0
    base = {}
    for r in sorted(lengths, key=lambda r: r["tail"]):
        base[r["tail"]] = plan["windows"] + before
        before += r["full"]
    below = Window.partitionBy("tail").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = groups.select("tail", "salt", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("n0"), F.coalesce(F.sum("full").over(below), F.lit(0)).alias("full0"))
    own = Window.partitionBy("tail", "salt").orderBy("doc_id", "tail_crc", "doc_tokens")
    ranked = tails.withColumns(
        {
            "n1": F.row_number().over(own) - 1,
            "full1": F.sum(F.size("crcs")).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.size("crcs"),
        }
    ).join(sums, ["tail", "salt"])
    ranked = ranked.select("doc_id", "doc_tokens", "crcs", "tail", "tail_crc", "ids", (F.col("n0") + F.col("n1")).alias("rank"), (F.col("full0") + F.col("full1")).alias("full_rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for b in batches:
            rows = []
            for r in b.to_pylist():
                at = 0
                for i, crc in enumerate(r["crcs"]):
                    rows.append((r["doc_id"], at, window, crc, r["doc_tokens"], base[r["tail"]] + r["full_rank"] + i, 0))
                    at += window
                if r["tail"]:
                    pieces = place(plan, r["tail"], r["rank"])
                    for lo, n, seq, off in pieces:
                        crc = r["tail_crc"] if len(pieces) == 1 else zlib.crc32(r["ids"][4 * lo : 4 * (lo + n)])
                        rows.append((r["doc_id"], at + lo, n, crc, r["doc_tokens"], seq, off))
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    return arrow_map(ranked, run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op5_packing(spark, sf_dir):
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
