"""Media columns: texts as PNG images in a binary column, read back and hashed.

A payload of 192-byte rows is an 8-bit RGB image 64 pixels wide. Writing makes
the signature, IHDR, one IDAT of zlib-compressed filtered rows, and IEND, each
chunk with its CRC-32. Reading walks the chunks, tests every checksum,
inflates, and undoes the row filters with numpy (all five, for any 8-bit grey
or colour image without interlacing). The feature is a hash of the image's
low-frequency cosine coefficients.

Defined results: a null or empty text is one row of 192 spaces; equal texts
have equal values; a damaged image raises ``PngError`` in ``read_png`` and
gives null features in ``image_features``; rows of one byte column are
independent, so a huge image costs its own task only.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, table, utf8

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples a pixel by colour type.
SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}
ROW = 192
#: Sides of the reduced image and of the block of coefficients that is hashed.
SIDE, LOW = 32, 8
_k, _x = np.meshgrid(np.arange(LOW), np.arange(SIDE), indexing="ij")
#: The first rows of the orthogonal cosine transform.
COSINE = np.cos(np.pi * (2 * _x + 1) * _k / (2 * SIDE)) * np.where(_k == 0, np.sqrt(1 / SIDE), np.sqrt(2 / SIDE))


class PngError(ValueError):
    pass


def pad(text: bytes, row: int = ROW) -> bytes:
    """Spaces up to a positive multiple of ``row``."""
    return text.ljust(max(1, -(-len(text) // row)) * row, b" ")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(payload: bytes, level: int = 1) -> bytes:
    """An RGB image 64 pixels wide; the payload's length is a multiple of 192. Rows are stored unfiltered: text has no gradients."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    filtered = np.zeros((len(rows), ROW + 1), np.uint8)
    filtered[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW // 3, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), level)) + _chunk(b"IEND", b"")


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, content) of each chunk up to IEND; raises on a wrong checksum or length."""
    if data[:8] != SIGNATURE:
        raise PngError("not a PNG signature")
    at = 8
    while True:
        if at + 12 > len(data):
            raise PngError("it ends inside a chunk")
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body, crc = data[at + 8 : at + 8 + n], data[at + 8 + n : at + 12 + n]
        if len(crc) < 4 or zlib.crc32(body, zlib.crc32(kind)) != int.from_bytes(crc, "big"):
            raise PngError(f"wrong checksum of chunk {kind!r}")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + n


def unfilter(rows: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Undoes the row filters; ``step`` is the bytes of a pixel. Runs of rows that only look up are summed at once."""
    out, n, at = np.zeros_like(rows), len(rows), 0
    above = np.zeros(rows.shape[1], np.uint8)
    while at < n:
        kind, end = kinds[at], at + 1
        if kind in (0, 1, 2):
            while end < n and kinds[end] == kind:
                end += 1
        block = rows[at:end]
        if kind == 0:
            out[at:end] = block
        elif kind == 1:
            out[at:end] = np.cumsum(block.reshape(end - at, -1, step), axis=1, dtype=np.uint8).reshape(end - at, -1)
        elif kind == 2:
            out[at:end] = np.cumsum(np.vstack([above, block]), axis=0, dtype=np.uint8)[1:]
        elif kind in (3, 4):
            up = above.reshape(-1, step).astype(np.int32)
            new, left, corner = np.zeros_like(up), np.zeros(step, np.int32), np.zeros(step, np.int32)
            for i, x in enumerate(block.reshape(-1, step).astype(np.int32)):
                if kind == 3:
                    guess = (left + up[i]) // 2
                else:
                    p = left + up[i] - corner
                    a, b, c = abs(p - left), abs(p - up[i]), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up[i], corner))
                left, corner = (x + guess) & 255, up[i]
                new[i] = left
            out[at] = new.ravel().astype(np.uint8)
        else:
            raise PngError(f"row filter {kind}")
        above, at = out[end - 1], end
    return out


def read_png(data: bytes) -> np.ndarray:
    """Height x width x samples of an 8-bit image."""
    head, body = None, []
    for kind, content in chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", content)
        elif kind == b"IDAT":
            body.append(content)
    if head is None or head[2] != 8 or head[3] not in SAMPLES or any(head[4:]):
        raise PngError(f"unsupported header {head}")
    width, height, step = head[0], head[1], SAMPLES[head[3]]
    try:
        raw = zlib.decompress(b"".join(body))
    except zlib.error as e:
        raise PngError(str(e)) from e
    if len(raw) != height * (width * step + 1):
        raise PngError("wrong number of samples")
    rows = np.frombuffer(raw, np.uint8).reshape(height, -1)
    return unfilter(rows[:, 1:], rows[:, 0], step).reshape(height, width, step)


def _cells(n: int) -> np.ndarray:
    """Where the cells of a reduced side begin; short sides repeat samples."""
    return np.arange(SIDE) * n // SIDE


def cosine_hash(image: np.ndarray) -> str:
    """64 bits: which low-frequency coefficients of the reduced grey image exceed their median."""
    grey = image.sum(axis=2, dtype=np.uint32)
    r, c = _cells(len(grey)), _cells(grey.shape[1])
    sums = np.add.reduceat(np.add.reduceat(grey, r, axis=0, dtype=np.float64), c, axis=1)
    high, wide = (np.maximum(1, np.diff(np.append(x, n))) for x, n in ((r, len(grey)), (c, grey.shape[1])))
    low = (COSINE @ (sums / high[:, None] / wide) @ COSINE.T).ravel().round(6)
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def image_features(docs: DataFrame, media_col: str) -> DataFrame:
    """Adds ``height``, ``width``, ``feature`` of the images in a binary column; null where one is null or damaged."""

    @F.pandas_udf("height int, width int, feature string")
    def features(media):
        import pandas as pd

        rows = []
        for m in media:
            try:
                image = read_png(m)
                rows.append((*image.shape[:2], cosine_hash(image)))
            except (PngError, TypeError):
                rows.append((None, None, None))
        return pd.DataFrame(rows, columns=["height", "width", "feature"]).astype({"height": "Int32", "width": "Int32"})

    return docs.select("*", features(F.col(media_col)).alias("image_features"))


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_media(docs: DataFrame, keep_media: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``media`` (the PNG, if ``keep_media``), figures of the payload as read back, and the feature."""
    names = [x.split()[0] for x in STORED.split(", ")] + ["media"] * keep_media
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.binary()] * keep_media]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                media = write_png(pad(text))
                image = read_png(media)
                back = image.tobytes()
                row = (doc_id, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(image))
                rows.append(row + (media,) * keep_media)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(slim, run, STORED + ", media binary" * keep_media)


def op10_media(spark, sf_dir):
    return store_media(table(spark, sf_dir, "documents"), keep_media=False)
