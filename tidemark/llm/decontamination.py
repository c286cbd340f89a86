"""Benchmark decontamination by template windows.

Texts become templates: numbers, names and units give way to typed
placeholders, other words are lower-cased. Windows of ``WIDTH`` template tokens
of documents are hash-joined with those of the benchmark's items. A document
holds an item if one place of it has ``SHARE`` of the item's windows there and
the slots are consistent: where the item has one value in several slots, the
document must have one value there too, so that re-parameterised questions are
caught and look-alikes with unrelated values are not. A place is a distance
between a document's window and the item's: one and the same for a copy word by
word, or within a stretch of the item's length (``LEAST_STRETCH`` at least) if
words were put in or left out; the best place counts.

A capital at the start of a sentence may be a name or not, so windows with such
a word exist twice, with the word and with a name's placeholder.

Before the join, document windows pass a bitmap of ``BITS`` bits of the
benchmark's window hashes. Its size is fixed; it lets a few windows through
that the join then drops, and never stops one that would join. Documents and
items first meet through the windows of an item that are rarest in the
benchmark, as many as a holder of the item can't all lack; a stock phrase of
many items makes no pairs by itself.

Defined results: null or empty texts hold nothing, empty tables give no rows;
items with fewer tokens than a window have one window of their own length;
items whose windows all have too many slots for a template are looked for word
by word, slots included, and must be there with all their windows; items under
``LEAST`` tokens can't be told from chance and match nothing. Rows are told
apart by id and text: those equal in both count once, a null id is an id. Only
ids and texts are read, so that further columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW_KEY, Scratch, arrow_map, row_key, table, utf8

WIDTH, LEAST, LITERALS, SHARE, CONSISTENT = 8, 4, 4, 0.4, 0.75
BITS = 1 << 22
LEAST_STRETCH = 16
#: Added to the width of windows of words, not of templates.
VERBATIM = 100
MEMO = 400_000
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:%|st|nd|rd|th)?$")
#: What surrounds a word, but for signs in front of a digit; the end of a sentence.
EDGES = re.compile(r"^(?:(?![$€£+-]?\d)[\W_])+|[\W_]+$")
SENTENCE_END = re.compile(r"[.?!:]\W*$")
QUANTITY = re.compile(r"[$€£]?\d[\d.,]*[^\W\d_]{1,4}$")
# Words that are units behind a number.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yard yards mile miles mg g gram grams kg kilogram kilograms oz ounce ounces lb lbs pound pounds "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "percent dollar dollars cent cents euro euros degree degrees mph kmh watt watts volt volts meter meters metre metres".split()
)
EMPTY, CAPITAL, NUM, UNIT, END = 1, 2, 4, 8, 16
PLACE = {k: np.uint64(xxhash.xxh64_intdigest(b"\0" + k.encode(), 1)) for k in ("num", "name", "unit")}
FACTORS = np.array([pow(6_364_136_223_846_793_005, j, 1 << 64) for j in range(WIDTH)], np.uint64)


class Templates:
    """What a worker remembers about words as they stand between white space."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.words: list[str] = []
        self.hashes, self.flags = np.zeros(1024, np.uint64), np.zeros(1024, np.uint8)

    def learn(self, word: str) -> None:
        core, flags, plain = word, 0, word.isalpha()
        if not plain and word[-1] in ".,;:?!" and word[:-1].isalpha():  # most words need no pattern
            core, flags, plain = word[:-1], END * (word[-1] in ".?!:"), True
        if not plain:
            core, flags = EDGES.sub("", word), END * bool(SENTENCE_END.search(word))
        if not plain and not any(map(str.isalnum, core)):
            flags |= EMPTY
        elif not plain and (NUMBER.match(core) or QUANTITY.match(core)):
            flags |= NUM
        else:
            flags |= CAPITAL * (core[0].isupper() and not core.isupper()) | UNIT * (core.lower() in UNITS)
        i = self.index[word] = len(self.words)
        self.words.append(core)
        if i == len(self.hashes):
            self.hashes, self.flags = np.resize(self.hashes, 2 * i), np.resize(self.flags, 2 * i)
        self.hashes[i], self.flags[i] = xxhash.xxh64_intdigest(core.lower().encode(), 1), flags

    def read(self, texts: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """Of all texts one after another: word numbers, number of the text, and two readings of the words as template hashes and whether a slot.

        The readings differ in capitals at the start of a sentence: words in the first, names in the second.
        """
        if len(self.words) > MEMO:
            self.__init__()
        split = [t.split() for t in texts]
        words = list(chain.from_iterable(split))
        for new in set(words) - self.index.keys():
            self.learn(new)
        ids = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        text = np.repeat(np.arange(len(texts)), [len(w) for w in split])
        flags = self.flags[ids]
        first = np.ones(len(ids), bool)
        first[1:] = (text[1:] != text[:-1]) | (flags[:-1] & END > 0)
        keep = flags & EMPTY == 0
        ids, text, flags, first = ids[keep], text[keep], flags[keep], first[keep]
        number = flags & NUM > 0
        unit = flags & UNIT > 0
        unit[1:] &= number[:-1] & (text[1:] == text[:-1])
        unit[:1] = False
        capital = (flags & CAPITAL > 0) & ~unit
        readings = []
        for name in (capital & ~first, capital):
            h = self.hashes[ids]
            for k, slot in (("num", number), ("unit", unit), ("name", name)):
                h[slot] = PLACE[k]
            readings.append((h, number | name | unit))
        return ids, text, readings


def window_hashes(h: np.ndarray, slot: np.ndarray, text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows inside one text with enough words that aren't slots."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total += h[j : j + n] * FACTORS[j]
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(32)
    slots = np.concatenate(([0], np.cumsum(slot)))
    ok = (text[:n] == text[width - 1 :]) & (slots[width:] - slots[:-width] <= width - min(LITERALS, width))
    at = np.flatnonzero(ok)
    return at, total[at]


WINDOWS = f"key {ROW_KEY}, width int, hash long, pos int, values array<string>"


def _rows(keys: pa.Array, text: np.ndarray, width: int, at: np.ndarray, hashes: np.ndarray, first: np.ndarray, words: list[str], word: np.ndarray, slot: np.ndarray) -> pa.RecordBatch:
    size = width % VERBATIM
    values = [[words[w].lower() for w in word[i : i + size][slot[i : i + size]].tolist()] for i in at.tolist()]
    cols = [keys.take(pa.array(text[at])), pa.array(np.full(len(at), width, np.int32)), pa.array(hashes.view(np.int64)), pa.array((at - first[text[at]]).astype(np.int32)), pa.array(values, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(cols, ["key", "width", "hash", "pos", "values"])


_templates = Templates()


def verbatim_windows(hashes: np.ndarray, text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of all windows of words, slots with their values."""
    return window_hashes(hashes + np.uint64(VERBATIM), np.zeros(len(hashes), bool), text, width)


def both_readings(readings: list[tuple[np.ndarray, np.ndarray]], text: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, hashes, slots) of the windows of the first reading, and of those of the second that have another hash."""
    differs = np.concatenate(([0], np.cumsum(readings[0][0] != readings[1][0])))
    for i, (h, slot) in enumerate(readings):
        at, hashes = window_hashes(h, slot, text, width)
        if i:
            new = differs[at + width] > differs[at]
            at, hashes = at[new], hashes[new]
        yield at, hashes, slot


def item_windows(benchmark: DataFrame) -> DataFrame:
    """Every window of every item; short items have one of their own length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            word, text, readings = _templates.read([t.decode() for t in utf8(b.column(1))])
            size = np.bincount(text, minlength=b.num_rows)
            first = np.cumsum(size) - size
            bare = size >= LEAST
            for width in range(LEAST, WIDTH + 1):
                own = lambda at, width=width: size[text[at]] >= WIDTH if width == WIDTH else size[text[at]] == width
                for at, hashes, slot in both_readings(readings, text, width):
                    use = own(at)
                    bare[text[at[use]]] = False
                    yield _rows(b.column(0), text, width, at[use], hashes[use], first, _templates.words, word, slot)
            for width in range(LEAST, WIDTH + 1):
                at, hashes = verbatim_windows(_templates.hashes[word], text, width)
                use = bare[text[at]] & (size[text[at]] >= WIDTH if width == WIDTH else size[text[at]] == width)
                yield _rows(b.column(0), text, width + VERBATIM, at[use], hashes[use], first, _templates.words, word, np.zeros(len(word), bool))

    return arrow_map(benchmark.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).select(row_key("id").alias("key"), "text"), run, WINDOWS)


def document_windows(docs: DataFrame, id_col: str, widths: list[int], bitmap: np.ndarray) -> DataFrame:
    """Windows of documents that pass the bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap))  # BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).astype(bool)
        for b in batches:
            word, text, readings = _templates.read([t.decode() for t in utf8(b.column(1))])
            size = np.bincount(text, minlength=b.num_rows)
            first = np.cumsum(size) - size
            for width in widths:
                whole = [(*verbatim_windows(_templates.hashes[word], text, width - VERBATIM), np.zeros(len(word), bool))] if width >= VERBATIM else both_readings(readings, text, width)
                for at, hashes, slot in whole:
                    ok = bits[hashes & np.uint64(BITS - 1)]
                    yield _rows(b.column(0), text, width, at[ok], hashes[ok], first, _templates.words, word, slot)

    slim = docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text")).select(row_key("id").alias("key"), "text")
    return arrow_map(slim, run, WINDOWS)


def bitmap_of(items: DataFrame) -> np.ndarray:
    """The bits of ``items.hash``, from a row for each 64 of them: ``BITS`` / 64 rows at most."""
    at = F.col("hash").bitwiseAND(F.lit(BITS - 1))
    words = items.select(F.shiftright(at, 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(hash & 63 as int))").alias("bit"))
    bits = np.zeros(BITS // 64, np.int64)
    for r in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
        bits[r["word"]] = r["bits"]
    return np.unpackbits(bits.view(np.uint8), bitorder="little").astype(bool)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, n_windows, matched, share, consistency, exact): one row per document and item that it holds.

    All but the first two tell about the document's best place for the item.
    """
    leaks = _leaks(docs, benchmark, id_col, share)
    return leaks.select(F.col("key.id").alias("doc_id"), F.col("item.id").alias("item_id"), "n_windows", "matched", "share", "consistency", "exact")


def _leaks(docs: DataFrame, benchmark: DataFrame, id_col: str, share: float = SHARE) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "templates")
    items = scratch.keep(item_windows(benchmark).distinct())
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # 2 * (WIDTH - LEAST + 1) at most
    sizes = items.groupBy(F.col("key").alias("item")).agg(F.countDistinct("pos").alias("n_windows"), F.when(F.max("width") > VERBATIM, 1.0).otherwise(share).alias("least"))
    needed = F.ceil(F.col("least") * F.col("n_windows") - 1e-9)
    # places of an item by how many items have their windows; one of these has to be met
    common = items.groupBy("width", "hash").agg(F.countDistinct("key").alias("items"))
    places = items.join(common, ["width", "hash"]).groupBy(F.col("key").alias("item"), "pos").agg(F.max("items").alias("items"))
    rare = places.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy("items", "pos"))).join(sizes, "item").where(F.col("rank") <= F.col("n_windows") - needed + 1)
    lists = items.select(F.col("key").alias("item"), "width", "hash", F.col("pos").alias("item_pos"), F.col("values").alias("a"))
    probes = lists.join(rare.select("item", F.col("pos").alias("item_pos")), ["item", "item_pos"]).select("width", "hash", "item").distinct()

    own = scratch.keep(document_windows(docs, id_col, widths, bitmap_of(items)))
    met = own.select("key", "width", "hash").distinct().join(probes, ["width", "hash"]).select("key", "item").distinct()
    hits = met.join(own.withColumnRenamed("values", "b"), "key").join(lists, ["item", "width", "hash"]).join(sizes, "item")
    away, stretch = F.col("pos") - F.col("item_pos"), F.greatest(F.lit(LEAST_STRETCH), F.col("n_windows") + WIDTH)
    three = F.array(F.struct(F.lit(0).alias("kind"), away.cast("long").alias("at")), *(F.struct(F.lit(k).alias("kind"), F.floor((away + half) / stretch).alias("at")) for k, half in ((1, F.lit(0)), (2, stretch / 2))))
    hits = hits.select("key", "item", "n_windows", "least", "item_pos", F.arrays_zip("a", "b").alias("slots"), F.explode(three).alias("place"))
    # an item's length bounds what is collected
    found = hits.groupBy("key", "item", "n_windows", "least", "place").agg(F.countDistinct("item_pos").alias("matched"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    found = found.withColumn("share", F.col("matched") / F.col("n_windows"))
    values = F.size(F.array_distinct(F.transform("slots", lambda s: s["a"])))
    found = found.withColumn("consistency", F.when(F.size("slots") == 0, 1.0).otherwise(values / F.size("slots")))
    found = found.withColumn("exact", F.forall("slots", lambda s: s["a"] == s["b"]))
    found = found.where((F.col("share") >= F.col("least")) & (F.col("consistency") >= CONSISTENT))
    best = found.groupBy("key", "item").agg(F.max(F.struct("exact", "consistency", "share", "matched", "n_windows")).alias("x"))
    return best.select("key", "item", "x.n_windows", "x.matched", "x.share", "x.consistency", "x.exact")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item; null ids and repeated ids are told apart by their texts."""
    name = next(f"leak_key{i}" for i in range(len(docs.columns) + 1) if f"leak_key{i}" not in docs.columns)
    leaks = _leaks(docs, benchmark, "doc_id").select(F.col("key").alias(name)).distinct()
    keyed = docs.withColumn(name, row_key("doc_id"))
    same = [F.col(f"d.{name}.{f}").eqNullSafe(F.col(f"l.{name}.{f}")) for f in ("id", "text", "check")]
    return keyed.alias("d").join(leaks.alias("l"), same[0] & same[1] & same[2], "left_anti").select(*(F.col(f"d.`{c}`") for c in docs.columns))


def op2_decontamination(spark, sf_dir):
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
