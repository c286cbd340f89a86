"""SimHash near-duplicates through an inverted index of fingerprint bytes.

Two 64-bit fingerprints that differ in at most ``max_bits`` (0 to 2) bits agree
in at least ``8 - max_bits`` of their eight byte positions. A posting list of
one byte position holds 1/256 of all fingerprints, so lists of a position are
kept within lists of others: the eight positions form four groups of two, at
most two groups can differ, and every pair shall meet in one of the six lists
keyed by the bytes of two groups. Within such a list a fingerprint posts the
bytes of the four open positions; the positions that a pair shares are tallied,
pairs below the guaranteed count go, and the rest is verified by the bits that
differ.

A list with more than ``LIST_MAX`` members would give a quadratic number of
pairs. There every fingerprint files itself under itself and under the 32
fingerprints one bit away in the groups that the key leaves open; two
fingerprints share such an entry if and only if they differ in at most two
bits (for ``max_bits`` 1, one of the two entries is the fingerprint itself), so
a star around the smallest member of each entry connects the same components
with a number of links in proportion to the members.

Defined results: a null or empty text has fingerprint zero and links like any
other; copies share a fingerprint and therefore a component; rows with a null
id stay, and the component's id is the smallest id that is not null (null if
there is none); rows that repeat stay, each as a row; an empty table gives no
rows. Only ids and texts are read, so that further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations, groupby, islice, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW_KEY, Scratch, arrow_map, row_key, table, utf8

#: A list with more members than this gives fewer star links than pairs.
LIST_MAX = 64
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15


def shingle_hashes(words: list[bytes], k: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of the space-joined ``k``-word shingles, repeats included, in chunks."""
    h = xxhash.xxh64_intdigest
    if len(words) <= k:
        yield np.array([h(b" ".join(words), seed)], np.uint64)
        return
    rest = map(b" ".join, zip(*(islice(words, i, None) for i in range(k))))
    while len(got := np.fromiter(map(h, islice(rest, CHUNK), repeat(seed)), np.uint64)):
        yield got


def fingerprint(text: bytes, k: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of a text; a bit is 1 if set in over half the shingles' hashes."""
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII white-space characters
    if not words:
        return 0
    n, ones = 0, np.zeros(64, np.int64)
    for hashes in shingle_hashes(words, k, seed):
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)
        for at in range(0, len(bits), 255):  # as many as a byte can count
            ones += bits[at : at + 255].sum(axis=0, dtype=np.uint8)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, k: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per document, fp holding the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, k, seed) for t in utf8(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(slim, run, "doc_id long, fp long")


def group_of(fp: Column, g: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * g).bitwiseAND(F.lit(0xFFFF))


#: The lists' keys: two of the four groups of two byte positions.
PAIRS = list(combinations(range(4), 2))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(fps: DataFrame, scratch: Scratch, max_bits: int = 2) -> DataFrame:
    """(u, v), u < v: links that connect exactly the distinct values of ``fps.fp`` within ``max_bits``."""
    if not 0 <= max_bits <= 2:
        raise ValueError("two byte groups can hold at most two differing bits")
    lists = F.array(*(F.struct(F.lit(i).alias("pair"), (F.shiftleft(group_of(F.col("fp"), a), 16) + group_of(F.col("fp"), b)).alias("key")) for i, (a, b) in enumerate(PAIRS)))
    postings = scratch.keep(fps.select("fp", F.explode(lists).alias("e")).select("e.pair", "e.key", "fp"))
    sizes = postings.groupBy("pair", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    listed = scratch.keep(postings.join(sizes, ["pair", "key"]))
    cold, hot = listed.where(F.col("n") <= LIST_MAX), listed.where(F.col("n") > LIST_MAX)
    open_positions = F.lit(None).cast("array<int>")
    for i, kept in enumerate(PAIRS):
        open_positions = F.when(F.col("pair") == i, F.array(*(F.lit(2 * g + j) for g in range(4) if g not in kept for j in range(2)))).otherwise(open_positions)
    byte = F.expr("cast(shiftrightunsigned(fp, 8 * position) & 255 as int)").alias("byte")
    posted = cold.select("pair", "key", "fp", F.explode(open_positions).alias("position")).select("pair", "key", "position", byte, "fp")
    shared = posted.withColumnRenamed("fp", "u").join(posted.withColumnRenamed("fp", "v"), ["pair", "key", "position", "byte"]).where("u < v")
    tally = shared.groupBy("pair", "u", "v").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= 4 - max_bits)
    near = tally.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits).select("u", "v")
    masks = F.lit(None).cast("array<long>")
    for i, kept in enumerate(PAIRS):
        open_bits = [_signed(1 << (16 * g + j)) for g in range(4) if g not in kept for j in range(16)]
        masks = F.when(F.col("pair") == i, F.array(*map(F.lit, [0, *open_bits]))).otherwise(masks)
    if max_bits == 2:
        entry = F.col("fp").bitwiseXOR(F.col("mask"))
        filed = hot.select("fp", F.explode(masks).alias("mask")).select(entry.alias("entry"), "fp").distinct()
    else:  # entries pair each fingerprint with one neighbour, so that a shared entry means one bit at most
        low = F.least(F.col("fp"), F.col("fp").bitwiseXOR(F.col("mask")))
        use = masks if max_bits else F.array(F.lit(0))
        filed = hot.select("fp", F.explode(use).alias("mask")).select(low.alias("low"), "mask", "fp").distinct()
        filed = filed.select(F.struct("low", "mask").alias("entry"), "fp")
    least = filed.groupBy("entry").agg(F.min("fp").alias("u"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = filed.join(least, "entry").where(F.col("u") < F.col("fp")).select("u", F.col("fp").alias("v"))
    return near.unionByName(stars).distinct()


#: Parts into which the rows of one key are dealt where keys may be hubs.
SALTS = 256


def hub_join(rows: DataFrame, by_key: DataFrame, key: str, spread: str) -> DataFrame:
    """``rows`` joined with ``by_key``, which has one row per ``key``; a key's rows are dealt over ``SALTS`` tasks by ``spread``.

    A key's row goes to the parts that its rows are in, so that no more of them are made than there are rows.
    """
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    parts = dealt.select(key, "salt").distinct()
    return dealt.join(by_key.join(parts, key), [key, "salt"]).drop("salt")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): every node of ``edges`` (u, v) with the smallest node that it can reach.

    Alternates large-star and small-star; each step is one written table, so
    that a lost executor costs a step at most. No link leaves the executors, and
    the links of a hub are dealt over many tasks. Ends when a large-star changes
    nothing and every node has one smaller neighbour: then all trees are stars.
    Every other round moves a link to a smaller node, so that it does end.
    """

    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()

    e = scratch.keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        before = state(e)
        if before["n"] == 0:
            break
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = scratch.keep(hub_join(both.where("v > u"), m, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        if state(large) == before and least.where("n > 1").limit(1).count() == 0:
            scratch.drop(large)
            break
        small = hub_join(large, least.select("u", "m"), "u", "v").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))
        after = scratch.keep(small.where("u <> v").distinct())
        scratch.drop(large)
        scratch.drop(e)
        e = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, k: int = 3, max_bits: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id): one row per input row; component_id is its component's smallest id."""
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.keep(fingerprints(docs, k, seed))
    texts = scratch.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(texts.select("fp"), scratch, max_bits), scratch)
    rooted = texts.join(roots, texts.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = scratch.keep(rooted.join(ids, "root").select("fp", "component_id"))
    return hub_join(fps, classes, "fp", "doc_id").select("doc_id", "fp", "component_id")


#: Positions of the minwise fingerprint, those in one list's key, and the shared ones that make a candidate.
POSITIONS, IN_KEY, SHARED = 128, 4, 80
#: The similarity of shingle sets that makes a link.
SIMILAR = 0.8
#: Members and shingles of a block of a large list; candidates of two blocks that are verified one by one.
BLOCK, BLOCK_SHINGLES, ONE_BY_ONE = 256, 1 << 18, 64


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """The distinct hashes of a text's ``k``-word shingles, in order."""
    words = text.lower().split()
    return np.unique(np.concatenate(list(shingle_hashes(words, k, 42)))) if words else np.zeros(0, np.uint64)


def minwise(hashes: np.ndarray, factors: np.ndarray) -> bytes:
    """One byte per factor: the low byte of the least ``hash * factor``."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[at : at + 1024, None] * factors).min(axis=0), out=least)
    return ((least >> np.uint64(32)) & np.uint64(255)).astype(np.uint8).tobytes()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def shared_shingles(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many hashes every set of ``a`` shares with every set of ``b``: a product over the hashes that both sides have."""
    x, y = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(x, y)
    out = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, len(common), 4096):
        part, sides = common[at : at + 4096], []
        for values, sets in ((x, a), (y, b)):
            row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            col = np.minimum(np.searchsorted(part, values), len(part) - 1)
            hit = part[col] == values
            m = np.zeros((len(sets), len(part)), np.float32)
            m[row[hit], col[hit]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def block_links(number: int, a: list[dict], b: list[dict] | None, threshold: float) -> list[tuple[int, int]]:
    """Links between the roots of two blocks of list ``number``, or inside one: all pairs of different roots are looked at.

    A pair that an earlier list has, too, is left to that list. The links connect
    what all similar pairs would, and are fewer than the roots.
    """
    same = b is None
    sides = []
    for members in (a, a if same else b):
        sketch = np.frombuffer(b"".join(x["sketch"] for x in members), np.uint8).reshape(-1, POSITIONS)
        sets = [np.frombuffer(x["hashes"], np.uint64) for x in members]
        sides.append((np.array([x["root"] for x in members], np.int64), sketch, sets, np.array([len(s) for s in sets])))
    (ru, su, hu, nu), (rv, sv, hv, nv) = sides
    open_ = ru[:, None] != rv
    if same:
        open_ = np.triu(open_, 1)
    open_ &= np.minimum(nu[:, None], nv) >= threshold * np.maximum(nu[:, None], nv) - 1e-9
    i, j = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
    if not len(i):
        return []
    x, y = su[i], sv[j]
    shared = np.zeros((len(i), len(j)), np.uint8)
    for p in range(POSITIONS):
        shared += x[:, p, None] == y[:, p]
    near = open_[np.ix_(i, j)] & (shared >= SHARED)
    x, y = x.view(np.uint32), y.view(np.uint32)
    for earlier in range(number):
        near &= x[:, earlier, None] != y[:, earlier]
    u, v = np.nonzero(near)
    if len(u) > ONE_BY_ONE:
        i, u = i[np.unique(u)], np.unique(u, return_inverse=True)[1]
        j, v = j[np.unique(v)], np.unique(v, return_inverse=True)[1]
        both = shared_shingles([hu[k] for k in i], [hv[k] for k in j])[u, v].astype(np.float64)
        good = both / (nu[i[u]] + nv[j[v]] - both) >= threshold
    else:
        good = np.array([similarity(hu[p], hv[q]) >= threshold for p, q in zip(i[u], j[v])], bool)
    above: dict[int, int] = {}

    def top(r: int) -> int:
        while (up := above.get(r, r)) != r:
            above[r] = r = above.get(up, up)
        return r

    out = []
    for p, q in zip(ru[i[u[good]]].tolist(), rv[j[v[good]]].tolist()):
        p, q = top(p), top(q)
        if p != q:
            above[max(p, q)] = min(p, q)
            out.append((min(p, q), max(p, q)))
    return out


def block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict], list[dict] | None]]:
    """(list, a block, the other block or None) for each task of the rows, which come in the order of ``task``.

    One task's members are held at a time, wherever batches are cut.
    """
    for (_, number, same), rows in groupby(chain.from_iterable(b.to_pylist() for b in batches), itemgetter("task", "list", "same")):
        sides: tuple[list[dict], list[dict]] = ([], [])
        for x in rows:
            sides[x["high"]].append(x)
        if sides[0] and (same or sides[1]):
            yield number, sides[0], None if same else sides[1]


def near_copies(docs: DataFrame, k: int = 5, threshold: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, fp, root) of every row, and the keys of the rows that stay: one of each group of copies.

    Copies here are documents whose sets of ``k``-word shingles have a (Jaccard)
    similarity of ``threshold`` or more. Sign bits cannot find those: at 0.8, 3 to
    11 of 64 bits differ. The same index holds another fingerprint instead, 128
    bytes that each agree with a probability equal to the similarity. It only
    proposes pairs: lists are keyed by four positions, so that a pair at 0.8
    meets in one of the 32 lists with a probability over 0.9999999, and has
    ``SHARED`` agreeing bytes with one over 0.99999. Whatever is proposed is
    verified on its whole sets of shingles before it links.

    Lists of up to ``LIST_MAX`` members propose all their pairs. In larger lists
    every member is first held against the one whose 32 lists are the fullest
    (the text that the others derive from, if it is there). That settles most of
    them; whatever pair of such a list is then still in different components is
    looked at, block by block.

    Texts without words are copies of each other, and so are texts of the same
    shingles, which ``fp`` tells. Of a group the smallest id stays; a null id
    counts as largest. ``key`` holds the id and two hashes of the text.
    """
    scratch = Scratch(docs.sparkSession, "copies")
    factors = np.random.default_rng(5).integers(0, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def fp_of(sets: list[np.ndarray]) -> pa.Array:
        return pa.array(np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, k) for t in utf8(b.column(2))]
            sketches = pa.array([minwise(x, factors) for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fp_of(sets), pa.array(map(len, sets), pa.int64()), sketches], ["doc_id", "key", "fp", "size", "sketch"])

    def hashes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, k) for t in utf8(b.column(0))]
            yield pa.RecordBatch.from_arrays([fp_of(sets), pa.array([x.tobytes() for x in sets], pa.binary())], ["fp", "hashes"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, POSITIONS) for i in (2, 3))
            yield b.select([0, 1]).filter(pa.array((x == y).sum(axis=1) >= SHARED))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = zip(b.column(2).to_pylist(), b.column(3).to_pylist())
            good = [similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= threshold for x, y in pairs]
            yield b.select([0, 1]).filter(pa.array(good, pa.bool_()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, low, high in block_pairs(batches):
            if found := block_links(number, low, high, threshold):
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["u", "v"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), F.col("text").cast("string").alias("text"))
    rows = scratch.keep(arrow_map(slim, run, f"doc_id long, key {ROW_KEY}, fp long, size long, sketch binary"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    texts = scratch.keep(rows.groupBy("fp").agg(F.min(order).alias("first"), F.first("size").alias("size"), F.first("sketch").alias("sketch")))
    keys = F.transform(F.sequence(F.lit(0), F.lit(POSITIONS // IN_KEY - 1)), lambda i: F.struct(i.alias("list"), F.substring("sketch", i * IN_KEY + 1, F.lit(IN_KEY)).alias("key")))
    postings = scratch.keep(texts.select("fp", F.explode(keys).alias("e")).select("e.list", "e.key", "fp"))
    sizes = postings.groupBy("list", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    listed = scratch.keep(postings.join(sizes, ["list", "key"]))
    few = listed.where(F.col("n") <= LIST_MAX).drop("n")
    pairs = few.withColumnRenamed("fp", "u").join(few.withColumnRenamed("fp", "v"), ["list", "key"]).where("u < v").select("u", "v")
    # texts in large lists, each with these lists; what follows joins texts, not their places in lists
    at = F.struct("list", "key")
    crowd = listed.groupBy("fp").agg(F.sum("n").alias("popularity"), F.collect_list(F.when(F.col("n") > LIST_MAX, at)).alias("lists")).where(F.size("lists") > 0)
    crowd = scratch.keep(crowd)
    many = crowd.select("fp", "popularity", F.explode("lists").alias("at"))
    centers = many.groupBy("at").agg(F.max_by("fp", F.struct("popularity", "fp")).alias("c"))
    stars = hub_join(many, centers, "at", "fp").where("c <> fp").select(F.least("c", "fp").alias("u"), F.greatest("c", "fp").alias("v"))
    met = scratch.keep(pairs.unionByName(stars).distinct())
    sketch = texts.select("fp", "size", "sketch")
    both = hub_join(hub_join(met, sketch.toDF("u", "m", "a"), "u", "v"), sketch.toDF("v", "n", "b"), "v", "u").where(F.least("m", "n") >= threshold * F.greatest("m", "n") - 1e-9)
    proposed = scratch.keep(arrow_map(both.select("u", "v", "a", "b"), tally, "u long, v long"))

    # whole sets, of texts in a proposed pair or a large list
    wanted = proposed.select(F.explode(F.array("u", "v")).alias("fp")).union(crowd.select("fp")).distinct()
    wanted = texts.join(wanted, "fp", "left_semi").select(F.col("first.key").alias("key"))
    read = slim.select("key", "text").join(wanted, "key", "left_semi").select("text")
    sets = scratch.keep(arrow_map(read, hashes_of, "fp long, hashes binary").groupBy("fp").agg(F.first("hashes").alias("hashes")))
    both = hub_join(hub_join(proposed, sets.toDF("u", "a"), "u", "v"), sets.toDF("v", "b"), "v", "u")
    roots = components(arrow_map(both.select("u", "v", "a", "b"), verify, "u long, v long"), scratch)
    rooted = scratch.keep(texts.join(roots, texts.fp == roots.node, "left").select("fp", "first", "size", F.coalesce("root", "fp").alias("root")))

    # large lists that still hold several components
    members = crowd.join(rooted.select("fp", "root", "size"), "fp").select("fp", "root", "size", F.explode("lists").alias("at"))
    room = lambda n, m: F.greatest(F.ceil(n / BLOCK), F.ceil(m / BLOCK_SHINGLES)).cast("int")
    roots = members.groupBy("at", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("m")).withColumn("blocks", room(F.col("n"), F.col("m")))
    small = lambda c: F.coalesce(F.sum(F.when(F.col("blocks") <= 1, F.col(c))), F.lit(0))
    plan = roots.groupBy("at").agg((F.min("root") < F.max("root")).alias("open"), F.collect_list(F.when(F.col("blocks") > 1, F.struct("root", "blocks"))).alias("large"), room(small("n"), small("m")).alias("rest")).where("open")
    plan = scratch.keep(plan.select("at", "large", "rest"))
    # blocks of a large component bear its root; all others share the rest
    numbers = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    block = lambda own, of, i: F.struct(own.alias("own"), of.alias("of"), i.cast("int").alias("i"))
    own = F.flatten(F.transform("large", lambda x: F.transform(numbers(x["blocks"]), lambda i: block(F.lit(True), x["root"], i))))
    rest = F.transform(numbers(F.col("rest")), lambda i: block(F.lit(False), F.lit(0).cast("long"), i))
    tasks = plan.select("at", F.concat(own, rest).alias("blocks")).select("at", F.explode("blocks").alias("lo"), "blocks").select("at", "lo", F.explode("blocks").alias("hi"))
    tasks = tasks.where("lo <= hi and not (lo.own and hi.own and lo.of = hi.of)")
    mine = F.filter("large", lambda x: x["root"] == F.col("root"))
    among = lambda n: F.pmod(F.xxhash64("fp"), n)
    placed = hub_join(members, plan, "at", "fp").withColumn("mine", F.get(mine, F.lit(0)))
    placed = placed.withColumn("block", F.when(F.col("mine").isNull(), block(F.lit(False), F.lit(0).cast("long"), among(F.col("rest")))).otherwise(block(F.lit(True), F.col("root"), among(F.col("mine.blocks")))))
    placed = placed.groupBy("fp").agg(F.first("root").alias("root"), F.collect_list(F.struct("at", "block")).alias("places"))
    shipped = placed.join(sketch.select("fp", "sketch"), "fp").join(sets, "fp").select(F.explode("places").alias("place"), F.struct("root", "sketch", "hashes").alias("member")).select("place.at", "place.block", "member")
    # a task's members come one by one, in order: gathered in rows, those of many tasks would lie on the heap at once
    name = F.concat_ws("/", "at.list", F.hex("at.key"), *(f"{side}.{x}" for side in ("lo", "hi") for x in ("own", "of", "i")))
    tasks = tasks.select("*", name.alias("task"), (F.col("lo") == F.col("hi")).alias("same"))
    sides = tasks.select("*", F.col("lo").alias("block"), F.lit(False).alias("high")).union(tasks.where("not same").select("*", F.col("hi").alias("block"), F.lit(True).alias("high")))
    met = sides.join(shipped, ["at", "block"]).select("task", "at.list", "same", "high", "member.*")
    met = met.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "task").sortWithinPartitions("task")
    late = components(arrow_map(met, compare, "u long, v long"), scratch)
    late = late.withColumnRenamed("root", "over")
    rooted = scratch.keep(rooted.join(late, rooted.root == late.node, "left").select("fp", "first", F.coalesce("over", "root").alias("root")))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias("key"))
    return hub_join(rows.select("doc_id", "key", "fp"), rooted.select("fp", "root"), "fp", "key"), scratch.keep(kept)


def one_of_each(docs: DataFrame, k: int = 5, threshold: float = SIMILAR) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group of near copies does.

    Of rows with equal ids and texts the one with the least other values stays.
    """
    rows, kept = near_copies(docs, k, threshold)
    name = next(f"row_key{i}" for i in range(len(docs.columns) + 1) if f"row_key{i}" not in docs.columns)
    mine = docs.withColumn(name, row_key()).join(kept.withColumnRenamed("key", name), name, "left_semi")
    again = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(kept, "key", "left_semi").select(F.col("key").alias(name))
    if again.take(1):  # rows that repeat id and text
        columns = [F.col(f"`{c}`") for c in docs.columns]
        least = mine.join(again, name, "left_semi").groupBy(name).agg(F.min(F.struct(*columns)).alias(f"{name}_least")).select(F.col(f"{name}_least.*"))
        mine = mine.join(again, name, "left_anti").select(*columns).unionByName(least)
    return mine.select(*(F.col(f"`{c}`") for c in docs.columns))


def op6_simhash(spark, sf_dir):
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
