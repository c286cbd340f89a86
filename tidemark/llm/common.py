"""What the operators of this subpackage share: scratch tables, Arrow maps, splits."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch. A batch of default size can hold 10,000 very long texts.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a folder of our own only where that is unset and all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='scratch-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Folders of the scratch tables made so far.
_roots: list[str] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes the scratch tables made inside, for results that are written there, too."""
    mark = len(_roots)
    try:
        yield
    finally:
        for root in _roots[mark:]:
            _delete(spark, root)
        del _roots[mark:]


class Scratch:
    """Written tables that cut lineage and survive the loss of executors.

    ``keep`` writes a frame as Parquet in the shared folder and reads it again;
    ``drop`` deletes a table that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}
        _roots.append(self.root)

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, df: DataFrame) -> None:
        if path := self.paths.pop(id(df), None):
            _delete(self.spark, path)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches of bounded size, whatever the length of the texts.

    The JVM cuts the batches by settings of the session as it runs, so these are
    lowered to ``BATCH_ROWS`` and ``BATCH_BYTES`` if they are higher, and never raised.
    """
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(f"spark.sql.execution.arrow.{name}").lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return df.mapInArrow(lambda batches: fn(b for b in batches if b.num_rows), schema)


#: The type of ``row_key``.
ROW_KEY = "struct<id:long,text:long,check:int>"


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What tells rows apart: the id and two hashes of the text."""
    return F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text"), F.hash(text_col).alias("check"))


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def held_out(doc_id: Column) -> Column:
    """Whether a document belongs to the part that no model may learn from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2
