"""Shared helpers of the training-data operators: tables in the shared scratch folder, and vectorised text hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_own_dir: dict[str, str] = {}
#: Rows that go to Python at a time.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of a few numbers that may be broadcast (some tens of MB); more are joined by a shuffle.
MAX_SENT = 500_000

#: Odd multiplier of the polynomial byte hash, and its inverse modulo 2**64.
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 2**64)
_U = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary folder, which only a local master shares."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="corpusflow-")
    return _own_dir[app]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder as Parquet and reads it back: cuts the lineage, survives lost executors."""
    return _written(df, name)[0]


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


class Scratch:
    """Owns the tables that an operator writes between its jobs, and deletes them: each when it is dropped, all that are left at the end.

    An operator's result is a table of its own (``stage``) or reads inputs only, so it outlives the scratch tables.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths.values():
            self._delete(path)
        self.paths.clear()

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        table, path = _written(df, name)
        # the table itself is kept, or its id could be given to another
        self.paths[id(table)] = (table, path)
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more; those it doesn't own stay. The shuffle files of the jobs that wrote them go when the
        driver collects its garbage, so it is told to: a long operator would else fill the executors' disks."""
        for table in tables:
            if held := self.paths.pop(id(table), None):
                self._delete(held)
        self.spark.sparkContext._jvm.System.gc()

    def _delete(self, held: tuple[DataFrame, str]) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(held[1])
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Texts go to Python so many at a time while jobs run within: at Spark's own 10,000, buffers of some tens of MB on both sides are held in each task."""
    before = spark.conf.get(BATCH)
    batches_at_most(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def batches_at_most(spark: SparkSession, rows: int = 1000) -> None:
    """The same from here on, for a job that owns its session: a result that goes through Python is made when its caller writes it."""
    before = int(spark.conf.get(BATCH))
    spark.conf.set(BATCH, str(min(rows, before) if before > 0 else rows))


def sent(df: DataFrame) -> DataFrame:
    """``df``, a written table of a few numbers a row, to be broadcast if it is counted to have no more than MAX_SENT rows."""
    return F.broadcast(df) if df.count() <= MAX_SENT else df


def row_keys(*columns: str) -> list[Column]:
    """k1, k2: 128 bits that tell rows apart by ``columns``, nulls included, whatever ids repeat."""
    return [F.xxhash64(F.lit(salt), *[F.col(c).isNull() for c in columns], *columns).alias(f"k{salt}") for salt in (1, 2)]


def running_totals(df: DataFrame, order: list[str], value: str, name: str, keep=stage) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows before each row in the order of ``order``, which must tell rows apart.

    Rows are ranged into at most 20,000 buckets, each summed by a task of its own; one row per bucket meets in a window and is sent back.
    """
    n = df.count()
    buckets = max(1, min(20_000, -(-n // 20_000)))
    ranged = keep(df.repartitionByRange(buckets, *order).withColumn("_bucket", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("_bucket").agg(F.sum(value).alias("_sum"))
    before = sums.select("_bucket", (F.sum("_sum").over(W.orderBy("_bucket")) - F.col("_sum")).alias("_before"))
    within = F.sum(value).over(W.partitionBy("_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) - F.col(value)
    return ranged.withColumn(name, within).join(F.broadcast(before), "_bucket").withColumn(name, F.col(name) + F.col("_before")).drop("_bucket", "_before")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n; kept between batches, grown by doubling."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _POWERS[:] = [np.concatenate(([_U(1)], np.full(size - 1, b, np.uint64))).cumprod(dtype=np.uint64) for b in (_P, _P_INV)]
    return _POWERS[0], _POWERS[1]


def segment_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range of ``buf``; equal bytes give equal hashes wherever they lie."""
    up, down = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + _U(1)) * up[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + mix((ends - starts).astype(np.uint64)))


def text_buffers(column, max_bytes: int = 250_000):
    """Slices of an Arrow string column as (first row, byte buffer, row offsets); null is empty. A text longer than ``max_bytes`` is a slice of its own."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def ascii_lower(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of each run of bytes other than space and 9-13; a run ends with its row's text."""
    if not len(buf):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    word = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    cut = np.zeros(len(buf) + 1, bool)
    cut[offsets] = True
    before = np.concatenate(([False], word[:-1]))
    starts = np.flatnonzero(word & (~before | cut[:-1]))
    after = np.concatenate((word[1:], [False]))
    ends = np.flatnonzero(word & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1
