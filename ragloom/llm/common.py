"""What the operators of this subpackage share: shared-folder tables, block counts, worker caches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import time
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What this Python worker keeps between tasks: owner and how to drop it.
_kept: dict[str, Callable[[], None]] = {}
_last: list[str | None] = [None]


def keeps(owner: str, drop: Callable[[], None]) -> None:
    _kept[owner] = drop


def enter(owner: str | None = None) -> None:
    """Called where a worker begins an operator's work: other operators' caches in this worker go, and freed memory with them."""
    gone = [n for n in _kept if n != owner]
    for name in gone:
        _kept.pop(name)()
    if gone or owner != _last[0]:
        _last[0] = owner
        gc.collect()
    give_back()


def give_back() -> None:
    """Freed memory goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: Compressed input bytes that one block (one task's documents) should hold.
BLOCK_BYTES = 4 << 20


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, taken: list[str]) -> str:
    """A column name like ``name`` that is not taken, whatever the case."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("ragloom.scratch.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ragloom-")
        spark.conf.set("ragloom.scratch.dir", found)
    return found


#: Tables in the shared folder by the DataFrame that reads them, and all that are there.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_there: dict[str, SparkSession] = {}


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: lineage ends there and survives lost executors.

    The table goes when ``discard`` or the end of a ``scratch`` block says so, at the latest with the driver's Python.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _there[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def _remove(path: str) -> None:
    spark = _there.pop(path, None)
    if spark is not None:
        jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Removes stored tables that nothing reads any more; other DataFrames are left alone."""
    for df in tables:
        if path := _paths.pop(df, None):
            _remove(path)


def release(spark: SparkSession) -> None:
    """Shuffle files of plans that nothing holds any more go now, not when the driver happens to collect its garbage.

    Python's references reach the JVM with the next call, and Spark's cleaner works on its own: hence two rounds.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stored inside are removed at the end, but those given to what it yields."""
    before, kept = set(_there), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(_paths.get(df))
        return df

    try:
        yield keep
    finally:
        for path in [p for p in _there if p not in before and p not in kept]:
            _remove(path)


@atexit.register
def _remove_all() -> None:
    for path in list(_there):
        with suppress(Exception):  # the session may have ended
            _remove(path)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df`` (file bytes for a scan); without one, half the bytes of its texts.

    Only block counts and sketch widths follow from it.
    """
    found = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if found < 1 << 55:
        return found
    return (df.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first().n or 0) // 2


def block_count(df: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    return max(8, -(-input_bytes(df) // block_bytes))


def to_blocks(df: DataFrame, blocks: int) -> DataFrame:
    """``df`` hash-partitioned on its block number. A task gets about four blocks, one after the other: fewer tasks, shuffle
    segments and files."""
    return df.repartition(max(8, -(-blocks // 4)), "block")


def as_blocks(df: DataFrame, blocks: int, key: Column) -> DataFrame:
    """``df`` with a block number derived from ``key``, partitioned by it; later grouping by ``block`` needs no new shuffle."""
    return to_blocks(df.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")), blocks)
