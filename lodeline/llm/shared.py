"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pattern of a word, a run of anything but ASCII white space, and of what stands between words. Texts are split by the
#: latter, in linear time; Spark's regexp_extract_all and regexp_count copy the whole text for each match.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


#: Tables of up to so many bytes are broadcast, larger ones are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under the one that the cluster shares (``spark.checkpoint.dir``).

    A folder of this machine is used only where that setting is absent and Spark runs on this machine alone, as in tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lodeline-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/lodeline-{uuid.uuid4().hex}"


@contextlib.contextmanager
def short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of executions within go when those end; for results that are written, so that nothing reads them again."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str, root: str | None = None, by: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder (in a folder for each value of ``by``) and reads it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{root or scratch_dir(spark)}/{name}"
    writer = df.write.mode("overwrite").option("compression", "zstd")
    with short_lived_shuffles(spark):
        (writer.partitionBy(by) if by else writer).parquet(path)
    relieve(spark)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, root: str, *names: str) -> None:
    """Removes stored tables that nothing reads any more."""
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_held: dict = {}


def held(name, make: Callable):
    """What a Python worker keeps between tasks, of one operator at a time: when another asks, the former's goes."""
    if name not in _held:
        _held.clear()
        give_back()
        _held[name] = make()
    return _held[name]


def give_back() -> None:
    """Returns to the machine what this process has freed. Idle Python workers live on beside those at work, with all that their allocators keep."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


#: Of the driver's greatest heap the share that may be filled anew before ``relieve`` clears it.
FILLED = 4
_kept = {"heap": 0}


def relieve(spark: SparkSession) -> bool:
    """Has the driver give back what it no longer uses, once it has filled a share of its heap since the last time; says whether it did.

    Left alone, a heap grows to its limit before it is cleared, beside what this process and the JVM's compiled plans take. When it is cleared,
    Spark also removes broadcasts that nothing refers to.
    """
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() - heap.freeMemory() - _kept["heap"] < heap.maxMemory() // FILLED:
        return False
    gc.collect()  # plans that Python no longer refers to
    spark._jvm.java.lang.System.gc()
    _kept["heap"] = heap.totalMemory() - heap.freeMemory()
    give_back()
    return True


def lean(run: Callable) -> Callable:
    """A function over batches after whose last one, or its failure, memory is given back.

    While it runs, Python seldom looks for cycles: the operators make none, and each look passes over all words that are remembered."""

    @functools.wraps(run)
    def runs(batches):
        usual = gc.get_threshold()
        gc.set_threshold(1_000_000, 1000, 1000)
        try:
            yield from run(batches)
        finally:
            gc.set_threshold(*usual)
            give_back()

    return runs


def checked_broadcast(df: DataFrame, row_bytes: int = 16) -> DataFrame:
    """A stored table with a hint to broadcast it if its rows are few enough, else as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def word_count(text: Column) -> Column:
    """Number of words (``WORD``) in a text; null has none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")).cast("long")
