"""Helpers shared by the text operators: the shared scratch folder, written tables and Arrow batch slicing."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text handled at once inside a Python worker; a single longer text is a slice of its own.
SLICE_BYTES = 4 << 20
#: Seconds without a task after which a worker drops its caches; tasks of one stage follow each other faster.
IDLE_SECONDS = 2.0


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where that is unset, a local session (tests) gets a temporary folder; a cluster, whose executors don't share one,
    gets a ValueError.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rillrank-"))
    return spark.sparkContext.getCheckpointDir()


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, deleted when the driver ends."""
    path = f"{shared_folder(spark)}/rillrank-{label}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder; a stopped session leaves it to the cluster's own cleaning."""
    if spark.sparkContext._jsc is None:
        return
    with suppress(Py4JError, OSError):  # the JVM may have ended first
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back, so that lineage ends there."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that is sorted and merged, so that neither side is broadcast through the driver.

    Spark takes a written table for as large as its compressed files and an array for one element, also where it is
    exploded: hundreds of MB can pass as less than ``spark.sql.autoBroadcastJoinThreshold``.
    """
    return df.hint("merge")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """While an action runs inside, Arrow batches to Python hold at most so many rows (long texts, little memory)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def least_hashes(n: int, count: int) -> int:
    """A bound that about ``4 * n`` of ``count`` signed 64-bit hashes lie below: which n are least needs only these."""
    share = min((4 * n + 64) / max(count, 1), 1.0)
    return min(int(share * 2**64), 2**64 - 1) - 2**63


def trim() -> None:
    """Give memory that a worker has freed back to the system: workers outlive tasks and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


_kept: dict[str, object] = {}
_idle: list[threading.Timer] = []


def release() -> None:
    """Drop what ``kept`` holds in this worker."""
    if _kept:
        _kept.clear()
        trim()


def kept[T](key: str, make: Callable[[], T]) -> T:
    """This worker's object for ``key``, kept with its caches from task to task.

    It goes when any other operator's task comes, or when none comes for a while: until the next stage has tasks in
    Python, its JVM needs the memory.
    """
    while _idle:
        _idle.pop().cancel()
    found = _kept.get(key)  # a timer that fires just now takes the cache away, not this object
    if found is None:
        release()
        found = _kept[key] = make()
    return found


def _rest() -> None:
    """Drop what ``kept`` holds once no task has asked for it for a while."""
    timer = threading.Timer(IDLE_SECONDS, release)
    timer.daemon = True
    _idle.append(timer)
    timer.start()


def slices(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, keep: bool = False
) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of at most ``limit`` bytes of ``column`` (one row at least).

    Workers outlive the stages of a pipeline: unless ``keep``, caches of operators that ran before go first.
    """
    if not keep:
        release()
    for batch in batches:
        index = batch.schema.get_field_index(column)
        sizes = pc.binary_length(batch.column(index)).fill_null(0).to_numpy(zero_copy_only=False)
        start = held = 0
        for row, size in enumerate(sizes):
            if row > start and held + size > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += int(size)
        if batch.num_rows > start:
            yield batch.slice(start)
        del batch
    trim()
    if keep:
        _rest()
