"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import sys
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; any path that Spark's readers open will do."""
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it. Without the setting a local
    session, as in tests, gets a temporary folder; on a cluster that is an error, since executors do not see it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="shared-")


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder on any file system that Spark reaches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def release() -> None:
    """Gives memory that a Python worker no longer uses back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
        if trim:
            trim(0)


def tidied(task: Task) -> Task:
    """The same task for mapInArrow, which releases memory when it ends."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(parts)
        finally:
            release()

    return run


_held: dict[str, object] = {}


def held(kind: str, make: Callable[[], object]) -> object:
    """What a worker keeps from task to task, such as the tables of a vocabulary: of one kind at a time, so that stages
    that follow each other in one worker do not add up."""
    if kind not in _held:
        _held.clear()
        _held[kind] = make()
    return _held[kind]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted_lookup(many: DataFrame, one: DataFrame, key: str, salt: Column, how: str = "inner") -> DataFrame:
    """Joins ``many`` with ``one`` (unique by ``key``) without gathering a hot key in one task.

    The distinct pairs of key and salt are far fewer than the rows for a hot key and no more than the rows for
    the others. They look the key up (a key has at most as many of them as there are salts), and the rows then
    join on key and salt, so a key that holds a third of all rows is spread over all salts.
    """
    salts = max(16, partitions(many.sparkSession))
    many = many.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    found = many.select(key, "_salt").distinct().join(one, key)
    return many.join(found, [key, "_salt"], how).drop("_salt")


def offsets_by_bucket(sizes: DataFrame, group: str, bucket: str, count: str, out: str) -> DataFrame:
    """Exclusive prefix sums of ``count`` over the buckets of each group; a group has a bounded number of buckets."""
    from pyspark.sql import Window

    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn(out, F.coalesce(F.sum(count).over(before), F.lit(0).cast("long")))
