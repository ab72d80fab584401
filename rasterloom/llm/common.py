"""What the operators of this subpackage share: scratch tables, blocks of rows, word splitting."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_left: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session names none and its master is local is a temporary folder made and set; on a
    cluster, whose machines would not share it, that is an error.
    """
    found = spark.sparkContext.getCheckpointDir() or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines share")
    if not found:
        found = Path(tempfile.mkdtemp(prefix="rasterloom-")).as_uri()
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; it is removed when the session's process ends, if not before."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _left:
        atexit.register(_drop_left, spark)
    _left.append(path)
    return path


def drop_scratch(spark: SparkSession, *paths: str) -> None:
    """Removes scratch tables that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        if path in _left:
            _left.remove(path)


def _drop_left(spark: SparkSession) -> None:
    try:
        drop_scratch(spark, *_left)
    except Exception:  # noqa: BLE001 - the session has ended already; the folder belongs to the cluster
        _left.clear()


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop_saved(*tables: DataFrame) -> None:
    """Removes tables of saved() that nothing reads any more."""
    for t in tables:
        if getattr(t, "_scratch", None):
            drop_scratch(t.sparkSession, t._scratch)


def scratch_left() -> list[str]:
    return list(_left)


def give_back() -> None:
    """Free memory of a Python worker goes back to the system: workers outlive tasks, and what one task
    freed would count beside what the next ones need."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(f: Callable) -> Callable:
    """f, a function for mapInArrow, and then give_back()."""

    def run(batches):
        yield from f(batches)
        give_back()

    return run


def lean_group(f: Callable) -> Callable:
    """f, a function for applyInArrow, and then give_back() if the group was large."""

    def run(*tables: pa.Table) -> pa.Table:
        out = f(*tables)
        if sum(t.nbytes for t in tables) > 1 << 20:
            give_back()
        return out

    # Spark tells functions of a group from those of a key and a group by their number of parameters
    return (lambda t: run(t)) if f.__code__.co_argcount == 1 else (lambda a, b: run(a, b))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text as long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def partitions(df: DataFrame) -> int:
    return max(1, df.rdd.getNumPartitions())


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
