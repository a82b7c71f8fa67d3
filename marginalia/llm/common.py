"""What the operators of this subpackage share: reading tables, the shared folder, cutting lineage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import math
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space that separates words: space and the controls from tab to carriage return.
BLANK = "[\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with no column of df, upper and lower case alike."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def spread(rows: DataFrame) -> DataFrame:
    """Deals rows out to all cores where fewer partitions hold any, as with a table of one row group; larger tables stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    held = rows.select(F.spark_partition_id().alias("p")).distinct().limit(cores).count()
    return rows.repartition(cores) if 0 < held < cores else rows


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local session may name none (tests, bench) and gets a temporary one; a cluster must."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not found:
        folder = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)  # a local session's own
        found = f"file://{folder}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared checkpoint folder and goes on from there: a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets the driver collect its garbage now: files of shuffles and checkpoints that nothing refers to any more go then, and else only when
    it happens to. For loops whose rounds each leave some."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Gives this process's free memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """A function over Arrow batches that gives free memory back when it is done, as workers go on to serve other tasks."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return wrapped


def parts_for(amount: float, each: float, least: int = 8) -> int:
    """How many partitions keep `each` units or less in one."""
    return int(max(least, math.ceil(amount / each)))
