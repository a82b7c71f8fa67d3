"""Shared folders, lineage cuts, and atomic writes of small documents, by Spark's own file systems."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share. A local session may name none and gets a temporary one; a cluster must."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not found:
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)  # a local session's own
        found = f"file://{folder}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read from there, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows, written to the shared folder as Parquet and read from there."""
    path = path or f"{shared_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """Tables that an iteration leaves from round to round in the shared folder, as Parquet. Unlike a checkpoint's, their sizes are known to the
    planner, which else multiplies guesses join by join. Leaving the context deletes them; what `keep` wrote stays."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, f"{shared_dir(spark)}/rounds-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Rounds:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, self.path)

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        return written(df, f"{self.path}/{self.n}")

    def keep(self, df: DataFrame) -> DataFrame:
        return written(df)


def spread(rows: DataFrame) -> DataFrame:
    """Deals rows out to all cores where fewer partitions hold any, as with a table of one row group; larger tables stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    held = rows.select(F.spark_partition_id().alias("p")).distinct().limit(cores).count()
    return rows.repartition(cores) if 0 < held < cores else rows


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Folders right below a path, by name; none if it doesn't exist."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _whole(spark: SparkSession, path: str, text: str):
    """A document under a name of its own beside the path: the file system, the name, the path."""
    fs, to = _fs(spark, path)
    fs.mkdirs(to.getParent())
    tmp = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(tmp, False)
    out.write(bytearray(text.encode()))
    out.close()
    return fs, tmp, to


def atomic_write(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small document under another name and puts it in the place of what is there, in one step: a reader finds the old one or the new."""
    fs, tmp, to = _whole(spark, path, text)
    jvm, gateway = spark._jvm, spark._sc._gateway
    if fs.getUri().getScheme() == "file":
        at = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), gateway.new_array(jvm.java.lang.String, 0))
        how = gateway.new_array(jvm.java.nio.file.CopyOption, 2)
        how[0], how[1] = jvm.java.nio.file.StandardCopyOption.ATOMIC_MOVE, jvm.java.nio.file.StandardCopyOption.REPLACE_EXISTING
        jvm.java.nio.file.Files.move(at(tmp), at(to), how)
        crc = spark._jvm.org.apache.hadoop.fs.Path(tmp.getParent(), f".{tmp.getName()}.crc")
        fs.getRawFileSystem().delete(crc, False)
        fs.getRawFileSystem().delete(spark._jvm.org.apache.hadoop.fs.Path(to.getParent(), f".{to.getName()}.crc"), False)  # of the old one
        return
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(tmp, to, how)


def write_json(spark: SparkSession, path: str, value: object) -> None:
    atomic_write(spark, path, json.dumps(value, indent=2, ensure_ascii=False) + "\n")


def read_json(spark: SparkSession, path: str, schema: StructType | str, multiline: bool = True) -> DataFrame:
    """Rows by the schema; none if the path doesn't exist. Malformed documents are errors."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", multiline).option("mode", "FAILFAST").json(path)


def guarded(root: str, file: str) -> str:
    """The path of a file below a local folder; links that lead outside are errors."""
    import os

    base, path = os.path.realpath(root), os.path.realpath(os.path.join(root, file))
    if path != base and not path.startswith(base + os.sep):
        raise ValueError(f"Local source symlink escapes paper directory: {file}")
    return path


def read_pages(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), html of every built page."""
    pages = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.html").text(root, wholetext=True)
    name = root.rstrip("/").split("/")[-1]
    return pages.select(F.element_at(F.split(F.col("_metadata.file_path"), f"/{name}/"), -1).alias("path"), F.col("value").alias("html"))
