"""The folder that driver and executors share, and tables written there to cut a plan's lineage."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. On a local master, where that is unset, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quire-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _path(spark: SparkSession, path: str) -> tuple[object, object]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path of its own in the shared folder. What is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/quire-{what}-{uuid.uuid4().hex}"
    p, fs = _path(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, and survives lost executors."""
    path = fresh_path(df.sparkSession, what)
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quire_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a written table that nothing reads any more, and lets Spark clean the shuffles behind it."""
    path = getattr(df, "_quire_path", None)
    if path:
        p, fs = _path(df.sparkSession, path)
        fs.delete(p, True)


def local_or_uri(path: str) -> tuple[object, str]:
    """A pyarrow file system and the path in it, for file://, hdfs:// and object stores alike."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), unquote(urlparse(path).path)
    return fs.FileSystem.from_uri(path)
