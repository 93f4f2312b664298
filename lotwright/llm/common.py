"""Shared helpers: table reading, shared folders and cutting of lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, without a trailing slash.

    It is ``spark.checkpoint.dir``. Where that is unset, a temporary folder
    serves, but only in local mode, where there is one machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lotwright-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Paths that scratch() gave in this process and remove() has not seen.
SCRATCH: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    SCRATCH.append(f"{shared_dir(spark)}/lotwright/{label}-{uuid.uuid4().hex}")
    return SCRATCH[-1]


def remove(spark: SparkSession, path: str) -> None:
    """Delete ``path`` with what is below it, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in SCRATCH:
        SCRATCH.remove(path)


def cut(df: DataFrame, label: str, release: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    What follows depends on files that outlive any executor, not on the work
    that made them. With ``release`` the shuffle files of that work go at once:
    Spark deletes them when the driver's JVM collects what refers to them,
    which may else be long after.
    """
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    if release:
        df.sparkSession._jvm.System.gc()
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames that cut() returned, once all that reads them is written."""
    for df in frames:
        remove(df.sparkSession, df._scratch)


def crc_mod(column, modulus: int):
    """crc32 of the id's decimal text, modulo ``modulus``; null ids count as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def unique_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores added until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
