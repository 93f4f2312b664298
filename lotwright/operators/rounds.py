"""Results of rounds, written where every executor can read them, and groups that tasks work on whole."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Rows that a task of an exchange should get, at most: what it sorts or hashes must not grow with the input.
TASK_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder, but on one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lotwright-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to as many tasks as a shuffle has: a small file's rows would else be one task's, with all that is made of them."""
    return spread_by(df)


def spread_by(df: DataFrame, *keys: str) -> DataFrame:
    """spread() with rows of equal ``keys`` in one task."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism), *keys)


def tasks_for(rows: int, spark: SparkSession) -> int:
    """Tasks for an exchange of so many rows: as many as a shuffle has, more where one would get over TASK_ROWS."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """``df`` exchanged by ``keys`` to so many tasks; as it is where that is None."""
    return df if tasks is None else df.repartition(tasks, *keys)


def keep(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: what follows starts from files, whose size is known.

    The shuffle files of the work behind it go at once: Spark deletes them when
    the driver's JVM collects what refers to them, which may else be many rounds later.
    """
    path = f"{shared_folder(df.sparkSession)}/rounds/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    df.sparkSession._jvm.System.gc()
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete the files of frames that keep() returned, once all that reads them is written."""
    for df in frames:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(df._kept)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def whole_groups(batches: Iterable[pa.RecordBatch], key: str | list[str], rows: int = 10_000) -> Iterator[pa.Table]:
    """A task's batches, in order of ``key`` (one or several), as tables of about ``rows`` rows or more in which no group is cut."""
    keys = [key] if isinstance(key, str) else key
    held, size = [], 0
    for batch in batches:
        held, size = [*held, batch], size + batch.num_rows
        if size < rows:
            continue
        # The last group's rows wait for what may follow of it.
        table = pa.Table.from_batches(held)
        other = np.any([pc.not_equal(table.column(k), table.column(k)[-1]).to_numpy() for k in keys], axis=0)
        end = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        if end:
            yield table.slice(0, end)
            held, size = table.slice(end).to_batches(), size - end
    if size:
        yield pa.Table.from_batches(held)


def changes(column: pa.ChunkedArray) -> np.ndarray:
    """Where a column without nulls has another value than in the row before."""
    other = pc.not_equal(column.slice(1), column.slice(0, max(len(column) - 1, 0)))
    return np.concatenate([np.ones(min(len(column), 1), bool), other.to_numpy()])
