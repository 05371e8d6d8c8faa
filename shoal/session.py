"""Shared storage for intermediate tables that must survive the loss of executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder the cluster names in ``spark.checkpoint.dir``.

    A local session without that setting gets a temporary folder; a cluster session
    without it is refused, because executors could not read a machine-local path.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="shoal-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str = "table") -> str:
    """A fresh path under the shared folder, below the application's own folder."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/shoal/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> bool:
    """Delete what this application wrote to the shared folder; results that still read it must be saved before."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader over the files.

    Unlike ``checkpoint`` this evaluates the plan one time, keeps the table columnar, so
    later jobs still prune columns, and leaves no lineage to recompute.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession, limit: int) -> None:
    """Let wide rows travel to Python in Arrow batches of ``limit`` bytes at most (or one row): a task holds a batch or two,
    whatever it reads. A smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = re.fullmatch(r"(\d+)([kmgtp]?)b?", spark.conf.get(name).strip().lower())
    if given is None or not 0 < int(given[1]) << 10 * " kmgtp".index(given[2] or " ") <= limit:
        spark.conf.set(name, limit)


SMALL_ROWS = 5_000_000
TASK_ROWS = 10_000


def spread(df: DataFrame, rows: int) -> DataFrame:
    """Size the tasks of a small table that is read many times.

    A small file is one split, which would leave every pass to one task, and a tiny table in
    many pieces costs more to schedule than to read. Large tables arrive in many splits and
    are left alone.
    """
    if rows > SMALL_ROWS:
        return df
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(slots, rows // TASK_ROWS)))
