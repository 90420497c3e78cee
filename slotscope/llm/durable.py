"""Cutting lineage into storage that outlives an executor."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; a temporary one where it is unset and all is one machine.

    On a cluster without that setting it refuses: a folder of one machine is not seen by the others.
    """
    jsc = spark.sparkContext._jsc.sc()
    found = jsc.getCheckpointDir()
    if found.isDefined():
        return found.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return jsc.getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """``df``, computed now and written to the checkpoint folder; later reads come from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, old: str | None = None) -> tuple[DataFrame, str]:
    """``df`` written as a table beside the checkpoints, and its path; the table at ``old`` goes.

    For loops: a checkpoint keeps the planner's size estimates, which a join multiplies, so that
    after a dozen rounds they have millions of digits. A table's size is that of its files.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if old is not None:
        gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old)
        gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    return spark.read.parquet(path), path


def release() -> None:
    """At the end of a Python task: gives freed memory back to the system, as workers live on."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def parallelism(spark: SparkSession) -> int:
    """Partitions that a shuffle of this session makes."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
