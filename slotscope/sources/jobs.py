"""Job history, event-log files and result files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotscope.schema import JOBS

_TEXT = T.StructType([T.StructField(f.name, T.StringType()) for f in JOBS.fields])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Job history with a header; columns by name, bad values null, missing text UNKNOWN."""
    raw = spark.read.option("header", True).csv(path)
    cast = lambda f: F.col(f.name).try_cast("double").cast(f.dataType) if isinstance(f.dataType, T.LongType) else F.col(f.name).try_cast(f.dataType)
    cols = [(cast(f) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in JOBS.fields]
    return raw.select(*cols).fillna("UNKNOWN", subset=[f.name for f in JOBS.fields if isinstance(f.dataType, T.StringType)])


def device_jobs(jobs: DataFrame, start: int, end: int) -> DataFrame:
    """Jobs that asked for devices, recorded in [start, end)."""
    return jobs.where((F.col("RequestGpus") > 0) & (F.col("RecordTime") >= start) & (F.col("RecordTime") < end))


def read_logs(spark: SparkSession, path: str, pattern: str = "*.log") -> DataFrame:
    """(log, text) of every log file under a folder, one row a file."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    return files.select(F.col("_metadata.file_path").alias("log"), F.col("value").alias("text"))


def write_csv(rows: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Result files with a header and the columns in the order given."""
    rows.select(*columns).write.mode("overwrite").option("header", True).csv(path)
