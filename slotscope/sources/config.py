"""Small configuration tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def owned_hosts(spark: SparkSession, path: str) -> DataFrame:
    """(Machine) from a text file with a host a line; blank lines are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("Machine")).where("Machine != ''").distinct()


def host_exclusions(spark: SparkSession, path: str | None = None, inline: str = "") -> DataFrame:
    """(pattern, reason) from a file with an ``excluded_hosts:`` section of ``pattern: reason`` lines
    and from an inline list ``pattern:reason,pattern``; inline entries win."""
    schema = "pattern string, reason string, own int"
    given: Mapping[str, str] = dict((x.split(":", 1) + [""])[:2] for x in inline.split(",") if x.strip())
    rows = spark.createDataFrame([(k.strip(), v.strip(), 1) for k, v in given.items()], schema)
    if path:
        lines = spark.read.text(path).where(F.rlike("value", F.lit(r"^\s+[^#\s][^:]*:")))
        listed = lines.select(F.trim(F.regexp_extract("value", r"^\s+([^:]+):", 1)).alias("pattern"), F.trim(F.regexp_extract("value", r"^\s+[^:]+:(.*)$", 1)).alias("reason"), F.lit(0).alias("own"))
        rows = rows.unionByName(listed)
    return rows.groupBy("pattern").agg(F.max_by("reason", "own").alias("reason"))
