"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition becomes a run: one row for each distinct digest that it holds, with the
identifier that stays, the number of rows and a check value. In binomial rounds the partitions
exchange parts of their runs: in round ``r`` a row moves to the partition whose ``r``-th digit is
that digit of its digest's bucket, so each partition gets ``fan_in`` sorted runs, merges them
(Spark's external sort) and keeps one row for each digest again. After ``log(partitions) /
log(fan_in)`` rounds every digest is in one place and no task ever held more than its share.

A row is merged with another only if the 256-bit digest, the number of bytes and an independent
64-bit hash agree; this is verified at every level. Hot groups shrink to one row a partition
before the first exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotscope.llm.durable import durable, parallelism

RUN = "at int, sha binary, n_bytes bigint, check bigint, keep_id bigint, n_rows bigint, keep_rows bigint"
_KEY = ("sha", "n_bytes", "check")
_COLUMNS = ["at", *_KEY, "keep_id", "n_rows", "keep_rows"]


def _best(ids: pa.ChunkedArray, keep: str) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers with nulls as the worst value, and where they are null."""
    null = ids.is_null().to_numpy(zero_copy_only=False)
    worst = np.iinfo(np.int64).min if keep == "max" else np.iinfo(np.int64).max
    return ids.fill_null(worst).to_numpy().astype(np.int64), null


def _merge_table(t: pa.Table, keep: str) -> pa.Table:
    """One row for each run of equal keys; ``t`` is sorted by key."""
    t = t.combine_chunks()
    n = t.num_rows
    sha = np.array(t["sha"].to_pylist(), dtype="S64") if n else np.empty(0, "S64")
    at, size, check = (t[c].to_numpy() for c in ("at", "n_bytes", "check"))
    start = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (sha[1:] != sha[:-1]) | (size[1:] != size[:-1]) | (check[1:] != check[:-1])])
    ids, null = _best(t["keep_id"], keep)
    pick = np.maximum if keep == "max" else np.minimum
    best = pick.reduceat(ids, start)
    group = np.repeat(np.arange(len(start)), np.diff(np.r_[start, n]))
    at_best = np.where(ids == best[group], t["keep_rows"].to_numpy(), 0)
    none = np.logical_and.reduceat(null, start)
    return pa.table(
        {
            "at": at[start],
            "sha": t["sha"].take(pa.array(start)),
            "n_bytes": size[start],
            "check": check[start],
            "keep_id": pa.array(best, mask=none),
            "n_rows": np.add.reduceat(t["n_rows"].to_numpy(), start),
            "keep_rows": np.add.reduceat(at_best, start),
        }
    )


def _merge(keep: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last group so far: the next batch may go on with it
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch]).select(_COLUMNS)
            t = pa.Table.from_arrays(t.columns, names=_COLUMNS)  # as what is held: every column nullable
            merged = _merge_table(pa.concat_tables([held, t]) if held is not None else t, keep)
            held = merged.slice(merged.num_rows - 1)
            yield from merged.slice(0, merged.num_rows - 1).to_batches()
        if held is not None:
            yield from held.to_batches()

    return merge


def fingerprints(docs: DataFrame, text: Column, doc_id: str) -> DataFrame:
    """(doc_id, sha, n_bytes, check) of every row; null text counts as empty."""
    t = F.coalesce(text, F.lit(""))
    return docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        F.unhex(F.sha2(t.cast("binary"), 256)).alias("sha"),
        F.octet_length(t).cast("bigint").alias("n_bytes"),
        F.xxhash64(t).alias("check"),
    )


def merge_runs(marks: DataFrame, keep: str = "max", fan_in: int = 16) -> DataFrame:
    """(sha, n_bytes, check, keep_id, n_rows, keep_rows): one row for each distinct text of ``marks``."""
    merge = _merge(keep)
    rounds = max(1, int(np.ceil(np.log(parallelism(marks.sparkSession)) / np.log(fan_in) - 1e-9)))
    radix = int(np.ceil(parallelism(marks.sparkSession) ** (1 / rounds) - 1e-9))
    width = radix**rounds
    one = F.lit(1).cast("bigint")
    run = marks.select((F.spark_partition_id() % width).alias("at"), *_KEY, F.col("doc_id").alias("keep_id"), one.alias("n_rows"), one.alias("keep_rows"))
    run = run.sortWithinPartitions("at", *_KEY).mapInArrow(merge, RUN)
    bucket = F.pmod(F.col("check"), F.lit(width)).cast("int")
    for r in range(rounds):
        low = radix**r
        digit = lambda x, low=low: F.floor(x / low).cast("int") % radix
        run = run.withColumn("at", (F.col("at") - digit(F.col("at")) * low + digit(bucket) * low).cast("int"))
        run = run.repartitionById(width, F.col("at")).sortWithinPartitions("at", *_KEY).mapInArrow(merge, RUN)
    return run.drop("at")


def exact_dedup(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: str = "max",
    normalise: Callable[[Column], Column] = lambda c: c,
    fan_in: int = 16,
) -> DataFrame:
    """One row for every row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, keep_rows.

    ``keep`` is ``max`` or ``min``: the identifier of a group that stays. Null text equals empty
    text. A null identifier stays only where its group has no other. Rows that repeat both
    identifier and text all say ``kept`` (``keep_rows`` counts them; ``drop_duplicates`` leaves
    one). An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    if keep not in ("min", "max"):
        raise ValueError(f"keep must be min or max, not {keep!r}")
    marks = durable(fingerprints(docs, normalise(F.col(text)), doc_id))
    groups = merge_runs(marks, keep, fan_in)
    # Rows of one group may be a third of all: an ordinary sort-merge join, whose hot
    # partitions adaptive execution splits.
    return marks.join(groups, list(_KEY)).select(
        "doc_id",
        "keep_id",
        F.col("n_rows").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "keep_rows",
    )


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of repeated rows, one."""
    stay = exact_dedup(docs, doc_id, text, keep).where("kept")
    keys = durable(stay.select(F.col("doc_id").alias("__keep_id"), F.col("text_sha256").alias("__keep_sha"), F.col("keep_rows").alias("__keep_rows")))
    same = F.col(doc_id).cast("bigint").eqNullSafe(F.col("__keep_id")) & (F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256) == F.col("__keep_sha"))
    once = docs.join(keys.where("__keep_rows = 1"), same).select(docs.columns)
    if keys.where("__keep_rows > 1").isEmpty():
        return once
    again = docs.join(keys.where("__keep_rows > 1").dropDuplicates(), same).dropDuplicates(["__keep_id", "__keep_sha"])
    return once.unionByName(again.select(docs.columns))
