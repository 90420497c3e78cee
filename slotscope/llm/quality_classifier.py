"""A compression classifier: zstandard dictionaries of good and bad labelled text.

Texts are cut into chunks and every chunk is compressed with either dictionary; the difference of
the sizes over their sum says which text it is more like. A logistic curve fitted on labelled
documents that the dictionaries did not see turns the difference into a probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotscope.llm.durable import durable

CHUNK = 4096
LEVEL = 3
#: Bounds of the fit: documents of each class, bytes of text of each class and of
#: one text, bytes of a dictionary.
MOST_DOCUMENTS = 3000
MOST_BYTES = 16 << 20
MOST_TEXT = 64 << 10
DICTIONARY = 112 << 10


@dataclass(frozen=True)
class Classifier:
    good: bytes
    bad: bytes
    slope: float
    offset: float


class Scorer:
    def __init__(self, good: bytes, bad: bytes) -> None:
        self.by = [zstandard.ZstdCompressor(level=LEVEL, dict_data=self._prepared(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (good, bad)]

    @staticmethod
    def _prepared(raw: bytes) -> zstandard.ZstdCompressionDict:
        d = zstandard.ZstdCompressionDict(raw)  # trained or, without their header, raw
        d.precompute_compress(level=LEVEL)
        return d

    def difference(self, text: str | None) -> float:
        """(bad - good) / (bad + good) compressed sizes over all chunks of the whole text; 0 for empty."""
        raw = (text or "").encode()
        good = bad = 0
        for i in range(0, len(raw), CHUNK):
            chunk = raw[i : i + CHUNK]
            good += len(self.by[0].compress(chunk))
            bad += len(self.by[1].compress(chunk))
        return (bad - good) / (bad + good) if raw else 0.0


def held_out(doc_id: Column) -> Column:
    """Whether a row's label is kept from the fit; false for a null identifier, which no label can belong to."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _dictionary(texts: list[bytes]) -> bytes:
    """A dictionary trained on the chunks of all sample texts; of too few, the chunks themselves."""
    chunks = [t[i : i + CHUNK] for t in texts for i in range(0, len(t), CHUNK)]
    chunks = [c for c in chunks if len(c) >= 16]
    try:
        return zstandard.train_dictionary(DICTIONARY, chunks, k=64, d=6).as_bytes()
    except (zstandard.ZstdError, MemoryError):
        return b"".join(chunks)[:DICTIONARY].ljust(16, b"\n")


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method with a small ridge."""
    if not len(x) or len(set(y.tolist())) < 2:
        return 40.0, 0.0
    scale = float(np.std(x)) or 1.0
    z = np.c_[x / scale, np.ones(len(x))]
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag([1e-2, 1e-6]), z.T @ (y - p) - np.array([1e-2, 0]) * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 1e-3) / scale), float(beta[1])


def fit(docs: DataFrame, marks: DataFrame) -> Classifier:
    """From ``docs`` (doc_id, text) and ``marks`` (doc_id, good 0/1).

    The first MOST_DOCUMENTS marks of each class in hash order whose text has at most MOST_TEXT
    bytes are used: half of them make the dictionaries, the other half fits the curve.
    """
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit(3))
    parts = [marks.where(F.col("good") == g).withColumn("o", order).orderBy("o", "doc_id").limit(MOST_DOCUMENTS) for g in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # 2 x MOST_DOCUMENTS rows at most
    sample = durable(docs.join(chosen, "doc_id").where(F.octet_length("text") <= MOST_TEXT).select("good", "o", "text"))

    def build(group: pa.Table) -> pa.Table:
        t = group.sort_by("o")
        good = t["good"][0].as_py()
        taken, size = [], 0
        for x in t["text"].to_pylist():
            raw = (x or "").encode()
            if taken and size + len(raw) > MOST_BYTES // 2:
                break
            taken.append(raw)
            size += len(raw)
        return pa.table({"good": pa.array([good], pa.int32()), "content": pa.array([_dictionary(taken)], pa.binary())})

    half = F.pmod("o", F.lit(2))
    made = {r["good"]: bytes(r["content"]) for r in sample.where(half == 0).select(F.col("good").cast("int").alias("good"), "o", "text").groupBy("good").applyInArrow(build, "good int, content binary").collect()}
    good, bad = made.get(1, b"\n" * 16), made.get(0, b"\n" * 16)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(good, bad)
        for b in batches:
            yield pa.RecordBatch.from_pydict({"good": b.column(0), "x": pa.array([scorer.difference(t) for t in b.column(1).to_pylist()], pa.float64())})

    rows = sample.where(half == 1).select(F.col("good").cast("int").alias("good"), "text").mapInArrow(measure, "good int, x double").collect()
    slope, offset = _logistic(np.array([r["x"] for r in rows], float), np.array([r["good"] for r in rows], float))
    return Classifier(good, bad, slope, offset)


def classify(docs: DataFrame, model: Classifier, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: doc_id, difference, score (0 to 1), predicted (1 if score >= 0.5).

    A null or empty text has difference 0, so its score is the curve's at 0. Repeated rows score
    alike; null identifiers go through; an empty table gives an empty result; other columns are
    ignored. Only the text is an input of the score.
    """
    good, bad, slope, offset = model.good, model.bad, model.slope, model.offset

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(good, bad)
        for b in batches:
            x = [scorer.difference(t) for t in b.column(1).to_pylist()]
            p = [1 / (1 + math.exp(-max(-500.0, min(500.0, slope * v + offset)))) for v in x]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.float64()), pa.array(p, pa.float64()), pa.array([int(v >= 0.5) for v in p], pa.int32())], ["doc_id", "difference", "score", "predicted"])

    return docs.select(F.col(doc_id).cast("bigint"), F.col(text).cast("string")).mapInArrow(score, "doc_id bigint, difference double, score double, predicted int")


def fit_and_classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all ``docs``; labels of the held-out third are never read for the fit."""
    marks = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("quality").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("good"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return classify(docs, fit(rows, marks))
