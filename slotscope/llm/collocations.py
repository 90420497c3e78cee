"""Phrase collocations from count streams in prefix and suffix order.

Counts are estimated level by level, as a language model's n-gram streams are: a phrase can occur
often only if all its parts do, so a level counts just the places whose shorter phrases may be
frequent. Those are marked in a bitmap of fixed size. Words are counted as they are. Pairs of
frequent words are first counted by cell, a phrase's cell following from a hash of its words: cells that stay
below the bound hold no frequent pair, and just the pairs of the others, and the longer phrases
made of them, are counted as text. A cell may let a rare phrase through (its exact count then drops
it) but never holds a frequent one back, so counts are exact whatever the number of cells.

The frequent phrases and their counts are then kept sorted. In prefix order the phrases that begin
with a given one follow it, in suffix order those that end with it do; left counts, right counts
and the counts of extensions by one word all come from lockstep merges of sorted streams
(sort-merge joins), never from hash tables of counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotscope.llm.durable import durable, parallelism, release

#: Ends of pieces, each a token of its own; words hold neither these nor blanks and tabs.
TOKENS = r"[.,;:!?\x0A-\x0D]|[^\x20\x09.,;:!?\x0A-\x0D]+"
ENDS = frozenset(".,;:!?\n\x0b\x0c\r")
#: log2 of the cells of a level, a bit each: 16 MB.
BITS = 27
#: Cells of a block: as many as a bucket of Spark's bitmap functions has.
CELLS = 32_768
#: Tokens that are looked at together; a longer text is taken whole.
SLICE = 1 << 21
#: Groups of languages up to this many totals are broadcast.
TOTALS = 10_000
COUNTS = "lang string, m int, phrase string, bit int, c bigint"
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _bits(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) * _MIX >> np.uint64(64 - bits)).astype(np.int64)


def _set(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


class _Places:
    """Tokens of a batch in a row: word codes, hashes of the phrases that begin at each, and where those end."""

    def __init__(self, langs: pa.Array, tokens: pa.ListArray):
        flat = pc.ascii_lower(tokens.flatten())
        coded = flat.dictionary_encode()
        self.words, self.code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        named = self.words.to_pylist()
        end = np.fromiter((w[0] in ENDS for w in named), bool, len(named))
        lang = langs.dictionary_encode()
        self.langs = lang.dictionary
        # Every text ends with an end token, so no phrase goes on into the next text.
        self.lang = np.repeat(lang.indices.to_numpy(zero_copy_only=False).astype(np.int64), pc.list_value_length(tokens).to_numpy(zero_copy_only=False))
        self.valid = ~end[self.code]
        self.word_hash = pd.util.hash_array(np.array(named, dtype=object), categorize=False)[self.code] if named else np.empty(0, np.uint64)
        of_lang = pd.util.hash_array(np.array(self.langs.to_pylist(), dtype=object), categorize=False) if len(self.langs) else np.empty(0, np.uint64)
        self.first_hash = self.word_hash ^ of_lang[self.lang] * _STEP

    def hashes(self, m: int) -> np.ndarray:
        h = self.first_hash
        for j in range(1, m):
            h = h[:-1] * _STEP + self.word_hash[j:]
        return h

    def counted(self, m: int, at: np.ndarray, bits: int) -> pa.RecordBatch:
        """Distinct phrases of ``m`` words that begin at the places ``at``, with their counts; codes are compared, not hashes."""
        ids = self.lang[at] * len(self.words) + self.code[at]
        for j in range(1, m):
            ids = np.unique(ids, return_inverse=True)[1] * len(self.words) + self.code[at + j]
        _, first, n = np.unique(ids, return_index=True, return_counts=True)
        at = at[first]
        parts = [self.words.take(pa.array(self.code[at + j])) for j in range(m)]
        phrase = pc.binary_join_element_wise(*parts, " ")
        return pa.RecordBatch.from_arrays(
            [self.langs.take(pa.array(self.lang[at])), pa.array(np.full(len(at), m, np.int32)), phrase, pa.array(_bits(self.hashes(m)[at], bits).astype(np.int32)), pa.array(n.astype(np.int64))],
            names=["lang", "m", "phrase", "bit", "c"],
        )


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[_Places]:
    """Places of whole texts, some ``SLICE`` tokens at once."""
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column("tokens")).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE, "right")))
            part = batch.slice(start, stop - start)
            yield _Places(part.column("lang"), part.column("tokens"))
            start = stop
    release()


def _good(p: _Places, short: int, bitmap: bytes | None, bits: int) -> np.ndarray:
    """Where phrases of ``short`` words begin that may be frequent."""
    if bitmap is None:
        return p.valid
    good = _set(np.frombuffer(bitmap, np.uint8), _bits(p.hashes(short), bits))
    for j in range(short):
        good &= p.valid[j : len(good) + j]
    return good


def _level(orders: range, short: int, bitmap: bytes | None, bits: int):
    """Counts of the phrases of ``orders`` words; ``bitmap`` has those of ``short`` words that may be frequent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in _slices(batches):
            good, held = _good(p, short, bitmap, bits), short
            for m in orders:
                while held < m:
                    good, held = good[:-1] & good[1:], held + 1
                at = np.flatnonzero(good)
                if len(at):
                    yield p.counted(m, at, bits)

    return count


def _cells(m: int, bitmap: bytes, bits: int):
    """How many phrases of ``m`` words fall in each of 2 ** bits cells: a row for each block of cells, its cells and counts packed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in _slices(batches):
            good = _good(p, m - 1, bitmap, bits)
            cell, n = np.unique(_bits(p.hashes(m)[np.flatnonzero(good[:-1] & good[1:])], bits), return_counts=True)
            block = cell // CELLS
            first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(cell) else np.empty(0, np.int64)
            ends = np.r_[first, len(cell)].astype(np.int32)
            packed = lambda x, width, ends=ends, first=first: pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends * np.int32(width)), pa.py_buffer(x)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(block[first].astype(np.int32)), packed((cell % CELLS).astype("<u2"), 2), packed(n.astype("<u4"), 4)], names=["block", "cells", "counts"]
            )

    return count


def _full_cells(least: int):
    """Of rows sorted by block: the cells of each block that come to ``least``, as a bitmap."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, np.zeros(CELLS, np.int64)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([held + 1], pa.int64()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], names=["bucket", "bits"])

        for batch in batches:
            for block, cells, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "cells", "counts")), strict=True):
                if block != held:
                    if held is not None:
                        yield done()
                    held, total[:] = block, 0
                total[np.frombuffer(cells, "<u2")] += np.frombuffer(counts, "<u4")  # a row names a cell once
        if held is not None:
            yield done()

    return add


def _bitmap(found: DataFrame, bits: int) -> bytes:
    """Rows (bucket, bits) of 4096 bytes each as one bitmap: at most 2 ** bits / 8 bytes, whatever was counted."""
    whole = bytearray((1 << bits) // 8)
    for row in found.collect():
        whole[(row["bucket"] - 1) * CELLS // 8 : row["bucket"] * CELLS // 8] = row["bits"]
    return bytes(whole)


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = 100, max_words: int = 5, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """Counts (lang, m, phrase, f) of all phrases with at least ``min_count`` occurrences, and totals (lang, n)."""
    tokens = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
        F.regexp_extract_all(F.concat(F.coalesce(F.col(text), F.lit("")), F.lit("\n")), F.lit(TOKENS), F.lit(0)).alias("tokens"),
    )
    summed = lambda found: found.groupBy("lang", "m", "phrase").agg(F.first("bit").alias("bit"), F.sum("c").alias("f"))
    words = durable(summed(tokens.mapInArrow(_level(range(1, 2), 1, None, bits), COUNTS)))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    often = F.col("f") >= min_count
    counts = words.where(often)
    if max_words > 1:
        at = F.col("bit").cast("bigint") + 1
        known = counts.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
        cells = tokens.mapInArrow(_cells(2, _bitmap(known, bits), bits), "block int, cells binary, counts binary")
        cells = cells.repartition(parallelism(docs.sparkSession), "block").sortWithinPartitions("block")
        pairs = _bitmap(cells.mapInArrow(_full_cells(min_count), "bucket bigint, bits binary"), bits)
        counts = counts.unionByName(durable(summed(tokens.mapInArrow(_level(range(2, max_words + 1), 2, pairs, bits), COUNTS)).where(often)))
    return counts.drop("bit"), totals


def _words(first: Column | int, n: Column | int, m: str = "words") -> Column:
    return F.array_join(F.slice(m, first, n), " ")


def top_collocations(counts: DataFrame, totals: DataFrame, top: int = 2000, ratio: int = 100) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best ``top`` phrases of two words or more.

    A phrase goes if an extension, of at least ``ratio`` % of its count, is in ``counts``. It is
    enough to look at extensions by one word, as those are as frequent as any longer one. Products
    are decimals of 38 digits.
    """
    phrases = counts.where("m >= 2").select("lang", "phrase", F.col("f").alias("a"), "m", F.split("phrase", " ").alias("words"))
    m = F.col("m")
    # Extension counts: the longer stream in prefix order and in suffix order, each cut by a word, beside the shorter one.
    longer = phrases.where("m > 2").select("lang", F.col("a").alias("ext"), F.explode(F.array(_words(1, m - 1), _words(2, m - 1))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("ext").alias("ext"))
    kept = phrases.join(longer.hint("merge"), ["lang", "phrase"], "left").where("ext IS NULL OR 100 * ext < {} * a".format(int(ratio)))
    cuts = kept.select("lang", "phrase", "a", F.explode(F.transform(F.sequence(F.lit(1), m - 1), lambda k: F.struct(k.alias("k"), _words(1, k).alias("left"), _words(k + 1, m - k).alias("right")))).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut.*")
    side = lambda name, count: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(count)).hint("merge")
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    totals = durable(totals)
    cuts = cuts.join(F.broadcast(totals) if totals.count() <= TOTALS else totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.withColumns({"above": 1000 * wide("a") * wide("n"), "below": wide("l") * wide("r")}).withColumn("score", F.expr("above div below"))
    low = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    best = low.select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return best.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def mine_collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = 100, max_words: int = 5, top: int = 2000, ratio: int = 100, bits: int = BITS) -> DataFrame:
    """``top_collocations`` of the phrases of ``docs``.

    Null and empty texts have no words, a null language is ``und``; very long texts are read whole,
    repeated rows count each time, other columns are ignored, an empty table gives no rows. Equal
    scores go by count, then by the phrase's UTF-8 bytes. ``bits`` (15 or more) sets the size of the
    bitmaps and changes no result.
    """
    return top_collocations(*phrase_counts(docs, text, lang, min_count, max_words, bits), top, ratio)
