"""Exact substring deduplication over the corpus by suffix sorting.

Every string of LENGTH bytes holds an anchor: the GRAM-byte string with the smallest hash among its
own, the leftmost of equal ones, so equal strings hold equal anchors at the same place. Only anchors
that occur more than once matter. Each is looked at in its context, the bytes that a string of
LENGTH bytes around it can reach; equal contexts are one class. A class with several occurrences is
repeated as a whole. Where an anchor has several classes, their bytes are cut at the columns in which
any two of them part, each piece becomes a symbol, and a suffix array over the classes' symbols,
built by Lyndon-prefix groups, shows the longest run that each suffix shares: runs of LENGTH bytes
or more are repeated. Anchors with more classes than a task's share are searched string by
string instead, by counting hashes in Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotscope.llm.durable import durable, parallelism
from slotscope.llm.suffix_sort import longest_shared, suffix_array

LENGTH, GRAM = 200, 50
REACH = LENGTH - GRAM
#: Symbols sorted at once; classes of one anchor that a task takes in any case.
SORTED_AT_ONCE, LEAST_SHARE = 100_000, 256
_BLOCK = 1 << 20
_FACTOR = 0x9E3779B97F4A7C15
_POWERS = np.cumprod(np.full(_BLOCK + 2 * LENGTH, np.uint64(_FACTOR)))
_INVERSES = np.cumprod(np.full(_BLOCK + 2 * LENGTH, np.uint64(pow(_FACTOR, -1, 1 << 64))))
_PLACE = np.uint64((1 << 24) - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


class Hashes:
    """Hashes of any substrings of a block of at most _BLOCK + 2 LENGTH bytes."""

    def __init__(self, raw: np.ndarray) -> None:
        n = len(raw)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _POWERS[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * _INVERSES[start] + (end - start).astype(np.uint64))


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, anchor hash, context hash) of a text's anchors; none in texts under LENGTH bytes."""
    n = len(raw)
    found = []
    for b in range(0, max(n - LENGTH + 1, 0), _BLOCK - 2 * LENGTH):
        # strings that start in [b, b + _BLOCK - 2 LENGTH); contexts reach REACH further either way
        lo, hi = max(b - REACH, 0), min(b + _BLOCK, n)
        part = raw[lo:hi]
        h = Hashes(part)
        strings = min(b + _BLOCK - 2 * LENGTH, n - LENGTH + 1) - b
        grams = np.arange(b - lo, b - lo + strings + REACH)
        g = h.of(grams, grams + GRAM)
        v = (g & ~_PLACE) | np.arange(len(g), dtype=np.uint64)
        width, least = 1, v
        while width * 2 <= REACH + 1:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[:strings], least[REACH + 1 - width : REACH + 1 - width + strings])
        at = (least[np.r_[True, least[1:] != least[:-1]]] & _PLACE).astype(np.int64)
        pos = at + (b - lo)
        left, right = np.minimum(pos + lo, REACH), np.minimum(n - lo - pos, LENGTH)
        context = _mix(h.of(pos - left, pos + right) + left.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        found.append((pos + lo, g[at], context))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    pos, g, context = (np.concatenate(x) for x in zip(*found, strict=True))
    once = np.unique(pos, return_index=True)[1]  # neighbouring blocks share some
    return pos[once], g[once], context[once]


def _bytes_of(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8)


def document_anchors(docs: DataFrame) -> DataFrame:
    """(doc, anchor, context, place) of each row of (doc, text), arrays in order of position.

    A place is 256 times the position plus the bytes of context from there on, of which there are
    LENGTH unless the text ends before.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = []
            for t in batch.column(1).to_pylist():
                raw = _bytes_of(t)
                pos, anchor, context = anchors(raw)
                cols.append((anchor.view(np.int64), context.view(np.int64), pos * 256 + np.minimum(len(raw) - pos, LENGTH)))
            ends = pa.array(np.cumsum([0, *(len(c[0]) for c in cols)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([c[k] for c in cols]) if cols else [], pa.int64())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["doc", "anchor", "context", "place"])

    return docs.mapInArrow(find, f"doc {_kind(docs)}, anchor array<bigint>, context array<bigint>, place array<bigint>")


def _kind(docs: DataFrame) -> str:
    return docs.schema["doc"].dataType.simpleString()


def _packed(docs: DataFrame) -> DataFrame:
    """(doc, packed): the texts compressed, as they travel between executors."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([z.compress((t or "").encode()) for t in batch.column(1).to_pylist()], pa.binary())], ["doc", "packed"])

    return docs.mapInArrow(pack, f"doc {_kind(docs)}, packed binary")


def _extents(strings: list[bytes], reach: int) -> tuple[list[int], np.ndarray]:
    """How far sorted neighbours agree (all lengths at which any two part), and each string's longest."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    size = np.array([len(strings[i]) for i in order])
    table = np.array([strings[i] for i in order], dtype=f"S{reach}").view(np.uint8).reshape(len(order), reach)
    differ = table[1:] != table[:-1]
    agree = np.where(differ.any(axis=1), differ.argmax(axis=1), reach)
    agree = np.minimum(agree, np.minimum(size[1:], size[:-1]))
    longest = np.zeros(len(order), np.int64)
    longest[order] = np.maximum(np.r_[0, agree], np.r_[agree, 0])
    return sorted(set(agree.tolist())), longest


class Repeats:
    """Collects the classes of many anchors as symbols and sorts their suffixes together."""

    def __init__(self) -> None:
        self.symbols: list[int] = []
        self.spans: list[tuple[int, int, list[int]]] = []  # (class, first symbol, cuts)
        self.known: dict[tuple[int, int, bytes], int] = {}
        self.separators = 0

    def add(self, anchor: int, classes: list[int], left: list[int], contexts: list[bytes]) -> None:
        to_left = [c[:k][::-1] for c, k in zip(contexts, left, strict=True)]
        to_right = [c[k:] for c, k in zip(contexts, left, strict=True)]
        cuts_left, far_left = _extents(to_left, REACH)
        cuts_right, far_right = _extents(to_right, LENGTH)
        cuts = sorted({*(-x for x in cuts_left), *cuts_right})
        enough = far_left + far_right >= LENGTH
        if enough.sum() < 2:
            return
        for i in np.flatnonzero(enough):
            c, k = contexts[i], left[i]
            own = [-int(far_left[i]), *(x for x in cuts if -far_left[i] < x < far_right[i]), int(far_right[i])]
            own = sorted(set(own))
            self.spans.append((classes[i], len(self.symbols), own))
            for lo, hi in zip(own[:-1], own[1:], strict=True):
                self.symbols.append(self.known.setdefault((anchor, lo, c[k + lo : k + hi]), len(self.known) + 1))
            self.separators -= 1
            self.symbols.append(self.separators)

    def solve(self) -> Iterator[tuple[int, int, int]]:
        """(class, from, to): repeated stretches, relative to the anchor's position."""
        if self.symbols:
            symbols = np.array(self.symbols, np.int64)
            shared = longest_shared(symbols, suffix_array(symbols))
            for name, first, cuts in self.spans:
                reached = None
                for b in range(len(cuts) - 1):
                    end = cuts[min(b + shared[first + b], len(cuts) - 1)]
                    if end - cuts[b] >= LENGTH:
                        if reached is not None and cuts[b] <= reached[1]:
                            reached = (reached[0], max(reached[1], end))
                        else:
                            if reached is not None:
                                yield (name, *reached)
                            reached = (cuts[b], end)
                if reached is not None:
                    yield (name, *reached)
        self.__init__()


def _solve(rows: DataFrame) -> DataFrame:
    """(anchor, context, lo, hi) from the classes (anchor, context, left, bytes) of anchors with several."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeats = Repeats()
        names: list[tuple[int, int]] = []
        group: list[tuple[int, int, bytes]] = []  # (context, left, bytes) of the anchor so far
        anchor = None

        def flush() -> pa.RecordBatch:
            rows = [(*names[i], lo, hi) for i, lo, hi in repeats.solve()]
            names.clear()
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["anchor", "context", "lo", "hi"])

        def close() -> None:
            if len(group) > 1:
                at = len(names)
                names.extend((anchor, g[0]) for g in group)
                repeats.add(anchor, list(range(at, len(names))), [g[1] for g in group], [g[2] for g in group])
            group.clear()

        for batch in batches:
            for a, context, left, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if a != anchor:
                    close()
                    anchor = a
                    if len(repeats.symbols) > SORTED_AT_ONCE:
                        yield flush()
                group.append((context, left, raw))
        close()
        yield flush()

    placed = rows.select("anchor", "context", "left", "bytes").repartition("anchor").sortWithinPartitions("anchor", "context")
    return placed.mapInArrow(solve, "anchor bigint, context bigint, lo bigint, hi bigint")


def _count_strings(rows: DataFrame) -> DataFrame:
    """As _solve, for anchors with very many classes: every string of LENGTH bytes counted by its hash."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            cols: list[list] = [[], [], [], []]
            for a, context, left, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                start = np.arange(len(raw) - LENGTH + 1)
                h = Hashes(np.frombuffer(raw, np.uint8)).of(start, start + LENGTH).view(np.int64)
                for c, v in zip(cols, (np.full(len(start), a), np.full(len(start), context), start - left, h), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in cols], ["anchor", "context", "lo", "h"])

    found = durable(rows.where(F.octet_length("bytes") >= LENGTH).select("anchor", "context", "left", "bytes").mapInArrow(strings, "anchor bigint, context bigint, lo bigint, h bigint"))
    again = found.groupBy("anchor", "lo", "h").count().where("count > 1").drop("count")
    # at most REACH + 1 starts a class, joined where they overlap or touch
    starts = found.join(again, ["anchor", "lo", "h"]).groupBy("anchor", "context").agg(F.sort_array(F.collect_set("lo")).alias("a"))
    apart = lambda i: F.get("a", i) - F.get("a", i - 1) > LENGTH
    lo = F.filter("a", lambda x, i: (i == 0) | apart(i))
    hi = F.transform(F.filter("a", lambda x, i: (i == F.size("a") - 1) | apart(i + 1)), lambda x: x + LENGTH)
    return starts.select("anchor", "context", F.explode(F.arrays_zip(lo.alias("lo"), hi.alias("hi"))).alias("s")).select("anchor", "context", "s.lo", "s.hi")


def _fetch(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """(anchor, context, left, bytes) of the classes in ``mixed`` (anchor, context, doc, place)."""
    of_doc = mixed.groupBy("doc").agg(F.collect_list("anchor").alias("a"), F.collect_list("context").alias("c"), F.collect_list("place").alias("p"))  # bounded by a text's own length

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in (b.slice(i, 100) for b in batches for i in range(0, b.num_rows, 100)):
            cols: list[list] = [[] for _ in range(4)]
            for packed, *wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = z.decompress(packed)
                for a, c, p in zip(*wanted, strict=True):
                    pos, right = divmod(p, 256)
                    left = min(pos, REACH)
                    for out, v in zip(cols, (a, c, left, raw[pos - left : pos + right]), strict=True):
                        out.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["anchor", "context", "left", "bytes"])

    return _packed(docs).join(of_doc, "doc").select("packed", "a", "c", "p").mapInArrow(fetch, "anchor bigint, context bigint, left bigint, bytes binary")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, lo, hi): stretches of the texts of ``docs`` (doc, text) that are repeated; they may overlap."""
    marks = durable(document_anchors(docs))
    found = marks.select("doc", F.explode(F.arrays_zip("anchor", "context", "place")).alias("f")).select("doc", "f.*")
    several = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    seen = durable(found.join(several, "anchor"))
    del marks, found, several  # nothing holds their stored rows from here on: Spark may drop them
    classes = durable(seen.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "place")).alias("one")).select("anchor", "context", "n", "one.*"))
    kinds = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    mixed = durable(classes.join(kinds, "anchor").select("anchor", "context", "kinds", "doc", "place"))

    share = max(LEAST_SHARE, 3 * mixed.count() // parallelism(docs.sparkSession))
    solved = _solve(_fetch(docs, mixed.where(F.col("kinds") <= share)))
    if not mixed.where(F.col("kinds") > share).isEmpty():
        solved = solved.unionByName(_count_strings(_fetch(docs, mixed.where(F.col("kinds") > share))))

    pos = F.shiftright("place", 8)
    lo, hi = -F.least(pos, F.lit(REACH)), F.col("place") % 256
    whole = classes.where("n > 1").select("anchor", "context", lo.alias("lo"), hi.alias("hi")).where(F.col("hi") - F.col("lo") >= LENGTH)
    spans = solved.unionByName(whole).groupBy("anchor", "context").agg(F.collect_list(F.struct("lo", "hi")).alias("s"))
    placed = seen.join(spans, ["anchor", "context"]).select("doc", pos.alias("pos"), F.explode("s").alias("s"))
    return placed.select("doc", (F.col("pos") + F.col("s.lo")).alias("lo"), (F.col("pos") + F.col("s.hi")).alias("hi"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """For every row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the bytes left).

    Every byte covered by a LENGTH-byte string that also starts elsewhere, in the same or another
    row, is removed, judged on the input. Null text counts as empty. Repeated rows repeat each
    other, so their long texts go. Null identifiers go through. An empty table gives an empty
    result; other columns are ignored.
    """
    named = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ids = named.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("k")).first()
    # where identifiers repeat or are null, rows are told apart by identifier and text
    key = F.col("doc_id") if ids["n"] == ids["k"] else F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    rows = named.select("doc_id", key.alias("doc"), "text")
    docs = rows.select("doc", "text")
    spans = repeated_spans(docs).groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            cols: list[list] = [[] for _ in range(5)]
            for packed, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = z.decompress(packed)
                kept, at, removed, n = [], 0, 0, 0
                end = -1
                for s in spans or ():
                    if s["lo"] > end:
                        n += 1
                        kept.append(raw[at : s["lo"]])
                        removed += s["hi"] - s["lo"]
                    elif s["hi"] > end:
                        removed += s["hi"] - end
                    end = max(end, s["hi"])
                    at = end
                kept.append(raw[at:])
                left = b"".join(kept)
                for c, v in zip(cols, (len(raw), removed, n, hashlib.sha256(left).hexdigest(), left if with_text else None), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    own = F.col("doc") if ids["n"] == ids["k"] else F.col("doc.id")
    out = _packed(docs).join(spans, "doc", "left").select(own.alias("doc_id"), "packed", "spans").mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    return out if with_text else out.drop("kept")
