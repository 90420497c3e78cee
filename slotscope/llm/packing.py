"""Best-fit packing of tokenised documents into sequences under several capacities.

Tokens are counted once, in Arrow batches. Pieces are dealt by hash into groups of a bounded number
of pieces, and each group is packed by vector best fit: longest piece first, into the open sequence
where the weighted norm of what is left of its token, document-count and attention-cost capacities
is least, among those where all three suffice. Sequences that end up with room are opened again
and their pieces packed once more, together with those of other groups.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotscope.llm.durable import durable, release

END = 1
#: Pieces dealt to one group on average.
GROUP = 4096
#: Words that one Python worker remembers the tokens of.
REMEMBERED = 400_000
#: Words that it remembers from one task to the next.
KEPT = 50_000
#: Stands between words while they are learned; texts that hold it go through the tokenizer whole.
_MARK = "\x01"
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds; ``weights`` (tokens, documents, attention) enter the residual norm."""

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)


class _Codes(dict):
    """Numbers words as they are met; ``fresh`` are those not learned yet."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.fresh.append(word)
        self[word] = n = len(self)
        return n


class WordTokenizer:
    """Token ids of whole texts from remembered words.

    The vocabulary drops white space and never merges over it, nor between a letter or digit and
    the punctuation after it, so a text's ids are those of its words and their closing punctuation
    in turn; each distinct one goes through the tokenizer once. Texts with special tokens' strings
    are given to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark gives each task a core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        if len(mark) != 1:
            raise ValueError("the mark between words must be one token")
        self.mark = mark[0]
        self.code = _Codes()
        self.flat = np.empty(0, np.uint32)
        self.start = np.zeros(1, np.int64)
        self.uses = np.zeros(0, np.int64)
        self.asleep = b""

    def _count(self, codes: list[np.ndarray | None]) -> None:
        """Adds up how often each word was met."""
        met = np.bincount(np.concatenate([c for c in codes if c is not None] or [np.empty(0, np.int64)]), minlength=len(self.code))
        met[: len(self.uses)] += self.uses
        self.uses = met

    def forget(self, most: int) -> None:
        """Keeps the ``most`` words that were used most since it last forgot, of those met twice or more."""
        often = np.argsort(-self.uses, kind="stable")[:most]
        keep = np.sort(often[self.uses[often] > 1])
        words = list(self.code)
        self.code = _Codes()
        self.code.update({words[k]: n for n, k in enumerate(keep.tolist())})
        first, n = self.start[keep], np.diff(self.start)[keep]
        stop = np.cumsum(n)
        self.flat = self.flat[np.arange(int(n.sum())) + np.repeat(first - stop + n, n)]
        self.start = np.r_[0, stop]
        self.uses = np.zeros(len(keep), np.int64)

    def _ask(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word) from the tokenizer."""
        parts, sizes, answers = [np.empty(0, np.uint32)], [np.empty(0, np.int64)], []
        lots = [words[i : i + 256] for i in range(0, len(words), 256)]
        for at in range(0, len(lots), 16):
            asked = [f" {_MARK} ".join(w.decode() for w in some) for some in lots[at : at + 16]]
            answers.extend(np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(asked, add_special_tokens=False))
        for some, ids in zip(lots, answers, strict=True):
            cut = np.r_[np.flatnonzero(ids == self.mark), len(ids)]
            if len(cut) != len(some):
                raise ValueError("a word gave the mark's id")
            parts.append(ids[ids != self.mark])
            sizes.append(np.diff(np.r_[-1, cut]) - 1)
        return np.concatenate(parts), np.concatenate(sizes)

    def rest(self) -> None:
        """Between tasks: what is kept lies in one string, so that the memory of all others is free for other stages."""
        self.forget(KEPT)
        self.asleep, self.code = b" ".join(self.code), _Codes()

    def _wake(self) -> None:
        if self.asleep:
            self.code.update({w: n for n, w in enumerate(self.asleep.split())})
            self.asleep = b""

    def _learn(self) -> None:
        """Ids of all fresh words, in the order of their numbers."""
        code = self.code
        known = len(code) - len(code.fresh)
        simple: dict[bytes, int] = {}  # what the tokenizer is asked
        stem, tail = [], []  # of each fresh word: places in ``simple``, or -1 - number of a known word
        place = lambda w: -1 - n if (n := code.get(w, known)) < known else simple.setdefault(w, len(simple))
        for w in code.fresh:
            bare = w.rstrip(_PUNCTUATION)
            if len(bare) < len(w) and bare and (bare[-1:].isalnum() or bare.decode()[-1].isalpha()):
                stem.append(place(bare))
                tail.append(place(w[len(bare) :]))
            else:
                stem.append(simple.setdefault(w, len(simple)))
                tail.append(None)
        ids, size = self._ask(list(simple))
        begin = np.r_[0, np.cumsum(size)]
        base = len(self.flat)
        flat = np.concatenate([self.flat, ids])  # learned ids, then those just asked for

        def span(p: int) -> tuple[int, int]:
            return (int(self.start[-1 - p]), int(self.start[-p])) if p < 0 else (base + int(begin[p]), base + int(begin[p + 1]))

        first, last = [], []
        ends = []
        total = int(self.start[-1])
        for s, t in zip(stem, tail, strict=True):
            for p in (s,) if t is None else (s, t):
                lo, hi = span(p)
                first.append(lo)
                last.append(hi)
                total += hi - lo
            ends.append(total)
        n = np.array(last) - np.array(first)
        stop = np.cumsum(n)
        self.flat = np.concatenate([self.flat, flat[np.arange(int(stop[-1])) + np.repeat(np.array(first) - stop + n, n)]])
        self.start = np.concatenate([self.start, ends])
        code.fresh = []

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, without any special tokens added."""
        self._wake()
        if len(self.code) > REMEMBERED:
            self.forget(REMEMBERED // 2)
        number = self.code.__getitem__
        coded: list[np.ndarray | None] = []
        for t in texts:
            if t and ("<|" in t or _MARK in t):
                coded.append(None)
                continue
            words = (t or "").encode().lower().split()  # of bytes: touches ASCII only
            coded.append(np.fromiter(map(number, words), np.int64, len(words)))
        if self.code.fresh:
            self._learn()
        self._count(coded)
        out = []
        for t, c in zip(texts, coded, strict=True):
            if c is None:
                out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32))
                continue
            first, n = self.start[c], self.start[c + 1] - self.start[c]
            stop = np.cumsum(n)
            total = int(stop[-1]) if len(stop) else 0
            out.append(self.flat[np.arange(total) + np.repeat(first - stop + n, n)])
        return out


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker, kept from task to task."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pieces_of(docs: DataFrame, tokenizer: str, tokens: int = 4096, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and the end id, cut every ``tokens``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                kept = []
                for i, ids in zip(part.column(0).to_pylist(), t.encode(part.column(1).to_pylist()), strict=True):
                    ids = np.append(ids, np.uint32(END)).astype("<u4")
                    for piece, s in enumerate(range(0, len(ids), tokens)):
                        own = ids[s : s + tokens]
                        rows.append((i, piece, s, len(own), zlib.crc32(own.tobytes())))
                        if with_ids:
                            kept.append(own.astype(np.int32))
                cols = list(zip(*rows, strict=True))
                arrays = [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)
        t.rest()
        release()

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return docs.select(F.col(doc_id).cast("bigint"), F.col(text).cast("string")).mapInArrow(cut, schema)


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; ``lengths`` in descending order, none over the capacity."""
    n = len(lengths)
    size = np.array([capacity.tokens, capacity.documents, capacity.attention], float)
    weight = np.array(capacity.weights) / np.square(size)
    left = np.empty((3, n))
    bins = 0
    where, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    live = np.empty(0, np.int64)  # sequences with room
    for i, length in enumerate(lengths):
        need = np.array([length, 1, float(length) * length])
        rest = left[:, live] - need[:, None]
        fits = (rest >= 0).all(axis=0)
        if fits.any():
            norm = np.where(fits, weight @ np.square(rest), np.inf)
            b = live[int(np.argmin(norm))]
        else:
            b = bins
            bins += 1
            left[:, b] = size
            live = np.append(live, b)
        where[i], offset[i] = b, capacity.tokens - int(left[0, b])
        left[:, b] -= need
        if left[0, b] <= 0 or left[1, b] <= 0:
            live = live[live != b]
    return where, offset


def _pack(pieces: DataFrame, capacity: Capacity, n: int, salt: int) -> DataFrame:
    """``pieces`` with sequence_id, offset and used (tokens of the sequence); ``salt`` is the ids' lowest bit."""
    groups = max(1, round(n / GROUP))
    room = 1 << 24

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        where, offset = best_fit(t["length"].to_numpy(), capacity)
        used = np.bincount(where, weights=t["length"].to_numpy())[where].astype(np.int64)
        sequence = 2 * (where + t["group"][0].as_py() * room) + salt
        t = t.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).append_column("used", pa.array(used))
        return t.drop_columns(["group"])

    fields = pieces.schema.simpleString()[len("struct<") : -1]
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(salt)), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(pack, f"{fields},sequence_id:bigint,offset:bigint,used:bigint")


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    capacity: Capacity = Capacity(),
    doc_id: str = "doc_id",
    text: str = "text",
    slack: float = 0.01,
    with_ids: bool = False,
) -> DataFrame:
    """For every piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A null or empty text is a piece with the end id alone. Repeated rows are documents of their
    own; null identifiers go through; an empty table gives an empty result; other columns are
    ignored. ``slack``: sequences with a larger free share are packed again.
    """
    pieces = durable(pieces_of(docs, tokenizer, capacity.tokens, doc_id, text, with_ids))
    once = durable(_pack(pieces, capacity, pieces.count(), 0))
    full = once.where(F.col("used") >= (1 - slack) * capacity.tokens)
    rest = once.where(F.col("used") < (1 - slack) * capacity.tokens).drop("sequence_id", "offset", "used")
    again = _pack(rest, capacity, rest.count(), 1)
    columns = [*pieces.columns[:5], "sequence_id", "offset", *pieces.columns[5:]]
    return full.select(columns).unionByName(again.select(columns))
