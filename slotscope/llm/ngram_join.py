"""Near-duplicate documents by a Jaccard join of word shingles with count-vector R-trees.

A document is a set of 64-bit shingle hashes. Hashing the shingles into groups and counting each
group gives a point; the summed minima of two points' coordinates bound the overlap of the sets
from above, and the maxima over a node's points bound it for a whole subtree; the parities of counts
over more groups bound it again for single points. Points meet in
buckets: two sets that are similar enough must share a shingle among the first ``n - ceil(0.8 n) + 1``
of either in one fixed order (frequent shingles last), so no link is lost. It is even among the first
``n - ceil(8 n / 9) + 1`` of the smaller set: only there does a row lead, and pairs whose smaller set
does not lead are left to other buckets. Equal sets count once.

1. In each bucket the smallest document is tried with all others (as many pairs as rows), then
   the one that has most links so far.
2. What these links connect is settled. A bucket too large for one block is divided by the next
   shared shingle (linked sets share at least four), so that sets which share one only part.
   The buckets that still hold several components build an R-tree each, in blocks of bounded size,
   and search it for pairs of different components, in rounds: each row names its likeliest mates
   first, so that what links is soon one component.
3. Every candidate pair is checked on the whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotscope.llm.components import connected_components
from slotscope.llm.durable import durable, release

WORDS = 5
#: Link when PERCENT_OF * overlap >= PERCENT * union.
PERCENT_OF, PERCENT = 100, 80
#: Documents sampled to learn which shingles are frequent (this only fixes an order of shingles).
SAMPLE = 8192
FREQUENT = 6
MOST_FREQUENT = 200_000
#: Dimensions of the vectors in a bucket's tree, points of a node, points of a block.
SHORT, FAN_OUT, BLOCK = 32, 16, 2000
#: Most groups whose counts' parities travel with a point.
PARITIES = 4096
#: Up to so many identifiers (8 bytes each) are broadcast to fetch texts; beyond, the texts are shuffled.
MOST_BROADCAST = 200_000
#: Words that one Python task remembers the hashes of.
REMEMBERED = 100_000
#: Texts that a Python worker holds the sets of at once.
AT_ONCE = 500
#: Partners of one document that a task tries.
PARTNERS = 2000
#: A row names one mate in the first round of the search, and so many times more in each later one.
MORE = 64
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)

_words: dict[bytes, int] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles of a whole text (A-Z lower-cased); of fewer words, of them all."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(_words) > REMEMBERED:
        _words.clear()
        release()
    get, digest = _words.get, xxhash.xxh3_64_intdigest
    codes = []
    for w in words:
        c = get(w)
        if c is None:
            c = _words[w] = digest(w)
        codes.append(c)
    h = np.array(codes, np.uint64)
    if len(h) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    n = len(h) - WORDS + 1
    total = np.zeros(n, np.uint64)
    for k in range(WORDS):
        total += h[k : k + n] * _FACTORS[k]
    return np.unique(_mix(total))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return PERCENT_OF * both >= PERCENT * (len(a) + len(b) - both)


def groups_of(n: int) -> int:
    """Groups of a count vector of ``n`` shingles."""
    return 1 << int(np.clip(np.ceil(np.log2(max(n, 1) / 4)), 6, 12))


def count_vector(s: np.ndarray) -> np.ndarray:
    """Counts of the shingles by hash group; about four shingles a group, 64 to 4096 groups."""
    d = groups_of(len(s))
    return np.bincount((s & np.uint64(d - 1)).astype(np.int64), minlength=d)


def packed(v: np.ndarray) -> bytes:
    """Counts in two bytes each, or in four where one needs them: never clipped, so that bounds hold for any length."""
    return v.astype("<u2" if v.max() < 1 << 16 else "<u4").tobytes()


def unpacked(b: bytes, d: int) -> np.ndarray:
    return np.frombuffer(b, f"<u{len(b) // d}").astype(np.int64)


def fold(v: np.ndarray, d: int) -> np.ndarray:
    """The vector over fewer groups (both powers of two)."""
    return v.reshape(-1, d).astype(np.int64).sum(axis=0)


def parities(s: np.ndarray) -> bytes:
    """Whether each group's count is odd, as bits; two to four groups a shingle, 256 to PARITIES groups.

    Groups of two sets with unlike parities have unlike counts, so their number bounds how many
    shingles the sets don't share from below: over many groups nearly exactly.
    """
    d = 1 << int(np.clip(np.ceil(np.log2(2 * max(len(s), 1))), 8, PARITIES.bit_length() - 1))
    odd = np.bincount((s & np.uint64(d - 1)).astype(np.int64), minlength=d) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Parities:
    """One point's parities over any number of groups up to its own."""

    def __init__(self, bits: bytes) -> None:
        self.by = {8 * len(bits): int.from_bytes(bits, "little")}
        self.most = 8 * len(bits)

    def over(self, d: int) -> int:
        if d not in self.by:
            x = self.over(2 * d)
            self.by[d] = (x >> d) ^ (x & ((1 << d) - 1))
        return self.by[d]

    def unlike(self, other: Parities) -> int:
        d = min(self.most, other.most)
        return (self.over(d) ^ other.over(d)).bit_count()


def may_link(overlap: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether ``overlap`` of sets with summed ``sizes`` would be enough."""
    return (PERCENT_OF + PERCENT) * overlap >= PERCENT * sizes


class CountTree:
    """An R-tree of count vectors, built bottom-up in order of size and position."""

    def __init__(self, n: np.ndarray, points: np.ndarray) -> None:
        self.order = np.lexsort((points[:, 1], points[:, 0], n))
        self.n, self.points = n[self.order], points[self.order]
        self.levels = []  # from the leaves up: (corner, least n, largest n)
        corner, low, high = self.points, self.n, self.n
        while len(corner) > FAN_OUT:
            at = np.arange(0, len(corner), FAN_OUT)
            corner, low, high = np.maximum.reduceat(corner, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((corner, low, high))

    def near(self, i: int) -> np.ndarray:
        """Positions after ``i`` (in tree order) of the points that may link with it."""
        v, n = self.points[i], self.n[i]
        nodes = np.arange(len(self.levels[-1][0])) if self.levels else np.arange(len(self.n))
        for corner, low, high in reversed(self.levels):
            nodes = nodes[nodes < len(low)]
            ok = (PERCENT * n <= PERCENT_OF * high[nodes]) & (PERCENT * low[nodes] <= PERCENT_OF * n)
            nodes = nodes[ok]
            nodes = nodes[may_link(np.minimum(corner[nodes], v).sum(axis=1), n + low[nodes])]
            nodes = (nodes[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
        nodes = nodes[(nodes > i) & (nodes < len(self.n))]
        return nodes[may_link(np.minimum(self.points[nodes], v).sum(axis=1), n + self.n[nodes])]


def frequent_shingles(docs: DataFrame, n_docs: int) -> list[int]:
    """Frequent shingles, rarest first, from a hashed sample of about SAMPLE documents."""
    one_in = max(1, -(-n_docs // SAMPLE))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, AT_ONCE) for x in batches for i in range(0, x.num_rows, AT_ONCE)):
            found = [shingles(t).view(np.int64) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else [], pa.int64())], ["s"])
        _words.clear()
        release()

    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(one_in)) == 0).select("text")
    counted = sample.mapInArrow(sets, "s bigint").groupBy("s").count().where(F.col("count") >= FREQUENT)
    return [r["s"] for r in counted.orderBy(F.desc("count"), "s").limit(MOST_FREQUENT).collect()][::-1]


def document_sets(docs: DataFrame, frequent: list[int]) -> DataFrame:
    """(doc_id, n, digest, vector, short, odd, prefix) of each document; ``short`` is the vector over SHORT groups, ``odd`` its parities.

    ``prefix`` is in the fixed order and one shingle longer than a first shared shingle needs, so that it holds a second one as well.
    """
    ordered = np.array(frequent, np.int64).view(np.uint64)
    by_value = np.argsort(ordered)
    values = ordered[by_value]

    def prefix(s: np.ndarray) -> np.ndarray:
        n = len(s)
        p = min(n, n - -(-PERCENT * n // PERCENT_OF) + 2) if n else 0
        if not len(values):
            return s[:p]
        at = np.minimum(np.searchsorted(values, s), len(values) - 1)
        common = values[at] == s
        rare = s[~common]
        if len(rare) >= p:
            return rare[:p]
        return np.concatenate([rare, ordered[np.sort(by_value[at[common]])[: p - len(rare)]]])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, AT_ONCE) for x in batches for i in range(0, x.num_rows, AT_ONCE)):
            n, digest, vector, short, odd, first = [], [], [], [], [], []
            for t in b.column(1).to_pylist():
                s = shingles(t)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                v = count_vector(s)
                vector.append(packed(v))
                short.append(packed(fold(v, SHORT)))
                odd.append(parities(s))
                first.append(prefix(s).view(np.int64))
            ends = np.cumsum([0, *map(len, first)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(first) if first else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(vector, pa.binary()), pa.array(short, pa.binary()), pa.array(odd, pa.binary()), lists], ["doc_id", "n", "digest", "vector", "short", "odd", "prefix"])
        _words.clear()
        release()

    return docs.mapInArrow(sets, "doc_id bigint, n bigint, digest binary, vector binary, short binary, odd binary, prefix array<bigint>")


def _approved(pairs: DataFrame, held: DataFrame, approve: Callable[[Any, Any], bool]) -> DataFrame:
    """Those of the distinct pairs (a, b) whose ``load``s in ``held`` (doc, load) ``approve`` accepts.

    A task holds one ``a`` and streams its partners past it. The partners of an ``a`` with many are
    dealt into parts of about PARTNERS, so that no hot document makes a task larger than that. Where
    an identifier has several loads, each is tried.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("parts"))
    left = parts.select("a", F.explode(F.sequence(F.lit(1).cast("bigint"), "parts")).alias("part")).join(held, F.col("a") == held["doc"])
    left = left.select("a", "part", F.lit(None).cast("bigint").alias("b"), "load")
    right = pairs.join(parts, "a").select("a", (F.pmod(F.xxhash64("b"), "parts") + 1).alias("part"), "b")
    right = right.join(held, F.col("b") == held["doc"]).select("a", "part", "b", "load")
    met = left.unionByName(right).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, last = None, [], None  # rows come in order, so a pair with several loads comes at one go
        for batch in (x.slice(i, AT_ONCE) for x in batches for i in range(0, x.num_rows, AT_ONCE)):
            keep: list[tuple[int, int]] = []
            for a, part, b, load in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (a, part):
                    at, own = (a, part), []
                if b is None:
                    own.append(load)
                elif last != (a, b) and any(approve(x, load) for x in own):
                    last = (a, b)
                    keep.append(last)
            yield _columns({"a": [k[0] for k in keep], "b": [k[1] for k in keep]})
        _words.clear()
        _sets.held.clear()
        release()

    return met.mapInArrow(stream, "a bigint, b bigint")


def _columns(cols: dict[str, list], kinds: dict[str, pa.DataType] | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, (kinds or {}).get(k, pa.int64())) for k, v in cols.items()], list(cols))


def _may_be_similar(x: dict[str, Any], y: dict[str, Any]) -> bool:
    """Whether two full count vectors leave enough overlap possible."""
    p, q = x["n"], y["n"]
    if PERCENT * p > PERCENT_OF * q or PERCENT * q > PERCENT_OF * p:
        return False
    v, w = unpacked(x["vector"], groups_of(p)), unpacked(y["vector"], groups_of(q))
    d = min(len(v), len(w))
    return bool(may_link(np.minimum(fold(v, d), fold(w, d)).sum(), p + q))


class _Sets:
    """The shingle sets of the last few texts: a partner's is needed once, a holder's again and again."""

    def __init__(self) -> None:
        self.held: dict[str, np.ndarray] = {}

    def of(self, text: str) -> np.ndarray:
        if text not in self.held:
            if len(self.held) >= 4:
                self.held.pop(next(iter(self.held)))
            self.held[text] = shingles(text)
        else:
            self.held[text] = self.held.pop(text)  # the one used last goes last
        return self.held[text]


_sets = _Sets()


def _are_similar(x: str, y: str) -> bool:
    """Whether two whole texts link."""
    return similar(_sets.of(x), _sets.of(y))


def _verified(pairs: DataFrame, rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are similar; ``vectors`` (doc, load) rule some out before texts move."""
    likely = durable(_approved(pairs, vectors, _may_be_similar))
    ids = durable(likely.select(F.explode(F.array("a", "b")).alias("doc")).distinct())
    few = ids.count() <= MOST_BROADCAST
    texts = durable(rows.join(F.broadcast(ids) if few else ids, rows["doc_id"] == ids["doc"]).select("doc", F.coalesce("text", F.lit("")).alias("load")))
    return durable(_approved(likely, texts, _are_similar))


def _leads(position: Column, nth: int) -> Column:
    """Whether the ``nth`` shingle shared with a linked set of ``n`` or more shingles can stand at ``position`` (from 0) of one of ``n``."""
    return position < F.col("n") - F.ceil(2 * PERCENT * F.col("n") / F.lit(PERCENT_OF + PERCENT)) + nth


def prefix_tokens(points: DataFrame) -> DataFrame:
    """(token, doc, lead, at) of the shingles of ``points`` (doc, n, prefix) that can be the first shared one; ``at`` counts from 0."""
    rows = points.select("doc", "n", F.posexplode("prefix").alias("at", "token"))
    first = F.col("at") < F.col("n") - F.ceil(PERCENT * F.col("n") / F.lit(PERCENT_OF)) + 1
    return rows.where(first).select("token", "doc", _leads(F.col("at"), 1).alias("lead"), "at")


def _kinds(placed: DataFrame) -> DataFrame:
    """(token, top, most, size, resting, by_comp) of the buckets in which a row that leads can meet another component.

    No pairs are needed among the rows of the largest component, nor among those that don't lead;
    ``resting`` counts the larger of these two sets, which ``by_comp`` tells.
    """
    kinds = placed.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("n"), F.count_if("lead").alias("leads"))
    of = kinds.groupBy("token").agg(F.max_by("comp", F.struct("n", "comp")).alias("top"), F.max("n").alias("most"), F.sum("n").alias("size"), F.sum("leads").alias("leads"))
    idle = F.col("size") - F.col("leads")
    return of.where("size > most and leads > 0").select("token", "top", "size", F.greatest("most", idle).alias("resting"), (F.col("most") >= idle).alias("by_comp"))


def divided(placed: DataFrame, points: DataFrame) -> DataFrame:
    """``placed`` (token, doc, lead, at, comp), its overfull buckets divided by the second shared shingle.

    ``points`` (doc, n, prefix) give the shingles behind a bucket's own. Linked sets share at least
    four, so in the bucket of the first one they meet again at the second; sets that share no second
    one part. A bucket is divided where more than a block of its rows would be paired and this gives
    fewer rows than copying them to blocks would; what stays large is left to the blocks.
    """
    dealt = lambda n: F.ceil(n / BLOCK)
    busy, resting = F.col("size") - F.col("resting"), F.col("resting")
    wide = _kinds(placed).where(busy > BLOCK).select("token", (busy * (dealt(resting) + dealt(busy)) + resting * dealt(busy)).alias("copies"))
    wide = durable(wide)
    if wide.isEmpty():
        return placed
    rows = placed.join(wide, "token").join(points.select("doc", "n", F.size("prefix").alias("length")), "doc")
    fewer = rows.groupBy("token").agg(F.sum(F.col("length") - F.col("at") - 1).alias("behind"), F.max("copies").alias("copies")).where("behind < copies")
    fewer = durable(fewer.select("token"))
    rows = placed.join(fewer, "token").join(points, "doc")
    behind = rows.select("token", "doc", "n", "lead", "at", "comp", F.posexplode(F.slice("prefix", F.col("at") + 2, F.size("prefix"))).alias("gap", "second"))
    place = F.col("at") + 1 + F.col("gap")
    parted = behind.select(F.xxhash64("token", "second").alias("token"), "doc", (F.col("lead") & _leads(place, 2)).alias("lead"), place.alias("at"), "comp")
    return durable(placed.join(fewer, "token", "left_anti").select(parted.columns).unionByName(parted))


def blocks(placed: DataFrame) -> DataFrame:
    """(token, i, j, own, doc, lead): what meets where, of the rows (token, doc, lead, comp) of buckets with several components.

    The resting rows of a bucket (of its largest component, or all that don't lead) need no pairs
    among themselves. They are dealt into blocks below 0 that meet each block of the others once;
    the others' blocks, from 0 on, meet one another too. In a block (i, j) with ``i != j`` only
    rows of different ``own`` make pairs.
    """
    dealt = lambda n: F.ceil(n / BLOCK)
    rows = placed.join(_kinds(placed), "token").withColumn("others", dealt(F.col("size") - F.col("resting")))
    rests = F.when(F.col("by_comp"), F.col("comp") == F.col("top")).otherwise(~F.col("lead"))
    own = F.when(rests, -1 - F.pmod(F.xxhash64("doc"), dealt(F.col("resting")))).otherwise(F.pmod(F.xxhash64("doc"), F.col("others")))
    first = F.when(rests, F.lit(0).cast("bigint")).otherwise(-dealt(F.col("resting")))
    rows = rows.select("token", "doc", "lead", own.alias("own"), F.explode(F.sequence(first, F.col("others") - 1)).alias("other"))
    return rows.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc", "lead")


def block_pairs(own: np.ndarray, doc: np.ndarray, lead: np.ndarray, comp: np.ndarray, n: np.ndarray, points: np.ndarray, odd: list[bytes], share: np.ndarray, place: np.ndarray, most: int, across: bool) -> list[tuple[int, int, float | None, int | None]]:
    """(doc, mate, share, place): of each row the ``most`` likeliest mates of other components not tried yet.

    With ``across`` only rows of different ``own`` are mates; the smaller set of a pair has to ``lead``.
    Neither the tree nor the parities rule these pairs out. Mates come in order of the largest
    share of their union that the pair may have in common, then of place in the tree; ``share`` and
    ``place`` say, by row, up to where in that order mates have been tried. They are given back
    with the last mate of a row that has more of them, else null.
    """
    tree = CountTree(n, points)
    own, doc, lead, comp, share, place = (x[tree.order] for x in (own, doc, lead, comp, share, place))
    bits: dict[int, Parities] = {}

    def parity(i: int) -> Parities:
        if i not in bits:
            bits[i] = Parities(odd[tree.order[i]])
        return bits[i]

    out = []
    for i in range(len(doc)):
        if share[i] < 0 or not lead[i]:  # those after i in the tree are as large or larger
            continue
        j = tree.near(i)
        j = j[(comp[j] != comp[i]) & (own[j] != own[i])] if across else j[comp[j] != comp[i]]
        if not len(j):
            continue
        sizes = tree.n[i] + tree.n[j]
        unlike = np.fromiter((parity(i).unlike(parity(k)) for k in j.tolist()), np.int64, len(j))
        both = np.minimum((sizes - unlike) // 2, np.minimum(tree.points[j], tree.points[i]).sum(axis=1))
        may = may_link(both, sizes)
        j, likely = j[may], (both / np.maximum(sizes - both, 1))[may]
        ahead = (likely < share[i]) | ((likely == share[i]) & (j > place[i]))
        j, likely = j[ahead], likely[ahead]
        if not len(j):
            continue
        best = np.lexsort((j, -likely))
        chosen, last = j[best[:most]], best[:most][-1]
        more = len(best) > most
        out += [(int(doc[i]), int(doc[k]), None, None) for k in chosen[:-1]]
        out.append((int(doc[i]), int(doc[chosen[-1]]), float(likely[last]) if more else None, int(j[last]) if more else None))
    return out


_FOUND = {"token": pa.int64(), "i": pa.int64(), "j": pa.int64(), "doc": pa.int64(), "mate": pa.int64(), "share": pa.float64(), "place": pa.int64()}


def _searched(rows: DataFrame, most: int) -> DataFrame:
    """(token, i, j, doc, mate, share, place): what block_pairs finds in each block of ``rows``, one count-vector tree a block."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
            key = np.stack([t[c].to_numpy() for c in ("token", "i", "j")])
            cut = np.r_[0, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, t.num_rows]
            own, doc, lead, comp, n, share, place = (t[c].to_numpy() for c in ("own", "doc", "lead", "comp", "n", "share", "place"))
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                if e - s > 1 and (comp[s:e] != comp[s]).any():
                    part = t.slice(s, e - s)
                    points = np.stack([unpacked(v, SHORT) for v in part["short"].to_pylist()])
                    found = block_pairs(own[s:e], doc[s:e], lead[s:e], comp[s:e], n[s:e], points, part["odd"].to_pylist(), share[s:e], place[s:e], most, bool(key[1, s] != key[2, s]))
                    if found:
                        at = [np.full(len(found), k) for k in key[:, s]]
                        yield _columns(dict(zip(_FOUND, (*at, *zip(*found, strict=True)), strict=True)), _FOUND)

        for batch in (x.slice(i, 4 * AT_ONCE) for x in batches for i in range(0, x.num_rows, 4 * AT_ONCE)):
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            last = [t[c][t.num_rows - 1].as_py() for c in ("token", "i", "j")]
            same = np.logical_and.reduce([t[c].to_numpy() == v for c, v in zip(("token", "i", "j"), last, strict=True)])
            first = int(np.argmax(same))  # rows are sorted: the last group is the tail
            if first:
                yield from _joined(pairs(t.slice(0, first).combine_chunks()))
            held = t.slice(first)
        if held is not None:
            yield from _joined(pairs(held.combine_chunks()))
        release()

    placed = rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "doc")
    return placed.mapInArrow(search, "token bigint, i bigint, j bigint, doc bigint, mate bigint, share double, place bigint")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Many small batches as one."""
    if some := list(batches):
        yield from pa.Table.from_batches(some).combine_chunks().to_batches()


def _links(shared: DataFrame, points: DataFrame, rows: DataFrame, known: DataFrame) -> DataFrame:
    """(node, component) of the documents that links reach, from the buckets ``shared`` (token, doc, lead, at, hub, size) of ``points``.

    The trees are searched in rounds: each row names its likeliest mates of other components, 1 in
    the first round and MORE times as many in each later one; what is verified unites components,
    and only blocks whose rows have more mates to name go on. So a round puts out in proportion to
    its rows, a group of near copies is one component after a few rounds, and no pair of different
    components is left out.
    """
    vectors = known.select(F.col("doc_id").alias("doc"), F.struct("n", "vector").alias("load"))
    tried = durable(shared.where("doc != hub").select(F.col("hub").alias("a"), F.col("doc").alias("b")).distinct())
    links = _verified(tried, rows, vectors)
    parts = connected_components(links)
    # with what was found since: a component is its members' links to its smallest
    united = lambda found: connected_components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found))
    named = lambda df: df.join(parts, df["doc"] == parts["node"], "left").withColumn("comp", F.coalesce("component", "doc")).drop("node", "component")
    # a bucket of two has had its only pair tried
    wide = shared.where("size > 2").select("token", "doc", "lead", "at")
    # again with the document that has most links in the bucket: copies of one original link with it rather than with one another
    degree = links.select(F.explode(F.array("a", "b")).alias("doc")).groupBy("doc").agg(F.count(F.lit(1)).alias("degree")).where("degree > 1")
    centre = named(wide.join(degree, "doc")).groupBy("token").agg(F.max_by(F.struct("doc", "comp"), F.struct("degree", -F.col("doc"))).alias("c")).select("token", "c.*")
    centre = centre.select("token", F.col("doc").alias("centre"), F.col("comp").alias("of"))
    again = named(wide).join(centre, "token").where("comp != of").select(F.least("doc", "centre").alias("a"), F.greatest("doc", "centre").alias("b")).distinct()
    again = durable(again.join(tried, ["a", "b"], "left_anti"))
    tried = tried.unionByName(again)
    if not (more := _verified(again, rows, vectors)).isEmpty():
        parts = united(more)
    buckets = divided(named(wide), points)
    met = blocks(buckets).withColumns({"share": F.lit(2.0), "place": F.lit(-1).cast("bigint")})
    most = 1
    while True:
        vectored = named(known.select(F.col("doc_id").alias("doc"), "n", "short", "odd"))
        found = durable(_searched(met.join(vectored, "doc").select("token", "i", "j", "own", "doc", "lead", "comp", "n", "short", "odd", "share", "place"), most))
        pairs = found.select(F.least("doc", "mate").alias("a"), F.greatest("doc", "mate").alias("b")).where("a < b").distinct()
        fresh = durable(pairs.join(tried, ["a", "b"], "left_anti"))
        more = _verified(fresh, rows, vectors)
        if not more.isEmpty():
            parts = united(more)
        going = found.where("share is not null").groupBy("token", "i", "j", "doc").agg(F.max(F.struct("share", (-F.col("place")).alias("back"))).alias("at"))
        going = durable(going.select("token", "i", "j", "doc", "at.share", (-F.col("at.back")).alias("place")))
        if going.isEmpty():
            return parts
        tried = tried.unionByName(fresh)
        met = blocks(buckets.join(going.select("token").distinct(), "token", "left_semi")) if most == 1 else met.drop("share", "place")
        met = met.join(going.select("token", "i", "j").distinct(), ["token", "i", "j"], "left_semi").join(going, ["token", "i", "j", "doc"], "left")
        # a row that has named all its mates only waits to be named by others
        met = durable(met.withColumns({"share": F.coalesce("share", F.lit(-1.0)), "place": F.coalesce("place", F.lit(-1).cast("bigint"))}))
        most *= MORE


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: doc_id, n_shingles, component_id (the smallest doc_id that links reach).

    Null, empty and blank texts have no shingles and link with nothing. Repeated rows are one
    document in the links and a row each in the result; rows that repeat an identifier with other
    texts link whatever either links. A row with a null identifier has a null component and links
    nothing. An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sets = durable(document_sets(rows, frequent_shingles(rows, rows.count())))
    known = sets.where("n > 0 and doc_id is not null")
    groups = durable(known.groupBy("digest", "n").agg(F.min("doc_id").alias("doc")))
    points = known.select("doc_id", "digest", "prefix").join(groups, (known["doc_id"] == groups["doc"]) & (known["digest"] == groups["digest"])).select("doc", "n", "prefix")
    tokens = prefix_tokens(points)
    buckets = tokens.groupBy("token").agg(F.min(F.when(F.col("lead"), F.col("doc"))).alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1 and hub is not null")
    shared = durable(tokens.join(buckets, "token"))
    parts = _links(shared, points, rows, known)
    of_group = groups.join(parts, groups["doc"] == parts["node"], "left").select("digest", F.col("n").alias("size"), F.coalesce("component", "doc").alias("component_id"))
    named = sets.join(of_group, (sets["digest"] == of_group["digest"]) & (sets["n"] == of_group["size"]) & sets["doc_id"].isNotNull(), "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the smallest identifier of their component, with all their columns."""
    kept = near_duplicates(docs, doc_id, text).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, F.col(doc_id).cast("bigint").eqNullSafe(F.col("__kept"))).select(*[docs[c] for c in docs.columns])
