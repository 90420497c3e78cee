"""Quality rules as a short-circuit cascade.

A rule is a cheap test of one whole text. On a hashed sample every rule is run on every text, which
gives its cost (seconds a text) and its selectivity (share rejected). The rules are then ordered by
rejection per cost, and on the whole table each text runs through them until the first rejects it.
The order changes only the time, never the verdict: a text is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotscope.llm.durable import release

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: Texts that a Python worker holds at once.
AT_ONCE = 500


class Text:
    """One whole text and its measures, each computed when first asked for."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""
        self.raw = self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # bytes.split: exactly the six ASCII white-space characters

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - (len(self.raw) - len(self.raw.translate(None, SPACE)))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip(SPACE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def codes(self) -> np.ndarray:
        """The words as numbers below the number of distinct words."""
        seen: dict[bytes, int] = {}
        return np.fromiter((seen.setdefault(w, len(seen)) for w in self.words), np.int64, len(self.words))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words that lie in a window of five words found twice or more."""
        n = len(self.words) - WINDOW + 1
        if n < 2:
            return 0
        codes = self.codes
        v = int(codes.max()) + 1
        if v**WINDOW < 2**63:
            key = codes[:n].copy()
            for k in range(1, WINDOW):
                key = key * v + codes[k : k + n]
        else:  # three words as one number first, so that nothing overflows
            m = len(codes) - 2
            triple = np.unique((codes[:m] * v + codes[1 : m + 1]) * v + codes[2:], return_inverse=True)[1] if v**3 < 2**63 else _ranks(codes, m)
            pair = np.unique(codes[:-1] * v + codes[1:], return_inverse=True)[1]
            key = triple[:n] * (int(pair.max()) + 1) + pair[3 : 3 + n]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        if not same.any():
            return 0
        again = np.zeros(n, bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        edge = np.zeros(len(codes) + 1, np.int64)
        np.add.at(edge, np.flatnonzero(again), 1)
        np.add.at(edge, np.flatnonzero(again) + WINDOW, -1)
        return int((np.cumsum(edge[:-1]) > 0).sum())

    @cached_property
    def top_word(self) -> int:
        return int(np.bincount(self.codes).max()) if self.words else 0

    @cached_property
    def case(self) -> tuple[int, int]:
        """ASCII capitals and small letters."""
        counts = np.bincount(np.frombuffer(self.raw, np.uint8), minlength=256)
        return int(counts[65:91].sum()), int(counts[97:123].sum())


def _ranks(codes: np.ndarray, m: int) -> np.ndarray:
    v = int(codes.max()) + 1
    pair = np.unique(codes[:-1] * v + codes[1:], return_inverse=True)[1]
    return np.unique(pair[:m] * v + codes[2:], return_inverse=True)[1]


@dataclass(frozen=True)
class Rule:
    """``rejects(text)``: true for a text to drop."""

    name: str
    rejects: Callable[[Text], bool]


#: The base rule and the others: whole numbers only, so that SQL gives the same verdicts.
BASE = Rule("base", lambda t: len(t.words) < 10 or 100 * t.n_repeat_words > 20 * len(t.words))
RULES = (
    Rule("symbols", lambda t: 100 * t.n_symbols > 5 * t.word_chars),
    Rule("dup_lines", lambda t: 100 * t.n_dup_lines > 30 * len(t.lines)),
    Rule("capitals", lambda t: t.case[0] > t.case[1]),
    Rule("word_length", lambda t: t.word_chars < 2 * len(t.words) or t.word_chars > 20 * len(t.words)),
    Rule("top_word", lambda t: 100 * t.top_word > 30 * len(t.words)),
)


def measure_rules(docs: DataFrame, rules: Sequence[Rule], text: str, doc_id: str, one_in: int) -> list[tuple[str, float, float]]:
    """(rule, seconds a text, share rejected) on the rows whose hashed identifier falls in one of ``one_in``."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, dropped, n = Counter(), Counter(), 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                n += 1
                for rule in rules:
                    t = Text(x)  # anew: a rule's cost is what it takes alone
                    began = time.perf_counter()
                    dropped[rule.name] += bool(rule.rejects(t))
                    spent[rule.name] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"rule": [r.name for r in rules], "n": [n] * len(rules), "dropped": [dropped[r.name] for r in rules], "spent": [float(spent[r.name]) for r in rules]})

    sample = docs.where(F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.lit(11)), F.lit(one_in)) == 0).select(F.col(text).cast("string"))
    rows = sample.mapInArrow(measure, "rule string, n bigint, dropped bigint, spent double").groupBy("rule").agg(F.sum("n").alias("n"), F.sum("dropped").alias("dropped"), F.sum("spent").alias("spent")).collect()
    return [(r["rule"], r["spent"] / max(1, r["n"]), r["dropped"] / max(1, r["n"])) for r in rows]


def order_rules(rules: Sequence[Rule], measured: list[tuple[str, float, float]]) -> list[Rule]:
    """Most rejection per cost first; without a sample in the order given."""
    worth = {name: share / max(cost, 1e-9) for name, cost, share in measured}
    return sorted(rules, key=lambda r: -worth.get(r.name, 0.0))


def quality_cascade(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    rules: Sequence[Rule] = RULES,
    base: Rule = BASE,
    one_in: int = 100,
) -> DataFrame:
    """For every row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, failed_rule (the base rule, else the first in the cascade that rejects).

    Null text has no words, so the base rule rejects it. Repeated rows are judged each, alike;
    null identifiers go through; an empty table gives an empty result; other columns are ignored.
    """
    cascade = order_rules(rules, measure_rules(docs, rules, text, doc_id, one_in))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, AT_ONCE) for b in batches for i in range(0, b.num_rows, AT_ONCE)):
            out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rule")}
            for x in batch.column(1).to_pylist():
                t = Text(x)
                bad = base.rejects(t)
                failed = base.name if bad else next((r.name for r in cascade if r.rejects(t)), None)
                for k, v in zip(out, (len(t.words), t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, bad, failed is None, failed), strict=True):
                    out[k].append(v)
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], ["doc_id", *out])

    schema = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, failed_rule string"
    return docs.select(F.col(doc_id).cast("bigint"), F.col(text).cast("string")).mapInArrow(judge, schema)


def keep_good(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rules: Sequence[Rule] = RULES, base: Rule = BASE, one_in: int = 100) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns, in one pass.

    The base rule is measured and ordered as all others. Null and empty texts have no words, so
    they go; long texts are judged whole; repeated rows stay or go alike; an empty table stays empty.
    """
    cascade = order_rules([base, *rules], measure_rules(docs, [base, *rules], text, doc_id, one_in))
    at = docs.columns.index(text)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, AT_ONCE) for b in batches for i in range(0, b.num_rows, AT_ONCE)):
            good = [not any(r.rejects(t) for r in cascade) for t in map(Text, batch.column(at).to_pylist())]
            yield batch.filter(pa.array(good, pa.bool_()))
        release()

    return docs.mapInArrow(judge, docs.schema)
