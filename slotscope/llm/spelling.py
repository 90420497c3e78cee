"""Spelling variants by permuterm rotations.

A word of L code points, marked with a terminator, has L + 1 rotations. A replaced or inserted
code point of the word is the last one of some rotation, so leaving that one out turns "differs in
one code point" into "shares a whole rotation prefix": words that share the prefix of length L are
replacements of one another, and the word whose whole rotation is that prefix is the one with the
code point deleted. Spark sorts rotations and prefixes together, every run of equal prefixes is
scanned once, and each member of a run gives its neighbours there: their number, and the best.

A run has at most one member for each code point of the alphabet and one whole rotation, so no run
grows with the data, however often its words occur (counts are summed before rotations are made).

Rotations of a word take L * L code points in all. Words longer than ``LONG`` therefore take the
same prefixes as pairs of polynomial hashes of the two sides, in linear space, and every pair that
those name is compared code point by code point before it counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotscope.llm.durable import durable

LETTERS = r"[A-Za-zÀ-ÿ]+"
#: Terminator of a word; no letter.
END = "$"
#: Words of up to so many code points are rotated as text.
LONG = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PRIME, _BASES = (1 << 61) - 1, (1_000_003, 998_244_353)


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = 31, min_length: int = 7, min_count: int = 2) -> DataFrame:
    """(word, n): distinct words after the hashed deletions, with their occurrences.

    Null texts have no runs; a null identifier counts as an empty string in the hash.
    """
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(LETTERS), F.lit(0))).alias("run"))
    # Runs of one-byte letters have the quick way to lower case.
    low = runs.select("id", F.when(F.octet_length("run") == F.char_length("run"), F.lower("run")).otherwise(F.translate("run", _UPPER, _LOWER)).alias("run"))
    hashed = low.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"), F.char_length("run").alias("length"))
    at = F.pmod(F.col("h"), F.col("length")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = hashed.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _rotations(words: DataFrame) -> DataFrame:
    """(prefix, skipped, n): whole rotations skip nothing (''), all others their last code point."""
    w, length = F.col("word"), F.char_length("word")
    whole = F.transform(F.sequence(F.lit(0), length), lambda i: F.struct(F.concat(F.substr(w, i + 1), F.lit(END), F.substr(w, F.lit(1), i)).alias("prefix"), F.lit("").alias("skipped")))
    part = F.transform(
        F.sequence(F.lit(0), length - 1),
        lambda i: F.struct(F.concat(F.substr(w, i + 2), F.lit(END), F.substr(w, F.lit(1), i)).alias("prefix"), F.substr(w, i + 1, F.lit(1)).alias("skipped")),
    )
    return words.select("n", F.explode(F.concat(whole, part)).alias("r")).select("r.prefix", "r.skipped", "n")


def _once(skipped: Column) -> Column:
    """Of equal code points in a row only the last stands for the deletion, so an indel is met once."""
    return ~F.startswith(F.col("prefix"), skipped)


def _near_short(words: DataFrame) -> DataFrame:
    """(word, near, best): neighbours that each run of equal prefixes gives to each of its members."""
    runs = _rotations(words).groupBy("prefix").agg(F.collect_list(F.struct("skipped", "n")).alias("members")).where(F.size("members") > 1)
    tail, head = F.substring_index("prefix", END, 1), F.substring_index("prefix", END, -1)
    each = runs.select("prefix", "members", F.explode("members").alias("x"), tail.alias("tail"), head.alias("head"))
    x = F.col("x.skipped")
    others = F.filter(
        "members",
        lambda y: (y["skipped"] != x) & F.when(x == "", _once(y["skipped"])).when(y["skipped"] == "", _once(x)).otherwise(True),
    )
    best = F.array_min(F.transform("near", lambda y: F.struct((-y["n"]).alias("minus"), F.concat("head", y["skipped"], "tail").alias("form"))))
    return each.withColumn("near", others).where(F.size("near") > 0).select(F.concat("head", x, "tail").alias("word"), F.size("near").cast("bigint").alias("near"), best.alias("best"))


def _sides(word: str) -> list[tuple[str, bool]]:
    """Keys of the word's prefixes, and whether it skips a code point there (False: a whole rotation)."""
    n, found = len(word), []
    for base in _BASES:
        powers, front = [1] * (n + 1), [0] * (n + 1)
        for i, c in enumerate(word):
            powers[i + 1] = powers[i] * base % _PRIME
            front[i + 1] = (front[i] * base + ord(c)) % _PRIME
        back = lambda i, front=front, powers=powers: (front[n] - front[i] * powers[n - i]) % _PRIME
        found.append(([(front[i], back(i)) for i in range(n + 1)], [(front[i], back(i + 1)) for i in range(n)]))
    keys = []
    for i in range(n + 1):
        keys.append((f"{i}:{n}:{found[0][0][i]}:{found[1][0][i]}", False))
    for i in range(n):
        if i == n - 1 or word[i] != word[i + 1]:
            keys.append((f"{i}:{n - 1}:{found[0][1][i]}:{found[1][1][i]}", True))
        else:  # replacements only
            keys.append((f"{i}:{n - 1}:{found[0][1][i]}:{found[1][1][i]}:r", True))
    return keys


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for node, word in zip(batch["node"], batch["word"], strict=True):
            rows = _sides(word)
            yield pd.DataFrame({"key": [k.removesuffix(":r") for k, _ in rows], "node": node, "skips": [s for _, s in rows], "indel": [not k.endswith(":r") for k, _ in rows]})


def _differ_once(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    low, high = 0, min(len(a), len(b))
    while low < high:  # length of the common beginning
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return a[low + (len(a) >= len(b)) :] == b[low + (len(b) >= len(a)) :]


def _near_long(words: DataFrame) -> DataFrame:
    """As ``_near_short``, for pairs with a word longer than ``LONG``."""
    nodes = durable(words.where(F.char_length("word") >= LONG).select(F.monotonically_increasing_id().alias("node"), "word", "n"))
    keyed = nodes.mapInPandas(_keys, "key string, node bigint, skips boolean, indel boolean")
    runs = keyed.groupBy("key").agg(F.collect_list(F.struct("node", "skips", "indel")).alias("members")).where(F.size("members") > 1)
    pairs = runs.select("members", F.explode("members").alias("x")).select("x", F.explode("members").alias("y"))
    pairs = pairs.where((F.col("x.node") != F.col("y.node")) & (F.col("x.skips") | F.col("y.skips")))
    pairs = pairs.where(F.col("x.skips") & F.col("y.skips") | F.col("x.indel") & F.col("y.indel")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    both = pairs.join(nodes.select(F.col("node").alias("a"), "word"), "a").join(nodes.select(F.col("node").alias("b"), F.col("word").alias("form"), F.col("n").alias("form_n")), "b")
    same = F.pandas_udf(lambda a, b: pd.Series([_differ_once(x, y) for x, y in zip(a, b, strict=True)], dtype=bool), "boolean")
    sure = both.where(F.greatest(F.char_length("word"), F.char_length("form")) > LONG).where(same("word", "form"))
    return sure.select("word", F.lit(1).cast("bigint").alias("near"), F.struct((-F.col("form_n")).alias("minus"), "form").alias("best"))


def spelling_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``words`` (word, n), whose words are distinct.

    ``form`` is the near word with the largest n (ties: the smallest in code-point order) if that is
    at least ``ratio`` times the word's n, else null; ``root`` follows forms to the last. An empty
    table gives an empty result. Words of any length and any letters are taken, but for ``END``,
    which is the terminator; null words have no neighbours and are left out.
    """
    if ratio < 2:
        raise ValueError("with a ratio below 2 forms could lead in a circle")
    words = durable(words.where("word IS NOT NULL").select("word", F.col("n").cast("bigint").alias("n")))
    near = _near_short(words.where(F.char_length("word") <= LONG))
    most, long = words.agg(F.max("n"), F.count_if(F.char_length("word") > LONG)).first()
    if long:
        near = near.unionByName(_near_long(words))
    near = near.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    enough = -F.col("best.minus") >= ratio * F.col("n")
    # The words follow their neighbours in the same order: a merge, whose sides the last aggregation has dealt.
    all_words = durable(words.join(near, "word", "left").select("word", F.when(enough, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, -F.col("best.minus")).alias("form_n")))
    roots = all_words.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    # Along a chain n grows by the ratio, so its length has a bound; each round doubles what is followed.
    links = 1 + int(math.log(max(most or 1, 1), ratio))
    for _ in range(max(0, math.ceil(math.log2(links)))):
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = durable(roots.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return all_words.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_spellings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = 31, min_length: int = 7, min_count: int = 2, ratio: int = 10) -> DataFrame:
    """``spelling_variants`` of the words of ``docs``.

    Words are maximal runs of letters; one run in ``every``, chosen by a hash of identifier and run,
    loses a code point. Null and empty texts have no words, very long texts are read whole,
    repeated rows count each time, other columns are ignored, an empty table gives no rows.
    """
    return spelling_variants(word_counts(docs, doc_id, text, every, min_length, min_count), ratio)
