"""Secret scans: stated patterns plus character Markov models, DataFrame functions only.

Two bigram models over a fixed alphabet, one of random strings (labelled secrets and digests) and
one of ordinary identifiers (candidate tokens of the corpus without a stated secret, its words, and
its words and numbers put together as identifiers, constants and paths), are trained from labelled samples. A
token is a secret if the log-likelihood ratio of the two models over its transitions reaches 15
nats and its mean over the transitions a threshold, so that length alone makes no secret. The
threshold is set on held-out labels: at most one ordinary token in a thousand reaches it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The stated patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")
#: What the models judge: unbroken runs of these.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
_SPAN = "array<struct<start:bigint,kind:int,end:bigint,token:string>>"


@dataclass(frozen=True)
class Model:
    """``ratios``: log-likelihood ratio (random to ordinary) by first and second character.

    ``least``: least ratio of a token; ``least_mean``: least ratio for each transition, set on the
    held-out labels, of which ``precision`` and ``recall`` are measured (null without such labels).
    """

    ratios: tuple[float, ...]
    least: float
    least_mean: float = 0.0
    precision: float | None = None
    recall: float | None = None


def _folded(items: Column, state: Column, emitted: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What ``step(state, item) -> (state, array to put out)`` puts out over an array, as one array.

    An array grows by copying, so the fold goes over chunks of about the square root of the items:
    n items copy n ** 1.5 times, not n ** 2. ``items`` has to be a plain column, as it is read again for each chunk.
    """
    none = F.array().cast(emitted)
    size = F.ceil(F.sqrt(F.size(items))).cast("int")
    chunks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.greatest(size, F.lit(1))), lambda i: F.slice(items, i, F.greatest(size, F.lit(1))))

    def one(acc: Column, x: Column) -> Column:
        after, out = step(acc["state"], x)
        return F.struct(after.alias("state"), F.concat(acc["out"], out).alias("out"))

    last = lambda st: F.struct(st.alias("state"), none.alias("out"))
    over = lambda acc, chunk: F.struct(
        F.aggregate(chunk, last(acc["last"]["state"]), one).alias("last"),
        F.concat(acc["outs"], F.array(acc["last"]["out"])).alias("outs"),
    )
    whole = lambda acc: F.flatten(F.concat(acc["outs"], F.array(acc["last"]["out"])))
    return F.aggregate(chunks, F.struct(last(state).alias("last"), F.array().cast(f"array<{emitted}>").alias("outs")), over, whole)


def matches(text: Column, pattern: str, gate: Column) -> Column:
    """Leftmost non-overlapping matches: array of (skip, token), ``skip`` code points after the match before."""
    pieces, tokens = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = F.zip_with(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), tokens, lambda p, t: F.struct(F.length(p).alias("skip"), t.alias("token")))
    return F.when(gate, found).otherwise(F.array().cast("array<struct<skip:int,token:string>>"))


def placed(found: Column, kind: int) -> Column:
    """``matches`` (a plain column) as an array of (start, kind, end, token) in code points, end exclusive."""

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["skip"]
        end = start + F.length(x["token"])
        return end, F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["token"].alias("token")))

    return _folded(found, F.lit(0).cast("bigint"), _SPAN, step)


def apart(spans: Column) -> Column:
    """Of spans in order of start (a plain column), those of the last kind that overlap none of another kind.

    Spans of the last kind don't overlap one another, so one pass does: a span waits until the next
    one starts at or after its end.
    """
    held = "struct<reach:bigint,start:bigint,end:bigint,token:string>"
    last = len(KINDS) - 1

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        free = state["start"].isNotNull() & (x["start"] >= state["end"])
        out = F.when(free, F.array(F.struct(state["start"].alias("start"), F.lit(last).alias("kind"), state["end"].alias("end"), state["token"].alias("token")))).otherwise(F.array().cast(_SPAN))
        waits = (x["kind"] == last) & (x["start"] >= state["reach"])
        after = F.struct(
            F.when(x["kind"] == last, state["reach"]).otherwise(F.greatest(state["reach"], x["end"])).alias("reach"),
            F.when(waits, x["start"]).alias("start"), F.when(waits, x["end"]).alias("end"), F.when(waits, x["token"]).alias("token"),
        )
        return after, out

    none = F.struct(F.lit(0).alias("reach"), F.lit(None).alias("start"), F.lit(None).alias("end"), F.lit(None).alias("token")).cast(held)
    return _folded(spans, none, _SPAN, step)


def _bigrams(labelled: DataFrame) -> DataFrame:
    """(random, a, b, n): how often character b follows a in the tokens of (token, random)."""
    chars = labelled.select("random", F.split("token", "").alias("c")).where(F.size("c") > 1)
    pairs = chars.select("random", F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.struct(F.element_at("c", i).alias("a"), F.element_at("c", i + 1).alias("b")))).alias("p"))
    return pairs.groupBy("random", "p.a", "p.b").count()


def ratio(token: Column, ratios: Column) -> Column:
    """Summed log-likelihood ratio of a token's transitions; characters outside the alphabet add nothing."""
    c = F.transform(F.split(token, ""), lambda x: F.when(x == "", 0).otherwise(F.instr(F.lit(ALPHABET), x)))
    step = lambda acc, i: F.struct(
        (acc["sum"] + F.when((acc["last"] > 0) & (i > 0), F.element_at(ratios, F.greatest((acc["last"] - 1) * len(ALPHABET) + i, F.lit(1)))).otherwise(0.0)).alias("sum"),
        i.alias("last"),
    )
    return F.aggregate(c, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("last")), step)["sum"]


def _constant(ratios: tuple[float, ...]) -> Column:
    """One folded array literal."""
    return F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")


def _put_together(words: Column, numbers: Column) -> Column:
    """Words, three at a time, in the usual spellings of identifiers, constants and paths, in turn; numbers run together or in parts."""
    by = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(c), F.lit(1)), F.lit(n)), lambda i: F.slice(c, i, n))
    threes = by(words, 3)
    spelt = lambda w, i: (
        F.when(i % 7 == 0, F.array_join(w, "/"))
        .when(i % 7 == 1, F.array_join(w, "_"))
        .when(i % 7 == 2, F.upper(F.array_join(w, "_")))
        .when(i % 7 == 3, F.array_join(w, "-"))
        .when(i % 7 == 4, F.array_join(F.transform(w, F.initcap), ""))
        .when(i % 7 == 5, F.upper(F.array_join(w, "")))
        .otherwise(F.array_join(w, "="))
    )
    parted = lambda w, i: F.when(i % 2 == 0, F.array_join(w, "")).otherwise(F.array_join(w, "-"))
    return F.concat(F.transform(threes, spelt), F.transform(by(numbers, 6), parted))


def labelled_samples(docs: DataFrame, text: str, doc_id: str, one_in: int, n_random: int) -> DataFrame:
    """(token, random): stated secrets and digests as random, what else the corpus holds as ordinary.

    Documents whose hashed identifier falls in one of ``one_in`` give both. Ordinary are the
    candidate tokens outside stated secrets, words and numbers of six characters and more, and
    words and numbers put together. ``n_random`` digests in base 64 and base 16 make sure that there are random
    strings of every character. Null and empty texts give nothing, a null identifier hashes like
    any other, and repeated rows count each.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    sample = docs.where(F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.lit(5)), F.lit(one_in)) == 0).select(t.alias("t"))
    secret = sample.select(F.explode(F.concat(F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("t", F.lit(HEX), F.lit(0)), F.regexp_extract_all("t", F.lit(ACCESS), F.lit(0)))).alias("token"))
    masked = sample.select(F.regexp_replace(F.regexp_replace(F.regexp_replace("t", ASSIGN, " "), HEX, " "), ACCESS, " ").alias("t"))
    all_of = lambda pattern: F.regexp_extract_all("t", F.lit(pattern), F.lit(0))
    parts = masked.select(all_of(CANDIDATE).alias("candidates"), all_of(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9_-]{6,15}(?![A-Za-z0-9+/_=])").alias("words"), all_of("[A-Za-z]{2,15}").alias("letters"), all_of("[0-9]+").alias("numbers"))
    word = parts.select(F.explode(F.concat("candidates", "words", _put_together(F.col("letters"), F.col("numbers")))).alias("token")).where(F.length("token") >= 6)
    digest = docs.sparkSession.range(n_random).select(F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("d"))
    digest = digest.select(F.explode(F.array(F.base64("d"), F.lower(F.hex("d")), F.hex("d"))).alias("token"))
    return secret.where(F.length("token") >= 16).unionByName(digest).select("token", F.lit(True).alias("random")).unionByName(word.select("token", F.lit(False).alias("random")))


def _kind(char: str) -> int:
    return 0 if char.islower() else 1 if char.isupper() else 2 if char.isdigit() else 3


def _transitions(counts: dict[tuple[int, int], float], backing: float) -> list[float]:
    """P(second | first) over the alphabet. A transition seen too rarely backs off to that of the
    kinds of character (small, capital, digit, other) times the second's share of its kind."""
    n = len(ALPHABET)
    kind = [_kind(c) for c in ALPHABET]
    among = [[1.0] * 4 for _ in range(4)]
    once = [1.0] * n
    row = [0.0] * n
    for (a, b), x in counts.items():
        among[kind[a]][kind[b]] += x
        once[b] += x
        row[a] += x
    of_kind = [sum(x for x, k in zip(once, kind, strict=True) if k == q) for q in range(4)]
    out = []
    for a in range(n):
        whole = sum(among[kind[a]])
        out += [(counts.get((a, b), 0.0) + backing * among[kind[a]][kind[b]] / whole * once[b] / of_kind[kind[b]]) / (row[a] + backing) for b in range(n)]
    return out


#: Steps of a nat in which thresholds are set.
_STEPS = 50
#: Of so many ordinary tokens one may pass as a secret.
ONE_FALSE_IN = 1000


def _held_out() -> Column:
    return F.pmod(F.xxhash64("token", F.lit(29)), F.lit(5)) == 0


def _mean(token: Column, ratios: Column) -> Column:
    """The ratio for each transition."""
    return ratio(token, ratios) / F.greatest(F.length(token) - 1, F.lit(1))


def measured(labelled: DataFrame, ratios: tuple[float, ...], least: float) -> list[tuple[float, int, int]]:
    """(threshold, random, ordinary): the labelled tokens of at least 16 characters that reach each mean ratio, and ``least``, from high to low.

    Counted in steps of 1 / 50 nat between -3 and 3, so at most 602 numbers reach the driver however
    many tokens there are; the last entry, minus infinity, counts all tokens.
    """
    table = _constant(ratios)
    rows = labelled.where(F.length("token") >= 16).select("random", ratio(F.col("token"), table).alias("sum"), F.length("token").alias("n"))
    step = F.when(F.col("sum") >= least, F.floor(F.col("sum") / F.greatest(F.col("n") - 1, F.lit(1)) * _STEPS).cast("int"))
    counts = rows.groupBy(step.alias("step")).agg(F.count_if("random").alias("random"), F.count_if(~F.col("random")).alias("ordinary")).collect()
    out, random, ordinary = [], 0, 0
    for r in sorted((r for r in counts if r["step"] is not None), key=lambda r: -r["step"]):
        random, ordinary = random + r["random"], ordinary + r["ordinary"]
        out.append((r["step"] / _STEPS, random, ordinary))
    below = [r for r in counts if r["step"] is None]
    return [*out, (-math.inf, random + sum(r["random"] for r in below), ordinary + sum(r["ordinary"] for r in below))]


def train(labelled: DataFrame, least: float = 15.0, backing: float = 50.0) -> Model:
    """Both models and the threshold from (token, random); bigram counts, 2 x 68 x 68 at most, and 602 counts reach the driver.

    One token in five, by its hash, is held out of the models. The threshold of the mean is the
    lowest that at most one held-out ordinary token in ONE_FALSE_IN reaches; without held-out
    tokens it is 0, and precision and recall are null.
    """
    counts: dict[bool, dict[tuple[int, int], float]] = {True: {}, False: {}}
    for r in _bigrams(labelled.where(~_held_out())).collect():
        if r["a"] and r["b"] and (a := ALPHABET.find(r["a"])) >= 0 and (b := ALPHABET.find(r["b"])) >= 0:
            counts[r["random"]][a, b] = float(r["count"])
    random, plain = (_transitions(counts[k], backing) for k in (True, False))
    # what only one of the samples shows counts for a bounded amount
    ratios = tuple(max(-3.0, min(3.0, math.log(x / y))) for x, y in zip(random, plain, strict=True))
    *steps, (_, n_random, n_ordinary) = measured(labelled.where(_held_out()), ratios, least)
    allowed = [s for s in steps if ONE_FALSE_IN * s[2] <= n_ordinary]
    if not allowed:  # none of the steps is clean enough: above all of them
        return Model(ratios, least, steps[0][0] + 1 / _STEPS if steps else 0.0, None, 0.0 if n_random else None)
    mean, true, false = allowed[-1]
    return Model(ratios, least, mean, true / (true + false), true / n_random if n_random else None)


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Model | None = None, one_in: int = 20, n_random: int = 2000) -> DataFrame:
    """For every row: doc_id and ``found``, an array of (start, kind, end, token) by start and kind.

    ``kind`` indexes KINDS. Markov spans are added where no stated span overlaps. Null and empty
    texts have no spans; long texts are taken whole, in time that grows with the number of matches
    to the power of 1.5. Repeated rows and null identifiers get a row each; an empty table gives an
    empty result; other columns are ignored, whatever their names.
    """
    model = model or train(labelled_samples(docs, text, doc_id, one_in, n_random))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    t = F.col("t")
    rows = rows.select(
        "doc_id",
        matches(t, ASSIGN, F.rlike(t, F.lit(ASSIGN))).alias("assign"),
        F.when(F.rlike(t, F.lit(ASSIGN)), F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2))).alias("value"),
        matches(t, ACCESS, F.contains(t, F.lit("AKIA"))).alias("access"),
        matches(t, HEX, F.rlike(t, F.lit(HEX))).alias("hex"),
        matches(t, CANDIDATE, F.rlike(t, F.lit(CANDIDATE))).alias("more"),
    )
    rows = rows.select("doc_id", "value", placed(F.col("assign"), 0).alias("assign"), placed(F.col("access"), 1).alias("access"), placed(F.col("hex"), 2).alias("hex"), placed(F.col("more"), 3).alias("more"))
    # matches that are too short are dropped after matching
    long_enough = F.filter(F.zip_with("assign", "value", lambda s, v: F.when(F.length(v) >= 8, s)), lambda s: s.isNotNull())
    base = F.array_sort(F.concat(F.when(F.size("assign") > 0, long_enough).otherwise(F.col("assign")), "access", "hex"))
    table = _constant(model.ratios)
    likely = F.filter("more", lambda c: (ratio(c["token"], table) >= model.least) & (_mean(c["token"], table) >= model.least_mean))
    rows = rows.select("doc_id", base.alias("base"), likely.alias("likely"))
    # the last span starts after all others and lets go of the one that waits
    end = F.struct(F.lit(1 << 62).cast("bigint").alias("start"), F.lit(0).alias("kind"), F.lit(1 << 62).cast("bigint").alias("end"), F.lit("").alias("token"))
    rows = rows.select("doc_id", "base", F.when(F.size("likely") > 0, F.concat(F.array_sort(F.concat("base", "likely")), F.array(end))).otherwise(F.array().cast(_SPAN)).alias("all"))
    return rows.select("doc_id", "base", F.when(F.size("all") > 0, F.array_sort(F.concat("base", apart(F.col("all"))))).otherwise(F.col("base")).alias("found"))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(kinds, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
