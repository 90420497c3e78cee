"""Mixing sources to target weights by iterative proportional fitting, DataFrame functions only.

The tokens of every cell (source x language x topic) are counted in Spark. Raking scales the cells
to the marginal targets in turn, never beyond what a cell holds, until the margins agree; a cell's
sampling probability is its raked weight over its tokens. A document is drawn if a hash of its
identifier falls below its cell's probability, so the draw is the same on every run and executor.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: No more cells than this are raked: levels come from the targets, never from the data.
MOST_CELLS = 100_000
OTHER = "other"


def n_words(text: Column) -> Column:
    """Words between ASCII white space, 0 for null."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    pieces = F.size(F.split(t, r"[\x20\x09-\x0D]+"))
    lead, tail = F.rlike(t, F.lit(r"^[\x20\x09-\x0D]")), F.rlike(t, F.lit(r"[\x20\x09-\x0D]\z"))
    return F.when(F.rlike(t, F.lit(r"[^\x20\x09-\x0D]")), pieces - lead.cast("int") - tail.cast("int")).otherwise(0).cast("bigint")


def form_topic(text: Column) -> Column:
    """A topic by form, for tables that have none: tabular, listed (short lines), long, or prose."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1
    return F.when(F.contains(t, F.lit(" | ")), "tabular").when(F.length(t) < 40 * lines, "listed").when(F.length(t) >= 8000, "long").otherwise("prose")


def rake(tokens: Mapping[tuple[str, ...], float], targets: list[Mapping[str, float]], share: float, sweeps: int = 500, tolerance: float = 1e-9) -> dict[tuple[str, ...], float]:
    """Weights of the cells, between 0 and the cell's tokens, whose margins follow ``targets``.

    They sum to ``share`` of all tokens if the cells hold enough; a margin that its cells can't
    fill gets all that they hold.
    """
    budget = share * sum(tokens.values())
    weight = {k: share * v for k, v in tokens.items()}
    for _ in range(sweeps):
        moved = 0.0
        for i, target in enumerate(targets):
            whole = sum(target.values()) or 1.0
            held: dict[str, float] = {}
            for k, v in weight.items():
                held[k[i]] = held.get(k[i], 0.0) + v
            for k, v in weight.items():
                scaled = v * budget * target.get(k[i], 0.0) / whole / held[k[i]] if held[k[i]] > 0 else 0.0
                scaled = min(scaled, tokens[k])
                moved = max(moved, abs(scaled - v))
                weight[k] = scaled
        if moved <= tolerance * max(budget, 1.0):
            break
    return weight


NAMES = ("source", "lang", "topic")


def _levels(targets: Mapping[str, Mapping[str, float]], text: Column, topic: Column | None) -> dict[str, Column]:
    """Each row's level of the three margins; what has no share of its own is ``other``."""
    cells = 1
    for k in NAMES:
        cells *= len({*targets[k], OTHER})
    if cells > MOST_CELLS:
        raise ValueError(f"targets make {cells} cells; at most {MOST_CELLS} are raked")
    own = {"source": F.col("source"), "lang": F.col("lang"), "topic": form_topic(text) if topic is None else topic}
    return {k: F.when(own[k].cast("string").isin(*targets[k]), own[k].cast("string")).otherwise(OTHER) for k in NAMES}


def _probabilities(rows: DataFrame, targets: Mapping[str, Mapping[str, float]], share: float) -> list[tuple]:
    """(source, lang, topic, probability) of each cell of ``rows`` (source, lang, topic, n_tokens)."""
    counted = {tuple(r[k] for k in NAMES): float(r["tokens"]) for r in rows.groupBy(*NAMES).agg(F.sum("n_tokens").alias("tokens")).collect()}
    weight = rake(counted, [targets[k] for k in NAMES], share)
    return [(*k, weight[k] / v if v else 0.0) for k, v in counted.items()]


def _drawn(doc_id: Column, probability: Column, seed: int) -> Column:
    """Whether a fixed number of the identifier, even in [0, 1), is below the probability."""
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40) < probability


def mix(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str, float]],
    share: float,
    doc_id: str = "doc_id",
    text: str = "text",
    topic: Column | None = None,
    seed: int = 17,
) -> DataFrame:
    """For every row: doc_id, source, lang, topic, n_tokens, probability, sampled.

    ``targets`` has shares by level for ``source``, ``lang`` and ``topic``. A level without a share,
    null included, counts as ``other``; where ``other`` has no share either, it isn't drawn. Empty
    texts weigh one token. Repeated rows are drawn together or not at all, and null identifiers
    all alike. An empty table gives an empty result; further columns are ignored.
    """
    level = _levels(targets, F.col(text), topic)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), *[level[k].alias(k) for k in NAMES], F.greatest(n_words(F.col(text)), F.lit(1)).alias("n_tokens"))
    cells = docs.sparkSession.createDataFrame(_probabilities(rows, targets, share), "source string, lang string, topic string, probability double")
    joined = rows.join(F.broadcast(cells), list(NAMES), "left")  # at most MOST_CELLS rows
    return joined.select("doc_id", *NAMES, "n_tokens", "probability", _drawn(F.col("doc_id"), F.col("probability"), seed).alias("sampled"))


def draw(docs: DataFrame, targets: Mapping[str, Mapping[str, float]], share: float, doc_id: str = "doc_id", text: str = "text", topic: Column | None = None, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` that ``mix`` samples, with all their columns, without a shuffle of the texts."""
    level = _levels(targets, F.col(text), topic)
    rows = docs.select(*[level[k].alias(k) for k in NAMES], F.greatest(n_words(F.col(text)), F.lit(1)).alias("n_tokens"))
    named = [("\x1f".join(k), p) for *k, p in _probabilities(rows, targets, share)]
    cells = docs.sparkSession.createDataFrame(named, "__cell string, __probability double")
    cell = F.concat_ws("\x1f", *[level[k] for k in NAMES])
    kept = docs.join(F.broadcast(cells), cell == F.col("__cell")).where(_drawn(F.col(doc_id).cast("bigint"), F.col("__probability"), seed))
    return kept.select(*[docs[c] for c in docs.columns])
