"""URL filters by empirical-Bayes host reputation, DataFrame functions only.

Labelled page outcomes (good or bad) are counted by host, registered domain and public suffix.
Each level's rate is a beta-binomial posterior whose prior is the posterior mean of the level
above, with a strength estimated from how much the level's units differ (method of moments). A
host passes if a low quantile of its posterior good rate reaches the threshold. Stated rules
(host and path prefix) come first, the longest that fits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotscope.llm.durable import durable, parallelism

#: Fixed values of the stated rules: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Second-level labels that registries of countries sell names under.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gob", "gov", "go", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
#: Steps of the rule that finds a posterior's quantile.
GRID = 400
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_AFTER = r"(?s)^.*?://"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    u = F.coalesce(url, F.lit(""))
    return F.when(F.contains(u, F.lit("://")), F.translate(F.regexp_extract(u, _AFTER + r"([^/?#]*)", 1), _CAPITALS, _SMALL)).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    u = F.coalesce(url, F.lit(""))
    return F.when(F.contains(u, F.lit("://")), F.regexp_extract(u, _AFTER + r"[^/?#]*([^?#]*)", 1)).otherwise("")


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; of equal lengths the first given."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def suffix_of(host: Column, second_level: Sequence[str] = SECOND_LEVEL) -> Column:
    """Public suffix by rule: the last label, or the last two where a country's two letters follow one of ``second_level``."""
    two = F.substring_index(host, ".", -2)
    return F.when(F.regexp_like(two, F.lit(rf"^(?:{'|'.join(second_level)})\.[a-z][a-z]$")), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, second_level: Sequence[str] = SECOND_LEVEL) -> Column:
    """Registered domain: the suffix and one label more; a host that is a suffix is its own domain."""
    return F.when(F.contains(suffix_of(host, second_level), F.lit(".")), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def _strength(units: DataFrame) -> float:
    """Prior strength by moments: what is left of the units' spread (n, good, up) beyond sampling.

    Between 1 and all outcomes there are: units that differ no more than by chance weigh all of them against their own.
    """
    rate, within = F.col("good") / F.col("n"), F.col("up") * (1 - F.col("up"))
    row = units.where("n > 0").agg(
        (F.sum(F.col("n") * F.pow(rate - F.col("up"), 2)) / F.sum("n")).alias("spread"),
        (F.sum(within) / F.sum("n")).alias("noise"),
        F.avg(within).alias("within"),
        F.sum("n").alias("n"),
    ).first()
    if row["within"] is None:
        return 1.0
    beyond = row["spread"] - row["noise"]
    most = max(1.0, row["n"])
    return most if beyond <= 0 else min(most, max(1.0, row["within"] / beyond - 1))


def _posterior(units: DataFrame, strength: float) -> DataFrame:
    a, b = F.col("up") * strength + F.col("good"), (1 - F.col("up")) * strength + F.col("n") - F.col("good")
    return units.withColumns({"a": a, "b": b, "mean": a / (a + b)})


def beta_quantile(a: Column, b: Column, q: float) -> Column:
    """The ``q`` quantile of Beta(a, b), by the trapezoid rule in log-odds, where the density has one smooth peak.

    GRID steps span eight deviations and the exponential tails on either side of the peak.
    """
    peak, sd = F.log(a / b), F.sqrt(1 / a + 1 / b)
    low, high = peak - 8 * sd - 30 / a, peak + 8 * sd + 30 / b
    softplus = lambda t: F.greatest(t, F.lit(0.0)) + F.log1p(F.exp(-F.abs(t)))
    log_density = lambda t: a * t - (a + b) * softplus(t)
    grid = F.struct(low.alias("low"), ((high - low) / GRID).alias("step"), log_density(peak).alias("top"))
    points = lambda g: F.transform(F.sequence(F.lit(0), F.lit(GRID)), lambda k: g["low"] + k * g["step"])
    weights = lambda g: F.transform(points(g), lambda t: F.exp(log_density(t) - g["top"]))

    def upto(weighted: Column, aim: Column) -> Column:
        """Log-odds at which the running sum of the weights, half of each on either side of its place, reaches ``aim``."""
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("k"), F.lit(None).cast("double").alias("at"))
        reached = lambda s, w: F.when(s["at"].isNotNull(), s["at"]).when((s["sum"] + w >= aim) & (w > 0), s["k"] - 0.5 + (aim - s["sum"]) / w)
        return F.aggregate(weighted, start, lambda s, w: F.struct((s["sum"] + w).alias("sum"), (s["k"] + 1).alias("k"), reached(s, w).alias("at")), lambda s: s["at"])

    # each value that a lambda reads again and again is bound by one of its own, or it would be computed at every step
    bound = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)
    total = lambda ws: F.aggregate(ws, F.lit(0.0), lambda s, w: s + w)
    place = lambda g: bound(weights(g), lambda ws: bound(q * total(ws), lambda aim: upto(ws, aim)))
    return 1 / (1 + F.exp(-bound(grid, lambda g: g["low"] + place(g) * g["step"])))


def _looked_up(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``facts`` (one row a ``key``), null where there is none.

    A key that holds more than a quarter of a partition's share of the rows is joined by broadcast:
    of such keys there are at most four times as many as partitions, whatever the size of the tables.
    """
    counts = durable(rows.groupBy(key).count())
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")).first()["n"]
    hot = counts.where(F.col("count") * 4 * parallelism(rows.sparkSession) > total).select(key)
    few = F.broadcast(facts.join(F.broadcast(hot), key, "left_semi"))
    others = rows.join(F.broadcast(hot), key, "left_anti").join(facts, key, "left")
    return rows.join(F.broadcast(hot), key, "left_semi").join(few, key, "left").unionByName(others)


def host_reputation(outcomes: DataFrame, tail: float = 0.05) -> DataFrame:
    """(host, domain, suffix, n, good, mean, lower) for each host of ``outcomes`` (host, good 0/1 or null).

    ``mean`` and ``lower`` belong to the host's beta posterior; ``lower`` is its ``tail`` quantile.
    Only the levels' strengths and the overall rate, four numbers, pass through the driver.
    A null host is left out; an empty table gives an empty result.
    """
    counted = outcomes.where("host is not null").groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    host = F.col("host")
    hosts = durable(counted.select("host", domain_of(host).alias("domain"), suffix_of(host).alias("suffix"), F.col("n").cast("double").alias("n"), F.col("good").cast("double").alias("good")))
    domains = durable(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("good").alias("good")))
    suffixes = durable(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")))
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("n"), F.coalesce(F.sum("good"), F.lit(0.0)).alias("good")).first()
    suffixes = suffixes.withColumn("up", F.lit((total["good"] + 1) / (total["n"] + 2)))
    suffixes = _posterior(suffixes, _strength(suffixes))
    domains = durable(_looked_up(domains, suffixes.select("suffix", F.col("mean").alias("up")), "suffix"))
    domains = _posterior(domains, _strength(domains))
    hosts = durable(_looked_up(hosts, domains.select("domain", F.col("mean").alias("up")), "domain"))
    hosts = _posterior(hosts, _strength(hosts))
    return hosts.select("host", "domain", "suffix", F.col("n").cast("bigint").alias("n"), F.col("good").cast("bigint").alias("good"), "mean", beta_quantile(F.col("a"), F.col("b"), tail).alias("lower"))


def labelled_outcomes(pages: DataFrame, labels: DataFrame, url: str = "url", number: str = r"/([0-9]{1,18})(?:\.html)?/?$") -> DataFrame:
    """(host, good): the labels of the documents that the urls' paths end in; good is 1 where quality is 1 and toxic is not."""
    u = F.col(url).cast("string")
    rows = pages.select(host_of(u).alias("host"), F.regexp_extract(path_of(u), number, 1).try_cast("bigint").alias("doc_id"))
    good = F.when(F.col("quality").isNotNull(), ((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).cast("int"))
    return rows.where("doc_id is not null").join(labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), good.alias("good")), "doc_id").select("host", "good")


def filter_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    least: float = 0.5,
    tail: float = 0.05,
) -> DataFrame:
    """For every page: page_id, host, path, rule, verdict, reputation (posterior mean), lower bound.

    ``outcomes`` (host, good) are labelled pages; rows with null ``good`` count as unlabelled.
    A url that is null or has no :// has an empty host and path, fits no rule and is judged as the
    empty host. A host without labels has the posterior of its domain, then suffix. Repeated rows
    are judged each, as are rows with a null ``page_id``; very long urls are read whole; an empty
    table gives an empty result; other columns are ignored, whatever their names.
    """
    host, path = F.col("host"), F.col("path")
    rule, verdict = fitting_rule(host, path, rules)
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), host_of(F.col(url).cast("string")).alias("host"), path_of(F.col(url).cast("string")).alias("path"))
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    hosts = rows.select("host").distinct().select("host", F.lit(None).cast("int").alias("good"))
    reputation = durable(host_reputation(outcomes.select("host", F.col("good").cast("int").alias("good")).unionByName(hosts), tail).select("host", "mean", "lower"))
    joined = _looked_up(rows, reputation, "host")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("lower") >= least, "allow").otherwise("block")).alias("verdict"), F.col("mean").alias("reputation"), F.col("lower").alias("lower_bound"))
