"""Spelling variants, collocations and near vectors against brute force on small, awkward tables."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from slotscope.llm import collocations, near_vectors, spelling
from slotscope.llm.queries import ORACLE_SQL

from tests.llm.test_operators import SCHEMA

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- 11 spelling variants ----------------------------------------------------------------------


def one_apart(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(counts: dict[str, int], ratio: int = 10) -> set[tuple]:
    near = {w: [v for v in counts if one_apart(v, w)] for w in counts}
    best = {w: min(vs, key=lambda v: (-counts[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if counts[v] >= ratio * counts[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None) for w, n in counts.items()}


def given(rows) -> set[tuple]:
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def test_spelling_variants_of_texts(spark):
    r = np.random.default_rng(3)
    base = ["".join(r.choice(list("abéÿ"), r.integers(6, 10))) for _ in range(60)]
    texts = [" ".join(r.choice(base, 200)) for _ in range(12)] + ["Aaaaaaaa aaaaaaaa AAAAAAAA", "ÀBÇDEFGH àbçdefgh", None, "", "1234 .-"]
    rows = [(i if i != 5 else None, t, None, None, None, 7, "clash") for i, t in enumerate(texts)]
    rows.append(rows[0])
    counts: Counter = Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    assert any(one_apart(a, b) for a in counts for b in counts)
    got = spelling.group_spellings(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(counts) and given(got) == variants(counts)


@pytest.mark.parametrize("long", [spelling.LONG, 5])
def test_spelling_chains_runs_of_equal_letters_and_long_words(spark, monkeypatch, long):
    """Words beyond LONG go by hashed prefixes: with a low bound all of the words do, also those astride of it."""
    monkeypatch.setattr(spelling, "LONG", long)
    x = "xyz" * 40
    words = {"aaaa": 1, "aaaaa": 20, "aaaaaa": 400, "aaaab": 20, "baaaaa": 5000, "abab": 3, "baba": 30, x: 2, x + "y": 30, x[:50] + "q" + x[50:]: 30, x[:50] + "q" + x[51:]: 7, "aaaba": 20, "é" * 5: 2, "é" * 4 + "a": 25, "漢字漢字": 2}
    got = spelling.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n bigint")).collect()
    assert len(got) == len(words) and given(got) == variants(words)


def test_spelling_of_an_empty_table(spark):
    assert spelling.group_spellings(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError, match="circle"):
        spelling.spelling_variants(spark.createDataFrame([], "word string, n bigint"), ratio=1)


# --- 12 collocations ---------------------------------------------------------------------------


def collocations_of(rows, least: int, top: int, ratio: int = 100) -> list[tuple]:
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            f.update((lang, *ws[i : i + m]) for m in range(1, 6) for i in range(len(ws) - m + 1))
    often = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    inside = lambda p, q: any(q[i : i + len(p) - 1] == p[1:] for i in range(1, len(q) - len(p) + 2))
    out = []
    for p, a in often.items():
        if any(len(q) > len(p) and q[0] == p[0] and inside(p, q) and 100 * b >= ratio * a for q, b in often.items()):
            continue
        score, k = min((1000 * a * n[p[0]] // (f[p[: k + 1]] * f[(p[0], *p[k + 1 :])]), k) for k in range(1, len(p) - 1))
        out.append((p[0], score, a, " ".join(p[1:]), f[p[: k + 1]], f[(p[0], *p[k + 1 :])], n[p[0]]))
    out.sort(key=lambda x: (x[0], -x[1], -x[2], x[3].encode()))
    seen: Counter = Counter()
    ranked = []
    for lang, score, a, phrase, left, right, total in out:
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], phrase, a, left, right, total, score))
    return ranked


def phrases_in(n: int) -> list[tuple]:
    r = np.random.default_rng(8)
    words = ["The", "old", "MILL", "é", "ÀB", "'s", "x\x0by", "river", "#", " "]
    ends = [" ", " ", "  ", "\t", ". ", ",", "\n", " ! "]
    line = lambda k: "".join(w + e for w, e in zip(r.choice(words, k), r.choice(ends, k), strict=True))
    texts = [line(60) + "new york city hall " + line(5) + "a a a a b a a" for _ in range(n)]
    langs = ["en", "de", None, "en"]
    return [(langs[i % 4], t) for i, t in enumerate(texts)] + [("en", None), ("fr", ""), (None, " .;! "), ("en", "one")]


@pytest.mark.parametrize(("ratio", "bits"), [(100, 27), (60, 15)])
def test_collocations(spark, ratio, bits):
    """With few bits nearly all rare phrases slip through the bitmap: the counts must not change."""
    rows = phrases_in(40)
    docs = spark.createDataFrame([(t, lang, 1, "clash") for lang, t in rows], "text string, lang string, m int, phrase string").repartition(3)
    got = collocations.mine_collocations(docs, min_count=6, top=25, ratio=ratio, bits=bits).orderBy("lang", "rank").collect()
    assert len(got) > 50 and [tuple(x) for x in got] == collocations_of(rows, 6, 25, ratio)


def test_collocations_as_sql(spark):
    rows = phrases_in(160)
    documents = spark.createDataFrame(rows, "lang string, text string").toPandas()
    want = duckdb.sql(ORACLE_SQL["op12_collocations"] + " ORDER BY lang, rank").fetchall()
    assert len(documents) and want == collocations_of(rows, 100, 2000)


def test_scores_beyond_64_bits(spark):
    counts = spark.createDataFrame([("en", 2, "a b", 3 * 10**12), ("en", 1, "a", 10**13), ("en", 1, "b", 4 * 10**12)], "lang string, m int, phrase string, f bigint")
    (row,) = collocations.top_collocations(counts, spark.createDataFrame([("en", 10**15 + 7)], "lang string, n bigint")).collect()
    assert row["score"] == 1000 * 3 * 10**12 * (10**15 + 7) // (10**13 * 4 * 10**12)


def test_collocations_of_an_empty_table(spark):
    assert collocations.mine_collocations(spark.createDataFrame([], SCHEMA)).collect() == []


# --- 13 near vectors ---------------------------------------------------------------------------


def linked(rows, threshold: float = 0.95) -> set[tuple]:
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and len(v) and np.isfinite(np.array(v, float)).all() and np.any(v)]
    ids, n = [i for i, _ in good], len(good)
    unit = [v / np.abs(v).max() for _, v in good]
    unit = [v / np.linalg.norm(v) for v in unit]
    link = np.array([[a.shape == b.shape and a @ b >= threshold - 1e-12 for b in unit] for a in unit], bool).reshape(n, n)
    part = np.arange(n)
    while True:
        new = np.array([part[link[i]].min() for i in range(n)]) if n else part
        if (new == part).all():
            break
        part = new
    least: dict = {}
    for i, p in zip(ids, part, strict=True):
        least[p] = min(i, least.get(p, i))
    out = [(i, int(link[k].sum()) - 1, least[part[k]], i == least[part[k]]) for k, i in enumerate(ids)]
    return Counter(out + [(i, 0, i, i is not None) for i, v in rows if not any(i is j and v is not None and len(v) == len(w) and np.array_equal(v, w) for j, w in good)])


def copies(r, centre, n, noise):
    return [(centre + noise * r.standard_normal(len(centre)) / np.sqrt(len(centre))).tolist() for _ in range(n)]


@pytest.fixture(scope="module")
def points():
    """Strangers, pairs about the threshold, one group that holds a third of all, one with outliers, chains."""
    r = np.random.default_rng(1)
    d = 32
    far = r.standard_normal((300, d))
    far /= np.linalg.norm(far, axis=1, keepdims=True)
    vectors = far.tolist() + copies(r, far[0], 260, 0.1) + copies(r, far[1], 90, 0.22) + [v for k in range(2, 40) for v in copies(r, far[k], 2, 0.3)]
    vectors += [far[5].tolist()] * 30
    return [(int(i), [float(x) for x in v]) for i, v in zip(r.permutation(len(vectors)) + 10, vectors, strict=True)]


def test_near_vectors_find_links_and_invent_none(spark, points):
    docs = spark.createDataFrame([(i, v, 3, 1) for i, v in points], "vec_id bigint, embedding array<double>, node int, w int").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.link_vectors(docs).collect()}
    want = {i: (n, c, k) for i, n, c, k in linked(points)}
    assert len(got) == len(points)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _, _ in got.values()) >= 0.999 * sum(n for n, _, _ in want.values())
    assert sum(got[i] != want[i] for i in want) <= 2


def test_members_of_a_ball_are_never_paired(spark, points, monkeypatch):
    """The large group's 34,000 links come from its ball; what is stored as links stays in proportion to the rows."""
    seen, keep = [], near_vectors.durable

    def watched(df):
        out = keep(df)
        if out.columns == ["a", "b", "a_w", "b_w"]:
            seen.append(out.count())
        return out

    monkeypatch.setattr(near_vectors, "durable", watched)
    docs = spark.createDataFrame(points, "vec_id bigint, embedding array<double>")
    assert near_vectors.link_vectors(docs).agg(F.sum("n_links")).first()[0] > 60_000
    assert seen and seen[0] < 10 * len(points)


def test_estimates_are_unbiased_and_bounds_hold(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = 0.9 * x + np.sqrt(1 - 0.81) * r.standard_normal((400, 64)) / 8
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))], "node bigint, vector array<double>").coalesce(1)
    coded = rows.mapInArrow(near_vectors._encode(5, 4), near_vectors.CODED)
    q, o = coded.where("node < 400").alias("q"), coded.where("node >= 400").alias("o")
    paired = q.join(o, F.col("q.node") + 400 == F.col("o.node"))
    true = (x * y).sum(axis=1) / np.linalg.norm(y, axis=1)
    reached = [paired.where(near_vectors._estimate_reaches(t, 1)).count() for t in (0.0, 0.85, 1.6)]
    assert reached[0] == 400 and reached[1] == 400 and reached[2] < 40 and true.mean() > 0.85
    monkey, near_vectors.SURE = near_vectors.SURE, 0.0
    try:
        above = paired.where(near_vectors._estimate_reaches(float(np.median(true)), 1)).count()
    finally:
        near_vectors.SURE = monkey
    assert 160 <= above <= 240


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    nan, inf = float("nan"), float("inf")
    rows = [(1, v), (1, v), (2, [2.0, 4.0, 6.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 3.0]), (7, [1.0, nan, 1.0]), (8, [inf, 1.0, 1.0]), (None, v), (9, [1e300, 2e300, 3e300]), (10, [1e-300, 2e-300, 3e-300]), (11, [1.0, 2.0]), (12, [-1.0, -2.0, -3.0])]
    got = sorted((tuple(r) for r in near_vectors.link_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()), key=str)
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 11, 12)] + [(None, 0, None, False)]
    assert got == sorted([(1, 4, 1, True), (1, 4, 1, True), (2, 4, 1, False), (9, 4, 1, False), (10, 4, 1, False), *alone], key=str)


def test_near_vectors_of_empty_tables(spark):
    kind = "vec_id bigint, embedding array<float>"
    assert near_vectors.link_vectors(spark.createDataFrame([], kind)).collect() == []
    assert [tuple(r) for r in near_vectors.link_vectors(spark.createDataFrame([(1, None)], kind)).collect()] == [(1, 0, 1, True)]
