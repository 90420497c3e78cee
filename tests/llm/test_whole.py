"""Numbered operators where a cut would show only on large or odd tables."""

from __future__ import annotations

import numpy as np

from pyspark.sql import functions as F

from slotscope.llm import exact_dedup, ngram_join, packing

from tests.llm.test_operators import check_components, prose


def test_packing_rounds_never_share_a_sequence(spark):
    n = 40_000 * packing.GROUP  # groups beyond 16384
    pieces = spark.range(2500).selectExpr("id AS doc_id", "0 AS piece", "CAST(0 AS BIGINT) AS start", "CAST(100 AS BIGINT) AS length", "id AS ids_crc32")
    first, again = ({r["sequence_id"] for r in packing._pack(pieces, packing.Capacity(), n, salt).collect()} for salt in (0, 1))
    assert len(first) > 2000 and len(again) > 2000
    assert not first & again


def test_both_texts_of_one_id_link(spark):
    a, b = prose(1, 300), prose(2, 300)
    rows = [(1, a), (1, b), (2, a + " tail"), (3, b + " tail")]
    for given in (rows, rows[::-1]):
        pairs = spark.createDataFrame([(1, 2), (1, 3)], "a bigint, b bigint")
        docs = spark.createDataFrame(given, "doc_id bigint, text string").coalesce(1)
        vectors = ngram_join.document_sets(docs, []).select(F.col("doc_id").alias("doc"), F.struct("n", "vector").alias("load"))
        assert {tuple(r) for r in ngram_join._verified(pairs, docs, vectors).collect()} == {(1, 2), (1, 3)}
        assert {r["component_id"] for r in ngram_join.near_duplicates(docs).collect()} == {1}


def test_short_vectors_of_long_texts_count_all_shingles(spark):
    n = 2_200_000
    docs = spark.range(1).selectExpr("id AS doc_id", f"array_join(transform(sequence(1, {n}), x -> CAST(x AS STRING)), ' ') AS text")
    (row,) = ngram_join.document_sets(docs, []).select("n", "short").collect()
    assert row["n"] == n - ngram_join.WORDS + 1
    assert np.frombuffer(row["short"], f"<u{len(row['short']) // ngram_join.SHORT}").sum(dtype=np.int64) == row["n"]


N_COPIES = 800


def edited(base: list[str], r: np.random.Generator, n: int) -> str:
    words = [*base]
    for k in r.choice(len(base), n, replace=False):
        words[k] = f"edit{r.integers(1 << 30)}"
    return " ".join(words)


def test_a_large_group_of_near_copies_stays_linear(spark, monkeypatch):
    """Copies that link with their original, rarely with one another; no round names more pairs than four times its rows."""
    r = np.random.default_rng(5)
    base = prose(1, 220).split()
    rows = [(N_COPIES // 2, " ".join(base))] + [(i if i < N_COPIES // 2 else i + 1, edited(base, r, 4)) for i in range(N_COPIES)]
    rows += [(90_000 + i, prose(10 + i, 80) + " " + " ".join(base[:60]) + " " + prose(5000 + i, 80)) for i in range(100)]
    monkeypatch.setattr(ngram_join, "BLOCK", 150)
    seen, search = [], ngram_join._searched

    def watched(rows, most):
        found = search(rows, most).cache()
        seen.append((found.count(), rows.count()))
        return found

    monkeypatch.setattr(ngram_join, "_searched", watched)
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[i] == 0 for i in range(N_COPIES + 1)) and all(got[90_000 + i] == 90_000 + i for i in range(100))
    assert seen and all(n <= rows for n, rows in seen[:1]) and sum(n for n, _ in seen) <= 2 * seen[0][1]


def watch_blocks(monkeypatch):
    """What goes into and out of ``blocks``."""
    seen, deal = [], ngram_join.blocks

    def watched(placed):
        out = deal(placed)
        seen.append((placed.count(), out.count()))
        return out

    monkeypatch.setattr(ngram_join, "blocks", watched)
    return seen


def test_texts_of_a_template_below_the_threshold_meet_nowhere(spark, monkeypatch):
    """Unlinked texts that share four fifths of their shingles: their common ones lead in none of them."""
    monkeypatch.setattr(ngram_join, "BLOCK", 50)
    seen = watch_blocks(monkeypatch)
    base = prose(3, 160)
    rows = [(i, base + " " + prose(7000 + i, 38)) for i in range(1500)]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert all(r["doc_id"] == r["component_id"] for r in got)
    assert sum(out for _, out in seen) <= len(rows)


def test_an_unlinked_bucket_is_divided_not_copied(spark, monkeypatch):
    """Rows that lead in one bucket and share nothing else: the bucket parts, and none is copied to all blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", 100)
    n = 5000
    points = spark.range(n).selectExpr("id AS doc", "CAST(100 AS BIGINT) AS n", "concat(array(CAST(-1 AS BIGINT)), transform(sequence(1, 21), x -> id * 100 + x)) AS prefix")
    placed = ngram_join.prefix_tokens(points).where("token = -1").withColumn("comp", F.col("doc"))
    assert placed.where("lead").count() == n
    assert ngram_join.blocks(placed).count() > 40 * n
    assert ngram_join.blocks(ngram_join.divided(placed, points)).count() == 0


def test_divided_buckets_lose_no_link(spark, monkeypatch):
    """Chains of edits, mates of unlike lengths and a passage shared by all, with buckets divided and dealt into tiny blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "FREQUENT", 1 << 30)  # no order by frequency, so that common shingles lead
    parted, divide = [], ngram_join.divided

    def watched(placed, points):
        out = divide(placed, points)
        parted.append(out is not placed)
        return out

    monkeypatch.setattr(ngram_join, "divided", watched)
    r = np.random.default_rng(8)
    passage, rows = prose(77, 60), []
    for k in range(30):
        base = (prose(900 + k, 25) + " " + passage).split()
        for v in range(4):
            rows.append((10 * k + v, edited(base, r, v)))
        rows.append((10 * k + 7, " ".join(base + [f"tail{k}x{i}" for i in range(3 * (k % 8))])))
    check_components(spark, rows)
    assert any(parted)


def test_hot_holders_are_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PARTNERS", 7)
    held = spark.range(200).selectExpr("id AS doc", "id % 3 AS load")
    pairs = spark.range(1, 200).selectExpr("CAST(0 AS BIGINT) AS a", "id AS b")
    got = {(x["a"], x["b"]) for x in ngram_join._approved(pairs, held, lambda x, y: x == y).collect()}
    assert got == {(0, b) for b in range(1, 200) if b % 3 == 0}


def test_dedup_of_tasks_with_several_batches(spark):
    rows = spark.range(45_000).selectExpr("id AS doc_id", "CAST(id % 30000 AS STRING) AS text").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        got = exact_dedup.exact_dedup(rows).groupBy("kept").count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {x["kept"]: x["count"] for x in got} == {True: 30_000, False: 15_000}
