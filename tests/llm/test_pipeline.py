"""The pipeline's stages against brute force, one after the other."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from slotscope.llm import mixing, packing, quality_rules
from slotscope.llm.queries import SHARE, TARGETS, tokenizer_path
from tests.llm.test_operators import SCHEMA, awkward, brute_components, prose


def test_stages(spark, tmp_path):
    rows = [*awkward(), *[(100 + i, prose(900 + i % 30, 60) + (" more words" if i > 30 else ""), "de", "src9", 1, 2, "x") for i in range(60)]]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = [r for r in rows if not any(x.rejects(quality_rules.Text(r[1])) for x in (quality_rules.BASE, *quality_rules.RULES))]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "exact_dedup", "ngram_join", "mixing", "packing"]

    good = stages["quality_rules"](spark, docs, str(tmp_path))
    assert good.columns == docs.columns
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in good.collect()))) == sorted(map(str, ((r[0], r[1]) for r in kept)))

    best: dict[str, int | None] = {}
    for i, t, *_ in kept:
        best[t] = max((x for x in (best.get(t), i) if x is not None), default=None)
    once = stages["exact_dedup"](spark, good, str(tmp_path))
    assert sorted((str(r["text"]), r["doc_id"]) for r in once.collect()) == sorted((str(t), i) for t, i in best.items())

    comps = brute_components([(i, t) for t, i in best.items()])
    near = stages["ngram_join"](spark, once, str(tmp_path))
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(i for i, (_, c) in comps.items() if i == c)

    mixed = stages["mixing"](spark, near, str(tmp_path))
    sampled = {r["doc_id"] for r in mixing.mix(near, TARGETS, SHARE).where("sampled").collect()}
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} == sampled

    packed = stages["packing"](spark, mixed, str(tmp_path)).collect()
    t = packing.WordTokenizer(tokenizer_path()).tokenizer
    want = {r["doc_id"]: len(t.encode(r["text"], add_special_tokens=False).ids) + 1 for r in mixed.collect()}
    got: dict[int, int] = {}
    for r in packed:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want
    assert len(packed) == sum(int(np.ceil(n / 4096)) for n in want.values())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)
