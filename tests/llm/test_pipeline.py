"""The pipeline stage by stage on the small tables."""

from __future__ import annotations

import corpus_pipeline as P
from corpusloom.llm.common import materialise

from .test_contracts import pii, quality, simhash


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in P.STAGES:
        out = materialise(stage(spark, docs, small), "test")
        if name != P.STAGES[-1][0]:
            assert out.columns == columns
        seen[name] = (docs.select("doc_id", "text").collect(), out.collect())
        docs = out
    before, after = seen["quality_rules"]
    assert sorted(str(r.doc_id) for r in after) == sorted(str(r.doc_id) for r in before if quality(r.text)[-1])
    before, after = seen["simhash_near_dedup"]
    fps = [simhash(r.text) for r in after]
    assert all(bin(a ^ b).count("1") > 4 for i, a in enumerate(fps) for b in fps[:i])
    assert len(after) >= len({simhash(r.text) for r in before}) / 8
    assert not any(pii(r.text or "") for r in seen["pii"][1])
    assert {r.doc_id for r in seen["mix_sources"][1]} <= {r.doc_id for r in seen["mix_sources"][0]}
    assert len(seen["byte_bpe"][1]) == len(seen["byte_bpe"][0])


def test_run(spark, small, empty):
    assert P.run(spark, small).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert P.run(spark, empty).count() == 0
