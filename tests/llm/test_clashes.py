"""Callers' columns that have the names of helpers keep their names and values through every operator that keeps columns."""

from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import cube_mix, feistel_shard, pii_boost, quality_rules, simhash_dedup

from .conftest import CLASHES

STAGES = {
    "quality": quality_rules.keep_quality,
    "near_dedup": simhash_dedup.keep_one,
    "pii": pii_boost.redact,
    "mix": cube_mix.take_mix,
}


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.mark.parametrize("name", sorted(STAGES))
def test_columns_and_values(docs, name):
    out = STAGES[name](docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[c] == f"clash of {c}" for r in rows for c in CLASHES if c not in ("doc_id", "text"))
    ids = {r["doc_id"]: (r["lang"], r["source"]) for r in docs.collect()}
    assert all((r["lang"], r["source"]) == ids[r["doc_id"]] for r in rows if r["doc_id"] is not None)


def test_shards(spark, docs, tmp_path):
    feistel_shard.write_shards(docs, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert set(back.columns) == {*(c for c in docs.columns if c not in ("shard", "slot")), "shard_", "slot_", "shard", "slot"}
    rows = back.collect()
    assert len(rows) == docs.count()
    for c in CLASHES:
        own = f"{c}_" if c in ("shard", "slot") else c
        assert {r[own] for r in rows} == {f"clash of {c}"}, c
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 4
    once = feistel_shard.numbered(docs.drop("row_number"), ["doc_id"])
    assert {r["__at"] for r in once.collect()} == {"clash of __at"} and once.agg(F.max("row_number")).first()[0] == docs.count() - 1
    with pytest.raises(ValueError, match="row_number"):
        feistel_shard.numbered(docs, ["doc_id"])


def test_an_empty_table(spark, empty, tmp_path):
    none = spark.read.parquet(f"{empty}/documents.parquet")
    for stage in STAGES.values():
        assert stage(none).count() == 0
    feistel_shard.write_shards(none, str(tmp_path / "s"), 4)
    assert corpus_pipeline.run(spark, empty).count() == 0
