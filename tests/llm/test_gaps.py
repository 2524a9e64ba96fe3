"""Awkward rows operator by operator, and whole queries against plain versions, where the other tests don't reach."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import byte_bpe, common, cube_mix, feistel_shard, fm_quality, quality_rules, token_cache, topk_search
import public_tokenizers

from .test_contracts import quality


def test_classifier_against_all_pairs(spark, small):
    """Op 5's scores: bias, linear weights and every pair of features, one by one."""
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    machine = fm_quality.train(docs, labels)
    weights, factors = machine.linear.astype(np.float32).astype(float), machine.factors.astype(np.float32).astype(float)
    want = Counter()
    for r in docs.select("doc_id", "text", "n_chars").collect():
        i, x = fm_quality.features(r.text, r.n_chars)
        assert len(set(i.tolist())) == len(i) <= fm_quality.DIM
        v = factors[i] * x[:, None]
        gram = v @ v.T
        pairs = sum(gram[a, b] for a in range(len(i)) for b in range(a)) if len(i) < 60 else float(np.tril(gram, -1).sum())
        margin = machine.bias + float(weights[i] @ x) + pairs
        want[r.doc_id, round(1 / (1 + math.exp(-margin)), 5)] += 1
    got = fm_quality.op5(spark, small).collect()
    assert Counter((r.doc_id, round(r.score, 5)) for r in got) == want
    assert all(r.predicted == (r.score >= 0.7) for r in got)


def test_labels_and_sources_are_no_input(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    machine = fm_quality.train(docs, labels)
    other = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("zz")).withColumn("doc_id", F.col("doc_id") + 1_000_000)
    scores = lambda df: sorted(r.score for r in fm_quality.score_documents(df, machine).collect())
    assert scores(docs) == scores(other)


def test_keep_quality_reads_long_texts_whole(spark):
    rng = random.Random(1)
    good = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(120_000))
    late = good + " # # # #" * 40_000  # only the end is bad
    data = [(1, good), (2, late), (3, None), (4, ""), (5, good), (5, good)]
    got = quality_rules.keep_quality(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, t in data if quality(t)[-1]) == [1, 5, 5]


def test_cascade_order_counts_what_is_left(spark):
    """A rule that rejects only what a cheaper one rejects comes after one that rejects others."""
    docs = spark.range(1000).selectExpr("id AS doc_id", "CAST(id AS string) AS text")
    rules = {"a": F.col("doc_id") < 600, "b": F.col("doc_id") < 590, "c": F.col("doc_id") >= 900}
    rules = {k: F.col("text").cast("long") < 600 if k == "a" else F.col("text").cast("long") < 590 if k == "b" else F.col("text").cast("long") >= 900 for k in rules}
    order = quality_rules.cascade_order(docs, rules)
    assert order.index("c") < max(order.index("a"), order.index("b"))


def test_mix_of_null_and_empty_texts(spark):
    data = [(i, None if i % 3 == 0 else "" if i % 3 == 1 else "two words", "a" if i < 30 else None) for i in range(60)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    counts = {r.doc_id: r for r in cube_mix.mix_counts(docs).collect()}
    assert all(r["size"] == (2 if i % 3 == 2 else 0) and r.copies in (0, 1, 2) for i, r in counts.items())
    taken = Counter(r.doc_id for r in cube_mix.take_mix(docs).collect())
    assert taken == Counter({i: r.copies for i, r in counts.items() if r.copies})
    only_empty = docs.where("text IS NULL OR text = ''")
    assert all(r.target == 0 and r.copies == 0 for r in cube_mix.mix_counts(only_empty).collect())


def test_counts_of_repeated_rows_and_clashing_names(spark):
    data = [(1, "one two", "x", 7)] * 3 + [(2, None, "y", 8), (None, "one two", "z", 9)]
    docs = spark.createDataFrame(data, "doc_id long, text string, digest string, n_tokens int")
    path = public_tokenizers.path("byte_bpe_50k.json")
    n = token_cache.counter(path)("one two")
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_cache.count_tokens(docs, path).collect())
    assert got == Counter({(1, 7, n): 3, (2, 0, 0): 1, (None, 7, n): 1})


def test_shards_of_long_texts(spark):
    long = "é" * 300_000
    got = {r.doc_id: r["size"] for r in feistel_shard.shard_rows(spark.createDataFrame([(1, long), (2, ""), (3, None)], "doc_id long, text string"), 2).collect()}
    assert got == {1: 600_008, 2: 8, 3: 8}


def test_repeated_and_long_documents_in_bpe(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    long = "word and another, " * 100_000 + "x" * 200
    docs = spark.createDataFrame([(1, long), (1, long), (2, "short")], "doc_id long, text string")
    got = byte_bpe.encode_documents(docs, path)
    assert sorted((r.doc_id, r.text) for r in byte_bpe.decode_documents(got, path).collect()) == [(1, long), (1, long), (2, "short")]
    rows = byte_bpe.round_trip(docs, path).collect()
    assert {(r.doc_id, r.n_tokens) for r in rows} == {(r.doc_id, len(r.ids)) for r in got.collect()} and len(rows) == 3


def test_bpe_generations():
    """A memo that is full all the time changes nothing."""
    bpe = byte_bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 90))) for _ in range(30)) for _ in range(60)]
    want = list(bpe.digests(texts))
    limit, together, byte_bpe.MEMO, byte_bpe.TOGETHER = byte_bpe.MEMO, byte_bpe.TOGETHER, 20, 500
    try:
        assert list(bpe.digests(texts)) == want
    finally:
        byte_bpe.MEMO, byte_bpe.TOGETHER = limit, together
    assert [n for n, *_ in want] == [len(bpe.encode(t)) for t in texts]


def test_hashed_sample(spark):
    df = spark.range(5000).selectExpr("id", "id % 7 AS v")
    a = sorted(r.id for r in common.hashed_sample(df, ["id"], 300).collect())
    assert a == sorted(r.id for r in common.hashed_sample(df.repartition(13), ["id"], 300).collect()) and len(a) == 300
    assert common.hashed_sample(df, ["v"], 300).count() == 7  # rows of one hash count once
    assert common.hashed_sample(df.limit(0), ["id"], 10).count() == 0


def test_join_unique(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    left = common.materialise(spark.range(1000).selectExpr("id", "IF(id % 3 = 0, 5, id % 50) AS k").unionByName(spark.sql("SELECT -1L AS id, NULL AS k")), "test")
    right = common.materialise(spark.range(40).selectExpr("id AS key", "id * id AS v"), "test")
    for how in ("inner", "left"):
        want = left.join(right, left["k"] == right["key"], how)
        got = common.join_unique(left, right, "k", "key", how)
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_scratch_tables_go(spark):
    import os

    root = common.scratch_root(spark).removeprefix("file://") + "/corpusloom"
    with common.scratch(spark):
        inside = common.materialise(spark.range(3), "inside")
        assert inside.count() == 3
        kept = common.written(inside, f"{common.scratch_root(spark)}/kept-{os.getpid()}")
    assert kept.count() == 3 and not [p for p in os.listdir(root) if p.startswith("inside-")]


def test_scratch_needs_a_shared_folder():
    class Cluster:
        class sparkContext:
            master = "spark://somewhere:7077"

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch_root(Cluster)


def test_pipeline_deletes_what_it_has_used(spark, small):
    import os

    import corpus_pipeline as P

    root = common.scratch_root(spark).removeprefix("file://") + "/corpusloom"
    before = set(os.listdir(root))
    out = P.run(spark, small)
    assert out.count() and sorted(p.rsplit("-", 1)[0] for p in set(os.listdir(root)) - before) == ["stage-byte_bpe"]


def test_top_k_of_one_vector(spark):
    df = spark.createDataFrame([(50, [1, 2])], "id long, q array<bigint>")
    assert topk_search.top_k(df, df).collect() == []
