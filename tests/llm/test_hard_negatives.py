"""Hard negatives against brute force, what a search visits, and every awkward row."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import hard_negatives as H

SCHEMA = "id long, label long, q array<bigint>"


def brute(data, anchors, positives=5, negatives=5, low=80):
    out = []
    for a, label, q in anchors:
        scores = [(-sum(x * y for x, y in zip(q, v)), i, other) for i, other, v in data if i != a and len(v) == len(q)]
        for sp, p in sorted((s, i) for s, i, other in scores if other == label)[:positives]:
            some = sorted((s, i) for s, i, other in scores if other != label and low * -sp <= 100 * -s <= 100 * -sp)[:negatives]
            out += [(a, p, n, i, -sp, -s) for n, (s, i) in enumerate(some, 1)]
    return sorted(out)


def answer(spark, data, anchors, **sizes):
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in H.hard_negatives(make(data), make(anchors), **sizes).collect())


def clustered(n, dim=12, clusters=40, labels=4, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    v = np.floor(256 * (centres[rng.integers(0, clusters, n)] + 0.03 * rng.normal(size=(n, dim)))).astype(np.int64)
    return [(i, int(c), x.tolist()) for i, (c, x) in enumerate(zip(rng.integers(0, labels, n), v))]


@given(st.integers(0, 1000), st.integers(1, 6))
@settings(max_examples=60, deadline=None)
def test_best_of(seed, k):
    rng = np.random.default_rng(seed)
    scores = rng.integers(-5, 5, (4, int(rng.integers(1, 12)))) * int(rng.choice([1, 2**58]))
    valid = rng.random(scores.shape) < 0.7
    row, col = H.best_of(scores, valid, k)
    for r in range(4):
        want = sorted((-int(s), c) for c, s in enumerate(scores[r]) if valid[r, c])[:k]
        assert sorted((-int(scores[r, c]), int(c)) for c in col[row == r]) == want


def test_small_chunks_and_several_rounds(spark):
    data = clustered(900)
    assert answer(spark, data, data[::45], chunk=16, parts=8) == brute(data, data[::45])


def test_unlike_lengths_norms_and_a_rare_label(spark):
    rng = np.random.default_rng(2)
    data = [(int(i), int(rng.integers(0, 3)), (rng.integers(-9, 9, 4) * int(rng.choice([1, 30]))).tolist()) for i in rng.permutation(300)]
    data += [(1000 + i, i % 2, rng.integers(-9, 9, 3).tolist()) for i in range(12)] + [(2000 + i, i % 2, []) for i in range(4)]
    data += [(3000, 77, [5, 5, 5, 5]), (3001, 0, [0, 0, 0, 0]), (3002, 0, [0, 0, 0, 0]), (-7, 1, [1, 2, 3, 4])]
    anchors = data[::23] + data[300:]
    assert answer(spark, data, anchors, chunk=16, parts=4) == brute(data, anchors)


def test_copies_and_ties(spark):
    """A third of all rows one vector, in both labels: only the first of them can be among the best."""
    data = [(i, i % 2, [4, 3]) for i in range(60)] + [(100 + i, i % 3, [4 + i % 2, 3]) for i in range(40)] + [(100, 1, [5, 3]), (7, 0, [4, 3])]
    anchors = data[:3] + data[60:64] + [(999, 1, [4, 3])]
    assert answer(spark, data, anchors, chunk=8) == brute(data, anchors)
    rows = spark.createDataFrame(data, SCHEMA)
    assert H.first_copies(rows, 6).where("label = 0 and q = array(4l, 3l)").count() == 6


def test_empty_sides(spark):
    data = clustered(20)
    assert answer(spark, [], data[:2]) == [] and answer(spark, data, []) == []
    assert answer(spark, data[:1], data[:1]) == []


def test_scores_beyond(spark):
    big = 2**62
    with pytest.raises(Exception, match="beyond a long"):
        answer(spark, [(1, 0, [big, big]), (2, 0, [big, big])], [(1, 0, [big, big])])
    data = [(i, i % 2, [2**30 + 1000 * i, -i]) for i in range(12)]
    assert answer(spark, data, data[:3]) == brute(data, data[:3])


def test_visits_are_few_on_clusters_and_never_twice(spark):
    data = clustered(6000)
    rows = spark.createDataFrame(data, SCHEMA)
    index = H.KeyIndex(rows, 5, chunk=64, parts=64)
    known = H.asked(index, rows.where("id % 60 = 0"))
    free = known.withColumn("hi_score", F.array(F.lit(2**63 - 1))).withColumn("lo_score", F.array(F.lit(-(2**63)).cast("long"))).withColumn("r", F.least("start", "far"))
    _, rounds = H.search(index, free, 5, True)
    pairs = [tuple(r) for due in rounds for r in due.select("qn", "chunk").collect()]
    assert len(pairs) == len(set(pairs)) and len(pairs) < 0.25 * 100 * index.chunks.count()
    assert index.chunks.agg(F.max("n")).first()[0] <= 64


def test_table(spark, small, empty):
    got = sorted(tuple(r) for r in H.op11(spark, small).collect())
    data = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], [int(np.floor(256 * x)) for x in r["embedding"]])
            for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()
            if r["vec_id"] is not None and r["label"] is not None and r["embedding"] is not None and all(x is not None and np.isfinite(x) for x in r["embedding"])]
    assert got == brute(data, [d for d in data if d[0] % 100 == 0]) and got
    assert H.op11(spark, empty).collect() == []
