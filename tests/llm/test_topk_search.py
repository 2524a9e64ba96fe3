"""Exact search against brute force, what it prunes, and what it moves."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import topk_search as T


def brute(data, queries, k):
    out = []
    for q, v in queries:
        best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in data if j != q and len(w) == len(v))[:k]
        out += [(q, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    return sorted(out)


def answer(spark, data, queries, k, **sizes):
    make = lambda rows: spark.createDataFrame(rows, "id long, q array<bigint>")
    return sorted(tuple(r) for r in T.top_k(make(data), make(queries), k, **sizes).collect())


def clustered(n, dim=16, clusters=40, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    return np.floor(256 * (centres[rng.integers(0, clusters, n)] + 0.03 * rng.normal(size=(n, dim)))).astype(np.int64)


@given(st.integers(1, 5), st.integers(1, 60))
@settings(max_examples=40, deadline=None)
def test_search_group(seed, n):
    rng = np.random.default_rng(seed)
    v, ids = rng.integers(-40, 40, (n, 6)), rng.permutation(n) * 3
    blocks = [(ids[own], v[own]) for own in T.split(v, 4)]
    assert sorted(i for own, _ in blocks for i in own) == sorted(ids) and max(len(own) for own, _ in blocks) <= 4
    q, got, score, scored = T.search_group(ids[:7], v[:7], np.full(min(7, n), -np.inf), blocks, 3)
    for k in range(min(7, n)):
        want = sorted((-int(v[k] @ v[j]), int(ids[j])) for j in range(n) if ids[j] != ids[k])[:3]
        assert sorted((-int(s), int(i)) for a, i, s in zip(q, got, score) if a == k) == want
    assert scored <= min(7, n) * n


@given(st.integers(0, 10_000))
@settings(max_examples=100, deadline=None)
def test_no_score_is_above_its_bound(seed):
    rng = np.random.default_rng(seed)
    scale = 10 ** int(rng.integers(1, 9))
    v, q = rng.integers(-scale, scale, (20, 5)), rng.integers(-scale, scale, (6, 5))
    high, low, centre, radius = T._summary(v)
    assert (T._bounds(q, high[None], low[None], centre[None], np.array([radius]))[:, 0] >= (q @ v.T).max(1)).all()


def test_many_groups(spark):
    """Several rounds, and groups cut into chunks of queries."""
    rng = np.random.default_rng(4)
    v = rng.integers(-50, 50, (700, 5))
    data = [(int(i) * 2 - 300, x.tolist()) for i, x in enumerate(v)]
    assert answer(spark, data, data[::9], 4, block=8, group=24) == brute(data, data[::9], 4)


def test_chunks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(T, "QUERIES", 10)
    data = [(i, x.tolist()) for i, x in enumerate(np.random.default_rng(5).integers(-50, 50, (200, 4)))]
    assert answer(spark, data, data, 3, block=16, group=64) == brute(data, data, 3)


def test_ties_repeats_and_lengths(spark):
    data = [(i, [1, 1]) for i in range(40)] + [(5, [1, 1]), (100, [2, 2, 2]), (101, [3, 0, 0]), (102, [9])]
    data += [(200, []), (201, []), (202, [])]  # empty vectors: 0 with each other
    assert answer(spark, data, data[3:4] + data[41:], 4, block=4, group=8) == brute(data, data[3:4] + data[41:], 4)
    assert answer(spark, data, [], 4) == [] and answer(spark, [], data, 4) == []


def test_beyond_a_long_is_an_error(spark):
    big = 2**62
    with pytest.raises(Exception, match="beyond a long"):
        answer(spark, [(1, [big, big]), (2, [big, big])], [(1, [big, big])], 1)
    assert answer(spark, [(1, [2**31, 5]), (2, [2**31, -7])], [(1, [2**31, 5])], 1) == [(1, 1, 2, 2**62 - 35)]
    with pytest.raises(Exception, match="beyond a long"):
        T.quantised(spark.createDataFrame([(1, [1e300])], "vec_id long, embedding array<double>")).collect()


def test_clusters_are_pruned(spark):
    v = clustered(4000)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, q array<bigint>")
    share = T.scored_share(df, df.where("id % 50 = 0"), 5, block=32, group=512)
    assert share < 0.2


def test_rows_moved_grow_with_the_table(spark, monkeypatch):
    """At a fixed number of queries, the vectors that meet a query are no more than all, each once a round."""
    moved, keep = [], T.materialise

    def count(df, label, *more):
        out = keep(df, label, *more)
        if label in ("topk-index", "topk-pairs"):
            moved.append(out.count())
        return out

    monkeypatch.setattr(T, "materialise", count)
    totals = []
    for n in (1000, 2000, 4000):
        v = clustered(n)
        df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, q array<bigint>")
        moved.clear()
        T.top_k(df, df.where(F.col("id") < 20), 5, block=32, group=256).count()
        totals.append(sum(moved))
    assert totals[2] <= 4 * totals[0] * np.log2(4000) / np.log2(1000)


def test_groups_stay_small_however_many(spark, monkeypatch):
    """With two summaries at most, groups of the size given share them; no task holds more than a group."""
    monkeypatch.setattr(T, "GROUPS", 2)
    rng = np.random.default_rng(8)
    data = [(i, x.tolist()) for i, x in enumerate(rng.integers(-50, 50, (900, 5)))] + [(1000 + i, x.tolist()) for i, x in enumerate(rng.integers(-9, 9, (60, 3)))]
    df = spark.createDataFrame(data, "id long, q array<bigint>")
    index = T.Index(df, block=8, group=32)
    assert index.shared == 15 and sum(len(s[0]) for s in index.summaries.values()) <= 6
    sizes = index.blocks.where("b = -1").agg(F.max("n"), F.count("*")).first()
    assert sizes[0] <= 32 and sizes[1] >= 30
    asked = data[::31]
    assert answer(spark, data, asked, 4, block=8, group=32) == brute(data, asked, 4)
