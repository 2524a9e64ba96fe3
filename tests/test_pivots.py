"""Tiles that the triangle inequality rules out: few are left on clusters, and none that hold a pair are lost."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import vectors as V


def clustered(n, dim=16, clusters=30, seed=3, noise=0.02):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    return centres[rng.integers(0, clusters, n)] + noise * rng.normal(size=(n, dim))


def frame(spark, v, blocks=1):
    return spark.createDataFrame([(i % blocks, i, x.tolist()) for i, x in enumerate(v)], "g int, id long, v array<double>")


def unit_rows(df):
    return df.select(F.col("g").alias("b"), F.col("id").alias("k"), V.l2_normalised(F.col("v")).alias("v"), F.lit(0.0).alias("w"))


def test_pairs_of_tiles_on_clusters(spark, monkeypatch):
    """The figure of the README: below a tenth of all pairs of tiles meet, and the result is that of all pairs."""
    monkeypatch.setattr(V, "TILE", 16)
    v = clustered(3000)
    df = frame(spark, v)
    unit = unit_rows(df)
    tiles = V._tiles(unit, V._pivots(unit), 16)
    n = tiles.count()
    met = V.tile_pairs(tiles, 0.95).count()
    assert n > 150 and met < 0.1 * n * (n + 1) / 2, (n, met)
    got = {(r["a"], r["b"]): r["cosine"] for r in V.cosine_pairs(df, "g", "id", "v", 0.95, most=None).collect()}
    u = v / np.linalg.norm(v, axis=1)[:, None]
    c = np.triu(u @ u.T, 1)
    want = {(int(a), int(b)): c[a, b] for a, b in zip(*np.nonzero(c >= 0.95))}
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-4 for p in want)


def test_nearest_visits_few_tiles(spark, monkeypatch):
    monkeypatch.setattr(V, "TILE", 16)
    met, keep = [], V._met

    def count(pairs, *more):
        met.append(pairs.count())
        return keep(pairs, *more)

    monkeypatch.setattr(V, "_met", count)
    v = clustered(2000, noise=0.01)
    df = frame(spark, v)
    got = {(r["query"], r["rank"]): (r["id"], r["cosine"]) for r in V.nearest(df.where("id % 20 = 0"), df, "id", "v", "g", 3).collect()}
    u = v / np.linalg.norm(v, axis=1)[:, None]
    for q in range(0, 2000, 20):
        best = sorted((-round(float(u[q] @ u[j]), 4), j) for j in range(2000) if j != q)[:3]
        assert [got[q, r + 1][1] for r in range(3)] == pytest.approx([-c for c, _ in best], abs=1e-4)
    assert len(got) == 300 and sum(met) < 0.3 * 25 * 125, met


@pytest.mark.parametrize("threshold", [0.6, 0.0, -0.5])
def test_awkward_vectors(spark, monkeypatch, threshold):
    """Zero vectors, which have no angle, unlike lengths, copies, null blocks, keys and vectors that repeat."""
    monkeypatch.setattr(V, "TILE", 5)
    rng = np.random.default_rng(6)
    rows = [(int(i % 3), int(i), rng.normal(size=int(rng.integers(2, 5))).tolist()) for i in range(60)]
    rows += [(0, 100 + i, [0.0, 0.0]) for i in range(4)] + [(1, 200 + i, [1.0, 2.0]) for i in range(20)] + [(None, 300, [1.0, 0.0]), (0, 301, None)]
    df = spark.createDataFrame(rows, "g int, id long, v array<double>")
    got = {(r["g"], r["a"], r["b"]) for r in V.cosine_pairs(df, "g", "id", "v", threshold, most=None).collect()}

    def unit(v):
        n = sum(x * x for x in v) ** 0.5
        return [x / n for x in v] if n else v

    kept = [(g, i, unit(v)) for g, i, v in rows if g is not None and v is not None]
    want = {(g, i, j) for g, i, v in kept for h, j, w in kept if g == h and i < j and sum(x * y for x, y in zip(v, w)) >= threshold}
    assert got == want
    assert V.cosine_pairs(df.where("id < 0"), "g", "id", "v", threshold).count() == 0
    near = V.nearest(df.where("id % 7 = 0"), df, "id", "v", "g", 4).groupBy("query").count().collect()
    assert {r["query"]: r["count"] for r in near} == {i: 4 for _, i, _ in kept if i % 7 == 0}
