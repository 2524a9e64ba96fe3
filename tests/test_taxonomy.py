"""Blind clusters, the null of an alignment, topology and propagation in place, against plain Python."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import graph as G
from corpusloom.operators import taxonomy as X

EDGES = "a string, b string, n_groups long"


def graph(kind: str, seed: int):
    rng = random.Random(seed)
    if kind == "clusters":
        name = lambda c, i: f"c{c}n{i:02}"
        e = {(name(c, i), name(c, j)) for c in range(4) for i in range(8) for j in range(i + 1, 8) if rng.random() < 0.6}
        e |= {(name(c, 0), name(c + 1, 1)) for c in range(2)}
    elif kind == "path":
        e = {(f"p{i:03}", f"p{i + 1:03}") for i in range(60)}
    elif kind == "hub":
        e = {("hub", f"l{i:04}") for i in range(800)} | {(f"l{i:04}", f"l{i + 1:04}") for i in range(0, 60, 3)}
    else:
        e = {tuple(sorted(rng.sample([f"n{i:02}" for i in range(30)], 2))) for _ in range(45)}
    return [(min(p), max(p), rng.randint(1, 5)) for p in sorted(e)]


def in_place(edges, rounds=10, seed=42):
    near = defaultdict(dict)
    for a, b, w in edges:
        near[a][b] = near[b][a] = w
    labels = {n: n for n in near}
    order = sorted(near, key=lambda n: (hashlib.md5(f"{seed}|{n}".encode()).hexdigest(), n))
    for _ in range(rounds):
        moved = False
        for n in order:
            votes = Counter()
            for m, w in near[n].items():
                votes[labels[m]] += w
            best = max(votes.items(), key=lambda x: (x[1], x[0]))[0]
            moved |= best != labels[n]
            labels[n] = best
        if not moved:
            break
    return labels


def roots(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b, _ in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in up}


@pytest.mark.parametrize("kind", ["clusters", "path", "hub", "random"])
@pytest.mark.parametrize("seed", [1, 2])
def test_propagation_and_components(spark, kind, seed):
    edges = graph(kind, seed)
    df = spark.createDataFrame(edges, EDGES).repartition(3 + seed)
    got = {r["node"]: r["label"] for r in G.ordered_propagation(df, seed=seed, rounds=4).collect()}
    assert got == in_place(edges, 4, seed)
    if kind == "clusters":
        assert len(set(got.values())) > 2
    assert {r["node"]: r["root"] for r in X.components(df).collect()} == roots(edges)


@pytest.mark.parametrize("kind", ["clusters", "hub", "random"])
def test_topology(spark, kind):
    edges = graph(kind, 3)
    near = defaultdict(set)
    for a, b, _ in edges:
        near[a].add(b)
        near[b].add(a)
    labels, m = in_place(edges), len(edges)
    closed = sum(b in near[a] and c in near[a] and c in near[b] for a in near for b, c in combinations(sorted(near[a]), 2) if a < b < c)
    wedges = sum(len(s) * (len(s) - 1) // 2 for s in near.values())
    degree = Counter()
    for n, s in near.items():
        degree[labels[n]] += len(s)
    q = sum(labels[a] == labels[b] for a, b, _ in edges) / m - sum((d / (2 * m)) ** 2 for d in degree.values())
    sizes = Counter(roots(edges).values())
    row = X.topology(spark.createDataFrame(edges, EDGES)).first()
    assert (row["nodes"], row["edges"], row["components"], row["triangles"], row["communities"]) == (len(near), m, len(sizes), closed, len(degree))
    want = (round(max(sizes.values()) / len(near), 4), round(3 * closed / wedges, 4), round(q, 4))
    assert (row["giant_share"], row["clustering"], row["modularity"]) == pytest.approx(want, abs=1.01e-4)


def test_a_hub_pairs_few_ends(spark):
    """The pairs of ends that are looked up for 800 leaves of one hub are those of the leaves, not the square of the hub's."""
    edges = spark.createDataFrame(graph("hub", 1), EDGES)
    plan = X.triangles(edges)
    assert plan.first()["triangles"] == 20
    d = {r["node"]: r["degree"] for r in X.degrees(edges).collect()}
    out = Counter(min((d[a], a), (d[b], b))[1] for a, b, _ in graph("hub", 1))
    assert sum(k * (k - 1) // 2 for k in out.values()) <= 60


def test_no_edges(spark):
    none = spark.createDataFrame([], EDGES)
    assert X.components(none).count() == 0 and G.ordered_propagation(none).count() == 0
    row = X.topology(none).first()
    assert row["nodes"] == row["edges"] == row["triangles"] == 0 and row["modularity"] is None
    assert X.ks_test(none.select("n_groups"), none.select("n_groups"), "n_groups").first()["ks"] is None


def clusters_by_hand(rows, k, rounds):
    rows = sorted(rows, key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0]))
    gap2 = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    centres = [rows[0][1]]
    while len(centres) < k:
        far = [min(gap2(q, c) for c in centres) for _, q in rows]
        if max(far) == 0:
            break
        centres.append(rows[far.index(max(far))][1])
    near = lambda q: min(range(len(centres)), key=lambda c: (gap2(q, centres[c]), c))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, q in rows:
            own[near(q)].append(q)
        centres = [[(2 * sum(x) + len(own[c])) // (2 * len(own[c])) for x in zip(*own[c])] if own[c] else v for c, v in enumerate(centres)]
    return {i: near(q) for i, q in rows}, centres


@pytest.mark.parametrize("parts", [1, 5])
def test_blind_clusters(spark, parts):
    rng = random.Random(4)
    rows = [(i, [rng.randint(-9, 9) + 20 * (i % 3), rng.randint(-9, 9), -(i % 2)]) for i in range(90)] + [(100 + i, [1, 1, 1]) for i in range(9)]
    df = spark.createDataFrame(rows, "key long, q array<bigint>").repartition(parts)
    got, centres = X.blind_clusters(df, 7, 3)
    want, at = clusters_by_hand(rows, 7, 3)
    assert {r["key"]: r["cluster"] for r in got.collect()} == want and centres.tolist() == at
    few, _ = X.blind_clusters(df.where("key >= 100"), 7, 3)  # one vector nine times is one cluster
    assert {r["cluster"] for r in few.collect()} == {0}
    assert X.blind_clusters(df.where("key < 0"), 3)[0].count() == 0
    awkward = spark.createDataFrame([(1, [0.5, None]), (2, None), (3, [float("nan"), 1.0]), (4, [-0.001, 0.5]), (None, [0.1, 0.1])], "k long, v array<double>")
    assert [tuple(r) for r in X.integer_vectors(awkward, "k", "v").collect()] == [(4, [-1, 128])]


def spearman(x, y):
    def rank(v):
        order = sorted(v)
        return [order.index(e) + (order.count(e) - 1) / 2 for e in v]

    return np.corrcoef(rank(x), rank(y))[0, 1]


def test_partner_null(spark):
    rng, n, k = random.Random(8), 40, 9
    first = {p: rng.randint(1, 6) for p in combinations(range(k), 2) if rng.random() < 0.6}
    partners = [rng.randrange(12) for _ in range(k)]
    second = {p: first.get((min(p), max(p)), 0) + rng.randint(1, 2) for p in combinations(range(12), 2) if rng.random() < 0.7}
    web = lambda e: spark.createDataFrame([(a, b, w) for (a, b), w in e.items()], "a int, b int, n_groups long")
    rows = {r["statistic"]: r for r in X.partner_null(web(first), web(second), spark.createDataFrame(list(enumerate(partners)), "cluster int, partner int"), n).collect()}

    def both(perm):
        order = sorted(range(k), key=lambda c: (hashlib.md5(f"42|{perm}|{c}".encode()).hexdigest() if perm else "", c))
        f = {c: partners[order[i]] for i, c in enumerate(range(k))}
        x = [first.get(p, 0) for p in combinations(range(k), 2)]
        y = [second.get((min(f[a], f[b]), max(f[a], f[b])), 0) if f[a] != f[b] else 0 for a, b in combinations(range(k), 2)]
        return round(spearman(x, y), 6), round(sum(a > 0 and b > 0 for a, b in zip(x, y)) / len(first), 6)

    for i, name in enumerate(("spearman", "reproduction")):
        seen, null = both(0)[i], [both(p)[i] for p in range(1, n + 1)]
        row = rows[name]
        want = (seen, np.mean(null), np.std(null), max(null), sorted(null)[38])
        assert (row["observed"], row["null_mean"], row["null_sd"], row["null_max"], row["null_q975"]) == pytest.approx(want, abs=1e-4)
        assert row["beaten"] == sum(v < seen for v in null) and row["p"] == round((sum(v >= seen for v in null) + 1) / (n + 1), 5)


def test_ks(spark):
    make = lambda v: spark.createDataFrame([(x,) for x in v], "v long")
    a, b = [1, 2, 2, 3, 9] * 20, [2, 3, 3, 4, 9] * 15
    gap = max(abs(np.mean(np.array(a) <= x) - np.mean(np.array(b) <= x)) for x in set(a + b))
    row = X.ks_test(make(a), make(b), "v").first()
    root = (100 * 75 / 175) ** 0.5
    lam = (root + 0.12 + 0.11 / root) * gap
    p = 2 * sum((-1) ** (j - 1) * np.exp(-2 * j * j * lam * lam) for j in range(1, 101))
    assert (row["n_a"], row["n_b"], row["ks"], row["ks_p"]) == (100, 75, pytest.approx(gap, abs=1e-4), pytest.approx(p, abs=1e-4))
    assert X.ks_test(make(a), make(a), "v").first()["ks_p"] == 1.0
    assert X.degrees(spark.createDataFrame([("x", "y", 1)], EDGES)).agg(F.sum("degree")).first()[0] == 2
