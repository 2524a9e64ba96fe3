"""Links and classes of fingerprints: dense clusters, hot anchors, many copies, any number of bands."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import common, components, simhash_dedup as S


@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=4, unique=True), st.sampled_from([2, 3, 4]))
@settings(max_examples=300, deadline=None)
def test_anchor_covering(fp, flips, bands):
    """A linked pair meets: each one's home is among the other's replicas in some band."""
    other = fp
    for b in flips:
        other ^= 1 << b
    i, key, home = S.anchors(np.array([fp, other], np.uint64).view(np.int64), bands, 4)
    for x, y in ((0, 1), (1, 0)):
        assert set(key[(i == x) & home]) & set(key[(i == y) & ~home])


def signed(values):
    return np.array(sorted(values), np.uint64).view(np.int64).tolist()


def classes(fps):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            root[f] = f = root[root[f]]
        return f

    u = np.array(fps, np.int64).view(np.uint64)
    for i, f in enumerate(u):
        for j in np.nonzero(np.bitwise_count(u[:i] ^ f) <= 4)[0]:
            a, b = find(fps[i]), find(fps[j])
            root[max(a, b)] = min(a, b)
    return {f: find(f) for f in fps}


def found(spark, fps, bands):
    links = common.materialise(S.links(spark.createDataFrame([(f,) for f in fps], "fp long").repartition(5), 4, bands), "test")
    roots = {r.node: r.root for r in components.connected_components(links).collect()}
    return {f: roots.get(f, f) for f in fps}, links


def mixed(rng):
    """Fingerprints alone, in chains and in balls."""
    out = {rng.getrandbits(64) for _ in range(150)}
    for _ in range(5):
        f = rng.getrandbits(64)
        for _ in range(40):  # a chain
            for b in rng.sample(range(64), 4):
                f ^= 1 << b
            out.add(f)
        out |= {f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(60)}  # a ball
    return signed(out)


@pytest.mark.parametrize("bands", [2, 3, 4, None])
def test_links_connect_what_is_linked(spark, bands):
    fps = mixed(random.Random(11))
    got, links = found(spark, fps, bands)
    assert got == classes(fps)
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 2 * 64 for a, b in links.collect())


def test_dense_cluster_has_few_links(spark):
    rng, centre = random.Random(12), random.Random(12).getrandbits(64)
    fps = {centre}
    while len(fps) < 20_000:
        f = centre
        for b in rng.sample(range(64), rng.choice([2, 3])):
            f ^= 1 << b
        fps.add(f)
    got, links = found(spark, signed(fps), None)
    assert len(set(got.values())) == 1
    made, _ = S.replicas(S.planned_bands(20_000), 4)
    assert links.count() <= 1.1 * 20_000 * (made + 4)  # at most one a row, where all pairs within 4 bits are some millions


@pytest.mark.parametrize("tile", [16, 100])
def test_hot_anchor_is_cut(spark, monkeypatch, tile):
    """A third of all fingerprints agree in the first bands' bits, so share these anchors, and most are far apart in the others."""
    monkeypatch.setattr(S, "TILE", tile)
    rng = random.Random(13)
    low = rng.getrandbits(32)
    hot = {low | rng.getrandbits(32) << 32 for _ in range(300)}
    hot |= {f ^ (1 << rng.randrange(32, 64)) for f in list(hot)[:60]}
    fps = signed(hot | {rng.getrandbits(64) for _ in range(600)})
    assert found(spark, fps, 3)[0] == classes(fps)


def test_forest_equals_all_pairs():
    rng = random.Random(14)
    homes = np.array(mixed(rng)[:120], np.int64)
    visitors = np.concatenate((homes[::2], np.array(mixed(rng)[:50], np.int64)))
    n = len(visitors)
    a, b = S.forest(homes, visitors, np.zeros(n, np.int64), np.full(n, len(homes)), 4)
    assert len(a) <= len(homes) + n
    want = {(int(min(h, v)), int(max(h, v))) for h in homes for v in visitors if h != v and bin((int(h) ^ int(v)) & (2**64 - 1)).count("1") <= 4}
    nodes = {int(x) for x in (*homes, *visitors)}

    def parts(edges):
        root = {x: x for x in nodes}
        for _ in nodes:
            for x, y in edges:
                root[x] = root[y] = min(root[x], root[y])
        return root

    assert parts([(int(x), int(y)) for x, y in zip(a, b)]) == parts(want)


def test_many_copies_and_one_root(spark, monkeypatch):
    """A third of all rows are copies; their class is found where they are."""
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    texts = ["the same words in every copy of this text " * 3] * 200 + [f"another text number {i} about hours and stones {i * 7}" for i in range(200)] + [None] * 50
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    got = {r.doc_id: r for r in S.simhash_classes(docs).collect()}
    fps = [int(np.array([S.fingerprint(t)], np.uint64).view(np.int64)[0]) for t in texts]
    roots = classes(sorted(set(fps)))
    least = {}
    for i, f in enumerate(fps):
        least.setdefault(roots[f], i)
    assert {i: (r.fp, r.component_id) for i, r in got.items()} == {i: (f, least[roots[f]]) for i, f in enumerate(fps)}
    assert S.keep_one(docs).count() == len(set(roots.values()))


def python_steps(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return sum(plan.count(x) for x in ("MapInPandas", "MapInArrow", "ArrowEvalPython"))


def test_one_python_step_in_a_task(spark, monkeypatch):
    """A task with two takes two workers, which stay with all that later stages load into them."""
    steps = {}

    def seen(df, label, *more):
        steps[label] = max(steps.get(label, 0), python_steps(df))
        return common.materialise(df, label, *more)

    for module in (S, components):
        monkeypatch.setattr(module, "materialise", seen)
    near = [(i, " ".join(f"w{j}" for j in range(200)) + f" x{i}", "en") for i in range(9)]
    docs = spark.createDataFrame([*near, (20, None, "en"), (21, "by itself", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.component_id for r in S.simhash_classes(docs).collect()}
    fps = {i: S.fingerprint(t) for i, t, _ in docs.collect()}
    for i in fps:  # the least id of those reached by links
        reached, todo = {i}, [i]
        while todo:
            x = todo.pop()
            new = {j for j in fps if (fps[x] ^ fps[j]).bit_count() <= 4} - reached
            reached |= new
            todo += new
        assert got[i] == min(reached)
    assert len(set(got.values())) < len(got)
    assert steps["cc"] == 1 and max(steps.values()) == 1
    nameless = spark.createDataFrame([(None, "no id here", "en"), (None, "no id here", "en")], docs.schema)
    kept = S.keep_one(docs.unionByName(nameless))
    assert python_steps(kept) == 1
    assert sorted(r.text for r in kept.where("doc_id is null").collect()) == ["no id here"]
    assert {r.doc_id for r in kept.where("doc_id is not null").collect()} == set(got.values())
