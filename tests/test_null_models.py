"""The registered null models run all 200 permutations of the reference, against brute force on a small fixture."""

from __future__ import annotations

import hashlib
import itertools
import random
import statistics
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom import plans
from corpusloom.operators import graph as G
from corpusloom.operators import permutations as P
from corpusloom.plans import graph_queries as Q

N = 200


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    """25 nations of 24 orders with two or three of five brands; two brands go together more often than by chance."""
    home, rng = tmp_path_factory.mktemp("star"), random.Random(5)
    brands, sets = [f"Brand#{k}" for k in range(1, 6)], {}
    for order in range(600):
        items = set(rng.sample(brands, 2 + order % 2))
        sets[order] = items | set(brands[:2]) if rng.random() < 0.5 else items
    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    tables = {
        "region": (list(enumerate(names)), "r_regionkey int, r_name string"),
        "nation": ([(k, f"N{k:02}", k % 5) for k in range(25)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(k, k) for k in range(25)], "c_custkey long, c_nationkey int"),
        "orders": ([(k, k % 25, "1995-01-01") for k in sets], "o_orderkey long, o_custkey long, o_orderdate string"),
        "part": ([(k, b, b, b) for k, b in enumerate(brands)], "p_partkey long, p_name string, p_brand string, p_type string"),
        "lineitem": ([(k, brands.index(b)) for k, s in sets.items() for b in sorted(s)], "l_orderkey long, l_partkey long"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{home}/{name}.parquet")
    groups = defaultdict(dict)
    for order, items in sets.items():
        groups[f"N{order % 25:02}"][order] = items
    return str(home), groups


def token_of(seat: int, n: int, seed: int, perm: int, group: str) -> int:
    """The bijection in plain whole numbers."""
    keys = []
    for j in range(6):
        h = hashlib.md5(f"{seed}|{perm}|{group}|{j}".encode()).hexdigest()
        keys.append((int(h[:7], 16) + 1, int(h[7:14], 16)))
    bits = max(2, (n - 1).bit_length())
    left, right, x = 2 ** (bits // 2), 2 ** (bits - bits // 2), seat
    while True:
        u, v = divmod(x, right)
        for j, (a, b) in enumerate(keys):
            move = lambda y: (((y * a + b) % (2**31 - 1)) ** 2 + a) % (2**31 - 1)  # noqa: E731, B023
            if j % 2 == 0:
                u = (u + move(v)) % left
            else:
                v = (v + move(u)) % right
        x = u * right + v
        if x < n:
            return x


def shuffled(groups: dict, perm: int) -> dict:
    out = {}
    for g, records in groups.items():
        seats = sorted((r, i) for r, items in records.items() for i in items)
        new = defaultdict(set)
        for at, (r, _) in enumerate(seats):
            new[r].add(seats[token_of(at, len(seats), 42, perm, g)][1])
        out[g] = new
    return out


def conserved(groups: dict, min_pair: int, min_groups: int, min_records: int) -> set:
    held = Counter()
    for records in groups.values():
        one = Counter(i for items in records.values() for i in items)
        two = Counter(p for items in records.values() for p in combinations(sorted(items), 2))
        n = len(records)
        held.update(p for p, k in two.items() if k >= min_pair and n >= min_records and k * n > one[p[0]] * one[p[1]])
    return {p for p, k in held.items() if k >= min_groups}


def test_null_models_run_all_permutations(spark, star):
    home, groups = star
    seen = conserved(groups, 3, Q.CONSERVED, 20)
    null = [conserved(shuffled(groups, p), 3, Q.CONSERVED, 20) for p in range(1, N + 1)]
    k = [len(x) for x in null]
    sd = statistics.pstdev(k)
    row = plans.QUERIES["null_model_summary"](spark, home).first()
    assert seen and (row.observed, row.null_max) == (len(seen), max(k))
    assert row.null_mean == pytest.approx(statistics.mean(k), abs=0.006) and row.null_sd == pytest.approx(sd, abs=0.006)
    assert row.p == round((sum(x >= len(seen) for x in k) + 1) / (N + 1), 5)
    rates = {(r.a, r.b): r.null_rate for r in plans.QUERIES["edge_null_hit_rate"](spark, home).collect()}
    assert rates == {e: round(sum(e in x for x in null) / N, 4) for e in seen}


def test_holdout_runs_all_permutations(spark, star):
    home, groups = star
    held = {g: x for g, x in groups.items() if int(g[1:]) % 5 < 2}
    known = conserved({g: x for g, x in groups.items() if g not in held}, *Q._TRAIN, 10)
    test = conserved(held, *Q._TEST, 10)
    m = len(known & test)
    k = [len(known & conserved(shuffled(held, p), *Q._TEST, 10)) for p in range(1, N + 1)]
    row = plans.QUERIES["holdout_prediction"](spark, home).first()
    assert known and m and (row.training_edges, row.reproduced, row.beaten) == (len(known), m, sum(x < m for x in k))
    assert row.null_mean == pytest.approx(statistics.mean(k), abs=1e-4)
    lift, novelty, beaten = m / statistics.mean(k), 1 - m / len(test), sum(x < m for x in k)
    want = "leakage_flag" if novelty < 0.1 else "success" if beaten == N and lift >= 1.15 else "weak_support" if beaten >= 190 and lift >= 1.05 else "failure"
    assert row.verdict == want


@pytest.mark.parametrize("slice_size, seats", [(500_000, 4_000_000), (30, 4_000_000), (30, 10)])
def test_permuted_counts_are_those_of_the_permuted_sets(spark, monkeypatch, slice_size, seats):
    """Groups cut into slices or not, seats broadcast or not; two groups of very different size, records dealt an item twice."""
    monkeypatch.setattr(G, "SLICE", slice_size)
    monkeypatch.setattr(G, "SEATS", seats)
    rng = random.Random(6)
    rows = [("big" if r < 80 else "small", r, f"i{i}") for r in range(90) for i in rng.sample(range(8), rng.randint(1, 4))]
    sets = spark.createDataFrame(rows, "group string, record int, item string").repartition(4)
    want = Counter(map(tuple, G.pair_counts(G.permute(sets, 7), ("perm", "group")).collect()))
    assert Counter(map(tuple, G.permuted_counts(sets, 7).collect())) == want and want


def test_no_seat_goes_through_the_driver(spark, monkeypatch):
    """packs of few tokens; a group whose sets are counted as bits, a small one, and integers as groups and items. Nothing is gathered but a row."""
    monkeypatch.setattr(G, "PACK", 100)
    rng = random.Random(8)
    rows = [(g, r, i) for g, n in ((7, 900), (3, 30)) for r in range(n) for i in rng.sample(range(100, 112), rng.randint(1, 5))]
    sets = spark.createDataFrame(rows, "group int, record long, item int").repartition(3)
    want = Counter(map(tuple, G.pair_counts(G.permute(sets, 3), ("perm", "group")).collect()))
    seen = Counter((0, *r) for r in G.pair_counts(sets).collect())
    kind = type(sets)
    monkeypatch.setattr(kind, "toPandas", lambda self: pytest.fail("gathered"))
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: x if len(x := collect(self)) < 2 else pytest.fail("gathered"))
    got = G._counts([(sets.where("group < 0"), 0), (sets, 3)], 42).where("side = 1").drop("side")
    monkeypatch.undo()
    assert Counter(map(tuple, got.collect())) == want + seen


def test_holdout_writes_no_records(spark, star, monkeypatch):
    """what is written are packs of many records each and sums, not a row for a record or its items."""
    kind, wide = type(spark.range(1)), []
    checkpoint = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda self, *a: [wide.append(self.columns) if "record" in self.columns else None, checkpoint(self, *a)][1])
    plans.QUERIES["holdout_prediction"](spark, star[0])
    assert not wide


@pytest.mark.parametrize("items", [1, 12, 512])
def test_bit_sums_are_pair_sums(items):
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 6, 20_000).astype(np.uint32)
    codes = rng.integers(0, items, int(lengths.sum())).astype(np.uint16)
    key = P.round_keys(1, 1, "x")
    for k, to in ((None, codes), (key, codes[P.dealt(np.arange(len(codes)), len(codes), [key])[0]])):
        want = np.zeros((items, items), int)
        for _, a, b, n in G._pair_sums(np.zeros(len(codes), int), np.repeat(np.arange(len(lengths)), lengths), to):
            np.add.at(want, (a, b), n)
        assert (G._bit_sums(codes, lengths, items, k) == want).all()


@given(st.integers(1, 700), st.integers(1, 5), st.integers(0, 99))
@settings(max_examples=60, deadline=None)
def test_dealt_is_a_permutation_and_can_be_undone(n, perms, seed):
    keys = [P.round_keys(seed, p, "g") for p in range(perms)]
    out = P.dealt(np.arange(n), n, keys)
    assert (np.sort(out, axis=1) == np.arange(n)).all()
    for row, key in zip(out, keys):
        assert (P.dealt(row, n, [key], back=True)[0] == np.arange(n)).all()
    assert out[0, n // 2] == token_of(n // 2, n, seed, 0, "g")


def test_places_are_dealt_evenly():
    """Each of 60 places comes about as often to each seat, and neighbours part, over 6,000 permutations."""
    out = P.dealt(np.arange(60), 60, [P.round_keys(1, p, "x") for p in range(6000)])
    counts = np.stack([np.bincount(out[:, s], minlength=60) for s in range(60)])
    chi = ((counts - 100.0) ** 2 / 100).sum()
    assert abs(chi - 59 * 59) < 6 * (2 * 59 * 59) ** 0.5
    near = (np.abs(np.diff(out, axis=1)) == 1).mean()
    assert abs(near - 2 / 60) < 0.004


def test_large_places():
    n = 10**12 + 7
    at = np.array([0, 1, 5 * 10**11, n - 1])
    keys = [P.round_keys(42, p, "g") for p in (1, 2)]
    out = P.dealt(at, n, keys)
    assert out.tolist() == [[token_of(int(s), n, 42, p, "g") for s in at] for p in (1, 2)]


def sums(parts):
    out = Counter()
    for unit, a, b, k in parts:
        for x in zip(unit.tolist(), a.tolist(), b.tolist(), k.tolist()):
            out[x[:3]] += x[3]
    return out


def test_pair_sums_of_large_codes(monkeypatch):
    """Codes near 2^31 in many units: no key overflows; held pairs are summed in parts."""
    monkeypatch.setattr(G, "PAIRS", 50)
    rng = random.Random(2)
    rows = [(u, r, 2**31 - 1 - c) for u in range(0, 40) for r in range(6) for c in rng.choices(range(10**9), k=3) + rng.choices(range(4), k=3)]
    want = Counter()
    for u in range(40):
        for r in range(6):
            items = sorted({c for x, y, c in rows if (x, y) == (u, r)})
            want.update((u, a, b) for i, a in enumerate(items) for b in items[i:])
    rng.shuffle(rows)
    assert sums(G._pair_sums(*np.array(rows).T)) == want


def test_a_record_of_many_items_is_made_in_parts():
    """20,000 items are 2 * 10^8 pairs: not more than PAIRS and a gap of them are held."""
    parts, n = 0, 20_000
    for unit, a, b, k in itertools.islice(G._pair_sums(np.zeros(n, int), np.zeros(n, int), np.arange(n) * 107_000), 3):
        assert len(a) <= G.PAIRS + n and (k == 1).all() and (a <= b).all()
        parts += 1
    assert parts == 3
