"""An index after inserts, changes and deletions is that of a full run, from the rows of changed texts alone; sequences with gaps against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import combinations

import pytest

from corpusloom.operators import graph as G
from corpusloom.operators import incremental as N

SCHEMA = "doc long, g string, label string"
SHARES = {"pairs": lambda rows: N.pair_shares(rows, "doc", "label", "g"), "occurrences": lambda rows: N.occurrence_shares(rows, "doc", "label", "g")}


def texts(seed, docs):
    rng = random.Random(seed)
    return [(d, f"g{d % 3}", rng.choice([*"abcdefg", None])) for d in docs for _ in range(rng.randint(1, 5))]


@pytest.mark.parametrize("kind", sorted(SHARES))
def test_update_is_a_full_run(spark, tmp_path, kind):
    old = texts(1, range(100)) + [(None, "g1", "a")]
    same = [r for r in old if r[0] is not None and r[0] < 80]
    new = same + texts(2, range(85, 90)) + texts(3, range(100, 120))  # 80 to 84 and 90 to 99 go, 85 to 89 change, 100 to 119 come
    before, after = (spark.createDataFrame(r, SCHEMA).repartition(4) for r in (old, new))
    N.write_store(before, str(tmp_path / "s"), "doc", 64)
    seen = []

    def shares(rows):
        seen.append({r["doc"] for r in rows.select("doc").distinct().collect()})
        return SHARES[kind](rows)

    index, what = N.update_index(SHARES[kind](before), str(tmp_path / "s"), after, "doc", ["g", "label"], shares, 64, spark)
    got, want = (Counter(map(tuple, x.select("kind", "group", "a", "b", "k").collect())) for x in (index, SHARES[kind](after)))
    if kind == "pairs":  # the null text is in no set
        assert got == want
        assert Counter(map(tuple, N.pair_counts_of(index).collect())) == Counter(map(tuple, G.pair_counts(G.item_sets(after, "g", "doc", "label")).collect()))
    else:
        assert got == want
    status = Counter(r["status"] for r in what.collect())
    assert status["inserted"] == 20 and status["deleted"] in (15, 16) and status["changed"] <= 5
    assert seen[0] <= set(range(80, 100)) and seen[1] <= set(range(85, 90)) | set(range(100, 120))  # no text that stayed is counted


def test_folders_of_other_texts_are_not_read(spark, tmp_path):
    rows = spark.createDataFrame(texts(1, range(200)), SCHEMA)
    N.write_store(rows, str(tmp_path / "s"), "doc", 64)
    few = N.read_texts(spark, str(tmp_path / "s"), spark.createDataFrame([(3,), (4,)], "text long"), "doc", 64)
    assert {r["doc"] for r in few.collect()} == {3, 4}
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*__part#\d+ (IN|=|INSET)", plan), plan


def test_versions(spark):
    make = lambda r: {x["text"]: x["version"] for x in N.versions(spark.createDataFrame(r, SCHEMA), "doc", ["g", "label"]).collect()}
    a = make([(1, "g", "x"), (1, "g", "y"), (2, "g", None)])
    assert a == make([(2, "g", None), (1, "g", "y"), (1, "g", "x")])
    assert a[1] != make([(1, "g", "x"), (1, "g", "y"), (1, "g", "y")])[1] and a[1] != make([(1, "g", "x")])[1]


@pytest.mark.parametrize("least, longest", [(2, None), (4, None), (3, 2)])
def test_gapped_sequences(spark, least, longest):
    rng = random.Random(least)
    chains = {c: [(p, rng.choice("abc")) for p in range(rng.randint(1, 7))] for c in range(12)}
    chains[50] = [(1, "z"), (1, "a"), (2, "a"), (None, "b"), (3, None)]
    rows = [(c, p, i) for c, items in chains.items() for p, i in items]
    held = Counter()
    for items in chains.values():
        whole = sorted(x for x in items if None not in x)
        found = set()
        for n in range(1, (longest or 9) + 1):
            for some in combinations(whole, n):
                if all(x[0] < y[0] for x, y in zip(some, some[1:])):
                    found.add(tuple(i for _, i in some))
        held.update(found)
    often = {s: n for s, n in held.items() if n >= least}

    def part(s, t):
        it = iter(t)
        return len(s) < len(t) and all(x in it for x in s)

    want = sorted((s, len(s), n, not any(part(s, t) for t in often)) for s, n in often.items())
    got = G.gapped_sequences(spark.createDataFrame(rows, "c int, p int, i string").repartition(3), "c", "p", "i", least, longest)
    assert sorted((tuple(r["sequence"]), r["length"], r["n_chains"], r["maximal"]) for r in got.collect()) == want
    assert G.gapped_sequences(spark.createDataFrame([], "c int, p int, i string"), "c", "p", "i").count() == 0
