"""JSON walked as variants against plain Python, and without a Python worker."""

from __future__ import annotations

import json
import random

import pytest

from corpusloom.operators import sets, variants
from corpusloom.sources import readers

ODD = ["é", "a b", "x.y", "", "quote", "motif_id", "motif_ids", "accepted", "notes", "k"]


def value(rng, depth):
    kind = rng.randrange(7 if depth else 4)
    if kind < 4:
        return rng.choice([None, True, 7, -3, "text", " ", "", "ü\n", 2.5])
    if kind == 4:
        return [value(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(ODD): value(rng, depth - 1) for _ in range(rng.randint(0, 4))}


def leaves(node, path=""):
    if isinstance(node, (dict, list)):
        for k, v in node.items() if isinstance(node, dict) else enumerate(node, 1):
            yield from leaves(v, f"{path}.{k}" if path else str(k))
    elif node is not None and path:
        yield path, node if isinstance(node, str) else json.dumps(node)


def quoted(node):
    for k, v in node.items() if isinstance(node, dict) else enumerate(node) if isinstance(node, list) else ():
        if k == "quote":
            if isinstance(v, str) and v.strip():
                yield v
        else:
            yield from quoted(v)


def ids(node):
    plain = lambda x: x if isinstance(x, str) else json.dumps(x)
    if isinstance(node, list):
        for x in node:
            yield from ids(x)
    elif isinstance(node, dict):
        many = node.get("motif_ids")
        for x in [node.get("motif_id"), *(many if isinstance(many, list) else [many])]:
            if x is not None and x != "" and not isinstance(x, (dict, list)):
                yield plain(x)
        for c in readers.CONTAINERS:
            yield from ids(node.get(c))


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(3)
    out = [(i, value(rng, 5)) for i in range(150)]
    deep = {"quote": "deep"}
    for _ in range(9):
        deep = {"accepted": [deep, {"motif_ids": ["n", 4, None, ""]}]}
    return [*out, (500, deep), (501, {"motif_id": {"a": 1}, "accepted": {"motif_id": "z"}})]


def test_walks(spark, documents):
    rows = [(i, json.dumps(d)) for i, d in documents] + [(900, "{broken"), (901, None), (902, ""), (903, "3")]
    df = spark.createDataFrame(rows, "k long, doc string").repartition(3)
    dotted = lambda i, d: sorted((i, *x) for x in leaves(d))
    assert sorted(map(tuple, sets.flat_fields(df, "k", "doc").collect())) == sorted(x for i, d in documents for x in dotted(i, d))
    assert sorted(map(tuple, readers.quotes(df, "k", "doc").collect())) == sorted((i, q) for i, d in documents for q in quoted(d))
    assert sorted(map(tuple, readers.nested_ids(df, "k", "doc").collect())) == sorted({(i, x) for i, d in documents for x in ids(d)})
    for out in (sets.flat_fields(df, "k", "doc"), readers.quotes(df, "k", "doc"), readers.nested_ids(df, "k", "doc")):
        plan = out._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_nothing(spark):
    none = spark.createDataFrame([], "k long, doc string")
    assert variants.nodes(none, "k", "doc").count() == 0 and sets.flat_fields(none, "k", "doc").count() == 0
