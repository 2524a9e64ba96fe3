"""Connected components of an edge table, without ever gathering it in one place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_unique, materialise

#: Rows that a task holds before it emits what it has contracted: bounds its memory.
CONTRACT_ROWS = 2_000_000


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its tree) for the edges given, nodes that are their own root left out."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top and up != x:
            parent[x], x = top, up
        return top

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    nodes = np.fromiter(parent, np.int64, len(parent))
    return nodes, np.array([root(x) for x in nodes.tolist()], np.int64)


def contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges (a, b) of a task as stars (root, node) that connect the same nodes."""
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n >= CONTRACT_ROWS:
            whole = pd.concat(held)
            nodes, roots = _forest(whole["a"].to_numpy(np.int64), whole["b"].to_numpy(np.int64))
            yield pd.DataFrame({"a": roots, "b": nodes})
            held, n = [], 0
    if held:
        whole = pd.concat(held)
        nodes, roots = _forest(whole["a"].to_numpy(np.int64), whole["b"].to_numpy(np.int64))
        yield pd.DataFrame({"a": roots, "b": nodes})


def connected_components(edges: DataFrame, contracted: bool = False) -> DataFrame:
    """edges (a, b) of longs -> (node, root): root is the least node of node's component.

    Rounds of: contract within each task (union-find over its rows, which keeps
    connectivity and leaves stars), then deal the star edges by their far end, so
    that a node's roots meet and are linked to the least of them. Every round
    writes its edges to the shared scratch folder. It ends when each node has one
    root and no root has a root itself. Self loops and repeated edges are allowed;
    nodes without an edge do not appear. contracted: edges made in Python have gone through
    contract() there; a second Python step in their tasks would take each core a second worker.
    """
    edges = edges.select("a", "b").where("a <> b")
    stars = materialise(edges if contracted else edges.mapInPandas(contract, "a long, b long"), "cc")
    while True:
        # a node's least root takes its other roots; partial aggregation makes a much-named node cheap
        least = materialise(stars.groupBy("b").agg(F.min("a").alias("low"), F.max("a").alias("high")), "cc-least")
        loose = least.where("low <> high").limit(1).count()
        chained = loose or least.join(stars.select("b").distinct().withColumnRenamed("b", "mid"), F.col("low") == F.col("mid"), "left_semi").limit(1).count()
        if not chained:
            return least.select(F.col("b").alias("node"), F.col("low").alias("root")).unionByName(
                least.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct()
            )
        # large star: every root of b -> least root of b; small star: a chained low -> its own low
        tops = least.select(F.col("b").alias("key"), F.col("low").alias("top"))
        across = materialise(stars.join(tops, stars["b"] == tops["key"]).select("a", "b", "top"), "cc-across")
        linked = across.where("a <> top").select(F.col("top").alias("a"), F.col("a").alias("b")).unionByName(across.select(F.col("top").alias("a"), "b"))
        # a root of many nodes is looked up without gathering its rows
        up = join_unique(linked, tops.withColumnRenamed("top", "over"), "a", "key", "left")
        jumped = up.select(F.coalesce("over", "a").alias("a"), "b").unionByName(up.where("over is not null").select(F.col("over").alias("a"), F.col("a").alias("b")))
        stars = materialise(jumped.where("a <> b").distinct().mapInPandas(contract, "a long, b long"), "cc")
