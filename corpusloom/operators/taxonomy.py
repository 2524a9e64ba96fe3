"""Blind taxonomies of two piles: clusters of label vectors, the web of clusters that go together, its alignment against a null, its topology.

Clusters are of integer vectors, with seeds by farthest point and ties by fixed
rules, so that any partitioning, and another engine, finds the same. Driver and
broadcasts hold k centres and a bounded sample for the seeds; vectors, records and
permutations are rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import conserved_edges, item_sets, ordered_propagation, pair_counts, pmi_edges
from .ranges import running

#: Rows that the seeds are chosen from, the first by the md5 of their key; numbers in all centres together.
SEED_ROWS, CENTRE_NUMBERS = 4_096, 4_000_000


def integer_vectors(df: DataFrame, key: str, vector: str, scale: int = 256) -> DataFrame:
    """(key, q): floor(scale * x) of each component, rows with a null or a non-finite one left out."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    kept = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & sound)
    return kept.select(F.col(key).alias("key"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("q"))


def farthest_seeds(rows: DataFrame, k: int, sample: int = SEED_ROWS) -> np.ndarray:
    """k seeds among the first `sample` rows by md5 of the key: the first of them, then always the one farthest from all seeds so far.

    Ties go to the earlier row. Fewer than k if the sample has fewer different vectors.
    """
    few = rows.withColumn("__h", F.md5(F.col("key").cast("string"))).orderBy("__h", "key").limit(sample).toPandas()
    if not len(few):
        return np.zeros((0, 0), np.int64)
    v = np.stack(few["q"].to_list()).astype(np.int64)
    chosen, gap = [0], ((v - v[0]) ** 2).sum(1)
    while len(chosen) < k and gap.max() > 0:
        chosen.append(int(np.argmax(gap)))
        gap = np.minimum(gap, ((v - v[chosen[-1]]) ** 2).sum(1))
    return v[chosen]


def _nearest(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each vector, ties to the first; exact, since all numbers are integers."""
    return np.argmin((centres * centres).sum(1)[None, :] - 2 * v @ centres.T, axis=1)


def blind_clusters(rows: DataFrame, k: int, rounds: int = 10, sample: int = SEED_ROWS) -> tuple[DataFrame, np.ndarray]:
    """((key, cluster), centres) of rows (key, q) by k-means on integers, at most `rounds` rounds.

    Each round is one pass: a task sums its vectors by cluster, and only these sums are moved. A
    centre is the mean rounded half up; one that no vector is nearest to stays where it was.
    """
    centres = farthest_seeds(rows, k, sample)
    if centres.size > CENTRE_NUMBERS:
        raise ValueError(f"{centres.shape[0]} centres of {centres.shape[1]} components are too many to give to each task")
    spark = rows.sparkSession

    def sums(shared):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at = shared.value
            total, count = np.zeros_like(at), np.zeros(len(at), np.int64)
            for pdf in batches:
                v = np.stack(pdf["q"].to_list()).astype(np.int64)
                own = _nearest(v, at)
                np.add.at(total, own, v)
                count += np.bincount(own, minlength=len(at))
            for c in np.nonzero(count)[0]:
                yield pd.DataFrame({"cluster": c, "i": np.arange(at.shape[1]), "s": total[c], "n": count[c]})

        return run

    for _ in range(rounds if len(centres) else 0):
        parts = rows.select("q").mapInPandas(sums(spark.sparkContext.broadcast(centres)), "cluster int, i int, s long, n long")
        new = centres.copy()
        for c, i, s, n in parts.groupBy("cluster", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():  # k centres
            new[c, i] = (2 * s + n) // (2 * n)
        if (new == centres).all():
            break
        centres = new
    shared = spark.sparkContext.broadcast(centres)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "cluster": _nearest(np.stack(pdf["q"].to_list()).astype(np.int64), shared.value)})

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInPandas(place, f"key {kind}, cluster int"), centres


def nearest_partners(spark, first: np.ndarray, second: np.ndarray) -> DataFrame:
    """(cluster, partner, cosine): the centre of the second pile with the highest cosine to each of the first, ties to the smaller number. k rows."""
    lengths = np.sqrt((second * second).sum(1).astype(float))
    score = np.divide((first @ second.T).astype(float), lengths[None, :], out=np.full((len(first), len(second)), -np.inf), where=lengths[None, :] > 0)
    best = np.argmax(score, axis=1) if score.size else np.zeros(0, int)
    own = np.sqrt((first * first).sum(1).astype(float))
    rows = [(int(c), int(p), float(score[c, p] / own[c]) if own[c] > 0 else None) for c, p in enumerate(best)]
    return spark.createDataFrame(rows, "cluster int, partner int, cosine double").select("cluster", "partner", F.round("cosine", 4).alias("cosine"))


def cluster_web(mentions: DataFrame, clusters: DataFrame, min_pair: int = 3, min_records: int = 20, min_groups: int = 4) -> DataFrame:
    """(a, b, n_groups, cooccurrence): clusters whose labels go together, above chance, in min_groups groups or more; mentions are (group, record, key)."""
    named = mentions.join(clusters.withColumnRenamed("key", "__key"), F.col("key") == F.col("__key"))
    return conserved_edges(pmi_edges(pair_counts(item_sets(named, "group", "record", "cluster")), min_pair, min_records), min_groups).drop("groups")


def partner_null(first: DataFrame, second: DataFrame, partners: DataFrame, n: int = 500, seed: int = 42, weight: str = "n_groups") -> DataFrame:
    """(statistic, observed, null_mean, null_sd, null_max, null_q975, beaten, p): two webs compared over aligned clusters, against n permuted alignments.

    For each pair of clusters of the first web, its weight there (0 without an edge) and that of the aligned pair in
    the second. spearman is the rank correlation of these, ties at their mean rank;
    reproduction the share of the first web's edges whose aligned pair is an edge too. A permutation deals the
    partners to the clusters in the order of md5(seed|perm|cluster): all are one column `perm`, 0 the true alignment,
    and ranks come from counts of values, so no task sees a permutation's pairs together.
    """
    perms = partners.select("cluster", "partner", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("perm"))
    key = F.when(F.col("perm") > 0, F.md5(F.concat_ws("|", F.lit(str(seed)), "perm", "cluster"))).otherwise(F.lit(""))
    place = lambda *order: F.row_number().over(Window.partitionBy("perm").orderBy(*order))  # noqa: E731  (a row for each cluster)
    seats = perms.select("perm", "cluster", place("cluster").alias("seat"))
    dealt = perms.select(F.col("perm").alias("__p"), F.col("partner"), place(key, "cluster").alias("__s"))
    dealt = seats.join(dealt, (F.col("perm") == F.col("__p")) & (F.col("seat") == F.col("__s"))).select("perm", "cluster", "partner").checkpoint()

    own = partners.select(F.col("cluster").alias("a"))
    pairs = own.join(own.withColumnRenamed("a", "b"), F.col("a") < F.col("b"))  # k * (k - 1) / 2
    x = first.select(F.col("a").alias("__a"), F.col("b").alias("__b"), F.col(weight).alias("x"))
    pairs = pairs.join(x, (F.col("a") == F.col("__a")) & (F.col("b") == F.col("__b")), "left").select("a", "b", F.coalesce("x", F.lit(0)).alias("x"))
    left = dealt.select(F.col("perm"), F.col("cluster").alias("__c"), F.col("partner").alias("pa"))
    right = dealt.select(F.col("perm").alias("__q"), F.col("cluster").alias("__d"), F.col("partner").alias("pb"))
    met = pairs.join(left, F.col("a") == F.col("__c")).join(right, (F.col("perm") == F.col("__q")) & (F.col("b") == F.col("__d")))
    y = second.select(F.col("a").alias("__ya"), F.col("b").alias("__yb"), F.col(weight).alias("y"))
    met = met.join(y, (F.least("pa", "pb") == F.col("__ya")) & (F.greatest("pa", "pb") == F.col("__yb")), "left")
    counts = met.groupBy("perm", "x", F.coalesce("y", F.lit(0)).alias("y")).agg(F.count(F.lit(1)).alias("n")).checkpoint()

    def ranked(c: str) -> DataFrame:
        """Twice the mean rank of each value, less the mean of all: whole numbers."""
        per = counts.groupBy("perm", c).agg(F.sum("n").alias("k"))
        upto = F.sum("k").over(Window.partitionBy("perm").orderBy(c).rowsBetween(Window.unboundedPreceding, 0))
        every = F.sum("k").over(Window.partitionBy("perm"))
        return per.select(F.col("perm").alias(f"__p{c}"), F.col(c).alias(f"__{c}"), (2 * upto - F.col("k") - every).alias(f"d{c}"))

    wide = counts
    for c in "xy":
        wide = wide.join(ranked(c), (F.col("perm") == F.col(f"__p{c}")) & (F.col(c) == F.col(f"__{c}")))
    total = lambda e: F.sum(F.col("n") * e)
    sums = wide.groupBy("perm").agg(
        total(F.col("dx") * F.col("dy")).alias("xy"), total(F.col("dx") * F.col("dx")).alias("xx"), total(F.col("dy") * F.col("dy")).alias("yy"),
        F.sum(F.when((F.col("x") > 0) & (F.col("y") > 0), F.col("n")).otherwise(0)).alias("both"), F.sum(F.when(F.col("x") > 0, F.col("n")).otherwise(0)).alias("bonds"),
    )
    # millionths, so that means don't depend on the order of rows
    rank = F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx").cast("double") * F.col("yy").cast("double")))
    share = F.when(F.col("bonds") > 0, F.col("both") / F.col("bonds"))
    whole = lambda e: F.round(e * 1_000_000).cast("long")
    each = sums.select("perm", F.explode(F.array(*[F.struct(F.lit(k).alias("statistic"), whole(e).alias("v")) for k, e in (("spearman", rank), ("reproduction", share))])).alias("s")).select("perm", "s.*")
    seen = F.max(F.when(F.col("perm") == 0, F.col("v"))).over(Window.partitionBy("statistic"))  # n + 1 rows
    null = F.when(F.col("perm") > 0, F.col("v"))
    out = each.withColumn("seen", seen).groupBy("statistic").agg(
        F.max("seen").alias("seen"), F.avg(null).alias("mean"), F.stddev_pop(null).alias("sd"), F.max(null).alias("most"), F.array_sort(F.collect_list(null)).alias("values"),
        F.count_if(null < F.col("seen")).alias("beaten"), F.count_if(null >= F.col("seen")).alias("hits"),
    )
    million = lambda c: F.round(c / 1_000_000, 4)
    at = F.ceil(F.size("values") * F.lit(0.975)).cast("int") - 1
    return out.select(
        "statistic", million(F.col("seen")).alias("observed"), million(F.col("mean")).alias("null_mean"), million(F.col("sd")).alias("null_sd"), million(F.col("most")).alias("null_max"),
        million(F.get("values", at)).alias("null_q975"), "beaten", F.round((F.col("hits") + 1) / F.lit(n + 1), 5).alias("p"),
    )


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree)."""
    return edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, by alternating stars.

    Every round links what a node is linked to with the least of it, first the
    greater ones and then the smaller ones, so the depth of a component halves about each round. A hub's edges are joined with one
    row, its least neighbour, and never with each other. Loops are allowed; nodes without an edge do not appear.
    """
    links = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    sign = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("__u")).agg(F.least(F.min("v"), F.col("__u")).alias("m"))
        large = both.join(least, F.col("u") == F.col("__u")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().checkpoint()
        low = large.groupBy(F.col("u").alias("__u")).agg(F.min("v").alias("m"))
        met = large.join(low, F.col("u") == F.col("__u"))
        links = met.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("__u").alias("u"), F.col("m").alias("v"))).distinct().checkpoint()
        now = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == sign:
            roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        sign = now


def triangles(edges: DataFrame, degree: DataFrame | None = None) -> DataFrame:
    """One row (triangles): each edge points from the end of smaller degree, so a node has at most sqrt(2 m) ends to pair, a hub of a million edges few."""
    d = degrees(edges) if degree is None else degree
    da, db = (d.select(F.col("node").alias(f"__{c}"), F.col("degree").alias(f"__d{c}")) for c in "ab")
    both = edges.select("a", "b").join(da, F.col("a") == F.col("__a")).join(db, F.col("b") == F.col("__b"))
    x, y = F.struct(F.col("__da").alias("d"), F.col("a").alias("n")), F.struct(F.col("__db").alias("d"), F.col("b").alias("n"))
    out = both.select(F.least(x, y).alias("u"), F.greatest(x, y).alias("v")).checkpoint()
    wedge = out.join(out.select(F.col("u").alias("__u"), F.col("v").alias("w")), (F.col("u") == F.col("__u")) & (F.col("v") < F.col("w"))).select("v", "w")
    closing = out.select(F.col("u").alias("__x"), F.col("v").alias("__y"))
    return wedge.join(closing, (F.col("v") == F.col("__x")) & (F.col("w") == F.col("__y"))).agg(F.count(F.lit(1)).alias("triangles"))


def topology(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One row: nodes, edges, density, components, share of the giant one, triangles, clustering (closed wedges), communities, their modularity.

    labels (node, label) are the communities, by default those of ordered_propagation(). All
    ratios are of whole numbers. edges are (a, b, n_groups), each pair once.
    """
    edges = edges.checkpoint()
    degree = degrees(edges).checkpoint()
    labels = (ordered_propagation(edges) if labels is None else labels).checkpoint()
    size = components(edges).groupBy("root").agg(F.count(F.lit(1)).alias("k"))
    la, lb = (labels.select(F.col("node").alias(f"__{c}"), F.col("label").alias(f"__l{c}")) for c in "ab")
    inner = edges.join(la, F.col("a") == F.col("__a")).join(lb, F.col("b") == F.col("__b")).agg(F.count_if(F.col("__la") == F.col("__lb")).alias("inner"))
    held = degree.join(labels.select(F.col("node").alias("__n"), "label"), F.col("node") == F.col("__n")).groupBy("label").agg(F.sum("degree").alias("d"))
    one = degree.agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("degree"), F.lit(0)).alias("ends"), F.coalesce(F.sum(F.col("degree") * (F.col("degree") - 1)), F.lit(0)).alias("wedges2"))
    for part in (
        size.agg(F.count(F.lit(1)).alias("components"), F.max("k").alias("giant")), triangles(edges, degree), inner,
        held.agg(F.count(F.lit(1)).alias("communities"), F.coalesce(F.sum(F.col("d") * F.col("d")), F.lit(0)).alias("squares")),
    ):
        one = one.join(part)  # one row each
    m = F.col("ends") / 2
    return one.select(
        "nodes", m.cast("long").alias("edges"), F.round(F.when(F.col("nodes") > 1, F.col("ends") / (F.col("nodes") * (F.col("nodes") - 1))), 4).alias("density"), "components",
        F.round(F.when(F.col("nodes") > 0, F.col("giant") / F.col("nodes")), 4).alias("giant_share"), "triangles",
        F.round(F.when(F.col("wedges2") > 0, 6 * F.col("triangles") / F.col("wedges2")), 4).alias("clustering"), "communities",
        F.round(F.when(F.col("ends") > 0, (2 * F.col("ends") * F.col("inner") - F.col("squares")) / (F.col("ends") * F.col("ends"))), 4).alias("modularity"),
    )


def ks_test(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """One row (n_a, n_b, ks, ks_p): the greatest distance of two empirical distributions and its asymptotic p; null for an empty side."""
    both = a.select(F.col(value).alias("x"), F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionByName(b.select(F.col(value).alias("x"), F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))
    per = both.where("x IS NOT NULL").groupBy("x").agg(F.sum("in_a").alias("a"), F.sum("in_b").alias("b")).checkpoint()
    every = per.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("n_a"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_b"))
    upto = running(per, ["x"], {"upto_a": "a", "upto_b": "b"})
    wide = every.join(upto, how="left")  # the left side is one row
    some = lambda c: F.nullif(F.col(c), F.lit(0))
    gap = F.max(F.abs(F.col("upto_a") / some("n_a") - F.col("upto_b") / some("n_b")))
    one = wide.groupBy("n_a", "n_b").agg(gap.alias("d"))
    return one.select("n_a", "n_b", F.round("d", 4).alias("ks"), F.round(ks_p(F.col("d"), some("n_a"), some("n_b")), 4).alias("ks_p"))


def ks_p(d: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """The asymptotic chance of a Kolmogorov-Smirnov distance of d or more between samples of n and m; 1 for a distance that is next to none."""
    root = F.sqrt(n * m / (n + m))
    scaled = (root + 0.12 + 0.11 / root) * d

    def series(at: Column) -> Column:
        term = lambda s, j: s + F.pow(F.lit(-1.0), j - 1) * F.exp(-2.0 * j * j * at * at)
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), term)))

    return F.when(scaled < 0.2, 1.0).when(scaled >= 0.2, F.element_at(F.transform(F.array(scaled), series), 1))
