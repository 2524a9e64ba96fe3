"""Vectors: normalising, cosine pairs within blocks, nearest neighbours, centroids of given clusters and their alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import running


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalised(v: Column) -> Column:
    """A vector of length 1; a zero vector stays zero instead of becoming NaN."""
    return F.element_at(F.transform(F.array(F.sqrt(dot(v, v))), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(F.transform(v, lambda x: x.cast("double")))), 1)


#: Rows of a block that are multiplied with as many others in one place; pivots, and rows of the sample that they are chosen from; tiles of a block that one task pairs.
TILE, PIVOTS, SAMPLE, PAIRED = 4_096, 32, 4_096, 64
#: What rounding may take from an angle.
_SLACK = 1e-6


def _matrix(column: pd.Series) -> np.ndarray:
    """Rows as vectors of one length; of several lengths the shorter are filled with zeros, which no product sees."""
    width = max(map(len, column), default=0)
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _angles(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The angle of each unit vector to each pivot."""
    width = min(v.shape[1], pivots.shape[1])
    return np.arccos(np.clip(v[:, :width] @ pivots[:, :width].T, -1, 1))


def _pivots(unit: DataFrame) -> np.ndarray:
    """PIVOTS unit vectors far from each other, from a sample by a hash of the key. They decide what is skipped, never a result."""
    v = _matrix(unit.orderBy(F.xxhash64("k")).limit(SAMPLE).toPandas()["v"])
    v = v[(v * v).sum(1) > 0.5]
    if not len(v):
        return np.zeros((1, 1))
    chosen, best = [0], v @ v[0]
    while len(chosen) < min(PIVOTS, len(v)):
        chosen.append(int(np.argmin(best)))
        best = np.maximum(best, v @ v[chosen[-1]])
    return v[chosen]


def _tiles(unit: DataFrame, pivots: np.ndarray, rows: int) -> DataFrame:
    """unit (b, k, v, w) as tiles (b, tile, ks, vs, ws, lo, hi), written: rows of a block in the order of nearest pivot and angle to it.

    lo and hi are the least and greatest angle of a tile's vectors to each pivot. A tile with a zero vector, which is on no sphere, has the widest.
    """
    spark = unit.sparkSession
    shared = spark.sparkContext.broadcast(pivots)
    b, k = (unit.schema[c].dataType.simpleString() for c in "bk")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            angles = _angles(_matrix(pdf["v"]), shared.value)
            nearest = angles.argmin(1)
            yield pdf.assign(pivot=nearest.astype(np.int32), angle=angles[np.arange(len(pdf)), nearest])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, made, held, n = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pd.DataFrame:
            nonlocal made, held, n
            pdf = pd.concat(held)
            held, n, made = [], 0, made + 1
            v = _matrix(pdf["v"])
            angles = _angles(v, shared.value)
            flat = (v * v).sum(1) < 0.5
            low, high = (np.zeros(angles.shape[1]), np.full(angles.shape[1], np.pi)) if flat.any() else (angles.min(0), angles.max(0))
            row = {"b": pdf["b"].iat[0], "tile": part << 32 | made, "ks": pdf["k"].tolist(), "width": v.shape[1], "vs": v.tobytes(), "ws": pdf["w"].to_numpy(float), "lo": low, "hi": high}
            return pd.DataFrame([row])

        for pdf in batches:
            same = (pdf["b"].eq(pdf["b"].shift()) & pdf["pivot"].eq(pdf["pivot"].shift())).to_numpy()
            edges = [*np.nonzero(~same)[0].tolist(), len(pdf)] if len(pdf) else []
            for x, y in zip(edges, edges[1:]):
                own = pdf.iloc[x:y]
                # a tile holds rows of one block, and of one pivot unless there are few
                if held and (held[-1]["b"].iat[0] != own["b"].iat[0] or (held[-1]["pivot"].iat[0] != own["pivot"].iat[0] and n >= rows // 4)):
                    yield out()
                while len(own):
                    held.append(own.iloc[: rows - n])
                    own, n = own.iloc[rows - n :], n + len(held[-1])
                    if n == rows:
                        yield out()
        if held:
            yield out()

    placed = unit.mapInPandas(place, f"b {b}, k {k}, v array<double>, w double, pivot int, angle double")
    ranged = placed.repartitionByRange("b", "pivot", "angle", "k").sortWithinPartitions("b", "pivot", "angle", "k")
    return ranged.mapInPandas(cut, f"b {b}, tile long, ks array<{k}>, width int, vs binary, ws array<double>, lo array<double>, hi array<double>").checkpoint()


def _apart(lo: str, hi: str, lo2: str, hi2: str) -> Column:
    """An angle that no vector of one tile is nearer to one of the other than: the widest gap between their ranges over all pivots."""
    gaps = F.zip_with(F.arrays_zip(F.col(lo).alias("a"), F.col(hi).alias("b")), F.arrays_zip(F.col(lo2).alias("a"), F.col(hi2).alias("b")), lambda x, y: F.greatest(y["a"] - x["b"], x["a"] - y["b"], F.lit(0.0)))
    return F.array_max(gaps)


def _paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """Tiles of one block side by side: (b, i, lo, hi) with (j, lo2, hi2). Ranges only; tiles of a large block are dealt to many tasks."""
    n = right.groupBy(F.col("b").alias("__n")).agg(F.ceil(F.count(F.lit(1)) / PAIRED).cast("int").alias("salts"))
    x = left.select("b", F.col("tile").alias("i"), "lo", "hi").join(n, F.col("b").eqNullSafe(F.col("__n"))).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    y = right.join(n, F.col("b").eqNullSafe(F.col("__n"))).select(F.col("b").alias("__b"), F.col("tile").alias("j"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.pmod(F.xxhash64("tile"), F.col("salts")).cast("int").alias("__s"))
    return x.join(y, F.col("b").eqNullSafe(F.col("__b")) & (F.col("s") == F.col("__s"))).select("b", "i", "j", "lo", "hi", "lo2", "hi2")


def tile_pairs(tiles: DataFrame, threshold: float) -> DataFrame:
    """(i, j), i <= j: tiles of one block that may hold a pair at the threshold; the others are ruled out by the triangle inequality on the sphere."""
    ranges = tiles.select("b", "tile", "lo", "hi")
    reach = float(np.arccos(np.clip(threshold, -1, 1))) + _SLACK
    near = _paired(ranges, ranges).where(F.col("i") <= F.col("j"))
    return near.where(_apart("lo", "hi", "lo2", "hi2") <= reach).select("i", "j")


def _met(pairs: DataFrame, left: DataFrame, right: DataFrame, work, schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """work(tile, tile) for each pair (i, j): each pair is a group of one tile from either side."""
    data = ("ks", "width", "vs", "ws")
    x = pairs.join(left.select(F.col("tile").alias("__t"), *data), F.col("i") == F.col("__t")).drop("__t")
    y = pairs.select("i", "j").join(right.select("b", F.col("tile").alias("__t"), *data), F.col("j") == F.col("__t")).drop("__t")
    y = y.select(*[F.col(c).alias(f"r_{c}") for c in ("i", "j", "b", *data)])  # both sides can be of one table: names tell them apart

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return work(a.iloc[0], b.rename(columns=lambda c: c[2:]).iloc[0])

    return x.select("i", "j", *data, *keep).groupBy("i", "j").cogroup(y.groupBy("r_i", "r_j")).applyInPandas(run, schema)


def _vectors(row) -> np.ndarray:
    return np.frombuffer(row["vs"]).reshape(len(row["ks"]), row["width"])


def cosine_pairs(df: DataFrame, block: str, key: str, vector: str, threshold: float = 0.9, weight: str | None = None, most: int | None = 2000) -> DataFrame:
    """(block, a, b, cosine, keep): pairs of a block at the threshold or above, best first.

    keep is the key of greater weight, ties to the earlier. Vectors are normalised
    once. A block is cut into tiles of vectors near the same pivot; of these only pairs that
    tile_pairs() leaves are copied, each to be one product of matrices in some task, so that only pairs that
    pass are ever made and no block is a single task.
    """
    kind, of = (df.schema[c].dataType.simpleString() for c in (block, key))
    weighted = F.col(weight).cast("double").alias("w") if weight else F.lit(0.0).alias("w")
    unit = df.where(F.col(vector).isNotNull() & F.col(block).isNotNull()).select(F.col(block).alias("b"), F.col(key).alias("k"), l2_normalised(F.col(vector)).alias("v"), weighted).checkpoint()
    tiles = _tiles(unit, _pivots(unit), TILE)

    def near(x, y) -> pd.DataFrame:
        u, v = _vectors(x), _vectors(y)
        width = min(u.shape[1], v.shape[1])
        same, found = x["i"] == x["j"], []
        for at in range(0, len(u), 512):
            c = u[at : at + 512, :width] @ v[:, :width].T
            r, s = np.nonzero(c >= threshold)
            found.append((r + at, s, c[r, s]))
        r, s, c = (np.concatenate(z) for z in zip(*found))
        a, b = np.array(x["ks"])[r], np.array(y["ks"])[s]
        wa, wb = np.array(x["ws"])[r], np.array(y["ws"])[s]
        swap = a > b
        a, b, wa, wb = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, wb, wa), np.where(swap, wa, wb)
        fine = (a < b) & ~(same & swap)  # a tile with itself has each pair twice
        out = pd.DataFrame({"a": a[fine], "b": b[fine], "c": c[fine], "keep": np.where(wb > wa, b, a)[fine]})
        return out.assign(block=y["b"])[["block", "a", "b", "c", "keep"]]

    out = _met(tile_pairs(tiles, threshold).checkpoint(), tiles, tiles, near, f"block {kind}, a {of}, b {of}, c double, keep {of}")
    out = out.select(F.col("block").alias(block), "a", "b", F.round("c", 4).alias("cosine"), "keep")
    return out.orderBy(F.desc("cosine"), "a", "b").limit(most) if most else out


#: Tiles that a tile of queries visits first.
FIRST = 2


def nearest(queries: DataFrame, corpus: DataFrame, key: str, vector: str, block: str, k: int = 10) -> DataFrame:
    """(query, key, cosine, rank): the k nearest rows of a query's block, its own left out; ties of the rounded cosine to the smaller key.

    Queries and rows are cut into tiles. A tile of queries meets the FIRST tiles whose ranges are nearest, and
    then, of the others, those that can hold a cosine as high as the least k-th best so far.
    """
    of = corpus.schema[key].dataType.simpleString()
    unit, asked = (
        d.where(F.col(vector).isNotNull() & F.col(block).isNotNull()).select(F.col(block).alias("b"), F.col(key).alias("k"), l2_normalised(F.col(vector)).alias("v"), F.lit(0.0).alias("w")).checkpoint()
        for d in (corpus, queries)
    )
    pivots = _pivots(unit)
    tiles, asked = _tiles(unit, pivots, TILE), _tiles(asked, pivots, TILE // 4)
    gaps = _paired(asked.select("b", "tile", "lo", "hi"), tiles.select("b", "tile", "lo", "hi")).select("i", "j", _apart("lo", "hi", "lo2", "hi2").alias("gap")).checkpoint()

    def best(x, y) -> pd.DataFrame:
        order = np.argsort(np.array(y["ks"]), kind="stable")
        u, v, keys, own = _vectors(x), _vectors(y)[order], np.array(y["ks"])[order], np.array(x["ks"])
        width, out = min(u.shape[1], v.shape[1]), []
        for at in range(0, len(u), 512):
            c = u[at : at + 512, :width] @ v[:, :width].T
            c[own[at : at + 512, None] == keys[None, :]] = -np.inf
            rounded = np.sign(c) * np.floor(np.abs(c) * 1e4 + 0.5)
            top = np.argsort(-rounded, axis=1, kind="stable")[:, :k]  # keys are in order already
            r, at_key = np.nonzero(np.isfinite(np.take_along_axis(c, top, 1)))
            column = top[r, at_key]
            out.append(pd.DataFrame({"i": x["i"], "query": own[at + r], "k": keys[column], "c": c[r, column]}))
        return pd.concat(out)

    schema = f"i long, query {of}, k {of}, c double"
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), key)
    rounded = lambda d: d.select("i", "query", F.col("k").alias(key), F.round("c", 4).alias("cosine"))
    top = lambda d: d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    turn = F.row_number().over(Window.partitionBy("i").orderBy("gap", "j"))
    gaps = gaps.withColumn("turn", turn).checkpoint()
    found = top(rounded(_met(gaps.where(F.col("turn") <= FIRST).select("i", "j"), asked, tiles, best, schema))).checkpoint()
    sizes = asked.select(F.col("tile").alias("__q"), F.size("ks").alias("n"))
    full = found.where(F.col("rank") == k).groupBy(F.col("i").alias("__i")).agg(F.count(F.lit(1)).alias("full"), F.min("cosine").alias("kth"))
    # without k rows for each of its queries a tile meets all others; a rounded cosine is at most half a unit of the last place too high
    need = sizes.join(full, F.col("__q") == F.col("__i"), "left").select("__q", F.when(F.col("full") == F.col("n"), F.acos(F.greatest(F.col("kth") - 0.0001, F.lit(-1.0)))).otherwise(4.0).alias("reach"))
    rest = gaps.where(F.col("turn") > FIRST).join(need, F.col("i") == F.col("__q")).where(F.col("gap") <= F.col("reach") + _SLACK).select("i", "j")
    more = rounded(_met(rest, asked, tiles, best, schema))
    return top(found.drop("rank").unionByName(more)).drop("i")


def embedding_status(rows: DataFrame, known: DataFrame, key: str, vector: str, code: str, size: int) -> DataFrame:
    """rows with `status`: the first of request_error, unknown_id, no_vector, wrong_size, not_finite that holds, else ok."""
    k = known.select(F.col(key).alias("__k")).distinct()
    both = rows.join(k, rows[key] == F.col("__k"), "left")
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    status = (
        F.when(F.coalesce(F.col(code) != 200, F.lit(True)), "request_error").when(F.col("__k").isNull(), "unknown_id").when(v.isNull(), "no_vector")
        .when(F.size(v) != size, "wrong_size").when(~finite, "not_finite").otherwise("ok")
    )
    return both.withColumn("status", status).drop("__k")


def centroids(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """(cluster, v): the mean of each cluster's unit vectors, normalised."""
    each = df.select(cluster, F.posexplode(l2_normalised(F.col(vector))).alias("i", "x")).groupBy(cluster, "i").agg(F.avg("x").alias("x"))
    rows = F.array_sort(F.collect_list(F.struct("i", "x")))
    return each.groupBy(cluster).agg(F.transform(rows, lambda r: r["x"]).alias("v")).select(cluster, l2_normalised(F.col("v")).alias("v"))


def aligned(first: DataFrame, second: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, partner, cosine): the nearest centroid of the second pile for each of the first. Centroids are k rows, so the pairs are k * k."""
    b = second.select(F.col(cluster).alias("partner"), F.col("v").alias("__w"))
    pairs = first.join(F.broadcast(b)).select(F.col(cluster), "partner", dot(F.col("v"), F.col("__w")).alias("c"))
    best = pairs.groupBy(cluster).agg(F.max(F.struct("c", (-F.col("partner")).alias("p"))).alias("m"))
    return best.select(cluster, (-F.col("m.p")).alias("partner"), F.round("m.c", 4).alias("cosine"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: rank correlation, ties at their mean rank; null if either column has one value only. Rows with a null don't count.

    Values are counted first, and ranks are running counts by range partitions.
    """
    both = df.select(F.col(x).alias("x"), F.col(y).alias("y")).na.drop().groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))

    def ranks(c: str) -> DataFrame:
        per = both.groupBy(c).agg(F.sum("n").alias("k"))
        return running(per, [c], {"upto": "k"}).select(F.col(c).alias(f"__{c}"), (F.col("upto") - (F.col("k") - 1) / 2).alias(f"r{c}"))

    every = both.join(ranks("x"), F.col("x") == F.col("__x")).join(ranks("y"), F.col("y") == F.col("__y"))
    sums = every.agg(*[F.sum(F.col("n") * e).alias(k) for k, e in {"s": F.lit(1.0), "sx": F.col("rx"), "sy": F.col("ry")}.items()])
    centred = every.join(F.broadcast(sums)).select("n", (F.col("rx") - F.col("sx") / F.col("s")).alias("dx"), (F.col("ry") - F.col("sy") / F.col("s")).alias("dy"))  # one row
    parts = centred.agg(*[F.sum(F.col("n") * F.col(a) * F.col(b)).alias(k) for k, a, b in (("xy", "dx", "dy"), ("xx", "dx", "dx"), ("yy", "dy", "dy"))])
    return parts.select(F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.round(F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")), 4)).alias("spearman"))


def ks_distance(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """One row: the greatest distance of two empirical distributions."""
    both = a.select(F.col(value).alias("x"), F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionByName(b.select(F.col(value).alias("x"), F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))
    per = both.groupBy("x").agg(F.sum("in_a").alias("a"), F.sum("in_b").alias("b")).checkpoint()
    every = per.agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))
    upto = running(per, ["x"], {"upto_a": "a", "upto_b": "b"}).join(F.broadcast(every))  # one row
    return upto.agg(F.round(F.max(F.abs(F.col("upto_a") / F.col("all_a") - F.col("upto_b") / F.col("all_b"))), 4).alias("ks"))
