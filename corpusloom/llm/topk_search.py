"""Exact top-k inner products by block-at-a-time pruning.

Vectors are put in an order in which neighbours are alike (a coarse partition
fitted on a bounded sample, then the signs of what it leaves over), and this
order is cut into document ranges: groups, and in these blocks. A block keeps the
maximum and minimum of each term (component), the centre and radius of its vectors, and a forward
index: the quantised vectors. For a query the summed term maxima (and, if lower, the
product with the centre plus length times radius) bound every score in a block; blocks
are visited by falling bound and scored through their forward index until the
bounds fall below the query's k-th score.

The same bounds hold for groups, whose summaries are few. A query goes to its best
group first; its k-th score there rules out groups before any vector is moved to
it, and so in rounds of the next best ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hashed_sample, materialise, table

#: Vectors in a block; vectors in a group, which is what a task holds; queries that a task scores against a group.
BLOCK, GROUP, QUERIES = 128, 16_384, 4_096
#: Summaries that all tasks get, at most, and the bytes that they may take. With more groups, neighbours in the order share one.
GROUPS, SUMMARY_BYTES = 4_096, 32 * 1024 * 1024
#: Rows and bytes of the sample that the coarse partition is fitted on, its parts, and signs that order each part.
SAMPLE, SAMPLE_BYTES, PARTS, SIGNS = 16_384, 16 * 1024 * 1024, 256, 16


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, keep: dict[str, Column] | None = None) -> DataFrame:
    """(id, q, and the columns `keep`) with q = floor(scale * x) of each component as long.

    Vectors that are null, or hold a null or a non-finite component, go, as do
    null ids; an empty vector stays. A component beyond a long is an error.
    """

    def whole(v: Column) -> Column:
        x = v.cast("double") * scale
        return F.when(F.abs(x) < 2.0**63, F.floor(x).cast("long")).otherwise(F.raise_error(F.lit("a component is beyond a long")).cast("long"))

    sound = F.forall(vector_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    kept = vectors.where(F.col(vector_col).isNotNull() & sound & F.col(id_col).isNotNull())
    return kept.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, whole).alias("q"), *[c.alias(k) for k, c in (keep or {}).items()])


def _largest(m: np.ndarray) -> int:
    return max(int(m.max(initial=0)), -int(m.min(initial=0)), 1)


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products of rows, exact; one beyond a long is an error."""
    most = _largest(q) * _largest(v) * max(q.shape[1], 1)
    if most < 2**53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    if most < 2**63:
        return q @ v.T
    exact = q.astype(object) @ v.astype(object).T
    if exact.size and (exact.max() >= 2**63 or exact.min() < -(2**63)):
        raise OverflowError("an inner product is beyond a long")
    return exact.astype(np.int64)


def _bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each query (row) and range (column) a number that no score in the range is above.

    The lower of the summed term maxima, and the product with the centre plus the
    Cauchy-Schwarz bound of what is left of each vector.
    """
    x = q.astype(np.float64)
    maxima = np.maximum(x, 0) @ high.T + np.minimum(x, 0) @ low.T
    length = np.sqrt((x * x).sum(1))
    tail = x @ centre.T + length[:, None] * radius
    # rounding of floats never makes a bound too low
    slack = 1 + 1e-9 * (np.abs(maxima) + length[:, None] * (np.sqrt((centre * centre).sum(1)) + radius + np.sqrt((high * high + low * low).sum(1))))
    return np.minimum(maxima, tail) + slack


def _summary(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Term maxima and minima, centre and radius of some vectors."""
    x = v.astype(np.float64)
    centre = x.mean(0)
    return x.max(0, initial=-np.inf), x.min(0, initial=np.inf), centre, float(np.sqrt(((x - centre) ** 2).sum(1).max(initial=0.0)))


def split(v: np.ndarray, size: int) -> list[np.ndarray]:
    """Places of the vectors in runs of `size` at most: halved at the middle of the widest term until they fit."""
    done, todo = [], [np.arange(len(v))]
    while todo:
        own = todo.pop()
        if len(own) <= size:
            done.append(own)
            continue
        part = v[own]
        if part.shape[1]:
            spread = part.astype(np.float64).var(0)
            own = own[np.argsort(part[:, int(np.argmax(spread))], kind="stable")]
        half = size * max(1, round(len(own) / size / 2))
        todo += [own[half:], own[:half]]
    return done


class Partition:
    """A coarse partition of vectors of one length, fitted on some: nearest of the centres, then signs of what is left over."""

    def __init__(self, sample: np.ndarray, parts: int = PARTS, signs: int = SIGNS, rounds: int = 8):
        x = sample.astype(np.float64)
        k = min(parts, max(1, len(x) // 32))
        self.centres = x[np.linspace(0, len(x) - 1, k).astype(int)] if len(x) else np.zeros((1, sample.shape[1]))
        for _ in range(rounds if k > 1 else 0):
            own = self.nearest(x)
            sums, counts = np.zeros_like(self.centres), np.bincount(own, minlength=k)
            np.add.at(sums, own, x)
            self.centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], self.centres)
        self.centres = self.centres[np.concatenate(split(self.centres, 1))]  # neighbours are alike
        left = (x - self.centres[self.nearest(x)]).var(0) if len(x) else np.zeros(sample.shape[1])
        self.terms = np.argsort(-left, kind="stable")[:signs]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return np.argmin((self.centres * self.centres).sum(1) - 2 * x @ self.centres.T, axis=1)

    def keys(self, v: np.ndarray) -> np.ndarray:
        x = v.astype(np.float64)
        own = self.nearest(x)
        signs = (x - self.centres[own])[:, self.terms] > 0
        return (own.astype(np.int64) << len(self.terms)) | (signs @ (1 << np.arange(len(self.terms))[::-1])).astype(np.int64)


class Best:
    """The k best (score, id) of each query so far: higher score first, then smaller id. With what each must reach at least."""

    def __init__(self, least: np.ndarray, k: int):
        self.least = least.astype(np.float64)
        self.score = np.full((len(least), k), np.iinfo(np.int64).min)
        self.id = np.full((len(least), k), np.iinfo(np.int64).max)
        self.found = np.zeros((len(least), k), bool)

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, valid: np.ndarray) -> None:
        # an equal score may still have a smaller id
        some = (valid & (score >= self.kth()[rows][:, None])).any(1)
        rows, score, valid = rows[some], score[some], valid[some]
        s = np.concatenate((self.score[rows], score), 1)
        i = np.concatenate((self.id[rows], np.broadcast_to(ids, score.shape)), 1)
        f = np.concatenate((self.found[rows], valid), 1)
        order = np.lexsort((i, ~s, ~f), axis=1)[:, : self.score.shape[1]]  # ~s falls as s rises, without overflow
        self.score[rows] = np.take_along_axis(s, order, 1)
        self.id[rows] = np.take_along_axis(i, order, 1)
        self.found[rows] = np.take_along_axis(f, order, 1)

    def kth(self) -> np.ndarray:
        """The score that a block must be able to reach."""
        return np.where(self.found[:, -1], np.maximum(self.least, self.score[:, -1].astype(np.float64)), self.least)


def search_group(query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query index, id, score, pairs scored) of each query's k best in some blocks (ids, vectors) that reach `least`.

    Each query visits its blocks by falling bound, twice as many at a time as
    before, and stops where a bound is below its k-th score; the queries that visit a block at
    the same time are scored together.
    """
    summaries = [_summary(v) for _, v in blocks]
    bounds = _bounds(queries, *(np.stack([s[i] for s in summaries]) for i in range(3)), np.array([s[3] for s in summaries]))
    order = np.argsort(-bounds, axis=1, kind="stable")
    best, scored, live = Best(least, k), 0, np.arange(len(queries))
    start, width = 0, 1
    while start < len(blocks) and len(live):
        visit = order[live, start : start + width]
        due = bounds[live[:, None], visit] >= best.kth()[live][:, None]
        row, at = live[np.nonzero(due)[0]], visit[due]
        by_block = np.argsort(at, kind="stable")
        row, at = row[by_block], at[by_block]
        edges = np.searchsorted(at, np.arange(len(blocks) + 1))
        for b in np.unique(at):
            own, (ids, vectors) = row[edges[b] : edges[b + 1]], blocks[b]
            best.add(own, _products(queries[own], vectors), ids, ids[None, :] != query_ids[own][:, None])
            scored += len(own) * len(ids)
        live = live[due[:, -1]]
        start, width = start + width, 2 * width
    q, j = np.nonzero(best.found)
    return q, best.id[q, j], best.score[q, j], scored


def _matrix(data: pd.Series, dim: int) -> np.ndarray:
    return np.stack(data.to_list()).astype(np.int64).reshape(len(data), dim) if len(data) else np.zeros((0, dim), np.int64)


def _united(heads: pd.DataFrame) -> pd.DataFrame:
    """The summary of several groups: extremes of their terms, and a ball around their balls."""
    dim = int(heads["dim"].iat[0])
    high, low, centre = (np.stack([np.frombuffer(x).reshape(3, dim)[i] for x in heads["vectors"]]) for i in range(3))
    radius = np.array([np.frombuffer(x)[0] for x in heads["ids"]])
    middle = centre.mean(0)
    widest = (np.sqrt(((centre - middle) ** 2).sum(1)) + radius).max() * (1 + 1e-9)
    return pd.DataFrame({"g": [heads["g"].iat[0]], "dim": [dim], "ids": [np.array([widest]).tobytes()], "vectors": [np.stack((high.max(0), low.min(0), middle)).tobytes()]})


class Index:
    """The blocks of all vectors (g, dim, b, n, ids, vectors; the summary of a group has b -1), and the summaries of groups."""

    def __init__(self, vectors: DataFrame, block: int = BLOCK, group: int = GROUP):
        spark = vectors.sparkSession
        vectors = materialise(vectors.withColumn("dim", F.size("q")), "topk-vectors")
        shape = {r["dim"]: r["n"] for r in vectors.groupBy("dim").agg(F.count("*").alias("n")).collect()}
        n, widest = sum(shape.values()), max(shape, default=1)
        groups = max(1, min(GROUPS, SUMMARY_BYTES // (24 * max(widest, 1))))
        size = group
        #: groups that share a summary: those of one range
        self.shared = max(1, -(-n // (groups * group)))
        rows = min(SAMPLE, max(256, SAMPLE_BYTES // (8 * max(widest, 1))))
        some = hashed_sample(vectors, ["id", "q"], rows).select("dim", "q").toPandas()
        fits = {dim: Partition(_matrix(some["q"][some["dim"] == dim], dim)) for dim in shape}
        shared = spark.sparkContext.broadcast(fits)

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                key = np.zeros(len(pdf), np.int64)
                for dim in pdf["dim"].unique():
                    own = (pdf["dim"] == dim).to_numpy()
                    key[own] = shared.value[dim].keys(_matrix(pdf["q"][own], dim))
                yield pdf.assign(key=key)

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            part, made, held, n_held = TaskContext.get().partitionId(), 0, [], 0

            def out(pdf: pd.DataFrame) -> pd.DataFrame:
                nonlocal made
                dim, g = int(pdf["dim"].iat[0]), (part << 32) | made
                made += 1
                ids, v = pdf["id"].to_numpy(np.int64), _matrix(pdf["q"], dim)
                high, low, centre, radius = _summary(v)
                rows = [(g, dim, -1, len(ids), np.array([radius]).tobytes(), np.stack((high, low, centre)).tobytes())]
                rows += [(g, dim, b, len(own), ids[own].tobytes(), v[own].tobytes()) for b, own in enumerate(split(v, block))]
                return pd.DataFrame(rows, columns=["g", "dim", "b", "n", "ids", "vectors"])

            for pdf in batches:
                for _, own in pdf.groupby("dim", sort=False):
                    if held and held[0]["dim"].iat[0] != own["dim"].iat[0]:
                        yield out(pd.concat(held))
                        held, n_held = [], 0
                    while len(own):
                        held.append(own.iloc[: size - n_held])
                        own, n_held = own.iloc[size - n_held :], n_held + len(held[-1])
                        if n_held == size:
                            yield out(pd.concat(held))
                            held, n_held = [], 0
            if held:
                yield out(pd.concat(held))

        placed = vectors.mapInPandas(place, "id long, q array<bigint>, dim int, key long")
        # a range of the order a task, of as many groups as share a summary; the id ends ties, so that equal vectors are split too
        ranged = placed.repartitionByRange(max(1, -(-n // (size * self.shared))), "dim", "key", "id").sortWithinPartitions("dim", "key", "id")
        self.blocks = materialise(ranged.mapInPandas(cut, "g long, dim int, b int, n int, ids binary, vectors binary"), "topk-index")
        heads = self.blocks.where("b = -1").select("g", "dim", "ids", "vectors")
        self.members = None
        if self.shared > 1:
            range_of = F.shiftright("g", 32)
            self.members = materialise(heads.select(range_of.alias("range"), F.col("dim").alias("of_dim"), F.col("g").alias("member")), "topk-members")
            heads = heads.withColumn("g", range_of).groupBy("g", "dim").applyInPandas(_united, "g long, dim int, ids binary, vectors binary")
        heads = heads.toPandas().sort_values(["dim", "g"])
        self.summaries = {}
        for dim, own in heads.groupby("dim"):
            terms = np.stack([np.frombuffer(x).reshape(3, dim) for x in own["vectors"]])
            radius = np.array([np.frombuffer(x)[0] for x in own["ids"]])
            self.summaries[int(dim)] = (own["g"].to_numpy(np.int64), terms[:, 0], terms[:, 1], terms[:, 2], radius)
        self.vectors, self.fits = n, shared


def search(index: Index, queries: DataFrame, k: int) -> tuple[DataFrame, list[DataFrame]]:
    """(qn, query_id, vec_id, score, rank): the k best of each distinct query row, and the counts (scored) of each round."""
    spark = queries.sparkSession
    asked = queries.dropDuplicates(["id", "q"]).withColumn("dim", F.size("q"))
    asked = materialise(asked.withColumn("qn", F.monotonically_increasing_id()), "topk-queries")
    summaries = spark.sparkContext.broadcast(index.summaries)
    most = max((len(s[0]) for s in index.summaries.values()), default=0)
    known = asked.withColumn("least", F.lit(float("-inf")))
    best, counts = None, []
    pair = "g long, qn long, id long, q array<bigint>, dim int, least double"
    start, stop = 0, 1
    while start < most:

        def route(batches: Iterator[pd.DataFrame], a: int = start, b: int = stop) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for dim, own in pdf.groupby("dim"):
                    if dim not in summaries.value:
                        continue
                    g, *terms = summaries.value[dim]
                    for at in range(0, len(own), 1024):
                        some = own.iloc[at : at + 1024]
                        bounds = _bounds(_matrix(some["q"], dim), *terms)
                        order = np.argsort(-bounds, axis=1, kind="stable")[:, a:b]
                        due = np.take_along_axis(bounds, order, 1) >= some["least"].to_numpy(float)[:, None]
                        row, col = np.nonzero(due)
                        yield some.iloc[row].assign(g=g[order[row, col]])[["g", "qn", "id", "q", "dim", "least"]]

        due = known.select("qn", "id", "q", "dim", "least").mapInPandas(route, pair)
        if index.members is not None:  # a query that a shared summary lets in goes to each group of it
            due = due.join(index.members, (F.col("g") == F.col("range")) & (F.col("dim") == F.col("of_dim"))).withColumn("g", F.col("member")).drop("range", "of_dim", "member")
        due = materialise(due, "topk-pairs")
        # as many rows as groups: into how many chunks the queries of a group are cut
        chunks = due.groupBy("g").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("chunks"))
        chunks = materialise(chunks.withColumnRenamed("g", "__g"), "topk-chunks")
        chunks = F.broadcast(chunks) if index.members is None else chunks
        left = due.join(chunks, due["g"] == F.col("__g")).withColumn("c", F.pmod(F.xxhash64("qn"), F.col("chunks")).cast("int")).drop("__g", "chunks")
        blocks = index.blocks.where("b >= 0")
        right = blocks.join(chunks, blocks["g"] == F.col("__g")).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("__g", "chunks")

        def score(ask: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            if not len(ask) or not len(own):
                return pd.DataFrame({"qn": [], "query_id": [], "vec_id": [], "score": []}, dtype="int64")
            dim = int(own["dim"].iat[0])
            parts = [(np.frombuffer(i, np.int64), np.frombuffer(v, np.int64).reshape(n, dim)) for i, v, n in zip(own["ids"], own["vectors"], own["n"])]
            at, vec, points, scored = search_group(ask["id"].to_numpy(np.int64), _matrix(ask["q"], dim), ask["least"].to_numpy(float), parts, k)
            out = pd.DataFrame({"qn": ask["qn"].to_numpy(np.int64)[at], "query_id": ask["id"].to_numpy(np.int64)[at], "vec_id": vec, "score": points})
            return pd.concat([out, pd.DataFrame({"qn": [-1], "query_id": [0], "vec_id": [0], "score": [scored]})], ignore_index=True)

        found = left.groupBy("g", "c").cogroup(right.groupBy("g", "c")).applyInPandas(score, "qn long, query_id long, vec_id long, score long")
        found = materialise(found, "topk-found")
        counts.append(found.where("qn = -1").select(F.col("score").alias("scored")))
        fresh = found.where("qn >= 0")
        every = fresh if best is None else best.drop("rank").unionByName(fresh)
        rank = F.row_number().over(Window.partitionBy("qn").orderBy(F.desc("score"), "vec_id"))
        best = materialise(every.withColumn("rank", rank).where(F.col("rank") <= k), "topk-best")
        start, stop = stop, 4 * stop
        if start < most:
            kth = best.where(F.col("rank") == k).select(F.col("qn").alias("__qn"), F.col("score").cast("double").alias("least"))
            known = materialise(asked.join(kth, asked["qn"] == F.col("__qn"), "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))).drop("__qn"), "topk-known")
    return best, counts


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query, its own id left out.

    Both are (id, q) as quantised() makes them. Ties go to the smaller id; a
    query with fewer than k candidates gets all. A vector is compared with those of
    its own length; empty vectors have score 0 with each other. Repeated ids are candidates each; a query id that is repeated
    is answered once for each of its distinct vectors, merged into one list of k.
    A score beyond a long is an error. An empty side gives an empty result.
    """
    best, _ = search(Index(candidates, block, group), queries, k)
    if best is None:
        best = candidates.sparkSession.createDataFrame([], "qn long, query_id long, vec_id long, score long, rank int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def scored_share(candidates: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK, group: int = GROUP) -> float:
    """The share of all pairs of a query and a vector that the search scores."""
    index = Index(candidates, block, group)
    _, counts = search(index, queries, k)
    scored = sum(c.agg(F.sum("scored")).first()[0] or 0 for c in counts)
    return scored / max(1, index.vectors * queries.dropDuplicates(["id", "q"]).count())


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """top_k() over the whole table `embeddings`, its rows of vec_id divisible by 50 asked; awkward rows as there."""
    vectors = materialise(quantised(table(spark, sf_dir, "embeddings")), "quantised")
    return top_k(vectors, vectors.where("id % 50 = 0"), 5)


OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
