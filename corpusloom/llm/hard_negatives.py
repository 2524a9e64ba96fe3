"""Hard negatives by exact search over one-dimensional distance keys.

A component is added to each vector that gives all the same length, so the nearest to a query are those of
the highest inner product. Each vector belongs to the nearest of some pivots, and its key is (pivot, distance to it);
the table is stored sorted by this key and cut into chunks. By the triangle inequality a vector within r
of a query has its key within r of the query's own distance to the pivot. So a query scans the key
intervals of a first radius, and then only the annuli that a wider one adds, until the
distance of its k-th best is within the radius: nothing beyond can be better.

Negatives are searched below a positive's score, so their scan also leaves out the
keys that are too near.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hashed_sample, materialise, table
from .topk_search import Partition, _products, quantised

#: Vectors and bytes in a chunk; queries that a task scores against one; of these at once.
CHUNK, CHUNK_BYTES, QUERIES, AT_ONCE = 4_096, 4 * 1024 * 1024, 1_024, 128
#: Pivots of a length at most; rows and bytes of the sample that they and the first radius are fitted on.
PIVOTS, SAMPLE, SAMPLE_BYTES = 64, 8_192, 16 * 1024 * 1024
_LOW, _HIGH = -(2**63), 2**63 - 1


def _matrix(data: pd.Series, dim: int) -> np.ndarray:
    return np.stack(data.to_list()).astype(np.int64).reshape(len(data), dim) if len(data) else np.zeros((0, dim), np.int64)


class Pivots:
    """Pivots in the augmented space of vectors of one length whose squared length is `top` at most."""

    def __init__(self, sample: np.ndarray, labels: np.ndarray, top: float, k: int, parts: int = PIVOTS):
        self.top = top
        self.points = Partition(self.augmented(sample), parts, 0).centres if len(sample) else np.zeros((1, sample.shape[1] + 1))
        self.radius = self._first_radius(sample[:512], labels[:512], sample, labels, k)

    def augmented(self, v: np.ndarray) -> np.ndarray:
        x = v.astype(np.float64)
        return np.concatenate((x, np.sqrt(np.maximum(self.top - (x * x).sum(1), 0))[:, None]), 1)

    def keys(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest pivot, distance to it) of each vector."""
        x = self.augmented(v)
        own = np.argmin((self.points * self.points).sum(1) - 2 * x @ self.points.T, axis=1)
        return own, np.sqrt(((x - self.points[own]) ** 2).sum(1))

    def query(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each query's factor, which makes it as long as the vectors, and its distances to all pivots."""
        x = q.astype(np.float64)
        length = np.sqrt((x * x).sum(1))
        factor = np.divide(np.sqrt(self.top), length, out=np.ones_like(length), where=length > 0)
        x = np.concatenate((x * factor[:, None], np.zeros((len(x), 1))), 1)
        return factor, np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in self.points], 1)

    def _first_radius(self, q: np.ndarray, own: np.ndarray, v: np.ndarray, labels: np.ndarray, k: int) -> float:
        """The median distance of the k-th best of its label in the sample: a start, not a bound."""
        if not len(q):
            return 0.0
        factor, _ = self.query(q)
        x = q * factor[:, None]
        d2 = (x * x).sum(1)[:, None] + self.top - 2 * x @ v.astype(np.float64).T
        d2[own[:, None] != labels[None, :]] = np.inf
        kth = np.sqrt(np.maximum(np.partition(d2, min(k, len(v) - 1), axis=1)[:, min(k, len(v) - 1)], 0))
        return float(np.median(np.where(np.isfinite(kth), kth, 2 * np.sqrt(self.top))))


def first_copies(rows: DataFrame, copies: int) -> DataFrame:
    """Of rows (id, label, q) alike in label and vector the first `copies` by id: no other can be among the copies - 1 best of a query.

    Each task keeps as many of its own before any are moved, so a vector that a third of all rows share is a few rows a task.
    """
    order = Window.partitionBy(F.xxhash64("label", "q"), "label", "q").orderBy("id")
    return rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= copies).drop("__n")


class KeyIndex:
    """Chunks of (id, label, vector) in the order of (length, pivot, distance), and their directory, both written tables.

    chunks: chunk, dim, pivot, lo, hi (distances), label_lo, label_hi, n, ids, labels, vectors.
    directory: chunk, dim, pivot, lo, hi, label_lo, label_hi, ring, first: a row for each ring of distances that the chunk touches.
    """

    def __init__(self, rows: DataFrame, k: int, chunk: int = CHUNK, parts: int = PIVOTS):
        spark = rows.sparkSession
        rows = materialise(first_copies(rows, k + 1).withColumn("dim", F.size("q")), "keys-vectors")
        length = F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        top, most, widest = rows.agg(F.max(length), F.max(F.array_max(F.transform("q", lambda x: F.abs(x.cast("double"))))), F.max("dim")).first()
        self.top, self.widest = float(top or 0.0) * (1 + 1e-9), int(widest or 0)
        self.slack = 1e-6 * np.sqrt(self.top)
        kind = np.dtype(np.int16 if (most or 0) < 2**15 - 1 else np.int32 if most < 2**31 - 1 else np.int64)
        self.kind = kind
        few = hashed_sample(rows, ["id", "q"], min(SAMPLE, max(256, SAMPLE_BYTES // (8 * max(self.widest, 1))))).select("dim", "label", "q").toPandas()
        top = self.top
        fits = {int(d): Pivots(_matrix(own["q"], int(d)), own["label"].to_numpy(), top, k, parts) for d, own in few.groupby("dim")}
        self.fits = spark.sparkContext.broadcast(fits)
        shared = self.fits

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for dim, own in pdf.groupby("dim"):
                    v = _matrix(own["q"], dim)
                    pivot, key = pivots(shared.value, dim, top).keys(v)
                    yield pd.DataFrame({"dim": dim, "pivot": pivot, "key": key, "id": own["id"], "label": own["label"], "v": [x.tobytes() for x in v.astype(kind)]})

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            part, made, held, n_held = TaskContext.get().partitionId(), 0, [], 0

            def out() -> pd.DataFrame:
                nonlocal made, held, n_held
                pdf = pd.concat(held).sort_values("id", kind="stable")
                held, n_held, made = [], 0, made + 1
                label, key = pdf["label"], pdf["key"]
                row = (part << 32 | made, pdf["dim"].iat[0], pdf["pivot"].iat[0], key.min(), key.max(), label.min(), label.max(), len(pdf))
                return pd.DataFrame([(*row, pdf["id"].to_numpy(np.int64).tobytes(), label.to_numpy(np.int64).tobytes(), b"".join(pdf["v"]))], columns=columns)

            columns = [c.split()[0] for c in schema.split(", ")]
            for pdf in batches:
                for (dim, pivot), own in pdf.groupby(["dim", "pivot"], sort=False):
                    size = min(chunk, max(16, CHUNK_BYTES // (kind.itemsize * max(dim, 1))))
                    if held and (held[0]["dim"].iat[0], held[0]["pivot"].iat[0]) != (dim, pivot):
                        yield out()
                    while len(own):
                        held.append(own.iloc[: size - n_held])
                        own, n_held = own.iloc[size - n_held :], n_held + len(held[-1])
                        if n_held == size:
                            yield out()
            if held:
                yield out()

        schema = "chunk long, dim int, pivot int, lo double, hi double, label_lo long, label_hi long, n int, ids binary, labels binary, vectors binary"
        n = rows.count()
        placed = rows.select("id", "label", "q", "dim").mapInPandas(place, "dim int, pivot int, key double, id long, label long, v binary")
        ranged = placed.repartitionByRange(max(1, -(-n // (4 * chunk))), "dim", "pivot", "key", "id").sortWithinPartitions("dim", "pivot", "key", "id")
        self.chunks = materialise(ranged.mapInPandas(cut, schema), "keys-chunks")
        farthest, chunks = self.chunks.agg(F.max("hi"), F.count("*")).first()
        # about as many rings of a pivot as it has chunks
        self.rings = max(1, -(-chunks // parts))
        self.width = (float(farthest or 0.0) / self.rings) or 1.0
        rings = F.sequence(F.floor(F.col("lo") / self.width), F.floor(F.col("hi") / self.width))
        directory = self.chunks.drop("ids", "labels", "vectors", "n").withColumn("ring", F.explode(rings))
        self.directory = materialise(directory.withColumn("first", F.floor(F.col("lo") / self.width)), "keys-directory")


def pivots(fits: dict[int, Pivots], dim: int, top: float) -> Pivots:
    """Those of this length; of a length that the sample has none of, the origin alone."""
    return fits.get(int(dim)) or Pivots(np.zeros((0, int(dim)), np.int64), np.zeros(0, np.int64), top, 1)


def asked(index: KeyIndex, queries: DataFrame) -> DataFrame:
    """queries (id, label, q) with a number, the factor, the distances to all pivots, and the first radius; written, so that each round sees the same."""
    shared, top = index.fits, index.top

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, own in pdf.groupby("dim"):
                fit, v = pivots(shared.value, dim, top), _matrix(own["q"], dim)
                factor, far = fit.query(v)
                x = v * factor[:, None]
                yield pd.DataFrame({
                    "qn": own["qn"], "id": own["id"], "label": own["label"], "dim": dim, "q": [x.tobytes() for x in v], "factor": factor,
                    "base": (x * x).sum(1) + top, "far": np.sqrt((x * x).sum(1)) + np.sqrt(top), "start": fit.radius, "dq": list(far),
                })

    schema = "qn long, id long, label long, dim int, q binary, factor double, base double, far double, start double, dq array<double>"
    numbered = materialise(queries.withColumn("dim", F.size("q")).withColumn("qn", F.monotonically_increasing_id()), "keys-asked")
    return materialise(numbered.mapInPandas(measure, schema), "keys-measured")


def _distance(score: Column, slack: float) -> Column:
    """The distance at which a vector of this score lies; _LOW is beyond any."""
    d2 = F.col("base") - 2 * F.col("factor") * score.cast("double")
    return F.least(F.sqrt(F.greatest(d2, F.lit(0.0))), F.col("far")) + slack


def visits(index: KeyIndex, state: DataFrame, same: bool) -> DataFrame:
    """(chunk, and the columns of state): the chunks whose vectors may lie in the annulus between radius `was` and `r` of a query, and have labels asked for.

    A chunk whose keys are all nearer to the query's than the least distance wanted is left out too.
    """
    near = F.greatest(F.array_max("hi_score").cast("double"), F.lit(float(_LOW)))
    state = state.withColumn("least", F.when(F.array_max("hi_score") == _HIGH, F.lit(-1.0)).otherwise(_distance(near, 0.0) - index.slack))
    each = state.select("*", F.posexplode("dq").alias("p", "d")).drop("dq")
    shells = F.when(F.col("was") < 0, F.array(F.struct(F.lit(0).alias("side"), (F.col("d") - F.col("r")).alias("a"), (F.col("d") + F.col("r")).alias("b")))).otherwise(
        F.array(
            F.struct(F.lit(-1).alias("side"), (F.col("d") - F.col("r")).alias("a"), (F.col("d") - F.col("was")).alias("b")),
            F.struct(F.lit(1).alias("side"), (F.col("d") + F.col("was")).alias("a"), (F.col("d") + F.col("r")).alias("b")),
        )
    )
    inside = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(float(index.rings)))
    each = each.select("*", F.explode(shells).alias("s")).where("s.b >= 0")
    each = each.withColumn("low", F.floor(inside(F.col("s.a") / index.width - 1e-6))).withColumn("ring", F.explode(F.sequence("low", F.floor(inside(F.col("s.b") / index.width + 1e-6)))))
    d = index.directory.withColumnsRenamed({"dim": "d_dim", "ring": "d_ring", "first": "d_first"})
    left, right = F.col("d") - F.col("hi"), F.col("lo") - F.col("d")
    gap = F.when(F.col("s.side") == 0, F.greatest(left, right, F.lit(0.0))).when(F.col("s.side") < 0, left).otherwise(right)
    label = F.col("label").between(F.col("label_lo"), F.col("label_hi"))
    if not same:
        label = ~((F.col("label_lo") == F.col("label")) & (F.col("label_hi") == F.col("label")))
    met = each.join(d, (F.col("dim") == F.col("d_dim")) & (F.col("p") == F.col("pivot")) & (F.col("ring") == F.col("d_ring")))
    # once, at the first ring that both touch; the rings' upper end holds what lies beyond
    once = F.col("ring") == F.greatest("low", F.least(F.col("d_first"), F.lit(index.rings)))
    due = once & (gap > F.col("was")) & (gap <= F.col("r")) & (F.col("d") + F.col("hi") >= F.col("least")) & label
    return met.where(due).select("chunk", "qn", "id", "label", "dim", "q", "hi_score", "lo_score")


def best_of(scores: np.ndarray, valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest valid scores of each row, all if fewer; of equal ones those of the first columns."""
    n = scores.shape[1]
    if not scores.size:
        return np.zeros(0, int), np.zeros(0, int)
    if max(int(scores.max()), -int(scores.min())) < 2**62 // (n + 1):
        order = scores * n + np.arange(n - 1, -1, -1)
        order = np.where(valid, order, _LOW)
        top = np.argpartition(order, n - min(k, n), axis=1)[:, n - min(k, n) :]
    else:
        top = np.lexsort((np.broadcast_to(np.arange(n), scores.shape), ~scores, ~valid), axis=1)[:, :k]
    row, at = np.nonzero(np.take_along_axis(valid, top, 1))
    return row, top[row, at]


def search(index: KeyIndex, queries: DataFrame, k: int, same: bool) -> tuple[DataFrame, list[DataFrame]]:
    """(qn, band, rank, found, score): the k best of each query's bands, and the visits of each round.

    queries are asked() ones with the bands of scores hi_score and lo_score (arrays, both inclusive) and the
    radius r to start with. same: rows of the query's label, else rows of others. A row of the query's id is none.
    """
    kind = index.kind
    state = queries.withColumn("was", F.lit(-1.0))
    best: DataFrame | None = None
    rounds = []

    def score(ask: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, ...]] = []
        if len(ask) and len(own):
            dim, n = int(own["dim"].iat[0]), int(own["n"].iat[0])
            ids, labels = (np.frombuffer(own[c].iat[0], np.int64) for c in ("ids", "labels"))
            v = np.frombuffer(own["vectors"].iat[0], kind).reshape(n, dim).astype(np.int64)
            for at in range(0, len(ask), AT_ONCE):
                some = ask.iloc[at : at + AT_ONCE]
                q = np.stack([np.frombuffer(x, np.int64) for x in some["q"]]).reshape(len(some), dim)
                s = _products(q, v)
                fits = (labels[None, :] == some["label"].to_numpy()[:, None]) == same
                fits &= ids[None, :] != some["id"].to_numpy()[:, None]
                qn, high, low = some["qn"].to_numpy(), some["hi_score"].to_list(), some["lo_score"].to_list()
                for band in range(max(map(len, high))):
                    a = np.array([x[band] if band < len(x) else _LOW for x in high], np.int64)
                    b = np.array([x[band] if band < len(x) else _HIGH for x in low], np.int64)
                    row, col = best_of(s, fits & (s <= a[:, None]) & (s >= b[:, None]), k)
                    out.append((qn[row], np.full(len(row), band), ids[col], s[row, col]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
        return pd.DataFrame(dict(zip(("qn", "band", "found", "score"), columns)))

    while True:
        due = materialise(visits(index, state, same), "keys-visits")
        rounds.append(due)
        parts = due.groupBy("chunk").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
        parts = materialise(parts.withColumnRenamed("chunk", "__chunk"), "keys-parts")
        left = due.join(parts, F.col("chunk") == F.col("__chunk")).withColumn("c", F.pmod(F.xxhash64("qn"), F.col("parts")).cast("int")).drop("__chunk", "parts")
        right = index.chunks.select("chunk", "dim", "n", "ids", "labels", "vectors").join(parts, F.col("chunk") == F.col("__chunk"))
        right = right.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("__chunk", "parts")
        fresh = left.groupBy("chunk", "c").cogroup(right.groupBy("chunk", "c")).applyInPandas(score, "qn long, band int, found long, score long")
        every = fresh if best is None else best.drop("rank").unionByName(fresh)
        rank = F.row_number().over(Window.partitionBy("qn", "band").orderBy(F.desc("score"), "found"))
        best = materialise(every.withColumn("rank", rank).where(F.col("rank") <= k), "keys-best")
        kth = best.where(F.col("rank") == k).groupBy(F.col("qn").alias("__qn")).agg(F.map_from_entries(F.collect_list(F.struct("band", "score"))).alias("kth"))
        held = state.join(kth, F.col("qn") == F.col("__qn"), "left").drop("__qn")
        wanted = F.array_min(F.transform("lo_score", lambda low, band: F.coalesce(F.element_at("kth", band), low)))
        full = F.coalesce(F.size("kth"), F.lit(0)) == F.size("lo_score")
        held = held.withColumn("need", _distance(wanted, index.slack)).where(F.col("r") < F.col("need"))
        wider = F.when(full, F.col("need")).otherwise(F.least("need", F.greatest(2 * F.col("r"), F.lit(index.width))))
        state = materialise(held.withColumn("was", F.col("r")).withColumn("r", wider).drop("need", "kth"), "keys-open")
        if not state.limit(1).count():
            return best, rounds


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, least: str = "0.8", chunk: int = CHUNK, parts: int = PIVOTS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors among rows, both (id, label, q) as labelled() makes them.

    An anchor's positives are the first rows of its label, its negatives for each the
    first rows of other labels whose score is between `least` (a decimal) times the positive's and the positive's. Higher inner
    products come first, ties by smaller id. Exact. Rows of the anchor's own id are left out; of rows alike in label and vector
    those with the first ids count, as ties do; repeated ids are rows each, a repeated anchor is answered for each of its
    rows. Vectors meet those of their own length; empty ones score 0. A negative positive score has no negatives. A score
    beyond a long is an error. An empty side gives an empty result.
    """
    most = max(positives, negatives)
    index = KeyIndex(rows, most, chunk, parts)
    known = asked(index, anchors)
    free = known.withColumn("hi_score", F.array(F.lit(_HIGH))).withColumn("lo_score", F.array(F.lit(_LOW).cast("long"))).withColumn("r", F.least("start", "far"))
    pos, _ = search(index, free, positives, True)
    floor = F.ceil(F.col("score").cast("decimal(20,0)") * F.lit(least).cast("decimal(10,6)")).cast("long")
    pos = pos.withColumn("floor", floor).where("floor <= score")
    pos = materialise(pos.withColumn("band", F.row_number().over(Window.partitionBy("qn").orderBy("rank")) - 1), "keys-positives")
    bands = pos.groupBy(F.col("qn").alias("__qn")).agg(F.array_sort(F.collect_list(F.struct("band", "score", "floor"))).alias("b"))
    bands = known.join(bands, F.col("qn") == F.col("__qn")).withColumn("hi_score", F.col("b.score")).withColumn("lo_score", F.col("b.floor")).drop("__qn", "b")
    start = _distance(F.array_min("hi_score"), index.slack) + index.width / 8
    neg, _ = search(index, materialise(bands.withColumn("r", start), "keys-bands"), negatives, False)
    pairs = pos.select(F.col("qn").alias("p_qn"), F.col("band").alias("p_band"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    out = neg.join(pairs, (F.col("qn") == F.col("p_qn")) & (F.col("band") == F.col("p_band")))
    who = known.select(F.col("qn").alias("a_qn"), F.col("id").alias("anchor_id"))
    out = out.join(who, F.col("qn") == F.col("a_qn"))
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def labelled(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, q): quantised() vectors of rows that have a label."""
    return quantised(vectors.where(F.col(label_col).isNotNull()), id_col, vector_col, keep={"label": F.col(label_col).cast("long")}).select("id", "label", "q")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hard_negatives() over the whole table `embeddings`, ids divisible by 7 relabelled, those by 100 as anchors; null and non-finite rows take no part."""
    rows = labelled(table(spark, sf_dir, "embeddings"))
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = materialise(rows.withColumn("label", moved), "labelled")
    return hard_negatives(rows, rows.where("id % 100 = 0"))


OP11_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
