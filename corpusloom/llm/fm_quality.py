"""Quality classifier: a factorisation machine.

Features of a text are its hashed words (square roots of their shares, unit
length), statistics of its structure and its recorded length, cut into
buckets. A score is the logistic of a bias, linear weights and low-rank pairwise interactions;
these are summed in linear time as half of (sum of v x) ** 2 - sum of (v x) ** 2.
Labels, language, source and id are never features.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hashed_sample, mapped, table

#: Hash buckets of words; after them come the buckets of the statistics.
WORDS, BUCKETS, RANK = 2**16, 16, 8
#: Labelled rows that a fit uses at most: those of smallest hash of the id. The one bound of the fit.
FIT_ROWS = 6_000

# Upper edges of the buckets of each statistic.
_LOGS = [math.log1p(x) for x in (0, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096, 16384, 65536, 1e9)]
_SHARES = [0, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]
_LENGTHS = [0, 1, 2, 3, 3.5, 4, 4.5, 5, 5.5, 6, 7, 8, 10, 15, 1e9]
STATISTICS = {
    "words": _LOGS, "lines": _LOGS, "length": _LOGS, "word_length": _LENGTHS, "distinct": _SHARES, "same_lines": _SHARES, "stutter": _SHARES,
    "symbols": _SHARES, "digits": _SHARES, "capitals": _SHARES, "stops": _SHARES, "most_common": _SHARES,
}
DIM = WORDS + BUCKETS * len(STATISTICS)
_SYMBOLS = re.compile(r"[#*$%&|<>{}\[\]\\^~=_@]")


def features(text: str | None, n_chars: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of a text; an empty one has its statistics alone."""
    text = text or ""
    found = text.split()
    n, size = len(found), max(len(text), 1)
    counts = Counter(found)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    stat = (
        math.log1p(n), math.log1p(len(lines)), math.log1p(max(n_chars, 0)) if n_chars is not None and n_chars == n_chars else math.log1p(len(text)), sum(map(len, found)) / max(n, 1),
        len(counts) / max(n, 1), 1 - len(set(lines)) / max(len(lines), 1), sum(map(str.__eq__, found, found[1:])) / max(n, 1),
        len(_SYMBOLS.findall(text)) / size, sum(map(text.count, "0123456789")) / size, sum(w[0].isupper() for w in found) / max(n, 1),
        (text.count(".") + text.count("!") + text.count("?")) / max(n, 1), max(counts.values(), default=0) / max(n, 1),
    )
    at = [WORDS + BUCKETS * k + int(np.searchsorted(edges, x)) for k, (x, edges) in enumerate(zip(stat, STATISTICS.values()))]
    if not counts:
        return np.array(at, np.int64), np.ones(len(at))
    words = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) & (WORDS - 1) for w in counts), np.int64, len(counts))
    # words of one bucket are one feature: there are at most DIM, whatever the text
    words, same = np.unique(words, return_inverse=True)
    value = np.sqrt(np.bincount(same, np.fromiter(counts.values(), float, len(counts))) / n)  # squares sum to 1
    return np.concatenate((words, at)), np.concatenate((value, np.ones(len(at))))


@dataclass
class Machine:
    """bias, linear weights and factors; scores in time linear in the features."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, index: np.ndarray, value: np.ndarray) -> float:
        v = self.factors[index] * value[:, None]
        pairs = 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
        return self.bias + float(self.linear[index] @ value) + pairs

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        return 1 / (1 + math.exp(-min(max(self.margin(index, value), -30.0), 30.0)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = RANK, epochs: int = 12, rate: float = 0.05, decay: float = 1e-4, seed: int = 42, batch: int = 128) -> Machine:
    """Logistic loss by AdaGrad over mini-batches. Rows of one class only, or none, give its share (0.5 for none)."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, float)
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Machine(math.log(share / (1 - share)), np.zeros(DIM, np.float64), rng.normal(0, 0.01, (DIM, rank)))
    if len(y) == 0 or y.min() == y.max():
        model.factors[:] = 0
        return model
    g_bias, g_linear, g_factors = 1e-6, np.full(DIM, 1e-6), np.full((DIM, rank), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), batch):
            some = order[k : k + batch]
            index = np.concatenate([rows[i][0] for i in some])
            value = np.concatenate([rows[i][1] for i in some])
            sizes = np.array([len(rows[i][0]) for i in some])
            start = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            row = np.repeat(np.arange(len(some)), sizes)
            vx = model.factors[index] * value[:, None]
            sums = np.add.reduceat(vx, start, axis=0)
            pairs = 0.5 * (sums**2 - np.add.reduceat(vx**2, start, axis=0)).sum(1)
            margin = model.bias + np.add.reduceat(model.linear[index] * value, start) + pairs
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[some]) / len(some)
            used, place = np.unique(index, return_inverse=True)
            step = error[row] * value
            d_linear = np.bincount(place, step, len(used)) + decay * model.linear[used]
            each = step[:, None] * (sums[row] - vx)
            d_factors = np.stack([np.bincount(place, each[:, f], len(used)) for f in range(rank)], 1) + decay * model.factors[used]
            g_linear[used] += d_linear**2
            g_factors[used] += d_factors**2
            g_bias += error.sum() ** 2
            model.linear[used] -= rate * d_linear / np.sqrt(g_linear[used])
            model.factors[used] -= rate * d_factors / np.sqrt(g_factors[used])
            model.bias -= rate * error.sum() / math.sqrt(g_bias)
    return model


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Machine:
    """Fit on at most fit_rows labelled rows, none of which is held out (crc32 of the id as text, modulo 4, is 2).

    They are chosen by hash of the id. Null labels and ids are no labels; a
    repeated id counts once. Only the features of these rows come to the driver, as bytes: 8 for each of at most DIM a row.
    """
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (part != 2)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = hashed_sample(known, ["doc_id"], fit_rows).select(F.col("doc_id").alias("__id"), "quality")
    n_chars = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    some = docs.select("doc_id", "text", n_chars.alias("n_chars")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))  # fit_rows ids at most
    # an id of many rows gives one: that of the smallest hash of its text
    some = some.groupBy("__id").agg(F.min_by(F.struct("doc_id", "text", "n_chars", "quality"), F.xxhash64("text", "n_chars")).alias("r")).select("r.*")

    def make():
        def run(texts: list, lengths: list) -> tuple:
            got = [features(t, c) for t, c in zip(texts, lengths)]
            return [x[0].astype(np.int32).tobytes() for x in got], [x[1].astype(np.float32).tobytes() for x in got]

        return run

    added = {"i": ("binary", pa.binary()), "x": ("binary", pa.binary())}
    got = mapped(some, ["doc_id", "quality"], ["text", "n_chars"], make, added)
    rows = sorted(got.collect(), key=lambda r: (zlib.crc32(str(r[0]).encode()), str(r[0]), len(r[2])))
    return fit([(np.frombuffer(r[2], np.int32).astype(np.int64), np.frombuffer(r[3], np.float32).astype(float)) for r in rows], np.array([r[1] for r in rows]))


def score_documents(docs: DataFrame, model: Machine, threshold: float = 0.7) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted.

    Null and empty texts are scored by their statistics; very long ones whole.
    The model is of a fixed size (DIM x (RANK + 1) numbers, some 5 MB) and is broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.linear.astype(np.float32), model.factors.astype(np.float32)))

    def make():
        machine = Machine(*sent.value)
        return lambda texts, lengths: ([machine.score(*features(t, c)) for t, c in zip(texts, lengths)],)

    n_chars = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    wanted = docs.select("doc_id", "text", n_chars.alias("n_chars"))
    scored = mapped(wanted, ["doc_id"], ["text", "n_chars"], make, {"score": ("double", pa.float64())})
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_documents() of the whole table `documents`, fitted by train() on `labels`; awkward rows and empty tables as there."""
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
