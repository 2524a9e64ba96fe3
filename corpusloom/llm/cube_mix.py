"""Mixing sources to target weights by the cube method of balanced sampling.

Every document of a source is wanted `target / source_size` times: that many whole
copies, and one more with the fractional part as inclusion probability. The
flight phase moves these probabilities through the null space of the balancing
constraints (documents, words) so that each step fixes one document at 0 or 1 and
leaves both totals as they were. It runs in chunks of a source; what a chunk can't
fix (as many as constraints, at most) flies on in the next, far smaller, round.
Once a source fits one chunk, its last few documents land on the assignment whose
totals come nearest.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_unique, materialise, n_words, shielded, table
from .feistel_shard import numbered

#: Documents that fly together.
CHUNK = 4096
#: Documents of a chunk that don't fly, spread over its sizes: with the 2 at most that the flight leaves
#: they go to the next round or, in the last, land on the best of all assignments.
RESERVE = 12
EPS = 1e-9


def targets(sources: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources (source, source_size, ...) -> the same with `weight` and `target`.

    Sources by code point, null last, take the weights in turn and share
    `share` times all sizes; a target stops at `most` times its source's size and
    the excess is shared again by weight until none is above. Only three sums come
    to the driver each round; a round without a new stop is the last.
    """
    # sources are numbered by range partitions: there may be any number of them
    ranked = numbered(sources.withColumn("__null", F.col("source").isNull()), ["__null", "source"])
    turn = F.array(*[F.lit(float(w)) for w in weights])
    out = materialise(ranked.withColumn("weight", F.get(turn, (F.col("row_number") % len(weights)).cast("int"))).drop("row_number", "__null"), "mix-sources")
    total = out.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * F.lit(float(most))
    rate, stopped = None, -1  # rate: words for each unit of weight; it only grows, so what has stopped stays so
    while True:
        over = F.lit(False) if rate is None else F.col("weight") * F.lit(rate) > cap
        row = out.agg(
            F.sum(F.when(over, cap).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.sum(over.cast("int"))
        ).first()
        capped, weight, n = row[0] or 0.0, row[1] or 0.0, row[2] or 0
        if n == stopped or weight <= 0:
            break
        rate, stopped = max(rate or 0.0, (share * total - capped) / weight), n
    rate = rate if rate is not None else 0.0
    return out.withColumn("target", F.least(F.col("weight") * F.lit(rate), cap))


def _draw(seed: int, keys: np.ndarray) -> np.ndarray:
    """A reproducible number in [0, 1) for each key: splitmix64 of it."""
    x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))).astype(np.float64) / 2.0**64


def fly(p: np.ndarray, size: np.ndarray, draws: np.ndarray, reserve: int = RESERVE) -> np.ndarray:
    """Flight phase: p with all but reserve + 2 entries at 0 or 1, at most; sum(p) and sum(p * size) stay.

    The reserve are documents at even ranks by size, largest first: of sizes as
    different as the chunk has, they can make up for what landing rounds away.
    """
    p = p.astype(float).copy()
    queue = [i for i in np.lexsort((np.arange(len(p)), -size)).tolist() if EPS < p[i] < 1 - EPS]
    if reserve:
        held = {queue[j * len(queue) // reserve] for j in range(reserve)} if len(queue) > reserve else set(queue)
        queue = [i for i in queue if i not in held]
    scale = float(max(size.max(initial=1), 1))
    live, at = queue[:3], 3
    while len(live) == 3:
        i, j, k = live
        a, b, c = size[i] / scale, size[j] / scale, size[k] / scale
        u = (b - c, c - a, a - b)  # null vector of the rows (1, 1, 1) and (a, b, c)
        if max(map(abs, u)) < 1e-12:
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[x]) / v if v > 0 else p[x] / -v for x, v in zip(live, u) if abs(v) > 1e-15)
        down = min(p[x] / v if v > 0 else (1 - p[x]) / -v for x, v in zip(live, u) if abs(v) > 1e-15)
        step = up if draws[i] * (up + down) < down else -down
        for x, v in zip(live, u):
            p[x] = min(1.0, max(0.0, p[x] + step * v))
        kept = [x for x in live if EPS < p[x] < 1 - EPS]
        if len(kept) == 3:  # rounding: the nearest is fixed
            x = min(kept, key=lambda q: min(p[q], 1 - p[q]))
            p[x] = round(p[x])
            kept.remove(x)
        take = 3 - len(kept)
        live, at = kept + queue[at : at + take], at + take
    for x in range(len(p)):
        if p[x] <= EPS or p[x] >= 1 - EPS:
            p[x] = round(p[x])
    return p


def land(p: np.ndarray, size: np.ndarray, words_due: float, docs_due: float) -> np.ndarray:
    """The 0/1 assignment of a few documents whose words, then number, come nearest to what is due."""
    n = len(p)
    if not n:
        return p
    bits = ((np.arange(2**n)[:, None] >> np.arange(n)) & 1).astype(float)
    off = np.abs(bits @ size - words_due)
    best = np.lexsort((np.arange(2**n), np.abs(bits.sum(1) - docs_due), off))[0]
    return bits[best]


def _chunk(seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "turn", "size", "p", "seq"], kind="stable").reset_index(drop=True)
        size, p = pdf["size"].to_numpy(float), pdf["p"].to_numpy(float)
        last = bool(pdf["last"].iat[0])
        words_due, docs_due = float(p @ size), float(p.sum())
        p = fly(p, size, _draw(seed, pdf["key"].to_numpy(np.int64).view(np.uint64) + np.arange(len(pdf), dtype=np.uint64)))
        if last:
            left = np.nonzero((p > EPS) & (p < 1 - EPS))[0]
            fixed = np.ones(len(p), bool)
            fixed[left] = False
            p[left] = land(p[left], size[left], words_due - float(p[fixed] @ size[fixed]), docs_due - float(p[fixed].sum()))
        return pdf.drop(columns="chunk").assign(p=p)

    return run


def _turns(units: DataFrame) -> DataFrame:
    """units with `turn`: 0, 1, ... among those of one key. Counted by place first, so that no task holds a key's units of more than one place."""
    placed = units.withColumn("__place", F.shiftright("seq", 33))  # the partition that monotonically_increasing_id gave the row
    counts = placed.groupBy("key", "__place").count().select(F.col("key").alias("__k"), F.col("__place").alias("__p"), "count")
    before = F.coalesce(F.sum("count").over(Window.partitionBy("__k").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    several = counts.withColumn("__before", before).where("count > 1 or __before > 0")
    here = F.row_number().over(Window.partitionBy("key", "__place").orderBy("seq")) - 1
    both = placed.withColumn("__here", here).join(several, (F.col("key") == F.col("__k")) & (F.col("__place") == F.col("__p")), "left")
    return both.withColumn("turn", (F.col("__here") + F.coalesce("__before", F.lit(0))).cast("long")).select(*units.columns, "turn")


def balanced(units: DataFrame, seed: int = 42, chunk: int = CHUNK) -> DataFrame:
    """units (seq, stratum, key, size, p) -> (seq, p) with each p 0 or 1, balanced on number and size by stratum.

    stratum, seq and key are longs, seq unique. Chunks of a stratum are dealt by
    a hash of the key and of the unit's turn among those of its key, so that a stratum of
    any size spreads over tasks, and so do units that are all alike.
    """
    schema = "seq long, stratum long, key long, turn long, size long, p double, last boolean"
    done: DataFrame | None = None
    level = 0
    while True:
        n = units.groupBy("stratum").count()
        n = n.select(F.col("stratum").alias("__s"), F.ceil(F.col("count") / chunk).alias("chunks"))
        most = n.agg(F.max("chunks")).first()[0] or 0
        if not most:
            break
        if not level:
            units = materialise(_turns(units), "mix-turns")
        # strata are one row each: joined to their units without gathering these
        dealt = join_unique(units, materialise(n, "mix-chunks"), "stratum", "__s").withColumn("chunk", F.pmod(F.xxhash64("key", "turn", F.lit(seed + level)), F.col("chunks")))
        dealt = dealt.withColumn("last", F.col("chunks") == 1)
        flown = dealt.select("seq", "stratum", "key", "turn", "size", "p", "last", "chunk").groupBy("stratum", "chunk")
        flown = materialise(flown.applyInPandas(_chunk(seed + level), schema), "mix-flight")
        fixed = flown.where(f"p <= {EPS} or p >= {1 - EPS}").select("seq", "p")
        done = fixed if done is None else done.unionByName(fixed)
        if most == 1:
            break
        units = flown.where(f"p > {EPS} and p < {1 - EPS}").drop("last")
        level += 1
    return done if done is not None else units.select("seq", "p")


def mix_counts(docs: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """One row for each row of docs: doc_id, source, text_hash, size, source_size, target, copies.

    size is the number of words of the text (null: 0), copies how often the mix
    takes the document: floor or ceiling of target / source_size, so at most
    `most`. Documents without words are taken as often as others, at no cost.
    Repeated rows are units of their own; since they are equal, which of them is
    taken more often is no difference. Reruns give the same copies for the same
    rows. A source without words has target 0. An empty table gives an empty result.
    """
    # numbers the rows for the way back; written once, so that they stay
    base = materialise(_units(docs).withColumn("seq", F.monotonically_increasing_id()), "mix-units")
    return _counted(base, weights, share, most, seed).drop("seq")


def _units(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select("doc_id", "source", F.xxhash64("doc_id", "text").alias("key"), n_words("text").alias("size"), *more)


def _stratum():
    """A source as a long; no source has the stratum of null."""
    return F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull())


def _counted(base: DataFrame, weights: Sequence[float], share: float, most: float, seed: int) -> DataFrame:
    """base (seq, doc_id, source, key, size), written already, with source_size, target and copies."""
    named = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    named = materialise(named.select(_stratum().alias("__stratum"), "source_size", "target"), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wanted = join_unique(base.withColumn("stratum", _stratum()), named, "stratum", "__stratum").drop("__stratum")
    whole = F.floor(rate + EPS)
    part = F.when(rate - whole > EPS, rate - whole).otherwise(0.0)
    wanted = materialise(wanted.withColumn("whole", whole.cast("long")).withColumn("p", part), "mix-wanted")
    drawn = balanced(wanted.where("p > 0").select("seq", "stratum", "key", "size", "p"), seed)
    drawn = drawn.select(F.col("seq").alias("__seq"), F.col("p").cast("long").alias("extra"))
    out = wanted.join(drawn, wanted["seq"] == F.col("__seq"), "left")
    copies = F.col("whole") + F.coalesce("extra", F.lit(0).cast("long"))
    return out.select("seq", "doc_id", "source", F.col("key").alias("text_hash"), "size", "source_size", "target", copies.alias("copies"))


def take_mix(docs: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """docs as the mix takes them: rows not taken go, a row taken twice comes twice. Columns are those of docs.

    The rows are written once with a number of their own, by which their copies
    are joined back: a key that no two rows share, however often a row repeats.
    Null and empty texts are taken as often as others, long ones count whole, columns keep their names,
    whatever these are. An empty table gives an empty one.
    """
    docs, back = shielded(docs, ["doc_id", "source", "text"])
    whole = materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "mix-rows")
    base = materialise(_units(whole, "__row").withColumnRenamed("__row", "seq"), "mix-units")
    counts = _counted(base, weights, share, most, seed).where("copies > 0").select(F.col("seq").alias("__seq"), F.col("copies").alias("__copies"))
    taken = whole.join(counts, F.col("__row") == F.col("__seq"))
    taken = taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return taken.select(*back(taken))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix_counts() of the whole table `documents`; null and empty texts, ties, repeated rows and an empty table as there."""
    found = mix_counts(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
