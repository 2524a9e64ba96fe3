"""SimHash near-duplicate classes by anchor-point covering.

Fingerprints of 64 bits link at `threshold` or fewer differing bits. The bits
are cut into bands; by the pigeonhole principle a linked pair differs in at most
`threshold // bands` bits of some band. Each band has a covering code: the
[15, 11] Hamming code on its first 15 bits (covering radius 1, perfect) and every
pattern on the other bits. A fingerprint's home is the code word nearest to it,
and it is replicated to every code word (anchor) within covering radius plus
threshold that can be the home of a linked one. Homes and replicas of an anchor
are compared there; of the links found only a forest leaves, so that a dense cluster
costs its rows and not its pairs. Documents of one fingerprint are one class throughout, so
copies are never expanded to pairs; the links are between different fingerprints.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_unique, mapped, materialise, shielded, table
from .components import connected_components, contract

SEED = 42
#: Bits given to the Hamming code of each band, and its number of check bits.
CODE_BITS, CHECK_BITS = 15, 4


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash of one text; 0 for a text without words.

    A-Z are lower-cased; words are runs of anything but ASCII white space; a
    text of fewer than `shingle` words is one shingle; repeats count.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII only, both for case and for space
    if not found:
        return 0
    digest, line = xxhash.xxh64_intdigest, b" ".join(found)
    if len(found) <= shingle:
        hashes = [digest(line, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts[: len(found) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):  # bounded memory for very long texts
        block = np.array(hashes[at : at + 65536], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, keep: Sequence[str] = ("doc_id",), name: str = "fp") -> DataFrame:
    """The columns `keep` and `name` for every row; the latter is the fingerprint as a signed long."""

    def make():
        def run(texts: list) -> tuple:
            return (np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64),)

        return run

    return mapped(docs, [*keep], ["text"], make, {name: ("long", pa.int64())})


def _bands(bands: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of each band; the last take what is left over."""
    edges = [64 * i // bands for i in range(bands + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _syndromes(code: np.ndarray) -> np.ndarray:
    """Syndrome of 15-bit words: the xor of the (1-based) positions of their ones."""
    out = np.zeros(len(code), np.int64)
    for i in range(CODE_BITS):
        out ^= np.where((code >> i) & 1, i + 1, 0)
    return out


def anchors(fps: np.ndarray, bands: int, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (index into fps, anchor key, is home) for the home and all replicas of each fingerprint.

    For `slack` bits of a band in which a linked pair may differ, a replica goes
    to each code word that some fingerprint within `slack` of this one has as home.
    """
    slack = threshold // bands
    index, keys, homes = [], [], []
    u = fps.view(np.uint64)
    for band, (first, width) in enumerate(_bands(bands)):
        bits = ((u >> np.uint64(first)) & np.uint64((1 << width) - 1)).astype(np.int64)
        layer = [bits]  # all patterns within slack of it, each tagged by the last bit flipped to list every one once
        frontier = [(bits, -1)]
        for _ in range(slack):
            frontier = [(b ^ (1 << i), i) for b, last in frontier for i in range(last + 1, width)]
            layer += [b for b, _ in frontier]
        every = np.stack(layer, 1)
        code, rest = every & ((1 << CODE_BITS) - 1), every >> CODE_BITS
        s = _syndromes(code.ravel()).reshape(code.shape)
        word = code ^ np.where(s > 0, 1 << np.maximum(s - 1, 0), 0)  # nearest code word: perfect code, so unique
        key = (np.int64(band) << 40) | (rest << CODE_BITS) | word
        index.append(np.arange(len(fps)))
        keys.append(key[:, 0])
        homes.append(np.ones(len(fps), bool))
        ordered = np.sort(key, 1)
        fresh = np.concatenate((np.ones((len(fps), 1), bool), ordered[:, 1:] != ordered[:, :-1]), 1)
        rows, _ = np.nonzero(fresh)
        index.append(rows)
        keys.append(ordered[fresh])
        homes.append(np.zeros(len(rows), bool))
    return np.concatenate(index), np.concatenate(keys), np.concatenate(homes)


def replicas(bands: int, threshold: int) -> tuple[float, float]:
    """(replicas of a fingerprint, share of all evenly spread fingerprints that it is compared with), over all bands: means of a few."""
    some = np.random.default_rng(1).integers(-(2**63), 2**63, 256)
    _, keys, home = anchors(some, bands, threshold)
    made = np.bincount((keys[~home] >> 40).astype(int), minlength=bands) / len(some)
    return float(made.sum()), float(sum(n / 2.0 ** (width - CHECK_BITS) for n, (_, width) in zip(made, _bands(bands))))


def planned_bands(distinct: int, threshold: int = 4) -> int:
    """How many bands cost least for so many different fingerprints: replicas to move (each as dear as 100 comparisons) and comparisons."""
    cost = {}
    for bands in range(2, threshold + 1):
        if 64 // bands >= CODE_BITS:
            made, share = replicas(bands, threshold)
            cost[bands] = 100.0 * made * distinct + share * distinct**2
    return min(cost, key=lambda bands: (cost[bands], -bands)) if cost else 1


#: Homes, and replicas, of an anchor that are compared in one place; an anchor of more is cut. Pairs held at a time.
TILE, PAIRS = 32_768, 2_000_000


def forest(homes: np.ndarray, visitors: np.ndarray, first: np.ndarray, last: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect what is linked: visitor i is compared with homes first[i] to last[i]. At most one link for each home and visitor."""
    root = np.arange(len(homes))
    tied = np.full(len(visitors), -1)  # a home that the visitor is linked to
    at = 0
    sizes = np.cumsum(last - first)
    while at < len(visitors):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PAIRS, side="right")))
        n = (last - first)[at:end]
        v = np.repeat(np.arange(at, end), n)
        h = np.arange(len(v)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at:end], n)
        apart = np.bitwise_count(homes[h].view(np.uint64) ^ visitors[v].view(np.uint64))
        near = (apart <= threshold) & (apart > 0)
        v, h = v[near], h[near]
        while len(v):  # homes that a visitor links take their least root, until none changes
            least = np.full(end - at, len(homes))
            own = root[h]
            np.minimum.at(least, v - at, own)
            new = least[v - at]
            if (new == own).all():
                tied[v] = new
                break
            np.minimum.at(root, own, new)
            np.minimum.at(root, h, new)
            while (root[root] != root).any():
                root = root[root]
        at = end
    moved = np.nonzero(root != np.arange(len(homes)))[0]
    seen = np.nonzero(tied >= 0)[0]
    a = np.concatenate((homes[root[moved]], homes[root[tied[seen]]]))
    b = np.concatenate((homes[moved], visitors[seen]))
    differ = a != b
    return np.minimum(a, b)[differ], np.maximum(a, b)[differ]


def _near(threshold: int):
    """Task that compares rows (anchor, p, q, fp, home) sorted by anchor, p, q and homes first."""

    def found(pdf: pd.DataFrame, edges: np.ndarray) -> pd.DataFrame:
        fps, home = pdf["fp"].to_numpy(np.int64), pdf["home"].to_numpy(bool)
        group = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        counts = np.bincount(group[home], minlength=len(edges) - 1)
        ends = np.cumsum(counts)
        a, b = forest(fps[home], fps[~home], (ends - counts)[group[~home]], ends[group[~home]], threshold)
        return pd.DataFrame({"a": a, "b": b})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n = 0
        for pdf in batches:
            held.append(pdf)
            n += len(pdf)
            if n < 4 * TILE:
                continue
            whole = pd.concat(held, ignore_index=True)
            key = whole[["anchor", "p", "q"]].to_numpy(np.int64)
            starts = np.concatenate(([0], np.nonzero((key[1:] != key[:-1]).any(1))[0] + 1))
            if len(starts) > 1:  # the last group may go on
                yield found(whole.iloc[: starts[-1]], starts)
                held = [whole.iloc[starts[-1] :]]
            else:
                held = [whole]
            n = len(held[0])
        if held:
            whole = pd.concat(held, ignore_index=True)
            if len(whole):
                key = whole[["anchor", "p", "q"]].to_numpy(np.int64)
                starts = np.concatenate(([0], np.nonzero((key[1:] != key[:-1]).any(1))[0] + 1, [len(whole)]))
                yield found(whole, starts)

    return run


def links(distinct: DataFrame, threshold: int = 4, bands: int | None = None, then: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] | None = None) -> DataFrame:
    """(a, b) with a < b: links between different fingerprints at `threshold` or fewer bits, enough to connect all that are linked.

    Each anchor's homes and replicas meet in one place, where a forest of their links
    is made: at most one link a row. An anchor of more than TILE homes or replicas is cut into tiles,
    each share of its homes meeting each share of its replicas; such anchors are at most all rows
    divided by TILE, and so may be broadcast. bands only decide the cost (planned_bands, if not given).
    then: what a task's links go through before they leave its worker.
    """
    if bands is None:
        bands = planned_bands(distinct.count(), threshold)
    if 64 // bands < CODE_BITS:
        raise ValueError(f"bands of {64 // bands} bits are shorter than the code's {CODE_BITS}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = pdf["fp"].to_numpy(np.int64)
            for at in range(0, len(fps), 4_000):
                part = fps[at : at + 4_000]
                i, key, home = anchors(part, bands, threshold)
                yield pd.DataFrame({"anchor": key, "fp": part[i], "home": home})

    placed = materialise(distinct.select("fp").mapInPandas(run, "anchor long, fp long, home boolean"), "anchors")
    # anchors that may be hot show in a share of the fingerprints, and only these are counted: one that is overlooked is held whole by its task
    share = max(1, TILE // 512)
    seen = placed.where(F.pmod(F.xxhash64("fp", F.lit(5)), F.lit(share)) == 0).groupBy(F.col("anchor").alias("__seen")).count().where(F.col("count") >= TILE // (2 * share))
    few = placed.join(F.broadcast(materialise(seen.select("__seen"), "seen-anchors")), F.col("anchor") == F.col("__seen"), "left_semi")
    count = few.groupBy("anchor").agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("v"))
    parts = lambda c: F.ceil(F.col(c) / TILE).cast("int")
    hot = count.where((F.col("h") > TILE) | (F.col("v") > TILE)).where("h > 0").select(F.col("anchor").alias("__hot"), parts("h").alias("hp"), parts("v").alias("vp"))
    hot = F.broadcast(materialise(hot, "hot-anchors"))
    both = placed.join(hot, placed["anchor"] == F.col("__hot"), "left")
    own = lambda c: F.pmod(F.xxhash64("fp"), F.col(c)).cast("int")
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    # which tiles (p of the homes, q of the replicas) a row is in: its own share, and each of the other side's
    p = F.when(F.col("__hot").isNull(), F.array(F.lit(0))).when(F.col("home"), F.array(own("hp"))).otherwise(every("hp"))
    q = F.when(F.col("__hot").isNull(), F.array(F.lit(0))).when(F.col("home"), every("vp")).otherwise(F.array(own("vp")))
    tiles = both.select("anchor", F.explode(p).alias("p"), q.alias("qs"), "fp", "home").select("anchor", "p", F.explode("qs").alias("q"), "fp", "home")
    dealt = tiles.repartition("anchor", "p", "q").sortWithinPartitions("anchor", "p", "q", F.desc("home"))
    near = _near(threshold)
    return dealt.mapInPandas((lambda batches: then(near(batches))) if then else near, "a long, b long")


def simhash_classes(docs: DataFrame, threshold: int = 4, shingle: int = 4, bands: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id, root) for each row of docs; component_id is the smallest doc_id reachable.

    Null texts, empty texts and texts of white space only have fingerprint 0 and
    are linked like any other. A null doc_id is never a component_id unless all of
    a component's are null. Repeated rows stay repeated. Other columns are ignored.
    An empty table gives an empty result.
    """
    rows = materialise(fingerprints(docs, shingle), "simhash")
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    found = connected_components(links(distinct, threshold, bands, contract), contracted=True)  # (node, root) of linked fingerprints only
    named = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = materialise(named, "simhash-roots")
    least = materialise(named.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "__root"), "simhash-least")
    classes = join_unique(named, least, "root", "__root").select(F.col("fp").alias("class_fp"), "component_id", "root")
    # many copies have one fingerprint, and many fingerprints one root: neither gathers in a task
    return join_unique(rows, materialise(classes, "simhash-classes"), "fp", "class_fp").select("doc_id", "fp", "component_id", "root")


def keep_one(docs: DataFrame, threshold: int = 4) -> DataFrame:
    """docs with one row of each near-duplicate class: that of its smallest doc_id.

    Rows that repeat that doc_id are reduced to one too. Rows of null doc_id go
    where their class has another; a class with null ids only keeps one row.
    Null and empty texts, and those of white space, are one class; long texts count
    whole. Columns are those of docs, whatever their names; an empty table stays empty.
    """
    docs, back = shielded(docs, ["doc_id", "text"])
    columns = docs.columns
    classes = materialise(simhash_classes(docs, threshold), "simhash-kept")
    kept = classes.where("doc_id = component_id").groupBy("doc_id").count().select(F.col("doc_id").alias("__keep_id"), F.col("count").alias("__n"))
    kept = materialise(kept, "simhash-ids")
    by_id = docs["doc_id"] == F.col("__keep_id")
    once = docs.join(kept.where("__n = 1").hint("merge"), by_id, "left_semi")
    repeated = docs.join(kept.where("__n > 1"), by_id, "left_semi").dropDuplicates(["doc_id"])
    # classes without any id are found again by a fingerprint of theirs
    nameless = classes.where("component_id is null").groupBy("root").agg(F.min("fp").alias("__keep_fp")).select("__keep_fp")
    # mapped, for the planner would put a UDF into a task more than once, each with a worker of its own
    unnamed = fingerprints(docs.where("doc_id is null"), keep=columns, name="__fp")
    unnamed = unnamed.join(nameless, F.col("__fp") == F.col("__keep_fp"), "left_semi").dropDuplicates(["__fp"])
    out = once.select(*columns).unionByName(repeated.select(*columns)).unionByName(unnamed.select(*columns))
    return out.select(*back(out))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """simhash_classes() of the whole table `documents`; nulls, empty and long texts, repeated rows and an empty table as there."""
    found = simhash_classes(table(spark, sf_dir, "documents"), threshold=4, shingle=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
