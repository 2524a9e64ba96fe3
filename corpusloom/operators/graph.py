"""Co-occurrence statistics: pair counts, PMI edges, conserved edges, permutation nulls, holdout tests, communities.

The relation is `sets`: one row for each (group, record, item), distinct. Pair
generation is a self-join on the record, whose sets are small; everything after
is aggregation with map-side partial sums. Permutations are one column, so a null
of 200 is a job and not a loop.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .permutations import dealt, round_keys
from .ranges import numbered, numbered_within


def item_sets(df: DataFrame, group: str, record: str, item: str) -> DataFrame:
    """Distinct (group, record, item) without nulls, so that records with empty sets don't count."""
    named = df.select(F.col(group).alias("group"), F.col(record).alias("record"), F.col(item).alias("item"))
    return named.na.drop().distinct()


def pairs_of(items: Column) -> Column:
    """All unordered pairs a < b of an array, as structs."""
    s = F.array_sort(F.array_distinct(items))
    return F.flatten(F.transform(s, lambda a, i: F.transform(F.slice(s, i + 2, F.size(s)), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def pair_counts(sets: DataFrame, by: tuple[str, ...] = ("group",)) -> DataFrame:
    """(by..., a, b, n_ab, n_a, n_b, n): co-occurrence counts within each group.

    One shuffle by record gathers each set (its size is that of one record);
    pairs and items are then exploded locally and summed with partial aggregation.
    """
    each = sets.groupBy(*by, "record").agg(F.collect_set("item").alias("items"))
    ones = each.select(*by, F.explode("items").alias("item")).groupBy(*by, "item").agg(F.count(F.lit(1)).alias("n_item"))
    both = each.select(*by, F.explode(pairs_of(F.col("items"))).alias("p")).groupBy(*by, "p.a", "p.b").agg(F.count(F.lit(1)).alias("n_ab"))
    total = each.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    a = ones.select(*[F.col(c).alias(f"__a_{c}") for c in by], F.col("item").alias("__a"), F.col("n_item").alias("n_a"))
    b = ones.select(*[F.col(c).alias(f"__b_{c}") for c in by], F.col("item").alias("__b"), F.col("n_item").alias("n_b"))
    t = total.select(*[F.col(c).alias(f"__t_{c}") for c in by], "n")
    same = lambda p: [F.col(c) == F.col(f"{p}_{c}") for c in by]
    out = both.join(a, [*same("__a"), F.col("a") == F.col("__a")]).join(b, [*same("__b"), F.col("b") == F.col("__b")]).join(t, same("__t"))
    return out.select(*by, "a", "b", "n_ab", "n_a", "n_b", "n")


def pmi_edges(counts: DataFrame, min_pair: int | Column = 3, min_records: int = 20) -> DataFrame:
    """Pairs with positive pointwise mutual information. The sign is decided in integers, exactly; pmi is rounded to 4 places."""
    kept = counts.where((F.col("n_ab") >= min_pair) & (F.col("n") >= min_records) & (F.col("n_ab") * F.col("n") > F.col("n_a") * F.col("n_b")))
    return kept.withColumn("pmi", F.round(F.ln((F.col("n_ab") / F.col("n")) / ((F.col("n_a") / F.col("n")) * (F.col("n_b") / F.col("n")))), 4))


def conserved_edges(edges: DataFrame, min_groups: int | Column = 4, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., a, b, n_groups, groups, cooccurrence) of edges that are significant in min_groups groups or more."""
    out = edges.groupBy(*by, "a", "b").agg(
        F.count(F.lit(1)).alias("n_groups"), F.array_sort(F.collect_list("group")).alias("groups"), F.sum("n_ab").alias("cooccurrence")
    )
    return out.where(F.col("n_groups") >= min_groups)


#: Seats of a group that a task holds as codes (1 to 4 bytes each); seats of a larger one that a task holds together (about); numbers that a task permutes, and pairs that it holds, at once.
SEATS, SLICE, CELLS, PAIRS = 32_000_000, 500_000, 1_000_000, 4_000_000
#: Seats of a pack (about); items up to which sets are counted as bits, and pairs from which it pays; numbers that a task permutes in all (about), and tasks of a group at most.
PACK, ITEMS, FEW, WORK, TASKS = 250_000, 512, 5_000, 40_000_000, 16


def _seats(sets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(seats, groups, items), written: seats (g, seat from 0, rec, record, code) in the order of record and item within a group.

    rec is a record's first seat and names it; groups (g, __group, tokens, n) and items (code, __item) have
    numbers in the order of their names, so that a < b is the same in both.
    """
    items = numbered(sets.select("item").distinct(), ["item"], "code").select(F.col("item").alias("__item"), F.col("code").cast("int").alias("code")).checkpoint()
    groups = numbered(sets.groupBy("group").agg(F.count(F.lit(1)).alias("tokens"), F.count_distinct("record").alias("n")), ["group"], "g")
    groups = groups.select(F.col("group").alias("__group"), F.col("g").cast("int").alias("g"), "n", "tokens").checkpoint()
    seats = numbered_within(sets, ["group"], ["record", "item"], "seat").join(groups.drop("n", "tokens"), F.col("group") == F.col("__group")).join(items, F.col("item") == F.col("__item"))
    first = F.min("seat").over(Window.partitionBy("g", "record")) - 1  # a record's set is small
    return seats.select("g", (F.col("seat") - 1).alias("seat"), first.alias("rec"), "record", "code").checkpoint(), groups, items


def _blocks(n: int, spark) -> tuple[Column, int]:
    """Permutations 1 to n in blocks for as many tasks, and the size of a block: not more than a task's cells hold for short groups."""
    size = max(1, -(-n // int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return F.explode(F.sequence(F.lit(1), F.lit(n), F.lit(size))), size


def _tokens_dealt(seats: DataFrame, groups: DataFrame, n: int, seed: int) -> DataFrame:
    """(perm, g, seat, code): the seat that each token takes in each permutation, worked out where the token is."""
    block, size = _blocks(n, seats.sparkSession)
    rows = seats.join(groups.select(F.col("g").alias("__h"), F.col("__group").cast("string").alias("name"), "tokens"), F.col("g") == F.col("__h")).select("g", "name", "tokens", "seat", "code")
    rows = rows.withColumn("block", block).repartition("block", "g", F.floor(F.col("seat") / F.lit(SLICE))).sortWithinPartitions("block", "g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, tokens, seat, code, block = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("g", "tokens", "seat", "code", "block"))
            ends = [0, *(np.nonzero((np.diff(g) != 0) | (np.diff(block) != 0))[0] + 1).tolist(), len(g)]
            for x, y in zip(ends, ends[1:]):
                if x == y:
                    continue
                perms = np.arange(block[x], min(block[x] + size, n + 1))
                step = max(1, CELLS // (y - x))
                for at in range(0, len(perms), step):
                    own = perms[at : at + step]
                    to = dealt(seat[x:y], int(tokens[x]), [round_keys(seed, int(p), batch.column("name")[x].as_py()) for p in own], back=True)
                    columns = [np.repeat(own, y - x).astype(np.int32), np.full(to.size, g[x], np.int32), to.ravel(), np.tile(code[x:y], len(own)).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["perm", "g", "seat", "code"])

    return rows.mapInArrow(run, "perm int, g int, seat long, code int")


def permute(sets: DataFrame, n: int = 200, seed: int = 42, distinct: bool = True) -> DataFrame:
    """sets with `perm` from 1: within each group items are pooled, shuffled and dealt to records by their sizes.

    A shuffle is the bijection of permutations.dealt(), whose keys are from seed, permutation
    and group: the same on any number of partitions, and no group is sorted or seen by one task. A record
    may be dealt an item twice, which then counts once, so sets can shrink;
    distinct=False leaves repeats in, for callers that gather sets anyway.
    """
    seats, groups, items = _seats(sets)
    own = seats.select(F.col("g").alias("__g"), F.col("seat").alias("__s"), "record")
    out = _tokens_dealt(seats, groups, n, seed).join(own, (F.col("g") == F.col("__g")) & (F.col("seat") == F.col("__s")))
    out = out.join(groups.select(F.col("g").alias("__h"), F.col("__group").alias("group")), F.col("g") == F.col("__h"))
    out = out.join(items.select(F.col("code").alias("__c"), F.col("__item").alias("item")), F.col("code") == F.col("__c")).select("perm", "group", "record", "item")
    return out.distinct() if distinct else out


def permuted_counts(sets: DataFrame, n: int = 200, seed: int = 42) -> DataFrame:
    """(perm, group, a, b, n_ab, n_a, n_b, n): pair_counts() of permute(sets, n, seed), without the permuted sets as a table."""
    return _counts([(sets, n)], seed).where("perm > 0").drop("side")


def _counts(sides: Sequence[tuple[DataFrame, int]], seed: int) -> DataFrame:
    """(side, perm, group, a, b, n_ab, n_a, n_b, n): pair_counts() of each side's sets as perm 0, and of so many permutations of them.

    Sets are packed once, about a byte a seat. A task has a whole group as packs and counts some of its permutations alone,
    so nothing is moved or sorted for a permutation. Groups of more than SEATS seats, or of too many
    pairs for a task, go by _moved_counts().
    """
    packs = _packs([sets for sets, _ in sides])
    spark, key = packs.sparkSession, ["side", "group"]
    items = packs.select(*key, F.explode("items").alias("item")).distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("items"))
    groups = packs.groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("tokens", "pairs")]).join(items, key)
    groups = groups.withColumn("whole", (F.col("tokens") <= SEATS) & ((F.col("items") <= ITEMS) | (F.col("pairs") < PAIRS)))
    groups = groups.withColumn("perms", F.element_at(F.array(*[F.lit(n) for _, n in sides]), F.col("side") + 1))
    tasks = F.least(F.greatest(F.ceil(F.col("tokens") * (F.col("perms") + 1) / WORK), F.lit(1)), F.lit(TASKS))
    groups = groups.withColumn("size", F.ceil((F.col("perms") + 1) / tasks).cast("int")).checkpoint()
    seen = groups.agg(F.count_if(~F.col("whole")).alias("rest"), F.sum(F.ceil((F.col("perms") + 1) / F.col("size"))).alias("tasks")).first()
    own = packs.drop("pairs").join(groups.where("whole").select(*key, "perms", "size"), key)
    own = own.withColumn("name", F.col("group").cast("string")).withColumn("block", F.explode(F.sequence(F.lit(0), "perms", "size")))
    own = own.repartition(min(2 * (seen["tasks"] or 1), 4000), *key, "block").sortWithinPartitions(*key, "block", "part", "at")
    kind = {f.name: f.dataType for f in packs.schema}
    fields = [("side", T.IntegerType()), ("perm", T.IntegerType()), ("group", kind["group"]), *[(c, kind["items"].elementType) for c in "ab"], *[(c, T.LongType()) for c in ("n_ab", "n_a", "n_b", "n")]]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                if held and any(row.column(c)[0] != held[0].column(c)[0] for c in ("side", "group", "block")):
                    yield from _group_counts(held, seed)
                    held = []
                held.append(row)
        if held:
            yield from _group_counts(held, seed)

    out = own.mapInArrow(count, T.StructType([T.StructField(*f) for f in fields]))
    for i, (sets, n) in enumerate(sides if seen["rest"] else []):
        large = sets.join(groups.where((F.col("side") == i) & ~F.col("whole")).select("group"), "group", "left_semi")
        out = out.unionByName(pair_counts(large).withColumns({"side": F.lit(i), "perm": F.lit(0)}))
        if n:
            out = out.unionByName(_moved_counts(large, n, seed).withColumn("side", F.lit(i)))
    return out


def _packs(sides: Sequence[DataFrame]) -> DataFrame:
    """(side, group, part, at, tokens, records, pairs, items, codes, lengths), written: the sets in the order of group, record and item.

    A row has whole records of a group: their sizes, and each token as its place among the row's own items; part and at give the rows' order.
    """
    every = reduce(DataFrame.unionByName, [x.select(F.lit(i).alias("side"), "group", "record", "item") for i, x in enumerate(sides)])
    parts = int(every.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = every.repartitionByRange(parts, "side", "group", "record").sortWithinPartitions("side", "group", "record", "item").withColumn("part", F.spark_partition_id())
    long, binary = T.LongType(), T.BinaryType()
    fields = [("side", T.IntegerType()), ("group", every.schema["group"].dataType), ("part", T.IntegerType()), ("at", long), ("tokens", long), ("records", long), ("pairs", long)]
    fields += [("items", T.ArrayType(every.schema["item"].dataType)), ("codes", binary), ("lengths", binary)]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = 0
        for batch in _and_end(batches):
            held += [batch] if batch is not None else []
            if not (n := sum(x.num_rows for x in held)) or batch is not None and n < PACK:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            group = _changes(whole, "side") | _changes(whole, "group")
            record = group | _changes(whole, "record")
            end = n if batch is None else int(np.nonzero(record)[0][-1])  # the last record may go on
            held = [whole.slice(end)] if end < n else []
            starts = np.nonzero(group[:end])[0]
            if not len(starts):
                continue
            columns: list[list] = [[] for _ in range(6)]
            for x, y in zip(starts.tolist(), [*starts[1:].tolist(), end]):
                lengths = np.diff(np.nonzero(np.append(record[x:y], True))[0])
                item = whole.column("item").slice(x, y - x).dictionary_encode()
                codes = item.indices.to_numpy()
                for column, value in zip(columns, (y - x, len(lengths), int((lengths * (lengths + 1) // 2).sum()), item.dictionary, _bytes(codes), _bytes(lengths))):
                    column.append(value)
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in columns[3]]))).astype(np.int32)
            columns[3] = pa.ListArray.from_arrays(offsets, pa.concat_arrays(columns[3]))
            named = [*whole.select(["side", "group", "part"]).take(pa.array(starts)).columns, pa.array(range(at, at + len(starts)), pa.int64()), *map(pa.array, columns[:3]), columns[3], *[pa.array(x, pa.binary()) for x in columns[4:]]]
            at += len(starts)
            yield pa.RecordBatch.from_arrays(named, names=[f[0] for f in fields])

    return rows.mapInArrow(pack, T.StructType([T.StructField(*f) for f in fields])).checkpoint()


def _and_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _changes(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """Whether each row differs from the one before it; the first does."""
    column = batch.column(name)
    return np.append(True, pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False))[: len(column)].astype(bool)


def _bytes(x: np.ndarray) -> bytes:
    """Whole numbers from 0 below 2^32 in 1, 2 or 4 bytes each."""
    return x.astype(_least(int(x.max(initial=0)))).tobytes()


def _least(most: int) -> type:
    return next(t for t in (np.uint8, np.uint16, np.uint32) if most <= np.iinfo(t).max)


def _numbers(row: pa.RecordBatch, name: str, n: str) -> np.ndarray:
    data = row.column(name)[0].as_py()
    return np.frombuffer(data, f"u{len(data) // row.column(n)[0].as_py()}")


def _group_counts(packs: list[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """The counts of a block of permutations from all packs of a group."""
    row = packs[0]
    first, size, perms, name = (row.column(c)[0].as_py() for c in ("block", "size", "perms", "name"))
    local = [p.column("items")[0].values for p in packs]
    names = pa.concat_arrays(local).unique()
    names = names.take(pc.sort_indices(names))
    place = [pc.index_in(x, value_set=names).to_numpy(zero_copy_only=False).astype(_least(len(names))) for x in local]
    codes = np.concatenate([x[_numbers(p, "codes", "tokens")] for x, p in zip(place, packs)])
    lengths = np.concatenate([_numbers(p, "lengths", "records").astype(np.uint32) for p in packs])
    own = list(range(first, min(first + size, perms + 1)))
    pairs = int((lengths.astype(np.int64) * (lengths + np.int64(1)) // 2).sum())

    def keys(some: list[int]) -> list:
        return [round_keys(seed, p, name) for p in some]

    def batch(perm: np.ndarray, a: np.ndarray, b: np.ndarray, k: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(np.full(len(a), row.column("side")[0].as_py(), np.int32)), pa.array(perm.astype(np.int32)), row.column("group").take(pa.array(np.zeros(len(a), np.int64)))]
        columns += [names.take(pa.array(x.astype(np.int64))) for x in (a, b)] + [pa.array(x.astype(np.int64)) for x in (k, n_a, n_b, np.full(len(a), len(lengths)))]
        return pa.RecordBatch.from_arrays(columns, names=["side", "perm", "group", "a", "b", "n_ab", "n_a", "n_b", "n"])

    if len(names) <= ITEMS and pairs > FEW:
        for p in own:
            k = _bit_sums(codes, lengths, len(names), keys([p])[0] if p else None)
            a, b = np.nonzero(np.triu(k, 1))
            yield batch(np.full(len(a), p), a, b, k[a, b], k[a, a], k[b, b])
        return
    step = max(1, min(CELLS // len(codes), (PAIRS - 1) // pairs))
    rec = np.repeat(np.arange(len(lengths)), lengths)
    for at in range(0, len(own), step):
        some = own[at : at + step]
        to = dealt(np.arange(len(codes)), len(codes), keys([p for p in some if p]))
        code = np.concatenate([codes[None]] * (some[0] == 0) + [codes[to]])
        for unit, a, b, k in _pair_sums(np.repeat(np.arange(len(some)), len(codes)), np.tile(rec, len(some)), code.ravel()):  # one part: there are fewer than PAIRS
            ones = np.zeros((len(some), len(names)), np.int64)
            ones[unit[a == b], a[a == b]] = k[a == b]
            unit, a, b, k = (x[a != b] for x in (unit, a, b, k))
            yield batch(np.array(some)[unit], a, b, k, ones[unit, a], ones[unit, b])


def _bit_sums(codes: np.ndarray, lengths: np.ndarray, items: int, key: list[tuple[int, int]] | None) -> np.ndarray:
    """In how many records the items a <= b are, a matrix, after the permutation of a key: each item's records as bits, some thousand records at a time."""
    ends = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
    out, most, r = np.zeros((items, items), np.int64), max(64, min(16_384, 2**21 // items)), 0
    while r < len(lengths):
        to = min(r + most, len(lengths))
        x, y, width = int(ends[r]), int(ends[to]), -(-(to - r) // 64) * 64
        code = codes[x:y] if key is None else codes[dealt(np.arange(x, y), len(codes), [key])[0]]
        bits = np.zeros(items * width, bool)
        bits[code.astype(np.int64) * width + np.repeat(np.arange(to - r), lengths[r:to])] = True  # an item that a record was dealt twice counts once
        words = np.packbits(bits.reshape(items, width), axis=1).view(np.uint64)
        for a in range(items):
            out[a, a:] += np.bitwise_count(words[a] & words[a:]).sum(1, dtype=np.int64)
        r = to
    return out


def _moved_counts(sets: DataFrame, n: int, seed: int) -> DataFrame:
    """permuted_counts() of groups of any size: tokens go to the task of their seat's record, so each permutation is moved once. No permutation is sorted."""
    seats, groups, items = _seats(sets)
    schema = "perm int, g int, a int, b int, k long"
    chairs = seats.select(F.col("g").alias("__cg"), F.col("seat").alias("__seat"), "rec")
    seated = _tokens_dealt(seats, groups, n, seed).join(chairs, (F.col("g") == F.col("__cg")) & (F.col("seat") == F.col("__seat"))).select("perm", "g", "rec", "code")
    seated = seated.repartition("perm", "g", F.floor(F.col("rec") / F.lit(SLICE))).sortWithinPartitions("perm", "g", "rec")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for perm, g, rec, code in _whole_records(batches, ["perm", "g", "rec", "code"]):
            unit = np.concatenate(([0], np.cumsum((np.diff(perm) != 0) | (np.diff(g) != 0))))
            first = np.concatenate(([0], np.nonzero(np.diff(unit))[0] + 1))
            for own, a, b, k in _pair_sums(unit, rec, code):
                yield _sums(perm[first[own]], g[first[own]], a, b, k)

    summed = seated.mapInArrow(count, schema)
    summed = summed.groupBy("perm", "g", "a", "b").agg(F.sum("k").alias("k")).checkpoint()
    ones = summed.where("a = b").select(F.col("perm").alias("__p"), F.col("g").alias("__h"), F.col("a").alias("__i"), F.col("k").alias("__k"))
    both = summed.where("a < b").withColumnRenamed("k", "n_ab")
    for side in "ab":
        one = ones.select("__p", "__h", "__i", F.col("__k").alias(f"n_{side}"))
        both = both.join(one, (F.col("perm") == F.col("__p")) & (F.col("g") == F.col("__h")) & (F.col(side) == F.col("__i"))).drop("__p", "__h", "__i")
    both = both.join(groups.select(F.col("g").alias("__h"), F.col("__group").alias("group"), "n"), F.col("g") == F.col("__h"))
    for side in "ab":
        name = items.select(F.col("code").alias("__c"), F.col("__item").alias(f"__{side}"))
        both = both.join(name, F.col(side) == F.col("__c")).drop("__c")
    return both.select("perm", "group", F.col("__a").alias("a"), F.col("__b").alias("b"), "n_ab", "n_a", "n_b", "n")


#: Rows that _whole_records gathers before it passes them on.
_ROWS = 200_000


def _whole_records(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[np.ndarray]:
    """Columns of about _ROWS sorted rows at a time, never with a part of a record: the first three columns name one."""
    held: list[np.ndarray] = []
    for batch in batches:
        held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]))
        if sum(x.shape[1] for x in held) >= _ROWS:
            whole = np.concatenate(held, 1)
            ends = np.nonzero((whole[:3, 1:] != whole[:3, :-1]).any(0))[0] + 1
            if len(ends):  # the last record may go on
                yield whole[:, : ends[-1]]
                whole = whole[:, ends[-1] :]
            held = [whole]
    if held:
        whole = np.concatenate(held, 1)
        if whole.shape[1]:
            yield whole


def _sums(perm: np.ndarray, g: np.ndarray, a: np.ndarray, b: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
    columns = [perm.astype(np.int32), g.astype(np.int32), a.astype(np.int32), b.astype(np.int32), k.astype(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["perm", "g", "a", "b", "k"])


def _pair_sums(unit: np.ndarray, rec: np.ndarray, code: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(unit, a, b, k): in how many records of a unit the items a <= b are; a = b counts records with the item. Rows in any order.

    Items, and records, are numbered anew within the rows, so that no key passes 2^63; pairs are made by their
    distance in a record's sorted set and summed whenever PAIRS of them are held, so a record of any size needs no more.
    """
    names, item = np.unique(code, return_inverse=True)
    c = len(names)
    order = np.lexsort((item, rec, unit))
    unit, rec, item = unit[order], rec[order], item[order]
    new = np.concatenate(([True], (np.diff(unit) != 0) | (np.diff(rec) != 0)))
    fresh = new | np.concatenate(([True], np.diff(item) != 0))  # an item that a record was dealt twice counts once
    group = np.cumsum(new)[fresh]
    unit, item = unit[fresh], item[fresh].astype(np.int64)
    place = np.arange(len(item)) - np.concatenate(([0], np.nonzero(np.diff(group))[0] + 1))[group - 1]
    held: list[np.ndarray] = []

    def summed() -> tuple[np.ndarray, ...]:
        i, j = (np.concatenate([h[s] for h in held]) for s in (0, 1))
        held.clear()
        if (int(unit.max()) + 1) * c * c < 2**63:
            key, k = np.unique((unit[i] * c + item[i]) * c + item[j], return_counts=True)
            return key // (c * c), names[key // c % c], names[key % c], k
        rows, k = np.unique(np.stack((unit[i], item[i], item[j])), axis=1, return_counts=True)
        return rows[0], names[rows[1]], names[rows[2]], k

    for gap in range(int(place.max(initial=-1)) + 1):
        later = np.nonzero(place >= gap)[0]
        held.append(np.stack((later - gap, later)))
        if sum(h.shape[1] for h in held) >= PAIRS:
            yield summed()
    if held:
        yield summed()


def null_model(sets: DataFrame, n: int = 200, seed: int = 42, min_pair: int = 3, min_records: int = 20, min_groups: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conserved edges (a, b, n_groups, cooccurrence) as observed, and (perm, a, b, n_groups) of each permutation. The sets are read once; the edges are written."""
    significant = pmi_edges(_counts([(sets, n)], seed), min_pair, min_records)
    edges = conserved_edges(significant, min_groups, ("perm",)).drop("groups").checkpoint()
    return edges.where("perm = 0").drop("perm"), edges.where("perm > 0").drop("cooccurrence")


def null_counts(sets: DataFrame, n: int = 200, seed: int = 42, min_pair: int = 3, min_records: int = 20, min_groups: int = 4) -> DataFrame:
    """Conserved edges (perm, a, b, n_groups) of each permutation."""
    return null_model(sets, n, seed, min_pair, min_records, min_groups)[1]


def null_summary(observed: DataFrame, null: DataFrame, n: int) -> DataFrame:
    """One row: observed count, null mean, population deviation, maximum, z (null if it is 0) and p = (#{null >= observed} + 1) / (n + 1)."""
    spark = observed.sparkSession
    seen = observed.agg(F.count(F.lit(1)).alias("observed"))
    per = null.groupBy("perm").agg(F.count(F.lit(1)).alias("k"))
    every = spark.range(1, n + 1).select(F.col("id").alias("__perm")).join(per, F.col("__perm") == per["perm"], "left").select(F.coalesce("k", F.lit(0)).alias("k"))
    both = every.join(F.broadcast(seen))  # one row
    out = both.groupBy("observed").agg(F.avg("k").alias("mean"), F.stddev_pop("k").alias("sd"), F.max("k").alias("most"), F.count_if(F.col("k") >= F.col("observed")).alias("hits"))
    return out.select(
        "observed", F.round("mean", 2).alias("null_mean"), F.round("sd", 2).alias("null_sd"), F.col("most").alias("null_max"),
        F.when(F.col("sd") > 0, F.round((F.col("observed") - F.col("mean")) / F.col("sd"), 2)).alias("z"), F.round((F.col("hits") + 1) / F.lit(n + 1), 5).alias("p"),
    )


def edge_hit_rate(observed: DataFrame, null: DataFrame, n: int) -> DataFrame:
    """observed edges with the share of permutations in which they are conserved too."""
    hits = null.groupBy(F.col("a").alias("__a"), F.col("b").alias("__b")).agg(F.count(F.lit(1)).alias("hits"))
    both = observed.join(hits, (F.col("a") == F.col("__a")) & (F.col("b") == F.col("__b")), "left")
    return both.select("a", "b", "n_groups", "cooccurrence", F.round(F.coalesce("hits", F.lit(0)) / F.lit(n), 4).alias("null_rate"))


def edge_set(sets: DataFrame, min_pair: int, min_groups: int, min_records: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., a, b) of edges conserved at the given thresholds."""
    return conserved_edges(pmi_edges(pair_counts(sets, (*by, "group")), min_pair, min_records), min_groups, by).select(*by, "a", "b")


def holdout(train: DataFrame, test: DataFrame, n: int = 200, seed: int = 42, train_at: tuple[int, int] = (3, 4), test_at: tuple[int, int] = (2, 2), min_records: int = 10, weak: float = 0.95) -> DataFrame:
    """One row: how many training edges the held-out groups show again, against permutations of these groups.

    rate is the reproduced share, lift rate by the null's mean rate, novelty the
    share of held-out edges that training lacks, beaten the permutations with
    strictly fewer. Verdict: leakage_flag below a novelty of 0.1; success if all are
    beaten and lift is 1.15 or more; weak_support from the share `weak` of them and 1.05 on; else failure.
    """
    at = [F.when(F.col("side") == 0, x).otherwise(y) for x, y in zip(train_at, test_at)]
    edges = conserved_edges(pmi_edges(_counts([(train, 0), (test, n)], seed), at[0], min_records), at[1], ("side", "perm")).select("side", "perm", "a", "b").checkpoint()
    known, seen = edges.where("side = 0").select("a", "b"), edges.where("side = 1 AND perm = 0").select("a", "b")
    both = seen.join(known, ["a", "b"], "left_semi").agg(F.count(F.lit(1)).alias("reproduced"))
    shuffled = edges.where("side = 1 AND perm > 0").join(known, ["a", "b"], "left_semi")
    per = shuffled.groupBy("perm").agg(F.count(F.lit(1)).alias("k"))
    every = train.sparkSession.range(1, n + 1).select(F.col("id").alias("__perm")).join(per, F.col("__perm") == per["perm"], "left").select(F.coalesce("k", F.lit(0)).alias("k"))
    one = known.agg(F.count(F.lit(1)).alias("training_edges")).join(seen.agg(F.count(F.lit(1)).alias("holdout_edges"))).join(both)  # single rows
    wide = every.join(F.broadcast(one)).groupBy("training_edges", "holdout_edges", "reproduced").agg(
        F.avg("k").alias("null_mean"), F.count_if(F.col("k") < F.col("reproduced")).alias("beaten")
    )
    rate = F.when(F.col("training_edges") > 0, F.col("reproduced") / F.col("training_edges"))
    lift = F.when(F.col("null_mean") > 0, F.col("reproduced") / F.col("null_mean"))
    novelty = F.when(F.col("holdout_edges") > 0, 1 - F.col("reproduced") / F.col("holdout_edges"))
    out = wide.withColumn("rate", F.round(rate, 4)).withColumn("lift", F.round(lift, 3)).withColumn("novelty", F.round(novelty, 4))
    verdict = (
        F.when(novelty < 0.10, "leakage_flag")
        .when((F.col("beaten") == n) & (lift >= 1.15), "success")
        .when((F.col("beaten") >= weak * n) & (lift >= 1.05), "weak_support")
        .otherwise("failure")
    )
    return out.withColumn("verdict", verdict).select("training_edges", "holdout_edges", "reproduced", "rate", F.round("null_mean", 4).alias("null_mean"), "lift", "novelty", "beaten", "verdict")


def per_lineage(train: DataFrame, test: DataFrame, train_at: tuple[int, int] = (3, 4), min_records: int = 10) -> DataFrame:
    """(group, records, present): for each held-out group alone, how many training edges it shows (count of 2 or more)."""
    known = edge_set(train, *train_at, min_records)
    own = pmi_edges(pair_counts(test), 2, min_records).select("group", "a", "b").join(known, ["a", "b"], "left_semi")
    n = test.groupBy("group").agg(F.count_distinct("record").alias("records"))
    present = own.groupBy(F.col("group").alias("__g")).agg(F.count(F.lit(1)).alias("k"))
    return n.join(present, F.col("group") == F.col("__g"), "left").select("group", "records", F.coalesce("k", F.lit(0)).alias("present"))


def hard_core(train: DataFrame, test: DataFrame, groups: Sequence, train_at: tuple[int, int] = (3, 4), test_at: tuple[int, int] = (2, 2), min_records: int = 10) -> DataFrame:
    """One row (training_edges, reproduced, rate): the training edges that the listed held-out groups alone show again."""
    known = edge_set(train, *train_at, min_records).checkpoint()
    seen = edge_set(test.where(F.col("group").isin(*groups)), *test_at, min_records)
    both = known.agg(F.count(F.lit(1)).alias("training_edges")).join(seen.join(known, ["a", "b"], "left_semi").agg(F.count(F.lit(1)).alias("reproduced")))  # one row each
    return both.withColumn("rate", F.when(F.col("training_edges") > 0, F.round(F.col("reproduced") / F.col("training_edges"), 4)))


def label_propagation(edges: DataFrame, weight: str = "n_groups", rounds: int = 10) -> DataFrame:
    """(node, label): synchronous propagation; a node takes the label of greatest (weight, label) among its neighbours and itself.

    Synchronous, so that the result depends on no order of nodes or partitions;
    communities may differ from those of an in-place update. A node's own label
    has the weight of its heaviest edge, else two neighbours would swap for ever.
    """
    e = edges.select(F.col("a").alias("u"), F.col("b").alias("v"), F.col(weight).alias("w"))
    e = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    e = e.unionByName(e.groupBy("u").agg(F.max("w").alias("w")).select("u", F.col("u").alias("v"), "w")).checkpoint()
    labels = e.select(F.col("u").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = e.join(labels, e["v"] == labels["node"]).groupBy("u", "label").agg(F.sum("w").alias("w"))
        new = votes.groupBy("u").agg(F.max(F.struct("w", "label")).alias("best")).select(F.col("u").alias("node"), F.col("best.label").alias("label")).checkpoint()
        old = labels.select(F.col("node").alias("__n"), F.col("label").alias("__l"))
        moved = new.join(old, F.col("node") == F.col("__n")).where(F.col("label") != F.col("__l")).limit(1).count()
        labels = new
        if not moved:
            break
    return labels


#: Passes of ordered_propagation that are one job.
PASSES = 2


def ordered_propagation(edges: DataFrame, weight: str = "n_groups", rounds: int = 10, seed: int = 42) -> DataFrame:
    """(node, label): label propagation in place, node after node in the order of md5(seed|node), `rounds` times or until none moves.

    A node takes the label of greatest (weight, label) among its neighbours; those earlier in the order have
    their labels of this round already, the others still those of the last. So a node waits for its earlier
    neighbours only. A round starts from the last one's labels and all nodes are worked out at once, again and
    again, until nothing changes: after as many passes as the longest chain of earlier neighbours, mostly
    far fewer, this is the one result that a sequential loop has too. PASSES of them are one job.
    """
    e = edges.select(F.col("a").alias("u"), F.col("b").alias("v"), F.col(weight).alias("w")).where(F.col("u") != F.col("v"))
    e = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    turn = lambda c: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), c)).alias("h"), F.col(c).alias("n"))
    e = e.withColumn("earlier", turn("v") < turn("u")).checkpoint()
    labels = e.select(F.col("u").alias("node")).distinct().select("node", F.col("node").alias("old"), F.col("node").alias("new"), F.lit(False).alias("changed")).checkpoint()
    # a node's own row, without a vote, carries its labels along
    e = e.unionByName(labels.select(F.col("node").alias("u"), F.col("node").alias("v"), F.lit(None).cast(e.schema["w"].dataType).alias("w"), F.lit(None).cast("boolean").alias("earlier"))).checkpoint()

    def once(labels: DataFrame) -> DataFrame:
        own = F.col("earlier").isNull()
        votes = e.join(labels.select(F.col("node").alias("__v"), "old", "new"), F.col("v") == F.col("__v"))
        votes = votes.groupBy("u", own.alias("own"), F.when(own | F.col("earlier"), F.col("new")).otherwise(F.col("old")).alias("label")).agg(F.sum("w").alias("w"), F.max(F.when(own, F.col("old"))).alias("old"))
        both = votes.groupBy(F.col("u").alias("node")).agg(
            F.max("old").alias("old"), F.max(F.when(~F.col("own"), F.struct("w", "label"))).alias("best"), F.max(F.when(F.col("own"), F.col("label"))).alias("former")
        )
        return both.select("node", "old", F.col("best.label").alias("new"), (F.col("former") != F.col("best.label")).alias("changed"))

    for _ in range(rounds):
        while True:
            for _ in range(PASSES):
                labels = once(labels)
            labels = labels.checkpoint()
            if not labels.where("changed").limit(1).count():
                break
        if not labels.where("old <> new").limit(1).count():
            break
        labels = labels.select("node", F.col("new").alias("old"), "new", "changed")
    return labels.select("node", F.col("new").alias("label"))


def communities(labels: DataFrame, edges: DataFrame, least: int = 2) -> DataFrame:
    """(label, size, internal_edges, mean_groups) of communities with `least` members; the members are the rows of labels."""
    c = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    la = labels.select(F.col("node").alias("__a"), F.col("label").alias("__la"))
    lb = labels.select(F.col("node").alias("__b"), F.col("label").alias("__lb"))
    inner = edges.join(la, F.col("a") == F.col("__a")).join(lb, F.col("b") == F.col("__b")).where(F.col("__la") == F.col("__lb"))
    n = inner.groupBy("__la").agg(F.count(F.lit(1)).alias("internal_edges"), F.round(F.avg("n_groups"), 2).alias("mean_groups"))
    return c.join(n, c["label"] == n["__la"], "left").select("label", "size", F.coalesce("internal_edges", F.lit(0)).alias("internal_edges"), "mean_groups")


def neighbours(edges: DataFrame, item) -> DataFrame:
    """(partner, n_groups, cooccurrence) of an item, strongest first."""
    own = edges.where((F.col("a") == item) | (F.col("b") == item))
    return own.select(F.when(F.col("a") == item, F.col("b")).otherwise(F.col("a")).alias("partner"), "n_groups", "cooccurrence").orderBy(F.desc("n_groups"), F.desc("cooccurrence"), "partner")


def induced(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """Edges both of whose ends are among the nodes."""
    n = nodes.select(F.col(node).alias("__n")).distinct()
    m = n.withColumnRenamed("__n", "__m")
    return edges.join(n, F.col("a") == F.col("__n"), "left_semi").join(m, F.col("b") == F.col("__m"), "left_semi")


def precedence(chains: DataFrame, chain: str, position: str, item: str) -> DataFrame:
    """(a, b, before, after): chains in which a first comes before b, or after it, for a < b. First positions only, so each chain votes once."""
    first = chains.groupBy(chain, item).agg(F.min(position).alias("at"))
    each = first.groupBy(chain).agg(F.array_sort(F.collect_list(F.struct(F.col(item).alias("i"), "at"))).alias("s"))
    s = F.col("s")
    two = F.flatten(F.transform(s, lambda x, i: F.transform(F.slice(s, i + 2, F.size(s)), lambda y: F.struct(x["i"].alias("a"), y["i"].alias("b"), (x["at"] < y["at"]).alias("first")))))
    return each.select(F.explode(two).alias("p")).groupBy("p.a", "p.b").agg(F.count_if(F.col("p.first")).alias("before"), F.count_if(~F.col("p.first")).alias("after"))


def recurring_sequences(chains: DataFrame, chain: str, position: str, item: str, length: int = 3, least: int = 2) -> DataFrame:
    """(sequence, n_chains): runs of `length` items that stand in `least` chains or more."""
    w = Window.partitionBy(chain).orderBy(position)
    run = F.array(F.col(item), *[F.lead(item, k).over(w) for k in range(1, length)])
    runs = chains.select(chain, run.alias("r")).where(F.forall("r", lambda x: x.isNotNull()))
    out = runs.select(chain, F.array_join(F.transform("r", lambda x: x.cast("string")), ">").alias("sequence")).distinct()
    return out.groupBy("sequence").agg(F.count(F.lit(1)).alias("n_chains")).where(F.col("n_chains") >= least)


def gapped_sequences(chains: DataFrame, chain: str, position: str, item: str, least: int = 2, longest: int | None = None) -> DataFrame:
    """(sequence, length, n_chains, maximal): all sequences that stand in `least` chains or more, in order but with any gaps, by pattern growth.

    A sequence of a chain is known by the place where it first ends; the items after that place, each at its
    first, are what it grows by. Only sequences that enough chains have grow on, so a round is a join of the projected chains with
    their own items and ends with the longest. maximal: no longer one of them has it as a part. Items of one position don't follow each other.
    """
    rows = chains.select(F.col(chain).alias("c"), F.col(position).alias("p"), F.col(item).alias("i")).na.drop().distinct()
    often = rows.groupBy(F.col("i").alias("__i")).agg(F.count_distinct("c").alias("k")).where(F.col("k") >= least)
    rows = rows.join(often, F.col("i") == F.col("__i"), "left_semi").checkpoint()
    grown = rows.groupBy("c", "i").agg(F.min("p").alias("p")).select("c", F.array("i").alias("s"), "p")
    found, length = None, 1
    while True:
        grown = grown.checkpoint()
        level = grown.groupBy("s").agg(F.count(F.lit(1)).alias("n_chains")).where(F.col("n_chains") >= least).checkpoint()
        some = level.limit(1).count()
        if found is None or some:
            found = level if found is None else found.unionByName(level)
        if not some or length == longest:
            break
        kept = grown.join(level.select(F.col("s").alias("__s")), F.col("s") == F.col("__s"), "left_semi")
        after = rows.select(F.col("c").alias("__c"), F.col("p").alias("q"), "i")
        grown = kept.join(after, (F.col("c") == F.col("__c")) & (F.col("q") > F.col("p"))).groupBy("c", "s", "i").agg(F.min("q").alias("p"))
        grown = grown.select("c", F.concat("s", F.array("i")).alias("s"), "p")
        length += 1
    # of a longer one all sequences less one item are found too, so these are all that are not maximal
    less = F.transform(F.sequence(F.lit(1), F.size("s")), lambda k: F.concat(F.slice("s", F.lit(1), k - 1), F.slice("s", k + 1, F.size("s"))))
    parts = found.where(F.size("s") > 1).select(F.explode(less).alias("__s")).distinct()
    out = found.join(parts, F.col("s") == F.col("__s"), "left")
    return out.select(F.col("s").alias("sequence"), F.size("s").alias("length"), "n_chains", F.col("__s").isNull().alias("maximal"))


def label_sets(df: DataFrame, record: str, label: str, pile: Column, min_len: int = 4, least: int = 2) -> DataFrame:
    """(record, pile, labels): distinct lower-case labels of min_len characters, records with `least` of them."""
    low = F.lower(F.col(label))
    each = df.where(F.length(low) >= min_len).groupBy(F.col(record), pile.alias("pile")).agg(F.array_sort(F.collect_set(low)).alias("labels"))
    return each.where(F.size("labels") >= least)


def number_prominence(texts: DataFrame, doc: str = "doc_id", text: str = "text", most: int | None = None) -> DataFrame:
    """(number, mentions, neighbours, prominence): mentions of each whole number of up to four digits (up to `most`, if given) against the mean of the numbers one below and above."""
    found = texts.select(doc, F.explode(F.regexp_extract_all(text, F.lit(r"(?<![0-9.,A-Za-z])([0-9]{1,4})(?![0-9.,A-Za-z])"), 1)).alias("m"))
    n = found.select(F.col("m").cast("int").alias("number")).where(F.lit(True) if most is None else F.col("number") <= most).groupBy("number").agg(F.count(F.lit(1)).alias("mentions"))
    near = n.select(F.explode(F.array(F.col("number") - 1, F.col("number") + 1)).alias("__k"), "mentions").groupBy("__k").agg((F.sum("mentions") / 2).alias("neighbours"))
    both = n.join(near, F.col("number") == F.col("__k"), "left").withColumn("neighbours", F.coalesce("neighbours", F.lit(0.0)))
    return both.select("number", "mentions", "neighbours", F.when(F.col("neighbours") > 0, F.round(F.col("mentions") / F.col("neighbours"), 4)).alias("prominence"))
