"""Sharding by a Feistel permutation with cycle walking, in DataFrame functions only.

Rows get global numbers 0..N-1 in the order of (doc_id, checksum, size). A
keyed permutation of these numbers is the shuffle: position p goes to shard
`p % shards`, slot `p // shards`. So shards differ by one row at most, slots have
no gaps, and both can be computed from a row's number alone, in any engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, shielded, table

ROUNDS = 6
#: Steps of a cycle walk. A walk visits no number twice and only those outside 0..N-1, fewer than
#: sqrt(N) + 1; so up to N = WALK ** 2 none is longer. Beyond, a step stays outside with chance below
#: 1 / sqrt(N), and the walk is checked: a row that hasn't come home fails the query, it isn't dropped.
WALK = 64


def permuted(number: Column, n: int, seed: int = 42) -> Column:
    """The place of each number 0..n-1 in a keyed permutation of them.

    The domain is a grid a x b of at least n cells with a = ceil(sqrt(n)); the
    halves of the Feistel network are a cell's two coordinates, added modulo a and b.
    """
    a = max(1, _root(n))
    b = max(1, -(-n // a))
    left, right = F.lit(a).cast("long"), F.lit(b).cast("long")

    def network(x: Column) -> Column:
        cell = F.struct(F.floor(x / right).cast("long").alias("l"), (x % right).alias("r"))

        def turn(c: Column, k: Column) -> Column:
            l = F.pmod(c["l"] + F.pmod(F.xxhash64(c["r"], k, F.lit(seed)), left), left)
            r = F.pmod(c["r"] + F.pmod(F.xxhash64(c["l"], k, F.lit(~seed)), right), right)
            odd = k % 2 == 1
            return F.struct(F.when(odd, l).otherwise(c["l"]).alias("l"), F.when(odd, c["r"]).otherwise(r).alias("r"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), cell, turn, lambda c: c["l"] * right + c["r"])

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), network(number), lambda x, _: F.when(x >= n, network(x)).otherwise(x))
    return F.aggregate(F.array(walked), F.lit(0).cast("long"), lambda _, x: F.when(x < n, x).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long")))


def _root(n: int) -> int:
    from math import isqrt

    return isqrt(n - 1) + 1 if n > 0 else 0


def numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with `row_number`: a dense number from 0 in the order of keys, names of columns; other columns of any name but row_number are kept.

    Range partitions are numbered apart and moved by the counts of those before
    them: one row for each partition is gathered. Equal rows are spread too, by
    an order of no meaning: they can't be told apart.
    """
    if "row_number" in rows.columns:
        raise ValueError("rows have a column row_number already")
    rows, back = shielded(rows, keys)
    # the range is cut also by place, so that a key of a third of all rows is more than one partition
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumn("__at", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(parts, *keys, "__at").withColumn("__part", F.spark_partition_id())
    ranged = materialise(ranged, "ranged")
    counts = ranged.groupBy("__part").count()
    before = counts.select(
        F.col("__part").alias("__p"),
        F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
    )
    local = F.row_number().over(Window.partitionBy("__part").orderBy(*keys, "__at")) - 1
    out = ranged.withColumn("__local", local).join(F.broadcast(before), F.col("__part") == F.col("__p"))  # one row a partition
    return out.select(*back(out), (F.col("__before") + F.col("__local")).alias("row_number"))


def shard_rows(docs: DataFrame, shards: int = 24, seed: int = 42) -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, row_number, shard, slot.

    size is UTF-8 bytes of the text (null: none) plus 8; the checksum of a null
    text is that of an empty one. Null ids come first in the order. Repeated rows
    get places of their own. Long texts count whole. Other columns are ignored; an empty table gives an
    empty result.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = materialise(numbered(rows, ["doc_id", "text_crc32", "size"]), "numbered")
    n = placed.count()
    at = permuted(F.col("row_number"), n, seed)
    placed = placed.withColumn("__place", F.explode(F.array(at)))  # computed once, read twice
    return placed.select(
        "doc_id", "size", "text_crc32", "row_number", (F.col("__place") % shards).cast("int").alias("shard"), F.floor(F.col("__place") / shards).cast("long").alias("slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, seed: int = 42, files: int | None = None) -> None:
    """Write the rows of docs under path/shard=k/, each shard in slot order: file by file, and in each file.

    files (spark.sql.shuffle.partitions, if not given; at least the shards) is the number of tasks, each of a range of shards and slots.
    Columns of docs are written as they are, whatever their names; only those named shard or slot become shard_ and slot_ (with as many _ as it takes).
    Null ids come first, null texts count as empty ones, repeated rows get places of their own; an empty table writes no shard.
    """
    files = max(shards, files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names: list[str] = []
    for c in docs.columns:
        own = c
        while own.lower() in ("shard", "slot") or own != c and own in docs.columns:
            own += "_"
        names.append(own)
    docs, back = shielded(docs.toDF(*names), ["doc_id", "text"])
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumn("__crc", F.crc32(text.cast("binary"))).withColumn("__size", F.octet_length(text))
    placed = materialise(numbered(rows, ["doc_id", "__crc", "__size"]), "numbered-rows")
    place = F.explode(F.array(permuted(F.col("row_number"), placed.count(), seed)))
    out = placed.withColumn("__place", place).withColumn("shard", (F.col("__place") % shards).cast("int"))
    out = out.withColumn("slot", F.floor(F.col("__place") / shards).cast("long"))
    out = out.select(*back(out), "shard", "slot")
    out.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shard_rows() of the whole table `documents` into 24 shards; awkward rows and an empty table as there."""
    found = shard_rows(table(spark, sf_dir, "documents"), 24)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
