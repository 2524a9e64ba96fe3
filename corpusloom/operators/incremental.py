"""Indexes kept up to date: what texts that changed gave is taken off, what they give now is added.

Every count of an index is a sum over texts, so a text's own share can be worked
out from its rows alone. A store keeps rows and shares in parts by a hash of the text, and an update
reads the parts that have a text which changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def versions(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """(text, version): a digest of a text's rows, in any order, repeats counted."""
    one = F.xxhash64(*columns)
    both = F.struct(F.count(F.lit(1)), F.sum(one.cast("decimal(38,0)")), F.bit_xor(F.xxhash64(one)))
    return rows.groupBy(F.col(text).alias("text")).agg(both.alias("__v")).select("text", F.sha2(F.to_json("__v"), 256).alias("version"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(text, status): inserted, changed or deleted, of two tables (text, version)."""
    old = before.select(F.col("text").alias("__t"), F.col("version").alias("__v"))
    both = after.join(old, F.col("text").eqNullSafe(F.col("__t")), "full")
    status = F.when(F.col("__v").isNull(), "inserted").when(F.col("version").isNull(), "deleted").when(F.col("version") != F.col("__v"), "changed")
    return both.select(F.coalesce("text", "__t").alias("text"), status.alias("status")).where(F.col("status").isNotNull())


def occurrence_shares(rows: DataFrame, text: str, label: str, group: str) -> DataFrame:
    """(kind, group, a, b, k): per label and group, in how many rows (kind occurrence) and in how many texts (kind text)."""
    per = rows.select(F.col(text).alias("t"), F.col(label).alias("a"), F.col(group).alias("group")).na.drop().groupBy("group", "a", "t").agg(F.count(F.lit(1)).alias("k"))
    sums = per.groupBy("group", "a").agg(F.sum("k").alias("occurrence"), F.count(F.lit(1)).alias("text"))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("k")) for c in ("occurrence", "text")])).alias("x")
    return sums.select("group", "a", each).select("x.kind", "group", "a", F.lit(None).cast(per.schema["a"].dataType).alias("b"), "x.k")


def pair_shares(rows: DataFrame, text: str, label: str, group: str) -> DataFrame:
    """(kind, group, a, b, k): texts of a group with a label (kind item), with a pair of labels (pair), and at all (record)."""
    from .graph import item_sets, pairs_of

    each = item_sets(rows, group, text, label).groupBy("group", "record").agg(F.collect_set("item").alias("items"))  # one text's set
    none = F.lit(None).cast(rows.schema[label].dataType)
    kinds = (
        each.select(F.lit("pair").alias("kind"), "group", F.explode(pairs_of(F.col("items"))).alias("p")).select("kind", "group", "p.a", "p.b"),
        each.select(F.lit("item").alias("kind"), "group", F.explode("items").alias("a")).withColumn("b", none),
        each.select(F.lit("record").alias("kind"), "group", none.alias("a"), none.alias("b")),
    )
    every = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    return every.groupBy("kind", "group", "a", "b").agg(F.count(F.lit(1)).alias("k"))


def updated(index: DataFrame, was: DataFrame, now: DataFrame) -> DataFrame:
    """index (kind, group, a, b, k) less the shares `was` and with the shares `now`; counts that come to nothing go."""
    less = was.withColumn("k", -F.col("k"))
    every = index.unionByName(less).unionByName(now)
    return every.groupBy("kind", "group", "a", "b").agg(F.sum("k").alias("k")).where(F.col("k") != 0)


def pair_counts_of(index: DataFrame) -> DataFrame:
    """(group, a, b, n_ab, n_a, n_b, n), as graph.pair_counts() has it, of an index of pair_shares()."""
    both = index.where("kind = 'pair'").select("group", "a", "b", F.col("k").alias("n_ab"))
    for side in "ab":
        one = index.where("kind = 'item'").select(F.col("group").alias("__g"), F.col("a").alias("__i"), F.col("k").alias(f"n_{side}"))
        both = both.join(one, (F.col("group") == F.col("__g")) & (F.col(side) == F.col("__i"))).drop("__g", "__i")
    n = index.where("kind = 'record'").select(F.col("group").alias("__g"), F.col("k").alias("n"))
    return both.join(n, F.col("group") == F.col("__g")).drop("__g")


def write_store(rows: DataFrame, path: str, text: str, parts: int) -> None:
    """Writes rows in `parts` folders by a hash of their text; a folder takes as many files as its tasks need."""
    rows.withColumn("__part", F.pmod(F.xxhash64(text), F.lit(parts)).cast("int")).write.mode("overwrite").partitionBy("__part").parquet(path)


def read_texts(spark: SparkSession, path: str, texts: DataFrame, text: str, parts: int) -> DataFrame:
    """The store's rows of the texts listed (text), from the folders that have any of them."""
    own = texts.select(F.col("text").alias("__t"))
    folders = [r[0] for r in own.select(F.pmod(F.xxhash64("__t"), F.lit(parts)).cast("int")).distinct().collect()]  # `parts` at most
    return spark.read.parquet(path).where(F.col("__part").isin(folders)).drop("__part").join(own, F.col(text) == F.col("__t"), "left_semi")


def update_index(index: DataFrame, store: str, after: DataFrame, text: str, columns: list[str], shares, parts: int, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(index as it is after the change, (text, status) of what changed) for a store of rows as they were, and rows as they are.

    shares(rows) gives what rows of whole texts give to the index; it sees the rows of changed texts only, old and new.
    """
    before = spark.read.parquet(store)
    what = changed(versions(before, text, columns), versions(after, text, columns)).checkpoint()
    was = read_texts(spark, store, what.where("status <> 'inserted'"), text, parts)
    now = after.join(what.where("status <> 'deleted'").select(F.col("text").alias("__t")), F.col(text) == F.col("__t"), "left_semi")
    return updated(index, shares(was), shares(now)), what
