"""Helpers shared by the training-data operators: tables, scratch tables, words."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Rows that mapped() turns into Python objects at once.
SLICE = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a local one only where it is unset and all runs in one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: the cluster must name a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "corpusloom-scratch")
    return root.rstrip("/")


#: Scratch tables of each open scratch(), innermost last; the first list is of those outside of any.
_scopes: list[list[str]] = [[]]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder for a scratch table, which goes with the innermost scratch()."""
    _scopes[-1].append(f"{scratch_root(spark)}/corpusloom/{label}-{uuid.uuid4().hex}")
    return _scopes[-1][-1]


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the scratch tables made within, at its end: what is wanted of them must have been written elsewhere."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)


def release(spark: SparkSession) -> None:
    """Delete all scratch tables that this process has written, once no result that reads them is wanted any more."""
    for paths in _scopes:
        while paths:
            delete(spark, paths.pop())


def written(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to path and read it back."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df once to the shared scratch folder and read it back.

    Cuts the lineage in a way that survives lost executors, and makes what is
    read twice (counts and rows, both sides of a self-join) the same rows.
    """
    return written(df, scratch_path(df.sparkSession, label), partition_by)


#: A key is hot if it has more rows than this, and than that share of all: so there are at most HOT_KEYS of them.
HOT_ROWS, HOT_KEYS = 1_000, 100_000


def join_unique(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """left joined (inner or left) to right, whose key is unique, however many rows of left have one key.

    Rows of hot keys meet theirs by a broadcast of HOT_KEYS rows at most, where
    they are; only the others are shuffled. Both sides must have been written.
    """
    n = left.count()
    hot = left.where(F.col(left_key).isNotNull()).groupBy(left_key).count().where(F.col("count") > max(HOT_ROWS, n // HOT_KEYS))
    hot = materialise(hot.select(F.col(left_key).alias("__hot")), "hot-keys")
    if not hot.limit(1).count():
        return left.join(right.hint("merge"), left[left_key] == right[right_key], how)
    few = F.broadcast(hot)
    their = F.broadcast(right.join(few, right[right_key] == F.col("__hot"), "left_semi"))
    often = left.join(few, left[left_key] == F.col("__hot"), "left_semi")
    seldom = left.join(few, left[left_key] == F.col("__hot"), "left_anti")
    rest = right.join(few, right[right_key] == F.col("__hot"), "left_anti")
    return often.join(their, often[left_key] == their[right_key], how).unionByName(seldom.join(rest.hint("merge"), seldom[left_key] == rest[right_key], how))


#: Values that a sample's hash takes.
_TURNS = 2**40


def hashed_sample(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """At most `rows` rows of df, the first by a hash of their keys; rows of one hash count once. The same for the same rows in any layout.

    Rows above a share of the hash, set by the number of different ones, go where they are, so
    that about twice the rows asked for move, whatever the number of partitions.
    """
    h = F.pmod(F.xxhash64(*keys, F.lit(11)), F.lit(_TURNS))
    n = df.agg(F.approx_count_distinct(h, 0.02)).first()[0] or 0
    share = min(1.0, (2.0 * rows + 100) / max(n, 1))
    few = df.withColumn("__h", h).where(F.col("__h") < F.lit(int(share * _TURNS))).dropDuplicates(["__h"])
    return few.orderBy("__h").limit(rows).drop("__h")


def shielded(docs: DataFrame, used: list[str]) -> tuple[DataFrame, Callable[[DataFrame], list[Column]]]:
    """docs with its columns but the used ones under names that no helper has, and a function that gives them (by place, so of any name) their own again.

    What is done in between may add columns of any name that isn't used.
    """
    columns = docs.columns
    names = [c if c in used else f"__kept_{i}" for i, c in enumerate(columns)]
    return docs.toDF(*names), lambda df: [F.col(n).alias(c) for n, c in zip(names, columns)]


def words(text: Column | str) -> Column:
    """The words of a text, null as none. Splits on white space, so costs one pass."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column | str) -> Column:
    """How many words a text has (null: 0), without building an array of them in the plan."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns whose values are computed once a row.

    Catalyst would inline an array expression into a lambda that reads it and
    evaluate it again for every element; a Generate of one row keeps it apart.
    """
    for name, value in columns.items():
        df = df.select("*", F.explode(F.array(F.struct(value.alias("v")))).alias(f"__{name}")).select(
            *[c for c in df.columns if c != name], F.col(f"__{name}.v").alias(name)
        )
    return df


def mapped(df: DataFrame, keep: list[str], read: list[str], make: Callable[[], Callable[..., tuple]], added: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """The columns `keep` of df as they are, and `added` ones made in Python from the columns `read`.

    make() runs once a task and gives a function from the read columns, as lists,
    to the added ones. Kept columns stay Arrow throughout, so null and large
    numbers, dates and nested values come back as they were. An added column of a
    kept one's name takes its place.
    """
    names = [c for c in keep if c not in added]
    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names] + [f"`{c}` {ddl}" for c, (ddl, _) in added.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):  # so few rows are Python objects at a time
                batch = whole.slice(at, SLICE)
                made = work(*[batch.column(c).to_pylist() for c in read])
                arrays = [batch.column(c) for c in names] + [pa.array(v, kind) for v, (_, kind) in zip(made, added.values())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, *added])

    return df.select(*dict.fromkeys([*names, *read])).mapInArrow(run, ", ".join(fields))
