"""Global numbers and running sums of tables of any size: by range partitions, each worked apart and moved by what stands before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ranged(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """df cut into ranges of the order, with the range of each row in `__range`. A place ends ties, so that equal rows are cut too."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.withColumn("__range_place", F.monotonically_increasing_id())
    # written once: the ranges must be those that were counted
    return placed.repartitionByRange(parts, *order, "__range_place").withColumn("__range", F.spark_partition_id()).checkpoint()


def _before(ranged: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """One row a range: the sums over all ranges before it."""
    per = ranged.groupBy(F.col("__range").alias("__range_of")).agg(*[c.alias(k) for k, c in sums.items()])
    w = Window.orderBy("__range_of").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    return per.select("__range_of", *[F.coalesce(F.sum(k).over(w), F.lit(0)).alias(k) for k in sums])


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "row_number") -> DataFrame:
    """df with a dense number from 1 (long) in the order given; ties in an order of no meaning."""
    ranged = _ranged(df, order)
    before = _before(ranged, {"__range_before": F.count(F.lit(1))})
    here = ranged.withColumn("__range_at", F.row_number().over(Window.partitionBy("__range").orderBy(*order, "__range_place")))
    both = here.join(F.broadcast(before), F.col("__range") == F.col("__range_of"))
    return both.withColumn(name, (F.col("__range_before") + F.col("__range_at")).cast("long")).drop("__range_place", "__range", "__range_of", "__range_before", "__range_at")


def numbered_within(df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], name: str = "row_number") -> DataFrame:
    """df with a dense number from 1 within each group: a global one less the group's first. No task sees a whole group."""
    every = numbered(df, [*groups, *order], "__range_every")
    first = every.groupBy(*[F.col(c).alias(f"__range_g{i}") for i, c in enumerate(groups)]).agg(F.min("__range_every").alias("__range_first"))
    same = [F.col(c).eqNullSafe(F.col(f"__range_g{i}")) for i, c in enumerate(groups)]
    out = every.join(first, same).withColumn(name, F.col("__range_every") - F.col("__range_first") + 1)
    return out.drop("__range_every", "__range_first", *[f"__range_g{i}" for i in range(len(groups))])


def running(df: DataFrame, order: Sequence[Column | str], sums: dict[str, str]) -> DataFrame:
    """df with, for each name: column of sums, the column's sum up to and with this row in a total order."""
    ranged = _ranged(df, order)
    before = _before(ranged, {f"__b_{k}": F.sum(c) for k, c in sums.items()})
    w = Window.partitionBy("__range").orderBy(*order, "__range_place").rowsBetween(Window.unboundedPreceding, 0)
    here = ranged.select("*", *[F.sum(c).over(w).alias(f"__h_{k}") for k, c in sums.items()])
    both = here.join(F.broadcast(before), F.col("__range") == F.col("__range_of"))
    return both.select(*df.columns, *[(F.col(f"__b_{k}") + F.col(f"__h_{k}")).alias(k) for k in sums])
