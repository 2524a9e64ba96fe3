"""Ranks, top-k, running sums and dealt places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import numbered, numbered_within


def ranked(df: DataFrame, order: Sequence[Column | str], rank: str = "rank") -> DataFrame:
    """df with its place from 1 (long) in a total order, numbered by range partitions."""
    return numbered(df, order, rank)


def top_k(df: DataFrame, group: str | Sequence[str], order: Sequence[Column | str], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark cuts each task's part before the shuffle."""
    groups = [group] if isinstance(group, str) else list(group)
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col(rank) <= k)


def top_n(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def islands(df: DataFrame, group: str, order: str, inside: Column, run: str = "run") -> DataFrame:
    """Rows that are inside, numbered by unbroken runs within their group."""
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("__in", inside).withColumn(run, F.sum((~F.col("__in")).cast("int")).over(w)).where("__in").drop("__in")


def offsets(df: DataFrame, group: str, order: str, size: str, start: str = "start") -> DataFrame:
    """df with the sum of the sizes before each row of its group: where its slice of a pool begins."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(start, F.coalesce(F.sum(size).over(w), F.lit(0)))


def stacked(df: DataFrame, x: str, order: Sequence[Column | str], value: str) -> DataFrame:
    """df with low and high: values stacked at each x around a centred baseline."""
    w = Window.partitionBy(x).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    high = F.sum(value).over(w) - F.sum(value).over(Window.partitionBy(x)) / 2
    return df.withColumn("high", high).withColumn("low", F.col("high") - F.col(value))


def inside_out(df: DataFrame, order: Sequence[Column | str], place: str = "place") -> DataFrame:
    """df with a place that puts the first ranks in the middle, the next to either side."""
    return numbered(df, order, "__r").withColumn(place, F.when(F.col("__r") % 2 == 1, F.floor(F.col("__r") / 2)).otherwise(-F.floor(F.col("__r") / 2)).cast("long")).drop("__r")


def ordered_rows(df: DataFrame, group: str, fields: Sequence[str], place: str = "place") -> DataFrame:
    """(group, place, fields): each group's rows in the order of the fields, of groups of any size."""
    return numbered_within(df.select(group, *fields), [group], fields, place).select(group, place, *fields)


def ordered_lists(df: DataFrame, group: str, fields: Sequence[str], name: str = "rows", most: int = 100_000) -> DataFrame:
    """(group, n, rows): each group's rows as an array in the order of the fields. A group of more than `most` rows is an error: see ordered_rows."""
    n = df.groupBy(F.col(group).alias("__g")).agg(F.count(F.lit(1)).alias("n"))
    # counted before rows are gathered
    fits = F.when(F.col("n") <= most, F.col("n")).otherwise(F.raise_error(F.concat(F.lit(f"more than {most} rows in group "), F.col("__g").cast("string"))).cast("long"))
    checked = n.select("__g", fits.alias("n")).checkpoint()
    rows = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    return rows.join(checked, F.col(group).eqNullSafe(F.col("__g"))).select(group, "n", name)


def restored(results: DataFrame, requests: DataFrame, key: str, ordinal: str) -> DataFrame:
    """results in the order of the requests."""
    r = requests.select(F.col(key).alias("__k"), F.col(ordinal).alias("__o"))
    return results.join(r, results[key] == F.col("__k")).orderBy("__o").drop("__k", "__o")
