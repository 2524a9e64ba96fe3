"""Set operations, audits and predicates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import numbered_within
from .variants import nodes, text_of


def audit(checks: dict[str, tuple[DataFrame, DataFrame]], key: str) -> DataFrame:
    """(check, key): for each named check the keys of the first table that the second lacks."""
    out = []
    for name, (left, right) in checks.items():
        right = right.select(F.col(key).alias("__k")).distinct()
        out.append(left.select(key).distinct().join(right, F.col(key) == F.col("__k"), "left_anti").select(F.lit(name).alias("check"), key))
    return reduce(DataFrame.unionByName, out)


def mapping_audit(mapping: DataFrame, left: DataFrame, right: DataFrame, listed: DataFrame) -> DataFrame:
    """(check, key): the seven faults of a mapping between two sets of families, with those listed as without a counterpart.

    mapping is (left, right), right null where there is none; left, right and listed are (key). duplicate: a left family mapped more than
    once; missing: one that isn't mapped; unknown_left, unknown_right: a mapped one that doesn't exist; unlisted: a right family neither
    referred to nor listed; both: one that is; unknown_listed: a listed one that doesn't exist.
    """
    keys = lambda df, c: df.select(F.col(c).cast("string").alias("key")).where("key IS NOT NULL").distinct()
    mapped, referred = keys(mapping, "left"), keys(mapping, "right")
    own, other, named = (keys(df, "key") for df in (left, right, listed))
    twice = mapping.groupBy(F.col("left").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND key IS NOT NULL").select("key")
    lacks = lambda a, b: a.join(b.withColumnRenamed("key", "__k"), F.col("key") == F.col("__k"), "left_anti")
    checks = {
        "duplicate": twice, "missing": lacks(own, mapped), "unknown_left": lacks(mapped, own), "unknown_right": lacks(referred, other),
        "unlisted": lacks(lacks(other, referred), named), "both": referred.join(named.withColumnRenamed("key", "__k"), F.col("key") == F.col("__k"), "left_semi"),
        "unknown_listed": lacks(named, other),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("check"), "key") for name, df in checks.items()])


def atlas(collections: dict[str, DataFrame]) -> DataFrame:
    """All collections in one table, each row tagged `collection`; columns that one lacks are null there."""
    tagged = [df.withColumn("collection", F.lit(name)) for name, df in collections.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def isolated(path: Column, prefixes: Sequence[str]) -> Column:
    """Whether a path starts with none of the prefixes of another corpus."""
    return reduce(lambda a, b: a & b, [~path.startswith(p) for p in prefixes])


def large_groups(df: DataFrame, group: str, record: str, least: int) -> DataFrame:
    """Rows of groups with `least` records or more."""
    n = df.groupBy(F.col(group).alias("__g")).agg(F.count_distinct(record).alias("__n")).where(F.col("__n") >= least)
    return df.join(n.select("__g"), df[group] == F.col("__g"), "left_semi")


def rights_gate(df: DataFrame, required: dict[str, str]) -> DataFrame:
    """Rows whose columns equal the required values, nulls not."""
    return df.where(reduce(lambda a, b: a & b, [F.coalesce(F.col(c) == v, F.lit(False)) for c, v in required.items()]))


def training_gate(df: DataFrame, use: str, allowed: Sequence[str] = ("allowed", "conditional")) -> DataFrame:
    return df.where(F.col(use).isin(*allowed))


def recurring(df: DataFrame, n: str, more_than: int = 1) -> DataFrame:
    return df.where(F.col(n) > more_than)


def library(df: DataFrame, group: str, title: str, missing: str = "unattributed") -> DataFrame:
    """(group, n, place, title): titles in order by group, null groups under `missing`; a row a title, so that a group may have any number."""
    g = F.coalesce(F.col(group), F.lit(missing)).alias(group)
    rows = df.select(g, title)
    n = rows.groupBy(F.col(group).alias("__g")).agg(F.count(F.lit(1)).alias("n"))
    return numbered_within(rows, [group], [title], "place").join(n, F.col(group) == F.col("__g")).select(group, "n", "place", title)


def flat_fields(df: DataFrame, key: str, document: str) -> DataFrame:
    """(key, path, value): the leaves of a JSON document as rows, at any depth; items of arrays are numbered from 1.

    Strings are their text, numbers and booleans their JSON; nulls, empty objects and empty arrays
    have no row. A broken document has none either.
    """
    leaves = nodes(df, key, document).where("NOT nested AND path <> ''")
    return leaves.select(F.col("key").alias(key), "path", text_of("value").alias("value")).where("value IS NOT NULL")


def by_path(df: DataFrame, wanted: str, path: str = "path") -> DataFrame:
    """The rows of one path, written in any of its usual forms: leading `./` and `/`, and repeated slashes, don't count."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r"/(?:\.?/)+", "/"), r"^(?:\.?/)+", "")
    return df.where(plain(F.col(path)) == plain(F.lit(wanted)))
