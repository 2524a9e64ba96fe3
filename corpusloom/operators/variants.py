"""JSON documents of any shape walked level by level as VARIANT values, without Python workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nodes(df: DataFrame, key: str, document: str, child: Column | None = None, into: Column | None = None) -> DataFrame:
    """(key, path, name, value, nested): every node of each JSON document, itself included (path ""), at any depth.

    name is the key in an object, null for an item of an array, which has its number from 1 in the path.
    child (a condition on name) picks which nodes are rows, into (on name, nested) which of these are gone into. A level is a
    table that is written, and the walk ends with the first level that has nothing nested: as many passes
    as documents are deep, over what is nested still. Null and broken documents (those that repeat a key are broken too) have no row.
    """
    level = df.select(F.col(key).alias("key"), F.lit("").alias("path"), F.lit(None).cast("string").alias("name"), F.try_parse_json(document).alias("value"))
    out = None
    while True:
        level = level.where(F.col("value").isNotNull()).withColumn("nested", F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)")).checkpoint()
        out = level if out is None else out.unionByName(level)
        deeper = level.where(F.col("nested") if into is None else F.col("nested") & into).select(F.col("key").alias("k"), F.col("path").alias("p"), "value")
        if not deeper.limit(1).count():
            return out
        items = df.sparkSession.tvf.variant_explode(F.col("whole").outer())  # pos, key (of an object's item), value
        below = deeper.withColumnRenamed("value", "whole").lateralJoin(items)
        step = F.coalesce(F.col("key"), (F.col("pos") + 1).cast("string"))
        level = below.select(F.col("k").alias("key"), F.concat_ws(".", F.nullif("p", F.lit("")), step).alias("path"), F.col("key").alias("name"), "value")
        if child is not None:
            level = level.where(child)


def text_of(value: Column | str) -> Column:
    """A string as it is, another scalar as its JSON, null as null."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(~F.is_variant_null(value), F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value)))
