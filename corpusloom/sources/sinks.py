"""Sinks: JSON lines by collection, YAML and Markdown for readers, sharded lines, guarded writes."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sets import atlas


def write_collections(collections: dict[str, DataFrame], path: str) -> None:
    """One folder of JSON lines for each collection, all of them the atlas."""
    atlas(collections).write.mode("overwrite").partitionBy("collection").json(path)


def write_shards(sharded: DataFrame, line: str, path: str) -> None:
    """Text files of lines under shard_id=..., one folder a shard."""
    sharded.select("shard_id", F.col(line).alias("value")).repartition("shard_id").write.mode("overwrite").partitionBy("shard_id").text(path)


def write_new(df: DataFrame, path: str, key: str, force: bool = False) -> DataFrame:
    """Append rows whose key isn't there yet and give them; with force all is overwritten."""
    spark = df.sparkSession
    if force:
        df.write.mode("overwrite").parquet(path)
        return df
    try:
        old = spark.read.parquet(path).select(F.col(key).alias("__k")).distinct()
    except Exception as error:  # the first write has nothing to keep
        if "PATH_NOT_FOUND" not in str(error):
            raise
        df.write.parquet(path)
        return df
    fresh = df.join(old, df[key] == F.col("__k"), "left_anti").checkpoint()
    fresh.write.mode("append").parquet(path)
    return fresh


def yaml_index(df: DataFrame, header: dict, name: str, most: int = 100_000) -> str:
    """A small index as one YAML document with its header; more than `most` rows are refused, since this is gathered."""
    import yaml

    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: keep the index as Parquet")
    return yaml.safe_dump({**header, "count": len(rows), name: [r.asDict(recursive=True) for r in rows]}, allow_unicode=True, sort_keys=False)


def markdown_table(df: DataFrame, most: int = 500) -> str:
    """The rows as a Markdown table; more than `most` are refused, since this is gathered (a report of the first ones takes top_n of them)."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: cut the report first")
    cells = lambda values: "| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in values) + " |"
    return "\n".join([cells(df.columns), cells(["---"] * len(df.columns)), *map(cells, rows)])


def replace_block(text: str, name: str, body: str) -> str:
    """text with what stands between the BEGIN and END markers of a name replaced."""
    return re.sub(rf"(<!-- BEGIN {re.escape(name)} -->\n).*?(\n?<!-- END {re.escape(name)} -->)", lambda m: m[1] + body + m[2], text, flags=re.S)


def write_files(df: DataFrame, path: str, key: str, content: str, shelves: int = 0) -> None:
    """One folder key=... for each row, its content as a text file there. Written by whichever task holds the row.

    With shelves, folders stand below as many shelf=..., each written by one task: all tasks write, the commit moves
    shelves instead of folders, and a reader of `path/*` lists them side by side.
    """
    out = df.select(key, F.col(content).alias("value"))
    if shelves:
        out = out.withColumn("shelf", F.pmod(F.hash(key), F.lit(shelves))).repartition(shelves, "shelf")
    out.write.mode("overwrite").partitionBy(*["shelf"] * bool(shelves), key).text(path)


def text_catalog(df: DataFrame, key: str, fields: Sequence[str], path: str) -> None:
    """The catalogue endpoint: one JSON line for each text, written in the order of its key."""
    df.select(key, *fields).orderBy(key).write.mode("overwrite").json(path)


def endpoint(summary: DataFrame) -> str:
    """A one-row summary as JSON."""
    row = summary.first()
    return json.dumps(row.asDict(recursive=True) if row else {}, default=str)
