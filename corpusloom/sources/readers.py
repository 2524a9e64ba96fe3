"""Sources: YAML, Markdown with front matter, JSON lines, and harvests from raw text."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.variants import nodes, text_of


def read_whole(spark: SparkSession, glob: str) -> DataFrame:
    """(path, content): whole files."""
    return spark.read.text(glob, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def read_yaml(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """(path, record, _corrupt_record): safely loaded documents by a declared schema; an empty one is {}.

    YAML is parsed in Python, in Arrow batches, to JSON, which Spark then reads by
    schema. Meant to be run once and kept as Parquet.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for pdf in batches:
            out = []
            for text in pdf["content"]:
                try:
                    out.append((json.dumps(yaml.safe_load(text) or {}, default=str), None))
                except yaml.YAMLError:
                    out.append((None, text))
            yield pd.DataFrame({"path": pdf["path"], "json": [x[0] for x in out], "_corrupt_record": [x[1] for x in out]})

    loaded = read_whole(spark, glob).mapInPandas(parse, "path string, json string, _corrupt_record string")
    return loaded.select("path", F.from_json("json", schema).alias("record"), "_corrupt_record")


def front_matter(content) -> tuple:
    """(metadata text, body) columns of a document that may start with `---`."""
    head = F.regexp_extract(content, r"(?s)^---[ \t]*\n(.*?)(?:^|\n)---[ \t]*(?:\n|\z)", 1)
    has = content.rlike(r"(?s)^---[ \t]*\n.*?(?:^|\n)---[ \t]*(?:\n|\z)")
    body = F.regexp_replace(content, r"(?s)\A---[ \t]*\n.*?(?:^|\n)---[ \t]*(?:\n|\z)", "")
    return F.when(has, head).otherwise(F.lit("")), F.when(has, body).otherwise(content)


def read_markdown(spark: SparkSession, glob: str) -> DataFrame:
    """(path, metadata, body): metadata a map of the plain `key: value` lines of the front matter."""
    whole = read_whole(spark, glob)
    head, body = front_matter(F.col("content"))
    pairs = F.transform(
        F.filter(F.split(head, "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*:")),
        lambda x: F.struct(F.regexp_extract(x, r"^([\w-]+):", 1).alias("k"), F.trim(F.regexp_replace(F.regexp_replace(x, r"^[\w-]+:\s*", ""), "^['\"]|['\"]$", "")).alias("v")),
    )
    first = F.aggregate(pairs, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["k"]), F.create_map(p["k"], p["v"])))
    return whole.select("path", first.alias("metadata"), body.alias("body"))


def front_matter_of(paths: DataFrame, scanned: DataFrame, path: str = "path") -> DataFrame:
    """paths with the `metadata` of scanned Markdown (path, metadata, ...), an empty map for a file that is missing. The bodies are never read on."""
    known = scanned.select(F.col("path").alias("__p"), "metadata")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return paths.join(known, F.col(path) == F.col("__p"), "left").withColumn("metadata", F.coalesce("metadata", none)).drop("__p")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line): the lines of text files, numbered from 1 in each. A file that is read in blocks is numbered by the counts of these."""
    at = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")
    rows = spark.read.text(path).select(*at, F.col("value").alias("line")).withColumn("id", F.monotonically_increasing_id())
    here = rows.withColumn("n", F.row_number().over(Window.partitionBy("path", "block").orderBy("id")))
    counts = rows.groupBy(F.col("path").alias("p"), F.col("block").alias("b")).agg(F.count(F.lit(1)).alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("p").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("p", "b", before.alias("before"))
    both = here.join(starts, (F.col("path") == F.col("p")) & (F.col("block") == F.col("b")))
    return both.select("path", (F.col("n") + F.col("before")).alias("line_no"), "line")


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line): lines that are neither blank nor JSON."""
    return numbered_lines(spark, path).where((F.trim("line") != "") & F.try_parse_json("line").isNull())


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines by schema; lenient drops blank and broken lines, strict fails on a broken one with its file and number."""
    if strict:
        first = broken_lines(spark, path).orderBy("path", "line_no").limit(1).collect()
        if first:
            raise ValueError(f"{first[0]['path']}:{first[0]['line_no']}: no JSON: {first[0]['line'][:80]}")
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def read_chunks(spark: SparkSession, path: str, marker: str = "- motif_id:") -> DataFrame:
    """(path, kind, chunk): a large list document split before each line that starts with the marker, without being held whole.

    kind is `header` for what stands before the first item, else `item`. An item
    starts with its marker and ends before the next key of the document's top level.
    """
    rows = spark.read.option("lineSep", "\n" + marker).text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), "value").withColumn("id", F.monotonically_increasing_id())
    first = rows.groupBy(F.col("path").alias("p")).agg(F.min("id").alias("first"))
    both = rows.join(first, F.col("path") == F.col("p"))
    leading = (F.col("id") == F.col("first")) & ~F.col("value").startswith(marker)
    whole = F.when(leading | F.col("value").startswith(marker), F.col("value")).otherwise(F.concat(F.lit(marker), F.col("value")))
    item = F.regexp_extract(whole, r"(?s)^(.*?)(?:\n(?=[A-Za-z_])|\z)", 1)
    out = both.select("path", F.when(leading, "header").otherwise("item").alias("kind"), F.when(leading, whole).otherwise(item).alias("chunk"))
    return out.where(F.trim("chunk") != "")


def parse_chunks(chunks: DataFrame, schema: str) -> DataFrame:
    """(path, record): each item of read_chunks parsed by itself, as schema."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "json": [json.dumps(yaml.safe_load(x)[0], default=str) for x in pdf["chunk"]]})

    items = chunks.where("kind = 'item'").select("path", "chunk").mapInPandas(parse, "path string, json string")
    return items.select("path", F.from_json("json", schema).alias("record"))


def read_binary_text(spark: SparkSession, glob: str) -> DataFrame:
    """(path, content): bytes as UTF-8, what isn't valid as U+FFFD."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(glob)
    return raw.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


# Extensions of raw sources.
RAW_EXTENSIONS = ("asc", "epub", "htm", "html", "json", "log", "mht", "mhtml", "pdf", "rtf", "tei", "text", "txt", "xhtml", "xml", "zip")


def raw_extensions(files: DataFrame, path: str = "path", extensions: Sequence[str] = RAW_EXTENSIONS) -> DataFrame:
    """Files whose extension marks a raw source among clean texts."""
    return files.where(F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)).isin(*extensions))


def quotes(df: DataFrame, key: str, document: str) -> DataFrame:
    """(key, quote): every non-blank string under a `quote` key of a JSON document, at any depth. A matching key isn't descended; broken documents have none."""
    named = F.coalesce(F.col("name") == "quote", F.lit(False))
    found = nodes(df, key, document, into=~named).where(named & (F.schema_of_variant("value") == "STRING"))
    return found.select(F.col("key").alias(key), F.variant_get("value", "$", "string").alias("quote")).where(F.col("quote").rlike(r"\S"))


def collected_ids(df: DataFrame, key: str, single: Sequence[str] = (), many: Sequence[str] = ()) -> DataFrame:
    """(key, id): ids from single columns and from array columns, distinct."""
    every = F.concat(F.array(*[F.col(c).cast("string") for c in single]) if single else F.array().cast("array<string>"), *[F.coalesce(F.col(c).cast("array<string>"), F.array().cast("array<string>")) for c in many])
    return df.select(key, F.explode(F.filter(every, lambda x: x.isNotNull() & (x != ""))).alias("id")).distinct()


# Keys of documents that hold further ones with ids.
CONTAINERS = ("motifs", "suggestions", "review_needed", "accepted", "auto_accepted")


def nested_ids(df: DataFrame, key: str, document: str, single: str = "motif_id", many: str = "motif_ids", containers: Sequence[str] = CONTAINERS) -> DataFrame:
    """(key, id): distinct ids under `single` and `many` of a JSON document and of the documents in its containers, at any depth; broken documents have none."""
    name = F.col("name")
    item = F.coalesce(F.col("path").rlike(rf"(^|\.)\Q{many}\E\.[0-9]+$"), F.lit(False))  # of a list right under `many`
    held = nodes(df, key, document, child=name.isNull() | name.isin(single, many, *containers), into=(name.isNull() & ~item) | name.isin(many, *containers))
    own = name.isin(single, many) | item
    ids = held.where(own & ~F.col("nested")).select(F.col("key").alias(key), text_of("value").alias("id"))
    return ids.where("id <> ''").distinct()
