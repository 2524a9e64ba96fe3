"""Sources, sinks and run mechanics as queries: tables are written out in a format and read back, the oracle is the table."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import incremental as N
from ..operators import integrity as I
from ..operators import joins as J
from ..operators import lines as D
from ..operators import pipeline as P
from ..operators import sets as X
from ..operators import windows as W
from ..session import scratch_dir
from ..sources import readers as R
from ..sources import sinks as K
from ..streaming import trickle as S
from .graph_queries import FACTS, counts_sql, facts
from .registry import query
from .text_queries import _FOUND as FOUND
from .text_queries import _NORM as NORM
from .text_queries import _PARTS as PARTS_SQL


@contextlib.contextmanager
def folder(spark: SparkSession, label: str) -> Iterator[str]:
    """A fresh folder under the shared scratch folder, deleted at the end: what is read from it must have been kept before."""
    path = f"{scratch_dir(spark)}/corpusloom/{label}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def kept(df: DataFrame) -> DataFrame:
    """df as it is now, whatever becomes of the files it was read from."""
    return df.checkpoint()


#: Folders above those of many small files, more than Spark lists in the driver (32); bytes that opening one counts as when it deals them to tasks.
SHELVES, OPENING = 128, 256 * 1024


@contextlib.contextmanager
def small_files(spark: SparkSession) -> Iterator[None]:
    """Reads planned within give a task as many small files as it can open soon, not four to thirty."""
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(OPENING))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def key_of(path: str = "path"):
    return F.regexp_extract(path, r"/key=(-?\d+)/", 1).cast("long")


@query("SELECT n_nationkey::BIGINT AS key, CASE WHEN n_nationkey % 7 = 3 OR n_nationkey % 7 = 5 THEN NULL ELSE n_name END AS name, CASE WHEN n_nationkey % 7 = 3 OR n_nationkey % 7 = 5 THEN NULL ELSE n_regionkey::BIGINT END AS region, n_nationkey % 7 = 5 AS corrupt FROM nation")
def yaml_scan(t):
    """One YAML file a nation; some are empty ({}), some broken."""
    k = F.col("n_nationkey")
    body = F.when(k % 7 == 3, F.lit("")).when(k % 7 == 5, F.lit("name: [broken")).otherwise(F.format_string("name: %s\nregion: %s\ntags: [a, b]", "n_name", "n_regionkey"))
    df = t("nation").select(k.cast("long").alias("key"), body.alias("content"))
    with folder(df.sparkSession, "yaml") as home:
        K.write_files(df, home, "key", "content")
        out = R.read_yaml(df.sparkSession, home, "name string, region long, tags array<string>")
        return kept(out.select(key_of().alias("key"), "record.name", "record.region", F.col("_corrupt_record").isNotNull().alias("corrupt")))


@query("SELECT count(*) FILTER (n_nationkey % 7 = 5) AS broken, count(*) AS files FROM nation")
def parse_checks(t):
    """Files of nations that aren't YAML, of all."""
    k = F.col("n_nationkey")
    body = F.when(k % 7 == 5, F.lit("{a: b")).otherwise(F.format_string("name: %s", "n_name"))
    df = t("nation").select(k.cast("long").alias("key"), body.alias("content"))
    with folder(df.sparkSession, "checks") as home:
        K.write_files(df, home, "key", "content")
        read = R.read_yaml(df.sparkSession, home, "name string")
        bad = I.type_errors(read, "path").agg(F.count(F.lit(1)).alias("broken"))
        return kept(bad.join(F.broadcast(read.agg(F.count(F.lit(1)).alias("files")))))  # one row each


def _markdown(t):
    k = F.col("s_suppkey")
    head = F.format_string("---\ntitle: '%s: a'\nid: %s\n---\n", "s_name", "s_suppkey")
    body = F.concat(F.when(k % 5 != 0, head).otherwise(""), F.lit("Text of "), "s_name", F.lit("\n---\nmore"))
    return t("supplier").select(k.cast("long").alias("key"), body.alias("content"))


@query("SELECT s_suppkey::BIGINT AS key, CASE WHEN s_suppkey % 5 <> 0 THEN s_name || ': a' END AS title, 'Text of ' || s_name || chr(10) || '---' || chr(10) || 'more' || chr(10) AS body FROM supplier")
def markdown_scan(t):
    """Markdown files with front matter and without."""
    df = _markdown(t)
    with folder(df.sparkSession, "markdown") as home, small_files(df.sparkSession):
        K.write_files(df, home, "key", "content", SHELVES)
        out = R.read_markdown(df.sparkSession, f"{home}/shelf=*")
        return kept(out.select(key_of().alias("key"), F.try_element_at("metadata", F.lit("title")).alias("title"), "body"))


@query("SELECT k AS key, CASE WHEN k > 0 AND k % 5 <> 0 THEN k::VARCHAR END AS id FROM (SELECT s_suppkey::BIGINT AS k FROM supplier UNION ALL SELECT -s_suppkey FROM supplier)")
def front_matter_only(t):
    """Metadata of listed files; a missing file has none."""
    df = _markdown(t)
    with folder(df.sparkSession, "front") as home, small_files(df.sparkSession):
        K.write_files(df, home, "key", "content", SHELVES)
        scanned = R.read_markdown(df.sparkSession, f"{home}/shelf=*").withColumn("path", key_of().cast("string"))
        asked = t("supplier").select(F.explode(F.array(F.col("s_suppkey").cast("string"), (-F.col("s_suppkey")).cast("string"))).alias("path"))
        out = R.front_matter_of(asked, scanned)
        return kept(out.select(F.col("path").cast("long").alias("key"), F.try_element_at("metadata", F.lit("id")).alias("id")))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 11 NOT IN (3, 4)")
def jsonl_lenient(t):
    """JSON lines of which some are blank and some broken: these go."""
    k = F.col("o_orderkey") % 11
    line = F.to_json(F.struct("o_orderkey", "o_orderstatus"))
    df = t("orders").select(F.when(k == 3, F.lit("")).when(k == 4, F.substring(line, 1, 12)).otherwise(line).alias("value"))
    with folder(df.sparkSession, "lines") as home:
        df.write.text(home)
        out = R.read_jsonl(df.sparkSession, home, "o_orderkey long, o_orderstatus string")
        return kept(out.where("o_orderkey IS NOT NULL"))


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def jsonl_strict(t):
    df = t("orders").select("o_orderkey", "o_orderstatus")
    with folder(df.sparkSession, "strict") as home:
        df.write.json(home)
        return kept(R.read_jsonl(df.sparkSession, home, "o_orderkey long, o_orderstatus string", strict=True))


@query("SELECT row_number() OVER (ORDER BY p_partkey) AS line_no FROM part QUALIFY p_partkey % 50 = 7")
def broken_lines(t):
    """Numbers of the lines of one file that aren't JSON."""
    line = F.to_json(F.struct("p_partkey"))
    df = t("part").orderBy("p_partkey").select(F.when(F.col("p_partkey") % 50 == 7, F.lit("{oops")).otherwise(line).alias("value"))
    with folder(df.sparkSession, "broken") as home:
        df.coalesce(1).write.text(home)
        return kept(R.broken_lines(df.sparkSession, home).select("line_no"))


@query("SELECT p_partkey::BIGINT AS motif_id, p_name AS label FROM part")
def chunked_yaml(t):
    """A long YAML list with a header and a further key, parsed item by item."""
    items = t("part").select(F.col("p_partkey").alias("o"), F.format_string("- motif_id: %s\n  label: %s\n  tags:\n  - x", "p_partkey", "p_name").alias("value"))
    ends = items.sparkSession.createDataFrame([(-1, "version: 1\nmotifs:"), (2**60, "closing: yes\nlist: [1]")], "o long, value string")
    with folder(items.sparkSession, "chunks") as home:
        items.select(F.col("o").cast("long").alias("o"), "value").unionByName(ends).coalesce(1).sortWithinPartitions("o").select("value").write.text(home)
        chunks = R.read_chunks(items.sparkSession, home)
        return kept(R.parse_chunks(chunks, "motif_id long, label string").select("record.motif_id", "record.label"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN (doc_id % 1000)::INTEGER END AS start FROM documents")
def field_harvest(t):
    """The start line of a record, from its raw text."""
    raw = F.concat(F.lit("record:\n  start: 9\npassage_locator:\n  kind: lines\n"), F.when(F.col("doc_id") % 3 != 0, F.format_string("  start: '%s'\n", F.col("doc_id") % 1000)).otherwise(F.lit("  none: 1\n")))
    return t("documents").select("doc_id", T.start_line_hint(raw).alias("start"))


@query("""SELECT p_partkey, unnest([p_name] || CASE WHEN p_size % 2 = 0 THEN [p_brand] ELSE [] END) AS quote FROM part""")
def quote_collector(t):
    """Strings under `quote` at any depth of a document; blank ones and what lies below a quote don't count."""
    inner = F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.lit(" "))
    deep = F.array(F.struct(F.struct(inner.alias("quote")).alias("y")), F.struct(F.struct(F.lit(None).cast("string").alias("quote")).alias("y")))
    doc = F.to_json(F.struct(F.col("p_name").alias("quote"), deep.alias("x")))
    return R.quotes(t("part").select("p_partkey", doc.alias("doc")), "p_partkey", "doc")


@query("""SELECT DISTINCT p_partkey, unnest(['m' || p_size, 'n' || (p_size + 1), 'n' || p_size, 's' || p_size]) AS id FROM part""")
def id_collector(t):
    """Ids of a document and of those in its containers."""
    s = F.col("p_size")
    name = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    accepted = F.array(F.struct(F.array(name("n", s), name("n", s + 1), F.lit("")).alias("motif_ids")))
    nested = F.array(F.struct(F.array(F.struct(name("s", s).alias("motif_id"))).alias("suggestions")))
    other = F.array(F.struct(F.lit("elsewhere").alias("motif_id")))
    doc = F.to_json(F.struct(name("m", s).alias("motif_id"), accepted.alias("accepted"), nested.alias("review_needed"), other.alias("notes")))
    return R.nested_ids(t("part").select("p_partkey", doc.alias("doc")), "p_partkey", "doc")


@query("SELECT n_nationkey::BIGINT AS key, replace(n_name, 'N', chr(65533)) AS content FROM nation")
def lossy_text(t):
    """Files with a byte that isn't UTF-8: it becomes U+FFFD."""
    df = t("nation").select(F.col("n_nationkey").cast("long").alias("key"), F.replace("n_name", F.lit("N"), F.lit("é")).alias("content"))
    with folder(df.sparkSession, "bytes") as home:
        df.write.partitionBy("key").option("encoding", "ISO-8859-1").option("header", False).option("quote", "").csv(home)
        out = R.read_binary_text(df.sparkSession, home)
        return kept(out.select(key_of().alias("key"), F.regexp_replace("content", "\n$", "").alias("content")))


_EXT = ("md", "PDF", "txt", "yml", "html", "Json", "jpg")


@query(f"SELECT p_partkey, 'texts/' || p_partkey || '.' || list_extract({list(_EXT)}, (p_size % 7 + 1)::INTEGER) AS path FROM part WHERE p_size % 7 IN (1, 2, 4, 5)")
def raw_files(t):
    path = F.concat(F.lit("texts/"), F.col("p_partkey").cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, _EXT)), (F.col("p_size") % 7 + 1).cast("int")))
    return R.raw_extensions(t("part").select("p_partkey", path.alias("path")))


@query(f"SELECT 'texts/' || p_partkey || '.' || list_extract({list(_EXT)}, (p_size % 7 + 1)::INTEGER) AS path, 1 AS line_no, 'raw download file' AS rule FROM part WHERE p_size % 7 IN (1, 2, 4, 5)")
def raw_file_rule(t):
    """The lint's rule of files."""
    path = F.concat(F.lit("texts/"), F.col("p_partkey").cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, _EXT)), (F.col("p_size") % 7 + 1).cast("int")))
    hidden = t("part").select(F.concat(F.lit("texts/."), F.col("p_partkey").cast("string"), F.lit(".txt")).alias("path"))
    return D.raw_downloads(t("part").select(path.alias("path")).unionByName(hidden))


@query("SELECT 'nation' AS collection, n_name AS name, n_regionkey::BIGINT AS regionkey FROM nation UNION ALL SELECT 'region', r_name, NULL FROM region")
def collections_written(t):
    """JSON lines of two collections, read back as the atlas."""
    nation = t("nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("regionkey"))
    with folder(nation.sparkSession, "atlas") as home:
        K.write_collections({"nation": nation, "region": t("region").select(F.col("r_name").alias("name"))}, home)
        out = nation.sparkSession.read.schema("name string, regionkey long, collection string").json(home)
        return kept(out.select("collection", "name", "regionkey"))


@query("""SELECT 'version: 1' || chr(10) || 'count: ' || count(*) || chr(10) || 'regions:' || chr(10) || string_agg('- key: ' || r_regionkey || chr(10) || '  name: ' || r_name || chr(10), '' ORDER BY r_regionkey) AS document FROM region""")
def yaml_index(t):
    df = t("region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")).orderBy("key")
    return df.sparkSession.createDataFrame([(K.yaml_index(df, {"version": 1}, "regions"),)], "document string")


@query("""WITH r AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1) SELECT '<!-- BEGIN t -->' || chr(10) || '| region | n |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_regionkey || ' | ' || n || ' |', chr(10) ORDER BY n DESC, n_regionkey) || chr(10) || '<!-- END t -->' AS report FROM r""")
def markdown_report(t):
    """A ranked table put between its markers."""
    df = t("nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.count(F.lit(1)).alias("n"))
    table = K.markdown_table(W.top_n(df, [F.desc("n"), "region"], 20))
    return df.sparkSession.createDataFrame([(K.replace_block("<!-- BEGIN t -->\nold\nlines\n<!-- END t -->", "t", table),)], "report string")


@query("SELECT 'summary' AS kind, 0 AS key, json_object('texts', (SELECT count(*) FROM documents), 'sources', (SELECT count(DISTINCT source) FROM documents))::VARCHAR AS body UNION ALL SELECT 'text', p_partkey, json_object('id', p_partkey, 'title', p_name)::VARCHAR FROM part")
def json_endpoints(t):
    """The summary endpoint and the catalogue of texts."""
    spark = t("part").sparkSession
    summary = K.endpoint(t("documents").agg(F.count(F.lit(1)).alias("texts"), F.count_distinct("source").alias("sources")))
    with folder(spark, "catalog") as home:
        K.text_catalog(t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")), "id", ["title"], home)
        lines = spark.read.text(home).select(F.lit("text").alias("kind"), F.get_json_object("value", "$.id").cast("long").alias("key"), F.col("value").alias("body"))
        top = spark.createDataFrame([("summary", 0, summary.replace(", ", ",").replace(": ", ":"))], "kind string, key long, body string")
        return kept(top.unionByName(lines))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'first' ELSE 'second' END AS run FROM part")
def guarded_write(t):
    """What is there is never overwritten: the second run adds what is missing."""
    part = t("part").select("p_partkey")
    with folder(part.sparkSession, "guarded") as home:
        K.write_new(part.where("p_partkey % 3 = 0").withColumn("run", F.lit("first")), home, "p_partkey")
        K.write_new(part.withColumn("run", F.lit("second")), home, "p_partkey")
        return kept(part.sparkSession.read.parquet(home))


@query("""WITH m AS (SELECT p_name AS k, arg_min(p_brand, p_partkey) AS brand FROM part WHERE p_size < 25 GROUP BY 1) SELECT p_partkey, p_name, brand FROM part JOIN m ON p_name = k""")
def first_mapping(t):
    """Of several mappings of a name the first counts."""
    mapping = t("part").where("p_size < 25").select(F.col("p_name").alias("raw"), F.col("p_brand").alias("brand"), F.col("p_partkey").alias("o"))
    return J.lookup(t("part").select("p_partkey", "p_name"), "p_name", mapping, "raw", "brand", "o")


@query("SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def request_map(t):
    """Of several requests under one id the last counts."""
    return J.last_by(t("orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey")


@query("""SELECT p_partkey, p_retailprice FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) ORDER BY p_retailprice DESC, p_partkey LIMIT 60""")
def unbinned_top(t):
    """The 60 dearest parts that no large order has."""
    left = J.never_seen(t("part").select("p_partkey", "p_retailprice"), "p_partkey", (t("lineitem").where("l_quantity > 49"), "l_partkey"))
    return W.top_n(left, [F.desc("p_retailprice"), "p_partkey"], 60)


@query("""WITH r AS (SELECT l_orderkey, list({'id': l_linenumber, 'flag': l_returnflag} ORDER BY l_linenumber, l_returnflag) AS e, list_sort(list(l_linenumber) FILTER (l_linestatus = 'O')) AS refs FROM lineitem GROUP BY 1)
SELECT l_orderkey, coalesce(array_to_string(list_transform(list_filter(e, lambda x: list_contains(coalesce(refs, []), x.id)), lambda x: x.id || x.flag), ','), '') AS kept FROM r""")
def evidence_for_refs(t):
    """Evidence of a record whose id is among a motif's references, in its order."""
    rows = t("lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("id"), F.col("l_returnflag").alias("flag")))).alias("evidence"),
        F.collect_list(F.when(F.col("l_linestatus") == "O", F.col("l_linenumber"))).alias("refs"),
    )
    named = F.transform(I.evidence_for(F.col("evidence"), F.col("refs")), lambda e: F.concat(e["id"].cast("string"), e["flag"]))
    return rows.select("l_orderkey", F.array_join(named, ",").alias("kept"))


@query("SELECT p_partkey::VARCHAR AS key FROM part WHERE p_size % 10 = 3")
def structural_types(t):
    """Records whose fields aren't of the declared types."""
    bad = F.concat(F.lit('{"id": "'), F.col("p_partkey").cast("string"), F.lit('", "tags": "not a list"}'))
    good = F.to_json(F.struct(F.col("p_partkey").cast("string").alias("id"), F.array("p_name").alias("tags")))
    df = t("part").select(F.when(F.col("p_size") % 10 == 3, bad).otherwise(good).alias("value"))
    with folder(df.sparkSession, "types") as home:
        df.write.text(home)
        read = df.sparkSession.read.schema("id string, tags array<string>, _corrupt_record string").json(home, mode="PERMISSIVE").checkpoint()
        return kept(I.type_errors(read, "id").select(F.get_json_object("_corrupt_record", "$.id").alias("key")))


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 7")
def top_families(t):
    return W.top_n(t("part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")), [F.desc("n"), "p_brand"], 7)


@query("SELECT row_number() OVER (ORDER BY o_orderkey DESC) AS place, o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def restored_order(t):
    """Results that came back in any order, in that of their requests."""
    requests = W.ranked(t("orders").select("o_orderkey"), [F.desc("o_orderkey")], "ordinal")
    back = W.restored(t("orders").where("o_orderstatus = 'F'").select("o_orderkey"), requests, "o_orderkey", "ordinal")
    spread = back.repartition(3, "o_orderkey")
    return W.ranked(spread, [F.desc("o_orderkey")], "place").select("place", "o_orderkey")


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 1 ORDER BY 1 LIMIT 50) ORDER BY 1 LIMIT 12")
def queue_prefix(t):
    """The first of the listed ids that wait."""
    queue = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    ids = [r["id"] for r in queue.where("id % 3 = 1").orderBy("id").limit(50).collect()]  # a list given by hand
    return P.queue_scan(queue, ["O", "P"], ids=ids, limit=12)


@query("SELECT c_custkey FROM customer WHERE NOT (c_name LIKE 'Customer#1%' OR c_name LIKE 'Customer#2%' OR c_name LIKE 'X%')")
def isolated_paths(t):
    return t("customer").where(X.isolated(F.col("c_name"), ["Customer#1", "Customer#2", "X"])).select("c_custkey")


@query("SELECT p_name, count(DISTINCT p_brand) AS n FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def recurring_labels(t):
    return X.recurring(t("part").groupBy("p_name").agg(F.count_distinct("p_brand").alias("n")), "n")


@query("SELECT doc_id, left(text, 240) AS first_quote FROM documents")
def trimmed_occurrences(t):
    evidence = F.array(F.struct(F.col("text").alias("quote"), F.lit(1).alias("id")), F.struct(F.col("lang").alias("quote"), F.lit(2).alias("id")))
    return t("documents").select("doc_id", T.trim_occurrence(evidence).alias("first_quote"))


@query(r"""SELECT o_orderkey, 'Sea Of ' || chr((65 + o_orderkey % 26)::INTEGER) || 'aSh ' || o_orderstatus AS title, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus WHEN o_orderkey % 3 = 1 THEN 'second' ELSE o_orderkey::VARCHAR END AS label,
format('{:,}', o_orderkey * 1234567) AS grouped, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS stamp, strftime(o_orderdate, '%Y-%m-%dT%H%M%SZ') AS compact FROM orders""")
def label_functions(t):
    """Titles, labels by a chain of choices, grouped numbers, dates and stamps."""
    k = F.col("o_orderkey")
    raw = F.concat(F.lit("sea_of-"), F.lower(F.chr(65 + k % 26)), F.lit("aSh "), "o_orderstatus")
    label = T.display_label(F.when(k % 3 == 0, F.concat(F.lit(" "), "o_orderstatus", F.lit(" "))).otherwise(F.lit("  ")), F.when(k % 3 == 1, F.lit("second")), k.cast("string"))
    when = F.col("o_orderdate").cast("timestamp_ntz")
    return t("orders").select("o_orderkey", T.titleize(raw).alias("title"), label.alias("label"), T.thousands(k * 1234567).alias("grouped"), T.iso_date(when).alias("day"), T.utc_stamp(when).alias("stamp"), T.compact_stamp(when).alias("compact"))


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#7' AND p_size % 10 = 4")
def path_lookup(t):
    """The records of one repository path, however it is written."""
    slashes = F.when(F.col("p_partkey") % 2 == 0, F.lit("./texts//")).otherwise(F.lit("texts/"))
    path = F.concat(slashes, "p_brand", F.lit("/"), (F.col("p_size") % 10).cast("string"), F.lit(".md"))
    return X.by_path(t("part").select("p_partkey", path.alias("path")), "/texts/Brand#7/4.md").select("p_partkey")


@query("""WITH a AS (SELECT event_id, list_extract([200, 429, 503, 404, 201], (event_id % 5 + 1)::INTEGER) AS code, event_id % 9 + 1 AS attempt, CASE WHEN event_id % 7 = 0 THEN 3 ELSE 0 END AS hint FROM events)
SELECT event_id, CASE WHEN code BETWEEN 200 AND 299 THEN 'ok' WHEN code IN (429, 503) AND attempt <= 6 THEN 'retry' ELSE 'error' END AS decision,
CASE WHEN code IN (429, 503) AND attempt <= 6 THEN CASE WHEN hint > 0 THEN hint ELSE least(2 ** attempt, 60) END END::DOUBLE AS delay FROM a""")
def retry_delays(t):
    """What follows an answer: done, another try after a wait, or an error."""
    e = F.col("event_id")
    codes = F.element_at(F.array(*map(F.lit, (200, 429, 503, 404, 201))), (e % 5 + 1).cast("int"))
    rows = t("events").select("event_id", codes.alias("code"), (e % 9 + 1).alias("attempt"), F.when(e % 7 == 0, 3).otherwise(0).alias("hint"))
    return P.retries(rows, "code", "attempt", 6, "hint").select("event_id", "decision", "delay")


@query("""WITH j AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'b' || c_custkey END AS b, CASE WHEN c_custkey % 8 = 0 THEN 'failed' WHEN c_custkey % 12 = 4 THEN 'in_progress' WHEN c_custkey % 4 = 0 THEN 'completed' ELSE 'prepared' END AS s FROM customer),
k AS (SELECT *, b IS NOT NULL AND s <> 'failed' AS skip FROM j), n AS (SELECT *, row_number() OVER (PARTITION BY skip ORDER BY c_custkey) AS n FROM k)
SELECT c_custkey, CASE WHEN skip THEN 'skip' WHEN n <= greatest(90 - (SELECT count(*) FROM j WHERE s = 'in_progress'), 0) THEN 'create' ELSE 'defer' END AS decision FROM n""")
def job_creation(t):
    """Which shards get a job now: those that have one are skipped unless they failed, and some wait for a place."""
    k = F.col("c_custkey")
    status = F.when(k % 8 == 0, "failed").when(k % 12 == 4, "in_progress").when(k % 4 == 0, "completed").otherwise("prepared")
    jobs = t("customer").select("c_custkey", F.when(k % 4 == 0, F.concat(F.lit("b"), k.cast("string"))).alias("batch_id"), status.alias("status"))
    return P.job_decisions(jobs, "c_custkey", 90, retry_failed=True).select("c_custkey", "decision")


@query("""WITH h AS (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN 'completed' ELSE event_type END AS s FROM events), e AS (SELECT user_id, min(event_id) AS at FROM h WHERE s = 'completed' GROUP BY 1),
l AS (SELECT user_id, max(event_id) AS last FROM h GROUP BY 1)
SELECT user_id, coalesce(e.at, l.last) AS at, (SELECT s FROM h WHERE h.event_id = coalesce(e.at, l.last) AND h.user_id = l.user_id) AS status, (SELECT count(*) FROM h WHERE h.user_id = l.user_id AND h.event_id <= coalesce(e.at, l.last)) AS polls FROM l LEFT JOIN e USING (user_id)""")
def polled_jobs(t):
    """Polling ends at a job's first terminal state."""
    history = t("events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", "completed").otherwise(F.col("event_type")).alias("status"))
    return P.polled(history, "user_id", "event_id").select("user_id", "at", "status", "polls")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def trickle_merge(t):
    """A stream in micro-batches merged by key: the newest row of each key stays. Runs in cycles until nothing comes."""
    rows = t("events").select("user_id", "event_id", "event_type")
    spark = rows.sparkSession
    with folder(spark, "merge") as home:
        rows.repartition(3).write.parquet(f"{home}/in")
        stream = lambda: S.trickle(spark, f"{home}/in", rows.schema, 2)
        done = S.cycles(stream, S.merge_sink(f"{home}/out", "user_id", "event_id", 8), f"{home}/state", 0.0, 600.0)
        if done[-1]:
            raise RuntimeError("the run ended before the stream was empty")
        S.vacuum(spark, f"{home}/out")
        return kept(S.read_merged(spark, f"{home}/out"))


_BODY = """'{{"model":"m","input":"' || {0} || '"}}'"""


@query(f"""WITH e AS (SELECT DISTINCT p_brand AS a, 'Brand#1' AS b FROM part WHERE p_brand > 'Brand#1'), p AS (SELECT p_brand AS k, max(p_name) AS v FROM part GROUP BY 1)
SELECT 'edge:' || a || ':' || b AS custom_id, 'POST' AS method, '/v1/responses' AS url, {_BODY.format("'Compare ' || a || ' (' || x.v || ') with ' || b || ' (' || y.v || ')'")} AS body FROM e JOIN p x ON x.k = a JOIN p y ON y.k = b""")
def edge_requests(t):
    """Requests that compare the two ends of an edge."""
    edges = t("part").where("p_brand > 'Brand#1'").select(F.col("p_brand").alias("a"), F.lit("Brand#1").alias("b")).distinct()
    return P.pair_requests(edges, "a", "b", t("part"), "p_brand", "p_name", "m", "Compare %s (%s) with %s (%s)")


@query(f"""WITH r AS (SELECT p_brand, p_name, p_partkey, count(*) OVER (PARTITION BY p_brand) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part),
l AS (SELECT p_brand, n, string_agg('- ' || p_name, '\\n' ORDER BY p_partkey) AS l FROM r WHERE r <= 5 AND n >= 8 GROUP BY ALL)
SELECT 'bins:' || p_brand AS custom_id, 'POST' AS method, '/v1/responses' AS url, {_BODY.format("'Bin the ' || n || ' of ' || p_brand || ':' || chr(92) || 'n' || l")} AS body FROM l""")
def binning_requests(t):
    """One request for each large family, with the first of its children."""
    return P.group_requests(t("part"), "p_brand", "p_name", ["p_partkey"], "m", "Bin the %2$s of %1$s:\n%3$s", "bins", 8, 5)


@query(f"""WITH b AS (SELECT doc_id, source, lang, CASE WHEN text = '' THEN '' ELSE text END AS t FROM documents WHERE doc_id % 4 <> 1),
o AS (SELECT *, left(array_to_string(string_split(t, chr(10))[1:3], chr(10)), 200) AS o FROM b)
SELECT 'dating:texts_' || source || '_' || doc_id || '_md' AS custom_id, 'POST' AS method, '/v1/responses' AS url, sha256('Date this text of ' || lang || ' from ' || source || ':' || chr(10) || coalesce(o, '')) AS input_sha256, 300 AS most FROM o""")
def dating_requests(t):
    """Requests to date texts that have no date yet, with their metadata and opening lines."""
    path = F.format_string("texts/%s/%s.md", "source", F.col("doc_id").cast("string"))
    texts = t("documents").withColumn("path", path)
    dated = texts.where("doc_id % 4 = 1").select("path")
    out = P.opening_requests(texts, dated, "path", "text", ["lang", "source"], "m", "Date this text of %s from %s:\n%s", "dating", 3, 200, {"max_output_tokens": 300})
    body = lambda f: F.get_json_object("body", f)
    return out.select("custom_id", "method", "url", F.sha2(body("$.input"), 256).alias("input_sha256"), body("$.max_output_tokens").cast("int").alias("most"))


@query(f"""SELECT 'review:' || user_id || ':' || event_id AS custom_id, 'POST' AS method, '/v1/responses' AS url, 'Apply: be strict' || chr(10) || 'DRAFT: ' || left('draft of ' || event_type, 12) AS input, user_id || ':' || event_id AS source_custom_id
FROM events WHERE event_type <> 'purchase' AND event_id % 3 > 0""")
def review_requests(t):
    """Requests that hand each completed draft to another reviewer, with the rubric; unfinished and empty drafts have none."""
    e = t("events")
    status = F.when(F.col("event_type") == "purchase", "incomplete").otherwise("completed")
    draft = F.when(F.col("event_id") % 3 == 0, "  ").otherwise(F.concat(F.lit("draft of "), "event_type"))
    rows = e.select(F.concat_ws(":", "user_id", "event_id").alias("custom_id"), status.alias("status"), draft.alias("draft"))
    out = P.review_requests(rows, "custom_id", "status", "draft", "be strict", "m", "Apply: %s\nDRAFT: %s", 12)
    return out.select("custom_id", "method", "url", F.get_json_object("body", "$.input").alias("input"), "source_custom_id")


@query("""WITH p AS (SELECT p_name, p_brand, p_type FROM part), g AS (SELECT p_name, string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand) AS b, count(DISTINCT p_brand) AS n FROM p GROUP BY 1), r AS (SELECT p_name, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS ty FROM p WHERE p_type LIKE 'E%' GROUP BY 1)
SELECT trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') || '.png' AS out, 'An image of ' || p_name || '. ' || CASE WHEN ty IS NOT NULL THEN 'Related: ' || ty || '. ' ELSE '' END || 'Seen in: ' || b || '.' AS prompt FROM g LEFT JOIN r USING (p_name) WHERE n > 1""")
def image_requests(t):
    """Image prompts of labels that recur, with what is related and where they are seen."""
    part = t("part")
    seen = part.select(F.col("p_name").alias("key"), F.col("p_brand").alias("place")).distinct()
    related = part.where("p_type LIKE 'E%'").select(F.col("p_name").alias("key"), F.col("p_type").alias("other")).distinct()
    out = P.image_prompts(seen, related, "An image of %s. ", "Related: %s. ", "Seen in: %s.", 2)
    return out.select("out", "prompt")


@query(f"""WITH n AS (SELECT n_regionkey, count(*) AS c FROM nation GROUP BY 1), l AS (SELECT count(*) AS k, string_agg(n_regionkey || ' | ' || c, '\\n' ORDER BY c DESC, n_regionkey) AS l FROM n)
SELECT 'synthesis' AS custom_id, 'POST' AS method, '/v1/responses' AS url, {_BODY.format("k || ' rows:' || chr(92) || 'n' || l")} AS body FROM l""")
def synthesis_request(t):
    """One request over a whole report."""
    df = t("nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("c"))
    return P.table_request(df, ["n_regionkey", "c"], [F.desc("c"), "n_regionkey"], "m", "%s rows:\n%s", "synthesis")


_PIECES = "CASE doc_id % 4 WHEN 0 THEN substr(text, 11, 90) WHEN 1 THEN substr(text, 3, 80) || ' [...] ' || substr(text, 101, 80) WHEN 2 THEN 'no such words as these ' || doc_id ELSE substr(text, 1, 50) END"


@query(f"""WITH b AS (SELECT doc_id % 7 AS record, doc_id % 4 = 3 AS missing, {_PIECES} AS quote, {NORM.format('text')} AS d FROM documents), n AS (SELECT *, {NORM.format('quote')} AS q FROM b),
v AS (SELECT record, quote, CASE WHEN missing THEN 'source_missing' WHEN {FOUND} THEN 'verified' ELSE 'failed' END AS status FROM (SELECT *, {PARTS_SQL} AS parts FROM n)),
f AS (SELECT record, left(quote, 120) AS s, row_number() OVER (PARTITION BY record ORDER BY left(quote, 120)) AS r FROM v WHERE status = 'failed'),
s AS (SELECT record, string_agg(s, ';' ORDER BY r) AS samples FROM f WHERE r <= 2 GROUP BY 1)
SELECT record, count(*) FILTER (status = 'verified') AS n_verified, count(*) FILTER (status = 'failed') AS n_failed, count(*) FILTER (status = 'source_missing') AS n_missing,
  round(count(*) FILTER (status = 'verified') / count(*), 4) AS rate, any_value(samples) AS samples FROM v LEFT JOIN s USING (record) GROUP BY 1""")
def quote_rollup(t):
    """Quotations of all documents, whole and elided, invented ones, and ones of missing sources, rolled up by record with samples of what failed."""
    docs, k = t("documents"), F.col("doc_id") % 4
    piece = lambda a, n: F.substring("text", a, n)
    text = F.when(k == 0, piece(11, 90)).when(k == 1, F.concat(piece(3, 80), F.lit(" [...] "), piece(101, 80))).when(k == 2, F.concat(F.lit("no such words as these "), F.col("doc_id").cast("string"))).otherwise(piece(1, 50))
    quotes = docs.select((F.col("doc_id") % 7).alias("record"), F.when(k == 3, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("source_id"), text.alias("quote"))
    verified = I.verify_quotes(quotes, t("documents").select(F.col("doc_id").alias("source_id"), "text"), "record", "source_id")
    out = I.quote_rollup(verified, "record")
    return out.withColumn("samples", F.nullif(F.array_join("samples", ";"), F.lit("")))


#: Folders of the store that an index is kept up to date from.
PARTS = 16


def _store(t, label: str):
    """(rows as they were, rows as they are): orders of 1 modulo 10 are new, of 2 had fewer lines, of 3 are gone."""
    rows = facts(t).select("l_orderkey", F.col("n_name").alias("tradition"), F.col(label).alias("label"), "l_partkey")
    k = F.col("l_orderkey") % 10
    return rows.where((k != 1) & ((k != 2) | (F.col("l_partkey") % 2 == 0))), rows.where(k != 3)


def _updated(t, label: str, shares):
    before, after = _store(t, label)
    spark = before.sparkSession
    with folder(spark, "store") as home:
        N.write_store(before, home, "l_orderkey", PARTS)
        index = shares(spark.read.parquet(home))
        out, _ = N.update_index(index, home, after, "l_orderkey", ["tradition", "label", "l_partkey"], shares, PARTS, spark)
        return kept(out)


@query(f"WITH s AS (SELECT DISTINCT n_name AS g, l_orderkey AS r, p_brand AS i FROM ({FACTS}) WHERE l_orderkey % 10 <> 3), {counts_sql('o', 's')} SELECT g AS tradition, a, b, n_ab, n_a, n_b, n FROM o_e")
def pair_index_update(t):
    """Pair counts after orders came, changed and went: from the shares of these alone."""
    index = _updated(t, "p_brand", lambda rows: N.pair_shares(rows, "l_orderkey", "label", "tradition"))
    return N.pair_counts_of(index).withColumnRenamed("group", "tradition")


@query(f"SELECT n_name AS tradition, p_name AS label, count(*) AS occurrences, count(DISTINCT l_orderkey) AS texts FROM ({FACTS}) WHERE l_orderkey % 10 <> 3 GROUP BY ALL")
def occurrence_index_update(t):
    """Occurrences of labels after the same changes."""
    index = _updated(t, "p_name", lambda rows: N.occurrence_shares(rows, "l_orderkey", "label", "tradition"))
    sums = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("k"))), F.lit(0)).alias(name) for k, name in (("occurrence", "occurrences"), ("text", "texts"))]
    return index.groupBy(F.col("group").alias("tradition"), F.col("a").alias("label")).agg(*sums)
