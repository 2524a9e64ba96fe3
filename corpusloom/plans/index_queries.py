"""Frequency, join, window, set and pipeline queries over the star schema and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import frequency as Q
from ..operators import integrity as I
from ..operators import joins as J
from ..operators import pipeline as P
from ..operators import sets as X
from ..operators import windows as W
from .graph_queries import FACTS, facts
from .registry import query

YEARS = ("1995-1996", "1997-1998", "1999-2000", "2001-2002")


def spans(df):
    y = F.year("o_orderdate")
    return df.withColumn("year", y).withColumn("era", Q.era(y, [(e, int(e[:4]), int(e[5:]) + 1) for e in YEARS]))


_ERA = "CASE WHEN y < 1997 THEN '1995-1996' WHEN y < 1999 THEN '1997-1998' WHEN y < 2001 THEN '1999-2000' ELSE '2001-2002' END"
_F = f"f AS (SELECT *, year(o_orderdate) AS y FROM ({FACTS}))"


@query(f"""WITH {_F}, g AS (SELECT p_name, n_name, count(*) AS n, min(l_partkey) AS k FROM f GROUP BY ALL)
SELECT p_name AS motif, sum(n)::BIGINT AS total, count(*) AS n_groups, string_agg(n_name || '=' || n, ',' ORDER BY n_name) AS groups FROM g GROUP BY 1""")
def motif_occurrence_index(t):
    out = Q.occurrence_index(facts(t), "p_name", "n_name")
    groups = F.array_join(F.transform(F.map_entries("groups"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select(F.col("p_name").alias("motif"), "total", "n_groups", groups.alias("groups"))


@query(f"""WITH {_F}, m AS (SELECT CASE WHEN p_size % 5 = 0 THEN trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') ELSE trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') END AS motif, p_name, l_orderkey * 1000000 + l_partkey AS o, n_name
  FROM (SELECT f.*, part.p_size AS size_ FROM f JOIN part ON f.l_partkey = part.p_partkey))
SELECT motif, arg_min(p_name, (o, p_name)) AS label, count(*) AS total, count(DISTINCT n_name) AS n_groups FROM m GROUP BY 1""")
def occurrence_labels(t):
    """The occurrence index of motifs that may have no references: then the label's slug is the motif. Labels are the first seen."""
    sized = facts(t).join(t("part").select(F.col("p_partkey").alias("__k"), "p_size"), F.col("l_partkey") == F.col("__k"))
    refs = F.when(F.col("p_size") % 5 != 0, F.array("p_brand")).otherwise(F.array().cast("array<string>"))
    rows = sized.withColumn("motif", F.explode(Q.refs_or_label(refs, F.col("p_name")))).withColumn("o", F.col("l_orderkey") * 1000000 + F.col("l_partkey"))
    return Q.occurrence_index(rows, "motif", "n_name", "p_name", "o").select("motif", "label", "total", "n_groups")


@query(f"""WITH {_F}, c AS (SELECT p_partkey, n_name, count(*) AS n FROM f GROUP BY ALL),
g AS (SELECT p_brand, sum(n)::BIGINT AS occurrences, count(DISTINCT n_name) AS traditions, count(DISTINCT c.p_partkey) AS mapped FROM c JOIN part USING (p_partkey) GROUP BY 1),
e AS (SELECT 'Empty' AS p_brand, FALSE AS is_meta UNION ALL SELECT DISTINCT p_brand, split_part(p_brand, '#', 2)::INTEGER % 6 = 0 FROM part)
SELECT p_brand AS family, is_meta, coalesce(occurrences, 0)::BIGINT AS occurrences, coalesce(traditions, 0) AS traditions, coalesce(mapped, 0) AS mapped,
row_number() OVER (ORDER BY is_meta, coalesce(traditions, 0) DESC, coalesce(occurrences, 0) DESC, p_brand) AS rank FROM e LEFT JOIN g USING (p_brand)""")
def canonical_frequency(t):
    """Groups by traditions and occurrences, meta groups last; a group without members stays."""
    counts = facts(t).groupBy("l_partkey", "n_name").agg(F.count(F.lit(1)).alias("n"))
    meta = F.substring_index("p_brand", "#", -1).cast("int") % 6 == 0
    groups = t("part").select("p_brand", F.col("p_partkey").alias("l_partkey"), meta.alias("meta"))
    empty = groups.sparkSession.createDataFrame([("Empty", None, False)], groups.schema)
    out = Q.canonical_rollup(counts, groups.unionByName(empty), "l_partkey", "n_name", "n", "p_brand", "meta")
    out = W.ranked(out, ["is_meta", F.desc("traditions"), F.desc("occurrences"), "p_brand"])
    return out.withColumnRenamed("p_brand", "family")


@query(f"""WITH {_F}, c AS (SELECT p_brand, n_name, count(*) AS n FROM f GROUP BY ALL)
SELECT p_brand AS family, n_name AS tradition, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, n_name) AS rank FROM c) WHERE rank <= 5""")
def top_traditions_per_family(t):
    counts = facts(t).groupBy("p_brand", "n_name").agg(F.count(F.lit(1)).alias("n"))
    out = W.top_k(counts, "p_brand", [F.desc("n"), "n_name"], 5)
    return out.select(F.col("p_brand").alias("family"), F.col("n_name").alias("tradition"), "n", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_F}, c AS (SELECT p_brand, {_ERA} AS era, count(*) AS n, count(DISTINCT n_name) AS k, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS tr FROM f GROUP BY ALL),
e AS (SELECT DISTINCT p_brand, unnest(['1995-1996', '1997-1998', '1999-2000', '2001-2002']) AS era FROM f)
SELECT e.p_brand AS family, e.era, coalesce(n, 0) AS n, coalesce(k, 0) AS n_traditions, coalesce(tr, '') AS traditions FROM e LEFT JOIN c ON c.p_brand = e.p_brand AND c.era = e.era""")
def era_flow(t):
    out = Q.era_flow(spans(facts(t)), "p_brand", "era", "n_name", YEARS)
    return out.select(F.col("p_brand").alias("family"), "era", "n", F.col("n_traditions").cast("long").alias("n_traditions"), F.array_join("traditions", ",").alias("traditions"))


@query(f"WITH {_F} SELECT p_brand AS family, min(y) AS first_year, min(l_orderkey) FILTER (y = m) AS first_record FROM (SELECT *, min(y) OVER (PARTITION BY p_brand) AS m FROM f) GROUP BY 1")
def first_attestation(t):
    out = Q.first_attestation(facts(t).withColumn("year", F.year("o_orderdate").cast("long")), "p_brand", "year", "l_orderkey")
    return out.select(F.col("p_brand").alias("family"), "first_year", F.col("first_path").alias("first_record"))


@query(f"""WITH {_F}, c AS (SELECT {_ERA} AS era, p_brand, count(*) AS n FROM f GROUP BY ALL)
SELECT era, p_brand AS family, n, sum(n) OVER (PARTITION BY era ORDER BY n DESC, p_brand ROWS UNBOUNDED PRECEDING) - sum(n) OVER (PARTITION BY era) / 2 AS high,
sum(n) OVER (PARTITION BY era ORDER BY n DESC, p_brand ROWS UNBOUNDED PRECEDING) - sum(n) OVER (PARTITION BY era) / 2 - n AS low FROM c""")
def era_streams(t):
    counts = spans(facts(t)).groupBy("era", F.col("p_brand").alias("family")).agg(F.count(F.lit(1)).alias("n"))
    return W.stacked(counts, "era", [F.desc("n"), "family"], "n")


@query("""WITH r AS (SELECT p_brand, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS r FROM part GROUP BY 1)
SELECT p_brand AS family, n, (CASE WHEN r % 2 = 1 THEN r // 2 ELSE -(r // 2) END)::BIGINT AS place FROM r""")
def inside_out_order(t):
    counts = t("part").groupBy(F.col("p_brand").alias("family")).agg(F.count(F.lit(1)).alias("n"))
    return W.inside_out(counts, [F.desc("n"), "family"])


@query(f"WITH {_F} SELECT n_name AS text, count(DISTINCT l_orderkey) AS records, count(DISTINCT p_brand) AS motifs, count(*) AS occurrences FROM f GROUP BY 1")
def text_summary(t):
    return Q.text_summary(facts(t), "n_name", "l_orderkey", "p_brand").withColumnRenamed("n_name", "text")


@query(f"""WITH {_F}, g AS (SELECT p_brand, sum(n)::BIGINT AS total, string_agg(n_name || '=' || n, ',' ORDER BY n_name) AS groups FROM (SELECT p_brand, n_name, count(*) AS n FROM f GROUP BY ALL) GROUP BY 1),
r AS (SELECT p_brand, string_agg(r_name || '=' || n, ',' ORDER BY r_name) AS subs FROM (SELECT p_brand, r_name, count(*) AS n FROM f GROUP BY ALL) GROUP BY 1)
SELECT p_brand AS motif, total, groups, subs FROM g JOIN r USING (p_brand)""")
def experiential_index(t):
    out = Q.two_map_index(facts(t), "p_brand", "n_name", "r_name")
    joined = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias(c)
    return out.select(F.col("p_brand").alias("motif"), "total", joined("groups"), joined("subs"))


@query(f"WITH {_F} SELECT r_name AS sub_corpus, count(DISTINCT n_name) AS texts, count(DISTINCT l_orderkey) AS records, count(*) AS occurrences, count(DISTINCT p_brand) AS motifs FROM f GROUP BY 1")
def subcorpus_rollup(t):
    return Q.subcorpus_rollup(facts(t), "r_name", "n_name", "l_orderkey", "p_brand").withColumnRenamed("r_name", "sub_corpus")


@query("""SELECT c_custkey, count(o_orderkey) AS n_records, CASE WHEN count(o_orderkey) = 0 THEN 'no_extractions' ELSE 'extracted' END AS status FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def extraction_coverage(t):
    return Q.coverage(t("customer").select("c_custkey"), t("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT count(DISTINCT p_partkey) AS indexed, count(DISTINCT l_partkey) AS mapped, count(DISTINCT p_partkey) - count(DISTINCT l_partkey) AS unmapped FROM part LEFT JOIN lineitem ON l_partkey = p_partkey")
def mapped_counts(t):
    return Q.mapped_counts(t("part"), t("lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


@query("""SELECT theme, count(*) FILTER (regexp_matches(p_type || ' ' || p_name, pat)) AS n
FROM part, (VALUES ('economy', 'ECONOMY'), ('ring', 'ring'), ('promo', '^PROMO'), ('none', 'zzz')) v(theme, pat) GROUP BY theme""")
def theme_tally(t):
    df = t("part").select(F.concat_ws(" ", "p_type", "p_name").alias("bond"))
    return Q.theme_tally(df, "bond", {"economy": "ECONOMY", "ring": "ring", "promo": "^PROMO", "none": "zzz"})


@query(f"""WITH {_F}, k AS (SELECT lower(p_name) AS key, r_name IN ('AFRICA', 'AMERICA') AS iso, n_name FROM f WHERE len(p_name) >= 4)
SELECT key, count(DISTINCT n_name) FILTER (iso) AS isolated, count(DISTINCT n_name) FILTER (NOT iso) AS connected FROM k GROUP BY 1""")
def label_spread(t):
    df = facts(t).withColumn("pile", F.when(F.col("r_name").isin("AFRICA", "AMERICA"), "isolated").otherwise("connected"))
    out = Q.label_spread(df, "p_name", "pile", "n_name", "l_partkey")
    n = lambda k: F.coalesce(F.try_element_at("piles", F.lit(k)), F.lit(0)).alias(k)
    return out.select("key", n("isolated"), n("connected"))


@query("""WITH p AS (SELECT p_name, bool_or(p_brand = 'Brand#1') AS a, bool_or(p_brand <> 'Brand#1') AS b FROM part GROUP BY 1)
SELECT count(*) FILTER (a AND NOT b) AS first_only, count(*) FILTER (b AND NOT a) AS second_only, count(*) FILTER (a AND b) AS both FROM p""")
def pile_counts(t):
    return Q.pile_counts(t("part"), "p_name", F.col("p_brand") == "Brand#1")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def value_counts(t):
    return Q.value_counts(t("events"), "event_type")


@query("""SELECT p_brand AS family, p_name AS child FROM (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_name) AS r FROM part GROUP BY 1, 2) WHERE r = 1""")
def largest_child(t):
    counts = t("part").groupBy("p_brand", "p_name").agg(F.count(F.lit(1)).alias("n"))
    return Q.best_of(counts, "p_brand", "p_name", "n").select(F.col("p_brand").alias("family"), F.col("p_name").alias("child"))


@query(f"WITH {_F} SELECT n_name AS text, count(*) AS n FROM f WHERE y > 2000 GROUP BY 1")
def undated_accounting(t):
    dated = facts(t).withColumn("year", F.when(F.year("o_orderdate") <= 2000, F.year("o_orderdate")))
    return Q.undated(dated, "n_name", "year").withColumnRenamed("n_name", "text")


@query(f"""WITH {_F}, c AS (SELECT p_brand, n_name, count(*) AS n FROM f WHERE n_name <> 'NATION_0' GROUP BY ALL),
e AS (SELECT DISTINCT p_brand FROM part WHERE p_size = 50)
SELECT p_brand AS family, count(*) AS traditions, sum(n)::BIGINT AS occurrences, p_brand IN (SELECT p_brand FROM e) AS proven FROM c GROUP BY 1""")
def universals(t):
    counts = facts(t).where("n_name <> 'NATION_0'").groupBy("p_brand", "n_name").agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("p_brand").agg(F.count(F.lit(1)).alias("traditions"), F.sum("n").alias("occurrences"))
    return J.flagged(per, "p_brand", t("part").where("p_size = 50"), "p_brand", "proven").withColumnRenamed("p_brand", "family")


@query("""WITH u AS (SELECT p_brand, unnest(range(min(p_size), max(p_size) + 1)) AS i FROM part GROUP BY 1)
SELECT p_brand AS source, printf('%s.%03d', p_brand, i) AS unit, (SELECT count(*) FROM part p WHERE p.p_brand = u.p_brand AND p.p_size = u.i) AS n_sources FROM u""")
def range_expansion_coverage(t):
    ranges = t("part").groupBy("p_brand").agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"))
    units = J.expand_ranges(ranges, "p_brand", "p_brand", "lo", "hi")
    have = t("part").select(F.format_string("%s.%03d", "p_brand", "p_size").alias("unit"), F.col("p_partkey").alias("src"))
    got = J.planned_coverage(units, "unit", have, "src", t("part").select(F.col("p_partkey").alias("src"), "p_name"), "p_name")
    return units.join(got, "unit").select(F.col("p_brand").alias("source"), "unit", "n_sources")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate < '1995-09-01')")
def never_included(t):
    earlier = t("lineitem").where(F.col("l_shipdate") < F.lit("1995-09-01").cast("timestamp_ntz"))
    return J.never_seen(t("part").select("p_partkey", "p_name"), "p_partkey", (earlier, "l_partkey"))


@query("SELECT l_suppkey AS ref, count(*) AS n FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1")
def reference_integrity(t):
    bad = I.dangling(t("lineitem").select("l_suppkey"), "l_suppkey", t("supplier").where("s_acctbal > 0"), "s_suppkey")
    return bad.groupBy(F.col("l_suppkey").alias("ref")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_brand AS family, count(*) AS n FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size >= 50 AND p_type = 'PROMO') GROUP BY 1 HAVING count(*) >= 20""")
def unbinned_families(t):
    n = t("part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return J.unbinned(n, "p_brand", "n", t("part").where("p_size >= 50 AND p_type = 'PROMO'"), 20).withColumnRenamed("p_brand", "family")


_MOTIF = "p_name || '/' || p_size"


@query(f"""WITH RECURSIVE raw AS (SELECT DISTINCT {_MOTIF} AS m FROM part),
i AS (SELECT {_MOTIF} AS m, min(p_brand) AS g FROM part WHERE p_size >= 40 GROUP BY 1), k AS (SELECT {_MOTIF} AS m, arg_min(p_brand, split_part(p_brand, '#', 2)::INTEGER) AS g FROM part WHERE p_size < 10 GROUP BY 1),
hit AS (SELECT m, coalesce(i.g, k.g) AS g FROM i FULL JOIN k USING (m)), al AS (SELECT DISTINCT {_MOTIF} AS m, p_name || '/' || (p_size - 5) AS ref FROM part WHERE p_size BETWEEN 10 AND 39),
walk AS (SELECT m, m AS at FROM raw UNION ALL SELECT w.m, al.ref FROM walk w JOIN al ON al.m = w.at WHERE w.at NOT IN (SELECT m FROM hit))
SELECT raw.m AS motif, f.g AS group_id FROM raw LEFT JOIN (SELECT walk.m, hit.g FROM walk JOIN hit ON hit.m = walk.at) f ON f.m = raw.m""")
def alias_resolution(t):
    """Part names resolved to brands through an index, members and a chain of aliases."""
    part = t("part")
    groups = part.select(F.col("p_brand").alias("group_id")).distinct().withColumn("pos", F.substring_index("group_id", "#", -1).cast("int"))
    members = part.where("p_size < 10").select(F.col("p_brand").alias("group_id"), F.substring_index("p_brand", "#", -1).cast("int").alias("pos"), F.concat_ws("/", "p_name", "p_size").alias("member")).distinct()
    index = part.where("p_size >= 40").groupBy(F.concat_ws("/", "p_name", "p_size").alias("motif")).agg(F.min("p_brand").alias("group_id"))
    raw = part.select(F.concat_ws("/", "p_name", "p_size").alias("motif")).distinct()
    aliases = part.where("p_size BETWEEN 10 AND 39").select(F.concat_ws("/", "p_name", "p_size").alias("alias"), F.lit(0).alias("ord"), F.concat_ws("/", "p_name", F.col("p_size") - 5).alias("ref")).distinct()
    return J.resolve(raw, "motif", groups, members, aliases, index)


@query("""SELECT 'unsold' AS "check", p_brand AS family FROM (SELECT DISTINCT p_brand FROM part WHERE p_size = 1 EXCEPT SELECT p_brand FROM part WHERE p_type = 'ECONOMY' AND p_size < 5)
UNION ALL SELECT 'large', p_brand FROM (SELECT DISTINCT p_brand FROM part EXCEPT SELECT p_brand FROM part WHERE p_retailprice > 1000 AND p_size = 49)""")
def set_audit(t):
    p = t("part").withColumnRenamed("p_brand", "family")
    return X.audit({"unsold": (p.where("p_size = 1"), p.where("p_type = 'ECONOMY' AND p_size < 5")), "large": (p, p.where("p_retailprice > 1000 AND p_size = 49"))}, "family")


@query("""WITH m AS (SELECT p_partkey AS l, CASE WHEN p_size % 9 > 0 THEN p_name END AS r FROM part WHERE p_size % 7 > 0 UNION ALL SELECT p_partkey, p_name FROM part WHERE p_size % 11 = 0 UNION ALL SELECT -p_partkey, 'no ' || p_name FROM part WHERE p_size = 1),
r AS (SELECT DISTINCT p_name AS k FROM part WHERE p_size < 45), s AS (SELECT DISTINCT p_name AS k FROM part WHERE p_size % 9 = 0), f AS (SELECT DISTINCT r AS k FROM m WHERE r IS NOT NULL)
SELECT 'duplicate' AS "check", l::VARCHAR AS key FROM m GROUP BY l HAVING count(*) > 1 UNION ALL SELECT 'missing', p_partkey::VARCHAR FROM part WHERE p_partkey NOT IN (SELECT l FROM m)
UNION ALL SELECT DISTINCT 'unknown_left', l::VARCHAR FROM m WHERE l NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT 'unknown_right', k FROM f WHERE k NOT IN (SELECT k FROM r)
UNION ALL SELECT 'unlisted', k FROM r WHERE k NOT IN (SELECT k FROM f) AND k NOT IN (SELECT k FROM s) UNION ALL SELECT 'both', k FROM f WHERE k IN (SELECT k FROM s) UNION ALL SELECT 'unknown_listed', k FROM s WHERE k NOT IN (SELECT k FROM r)""")
def mapping_audit(t):
    """The seven checks of a mapping of parts to names."""
    p, size = t("part"), F.col("p_size")
    own = lambda left, right, where: p.where(where).select(left.alias("left"), right.alias("right"))
    key, name = F.col("p_partkey"), F.col("p_name")
    mapping = own(key, F.when(size % 9 > 0, name), size % 7 > 0).unionByName(own(key, name, size % 11 == 0)).unionByName(own(-key, F.concat(F.lit("no "), name), size == 1))
    names = lambda where: p.where(where).select(name.alias("key"))
    return X.mapping_audit(mapping, p.select(key.alias("key")), names(size < 45), names(size % 9 == 0))


@query("SELECT p_name AS item, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS families FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def multi_assignment(t):
    return Q.multi_assigned(t("part"), "p_name", "p_brand").select(F.col("p_name").alias("item"), F.array_join("families", ",").alias("families"))


@query("SELECT p_name, p_brand, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_labels(t):
    return Q.duplicates(t("part"), "p_name", "p_brand")


@query("""SELECT coalesce(d.k, o.k) AS family, coalesce(d.n, 0) AS declared, coalesce(o.n, 0) AS observed FROM (SELECT p_brand AS k, count(*) AS n FROM part WHERE p_size <= 25 GROUP BY 1) d
FULL JOIN (SELECT p_brand AS k, count(*) AS n FROM part WHERE p_size > 25 GROUP BY 1) o ON d.k = o.k WHERE coalesce(d.n, 0) <> coalesce(o.n, 0)""")
def declared_distribution(t):
    n = lambda w: t("part").where(w).groupBy(F.col("p_brand").alias("family")).agg(F.count(F.lit(1)).alias("n"))
    return Q.declared_against_observed(n("p_size <= 25"), n("p_size > 25"), "family")


@query("""WITH s AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY p_partkey) AS n FROM s)
SELECT p_partkey, s || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS slug FROM n""")
def slug_dedupe(t):
    return P.slug_files(t("part"), "p_name", "p_partkey").select("p_partkey", "slug")


@query("""WITH r AS (SELECT p_partkey, p_name, printf('%04d', (row_number() OVER (ORDER BY p_partkey) + 299) // 300) AS shard_id FROM part), b AS (SELECT shard_id, count(*) AS n, string_agg(p_name, chr(10) ORDER BY p_partkey) || chr(10) AS b FROM r GROUP BY 1)
SELECT shard_id, n, strlen(b) AS bytes, sha256(b) AS sha256 FROM b""")
def request_shards(t):
    return P.shard_manifest(P.shards(t("part").select("p_partkey", "p_name"), "p_partkey", 300), "p_name", "p_partkey")


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_by_custom_id(t):
    e = t("events").withColumn("cid", F.concat_ws(":", "user_id", "event_type"))
    out = P.upsert(e.where("event_id < 100"), e.where("event_id >= 100"), "cid", "event_id")
    return out.select("user_id", "event_type", "event_id", "value")


@query("""WITH s AS (SELECT coalesce(nullif(source, 'src0'), 'unattributed') AS source, lpad(doc_id::VARCHAR, 9, '0') AS title FROM documents)
SELECT source, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY title) AS place, title FROM s""")
def library_listing(t):
    df = t("documents").select(F.nullif("source", F.lit("src0")).alias("source"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("title"))
    return X.library(df, "source", "title")


@query("""SELECT doc_id, field FROM (SELECT doc_id, unnest(list_filter([CASE WHEN trim(text) = '' OR text IS NULL THEN 'text' END, CASE WHEN nullif(lang, 'de') IS NULL THEN 'lang' END], lambda x: x IS NOT NULL)) AS field FROM documents)""")
def required_fields(t):
    df = t("documents").withColumn("lang", F.nullif("lang", F.lit("de")))
    return I.missing_fields(df, "doc_id", ["text", "lang"])


@query("""WITH w AS (SELECT DISTINCT p_name AS c FROM part), b AS (SELECT p_name AS c, count(*) AS n FROM (SELECT DISTINCT p_brand, p_name FROM part WHERE p_size <= 3) GROUP BY 1)
SELECT w.c AS child, CASE WHEN b.c IS NULL THEN 'unbinned' ELSE 'repeated' END AS problem FROM w LEFT JOIN b ON w.c = b.c WHERE b.c IS NULL OR n > 1""")
def bin_cover(t):
    return I.bin_cover(t("part"), "p_name", t("part").where("p_size <= 3").select("p_brand", "p_name").distinct(), "p_name")


@query("""SELECT p_partkey, CASE WHEN p_size = 1 THEN 'L1' WHEN p_size < 5 THEN 'L2' WHEN p_type = 'PROMO' THEN 'L3' ELSE 'none' END AS layer,
CASE WHEN p_size = 1 THEN 'excluded' WHEN p_size < 5 THEN p_brand WHEN p_type = 'PROMO' THEN 'new' ELSE 'unmapped' END AS decision FROM part""")
def normalization_layers(t):
    layers = [("L1", F.col("p_size") == 1, F.lit("excluded")), ("L2", F.col("p_size") < 5, F.col("p_brand")), ("L3", F.col("p_type") == "PROMO", F.lit("new"))]
    return P.layered(t("part"), layers).select("p_partkey", "layer", "decision")


@query("""SELECT p_partkey::VARCHAR AS custom_id, 'POST' AS method, '/v1/responses' AS url, '{"model":"m","input":"Name ' || p_name || ' of ' || p_brand || '"}' AS body FROM part""")
def prompt_requests(t):
    return P.requests(t("part"), "p_partkey", "m", "Name %s of %s", ["p_name", "p_brand"])


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'D' ELSE o_orderstatus END AS status FROM orders""")
def queue_transition(t):
    queue = t("orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    done = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return P.transition(queue, done, "o_orderkey", "F", "D")


@query("""SELECT n_nationkey, n_name FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS r FROM nation WHERE n_regionkey <> 0) WHERE r + (SELECT count(*) FROM nation WHERE n_regionkey = 0) <= 12""")
def admission_control(t):
    jobs = t("nation").withColumn("status", F.when(F.col("n_regionkey") == 0, "validating").otherwise("prepared"))
    return P.admitted(jobs, "n_nationkey", ["validating"], 12).select("n_nationkey", "n_name")


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE text IS NULL OR contains(text, '.')")
def changed_only(t):
    docs = t("documents")
    stored = docs.select("doc_id", F.sha2(F.replace("text", F.lit("."), F.lit(";")), 256).alias("sha256"))
    return P.unchanged_skipped(docs, "doc_id", "text", stored).select("doc_id", "sha256")


@query("SELECT event_type, count(*) || ':' || max(event_id) AS version FROM events GROUP BY 1")
def freshness_stamp(t):
    return P.freshness(t("events"), "event_type", "event_id")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'accept' WHEN o_orderstatus = 'O' THEN 'revise' ELSE 'reject' END AS verdict,
CASE WHEN o_orderstatus = 'F' THEN o_orderpriority WHEN o_orderstatus = 'O' THEN coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'fixed' END, o_orderpriority) END AS final FROM orders""")
def reviewed_drafts(t):
    o = t("orders").withColumn("id", F.col("o_orderkey").cast("string"))
    verdict = F.when(F.col("o_orderstatus") == "F", "accept").when(F.col("o_orderstatus") == "O", "revise").otherwise("reject")
    reviews = o.select(F.concat(F.lit("review:"), "id").alias("rid"), verdict.alias("v"), F.when(F.col("o_orderkey") % 2 == 0, "fixed").alias("c"))
    return J.reviewed(o, reviews, "id", "rid", "v", "o_orderpriority", "c").select("o_orderkey", "verdict", "final")


@query("""SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug, CASE WHEN p_size - 25 < 0 THEN (25 - p_size) || ' BCE' ELSE (p_size - 25) || ' CE' END AS year,
floor((p_size - 50 + p_size) / 2.0)::BIGINT AS middle, split_part('texts/public/' || p_brand || '/x.md', '/', 3) AS tradition FROM part""")
def scalar_functions(t):
    y = F.col("p_size") - 25
    path = F.concat(F.lit("texts/public/"), "p_brand", F.lit("/x.md"))
    return t("part").select("p_partkey", T.slug("p_name").alias("slug"), T.year_label(y).alias("year"), T.midpoint(F.col("p_size") - 50, F.col("p_size")).alias("middle"), T.path_tradition(path).alias("tradition"))


@query("""SELECT event_id, unnest(['k', 'deep.list.1.a', 'deep.list.2', 'deep.on']) AS path, unnest([json_extract_string(props, '$.k'), event_type, '7', 'true']) AS value FROM events""")
def flat_fields(t):
    """Leaves of documents nested three levels deep, with a list."""
    deep = F.concat(F.lit('{"list": [{"a": "'), "event_type", F.lit('"}, 7, null], "on": true, "none": {}}'))
    doc = F.concat(F.regexp_replace("props", r"\}\s*$", ""), F.lit(', "deep": '), deep, F.lit("}"))
    return X.flat_fields(t("events").select("event_id", doc.alias("doc")), "event_id", "doc")


@query("SELECT p_partkey, p_name FROM part WHERE p_type = 'ECONOMY' AND p_brand = 'Brand#2'")
def rights_gate(t):
    return X.rights_gate(t("part"), {"p_type": "ECONOMY", "p_brand": "Brand#2"}).select("p_partkey", "p_name")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts)::VARCHAR AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def trickle_stream(t):
    """Hourly counts through a stream that reads what is there and ends."""
    from ..streaming import trickle as S
    from .source_queries import folder

    spark = t("events").sparkSession
    rows = t("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    with folder(spark, "trickle") as home:
        rows.repartition(4).write.parquet(f"{home}/in")
        stream = S.trickle(spark, f"{home}/in", rows.schema, 2)
        S.drain(stream, lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{home}/out/epoch={epoch}"), f"{home}/state")
        out = S.windowed(spark.read.parquet(f"{home}/out"), "ts", "event_type")
        return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n").checkpoint()
