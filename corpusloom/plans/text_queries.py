"""Line, quotation, agreement and vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions import text as T
from ..operators import agreement as A
from ..operators import lines as D
from ..operators import quotes as S
from ..operators import vectors as V
from .registry import query

LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents)"
_FORM = "lower(trim(regexp_replace(regexp_replace({0}, '[0-9\\[\\]().:;,''\"*—–-]+', ' ', 'g'), ' +', ' ', 'g')))"
_S = "trim(line)"
_HEAD = f"(len({_S}) > 0 AND len({_S}) <= 60 AND len({_FORM.format(_S)}) >= 4 AND (regexp_matches({_S}, '[0-9]') OR {_S} = upper({_S})))"
_STOP = "[" + ", ".join(f"'{w}'" for w in L.STOPWORDS) + "]"


def lines_of(t):
    return D.to_lines(t("documents"))


@query(f"""WITH {LINES}, m AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN line_no + 3 ELSE line_no END AS line_no, line FROM l UNION ALL
  SELECT doc_id, unnest([1, 2, 3]), unnest(['---', 'title: x', '---']) FROM documents WHERE doc_id % 3 = 0)
SELECT doc_id, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY line_no)) AS text_md5 FROM m WHERE line_no BETWEEN 3 AND 6 OR (doc_id % 3 = 0 AND line_no <= 3) GROUP BY 1""")
def trimmed_range(t):
    """Lines 3 to 6 of each document, and its front matter where it has some."""
    front = F.when(F.col("doc_id") % 3 == 0, F.lit("---\ntitle: x\n---\n")).otherwise("")
    lines = D.to_lines(t("documents").withColumn("text", F.concat(front, "text")))
    out = D.trim_range(lines, 3, 6)
    n = out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))
    return n.join(D.to_text(out).select("doc_id", F.md5("text").alias("text_md5")), "doc_id")


@query(f"WITH {LINES} SELECT doc_id, {_FORM.format(_S)} AS form, count(*) AS n FROM l WHERE {_HEAD} GROUP BY ALL HAVING count(*) >= 5")
def running_headers(t):
    return D.running_headers(lines_of(t), min_repeats=5)


_OCR = f"""WITH {LINES}, h AS (SELECT doc_id, {_FORM.format(_S)} AS form FROM l WHERE {_HEAD} GROUP BY ALL HAVING count(*) >= 5),
k AS (SELECT doc_id, line_no, line FROM l WHERE NOT regexp_matches({_S}, '(?i)^Hosted by Google$|^Digiti[sz]ed by (the )?(Google|Internet Archive|Microsoft)|^https?://(www\\.)?archive\\.org')
  AND NOT regexp_matches({_S}, '^\\[?[0-9]{{1,4}}\\]?$') AND NOT ({_HEAD} AND (doc_id, {_FORM.format(_S)}) IN (SELECT doc_id, form FROM h))),
j AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS nx FROM k),
f AS (SELECT *, coalesce(regexp_matches(line, '[a-z]-$') AND regexp_matches(ltrim(nx), '^[a-z]'), FALSE) AS j FROM j),
r AS (SELECT *, sum(CASE WHEN j THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM f),
p AS (SELECT *, j AND row_number() OVER (PARTITION BY doc_id, run, j ORDER BY line_no) % 2 = 1 AS joins FROM r),
q AS (SELECT *, coalesce(lag(joins) OVER (PARTITION BY doc_id ORDER BY line_no), FALSE) AS taken FROM p),
m AS (SELECT doc_id, line_no, CASE WHEN joins THEN regexp_replace(line, '-$', '') || ltrim(nx) ELSE line END AS line FROM q WHERE NOT taken),
b AS (SELECT *, trim(line) = '' AS blank, sum(CASE WHEN trim(line) = '' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS solid FROM m),
c AS (SELECT doc_id, line_no, CASE WHEN blank THEN '' ELSE line END AS line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, solid, blank ORDER BY line_no) AS n FROM b) WHERE NOT blank OR n <= 2)"""


@query(f"{_OCR} SELECT doc_id, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY line_no)) AS text_md5 FROM c GROUP BY 1")
def ocr_clean(t):
    out = D.clean_ocr(lines_of(t), min_repeats=5)
    n = out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))
    return n.join(D.to_text(out).select("doc_id", F.md5("text").alias("text_md5")), "doc_id")


_TOKS = r"""list_filter(regexp_split_to_array(trim({0}), '\s+'), lambda x: NOT regexp_full_match(regexp_replace(x, '["''“”‘’()\[\],.!?;:*—–·]', '', 'g'), '[0-9]*'))"""
_NSTOP = "len(list_filter(list_transform({0}, lambda x: regexp_replace(lower(x), '[^a-z]', '', 'g')), lambda x: len(x) >= 3 AND list_contains(" + _STOP + ", x)))"
_SIG = r"len(list_filter({0}, lambda x: regexp_matches(x, '[^\x00-\x7F]|[a-z][A-Z]|@')))"
_PARA = f"""{LINES}, m AS (SELECT *, trim(line) <> '' AS solid, trim(line) <> '' AND coalesce(trim(lag(line) OVER (PARTITION BY doc_id ORDER BY line_no)), '') = '' AS fresh FROM l),
g AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS para_no FROM m),
pa AS (SELECT doc_id, para_no::BIGINT AS para_no, min(line_no) AS start_line, max(line_no) AS end_line, string_agg(line, chr(10) ORDER BY line_no) AS text FROM g WHERE solid GROUP BY ALL)"""


@query(f"WITH {_PARA} SELECT doc_id, para_no, start_line, end_line, md5(text) AS text_md5 FROM pa")
def paragraphs(t):
    return D.paragraphs(lines_of(t)).select("doc_id", "para_no", "start_line", "end_line", F.md5("text").alias("text_md5"))


@query(f"""WITH {_PARA}, t AS (SELECT *, {_TOKS.format('text')} AS w FROM pa), n AS (SELECT *, len(w) AS n, {_SIG.format('w')} AS f, {_NSTOP.format('w')} AS s FROM t)
SELECT doc_id, para_no FROM n WHERE n > 0 AND s = 0 AND ((f >= 2 AND f >= 0.15 * n) OR (n <= 4 AND f >= 1 AND f = n))""")
def foreign_paragraphs(t):
    return D.paragraphs(lines_of(t)).where(L.foreign(F.col("text"), min_ratio=0.15)).select("doc_id", "para_no")


@query(f"""WITH {LINES}, t AS (SELECT *, {_TOKS.format('line')} AS w, list_filter(regexp_split_to_array(trim(line), '\\s+'), lambda x: x <> '') AS a, len(regexp_replace(line, '\\s', '', 'g')) AS solid, len(regexp_replace(line, '[^A-Za-z]', '', 'g')) AS letters FROM l)
SELECT doc_id, line_no FROM t WHERE solid > 0 AND {_NSTOP.format('w')} = 0 AND (letters < 0.5 * solid OR (len(a) >= 4 AND list_sum(list_transform(a, lambda x: len(x))) / len(a) <= 2.2))""")
def garble_lines(t):
    return lines_of(t).where(L.garble(F.col("line"))).select("doc_id", "line_no")


@query(f"""WITH {LINES}, m AS (SELECT *, len(line) >= 60 AS keep, sum(CASE WHEN len(line) >= 60 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM l)
SELECT doc_id, line_no FROM (SELECT *, count(*) FILTER (regexp_matches(line, '[a-z]{{3}}')) OVER (PARTITION BY doc_id, run) AS n FROM m WHERE keep) WHERE n >= 3""")
def min_run_filter(t):
    return D.min_run(lines_of(t), F.length("line") >= 60, F.col("line").rlike("[a-z]{3}"), 3).select("doc_id", "line_no")


@query(f"""WITH {LINES} SELECT doc_id, line_no FROM (SELECT *, last_value(CASE WHEN regexp_matches(line, '^The ') THEN TRUE WHEN regexp_matches(line, '^(An|Of) ') THEN FALSE END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS st FROM l) WHERE st""")
def state_machine_keep(t):
    return D.state_machine(lines_of(t), "^The ", "^(An|Of) ").select("doc_id", "line_no")


@query(f"""WITH {LINES}, m AS (SELECT *, max(line_no) OVER (PARTITION BY doc_id) AS n FROM l), c AS (SELECT *, min(CASE WHEN regexp_matches(line, '^Th') AND line_no > n * 0.8 THEN line_no END) OVER (PARTITION BY doc_id) AS cut FROM m)
SELECT doc_id, count(*) AS n_lines FROM c WHERE cut IS NULL OR line_no < cut GROUP BY 1""")
def tail_cut(t):
    return D.tail_cut(lines_of(t), "^Th").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))


_LINT = f"""WITH {LINES}, x AS (SELECT *, max(line_no) OVER (PARTITION BY doc_id) AS lst, sum(regexp_matches(line, '^[ \\t]*(```|~~~)')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS fences FROM l),
y AS (SELECT *, trim(line) = '' AND (line_no < lst OR line <> '') AS blank, regexp_replace(line, '`[^`\\n]*`', '', 'g') AS body FROM x),
z AS (SELECT *, sum((NOT blank)::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS solid FROM y),
w AS (SELECT *, row_number() OVER (PARTITION BY doc_id, solid, blank ORDER BY line_no) AS n, fences % 2 = 0 AS prose FROM z)"""
_SCRIPT, _TAG = f"regexp_matches(body, '{D.SCRIPT_TAG}')", f"regexp_matches(body, '{D.HTML_TAG}')"


@query(f"""{_LINT} SELECT doc_id, line_no, 'missing final newline' AS rule FROM w WHERE line_no = lst AND line <> ''
UNION ALL SELECT doc_id, line_no, 'trailing whitespace' FROM w WHERE regexp_matches(line, '[ \\t]+$')
UNION ALL SELECT doc_id, line_no, 'control character' FROM w WHERE regexp_matches(line, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]')
UNION ALL SELECT doc_id, line_no - 2, 'excessive blank lines' FROM w WHERE blank AND n = 3
UNION ALL SELECT doc_id, line_no, 'script/style tag' FROM w WHERE prose AND {_SCRIPT}
UNION ALL SELECT doc_id, line_no, 'raw HTML tag' FROM w WHERE prose AND NOT {_SCRIPT} AND {_TAG} AND NOT regexp_matches(body, '^\\s*<!--.*-->\\s*$')
UNION ALL SELECT doc_id, line_no, 'undecoded HTML entity' FROM w WHERE prose AND regexp_matches(body, '{D.HTML_ENTITY}')
UNION ALL SELECT doc_id, line_no, 'distributor boilerplate' FROM w WHERE prose AND regexp_matches(trim(line), '{"|".join(L.DISTRIBUTOR)}')""")
def markdown_lint(t):
    return D.lint(lines_of(t))


@query(r"""SELECT doc_id, array_to_string(list_slice(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.?!]) +', '\1' || chr(10), 'g'), chr(10)), 1, 2), ' ') AS opening FROM documents""")
def first_sentences(t):
    return t("documents").select("doc_id", T.first_sentences("text", 2).alias("opening"))


_QUOTES = "'" + '"' * 4 + "''" * 4 + "--'"
_NORM = "trim(regexp_replace(replace(translate({0}, '“”„‟‘’‚‛–—', " + _QUOTES + r"), '…', '...'), '[ \t\n\x0B\f\r]+', ' ', 'g'))"


_FOUND = r"""CASE WHEN len(parts) <= 1 THEN contains(d, q) ELSE len(list_filter(parts, lambda x: NOT contains(d, x))) = 0 END"""
_PARTS = r"list_filter(list_transform(string_split_regex(q, '\[\.\.\.\]|\.{3,}'), lambda x: trim(x)), lambda x: len(x) >= 12)"
_WORDS = "string_split(text, ' ')"


@query(f"""WITH b AS (SELECT item_id, text FROM benchmark UNION ALL SELECT item_id + 100000, array_to_string({_WORDS}[3:5], ' ') FROM benchmark
  UNION ALL SELECT item_id + 200000, array_to_string({_WORDS}[2:5], ' ') || ' ... ' || array_to_string({_WORDS}[8:18], ' ') FROM benchmark
  UNION ALL SELECT item_id + 300000, array_to_string({_WORDS}[2:4], ' ') || ' [...] ' || array_to_string({_WORDS}[6:8], ' ') FROM benchmark),
q AS (SELECT item_id, {_NORM.format('text')} AS q, {_PARTS} AS parts FROM (SELECT item_id, text, {_NORM.format('text')} AS q FROM b)), d AS (SELECT doc_id, {_NORM.format('text')} AS d FROM documents)
SELECT item_id, count(doc_id) AS n_docs, CASE WHEN count(doc_id) > 0 THEN 'verified' ELSE 'failed' END AS status FROM q LEFT JOIN d ON {_FOUND} GROUP BY item_id""")
def quote_verification(t):
    """Quotations looked up in all documents: whole passages, a few words of each, and passages with an ellipsis between long or short parts."""
    words = F.split("text", " ")
    some = lambda a, b: F.array_join(F.slice(words, a, b - a + 1), " ")
    b = t("benchmark")
    shift = lambda n, text: b.select((F.col("item_id") + n).alias("item_id"), text.alias("quote"))
    quotes = shift(0, F.col("text")).unionByName(shift(100_000, some(3, 5))).unionByName(shift(200_000, F.concat_ws(" ... ", some(2, 5), some(8, 18)))).unionByName(shift(300_000, F.concat_ws(" [...] ", some(2, 4), some(6, 8))))
    quotes = quotes.withColumn("item_id", F.col("item_id").cast(b.schema["item_id"].dataType))
    n = S.quote_pairs(quotes, t("documents"), "item_id", "doc_id").groupBy(F.col("item_id").alias("i")).agg(F.count(F.lit(1)).alias("n"))
    out = quotes.join(n, F.col("item_id") == F.col("i"), "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n_docs"))
    return out.withColumn("status", F.when(F.col("n_docs") > 0, "verified").otherwise("failed"))


_READ = "r AS (SELECT event_type AS run, user_id AS passage, list_sort(list_distinct(list(json_extract_string(props, '$.k')))) AS refs FROM events GROUP BY ALL)"


def readings(t):
    return t("events").withColumn("k", F.get_json_object("props", "$.k"))


@query(f"""WITH {_READ}, p AS (SELECT x.run AS run_a, y.run AS run_b, len(list_intersect(x.refs, y.refs)) AS i, len(x.refs) + len(y.refs) - len(list_intersect(x.refs, y.refs)) AS u, (x.refs = y.refs)::INT AS e FROM r x JOIN r y ON x.passage = y.passage AND x.run < y.run)
SELECT run_a, run_b, count(*) AS shared, round(avg(CASE WHEN u = 0 THEN 1 ELSE i / u END), 4) AS mean_jaccard, round(avg(e), 4) AS exact_rate FROM p GROUP BY ALL""")
def replication_agreement(t):
    return A.pairwise(A.reading_sets(readings(t), "event_type", "user_id", "k"))


@query(f"""WITH e AS (SELECT event_type AS run, user_id AS passage, json_extract_string(props, '$.k') AS k FROM events),
r AS (SELECT run, passage, list_distinct(list(k)) AS refs, list_distinct(list(nullif(k::INTEGER // 10, 3))) AS canon FROM e GROUP BY ALL),
p AS (SELECT x.run AS run_a, y.run AS run_b, list_sort(x.canon) = list_sort(y.canon) AS same, len(list_intersect(x.refs, y.refs)) AS i, len(list_distinct(x.refs || y.refs)) AS u,
  len(list_intersect(x.canon, y.canon)) AS ci, len(list_distinct(x.canon || y.canon)) AS cu FROM r x JOIN r y ON x.passage = y.passage AND x.run < y.run)
SELECT run_a, run_b, count(*) AS shared, round(avg(CASE WHEN u = 0 THEN 1 ELSE i / u END), 4) AS mean_raw_jaccard, round(avg(CASE WHEN cu = 0 THEN 1 ELSE ci / cu END), 4) AS mean_canonical_jaccard,
round(avg(same::INT), 4) AS exact_canonical_rate FROM p GROUP BY ALL""")
def canonical_agreement(t):
    """Agreement of runs on raw references and on the groups that these resolve to; one group of references has none."""
    k = F.col("k").cast("int")
    mapping = readings(t).select("k", F.nullif(F.floor(k / 10).cast("string"), F.lit("3")).alias("group_id")).where("group_id IS NOT NULL").distinct()
    return A.pairwise_canonical(A.reading_sets(readings(t), "event_type", "user_id", "k"), mapping, "k", "group_id")


@query("""WITH v AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN lang END AS honeypot, CASE WHEN quality = 0 THEN 'reject' WHEN toxic = 1 THEN 'revise' ELSE 'accept' END AS verdict FROM labels JOIN documents USING (doc_id))
SELECT 'verdict' AS part, verdict AS name, count(*) AS n, NULL::DOUBLE AS rate FROM v WHERE honeypot IS NULL GROUP BY 2
UNION ALL SELECT 'honeypot', honeypot, count(*), round(count(*) FILTER (verdict IN ('revise', 'reject')) / count(*), 3) FROM v WHERE honeypot IS NOT NULL GROUP BY 2
UNION ALL SELECT 'total', 'records_gated', count(*), NULL FROM v WHERE honeypot IS NULL UNION ALL SELECT 'total', 'escalations', count(*), NULL FROM v WHERE honeypot IS NULL AND verdict = 'reject'""")
def gate_report(t):
    """A gate's verdicts on real records, its sensitivity to seeded ones by kind, and how many records go to a second reader."""
    return A.gate_report(_verdicts(t), "honeypot", "verdict")


def _verdicts(t):
    both = t("labels").join(t("documents").select("doc_id", "lang"), "doc_id")
    verdict = F.when(F.col("quality") == 0, "reject").when(F.col("toxic") == 1, "revise").otherwise("accept")
    return both.select("doc_id", F.when(F.col("doc_id") % 6 == 0, F.col("lang")).alias("honeypot"), verdict.alias("verdict"))


@query("SELECT doc_id FROM labels JOIN documents USING (doc_id) WHERE doc_id % 6 <> 0 AND quality = 0")
def escalations(t):
    """Real records that the gate rejects."""
    return A.escalated(_verdicts(t), "honeypot", "verdict").select("doc_id")


@query("""WITH l AS (SELECT DISTINCT user_id, event_type, json_extract_string(props, '$.k') AS k FROM events), c AS (SELECT user_id, k, count(*) AS readers FROM l GROUP BY ALL)
SELECT user_id AS passage, k AS family, readers, CASE WHEN readers >= 3 THEN 'confirmed' WHEN readers = 2 THEN 'corroborated' ELSE 'provisional' END AS tier FROM c WHERE user_id IN (SELECT user_id FROM l GROUP BY 1 HAVING count(DISTINCT event_type) >= 2)""")
def consensus_tiers(t):
    out = A.consensus(readings(t).withColumn("line", F.col("event_type")), "user_id", "event_type", "k", "line")
    return out.select(F.col("user_id").alias("passage"), F.col("k").alias("family"), "readers", "tier")


@query("SELECT event_type, count(DISTINCT user_id) FILTER (value >= 1) AS parsed, count(*) FILTER (value < 1) AS parse_failed FROM events GROUP BY 1")
def parse_stats(t):
    return A.parse_stats(t("events").withColumn("ok", F.col("value") >= 1), "event_type", "user_id", "ok")


@query("SELECT lang AS kind, count(*) FILTER (quality = 0) AS caught, count(*) AS total, round(count(*) FILTER (quality = 0) / count(*), 3) AS sensitivity FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def gate_sensitivity(t):
    v = t("labels").join(t("documents").select("doc_id", "lang"), "doc_id").withColumn("bad", F.col("quality") == 0)
    return A.gate_sensitivity(v, "lang", "bad").withColumnRenamed("lang", "kind")


@query("SELECT DISTINCT doc_id FROM labels WHERE quality = 0 AND doc_id IN (SELECT doc_id FROM documents WHERE regexp_matches(text, '[#*$%&]{3}')) AND doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def suspect_intersection(t):
    docs = t("documents")
    return A.suspects(t("labels").where("quality = 0"), docs.where(F.col("text").rlike("[#*$%&]{3}")), docs.where("lang = 'en'"), "doc_id")


_GATES = "v AS (SELECT lang, quality = 0 AS a, regexp_matches(text, '[#*$%&]{3}') AS b FROM labels JOIN documents USING (doc_id))"


def gates(t):
    both = t("labels").join(t("documents").select("doc_id", "lang", "text"), "doc_id")
    return both.select("lang", (F.col("quality") == 0).alias("a"), F.col("text").rlike("[#*$%&]{3}").alias("b"))


@query(f"WITH {_GATES} SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b, count(*) FILTER (NOT a AND NOT b) AS neither, round(count(*) FILTER (a = b) / count(*), 4) AS agreement FROM v")
def gate_agreement(t):
    return A.gate_agreement(gates(t), "a", "b")


@query(f"WITH {_GATES} SELECT lang AS tier, round(count(*) FILTER (a) / (SELECT count(*) FROM v WHERE a), 4) AS share_rejected, round(count(*) / (SELECT count(*) FROM v), 4) AS share_all FROM v GROUP BY 1")
def gate_enrichment(t):
    return A.enrichment(gates(t), "lang", "a").withColumnRenamed("lang", "tier")


_UNIT = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings)"


@query(f"""WITH {_UNIT}, p AS (SELECT x.label, x.vec_id AS a, y.vec_id AS b, list_inner_product(x.v, y.v) AS c FROM u x JOIN u y ON x.label = y.label AND x.vec_id < y.vec_id)
SELECT label, a, b, round(c, 4) AS cosine, a AS keep FROM p WHERE c >= 0.35 ORDER BY cosine DESC, a, b LIMIT 2000""")
def synonym_merge(t):
    return V.cosine_pairs(t("embeddings"), "label", "vec_id", "embedding", 0.35)


@query(f"""WITH {_UNIT}, p AS (SELECT x.vec_id AS query, y.vec_id, round(list_inner_product(x.v, y.v), 4) AS cosine FROM u x JOIN u y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE x.vec_id % 20 = 0)
SELECT query, vec_id, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) AS rank FROM p) WHERE rank <= 3""")
def nearest_neighbours(t):
    out = V.nearest(t("embeddings").where("vec_id % 20 = 0"), t("embeddings"), "vec_id", "embedding", "label", 3)
    return out.withColumn("rank", F.col("rank").cast("long"))


@query("SELECT CASE WHEN vec_id % 7 = 0 THEN 'request_error' WHEN vec_id % 5 = 0 THEN 'unknown_id' WHEN vec_id % 3 = 0 THEN 'wrong_size' ELSE 'ok' END AS status, count(*) AS n FROM embeddings GROUP BY 1")
def embedding_ingest(t):
    rows = t("embeddings").withColumn("code", F.when(F.col("vec_id") % 7 == 0, 500).otherwise(200))
    rows = rows.withColumn("embedding", F.when(F.col("vec_id") % 3 == 0, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")))
    out = V.embedding_status(rows, t("embeddings").where("vec_id % 5 <> 0"), "vec_id", "embedding", "code", 64)
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_UNIT}, x AS (SELECT vec_id % 2 AS pile, (vec_id // 2) % 8 AS cluster, unnest(v) AS x, unnest(range(len(v))) AS i FROM u), m AS (SELECT pile, cluster, i, avg(x) AS x FROM x GROUP BY ALL),
c AS (SELECT pile, cluster, list(x ORDER BY i) AS v, sqrt(sum(x * x)) AS n FROM m GROUP BY ALL),
p AS (SELECT a.cluster, b.cluster AS partner, list_inner_product(a.v, b.v) / (a.n * b.n) AS c FROM c a JOIN c b ON a.pile = 0 AND b.pile = 1)
SELECT cluster, partner, round(c, 4) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY c DESC, partner) AS r FROM p) WHERE r = 1""")
def centroid_alignment(t):
    """Two piles with given clusters, their centroids aligned."""
    df = t("embeddings").withColumn("cluster", F.floor(F.col("vec_id") / 2) % 8)
    return V.aligned(*[V.centroids(df.where(w), "cluster", "embedding") for w in ("vec_id % 2 = 0", "vec_id % 2 = 1")])


@query("SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS chain, count(*) AS n FROM conversations GROUP BY 1")
def conversation_chains(t):
    rows = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return t("conversations").groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: r["role"]), ">").alias("chain"), F.count(F.lit(1)).alias("n"))
