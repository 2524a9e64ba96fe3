"""Line classifiers, cleaning steps, integrity checks, windows and statistics, each over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions import text as T
from ..operators import agreement as A
from ..operators import frequency as N
from ..operators import integrity as I
from ..operators import lines as D
from ..operators import pipeline as P
from ..operators import sets as S
from ..operators import vectors as V
from ..operators import windows as W
from .registry import query
from .text_queries import _NSTOP, _PARA, _READ, _SIG, _STOP, _TOKS, LINES, lines_of, readings


@query(f"""WITH {LINES}, t AS (SELECT *, {_TOKS.format('line')} AS w, list_filter(regexp_split_to_array(trim(line), '\\s+'), lambda x: x <> '') AS a, len(regexp_replace(line, '\\s', '', 'g')) AS solid, len(regexp_replace(line, '[^A-Za-z]', '', 'g')) AS letters,
  regexp_extract(trim(line), '^[0-9]{{1,4}}\\s+(.*)$', 1) AS rest, list_filter(list_transform(regexp_split_to_array(trim(line), '\\s+'), lambda x: regexp_replace(lower(x), '[^a-zāēīōū]', '', 'g')), lambda x: x <> '') AS p FROM l),
u AS (SELECT *, {_NSTOP.format('w').replace('len(x) >= 3 AND ', '')} AS s, {_SIG.format('w')} AS f, len(list_filter(w, lambda x: regexp_matches(x, '^[A-Za-z]{{5,}}[.,;:!?]?$') AND regexp_matches(x, '(?i)[aeiou]') AND NOT regexp_matches(x, '[^\\x00-\\x7F]|[a-z][A-Z]|@'))) AS content FROM t)
SELECT doc_id, count(*) FILTER (trim(line) <> '' AND NOT regexp_matches(line, '[A-Za-z]{{3,}}')) AS no_word,
  count(*) FILTER (len(rest) BETWEEN 1 AND 50 AND len(regexp_replace(rest, '[^A-Za-z]', '', 'g')) >= 4 AND len(regexp_replace(rest, '[^A-Z]', '', 'g')) >= 0.7::DOUBLE * len(regexp_replace(rest, '[^A-Za-z]', '', 'g'))) AS verso,
  count(*) FILTER (solid > 0 AND letters < 0.4::DOUBLE * solid AND NOT regexp_matches(line, '[A-Za-z]{{4}}') AND len(list_filter(a, lambda x: regexp_matches(x, '^[A-Za-z]{{2,}}[.,;:!?]?$'))) < 0.5::DOUBLE * len(a)) AS soup,
  count(*) FILTER (len(w) >= 3 AND s = 0 AND NOT (trim(line) = upper(trim(line)) AND regexp_matches(line, '[A-Z]'))) AS no_stopword,
  count(*) FILTER (len(p) >= 3 AND NOT list_has_any(p, {_STOP}) AND len(list_filter(p, lambda x: regexp_matches(x, '[aeiouāēīōū]$'))) >= 0.66::DOUBLE * len(p)) AS vowel_final,
  count(*) FILTER (CASE WHEN content > 0 THEN FALSE WHEN f > 0 THEN TRUE ELSE len(w) >= 5 AND list_sum(list_transform(w, lambda x: len(regexp_replace(x, '[^A-Za-z]', '', 'g')))) / len(w) <= 2.7 END) AS short_tokens
FROM u GROUP BY 1""")
def line_verdicts(t):
    """How many lines of each document each line classifier flags."""
    line = F.col("line")
    flags = {
        "no_word": L.no_word(line), "verso": L.verso_caps_header(line), "soup": L.glyph_soup(line), "no_stopword": L.no_stopword(line),
        "vowel_final": L.vowel_final(line), "short_tokens": L.short_tokens(line),
    }
    return lines_of(t).groupBy("doc_id").agg(*[F.count_if(c).alias(n) for n, c in flags.items()])


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '(?m)[ \t]+$', '', 'g'), '\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g')) AS plain_md5,
  md5(regexp_replace(text, '([a-z,;])[ \t]*\n[ \t]*\n[ \t]*([a-z])', '\1 \2', 'g')) AS rejoined_md5, md5(regexp_replace(translate(text, '<>', '()'), ' {2,}', ' ', 'g')) AS angles_md5,
  md5(left(array_to_string(list_slice(string_split(text, chr(10)), 1, 60), chr(10)), 4000)) AS opening_md5,
  md5(regexp_replace(replace(text, 'e' || chr(10), 'e¬' || chr(10)), '¬\s*\n\s*', '', 'g')) AS soft_md5 FROM documents""")
def text_rewrites(t):
    soft = F.replace("text", F.lit("e\n"), F.lit("e¬\n"))
    rewrites = {"plain": D.plain(F.col("text")), "rejoined": D.rejoin_paragraphs(F.col("text")), "angles": D.neutral_angles(F.col("text")), "opening": D.opening(F.col("text")), "soft": D.soft_hyphens(soft)}
    return t("documents").select("doc_id", *[F.md5(c).alias(f"{n}_md5") for n, c in rewrites.items()])


@query(f"""WITH {LINES}, a AS (SELECT *, min(CASE WHEN regexp_matches(line, '^Th') THEN line_no END) OVER (PARTITION BY doc_id) AS a0 FROM l),
b AS (SELECT *, min(CASE WHEN regexp_matches(line, '^(A|O)') AND line_no > a0 THEN line_no END) OVER (PARTITION BY doc_id) AS b0 FROM a),
c AS (SELECT *, min(CASE WHEN regexp_matches(line, '^I') AND line_no > b0 THEN line_no END) OVER (PARTITION BY doc_id) AS a1 FROM b),
d AS (SELECT *, min(CASE WHEN regexp_matches(line, '^E') AND line_no > a1 THEN line_no END) OVER (PARTITION BY doc_id) AS b1 FROM c)
SELECT doc_id, line_no FROM d WHERE (line_no >= a0 AND line_no < coalesce(b0, 2147483647)) OR (line_no >= a1 AND line_no < coalesce(b1, 2147483647))""")
def marker_ranges(t):
    return D.between_markers(lines_of(t), [("^Th", "^(A|O)"), ("^I", "^E")]).select("doc_id", "line_no")


@query(f"""WITH {LINES}, p AS (SELECT *, len(list_filter(regexp_split_to_array(trim(line), '\\s+'), lambda x: regexp_matches(x, '[A-Za-z]{{2,}}'))) < 2 AS poor FROM l),
r AS (SELECT *, sum((NOT poor)::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM p), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, run, poor) AS n FROM r),
s AS (SELECT *, min(CASE WHEN poor AND n >= 2 THEN line_no END) OVER (PARTITION BY doc_id) AS stop FROM n)
SELECT doc_id, count(*) AS n_lines FROM s WHERE stop IS NULL OR line_no < stop GROUP BY 1""")
def garble_stop(t):
    return D.stop_at_garble(lines_of(t), least=2).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))


@query(f"""WITH {_PARA}, b AS (SELECT *, len(regexp_replace(text, '\\s', '', 'g')) AS solid, len(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters, len(text) - len(regexp_replace(text, '[\\^\\\\]', '', 'g')) AS marks, {_TOKS.format('text')} AS w FROM pa)
SELECT doc_id, para_no FROM b WHERE len(string_split(text, chr(10))) >= 3 AND letters >= 0.65::DOUBLE * solid AND marks < 2 AND {_SIG.format('w')} < 0.34::DOUBLE * greatest(len(w), 1)""")
def quality_blocks(t):
    return D.quality_blocks(lines_of(t)).select("doc_id", "para_no")


@query(f"""WITH {LINES}, m AS (SELECT *, max(CASE WHEN regexp_matches(line, '^(O|T)') THEN line_no END) OVER (PARTITION BY doc_id) AS m, len(list_filter(regexp_split_to_array(trim(line), '\\s+'), lambda x: regexp_matches(x, '[A-Za-z]'))) >= 2 AS worded FROM l),
e AS (SELECT *, coalesce(max(CASE WHEN worded AND line_no < m THEN line_no END) OVER (PARTITION BY doc_id), 0) AS e FROM m)
SELECT doc_id, count(*) AS n_lines FROM e WHERE m IS NULL OR line_no <= e GROUP BY 1""")
def tail_backtrack(t):
    return D.tail_backtrack(lines_of(t), "^(O|T)").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))


@query(f"""WITH {LINES}, g AS (SELECT *, CASE WHEN coalesce(bool_or(line_no = 2 AND regexp_matches(line, '[a-z]')) OVER (PARTITION BY doc_id), FALSE) THEN 'trimmed' ELSE 'aborted' END AS status FROM l)
SELECT doc_id, status, count(*) AS n_lines FROM g WHERE status = 'aborted' OR line_no BETWEEN 2 AND 5 GROUP BY ALL""")
def guarded_trim(t):
    return D.guarded_trim(lines_of(t), 2, 5, "[a-z]").groupBy("doc_id", "status").agg(F.count(F.lit(1)).alias("n_lines"))


@query(f"WITH {LINES} SELECT doc_id, line_no FROM l WHERE trim(line) NOT IN (SELECT trim(line) FROM l GROUP BY line HAVING count(*) >= 3)")
def listed_lines(t):
    lines = lines_of(t)
    listed = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    return D.drop_listed(lines, listed).select("doc_id", "line_no")


@query(f"""WITH {LINES}, x AS (SELECT doc_id, line_no, CASE WHEN regexp_matches(line, '^Th') THEN '## ' || substr(line, 1, 6) ELSE line END AS line FROM l),
h AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{2,3}} ') THEN trim(regexp_replace(line, '^#{{2,3}} ', '')) END AS h FROM x),
s AS (SELECT *, last_value(h IGNORE NULLS) OVER w AS heading, last_value(CASE WHEN h IS NOT NULL THEN line_no END IGNORE NULLS) OVER w AS start_line FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
g AS (SELECT doc_id, heading, start_line, max(line_no) AS end_line, trim(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (h IS NULL), '')) AS body FROM s WHERE heading IS NOT NULL AND NOT regexp_matches(line, '^# ') GROUP BY ALL)
SELECT doc_id, heading, start_line, end_line, md5(body) AS body_md5 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, heading ORDER BY start_line DESC) AS r FROM g) WHERE r = 1""")
def heading_sections(t):
    lines = lines_of(t).withColumn("line", F.when(F.col("line").rlike("^Th"), F.concat(F.lit("## "), F.substring("line", 1, 6))).otherwise(F.col("line")))
    return D.sections(lines).select("doc_id", "heading", "start_line", "end_line", F.md5("body").alias("body_md5"))


@query(r"""WITH f AS (SELECT doc_id, array_to_string(list_slice(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.?!]) +', '\1' || chr(10), 'g'), chr(10)), 1, 3), ' ') AS t FROM documents)
SELECT doc_id, CASE WHEN len(t) <= 480 THEN t ELSE coalesce(nullif(regexp_extract(left(t, 480), '(?s)^(.*[.?!])', 1), ''), left(t, 480)) END AS quote FROM f""")
def evidence_quotes(t):
    return t("documents").select("doc_id", T.evidence_quote("text").alias("quote"))


@query("SELECT conv_id, turn, coalesce(nullif(trim(concat_ws(chr(10), text, role)), ''), 'none') AS response FROM conversations")
def response_texts(t):
    part = lambda kind, c: F.struct(F.lit(kind).alias("type"), F.col(c).alias("text"))
    parts = F.array(part("message", "text"), part("reasoning", "role"), part("message", "role"))
    return t("conversations").select("conv_id", "turn", T.response_text(parts, F.lit("none")).alias("response"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def lenient_payloads(t):
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    wrapped = F.when(F.col("event_id") % 2 == 0, fenced).otherwise(F.concat(F.lit("So: "), F.col("props"), F.lit(" as asked")))
    return t("events").select("event_id", T.lenient_json(wrapped, "k bigint")["k"].alias("k"))


@query("SELECT 'nation' AS collection, n_name AS name, n_regionkey AS regionkey, n_nationkey AS nationkey FROM nation UNION ALL SELECT 'region', r_name, r_regionkey, NULL FROM region")
def collection_union(t):
    nation = t("nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("regionkey"), F.col("n_nationkey").alias("nationkey"))
    return S.atlas({"nation": nation, "region": t("region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("regionkey"))})


@query(f"""WITH {LINES}, n AS (SELECT doc_id, max(line_no) AS n FROM l GROUP BY 1), r AS (SELECT doc_id, doc_id % 7 AS a, n_chars % 50 AS b FROM documents)
SELECT doc_id FROM r LEFT JOIN n USING (doc_id) WHERE NOT coalesce(a >= 1 AND a <= b AND b <= n, FALSE)""")
def line_range_check(t):
    records = t("documents").select("doc_id", (F.col("doc_id") % 7).alias("a"), (F.col("n_chars") % 50).alias("b"))
    return I.bad_line_ranges(records, lines_of(t), "doc_id", "a", "b").select("doc_id")


_FLAGS = "r AS (SELECT l_orderkey, list(l_returnflag) AS ids, list_distinct(list(l_linestatus)) AS known FROM lineitem GROUP BY 1)"


def _records(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("ids"), F.collect_set("l_linestatus").alias("known"))


@query(f"WITH {_FLAGS} SELECT l_orderkey FROM r WHERE len(ids) <> len(list_distinct(ids))")
def repeated_ids(t):
    return I.repeated_ids(_records(t), "ids").select("l_orderkey")


@query(f"""WITH {_FLAGS}, m AS (SELECT l_orderkey, list_sort(list_filter(list_distinct(ids), lambda x: NOT list_contains(known, x))) AS m FROM r)
SELECT l_orderkey, array_to_string(m, ',') AS missing FROM m WHERE len(m) > 0""")
def dangling_references(t):
    return I.dangling_within(_records(t), "ids", "known").select("l_orderkey", F.array_join(F.array_sort("missing"), ",").alias("missing"))


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000 UNION ALL SELECT n_nationkey FROM nation WHERE n_regionkey = 0)")
def outside_vocabulary(t):
    return I.outside_vocabulary(t("customer"), "c_nationkey", (t("supplier").where("s_acctbal > 9000"), "s_nationkey"), (t("nation").where("n_regionkey = 0"), "n_nationkey")).select("c_custkey")


@query("SELECT o_custkey, o_orderkey, coalesce(sum(o_orderkey % 7) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM orders")
def dealt_offsets(t):
    sets = t("orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 7).alias("size"))
    return W.offsets(sets, "o_custkey", "o_orderkey", "size").select("o_custkey", "o_orderkey", "start")


@query("SELECT c_nationkey, count(*) AS n, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS keys FROM customer GROUP BY 1")
def ordered_groups(t):
    out = W.ordered_lists(t("customer"), "c_nationkey", ["c_custkey"])
    return out.select("c_nationkey", "n", F.array_join(F.transform("rows", lambda r: r["c_custkey"].cast("string")), ",").alias("keys"))


@query("SELECT o_custkey, string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey) AS listed FROM orders GROUP BY 1")
def occurrence_lists(t):
    out = N.occurrence_lists(t("orders"), "o_custkey", ["o_orderkey"], ["o_orderstatus"])
    shown = F.transform("occurrences", lambda r: F.concat(r["o_orderkey"].cast("string"), F.lit(":"), r["o_orderstatus"]))
    return out.select("o_custkey", F.array_join(shown, ",").alias("listed"))


@query(f"""WITH {_READ}, p AS (SELECT x.run AS run_a, y.run AS run_b, x.passage % 3 AS tradition, len(list_intersect(x.refs, y.refs)) AS i, len(x.refs) + len(y.refs) - len(list_intersect(x.refs, y.refs)) AS u FROM r x JOIN r y ON x.passage = y.passage AND x.run < y.run)
SELECT run_a, run_b, tradition, count(*) AS shared, round(avg(CASE WHEN u = 0 THEN 1 ELSE i / u END), 4) AS mean_jaccard FROM p GROUP BY ALL""")
def agreement_by_tradition(t):
    groups = t("events").select(F.col("user_id").alias("passage"), (F.col("user_id") % 3).alias("tradition")).distinct()
    return A.pairwise_by(A.reading_sets(readings(t), "event_type", "user_id", "k"), groups, "tradition")


@query("SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS source FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority = '1-URGENT'")
def queue_selection(t):
    queue = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("source"))
    return P.queue_scan(queue, ["O", "P"], source="1-URGENT")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_custkey % 5 = o_orderkey % 5")
def reviewer_guard(t):
    drafts = t("orders").withColumn("drafter", F.col("o_custkey") % 5).withColumn("reviewer", F.col("o_orderkey") % 5)
    return P.same_reviewer(S.training_gate(drafts, "o_orderstatus", ("F", "P")), "drafter", "reviewer").select("o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey) >= 12)")
def large_groups(t):
    return S.large_groups(t("orders"), "o_custkey", "o_orderkey", 12).select("o_custkey", "o_orderkey")


@query("""WITH e AS (SELECT r_name AS era, 1992 + 2 * r_regionkey AS a FROM region) SELECT era, count(*) AS n FROM orders JOIN e ON year(o_orderdate) >= a AND year(o_orderdate) < a + 2 GROUP BY 1""")
def era_ranges(t):
    eras = t("region").select(F.col("r_name").alias("era"), (1992 + 2 * F.col("r_regionkey")).alias("start"), (1994 + 2 * F.col("r_regionkey")).alias("end"))
    return N.era_join(t("orders").withColumn("year", F.year("o_orderdate")), "year", eras).groupBy("era").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT round(avg(l_quantity), 2) AS mean, round(stddev_pop(l_quantity), 2) AS sd, max(l_quantity) AS most FROM lineitem")
def value_moments(t):
    return N.mean_sd(t("lineitem"), "l_quantity")


@query("""WITH r AS (SELECT rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2 AS x, rank() OVER (ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_nationkey) - 1) / 2 AS y FROM customer),
u AS (SELECT x, sum(a) AS a, sum(b) AS b FROM (SELECT floor(c_acctbal) AS x, 1 AS a, 0 AS b FROM customer UNION ALL SELECT floor(s_acctbal), 0, 1 FROM supplier) GROUP BY 1),
k AS (SELECT abs(sum(a) OVER (ORDER BY x) / sum(a) OVER () - sum(b) OVER (ORDER BY x) / sum(b) OVER ()) AS g FROM u)
SELECT (SELECT round(corr(x, y), 4) FROM r) AS spearman, (SELECT round(max(g), 4) FROM k) AS ks""")
def rank_statistics(t):
    a, b = t("customer").select(F.floor("c_acctbal").alias("v")), t("supplier").select(F.floor("s_acctbal").alias("v"))
    return V.spearman(t("customer"), "c_acctbal", "c_nationkey").join(F.broadcast(V.ks_distance(a, b, "v")))  # one row each


_VOWELS = "len(list_filter(p, lambda x: regexp_matches(x, '[aeiouāēīōū]$')))"


def _ratio_sql(least: int, ratio: float, short: int) -> str:
    return f"len(w) > 0 AND s = 0 AND ((f >= {least} AND f >= {ratio}::DOUBLE * len(w)) OR (len(w) <= {short} AND f >= 1 AND f = len(w)))"


def _vowel_sql(words: int, ratio: float, particles: str = "") -> str:
    return f"len(p) >= {words} AND NOT list_has_any(p, {_STOP}) AND {_VOWELS} >= {ratio}::DOUBLE * len(p)" + (f" AND list_has_any(p, {particles})" if particles else "")


@query(f"""WITH {LINES}, t AS (SELECT *, {_TOKS.format('line')} AS w,
  list_filter(list_transform(regexp_split_to_array(trim(line), '\\s+'), lambda x: regexp_replace(lower(x), '[^a-zāēīōū]', '', 'g')), lambda x: x <> '') AS p FROM l),
u AS (SELECT *, {_NSTOP.format('w')} AS s, {_SIG.format('w')} AS f FROM t)
SELECT doc_id, count(*) FILTER ({_ratio_sql(2, 0.15, 4)}) AS share_15, count(*) FILTER ({_ratio_sql(3, 0.15, 4)}) AS three_15, count(*) FILTER ({_ratio_sql(2, 0.34, 2)}) AS share_34, count(*) FILTER ({_ratio_sql(2, 0.4, 2)}) AS share_40,
  count(*) FILTER ({_vowel_sql(3, 0.6)}) AS vowel_60, count(*) FILTER ({_vowel_sql(3, 0.7)}) AS vowel_70, count(*) FILTER ({_vowel_sql(2, 0.72)}) AS two_words_72, count(*) FILTER ({_vowel_sql(3, 0.6, "['ka', 'la', 'te', 'no']")}) AS particles FROM u GROUP BY 1""")
def classifier_family(t):
    """How many lines of each document each setting of the two classifier families flags."""
    line = F.col("line")
    flags = {
        "share_15": L.foreign(line, min_ratio=0.15), "three_15": L.foreign(line, min_flags=3, min_ratio=0.15), "share_34": L.foreign(line, min_ratio=0.34, short_words=2),
        "share_40": L.foreign(line, min_ratio=0.4, short_words=2), "vowel_60": L.vowel_final(line, ratio=0.6), "vowel_70": L.vowel_final(line, ratio=0.7),
        "two_words_72": L.vowel_final(line, ratio=0.72, min_words=2), "particles": L.vowel_final(line, ratio=0.6, particles=("ka", "la", "te", "no")),
    }
    return lines_of(t).groupBy("doc_id").agg(*[F.count_if(c).alias(n) for n, c in flags.items()])
