"""Co-occurrence queries over orders as records, brands as items, nations as groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators.permutations import permutation_sql
from .registry import query

#: Groups in which an edge must hold, as in the reference and the functions' defaults.
CONSERVED = 4
#: Permutations of the registered null models, as in the reference and the functions' default.
PERMS = 200


def facts(t):
    """(nation, region, order, date, part, brand, ...) of every line item."""
    li = t("lineitem").select("l_orderkey", "l_partkey")
    out = li.join(t("part").select("p_partkey", "p_name", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    # orders get their nation first: line items then move by part and by order, not by customer too
    who = t("orders").select("o_orderkey", "o_custkey", "o_orderdate").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    who = who.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return out.join(who, F.col("l_orderkey") == F.col("o_orderkey"))


def brand_sets(t, held=None):
    df = facts(t)
    if held is not None:
        df = df.where(F.col("r_name").isin("AFRICA", "AMERICA") == F.lit(held))
    return G.item_sets(df, "n_name", "l_orderkey", "p_brand")


FACTS = """SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
SETS = f"s AS (SELECT DISTINCT n_name AS g, l_orderkey AS r, p_brand AS i, r_name IN ('AFRICA', 'AMERICA') AS held FROM ({FACTS}))"


def counts_sql(name: str, source: str, by: str = "") -> str:
    """CTEs <name>_e of PMI inputs over a CTE source(g, r, i[, by])."""
    b = f"{by}, " if by else ""
    eq = f"AND x.{by} = y.{by}" if by else ""
    return f"""
{name}_n AS (SELECT {b}g, count(DISTINCT r) AS n FROM {source} GROUP BY {b}g),
{name}_1 AS (SELECT {b}g, i, count(*) AS n1 FROM {source} GROUP BY {b}g, i),
{name}_2 AS (SELECT {"x." + by + ", " if by else ""}x.g, x.i AS a, y.i AS b, count(*) AS n_ab FROM {source} x JOIN {source} y ON x.g = y.g AND x.r = y.r AND x.i < y.i {eq} GROUP BY ALL),
{name}_e AS (SELECT p.*, u.n1 AS n_a, v.n1 AS n_b, t.n FROM {name}_2 p
  JOIN {name}_1 u ON p.g = u.g AND p.a = u.i {f"AND p.{by} = u.{by}" if by else ""}
  JOIN {name}_1 v ON p.g = v.g AND p.b = v.i {f"AND p.{by} = v.{by}" if by else ""}
  JOIN {name}_n t ON p.g = t.g {f"AND p.{by} = t.{by}" if by else ""})"""


PMI = "n_ab >= {0} AND n >= {1} AND n_ab * n > n_a * n_b"
CONS = f"c AS (SELECT a, b, count(*) AS n_groups, sum(n_ab)::BIGINT AS cooccurrence, string_agg(g, ',' ORDER BY g) AS groups FROM o_e WHERE {PMI.format(3, 20)} GROUP BY a, b HAVING count(*) >= {CONSERVED})"
BASE = f"WITH RECURSIVE {SETS}, {counts_sql('o', 's')}, {CONS}"
# the shuffle: each seat of a group, in the order of record and item, is dealt a token by a keyed bijection
PERM = lambda source: f"""t AS MATERIALIZED (SELECT g, r, i, row_number() OVER (PARTITION BY g ORDER BY r, i) - 1 AS seat, count(*) OVER (PARTITION BY g) AS n FROM {source}), {permutation_sql('t', PERMS, 'pm')},
d AS (SELECT DISTINCT x.perm, x.g, s.r, y.i FROM pm x JOIN t s ON x.g = s.g AND x.seat = s.seat JOIN t y ON x.g = y.g AND x.token = y.seat)"""  # noqa: E731
NULL = f"{BASE}, {PERM('s')}, {counts_sql('w', 'd', 'perm')}, z AS (SELECT perm, a, b FROM w_e WHERE {PMI.format(3, 20)} GROUP BY perm, a, b HAVING count(*) >= {CONSERVED})"


def observed(t):
    return G.conserved_edges(G.pmi_edges(G.pair_counts(brand_sets(t))), CONSERVED)


@query(f"WITH {SETS}, {counts_sql('o', 's')} SELECT g AS tradition, a, b, n_ab, n_a, n_b, n FROM o_e")
def pair_counts(t):
    return G.pair_counts(brand_sets(t)).withColumnRenamed("group", "tradition")


@query(f"WITH {SETS}, {counts_sql('o', 's')} SELECT g AS tradition, a, b, n_ab, n_a, n_b, n, round(ln((n_ab / n) / ((n_a / n) * (n_b / n))), 4) AS pmi FROM o_e WHERE {PMI.format(3, 20)}")
def pmi_edges(t):
    return G.pmi_edges(G.pair_counts(brand_sets(t))).withColumnRenamed("group", "tradition")


@query(f"{BASE} SELECT a, b, n_groups, groups, cooccurrence FROM c")
def conserved_edges(t):
    return observed(t).withColumn("groups", F.array_join("groups", ","))


@query(f"{BASE} SELECT CASE WHEN a = 'Brand#1' THEN b ELSE a END AS partner, n_groups, cooccurrence FROM c WHERE a = 'Brand#1' OR b = 'Brand#1'")
def edge_neighbours(t):
    return G.neighbours(observed(t), "Brand#1")


@query(f"{BASE} SELECT a, b, n_groups, cooccurrence FROM c WHERE a IN (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) > 70) AND b IN (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) > 70)")
def induced_edges(t):
    big = t("part").groupBy("p_brand").count().where("count > 70").withColumnRenamed("p_brand", "node")
    return G.induced(observed(t), big).select("a", "b", "n_groups", "cooccurrence")


@query(f"""{NULL}, k AS (SELECT p, count(z.perm) AS k FROM (SELECT unnest(range(1, {PERMS} + 1)) AS p) LEFT JOIN z ON z.perm = p GROUP BY p), o AS (SELECT count(*) AS observed FROM c)
SELECT observed, round(avg(k), 2) AS null_mean, round(stddev_pop(k), 2) AS null_sd, max(k) AS null_max, CASE WHEN stddev_pop(k) > 0 THEN round((observed - avg(k)) / stddev_pop(k), 2) END AS z,
round((count(*) FILTER (k >= observed) + 1) / {PERMS + 1}, 5) AS p FROM k, o GROUP BY observed""")
def null_model_summary(t):
    return G.null_summary(*G.null_model(brand_sets(t), PERMS, min_groups=CONSERVED), PERMS)


@query(f"{NULL} SELECT a, b, n_groups, cooccurrence, round(count(z.perm) / {PERMS}, 4) AS null_rate FROM c LEFT JOIN z USING (a, b) GROUP BY a, b, n_groups, cooccurrence")
def edge_null_hit_rate(t):
    return G.edge_hit_rate(*G.null_model(brand_sets(t), PERMS, min_groups=CONSERVED), PERMS)


_TRAIN, _TEST = (3, 4), (2, 2)
_HOLD = f"""WITH RECURSIVE {SETS}, s1 AS (SELECT * FROM s WHERE NOT held), s2 AS (SELECT * FROM s WHERE held), {counts_sql('o', 's1')}, {counts_sql('h', 's2')},
tr AS (SELECT a, b FROM o_e WHERE {PMI.format(_TRAIN[0], 10)} GROUP BY a, b HAVING count(*) >= {_TRAIN[1]}),
te AS (SELECT a, b FROM h_e WHERE {PMI.format(_TEST[0], 10)} GROUP BY a, b HAVING count(*) >= {_TEST[1]})"""


@query(f"""{_HOLD}, {PERM('s2')}, {counts_sql('w', 'd', 'perm')},
z AS (SELECT perm, a, b FROM w_e WHERE {PMI.format(_TEST[0], 10)} GROUP BY perm, a, b HAVING count(*) >= {_TEST[1]}),
k AS (SELECT p, count(x.perm) AS k FROM (SELECT unnest(range(1, {PERMS} + 1)) AS p) LEFT JOIN (SELECT z.perm FROM z JOIN tr USING (a, b)) x ON x.perm = p GROUP BY p),
o AS (SELECT (SELECT count(*) FROM tr) AS t, (SELECT count(*) FROM te) AS h, (SELECT count(*) FROM tr JOIN te USING (a, b)) AS m),
f AS (SELECT t, h, m, avg(k) AS mean, count(*) FILTER (k < m) AS beaten FROM k, o GROUP BY t, h, m),
v AS (SELECT *, m / nullif(t, 0) AS rate, m / nullif(mean, 0) AS lift, 1 - m / nullif(h, 0) AS nov FROM f)
SELECT t AS training_edges, h AS holdout_edges, m AS reproduced, round(rate, 4) AS rate, round(mean, 4) AS null_mean, round(lift, 3) AS lift, round(nov, 4) AS novelty, beaten,
CASE WHEN nov < 0.1 THEN 'leakage_flag' WHEN beaten = {PERMS} AND lift >= 1.15 THEN 'success' WHEN beaten >= 190 AND lift >= 1.05 THEN 'weak_support' ELSE 'failure' END AS verdict FROM v""")
def holdout_prediction(t):
    return G.holdout(brand_sets(t, False), brand_sets(t, True), PERMS, train_at=_TRAIN, test_at=_TEST)


@query(f"""{_HOLD} SELECT g AS tradition, count(DISTINCT r) AS records, (SELECT count(*) FROM h_e e JOIN tr USING (a, b) WHERE e.g = s2.g AND {PMI.format(2, 10)}) AS present FROM s2 GROUP BY g""")
def lineage_edges(t):
    return G.per_lineage(brand_sets(t, False), brand_sets(t, True), _TRAIN).withColumnRenamed("group", "tradition")


@query(f"""{_HOLD}, s3 AS (SELECT * FROM s2 WHERE g IN ('NATION_0', 'NATION_1', 'NATION_5', 'NATION_6', 'NATION_10')), {counts_sql('k', 's3')},
tk AS (SELECT a, b FROM k_e WHERE {PMI.format(_TEST[0], 10)} GROUP BY a, b HAVING count(*) >= {_TEST[1]}), m AS (SELECT (SELECT count(*) FROM tr) AS t, (SELECT count(*) FROM tr JOIN tk USING (a, b)) AS r)
SELECT t AS training_edges, r AS reproduced, CASE WHEN t > 0 THEN round(r / t, 4) END AS rate FROM m""")
def hard_core_prediction(t):
    """The holdout test on a listed subset of the held-out groups."""
    return G.hard_core(brand_sets(t, False), brand_sets(t, True), ["NATION_0", "NATION_1", "NATION_5", "NATION_6", "NATION_10"], _TRAIN, _TEST)


@query("""WITH f AS (SELECT user_id, event_type, min(event_id) AS at FROM events GROUP BY ALL)
SELECT x.event_type AS a, y.event_type AS b, count(*) FILTER (x.at < y.at) AS before, count(*) FILTER (x.at > y.at) AS after
FROM f x JOIN f y ON x.user_id = y.user_id AND x.event_type < y.event_type GROUP BY ALL""")
def sequence_precedence(t):
    return G.precedence(t("events"), "user_id", "event_id", "event_type")


@query("""WITH r AS (SELECT user_id, event_type || '>' || lead(event_type, 1) OVER w || '>' || lead(event_type, 2) OVER w AS sequence FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT sequence, count(DISTINCT user_id) AS n_chains FROM r WHERE sequence IS NOT NULL GROUP BY 1 HAVING count(DISTINCT user_id) >= 2""")
def recurring_sequences(t):
    return G.recurring_sequences(t("events"), "user_id", "event_id", "event_type")


#: Chains that a sequence with gaps must stand in.
CHAINS = 100


@query(f"""WITH RECURSIVE r AS (SELECT DISTINCT l_orderkey AS c, l_linenumber AS p, floor(l_quantity / 10)::INTEGER AS i FROM lineitem),
s AS (SELECT c, p, [i] AS s FROM r UNION ALL SELECT s.c, r.p, list_append(s.s, r.i) FROM s JOIN r ON r.c = s.c AND r.p > s.p),
n AS (SELECT s, count(DISTINCT c) AS n FROM s GROUP BY s HAVING count(DISTINCT c) >= {CHAINS}),
d AS (SELECT DISTINCT list_concat(s[1:k - 1], s[k + 1:]) AS s FROM (SELECT s, unnest(range(1, len(s) + 1)) AS k FROM n))
SELECT array_to_string(s, '>') AS sequence, len(s)::INTEGER AS length, n AS n_chains, s NOT IN (SELECT s FROM d) AS maximal FROM n""")
def gapped_sequences(t):
    """Sizes of an order's lines as a chain: sequences with gaps of any length."""
    chains = t("lineitem").withColumn("size", F.floor(F.col("l_quantity") / 10).cast("int"))
    return G.gapped_sequences(chains, "l_orderkey", "l_linenumber", "size", CHAINS).withColumn("sequence", F.array_join(F.transform("sequence", lambda x: x.cast("string")), ">"))


@query("""WITH w AS (SELECT unnest(string_split_regex(text, '[^0-9.,A-Za-z]+')) AS w FROM documents),
n AS (SELECT w::INTEGER AS number, count(*) AS mentions FROM w WHERE regexp_full_match(w, '[0-9]{1,4}') GROUP BY 1),
x AS (SELECT a.number, a.mentions, coalesce(sum(b.mentions) / 2, 0) AS neighbours FROM n a LEFT JOIN n b ON abs(a.number - b.number) = 1 GROUP BY ALL)
SELECT number, mentions, neighbours, CASE WHEN neighbours > 0 THEN round(mentions / neighbours, 4) END AS prominence FROM x""")
def number_prominence(t):
    return G.number_prominence(t("documents"))


@query("""SELECT o_orderkey AS record, string_agg(l, ',' ORDER BY l) AS labels FROM (SELECT DISTINCT l_orderkey AS o_orderkey, lower(p_name) AS l FROM lineitem JOIN part ON l_partkey = p_partkey WHERE len(p_name) >= 4)
GROUP BY 1 HAVING count(*) >= 2""")
def crown_label_sets(t):
    df = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    out = G.label_sets(df, "l_orderkey", "p_name", F.lit("all"))
    return out.select(F.col("l_orderkey").alias("record"), F.array_join("labels", ",").alias("labels"))
