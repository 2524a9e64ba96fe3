"""Blind taxonomies of two piles: their clusters, webs, alignment and topology, each with its SQL.

Labels are embeddings, those of even ids for the first pile and of odd ids for the
second; a line of an order mentions the label of its part, in the pile of its customer's region.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import taxonomy as X
from .graph_queries import FACTS, PMI, counts_sql, facts
from .registry import query

#: Clusters of a pile, rounds of k-means, permutations of the alignment, and groups in which an edge of a pile's web must hold.
K, ROUNDS, PERMS, HELD = 40, 4, 500, {0: 7, 1: 10}
HELD_REGIONS = ("AFRICA", "AMERICA")


def _blind_sql(k: int = K, rounds: int = ROUNDS) -> str:
    """CTEs up to `a` (pile, vec_id, cluster) and `z` (pile, cluster, q): the seeds one by one, then the rounds."""
    gap = "x.nn + c.nn - 2 * list_inner_product(x.q, c.q)"
    out = f"""u AS MATERIALIZED (SELECT vec_id, vec_id % 2 AS pile, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings),
r AS MATERIALIZED (SELECT * FROM (SELECT pile, q, list_inner_product(q, q) AS nn, row_number() OVER (PARTITION BY pile ORDER BY md5(vec_id::VARCHAR), vec_id) AS p FROM u) WHERE p <= {X.SEED_ROWS}),
c1 AS (SELECT pile, q, nn FROM r WHERE p = 1), g1 AS MATERIALIZED (SELECT x.*, {gap} AS d FROM r x JOIN c1 c USING (pile))"""
    for j in range(2, k + 1):
        out += f""", c{j} AS MATERIALIZED (SELECT pile, first(q ORDER BY d DESC, p) AS q, first(nn ORDER BY d DESC, p) AS nn FROM g{j - 1} WHERE d > 0 GROUP BY pile),
g{j} AS MATERIALIZED (SELECT x.pile, x.q, x.nn, x.p, least(x.d, {gap}) AS d FROM g{j - 1} x JOIN c{j} c USING (pile))"""
    out += ", z0 AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT pile, {j - 1} AS cluster, q FROM c{j}" for j in range(1, k + 1)) + ")"
    for i in range(rounds + 1):
        last = i == rounds
        out += f""", {'a' if last else f'a{i}'} AS MATERIALIZED (SELECT pile, vec_id, q, cluster FROM (SELECT pile, vec_id, u.q, cluster,
  row_number() OVER (PARTITION BY vec_id ORDER BY list_inner_product(z.q, z.q) - 2 * list_inner_product(u.q, z.q), cluster) AS n FROM u JOIN z{i} z USING (pile)) WHERE n = 1)"""
        if not last:
            out += f""", m{i} AS (SELECT pile, cluster, k, floor((2 * sum(x) + count(*)) / (2 * count(*))) AS x FROM (SELECT pile, cluster, unnest(q) AS x, unnest(range(len(q))) AS k FROM a{i}) GROUP BY ALL),
z{i + 1} AS MATERIALIZED (SELECT pile, cluster, coalesce(v, q) AS q FROM z{i} LEFT JOIN (SELECT pile, cluster, list(x ORDER BY k) AS v FROM m{i} GROUP BY ALL) USING (pile, cluster))"""
    return out + f", z AS (SELECT * FROM z{rounds})"


BLIND = f"WITH RECURSIVE {_blind_sql()}"
ALIGNED = """h AS MATERIALIZED (SELECT cluster, partner, c FROM (SELECT x.cluster, y.cluster AS partner, list_inner_product(x.q, y.q) / sqrt(list_inner_product(y.q, y.q)) / sqrt(list_inner_product(x.q, x.q)) AS c,
  row_number() OVER (PARTITION BY x.cluster ORDER BY list_inner_product(x.q, y.q) / sqrt(list_inner_product(y.q, y.q)) DESC, y.cluster) AS n FROM z x JOIN z y ON x.pile = 0 AND y.pile = 1) WHERE n = 1)"""
WEB = f"""s AS (SELECT DISTINCT n_name AS g, l_orderkey AS r, 1000 * a.pile + cluster AS i FROM (SELECT *, CASE WHEN r_name IN {HELD_REGIONS} THEN 0 ELSE 1 END AS side FROM ({FACTS})) f
  JOIN a ON a.vec_id = 2 * (l_partkey % (SELECT count(*) // 2 FROM embeddings)) + side), {counts_sql('o', 's')},
w AS MATERIALIZED (SELECT a // 1000 AS pile, a % 1000 AS a, b % 1000 AS b, count(*) AS n_groups, sum(n_ab)::BIGINT AS cooccurrence FROM o_e WHERE {PMI.format(3, 20)} GROUP BY o_e.a, o_e.b
  HAVING count(*) >= CASE WHEN o_e.a // 1000 = 0 THEN {HELD[0]} ELSE {HELD[1]} END)"""


def in_place_sql(edges: str, name: str, rounds: int = 10, seed: int = 42) -> str:
    """Recursive CTE <name> (pile, node, label): propagation node after node over a CTE edges(pile, a, b, n_groups)."""
    return f"""{name}_e AS MATERIALIZED (SELECT pile, a AS u, b AS v, n_groups AS w FROM {edges} UNION ALL SELECT pile, b, a, n_groups FROM {edges}),
{name}_n AS MATERIALIZED (SELECT pile, node, row_number() OVER (PARTITION BY pile ORDER BY md5(concat_ws('|', '{seed}', node::VARCHAR)), node) AS pos, count(*) OVER (PARTITION BY pile) AS k FROM (SELECT DISTINCT pile, u AS node FROM {name}_e)),
{name}_x AS MATERIALIZED (SELECT e.pile, p.pos AS up, q.pos AS vp, w FROM {name}_e e JOIN {name}_n p ON p.pile = e.pile AND p.node = u JOIN {name}_n q ON q.pile = e.pile AND q.node = v),
{name}_r AS (SELECT pile, 0 AS t, any_value(k) AS k, list(node ORDER BY pos) AS labels FROM {name}_n GROUP BY pile UNION ALL
  SELECT r.pile, r.t + 1, r.k, list_concat(r.labels[1:r.t % r.k], [(SELECT label FROM (SELECT r.labels[x.vp] AS label, sum(x.w) AS s FROM {name}_x x WHERE x.pile = r.pile AND x.up = r.t % r.k + 1 GROUP BY 1) ORDER BY s DESC, label DESC LIMIT 1)],
    r.labels[r.t % r.k + 2:]) FROM {name}_r r WHERE r.t < {rounds} * r.k),
{name} AS MATERIALIZED (SELECT n.pile, n.node, r.labels[n.pos] AS label FROM {name}_r r JOIN {name}_n n USING (pile) WHERE r.t = {rounds} * r.k)"""


def _piles(t):
    return [X.integer_vectors(t("embeddings").where(w), "vec_id", "embedding").checkpoint() for w in ("vec_id % 2 = 0", "vec_id % 2 = 1")]


def _blind(t):
    return [X.blind_clusters(p, K, ROUNDS) for p in _piles(t)]


def _mentions(t, side: int):
    """(group, record, key) of the lines of one pile."""
    half = t("embeddings").agg(F.floor(F.count(F.lit(1)) / 2).alias("half"))
    held = F.col("r_name").isin(*HELD_REGIONS)
    rows = facts(t).where(held if side == 0 else ~held).join(F.broadcast(half))  # one row
    return rows.select(F.col("n_name").alias("group"), F.col("l_orderkey").alias("record"), (2 * (F.col("l_partkey") % F.col("half")) + side).alias("key"))


def _webs(t, blind):
    return [X.cluster_web(_mentions(t, side), clusters, min_groups=HELD[side]).checkpoint() for side, (clusters, _) in enumerate(blind)]


@query(f"{BLIND} SELECT pile, vec_id, cluster FROM a")
def blind_clusters(t):
    """Each pile's labels clustered without sight of the other."""
    first, second = (c.select(F.lit(side).cast("long").alias("pile"), F.col("key").alias("vec_id"), "cluster") for side, (c, _) in enumerate(_blind(t)))
    return first.unionByName(second)


@query(f"{BLIND}, {ALIGNED} SELECT cluster, partner, round(c, 4) AS cosine FROM h")
def crown_alignment(t):
    """Two piles clustered blind, their centres aligned."""
    (clusters, first), (_, second) = _blind(t)
    return X.nearest_partners(clusters.sparkSession, first, second)


@query(f"{BLIND}, {WEB} SELECT pile::INTEGER AS pile, a::INTEGER AS a, b::INTEGER AS b, n_groups, cooccurrence FROM w")
def label_web(t):
    """The two webs of blind clusters."""
    first, second = (w.select(F.lit(side).alias("pile"), "a", "b", "n_groups", "cooccurrence") for side, w in enumerate(_webs(t, _blind(t))))
    return first.unionByName(second)


_NULL = f"""{BLIND}, {ALIGNED}, {WEB}, p AS (SELECT p, cluster, partner FROM h, (SELECT unnest(range(0, {PERMS} + 1)) AS p)),
st AS (SELECT p, cluster, row_number() OVER (PARTITION BY p ORDER BY cluster) AS s FROM p),
dl AS (SELECT p, partner, row_number() OVER (PARTITION BY p ORDER BY CASE WHEN p > 0 THEN md5(concat_ws('|', '42', p::VARCHAR, cluster::VARCHAR)) ELSE '' END, cluster) AS s FROM p),
d AS MATERIALIZED (SELECT p, cluster, partner FROM st JOIN dl USING (p, s)),
e AS (SELECT x.cluster AS a, y.cluster AS b, coalesce(n_groups, 0) AS x FROM h x JOIN h y ON x.cluster < y.cluster LEFT JOIN w ON pile = 0 AND w.a = x.cluster AND w.b = y.cluster),
n AS MATERIALIZED (SELECT i.p, x, coalesce(n_groups, 0) AS y, count(*) AS n FROM e JOIN d i ON i.cluster = e.a JOIN d j ON j.cluster = e.b AND j.p = i.p
  LEFT JOIN w ON pile = 1 AND w.a = least(i.partner, j.partner) AND w.b = greatest(i.partner, j.partner) GROUP BY ALL),
rx AS (SELECT p, x, 2 * sum(k) OVER (PARTITION BY p ORDER BY x) - k - sum(k) OVER (PARTITION BY p) AS dx FROM (SELECT p, x, sum(n) AS k FROM n GROUP BY ALL)),
ry AS (SELECT p, y, 2 * sum(k) OVER (PARTITION BY p ORDER BY y) - k - sum(k) OVER (PARTITION BY p) AS dy FROM (SELECT p, y, sum(n) AS k FROM n GROUP BY ALL)),
c AS (SELECT p, sum(n * dx * dy) AS xy, sum(n * dx * dx) AS xx, sum(n * dy * dy) AS yy, sum(n) FILTER (x > 0 AND y > 0) AS both_, sum(n) FILTER (x > 0) AS bonds FROM n JOIN rx USING (p, x) JOIN ry USING (p, y) GROUP BY p),
q AS (SELECT p, 'spearman' AS statistic, CASE WHEN xx > 0 AND yy > 0 THEN round(xy / sqrt(xx::DOUBLE * yy::DOUBLE) * 1000000)::BIGINT END AS v FROM c
  UNION ALL SELECT p, 'reproduction', CASE WHEN bonds > 0 THEN round(coalesce(both_, 0) / bonds * 1000000)::BIGINT END FROM c),
o AS (SELECT *, max(v) FILTER (p = 0) OVER (PARTITION BY statistic) AS seen FROM q),
nl AS MATERIALIZED (SELECT statistic, round(any_value(seen) / 1000000, 4) AS observed, round(avg(v) / 1000000, 4) AS null_mean, round(stddev_pop(v) / 1000000, 4) AS null_sd, round(max(v) / 1000000, 4) AS null_max,
  round(list(v ORDER BY v)[ceil(0.975 * count(v))::INTEGER] / 1000000, 4) AS null_q975, count(*) FILTER (v < seen) AS beaten, round((count(*) FILTER (v >= seen) + 1) / ({PERMS} + 1), 5) AS p FROM o WHERE p > 0 GROUP BY statistic)"""


@query(f"{_NULL} SELECT statistic, observed, null_mean, null_sd, null_max, null_q975, beaten, p FROM nl")
def alignment_null(t):
    """Rank correlation and reproduction of the aligned webs against permuted alignments."""
    blind = _blind(t)
    first, second = _webs(t, blind)
    return X.partner_null(first, second, X.nearest_partners(first.sparkSession, blind[0][1], blind[1][1]), PERMS)


_TOPOLOGY = f"""{in_place_sql('w', 'lp')}, dg AS MATERIALIZED (SELECT pile, node, count(*) AS d FROM (SELECT pile, a AS node FROM w UNION ALL SELECT pile, b FROM w) GROUP BY ALL),
rc AS (SELECT pile, node, node AS seen FROM dg UNION SELECT rc.pile, rc.node, e.v FROM rc JOIN lp_e e ON e.pile = rc.pile AND e.u = rc.seen),
cm AS (SELECT pile, count(*) AS components, max(k) AS giant FROM (SELECT pile, root, count(*) AS k FROM (SELECT pile, node, min(seen) AS root FROM rc GROUP BY ALL) GROUP BY ALL) GROUP BY pile),
tr AS (SELECT x.pile, count(*) AS triangles FROM w x JOIN w y ON x.pile = y.pile AND x.b = y.a JOIN w z ON z.pile = x.pile AND z.a = x.a AND z.b = y.b GROUP BY x.pile),
sq AS (SELECT pile, count(*) AS communities, sum(k * k) AS squares FROM (SELECT pile, label, sum(d) AS k FROM dg JOIN lp USING (pile, node) GROUP BY ALL) GROUP BY pile),
iw AS (SELECT w.pile, count(*) FILTER (x.label = y.label) AS inner_ FROM w JOIN lp x ON x.pile = w.pile AND x.node = w.a JOIN lp y ON y.pile = w.pile AND y.node = w.b GROUP BY w.pile),
ds AS (SELECT pile, count(*) AS nodes, sum(d) AS ends, sum(d * (d - 1)) AS wedges2 FROM dg GROUP BY pile),
tp AS MATERIALIZED (SELECT pile::INTEGER AS pile, coalesce(nodes, 0) AS nodes, (coalesce(ends, 0) / 2)::BIGINT AS edges, round(ends / nullif(nodes * (nodes - 1), 0), 4) AS density, coalesce(components, 0) AS components,
  round(giant / nodes, 4) AS giant_share, coalesce(triangles, 0) AS triangles, round(6 * coalesce(triangles, 0) / nullif(wedges2, 0), 4) AS clustering, coalesce(communities, 0) AS communities,
  round((2 * ends * inner_ - squares) / (ends * ends), 4) AS modularity FROM (VALUES (0), (1)) AS v(pile) LEFT JOIN ds USING (pile) LEFT JOIN cm USING (pile) LEFT JOIN tr USING (pile) LEFT JOIN sq USING (pile) LEFT JOIN iw USING (pile))"""


@query(f"{BLIND}, {WEB}, {_TOPOLOGY} SELECT * FROM tp")
def web_topology(t):
    """Global measures of the two webs, a row each."""
    first, second = (X.topology(w).withColumn("pile", F.lit(side)) for side, w in enumerate(_webs(t, _blind(t))))
    return first.unionByName(second)


@query(f"""{_NULL}, {_TOPOLOGY}, kd AS (SELECT d, count(*) FILTER (pile = 0) AS a, count(*) FILTER (pile = 1) AS b FROM dg GROUP BY d),
ku AS (SELECT sum(a) OVER (ORDER BY d) / sum(a) OVER () - sum(b) OVER (ORDER BY d) / sum(b) OVER () AS gap, sum(a) OVER () AS n_a, sum(b) OVER () AS n_b FROM kd),
kk AS (SELECT max(abs(gap)) AS d, coalesce(any_value(n_a), 0)::BIGINT AS n_a, coalesce(any_value(n_b), 0)::BIGINT AS n_b FROM ku), kl AS (SELECT *, sqrt(n_a * n_b / (n_a + n_b)) AS ro FROM kk),
km AS (SELECT *, (ro + 0.12 + 0.11 / ro) * d AS lam FROM kl),
kp AS (SELECT n_a, n_b, round(d, 4) AS ks, round(CASE WHEN d IS NULL THEN NULL WHEN lam < 0.2 THEN 1 ELSE least(1, greatest(0, 2 * list_sum(list_transform(range(1, 101), lambda j: pow(-1, j - 1) * exp(-2.0 * j * j * lam * lam))))) END, 4) AS ks_p FROM km)
SELECT observed AS spearman, null_q975, n_a, n_b, ks, ks_p, CASE WHEN observed > null_q975 AND ks_p > 0.05 THEN 'STRONG' WHEN observed > null_q975 OR ks_p > 0.05 THEN 'PARTIAL' ELSE 'NULL' END AS verdict FROM nl, kp WHERE statistic = 'spearman'""")
def crown_verdict(t):
    """STRONG if the rank correlation is above 97.5 % of the null and the degrees of the webs can't be told apart, PARTIAL for one of these, else NULL."""
    blind = _blind(t)
    first, second = _webs(t, blind)
    null = X.partner_null(first, second, X.nearest_partners(first.sparkSession, blind[0][1], blind[1][1]), PERMS).where("statistic = 'spearman'")
    one = null.select(F.col("observed").alias("spearman"), "null_q975").join(X.ks_test(X.degrees(first), X.degrees(second), "degree"))  # a row each
    beats, alike = F.coalesce(F.col("spearman") > F.col("null_q975"), F.lit(False)), F.coalesce(F.col("ks_p") > 0.05, F.lit(False))
    return one.withColumn("verdict", F.when(beats & alike, "STRONG").when(beats | alike, "PARTIAL").otherwise("NULL"))


#: Groups in which an edge of the communities' query must hold: so many that the brands fall into several communities.
COMMUNITY = 15


def _several() -> str:
    from .graph_queries import SETS

    return f"""WITH RECURSIVE {SETS}, {counts_sql('o', 's')}, c AS MATERIALIZED (SELECT 0 AS pile, a, b, count(*) AS n_groups FROM o_e WHERE {PMI.format(3, 20)} GROUP BY a, b HAVING count(*) >= {COMMUNITY}), {in_place_sql('c', 'lp')}"""


@query(f"""{_several()}, m AS (SELECT label, count(*) AS size FROM lp GROUP BY 1 HAVING count(*) >= 2),
n AS (SELECT x.label, count(*) AS internal_edges, round(avg(n_groups), 2) AS mean_groups FROM c JOIN lp x ON x.node = a JOIN lp y ON y.node = b WHERE x.label = y.label GROUP BY 1)
SELECT label, lp.node, size, coalesce(internal_edges, 0) AS internal_edges, mean_groups FROM lp JOIN m USING (label) LEFT JOIN n USING (label)""")
def edge_communities(t):
    """Communities of two members or more by propagation in place, a row for each member."""
    from .graph_queries import brand_sets

    edges = G.conserved_edges(G.pmi_edges(G.pair_counts(brand_sets(t))), COMMUNITY).checkpoint()
    labels = G.ordered_propagation(edges)
    return labels.join(G.communities(labels, edges).withColumnRenamed("label", "__l"), F.col("label") == F.col("__l")).drop("__l").select("label", "node", "size", "internal_edges", "mean_groups")
