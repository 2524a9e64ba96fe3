"""Joins by meaning: resolution of raw labels, look-ups, ranges, expansions, anti-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve(raw: DataFrame, motif: str, groups: DataFrame, members: DataFrame, aliases: DataFrame, index: DataFrame) -> DataFrame:
    """(motif, group_id): canonical group of each distinct raw label, null if there is none.

    Precedence: (1) index (motif, group_id); (2) the label is a group's id; (3) the
    first group, by pos, that lists it in members (group_id, pos, member); (4) its
    alias entry (alias, ord, ref), references in their order, depth first. Chains of aliases are
    followed to their end, whatever their length; a label that is on its own route is not
    followed again, so a cycle resolves to null. A result that is no known group becomes null. groups is (group_id, pos).
    """
    labels = raw.select(F.col(motif).alias("motif")).distinct()

    def direct(df: DataFrame, c: str) -> DataFrame:
        """df with `hit`: the group by the first three rules for column c, else null."""
        one = index.groupBy(F.col("motif").alias("__m1")).agg(F.min("group_id").alias("__g1"))
        two = groups.select(F.col("group_id").alias("__g2"))
        three = members.groupBy(F.col("member").alias("__m3")).agg(F.min(F.struct("pos", "group_id")).getField("group_id").alias("__g3"))
        out = df.join(one, F.col(c) == F.col("__m1"), "left").join(two, F.col(c) == F.col("__g2"), "left").join(three, F.col(c) == F.col("__m3"), "left")
        return out.withColumn("hit", F.coalesce("__g1", "__g2", "__g3")).drop("__m1", "__g1", "__g2", "__m3", "__g3")

    start = labels.withColumn("at", F.col("motif")).withColumn("route", F.array().cast("array<int>")).withColumn("seen", F.array("motif"))
    step = direct(start, "at").checkpoint()
    found = step.where("hit is not null").select("motif", "route", "hit")
    while True:
        near = step.where("hit is null").drop("hit").join(aliases, F.col("at") == F.col("alias")).where(~F.array_contains("seen", F.col("ref")))
        # of several routes of one length to a label the first counts
        near = near.select("motif", F.col("ref").alias("at"), F.struct(F.concat("route", F.array(F.col("ord").cast("int"))).alias("route"), F.concat("seen", F.array("ref")).alias("seen")).alias("way"))
        near = near.groupBy("motif", "at").agg(F.min("way").alias("way")).select("motif", "at", "way.route", "way.seen")
        step = direct(near, "at").checkpoint()
        if not step.limit(1).count():
            break
        found = found.unionByName(step.where("hit is not null").select("motif", "route", "hit"))
    # depth first is the order of the routes: arrays compare from the left
    best = found.groupBy(F.col("motif").alias("__m")).agg(F.min(F.struct("route", "hit")).getField("hit").alias("__hit"))
    known = groups.select(F.col("group_id").alias("__known"))
    out = labels.join(best, F.col("motif") == F.col("__m"), "left").join(known, F.col("__hit") == F.col("__known"), "left")
    return out.select("motif", F.when(F.col("__known").isNotNull(), F.col("__hit")).alias("group_id"))


def lookup(df: DataFrame, key: str, mapping: DataFrame, map_key: str, value: str, order: str | None = None, how: str = "inner") -> DataFrame:
    """df with `value` of a mapping; of several entries for a key the first by order (else the least value) wins."""
    first = F.min(F.struct(order, value)).getField(value) if order else F.min(value)
    one = mapping.groupBy(F.col(map_key).alias("__k")).agg(first.alias(value))
    return df.join(one, df[key] == F.col("__k"), how).drop("__k")


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the last by order."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def shared_keys(df: DataFrame, run: str, key: str, value: str) -> DataFrame:
    """(run_a, run_b, key, value_a, value_b) for each key that two runs share, run_a < run_b."""
    a = df.select(F.col(run).alias("run_a"), F.col(key).alias(key), F.col(value).alias("value_a"))
    b = df.select(F.col(run).alias("run_b"), F.col(key).alias("__k"), F.col(value).alias("value_b"))
    return a.join(b, (F.col(key) == F.col("__k")) & (F.col("run_a") < F.col("run_b"))).drop("__k")


def never_seen(df: DataFrame, key: str, *earlier: tuple[DataFrame, str]) -> DataFrame:
    """Rows of df whose key is in none of the earlier tables."""
    for other, c in earlier:
        df = df.join(other.select(F.col(c).alias("__k")).distinct(), df[key] == F.col("__k"), "left_anti")
    return df


def unbinned(families: DataFrame, family: str, n: str, binned: DataFrame, least: int = 20) -> DataFrame:
    """Families with `least` children or more that have no bins."""
    return never_seen(families.where(F.col(n) >= least), family, (binned, family))


def flagged(df: DataFrame, key: str, marked: DataFrame, marked_key: str, flag: str) -> DataFrame:
    """df with a boolean: whether the key is among the marked ones."""
    m = marked.select(F.col(marked_key).alias("__k")).distinct()
    return df.join(m, df[key] == F.col("__k"), "left").withColumn(flag, F.col("__k").isNotNull()).drop("__k")


def expand_ranges(ranges: DataFrame, source: str, prefix: str, first: str, last: str, listed: DataFrame | None = None, unit: str = "unit") -> DataFrame:
    """(source, unit): `prefix.%03d` for each number of each range, and listed units, distinct."""
    each = ranges.select(source, prefix, F.explode(F.sequence(F.col(first), F.col(last))).alias("__i"))
    out = each.select(source, F.format_string("%s.%03d", F.col(prefix), F.col("__i")).alias(unit))
    return (out.unionByName(listed.select(source, unit)) if listed is not None else out).distinct()


def planned_coverage(units: DataFrame, unit: str, sources: DataFrame, source: str, registered: DataFrame, text: str) -> DataFrame:
    """Every planned unit with its sources and the registered texts among them; sources is (unit, source), registered (source, text)."""
    s = sources.select(F.col(unit).alias("__u"), F.col(source).alias("__s")).distinct()
    r = registered.select(F.col(source).alias("__r"), F.col(text).alias("__t"))
    both = units.select(unit).distinct().join(s, F.col(unit) == F.col("__u"), "left").join(r, F.col("__s") == F.col("__r"), "left")
    return both.groupBy(unit).agg(F.count_distinct("__s").alias("n_sources"), F.array_sort(F.collect_set("__t")).alias("texts"))


def reviewed(drafts: DataFrame, reviews: DataFrame, key: str, review_key: str, verdict: str, draft: str, correction: str, prefix: str = "review:") -> DataFrame:
    """drafts with `final`: accept keeps the draft, revise takes the correction (or the draft), anything else rejects it."""
    r = reviews.select(F.regexp_replace(review_key, f"^{prefix}", "").alias("__k"), F.col(verdict).alias("__v"), F.col(correction).alias("__c"))
    both = drafts.join(r, drafts[key] == F.col("__k"))
    final = F.when(F.col("__v") == "accept", F.col(draft)).when(F.col("__v") == "revise", F.coalesce("__c", F.col(draft)))
    return both.withColumn("verdict", F.col("__v")).withColumn("final", final).drop("__k", "__v", "__c")


def blocked_pairs(df: DataFrame, block: str, key: str, keep: tuple[str, ...] = (), condition: Column | None = None) -> DataFrame:
    """Pairs a < b of keys within a block, with the kept columns of both as a_*, b_*; `condition` is part of the join. The block column mustn't be named a or b."""
    a = df.select(F.col(block).alias(block), F.col(key).alias("a"), *[F.col(c).alias(f"a_{c}") for c in keep])
    b = df.select(F.col(block).alias("__b"), F.col(key).alias("b"), *[F.col(c).alias(f"b_{c}") for c in keep])
    on = (F.col(block) == F.col("__b")) & (F.col("a") < F.col("b"))
    return a.join(b, on if condition is None else on & condition).drop("__b")
