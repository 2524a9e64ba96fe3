"""Agreement of readers: pairwise Jaccard, consensus tiers, gates and suspects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import jaccard
from .joins import shared_keys


def reading_sets(df: DataFrame, run: str, passage: str, ref: str) -> DataFrame:
    """(run, passage, refs): the sorted set of references of each reading; none gives an empty set."""
    return df.groupBy(F.col(run).alias("run"), F.col(passage).alias("passage")).agg(F.array_sort(F.collect_set(ref)).alias("refs"))


def pairwise(sets: DataFrame) -> DataFrame:
    """(run_a, run_b, shared, mean_jaccard, exact_rate) for each two runs that share passages."""
    both = shared_keys(sets, "run", "passage", "refs")
    j = jaccard("value_a", "value_b")
    return both.groupBy("run_a", "run_b").agg(
        F.count(F.lit(1)).alias("shared"), F.round(F.avg(j), 4).alias("mean_jaccard"), F.round(F.avg((F.col("value_a") == F.col("value_b")).cast("int")), 4).alias("exact_rate")
    )


def pairwise_by(sets: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """(run_a, run_b, group, shared, mean_jaccard) with the group of each passage; groups is (passage, group)."""
    g = groups.select(F.col("passage").alias("__p"), group)
    both = shared_keys(sets, "run", "passage", "refs").join(g, F.col("passage") == F.col("__p"))
    return both.groupBy("run_a", "run_b", group).agg(F.count(F.lit(1)).alias("shared"), F.round(F.avg(jaccard("value_a", "value_b")), 4).alias("mean_jaccard"))


def parse_stats(lines: DataFrame, run: str, key: str, parsed: str) -> DataFrame:
    """(run, parsed, parse_failed): distinct keys that parsed, and lines that didn't."""
    ok = F.col(parsed)
    return lines.groupBy(run).agg(F.count_distinct(F.when(ok, F.col(key))).alias("parsed"), F.count_if(~ok).alias("parse_failed"))


def consensus(readings: DataFrame, passage: str, run: str, family: str, line: str) -> DataFrame:
    """(passage, family, readers, tier): lines that name a family at a passage read by two runs or more.

    A line counts once for each family it names, so a reading repeated within a
    run counts again. Tiers: 3 or more confirmed, 2 corroborated, 1 provisional.
    """
    lines = readings.where(F.col(family).isNotNull()).select(passage, run, line, family).distinct()
    read = lines.groupBy(F.col(passage).alias("__p")).agg(F.count_distinct(line).alias("__n")).where(F.col("__n") >= 2)
    named = lines.groupBy(passage, family).agg(F.count(F.lit(1)).alias("readers"))
    kept = named.join(read.select("__p"), F.col(passage) == F.col("__p"), "left_semi")
    tier = F.when(F.col("readers") >= 3, "confirmed").when(F.col("readers") == 2, "corroborated").otherwise("provisional")
    return kept.withColumn("tier", tier)


def gate_sensitivity(verdicts: DataFrame, kind: str, rejected: str, places: int = 3) -> DataFrame:
    """(kind, caught, total, sensitivity) of seeded corruptions by kind."""
    bad = F.col(rejected)
    return verdicts.groupBy(kind).agg(F.count_if(bad).alias("caught"), F.count(F.lit(1)).alias("total"), F.round(F.count_if(bad) / F.count(F.lit(1)), places).alias("sensitivity"))


def suspects(first: DataFrame, second: DataFrame, confirmed: DataFrame, key: str) -> DataFrame:
    """Keys that both gates reject and no consensus confirms."""
    two = second.select(F.col(key).alias("__b")).distinct()
    ok = confirmed.select(F.col(key).alias("__c")).distinct()
    return first.select(key).distinct().join(two, F.col(key) == F.col("__b"), "left_semi").join(ok, F.col(key) == F.col("__c"), "left_anti")


def gate_agreement(verdicts: DataFrame, a: str, b: str) -> DataFrame:
    """One row: both reject, only a, only b, neither, and the share in which the gates agree."""
    x, y = F.col(a), F.col(b)
    return verdicts.agg(
        F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"),
        F.round(F.count_if(x == y) / F.count(F.lit(1)), 4).alias("agreement"),
    )


def enrichment(df: DataFrame, tier: str, rejected: str) -> DataFrame:
    """(tier, share_rejected, share_all): how often a tier is among the rejected and among all."""
    per = df.groupBy(tier).agg(F.count_if(F.col(rejected)).alias("__r"), F.count(F.lit(1)).alias("__n"))
    total = df.agg(F.count_if(F.col(rejected)).alias("__rejected"), F.count(F.lit(1)).alias("__every"))
    both = per.join(F.broadcast(total))  # one row
    return both.select(tier, F.round(F.col("__r") / F.nullif("__rejected", F.lit(0)), 4).alias("share_rejected"), F.round(F.col("__n") / F.col("__every"), 4).alias("share_all"))


def pairwise_canonical(sets: DataFrame, mapping: DataFrame, ref: str, canonical: str) -> DataFrame:
    """(run_a, run_b, shared, mean_raw_jaccard, mean_canonical_jaccard, exact_canonical_rate): pairwise() on references and on what they resolve to.

    mapping (ref, canonical) has one row a reference; a reference without one counts in the raw sets only.
    """
    m = mapping.select(F.col(ref).alias("__ref"), F.col(canonical).alias("__canonical"))
    named = sets.select("run", "passage", F.explode("refs").alias("__r")).join(m, F.col("__r") == F.col("__ref"))
    found = named.groupBy(F.col("run").alias("__run"), F.col("passage").alias("__passage")).agg(F.array_sort(F.collect_set("__canonical")).alias("__c"))
    both = sets.join(found, (F.col("run") == F.col("__run")) & (F.col("passage") == F.col("__passage")), "left")
    none = F.array().cast(f"array<{mapping.schema[canonical].dataType.simpleString()}>")
    value = F.struct("refs", F.coalesce("__c", none).alias("canonical"))
    pairs = shared_keys(both.select("run", "passage", value.alias("value")), "run", "passage", "value")
    a, b = F.col("value_a"), F.col("value_b")
    return pairs.groupBy("run_a", "run_b").agg(
        F.count(F.lit(1)).alias("shared"), F.round(F.avg(jaccard(a["refs"], b["refs"])), 4).alias("mean_raw_jaccard"),
        F.round(F.avg(jaccard(a["canonical"], b["canonical"])), 4).alias("mean_canonical_jaccard"),
        F.round(F.avg((a["canonical"] == b["canonical"]).cast("int")), 4).alias("exact_canonical_rate"),
    )


def gate_report(verdicts: DataFrame, honeypot: str, verdict: str, caught: tuple[str, ...] = ("revise", "reject"), worst: str = "reject") -> DataFrame:
    """(part, name, n, rate): verdicts of real records, seeded ones caught by kind, records gated, and escalations (real ones of the worst verdict)."""
    real = verdicts.where(F.col(honeypot).isNull())
    none, n = F.lit(None).cast("double").alias("rate"), F.count(F.lit(1)).alias("n")
    per = real.groupBy(F.col(verdict).alias("name")).agg(n).select(F.lit("verdict").alias("part"), "name", "n", none)
    kinds = gate_sensitivity(verdicts.where(F.col(honeypot).isNotNull()).withColumn("__bad", F.col(verdict).isin(*caught)), honeypot, "__bad")
    seeded = kinds.select(F.lit("honeypot").alias("part"), F.col(honeypot).alias("name"), F.col("total").alias("n"), F.col("sensitivity").alias("rate"))
    total = real.agg(n).select(F.lit("total").alias("part"), F.lit("records_gated").alias("name"), "n", none)
    up = escalated(verdicts, honeypot, verdict, worst).agg(n).select(F.lit("total").alias("part"), F.lit("escalations").alias("name"), "n", none)
    return per.unionByName(seeded).unionByName(total).unionByName(up)


def escalated(verdicts: DataFrame, honeypot: str, verdict: str, worst: str = "reject") -> DataFrame:
    """Real records of the worst verdict: these go to a second reader."""
    return verdicts.where(F.col(honeypot).isNull() & (F.col(verdict) == worst))
