"""Frequency indexes: occurrences, canonical roll-ups, eras, summaries, counts and rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import slug
from .windows import ordered_lists

# Half-open eras (id, from, to) of signed years.
ERAS = (
    ("deep_bronze", -10000, -1500), ("late_bronze_iron", -1500, -800), ("axial", -800, -300), ("classical", -300, 200), ("late_antique", 200, 800),
    ("medieval", 800, 1500), ("early_modern_recorded", 1500, 2100),
)


def occurrence_index(df: DataFrame, key: str, group: str, label: str | None = None, order: str | None = None) -> DataFrame:
    """One row for each key: total, groups (map of counts), and its label of the least order."""
    per = df.groupBy(key, group).agg(F.count(F.lit(1)).alias("n"), *([F.min(F.struct(order, label)).alias("__l")] if label else []))
    out = per.groupBy(key).agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_groups"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(group, "n")))).alias("groups"),
        *([F.min("__l").getField(label).alias("label")] if label else []),
    )
    return out


def refs_or_label(refs: Column, label: Column | str) -> Column:
    """A motif's references as slugs; without any, its label's slug is the one."""
    own = F.coalesce(F.transform(refs, lambda r: slug(r)), F.array().cast("array<string>"))
    return F.when(F.size(own) > 0, own).otherwise(F.array(slug(label)))


def occurrence_lists(df: DataFrame, key: str, order: Sequence[str], keep: Sequence[str], most: int | None = None) -> DataFrame:
    """(key, occurrences): the rows of each key as an ordered array; with `most` only the first so many, cut before they are gathered.

    Without `most` a key of more than 100,000 rows is an error: windows.ordered_rows gives these as rows.
    """
    fields = [*order, *[c for c in keep if c not in order]]
    if most:
        from pyspark.sql import Window

        df = df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__r") <= most)
        return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("occurrences"))
    return ordered_lists(df, key, fields, "occurrences").drop("n")


def canonical_rollup(counts: DataFrame, groups: DataFrame, key: str, tradition: str, n: str, group_id: str, meta: str | None = None) -> DataFrame:
    """counts (key, tradition, n) mapped to groups -> every group with occurrences, traditions, mapped keys; empty groups stay.

    groups is (group_id, key[, meta]); a key of null marks an empty group.
    """
    per = counts.join(groups.select(group_id, F.col(key).alias("__k")), counts[key] == F.col("__k"))
    by = per.groupBy(group_id).agg(F.sum(n).alias("occurrences"), F.count_distinct(tradition).alias("traditions"), F.count_distinct(key).alias("mapped"))
    every = groups.groupBy(F.col(group_id).alias("__g")).agg((F.max(meta) if meta else F.lit(False)).alias("is_meta"))
    out = every.join(by, F.col("__g") == by[group_id], "left")
    return out.select(F.col("__g").alias(group_id), "is_meta", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("occurrences", "traditions", "mapped")])


def mapped_counts(counts: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """One row: indexed, mapped and unmapped distinct keys."""
    known = groups.select(F.col(key).alias("__k")).distinct()
    both = counts.select(key).distinct().join(known, F.col(key) == F.col("__k"), "left")
    return both.agg(F.count(F.lit(1)).alias("indexed"), F.count("__k").alias("mapped"), F.count_if(F.col("__k").isNull()).alias("unmapped"))


def era(year: Column, eras: Sequence[tuple[str, int, int]] = ERAS) -> Column:
    """The era whose half-open range holds a year, else null. A few fixed ranges need no join."""
    out = None
    for name, start, end in eras:
        inside = (year >= start) & (year < end)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def era_join(df: DataFrame, year: str, eras: DataFrame) -> DataFrame:
    """df with the `era` of a table (era, start, end) of ranges: inner join, so undated rows go.

    Up to 1,000 ranges are broadcast; more are joined on slices of the years, as wide as a range is on average.
    """
    inside = (F.col(year) >= F.col("start")) & (F.col(year) < F.col("end"))
    size = eras.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("end") - F.col("start")).alias("width")).first()
    if size["n"] <= 1_000:
        return df.join(F.broadcast(eras), inside)
    width = F.lit(max(1, int(size["width"] or 1)))
    slices = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))
    named = eras.where("start < end").withColumn("__slice", F.explode(slices))
    sliced = df.withColumn("__at", F.floor(F.col(year) / width))
    return sliced.join(named, (F.col("__at") == F.col("__slice")) & inside).drop("__at", "__slice")


def era_flow(df: DataFrame, family: str, era_col: str, tradition: str, eras: Sequence[str]) -> DataFrame:
    """(family, era, n, n_traditions, traditions) for every family and era, with zero cells."""
    cells = df.where(F.col(era_col).isNotNull()).groupBy(family, era_col).agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(tradition)).alias("traditions")
    )
    every = df.select(F.col(family).alias("__f")).distinct().select("__f", F.explode(F.array(*[F.lit(e) for e in eras])).alias("__e"))
    out = every.join(cells, (F.col("__f") == F.col(family)) & (F.col("__e") == F.col(era_col)), "left")
    none = F.array().cast("array<string>")
    return out.select(
        F.col("__f").alias(family), F.col("__e").alias("era"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.size("traditions"), F.lit(0)).alias("n_traditions"),
        F.coalesce("traditions", none).alias("traditions"),
    )


def first_attestation(df: DataFrame, family: str, year: str, path: str) -> DataFrame:
    """(family, first_year, first_path): the least year, ties to the least path."""
    first = F.min(F.struct(F.col(year).alias("y"), F.col(path).alias("p")))
    return df.where(F.col(year).isNotNull()).groupBy(family).agg(first.alias("f")).select(family, F.col("f.y").alias("first_year"), F.col("f.p").alias("first_path"))


def undated(df: DataFrame, text: str, year: str) -> DataFrame:
    """(text, n): rows without a year."""
    return df.where(F.col(year).isNull()).groupBy(text).agg(F.count(F.lit(1)).alias("n"))


def text_summary(df: DataFrame, text: str, record: str, motif: str) -> DataFrame:
    return df.groupBy(text).agg(F.count_distinct(record).alias("records"), F.count_distinct(motif).alias("motifs"), F.count(F.lit(1)).alias("occurrences"))


def two_map_index(df: DataFrame, key: str, group: str, sub: str) -> DataFrame:
    """(key, total, groups, subs): occurrences of each key by tradition and by sub-corpus; null keys are skipped."""
    per = df.where(F.col(key).isNotNull()).groupBy(key, group, sub).agg(F.count(F.lit(1)).alias("n"))
    maps = []
    for c in (group, sub):
        one = per.groupBy(key, c).agg(F.sum("n").alias("n")).groupBy(F.col(key).alias(f"__{c}"))
        maps.append((c, one.agg(F.sum("n").alias(f"__n_{c}"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias(f"__m_{c}"))))
    (a, first), (b, second) = maps
    out = first.join(second, F.col(f"__{a}") == F.col(f"__{b}"))
    return out.select(F.col(f"__{a}").alias(key), F.col(f"__n_{a}").alias("total"), F.col(f"__m_{a}").alias("groups"), F.col(f"__m_{b}").alias("subs"))


def subcorpus_rollup(df: DataFrame, sub: str, text: str, record: str, motif: str) -> DataFrame:
    """(sub, texts, records, occurrences, motifs): records of each text counted apart, motifs once. No set is gathered."""
    return df.groupBy(sub).agg(
        F.count_distinct(text).alias("texts"), F.count_distinct(text, record).alias("records"), F.count(F.lit(1)).alias("occurrences"), F.count_distinct(motif).alias("motifs")
    )


def coverage(texts: DataFrame, records: DataFrame, text: str) -> DataFrame:
    """texts with n_records and a status: no_extractions or extracted."""
    n = records.groupBy(F.col(text).alias("__t")).agg(F.count(F.lit(1)).alias("n"))
    both = texts.join(n, texts[text] == F.col("__t"), "left").withColumn("n_records", F.coalesce("n", F.lit(0)))
    return both.withColumn("status", F.when(F.col("n_records") == 0, "no_extractions").otherwise("extracted")).drop("__t", "n")


def value_counts(df: DataFrame, value: str, exploded: bool = False) -> DataFrame:
    """(value, n), most frequent first."""
    one = df.select(F.explode(value).alias(value)) if exploded else df.select(value)
    return one.groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), value)


def rate(df: DataFrame, group: str, condition: Column, places: int = 3) -> DataFrame:
    """(group, caught, total, rate) of a condition."""
    return df.groupBy(group).agg(F.count_if(condition).alias("caught"), F.count(F.lit(1)).alias("total"), F.round(F.count_if(condition) / F.count(F.lit(1)), places).alias("rate"))


def declared_against_observed(declared: DataFrame, observed: DataFrame, key: str, n: str = "n") -> DataFrame:
    """(key, declared, observed) where the two counts differ, either missing counting as 0."""
    d = declared.select(F.col(key).alias("__d"), F.col(n).alias("declared"))
    o = observed.select(F.col(key).alias("__o"), F.col(n).alias("observed"))
    both = d.join(o, F.col("__d").eqNullSafe(F.col("__o")), "full_outer")
    out = both.select(F.coalesce("__d", "__o").alias(key), F.coalesce("declared", F.lit(0)).alias("declared"), F.coalesce("observed", F.lit(0)).alias("observed"))
    return out.where(F.col("declared") != F.col("observed"))


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def multi_assigned(df: DataFrame, item: str, family: str) -> DataFrame:
    """(item, families) of items in more than one family."""
    return df.groupBy(item).agg(F.array_sort(F.collect_set(family)).alias("families")).where(F.size("families") > 1)


def label_spread(df: DataFrame, label: str, pile: str, tradition: str, order: str, min_len: int = 4) -> DataFrame:
    """(key, display, piles): lower-case labels with their distinct traditions by pile, and the first spelling."""
    kept = df.withColumn("__key", F.lower(label)).where(F.length("__key") >= min_len)
    per = kept.groupBy("__key", pile).agg(F.count_distinct(tradition).alias("n"), F.min(F.struct(order, label)).alias("__f"))
    piles = F.map_from_entries(F.array_sort(F.collect_list(F.struct(pile, "n"))))
    return per.groupBy(F.col("__key").alias("key")).agg(F.min("__f").getField(label).alias("display"), piles.alias("piles"))


def pile_counts(df: DataFrame, label: str, in_first: Column) -> DataFrame:
    """One row: labels of the first pile only, of the second only, of both."""
    per = df.groupBy(label).agg(F.max(in_first.cast("int")).alias("a"), F.max((~in_first).cast("int")).alias("b"))
    a, b = F.col("a") == 1, F.col("b") == 1
    return per.agg(F.count_if(a & ~b).alias("first_only"), F.count_if(~a & b).alias("second_only"), F.count_if(a & b).alias("both"))


def theme_tally(df: DataFrame, text: str, themes: dict[str, str]) -> DataFrame:
    """(theme, n): rows whose text matches each theme's pattern; one pass, one row a theme."""
    hits = F.array(*[F.struct(F.lit(k).alias("theme"), F.coalesce(F.col(text).rlike(p), F.lit(False)).cast("int").alias("hit")) for k, p in themes.items()])
    return df.select(F.explode(hits).alias("h")).groupBy("h.theme").agg(F.sum("h.hit").alias("n"))


def best_of(df: DataFrame, group: str, item: str, value: str) -> DataFrame:
    """(group, item) of the greatest value, ties to the smaller item."""
    return df.groupBy(group).agg(F.min(F.struct((-F.col(value)).alias("v"), item)).getField(item).alias(item))


def mean_sd(df: DataFrame, value: str, places: int = 2) -> DataFrame:
    return df.agg(F.round(F.avg(value), places).alias("mean"), F.round(F.stddev_pop(value), places).alias("sd"), F.max(value).alias("most"))
