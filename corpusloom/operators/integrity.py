"""Evidence integrity: quotations in their sources, references within records, vocabularies, structure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import MIN_FRAGMENT, norm_ws, quote_matches


def verify_quotes(quotes: DataFrame, sources: DataFrame, record: str, source: str, quote: str = "quote", text: str = "text", min_fragment: int = MIN_FRAGMENT) -> DataFrame:
    """quotes with `status`: verified, failed or source_missing. Each source is normalised once, before the join."""
    ready = sources.select(F.col(source).alias("__s"), norm_ws(text).alias("__h"))
    both = quotes.join(ready, quotes[source] == F.col("__s"), "left")
    found = quote_matches(norm_ws(quote), F.col("__h"), min_fragment)
    return both.withColumn("status", F.when(F.col("__s").isNull(), "source_missing").when(found, "verified").otherwise("failed")).drop("__s", "__h")


def quote_rollup(verified: DataFrame, record: str, quote: str = "quote", samples: int = 2, chars: int = 120) -> DataFrame:
    """One row per record: verified, failed and missing counts, rate to 4 places, and a few failed quotes."""
    n = F.count(F.lit(1))
    ok = F.count_if(F.col("status") == "verified")
    counts = verified.groupBy(record).agg(
        ok.alias("n_verified"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.count_if(F.col("status") == "source_missing").alias("n_missing"),
        F.round(ok / n, 4).alias("rate"),
    )
    # cut before they are gathered: a record may have any number of failed quotes
    failed = verified.where("status = 'failed'").select(F.col(record).alias("__r"), F.substring(quote, 1, chars).alias("__q"))
    first = failed.withColumn("__n", F.row_number().over(Window.partitionBy("__r").orderBy("__q"))).where(F.col("__n") <= samples)
    listed = first.groupBy("__r").agg(F.array_sort(F.collect_list("__q")).alias("samples"))
    none = F.array().cast("array<string>")
    return counts.join(listed, F.col(record).eqNullSafe(F.col("__r")), "left").withColumn("samples", F.coalesce("samples", none)).drop("__r")


def bad_line_ranges(records: DataFrame, lines: DataFrame, source: str, start: str = "start", end: str = "end") -> DataFrame:
    """Records whose start and end aren't numbers with 1 <= start <= end <= lines of the source."""
    n = lines.groupBy(F.col(source).alias("__s")).agg(F.max("line_no").alias("__n"))
    both = records.join(n, records[source] == F.col("__s"), "left")
    a, b = F.col(start).cast("string"), F.col(end).cast("string")
    number = a.rlike(r"^\d+$") & b.rlike(r"^\d+$")
    good = number & (a.try_cast("int") >= 1) & (a.try_cast("int") <= b.try_cast("int")) & (b.try_cast("int") <= F.coalesce("__n", F.lit(0)))
    return both.where(~F.coalesce(good, F.lit(False))).select(*records.columns)


def repeated_ids(records: DataFrame, ids: str) -> DataFrame:
    """Records whose array of ids holds one twice."""
    return records.where(F.size(ids) != F.size(F.array_distinct(ids)))


def dangling(refs: DataFrame, ref: str, ids: DataFrame, id_col: str, within: Sequence[str] = ()) -> DataFrame:
    """Rows of refs whose ref isn't among the ids, of the same `within` columns if given."""
    known = ids.select(F.col(id_col).alias("__id"), *[F.col(c).alias(f"__{c}") for c in within]).distinct()
    on = refs[ref] == F.col("__id")
    for c in within:
        on = on & (refs[c] == F.col(f"__{c}"))
    return refs.join(known, on, "left_anti")


def dangling_within(records: DataFrame, refs: str, ids: str) -> DataFrame:
    """Records with `missing`: the refs of a row that aren't among its own ids. No shuffle."""
    return records.withColumn("missing", F.array_except(refs, ids)).where(F.size("missing") > 0)


def outside_vocabulary(refs: DataFrame, ref: str, *vocabularies: tuple[DataFrame, str]) -> DataFrame:
    """Rows of refs whose ref is in none of the vocabularies (families, aliases, groups, index)."""
    known = None
    for df, c in vocabularies:
        one = df.select(F.col(c).alias("__v"))
        known = one if known is None else known.unionByName(one)
    return refs.join(known.distinct(), refs[ref] == F.col("__v"), "left_anti")


def bin_cover(children: DataFrame, child: str, binned: DataFrame, bin_child: str) -> DataFrame:
    """(child, problem): children in no bin, in several, or binned without being children."""
    got = binned.groupBy(F.col(bin_child).alias("__c")).agg(F.count(F.lit(1)).alias("__n"))
    want = children.select(F.col(child).alias("__w")).distinct()
    both = want.join(got, F.col("__w") == F.col("__c"), "full_outer")
    problem = F.when(F.col("__c").isNull(), "unbinned").when(F.col("__w").isNull(), "unknown").when(F.col("__n") > 1, "repeated")
    return both.select(F.coalesce("__w", "__c").alias("child"), problem.alias("problem")).where(F.col("problem").isNotNull())


def missing_fields(df: DataFrame, key: str, required: Sequence[str]) -> DataFrame:
    """(key, field) for each required field that is null or blank."""
    blank = [F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(c)) for c in required]
    return df.select(key, F.explode(F.filter(F.array(*blank), lambda x: x.isNotNull())).alias("field"))


def type_errors(df: DataFrame, key: str, corrupt: str = "_corrupt_record") -> DataFrame:
    """Rows that a permissive read with a declared schema couldn't parse."""
    return df.where(F.col(corrupt).isNotNull()).select(key, corrupt)


def evidence_for(evidence: Column, refs: Column) -> Column:
    """Evidence items whose id is among the refs, in the order of the evidence."""
    return F.filter(evidence, lambda e: F.array_contains(refs, e["id"]))
