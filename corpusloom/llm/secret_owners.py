"""Secret scan by corpus-wide ownership frequency, in DataFrame functions only.

Three base kinds follow fixed rules and always stay. One pattern of further formats
(vendor keys, signed tokens, key blocks, logins in addresses, named values, random-looking
runs) proposes candidates. The digests of all values are counted over the
corpus by distinct owners and by distinct repositories of these: a value that many hold is a
widely copied example, one that few hold and that looks live is a credential, and
such candidates are added. Only digests, places and flags are written, never values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_unique, materialise, pinned, table

# Kinds in the order in which spans of one start are listed, and the patterns of the base ones. No shorter match begins inside
# one of `access` or `hex` that is too short, so their least length is part of the pattern; of `assign` it is asked afterwards.
KINDS = ("assign", "access", "hex", "vendor", "jwt", "block", "login", "bearer", "named", "run")
BASE = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"(AKIA[A-Z0-9]{12,})",
    "hex": r"([0-9a-f]{32,})",
}
ASSIGNED = 8
# Public formats of credentials; the first that matches at a place counts. Each has its value as group 1.
FORMATS = {
    "vendor": r"((?:gh[pousr]_[A-Za-z0-9]{36}|glpat-[A-Za-z0-9_-]{20}|xox[abposr]-[A-Za-z0-9-]{10,}|[prs]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|npm_[A-Za-z0-9]{36}))",
    "jwt": r"(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})",
    "block": r"(-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]+-----END [A-Z ]*PRIVATE KEY-----)",
    "login": r"://[^\x09-\x20:/@]+:([^\x09-\x20:/@]{6,})@",
    "bearer": r"(?i:bearer)\x20+([A-Za-z0-9._~+/-]{16,})",
    "named": r"""(?i:pwd|passphrase|passcode|credential|auth_?key|access_?key|private_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{8,})""",
    "run": r"([A-Za-z0-9_]{20,})",
}
ANY_FORMAT = "|".join(p.replace("(", "(?:", 1) if p.startswith("(") and not p.startswith("(?") else p for p in FORMATS.values())
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|change_?me|your|xxxx|0000|123456|abcdef"
#: A value looks live with so many different characters, and a run with so many changes from letter to digit.
DIFFERENT, CHANGES = 6, 3
#: A value of more owners than this, or of more of their repositories, is a widely copied example.
OWNERS, REPOSITORIES = 2, 20


def _live_looking(value: Column, kind: Column) -> Column:
    """Not a placeholder, of several characters, a run with letters and digits by turns."""
    varied = F.size(F.array_distinct(F.split(value, ""))) >= DIFFERENT
    mixed = (kind != F.lit("run")) | (F.regexp_count(value, F.lit("[A-Za-z][0-9]")) >= CHANGES)
    return varied & mixed & ~value.rlike(PLACEHOLDER)


def _matches(text: Column, pattern: str, fields) -> Column:
    """A struct for each match of pattern in text, leftmost non-overlapping: what stands before it since the last one, its length, and fields(match).

    Texts without a match, most of them, are passed over once.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    pairs = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), 0), gaps, lambda m, g: F.when(m.isNotNull(), F.struct(g.alias("gap"), F.length(m).alias("len"), *fields(m)))
    )
    return F.when(text.rlike(pattern), F.filter(pairs, lambda x: x.isNotNull()))


def _fields(kind: str, pattern: str):
    """What is kept of a base match: its kind, the digest of its value, and whether it counts."""

    def run(m: Column) -> list[Column]:
        value = F.regexp_extract(m, pattern, 1)
        counts = F.length(value) >= ASSIGNED if kind == "assign" else F.lit(True)
        return [F.lit(KINDS.index(kind)).alias("kind"), F.sha2(value.cast("binary"), 256).alias("digest"), counts.alias("counts"), _live_looking(value, F.lit(kind)).alias("live")]

    return run


def _format_fields(m: Column) -> list[Column]:
    kind = value = None
    for name, pattern in FORMATS.items():
        fits = m.rlike(rf"\A(?:{pattern})\z")
        kind = F.when(fits, F.lit(name)) if kind is None else kind.when(fits, F.lit(name))
        own = F.regexp_extract(m, pattern, 1)
        value = F.when(fits, own) if value is None else value.when(fits, own)
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind).cast("int") - 1
    live = _live_looking(value, kind)
    return [number.alias("kind"), F.sha2(value.cast("binary"), 256).alias("digest"), live.alias("counts"), live.alias("live")]


def candidates(docs: DataFrame, text: str = "text", key: str = "doc_id", owner: str = "source", repository: str | None = None) -> DataFrame:
    """(row, key, owner, repo, found): one row for each row of docs, written to scratch; found has a struct for each match, without the value.

    Whole texts are read, a null one as empty; without a column of repositories, rows of an owner with equal texts are one.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{owner}`").cast("string").alias("owner"),
        (F.col(f"`{repository}`").cast("string") if repository else F.lit(None).cast("string")).alias("repo"), whole.alias("text"),
    )
    each = [_matches(F.col("text"), p, _fields(k, p)) for k, p in BASE.items()] + [_matches(F.col("text"), ANY_FORMAT, _format_fields)]
    # the place among the matches of one pattern, whose gaps and lengths add up to where it starts
    pattern = lambda n: lambda x, i: x.withField("pattern", F.lit(n)).withField("i", i)
    found = F.flatten(F.array(*[F.coalesce(F.transform(c, pattern(n)), F.array()) for n, c in enumerate(each)]))
    rows = pinned(rows, found=found)
    if repository is None:
        rows = rows.withColumn("repo", F.when(F.size("found") > 0, F.sha2(F.col("text").cast("binary"), 256)))
    return materialise(rows.drop("text"), "secret-candidates")


def _placed(rows: DataFrame) -> DataFrame:
    """The matches that count, with start and end: running sums over those of one text and pattern, in order."""
    each = rows.select("row", "owner", "repo", F.explode("found").alias("f")).select("row", "owner", "repo", "f.*")
    before = Window.partitionBy("row", "pattern").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap").cast("long") + F.col("len")).over(before)
    return each.withColumn("end", end).withColumn("start", F.col("end") - F.col("len")).where("counts").drop("gap", "len", "counts", "pattern", "i")


def ownership(values: DataFrame) -> DataFrame:
    """(digest, n_owners, n_repos) of (digest, owner, repo): distinct owners, and distinct repositories of each. A null owner is an owner.

    Repeats go before anything is moved, and again at each step, so a value that a third of all rows holds is a few rows a task.
    """
    by_owner = values.select("digest", "owner", "repo").distinct().groupBy("digest", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("digest").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"))


def secret_spans(rows: DataFrame, owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """(row, kind, start, end, digest, n_owners, n_repos, live): the base spans of candidates(), all of them, and those of other kinds that are live.

    live: looks live, and is held by few owners and few repositories. A span of
    another kind that overlaps a base span is left out.
    """
    spans = materialise(_placed(rows), "secret-spans")
    known = materialise(ownership(spans).withColumnRenamed("digest", "__digest"), "secret-owners")
    judged = join_unique(spans, known, "digest", "__digest").drop("__digest", "owner", "repo")
    live = F.col("live") & (F.col("n_owners") <= owners) & (F.col("n_repos") <= repositories)
    base = F.col("kind") < len(BASE)
    judged = judged.withColumn("live", live).where(base | F.col("live"))
    up = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy("row").orderBy(F.desc("start"), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = judged.withColumn("__until", F.max(F.when(base, F.col("end"))).over(up)).withColumn("__from", F.min(F.when(base, F.col("start"))).over(down))
    clear = (F.coalesce("__until", F.lit(0)) <= F.col("start")) & (F.coalesce("__from", F.col("end")) >= F.col("end"))
    return near.where(base | clear).drop("__until", "__from")


def _listed(spans: Column) -> Column:
    """kind:start:end of spans (start, kind, end), by start and kind."""
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def find_secrets(
    docs: DataFrame, text: str = "text", key: str = "doc_id", owner: str = "source", repository: str | None = None, owners: int = OWNERS, repositories: int = REPOSITORIES
) -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example): one row for each row of docs.

    Counts of the base kinds, the digest of their spans, all spans as text, and how many of these are live and how many
    not. Places are code points, ends exclusive. A null text is as an empty one; repeated rows are counted each,
    but are one repository; null keys stay, null owners are one owner; long texts are read whole; other columns, of any name, play no part.
    """
    rows = candidates(docs, text, key, owner, repository)
    spans = secret_spans(rows.where(F.size("found") > 0), owners, repositories)
    base, at = F.col("kind") < len(BASE), F.struct("start", "kind", "end")
    counts = [F.count(F.when(F.col("kind") == n, 1)).alias(f"n_{k}") for n, k in enumerate(BASE)]
    per_row = spans.groupBy(F.col("row").alias("__row")).agg(
        *counts, F.collect_list(F.when(base, at)).alias("base"), F.collect_list(at).alias("all"), F.count(F.when(F.col("live"), 1)).alias("n_live"), F.count(F.when(~F.col("live"), 1)).alias("n_example")
    )
    some = rows.where(F.size("found") > 0).select("row", "key").join(per_row, F.col("row") == F.col("__row"), "left")
    none = F.sha2(F.lit("").cast("binary"), 256)
    full = some.select(
        "key", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE], F.coalesce(F.sha2(_listed(F.col("base")).cast("binary"), 256), none).alias("base_sha256"),
        F.coalesce(_listed(F.col("all")), F.lit("")).alias("spans"), F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"), F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"),
    )
    zero = F.lit(0).cast("long")
    bare = rows.where(F.size("found") == 0).select("key", *[zero.alias(f"n_{k}") for k in BASE], none.alias("base_sha256"), F.lit("").alias("spans"), zero.alias("n_live"), zero.alias("n_example"))
    return bare.unionByName(full).withColumnRenamed("key", key)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find_secrets() of the whole table `documents`, sources as owners, equal texts of a source as one repository; awkward rows as there."""
    return find_secrets(table(spark, sf_dir, "documents"))


def _literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql() -> str:
    base = [(k, p, f"length(regexp_extract(m, {_literal(p)}, 1)) >= {ASSIGNED}" if k == "assign" else "true") for k, p in BASE.items()]
    kind = " ".join(f"WHEN regexp_full_match(m, {_literal(p)}) THEN {_literal(k)}" for k, p in FORMATS.items())
    value = " ".join(f"WHEN kind = {_literal(k)} THEN regexp_extract(m, {_literal(p)}, 1)" for k, p in {**BASE, **FORMATS}.items())
    each = [
        f"SELECT id, source, t, {n} AS pattern, unnest(regexp_extract_all(t, {_literal(p)})) AS m, unnest(string_split_regex(t, {_literal(p)})[1:len(regexp_extract_all(t, {_literal(p)}))]) AS gap,"
        f" unnest(range(len(regexp_extract_all(t, {_literal(p)})))) AS i FROM d WHERE regexp_matches(t, {_literal(p)})"
        for n, p in enumerate([*BASE.values(), ANY_FORMAT])
    ]
    names = ", ".join(_literal(k) for k in KINDS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS t FROM documents),
e AS ({" UNION ALL ".join(each)}),
k AS (SELECT *, CASE {" ".join(f"WHEN pattern = {n} THEN {_literal(k)}" for n, k in enumerate(BASE))} ELSE CASE {kind} END END AS kind,
             sum(length(gap) + length(m)) OVER (PARTITION BY id, pattern ORDER BY i)::BIGINT AS e FROM e),
v AS (SELECT *, e - length(m) AS s, CASE {value} END AS value, list_position([{names}], kind) AS n FROM k),
l AS (SELECT *, len(list_distinct(string_split(value, ''))) >= {DIFFERENT} AND NOT regexp_matches(value, {_literal(PLACEHOLDER)})
                AND (kind <> 'run' OR len(regexp_extract_all(value, '[A-Za-z][0-9]')) >= {CHANGES}) AS looks FROM v),
c AS (SELECT * FROM l WHERE CASE kind WHEN 'assign' THEN length(value) >= {ASSIGNED} WHEN 'access' THEN true WHEN 'hex' THEN true ELSE looks END),
o AS (SELECT value, count(DISTINCT coalesce('s' || source, 'null')) AS n_owners, count(DISTINCT (coalesce('s' || source, 'null'), t)) AS n_repos FROM c GROUP BY value),
j AS (SELECT c.*, looks AND n_owners <= {OWNERS} AND n_repos <= {REPOSITORIES} AS live, n <= {len(BASE)} AS base FROM c JOIN o USING (value)),
a AS (SELECT * FROM j WHERE base OR (live AND NOT EXISTS (SELECT 1 FROM j b WHERE b.base AND b.id = j.id AND b.s < j.e AND j.s < b.e))),
g AS (SELECT id, {", ".join(f"count(*) FILTER (kind = {_literal(k)}) AS n_{k}" for k in BASE)}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, n) FILTER (base) AS b,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, n) AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example FROM a GROUP BY id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example
FROM d LEFT JOIN g USING (id)
"""


OP12_SQL = _sql()
