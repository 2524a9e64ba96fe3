"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a predicate that rejects a document. On a bounded sample the
cascade measures which rows each rule rejects and what it costs, and then asks
the rules in the order of rejection per cost, of the rows that those before it leave: a CASE whose first true branch
ends it. The order is only a matter of speed; the verdict is the same in any.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, WORD, hashed_sample, materialise, n_words, pinned, table

#: Rows of the sample from which the cascade learns its order (verdicts don't depend on it).
SAMPLE_ROWS = 2_048
WINDOW = 8


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


def _covered(words: Column) -> Column:
    """Words in windows of WINDOW = 8 words that are in the list twice or more, the first included.

    Window hashes are built by doubling (1, 2, 4, 8 words), sorted with their
    places, and equal neighbours marked; each marked place covers the words up to
    the next marked one, 8 at most.
    """
    h = F.transform(words, lambda w: F.xxhash64(w))
    for width in (1, 2, 4):
        h = _paired(h, width)
    spread = F.aggregate(
        F.array(h),  # names the array once: each reference below is to the lambda's variable
        F.lit(0).cast("long"),
        lambda acc, a: acc + F.when(F.size(F.array_distinct(a)) == F.size(a), F.lit(0).cast("long")).otherwise(_repeated(a)),
    )
    return F.when(F.size(words) >= WINDOW, spread).otherwise(F.lit(0).cast("long"))


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _paired(h: Column, step: int) -> Column:
    """xxhash64(h[i], h[i + step]) for each i that has both."""

    def body(a: Column) -> Column:
        n = F.greatest(F.size(a) - step, F.lit(0))
        return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(step + 1), n), lambda x, y: F.xxhash64(x, y))

    return _let(h, body)


def _repeated(a: Column) -> Column:
    """Words covered by the windows of a whose hash is in a twice or more."""
    placed = F.array_sort(F.zip_with(a, F.sequence(F.lit(0), F.size(a) - 1), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def marks(s: Column) -> Column:
        n = F.size(s) - 1
        same = F.zip_with(F.slice(s, F.lit(1), n), F.slice(s, F.lit(2), n), lambda x, y: x["h"] == y["h"])

        def places(e: Column) -> Column:
            either = F.zip_with(F.concat(e, F.array(F.lit(False))), F.concat(F.array(F.lit(False)), e), lambda x, y: x | y)
            return F.array_sort(F.filter(F.zip_with(s, either, lambda x, d: F.when(d, x["i"])), lambda i: i.isNotNull()))

        return _let(same, places)

    def cover(p: Column) -> Column:
        gaps = F.zip_with(p, F.slice(p, F.lit(2), F.greatest(F.size(p), F.lit(1))), lambda x, y: F.least(F.coalesce(y - x, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, g: acc + g)

    return _let(_let(placed, marks), cover)


def measures(text: str = "text") -> dict[str, Column]:
    """What the rules look at, by name. A null text is as an empty one; whole texts count."""
    t = F.coalesce(F.col(text), F.lit(""))
    w = F.filter(F.split(t, SPACE), lambda x: x != "")
    symbols = F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))
    return {
        "n_words": n_words(t),
        "word_chars": F.length(F.regexp_replace(t, SPACE, "")).cast("long"),
        "n_symbols": symbols.cast("long"),
        "n_lines": F.size(_lines(t)).cast("long"),
        "n_dup_lines": _let(_lines(t), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _let(w, _covered),
        "n_adjacent": _let(
            w, lambda x: F.size(F.filter(F.zip_with(x, F.slice(x, F.lit(2), F.greatest(F.size(x), F.lit(1))), lambda a, b: a == b), lambda e: e))
        ).cast("long"),
    }


#: rule: (measures it needs, predicate in SQL over them that rejects)
BASE_RULES = {
    "short": (("n_words",), "n_words < 20"),
    "repeated_windows": (("n_words", "n_repeat_words"), "100 * n_repeat_words > 30 * n_words"),
}
RULES = {
    "symbols": (("n_words", "n_symbols"), "10 * n_symbols > n_words"),
    "duplicate_lines": (("n_lines", "n_dup_lines"), "100 * n_dup_lines > 40 * n_lines"),
    "stutter": (("n_words", "n_adjacent"), "10 * n_adjacent > 3 * n_words"),
    "word_length": (("n_words", "word_chars"), "word_chars < 2 * n_words or word_chars > 15 * n_words"),
}


def rule_columns(rules: dict[str, tuple[tuple[str, ...], str]], given: dict[str, Column]) -> dict[str, Column]:
    """Each rule as one boolean column over the text: its measures are evaluated only when it is asked."""
    out = {}
    for name, (needs, predicate) in rules.items():
        record = F.struct(*[given[k].alias(k) for k in needs])
        holds = _predicate(predicate)
        out[name] = F.coalesce(F.exists(F.array(record), holds), F.lit(False))
    return out


def _predicate(sql: str):
    """A predicate such as "a * 10 > b or ..." as a function of a struct of its names."""
    import re

    def run(row: Column) -> Column:
        whole = F.lit(False)
        for part in sql.split(" or "):
            left, sign, right = re.fullmatch(r"(.+) ([<>]) (.+)", part).groups()
            a, b = (_product(x, row) for x in (left, right))
            whole = whole | (a < b if sign == "<" else a > b)
        return whole

    return run


def _product(sql: str, row: Column) -> Column:
    out = F.lit(1).cast("long")
    for x in sql.split(" * "):
        out = out * (F.lit(int(x)).cast("long") if x.isdigit() else row[x])
    return out


def cascade_order(docs: DataFrame, rules: dict[str, Column], sample_rows: int = SAMPLE_ROWS, before: dict[str, Column] | None = None) -> list[str]:
    """The rules by rejections per second, each of the rows that those before it leave, best first.

    Measured on a hashed sample of at most sample_rows rows. A rule's cost is the
    time to ask it of the sample less that of a plan which asks nothing. What it rejects is taken from the counts of
    the rules that hold together, so survivors are exact. `before`: rules that have been asked already.
    """
    before = before or {}
    keys = [k for k in ("doc_id", "text") if k in docs.columns]
    sample = materialise(hashed_sample(docs.select(*keys), keys, sample_rows), "quality-sample")

    def seconds(column: Column) -> float:
        best = float("inf")
        for _ in range(2):  # the first also compiles
            began = time.perf_counter()
            sample.agg(F.avg(column)).collect()
            best = min(best, time.perf_counter() - began)
        return best

    nothing = seconds(F.length("text"))
    cost = {name: max(seconds(rejects.cast("int")) - nothing, 1e-4) for name, rejects in rules.items()}
    flags = F.array(*[x.cast("int") for x in (*before.values(), *rules.values())])
    patterns = [(list(r["flags"]), r["count"]) for r in sample.select(flags.alias("flags")).groupBy("flags").count().collect()]
    left = [(dict(zip(rules, f[len(before) :])), n) for f, n in patterns if not any(f[: len(before)])]
    out: list[str] = []
    while len(out) < len(rules):
        gain = {name: (sum(n for f, n in left if f[name]) + 1e-6) / cost[name] for name in rules if name not in out}
        out.append(min(gain, key=lambda name: (-gain[name], name)))
        left = [(f, n) for f, n in left if not f[out[-1]]]
    return out


def cascade(docs: DataFrame, rules: dict[str, Column], order: list[str]) -> DataFrame:
    """docs with `rejected_by`: the first rule, in this order, that rejects the row, else null."""
    verdict = None
    for name in order:
        verdict = F.when(rules[name], F.lit(name)) if verdict is None else verdict.when(rules[name], F.lit(name))
    return docs.withColumn("rejected_by", verdict if verdict is not None else F.lit(None).cast("string"))


def keep_quality(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs without the rows that a rule rejects; columns as they were, repeated rows kept as often.

    Null and empty texts have no words and go as short; very long texts count whole. An empty table stays empty.
    """
    rules = rule_columns(BASE_RULES | RULES, measures())
    order = cascade_order(docs, rules, sample_rows)
    verdict = None
    for name in order:
        verdict = F.when(rules[name], F.lit(False)) if verdict is None else verdict.when(rules[name], F.lit(False))
    return docs.where(verdict.otherwise(F.lit(True)))


def score_quality(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row for each row of docs: doc_id, the base measures, base_failed, kept and rejected_by.

    The base measures are wanted of every row; the cascade then asks the rules
    in order over them, and the measures that only a rule needs are computed for
    rows which come that far. Null and empty texts have no words: all counts 0,
    base_failed. Very long texts count whole.
    """
    given = measures()
    order = cascade_order(docs, rule_columns(RULES, given), sample_rows, rule_columns(BASE_RULES, given))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    wide = pinned(docs.select("doc_id", "text"), m=F.struct(*[given[k].alias(k) for k in base]))
    known = {k: F.col(f"m.{k}") for k in base}
    rules = rule_columns(RULES, given | known)
    failed = F.coalesce(F.exists(F.array(F.col("m")), lambda r: _predicate(BASE_RULES["short"][1])(r) | _predicate(BASE_RULES["repeated_windows"][1])(r)), F.lit(True))
    verdict = F.when(failed, F.lit("base"))
    for name in order:
        verdict = verdict.when(rules[name], F.lit(name))
    out = wide.select("doc_id", *[known[k].alias(k) for k in base], failed.alias("base_failed"), verdict.alias("rejected_by"))
    return out.withColumn("kept", F.col("rejected_by").isNull())


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_quality() of the whole table `documents`; nulls, empty and long texts, repeated rows and an empty table as there."""
    found = score_quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rowid_ AS id, i, list_aggregate(ws[i:i+7], 'string_agg', ' ') AS win
      FROM (SELECT doc_id AS rowid_, ws, unnest(range(1, greatest(len(ws) - 6, 1))) AS i FROM w)),
dup AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, win) AS c FROM g) WHERE c > 1),
cov AS (SELECT id, sum(least(8, coalesce(nxt - i, 8))) AS c
        FROM (SELECT id, i, lead(i) OVER (PARTITION BY id ORDER BY i) AS nxt FROM dup) GROUP BY id),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, len(array_to_string(ws, ''))::BIGINT AS word_chars,
             (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
             coalesce(c, 0)::BIGINT AS n_repeat_words,
             len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1])) AS n_adjacent
      FROM w LEFT JOIN cov ON cov.id = w.doc_id),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 40 * n_lines
            OR 10 * n_adjacent > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM f
"""
