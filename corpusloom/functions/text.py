"""Column functions on text: labels, quotes, sentences, lenient payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shortest fragment of an elided quote that is looked for.
MIN_FRAGMENT = 12


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def slug(c: Column | str, sep: str = "_") -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one separator, none at the ends."""
    inner = F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", sep)
    return F.regexp_replace(inner, f"^{sep}+|{sep}+$", "")


def titleize(c: Column | str) -> Column:
    """First letter of each word in upper case, the rest as it was (initcap would lower it)."""
    words = F.split(F.regexp_replace(_col(c), "[_-]+", " "), " +")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), " ")


def display_label(*choices: Column | str) -> Column:
    """The first choice that is neither null nor blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(_col(c)), F.lit("")) for c in choices])


def path_tradition(c: Column | str, unknown: str = "unknown", segment: int = 2) -> Column:
    """A path's segment (from 0) when the path has a further one, else `unknown`."""
    parts = F.split(_col(c), "/")
    return F.when(F.size(parts) > segment + 1, F.get(parts, segment)).otherwise(F.lit(unknown))


def basename(c: Column | str, suffix: str = "") -> Column:
    last = F.element_at(F.split(_col(c), "/"), -1)
    return F.regexp_replace(last, f"\\Q{suffix}\\E$", "") if suffix else last


def norm_ws(c: Column | str) -> Column:
    """Straight quotes, plain dashes, dots for an ellipsis, white space as one space, trimmed."""
    plain = F.translate(_col(c), "“”„‟‘’‚‛–—", "\"\"\"\"''''--")
    plain = F.regexp_replace(plain, "…", "...")
    return F.trim(F.regexp_replace(plain, r"[ \t\n\x0B\f\r]+", " "))


def quote_fragments(quote: Column, min_fragment: int = MIN_FRAGMENT) -> Column:
    """Parts of a normalised quote between ellipses (dots, or in brackets) that are long enough."""
    parts = F.transform(F.split(quote, r"\[\.\.\.\]|\.{3,}"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: F.length(x) >= min_fragment)


def quote_matches(quote: Column | str, haystack: Column | str, min_fragment: int = MIN_FRAGMENT) -> Column:
    """Whether a normalised text contains a normalised quote: whole, or all fragments if it has two or more."""
    q, h = _col(quote), _col(haystack)
    parts = quote_fragments(q, min_fragment)
    return F.when(F.size(parts) <= 1, F.contains(h, q)).otherwise(F.forall(parts, lambda x: F.contains(h, x)))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared share of two sets given as arrays; 1 for two empty ones."""
    a, b = _col(a), _col(b)
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def response_text(parts: Column, fallback: Column | None = None) -> Column:
    """Text of the message parts (an array of struct(type, text)) by lines, stripped; else the fallback."""
    joined = F.trim(F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "message"), lambda p: p["text"]), "\n"))
    return F.coalesce(F.nullif(joined, F.lit("")), *([fallback] if fallback is not None else []))


def lenient_json(c: Column | str, schema: str) -> Column:
    """The payload of a text by schema: without its code fence, else from its first brace to its last, else null."""
    text = F.trim(F.regexp_replace(_col(c), r"(?s)^\s*```[A-Za-z]*\s*|\s*```\s*$", ""))
    whole = F.when(F.is_valid_utf8(text) & text.startswith("{") & text.endswith("}"), text)
    inner = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    checked = [F.when(F.try_parse_json(x).isNotNull(), x) for x in (whole, inner)]
    return F.from_json(F.coalesce(*checked), schema)


def first_sentences(c: Column | str, count: int = 2) -> Column:
    """The first sentences of a body, white space as one space."""
    flat = F.trim(F.regexp_replace(_col(c), r"\s+", " "))
    return F.array_join(F.slice(F.split(flat, r"(?<=[.?!])\s+"), 1, count), " ")


def evidence_quote(c: Column | str, max_chars: int = 480, count: int = 3) -> Column:
    """The first three sentences; a longer text is cut at the last end of a sentence within max_chars."""
    text = first_sentences(c, count)
    cut = F.substring(text, 1, max_chars)
    ended = F.regexp_extract(cut, r"(?s)^(.*[.?!])", 1)
    return F.when(F.length(text) <= max_chars, text).otherwise(F.coalesce(F.nullif(ended, F.lit("")), cut))


def year_label(c: Column | str) -> Column:
    """A signed year as text: negative ones are BCE."""
    y = _col(c)
    return F.when(y < 0, F.concat((-y).cast("string"), F.lit(" BCE"))).otherwise(F.concat(y.cast("string"), F.lit(" CE")))


def midpoint(start: Column | str, end: Column | str) -> Column:
    """The middle year, rounded down also below zero."""
    return F.floor((_col(start) + _col(end)) / 2.0).cast("long")


def thousands(c: Column | str) -> Column:
    return F.format_number(_col(c), 0)


def start_line_hint(raw: Column | str, within: int = 800) -> Column:
    """The first `start:` value in the characters after `passage_locator:`, without parsing the document."""
    after = F.substring(F.regexp_extract(_col(raw), r"(?s)passage_locator:(.*)", 1), 1, within)
    return F.regexp_extract(after, r"start:\s*['\"]?(\d+)", 1).try_cast("int")


def trim_occurrence(evidence: Column | str, limit: int = 240) -> Column:
    """First evidence quote of an occurrence, cut for listing."""
    return F.substring(F.get(_col(evidence), 0)["quote"], 1, limit)


def iso_date(c: Column | str) -> Column:
    """A time as its date, `2026-07-20`."""
    return F.date_format(_col(c), "yyyy-MM-dd")


def utc_stamp(c: Column | str) -> Column:
    """A time of the session's zone (UTC) to the second, `2026-07-20T18:54:58Z`."""
    return F.date_format(_col(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def compact_stamp(c: Column | str) -> Column:
    """The same for file names, `2026-07-20T185458Z`."""
    return F.date_format(_col(c), "yyyy-MM-dd'T'HHmmss'Z'")
