"""Line operators: a document as rows (doc, line_no from 1, line), and cleaning steps over them.

Windows are partitioned by document, so the largest unit of one task is one
document. Whole-document rewrites use one regular expression instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lines as L
from ..sources.readers import raw_extensions


def _doc(doc: str) -> Window:
    return Window.partitionBy(doc).orderBy("line_no")


def to_lines(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, line_no, line); a null text has no lines."""
    parts = df.select(F.col(doc), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    return parts.select(doc, (F.col("pos") + 1).cast("long").alias("line_no"), "line")


def to_text(lines: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines joined again in order; one row for each document that has lines left."""
    rows = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy(doc).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias(text))


def plain(text: Column) -> Column:
    """CRLF to LF, no spaces at line ends, four or more line feeds to three, none at the ends."""
    out = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "(?m)[ \t]+$", "")
    return F.regexp_replace(F.regexp_replace(out, "\n{4,}", "\n\n\n"), "^\n+|\n+$", "")


def with_front_matter(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Adds front_end: the line of the closing `---`, 0 without front matter."""
    fence = F.col("line").rlike(r"^---\s*$")
    opens = F.max(F.when((F.col("line_no") == 1) & F.col("line").startswith("---"), 1)).over(Window.partitionBy(doc))
    close = F.min(F.when(fence & (F.col("line_no") > 1), F.col("line_no"))).over(Window.partitionBy(doc))
    return lines.withColumn("front_end", F.when(opens == 1, F.coalesce(close, F.lit(0))).otherwise(0))


def trim_range(lines: DataFrame, first: int | None = None, last: int | None = None, doc: str = "doc_id") -> DataFrame:
    """Keeps lines first..last (1-based, inclusive) and front matter whatever the range."""
    inside = (F.col("line_no") >= (first or 1)) & (F.col("line_no") <= F.lit(last) if last else F.lit(True))
    return with_front_matter(lines, doc).where(inside | (F.col("line_no") <= F.col("front_end"))).drop("front_end")


def running_headers(lines: DataFrame, min_repeats: int = 15, max_len: int = 60, doc: str = "doc_id") -> DataFrame:
    """(doc, form, n): forms of header-like lines that a document repeats min_repeats times or more."""
    shaped = lines.where(L.header_like(F.col("line"), max_len)).select(doc, L.header_form(F.trim("line")).alias("form"))
    return shaped.groupBy(doc, "form").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_repeats)


def drop_furniture(lines: DataFrame, min_repeats: int = 15, max_len: int = 60, doc: str = "doc_id") -> DataFrame:
    """Lines without scanning boilerplate, page numbers and running headers."""
    body = lines.where(~L.is_boilerplate(F.col("line")) & ~L.is_page_number(F.col("line")))
    heads = running_headers(lines, min_repeats, max_len, doc).select(F.col(doc).alias("__doc"), F.col("form").alias("__form"))
    shaped = body.withColumn("__own", F.when(L.header_like(F.col("line"), max_len), L.header_form(F.trim("line"))))
    return shaped.join(heads, (F.col(doc) == F.col("__doc")) & (F.col("__own") == F.col("__form")), "left_anti").drop("__own")


def dehyphenate(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Joins a line ending in a letter and hyphen with the next if that begins in lower case.

    Pairs don't overlap: of a chain of such lines the first takes the second,
    the third the fourth. Joined lines keep the number of their first.
    """
    w = _doc(doc)
    after = F.lead("line").over(w)
    flagged = lines.withColumn("__j", F.coalesce(F.col("line").rlike("[a-z]-$") & F.ltrim(after).rlike("^[a-z]"), F.lit(False))).withColumn("__next", after)
    # place within a run of joinable lines: odd places join, even ones are taken by the line before
    flagged = flagged.withColumn("__run", F.sum((~F.col("__j")).cast("int")).over(w) + F.col("__j").cast("int"))
    placed = flagged.withColumn("__k", F.when(F.col("__j"), F.row_number().over(Window.partitionBy(doc, "__run", "__j").orderBy("line_no"))))
    placed = placed.withColumn("__joins", F.coalesce(F.col("__k") % 2 == 1, F.lit(False)))
    placed = placed.withColumn("__taken", F.coalesce(F.lag("__joins").over(w), F.lit(False)))
    joined = F.concat(F.regexp_replace("line", "-$", ""), F.ltrim("__next"))
    return placed.where(~F.col("__taken")).select(doc, "line_no", F.when(F.col("__joins"), joined).otherwise(F.col("line")).alias("line"))


def collapse_blanks(lines: DataFrame, most: int = 2, doc: str = "doc_id") -> DataFrame:
    """Blank lines emptied, and no more than `most` of them in a row."""
    w = _doc(doc)
    blank = F.trim("line") == ""
    marked = lines.withColumn("__solid", F.sum((~blank).cast("int")).over(w)).withColumn("__blank", blank)
    run = F.row_number().over(Window.partitionBy(doc, "__solid", "__blank").orderBy("line_no"))
    marked = marked.withColumn("__n", run)
    return marked.where(~F.col("__blank") | (F.col("__n") <= most)).select(doc, "line_no", F.when(F.col("__blank"), "").otherwise(F.col("line")).alias("line"))


def clean_ocr(lines: DataFrame, first: int | None = None, last: int | None = None, min_repeats: int = 15, doc: str = "doc_id") -> DataFrame:
    """The cleaning of a scanned book: trim, furniture, hyphens, blanks."""
    return collapse_blanks(dehyphenate(drop_furniture(trim_range(lines, first, last, doc), min_repeats, doc=doc), doc), doc=doc)


def guarded_trim(lines: DataFrame, first: int, last: int, pattern: str, doc: str = "doc_id") -> DataFrame:
    """Keeps first..last of documents whose line `first` matches; adds `status`: any other keeps all its lines as aborted."""
    good = F.max(F.when((F.col("line_no") == first) & F.col("line").rlike(pattern), 1)).over(Window.partitionBy(doc)) == 1
    marked = lines.withColumn("status", F.when(F.coalesce(good, F.lit(False)), "trimmed").otherwise("aborted"))
    return marked.where((F.col("status") == "aborted") | F.col("line_no").between(first, last))


def tail_cut(lines: DataFrame, pattern: str, share: float = 0.2, doc: str = "doc_id") -> DataFrame:
    """Cuts from the first match in the last `share` of a document's lines."""
    w = Window.partitionBy(doc)
    n = F.max("line_no").over(w)
    cut = F.min(F.when(F.col("line").rlike(pattern) & (F.col("line_no") > n * (1 - share)), F.col("line_no"))).over(w)
    return lines.withColumn("__cut", cut).where(F.col("__cut").isNull() | (F.col("line_no") < F.col("__cut"))).drop("__cut")


def state_machine(lines: DataFrame, keep: str, drop: str, start: bool = False, doc: str = "doc_id") -> DataFrame:
    """Lines while the last trigger was one of keep; the trigger lines follow their own state."""
    trigger = F.when(F.col("line").rlike(keep), True).when(F.col("line").rlike(drop), False)
    state = F.last(trigger, ignorenulls=True).over(_doc(doc).rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("__on", F.coalesce(state, F.lit(start))).where("__on").drop("__on")


def min_run(lines: DataFrame, keep: Column, content: Column, least: int = 5, doc: str = "doc_id") -> DataFrame:
    """Runs of kept lines that hold `least` content lines or more; a dropped line ends a run."""
    marked = lines.withColumn("__keep", keep).withColumn("__content", content)
    marked = marked.withColumn("__run", F.sum((~F.col("__keep")).cast("int")).over(_doc(doc))).where("__keep")
    n = F.sum(F.col("__content").cast("int")).over(Window.partitionBy(doc, "__run"))
    return marked.withColumn("__n", n).where(F.col("__n") >= least).drop("__keep", "__content", "__run", "__n")


def paragraphs(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, para_no, start_line, end_line, text): runs of non-blank lines."""
    solid = F.trim("line") != ""
    fresh = solid & (F.coalesce(F.trim(F.lag("line").over(_doc(doc))), F.lit("")) == "")
    marked = lines.withColumn("para_no", F.sum(fresh.cast("int")).over(_doc(doc))).where(solid)
    rows = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return marked.groupBy(doc, "para_no").agg(
        F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("text")
    )


def rejoin_paragraphs(text: Column) -> Column:
    """A paragraph that ends in a letter, comma or semicolon takes one that begins in lower case."""
    return F.regexp_replace(text, r"([a-z,;])[ \t]*\n[ \t]*\n[ \t]*([a-z])", "$1 $2")


def neutral_angles(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, "<>", "()"), " {2,}", " ")


def drop_listed(lines: DataFrame, listed: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Lines that, trimmed, are not in listed.line. The planner broadcasts the list if it is small."""
    return lines.join(listed.select(F.trim("line").alias("__l")).distinct(), F.trim(lines["line"]) == F.col("__l"), "left_anti")


def soft_hyphens(text: Column) -> Column:
    """Joins at `¬`, across blank lines too."""
    return F.regexp_replace(text, r"¬\s*\n\s*", "")


def opening(text: Column, lines: int = 60, chars: int = 4000) -> Column:
    return F.substring(F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n"), 1, chars)


def sections(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, heading, start_line, end_line, body) of `##` and `###` headings; `# ` lines belong to no body.

    Of a heading that a document repeats the last one stays.
    """
    title = F.when(F.col("line").rlike("^#{2,3} "), F.trim(F.regexp_replace("line", "^#{2,3} ", "")))
    opened = lines.withColumn("__h", title).withColumn("__start", F.when(F.col("__h").isNotNull(), F.col("line_no")))
    w = _doc(doc).rowsBetween(Window.unboundedPreceding, 0)
    opened = opened.withColumn("heading", F.last("__h", True).over(w)).withColumn("start_line", F.last("__start", True).over(w))
    body = opened.where(F.col("heading").isNotNull() & ~F.col("line").rlike("^# "))
    rows = F.array_sort(F.collect_list(F.when(F.col("__h").isNull(), F.struct("line_no", "line"))))
    one = body.groupBy(doc, "heading", "start_line").agg(F.max("line_no").alias("end_line"), F.trim(F.array_join(F.transform(rows, lambda r: r["line"]), "\n")).alias("body"))
    last = F.row_number().over(Window.partitionBy(doc, "heading").orderBy(F.desc("start_line")))
    return one.withColumn("__r", last).where("__r = 1").drop("__r")


def between_markers(lines: DataFrame, markers: Sequence[tuple[str, str]], doc: str = "doc_id") -> DataFrame:
    """Keeps the ranges [from, to) of the marker pairs, each marker looked for after the one before it."""
    w = Window.partitionBy(doc)
    marked, last = lines, F.lit(0)
    inside = F.lit(False)
    for k, (start, stop) in enumerate(markers):
        for name, pattern in ((f"__a{k}", start), (f"__b{k}", stop)):
            marked = marked.withColumn(name, F.min(F.when(F.col("line").rlike(pattern) & (F.col("line_no") > last), F.col("line_no"))).over(w))
            last = F.coalesce(F.col(name), F.lit(2**31 - 1))
        inside = inside | ((F.col("line_no") >= F.col(f"__a{k}")) & (F.col("line_no") < F.coalesce(F.col(f"__b{k}"), F.lit(2**31 - 1))))
    return marked.where(F.coalesce(inside, F.lit(False))).select(*lines.columns)


def stop_at_garble(lines: DataFrame, least: int = 6, doc: str = "doc_id") -> DataFrame:
    """Lines before the first run of `least` blank or one-word lines."""
    poor = F.size(F.filter(F.split(F.trim("line"), r"\s+"), lambda t: t.rlike("[A-Za-z]{2,}"))) < 2
    marked = lines.withColumn("__poor", poor).withColumn("__run", F.sum((~poor).cast("int")).over(_doc(doc)))
    runs = Window.partitionBy(doc, "__run", "__poor")
    first = F.min(F.when(F.col("__poor") & (F.col("__n") >= least), F.col("line_no"))).over(Window.partitionBy(doc))
    marked = marked.withColumn("__n", F.count(F.lit(1)).over(runs)).withColumn("__stop", first)
    return marked.where(F.col("__stop").isNull() | (F.col("line_no") < F.col("__stop"))).select(*lines.columns)


def quality_blocks(lines: DataFrame, signatures: Sequence[str] = L.GLYPHS, least: int = 3, min_letters: float = 0.65, max_marks: int = 2, max_foreign: float = 0.34, doc: str = "doc_id") -> DataFrame:
    """Blocks between blank lines of enough lines, mostly letters, with few carets and backslashes and few foreign tokens."""
    parts = paragraphs(lines, doc)
    solid = F.length(F.regexp_replace("text", r"\s", ""))
    letters = F.length(F.regexp_replace("text", "[^A-Za-z]", ""))
    marks = F.length("text") - F.length(F.regexp_replace("text", r"[\^\\]", ""))
    toks = L.tokens(F.col("text"))
    good = (F.size(F.split("text", "\n")) >= least) & (letters >= min_letters * solid) & (marks < max_marks)
    return parts.where(good & (L.signature_count(toks, signatures) < max_foreign * F.greatest(F.size(toks), F.lit(1))))


def tail_backtrack(lines: DataFrame, marker: str, min_words: int = 2, doc: str = "doc_id") -> DataFrame:
    """Cuts at the last marker, and before it back to the last line of min_words words."""
    w = Window.partitionBy(doc)
    marked = lines.withColumn("__m", F.max(F.when(F.col("line").rlike(marker), F.col("line_no"))).over(w))
    worded = F.size(F.filter(F.split(F.trim("line"), r"\s+"), lambda t: t.rlike("[A-Za-z]"))) >= min_words
    end = F.max(F.when(worded & (F.col("line_no") < F.col("__m")), F.col("line_no"))).over(w)
    return marked.withColumn("__end", F.when(F.col("__m").isNotNull(), F.coalesce(end, F.lit(0)))).where(F.col("__m").isNull() | (F.col("line_no") <= F.col("__end"))).select(*lines.columns)


# What clean Markdown doesn't hold.
HTML_ENTITY = r"&(?:amp|apos|copy|gt|ldquo|lsquo|mdash|nbsp|ndash|quot|rdquo|rsquo);|&#(?:\d+|x[0-9a-fA-F]+);"
HTML_TAG = r"</?[A-Za-z][A-Za-z0-9:-]*(?:\s+[^<>]*)?/?>"
SCRIPT_TAG = r"(?i)</?(?:script|style)\b[^>]*>"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


def raw_downloads(files: DataFrame, path: str = "path") -> DataFrame:
    """(path, line_no, rule): the lint's rule of files: raw downloads among the clean texts, hidden files apart."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    found = raw_extensions(files.where(~name.startswith(".")), path)
    return found.select(path, F.lit(1).alias("line_no"), F.lit("raw download file").alias("rule"))


def lint(lines: DataFrame, doc: str = "doc_id", texts_only: Column | None = None) -> DataFrame:
    """(doc, line_no, rule) for each broken rule of clean Markdown.

    Rules: final newline, trailing space, control character, three blank lines,
    script or style tag, other tag, undecoded entity, distributor boilerplate.
    Front matter and code fences are exempt from the last four, inline code too.
    """
    w = _doc(doc)
    line = F.col("line")
    fence = line.rlike(r"^[ \t]*(```|~~~)")
    marked = with_front_matter(lines, doc).withColumn("__front", (F.col("line_no") <= F.col("front_end")))
    marked = marked.withColumn("__fences", F.sum((fence & ~F.col("__front")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    blank = F.trim("line") == ""
    marked = marked.withColumn("__last", F.max("line_no").over(Window.partitionBy(doc)))
    # after a final newline comes one empty part, which is no line
    marked = marked.withColumn("__blank", blank & ((F.col("line_no") < F.col("__last")) | (line != "")))
    marked = marked.withColumn("__solid", F.sum((~F.col("__blank")).cast("int")).over(w))
    n = F.row_number().over(Window.partitionBy(doc, "__solid", "__blank").orderBy("line_no"))
    marked = marked.withColumn("__n", F.when(F.col("__blank"), n))
    content = F.regexp_replace(line, "`[^`\n]*`", "")
    prose = ~F.col("__front") & (F.col("__fences") % 2 == 0)
    script = content.rlike(SCRIPT_TAG)
    tag = content.rlike(HTML_TAG) & ~content.rlike(r"^\s*<!--.*-->\s*$")
    entity = content.rlike(HTML_ENTITY)
    rules = [
        F.when((F.col("line_no") == F.col("__last")) & (line != ""), "missing final newline"),
        F.when(line.rlike(r"[ \t]+$"), "trailing whitespace"),
        F.when(line.rlike(CONTROL), "control character"),
        F.when(F.col("__n") == 3, "excessive blank lines"),
        F.when(prose & script, "script/style tag").when(prose & tag, "raw HTML tag"),
        F.when(prose & entity, "undecoded HTML entity"),
        F.when(prose & (texts_only if texts_only is not None else F.lit(True)) & L.is_boilerplate(line, L.DISTRIBUTOR), "distributor boilerplate"),
    ]
    named = marked.select(doc, "line_no", "__n", F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull())).alias("rule"))
    at = F.when(F.col("rule") == "excessive blank lines", F.col("line_no") - 2).otherwise(F.col("line_no"))
    return named.select(doc, at.alias("line_no"), "rule")
