"""Column functions on single lines or paragraphs: which of them are furniture, garble, or another language."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# English words that mark a text as English, and the patterns of scanning services' lines.
STOPWORDS = tuple(
    """
    the a an and of to in on he she it they we you i is are was were be been
    said say that this these those all one two his her him them there here
    with for from by at as not but or which who what when where how had have
    has would could their your our then see compare according into out
    upon their its also who whom
    """.split()
)
BOILERPLATE = (r"(?i)^Hosted by Google$", r"(?i)^Digiti[sz]ed by (the )?(Google|Internet Archive|Microsoft)", r"(?i)^https?://(www\.)?archive\.org")
PAGE_NUMBER = r"^\[?\d{1,4}\]?$"
DISTRIBUTOR = (
    r"(?i)project gutenberg",
    r"(?i)gutenberg (?:ebook|e-text)",
    r"(?i)\*\*\*\s*start of (?:the )?(?:project gutenberg )?(?:ebook|e-text)",
    r"(?i)\*\*\*\s*end of (?:the )?(?:project gutenberg )?(?:ebook|e-text)",
    r"(?i)this eBook is for the use of anyone anywhere",
    r"(?i)project gutenberg literary archive foundation",
)


def header_form(line: Column) -> Column:
    """A line without digits and punctuation, spaces squeezed, lower case: what running headers share."""
    bare = F.regexp_replace(line, r"[\d\[\]().:;,'\"*—–-]+", " ")
    return F.lower(F.trim(F.regexp_replace(bare, " +", " ")))


def header_like(line: Column, max_len: int = 60, min_form: int = 4) -> Column:
    """Short, with a digit or without lower case, and of a form long enough to be counted."""
    s = F.trim(line)
    return (F.length(s) > 0) & (F.length(s) <= max_len) & (F.length(header_form(s)) >= min_form) & (s.rlike(r"\d") | (s == F.upper(s)))


def is_boilerplate(line: Column, patterns: Sequence[str] = BOILERPLATE) -> Column:
    return F.coalesce(_any(F.trim(line).rlike(p) for p in patterns), F.lit(False))


def is_page_number(line: Column) -> Column:
    return F.trim(line).rlike(PAGE_NUMBER)


def verso_caps_header(line: Column, max_len: int = 50, min_letters: int = 4, ratio: float = 0.7) -> Column:
    """A page number, then a short heading mostly in capitals."""
    rest = F.regexp_extract(F.trim(line), r"^\d{1,4}\s+(.*)$", 1)
    letters = F.length(F.regexp_replace(rest, r"[^A-Za-z]", ""))
    upper = F.length(F.regexp_replace(rest, r"[^A-Z]", ""))
    return (F.length(rest) > 0) & (F.length(rest) <= max_len) & (letters >= min_letters) & (upper >= ratio * letters)


def tokens(c: Column) -> Column:
    """Space-separated tokens that hold more than digits and punctuation."""
    return F.filter(F.split(F.trim(c), r"\s+"), lambda t: ~F.regexp_replace(t, "[\"'“”‘’()\\[\\],.!?;:*—–·]", "").rlike(r"^\d*$"))


def stopword_count(toks: Column, stopwords: Sequence[str] = STOPWORDS, min_len: int = 3) -> Column:
    known = F.array(*[F.lit(w) for w in stopwords])
    plain = F.transform(toks, lambda t: F.regexp_replace(F.lower(t), "[^a-z]", ""))
    return F.size(F.filter(plain, lambda t: (F.length(t) >= min_len) & F.array_contains(known, t)))


def signature_count(toks: Column, signatures: Sequence[str]) -> Column:
    """Tokens that match one of the signature patterns of a language."""
    return F.size(F.filter(toks, lambda t: _any(t.rlike(p) for p in signatures)))


#: Signatures of non-English print: letters beyond ASCII, a capital inside a word, scanning glyphs.
GLYPHS = (r"[^\x00-\x7F]", r"[a-z][A-Z]", "@")


def foreign(c: Column, signatures: Sequence[str] = GLYPHS, stopwords: Sequence[str] = STOPWORDS, min_flags: int = 2, min_ratio: float = 0.0, stopword_veto: bool = True, short_words: int = 4) -> Column:
    """Whether a line or paragraph is of another language: enough signature tokens, by number and share.

    With stopword_veto one English stopword keeps it. A short unit all of whose
    tokens are flagged goes too. One function for all of the family: the
    paragraph rules use shares of 0.15, the line rules 0.34 or 0.40.
    """
    toks = tokens(c)
    n, flags = F.size(toks), signature_count(toks, signatures)
    english = (stopword_count(toks, stopwords) > 0) if stopword_veto else F.lit(False)
    many = (flags >= min_flags) & (flags >= min_ratio * n)
    short = (n <= short_words) & (flags >= 1) & (flags == n)
    return (n > 0) & ~english & (many | short)


def vowel_final(c: Column, function_words: Sequence[str] = STOPWORDS, ratio: float = 0.66, min_words: int = 3, particles: Sequence[str] = ()) -> Column:
    """Languages whose words end in vowels: no function word, enough words, the share of vowel endings, and a particle if some are given."""
    plain = F.filter(F.transform(F.split(F.trim(c), r"\s+"), lambda t: F.regexp_replace(F.lower(t), "[^a-zāēīōū]", "")), lambda t: t != "")
    n = F.size(plain)
    ends = F.size(F.filter(plain, lambda t: t.rlike("[aeiouāēīōū]$")))
    known = F.arrays_overlap(plain, F.array(*[F.lit(w) for w in function_words]))
    need = F.arrays_overlap(plain, F.array(*[F.lit(w) for w in particles])) if particles else F.lit(True)
    return (n >= min_words) & ~known & (ends >= ratio * n) & need


def garble(line: Column, min_alpha: float = 0.5, min_tokens: int = 4, mean_len: float = 2.2) -> Column:
    """Scan bleed: no English stopword, and few ASCII letters or very short tokens."""
    solid = F.length(F.regexp_replace(line, r"\s", ""))
    letters = F.length(F.regexp_replace(line, "[^A-Za-z]", ""))
    n = F.regexp_count(line, F.lit(r"\S+"))
    # tokens are looked at one by one only in lines whose letters or lengths are odd, which are few
    odd = (letters < min_alpha * solid) | ((n >= min_tokens) & (solid <= mean_len * n))
    return (solid > 0) & odd & (stopword_count(tokens(line)) == 0)


def glyph_soup(line: Column, min_alpha: float = 0.4, keep_wordish: float = 0.5) -> Column:
    """Few letters and no word of four; a line of which half the tokens are words is kept."""
    toks = F.filter(F.split(F.trim(line), r"\s+"), lambda t: t != "")
    wordish = F.size(F.filter(toks, lambda t: t.rlike("^[A-Za-z]{2,}[.,;:!?]?$")))
    solid = F.length(F.regexp_replace(line, r"\s", ""))
    letters = F.length(F.regexp_replace(line, "[^A-Za-z]", ""))
    return (solid > 0) & (letters < min_alpha * solid) & ~line.rlike("[A-Za-z]{4}") & (wordish < keep_wordish * F.size(toks))


def no_word(line: Column) -> Column:
    """A non-blank line without a word of three letters."""
    return (F.trim(line) != "") & ~line.rlike("[A-Za-z]{3,}")


def no_stopword(line: Column, stopwords: Sequence[str] = STOPWORDS, min_tokens: int = 3) -> Column:
    """Enough tokens and none a stopword; headings in capitals are protected."""
    toks = tokens(line)
    heading = (F.trim(line) == F.upper(F.trim(line))) & line.rlike("[A-Z]")
    return (F.size(toks) >= min_tokens) & (stopword_count(toks, stopwords, 1) == 0) & ~heading


def short_tokens(line: Column, signatures: Sequence[str] = GLYPHS, min_tokens: int = 5, mean_len: float = 2.7) -> Column:
    """An English content word protects; else a signature drops; else many very short tokens do."""
    toks = tokens(line)
    content = F.exists(toks, lambda t: t.rlike("^[A-Za-z]{5,}[.,;:!?]?$") & t.rlike("(?i)[aeiou]") & ~_any(t.rlike(p) for p in signatures))
    letters = F.aggregate(toks, F.lit(0), lambda s, t: s + F.length(F.regexp_replace(t, "[^A-Za-z]", ""))) / F.greatest(F.size(toks), F.lit(1))
    return F.when(content, False).when(signature_count(toks, signatures) > 0, True).otherwise((F.size(toks) >= min_tokens) & (letters <= mean_len))


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out
