"""HTML extraction by wrappers: union-free regular expressions inferred by host.

A page is a nested token stream: its block elements, and in them runs of text, which are slots. The streams
of one host are aligned two at a time: equal tokens match, a mismatch
becomes an optional item, a run of equal items (or of equal pairs and triples) a
repeated group. What remains is the host's wrapper. Each of its items knows how much text it holds over
the host's pages, how much of that in links, and about how many different texts.

So the wrapper tells which slot holds the running text of a host: from the page's
root the way goes to the element that has most of the text, as long as one has. What is in
it is main text, whether or not it recurs; beside it only headings and paragraphs are, if they vary
from page to page. Element names and classes are priors: they weigh an element's text, and
take menus, footers and the like out of the slot that was chosen.

Partial wrappers are made within tasks (one for each host a task meets), and
only these are moved and merged, a bounded number at a time: no task ever holds
the pages of a host.
"""

from __future__ import annotations

import functools
import hashlib
import html
import json
import re
import sys
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, materialise, table

#: Hosts whose partial wrappers a task holds before it hands them on, and partial wrappers of a host that are merged at a time.
HELD, MERGED = 2_000, 64
#: The way goes on to an element that has this share of the (weighed) text; a slot that at least so many pages have is fixed if it has
#: hardly more than one text, one more for this share of the pages; digests kept of a slot's texts, from which their number is estimated.
SHARE, FIXED_PAGES, FIXED_SHARE, KEPT = 0.6, 3, 0.1, 8
#: Weights of text in elements by their priors: furniture by name or role, furniture by class, an article; of fixed texts; of links.
WEIGH_HARD, WEIGH_SOFT, WEIGH_MAIN, WEIGH_FIXED, WEIGH_LINKS = 0.02, 0.5, 2.0, 0.05, 0.1
#: Total size up to which what is known of hosts is broadcast; beyond, it is joined to the pages by shuffle.
BROADCAST_BYTES = 32 * 1024 * 1024
#: In that join a host of more pages than HOT is dealt to SALT tasks.
HOT, SALT = 100_000, 64

# Element names of HTML by role, and words in class, id or role that mark furniture.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style textarea title xmp template iframe noembed noframes svg canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("aside button datalist dialog fieldset footer form head header input label menu nav optgroup option select".split())
MAIN = frozenset("article main".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead "
    "menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted related replies respond share sharing "
    "sidebar signup skip social sponsor sponsored sponsors subscribe toolbar widget".split()
)
ROLES = frozenset("alert banner complementary contentinfo dialog menu menubar navigation search status toolbar".split())
# Marks that hold for an article or main element too: it is a reader's comment.
COMMENTS = frozenset("comment comments reply replies respond".split())
# First words of a class that tells of a property (has-comments), and of one that names a part of the article (entry-header).
TELLS = frozenset("has with no is not without hide show js".split())
PARTS = frozenset("article post entry story content chapter section title".split())
# Words that say nothing beside a mark (site-footer, ad-box), and further ones that may follow it.
NEUTRAL = frozenset("site page main top bottom left right inner outer box bar block container wrapper wrap section list area item items row col column button buttons link links group panel slot unit global".split())
AFTER = frozenset("content text body title message form".split())
# Elements that hold others, and those of them that may be furniture but can hold a whole page too.
CONTAINERS = frozenset("html body div article main section center td tr tbody table th details form fieldset".split())
OPEN_FURNITURE = frozenset("form fieldset".split())
HEADINGS = frozenset("h1 h2 h3".split())
# An open element that a start tag closes, if it is the current one.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*(?:>|\Z))", re.S
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORDS = re.compile(r"[A-Za-z]+|[0-9]+")
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.I)
HOST_SQL = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"

# What is known of a block from the elements it stands in: bits, the higher deciding.
IS_MAIN, SOFT, HARD = 1, 2, 4


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def digest(text: str) -> int:
    """64 bits that stand for a text; 0 is left free."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) or 1


def _marked(names: list[str]) -> bool:
    """Whether some class marks furniture: a mark with no other word than such as say nothing (ad-box, site-footer, post-comments).

    A class that names a part of the article beside it (content social) outweighs all but readers' comments.
    """
    marks, part = set(), False
    for name in names:
        words = [w for w in _WORDS.findall(name) if not w.isdigit()]
        if not words or words[0] in TELLS:
            continue
        before = NEUTRAL if words[-1] in ("header", "banner") else NEUTRAL | PARTS
        if words[0] in MARKS and all(w in MARKS | NEUTRAL | AFTER for w in words[1:]):
            marks.add(words[0])
        elif words[-1] in MARKS and all(w in before for w in words[:-1]):
            marks.add(words[-1])
        else:
            part = part or words[0] in PARTS
    return bool(marks & COMMENTS if part else marks)


@functools.lru_cache(maxsize=65_536)
def _label(tag: str, attributes: str) -> tuple[str, int]:
    """(label, bits) of a start tag; bits of its own: IS_MAIN, SOFT (marked by class or id), HARD (by element or role)."""
    label, bits, names = tag, HARD if tag in FURNITURE else 0, []
    if "=" in attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            value = next((v for v in values if v), "").lower()
            if name.lower() == "role":
                bits |= HARD if value in ROLES else IS_MAIN if value == "main" else 0
            else:
                names += value.split()
        words = _WORDS.findall(names[0]) if names else ()
        if words and words[0].isalpha():
            label = f"{tag}.{words[0]}"
    if tag in ("html", "body"):
        return label, 0
    if tag in MAIN:
        return (label, HARD) if COMMENTS.intersection(names) else (label, IS_MAIN)
    if tag in ("h1", "h2", "h3", "h4", "h5", "h6", "p"):
        names = [n for n in names if n in MARKS]  # of headings and paragraphs only whole words tell
    return label, bits | (SOFT if _marked(names) else 0)


class Element:
    """An element that is open where some text stands: label with its own bits, whether it stands in an article, and the item made of it."""

    __slots__ = ("tag", "label", "within", "above", "item")

    def __init__(self, tag: str, label: str, within: bool, above: Element | None):
        self.tag, self.label, self.within, self.above, self.item = tag, label, within, above, None


class Block:
    """A run of text between block tags: the element it stands in (if any), its text and its characters in links."""

    __slots__ = ("element", "text", "linked")

    def __init__(self, element: Element | None, text: str, linked: int):
        self.element, self.text, self.linked = element, text, linked


def blocks(page: str) -> list[Block]:
    """The non-empty text blocks of a page in order; unclosed and stray tags are borne as browsers do."""
    out: list[Block] = []
    stack: list[Element] = []
    pieces: list[str] = []
    link, linked = 0, 0
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.append(Block(stack[-1] if stack else None, text, min(linked, len(text))))
            pieces.clear()
        linked = 0

    while at < end:
        token = _TOKEN.search(page, at)
        stop = token.start() if token else end
        if stop > at:
            pieces.append(page[at:stop])
            if link:
                linked += stop - at
        if not token:
            break
        at = token.end()
        tag = token[2]
        if not tag:
            continue
        tag = tag.lower()
        if token[1]:
            if tag in BLOCKS:
                flush()
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
            elif tag == "a":
                link = 0
            continue
        if tag in RAW:
            # what it holds is no text of the page; an unclosed one holds the rest
            if not token[3].endswith("/>"):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else end
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                pieces.append(" ")
            continue
        if tag == "a":
            link = 1
            continue
        if tag not in BLOCKS:
            # inline furniture (buttons, labels); text of other inline and unknown elements stays with the block
            if tag in ("button", "label") and not token[3].endswith("/>"):
                close = re.compile(rf"</{tag}[^>]*>", re.I).search(page, at)
                at = close.end() if close else at
            continue
        flush()
        if stack and stack[-1].tag == "p":
            stack.pop()  # a block ends an open paragraph
        closes = CLOSES.get(tag)
        while closes and stack and stack[-1].tag in closes:
            stack.pop()
        if tag == "body":
            stack[:] = [x for x in stack if x.tag != "head"]
        label, own = _label(tag, token[3])
        above = stack[-1] if stack else None
        within = bool(above and above.within)
        if tag == "header" and within and own == HARD:
            own = 0  # the heading of an article
        stack.append(Element(tag, f"{label}~{own}", within or bool(own & IS_MAIN), above))
    flush()
    return out


# A wrapper is a list of items [label, optional, repeated, items below, characters, of these in links, places, pages, texts]. The label is
# that of an element, with its bits and its shape, "#" for a text slot, "(" for a group. Characters are summed over pages; pages are those that have the item; texts are the
# least digests of its texts. Places, in the wrapper of one page only, are the numbers of the blocks that a text item stands for, as a tree of pairs.
LABEL, OPTIONAL, REPEATED, BELOW, CHARS, LINKED, PLACES, PAGES, TEXTS = range(9)


def tag_of(item: list) -> str:
    return item[LABEL].partition("~")[0].partition(".")[0]


def bits_of(item: list) -> int:
    return int(item[LABEL].partition("~")[2][:1] or 0)


def _merged(a: list, b: list, along: bool, one_page: bool = False) -> list:
    """One item of two that match; along: two in a row; one_page: of one page, else of two."""
    places = b[PLACES] if a[PLACES] is None else a[PLACES] if b[PLACES] is None else (a[PLACES], b[PLACES])
    below = align(a[BELOW], b[BELOW], along or one_page) if a[BELOW] or b[BELOW] else a[BELOW]
    pages = max(a[PAGES], b[PAGES]) if along or one_page else a[PAGES] + b[PAGES]
    texts = tuple(sorted({*a[TEXTS], *b[TEXTS]})[:KEPT])
    return [a[LABEL], a[OPTIONAL] or b[OPTIONAL], a[REPEATED] or b[REPEATED] or along, below, a[CHARS] + b[CHARS], a[LINKED] + b[LINKED], places, pages, texts]


def _optional(items: list) -> list:
    return [[x[LABEL], True, *x[REPEATED:]] for x in items]


def fold(items: list) -> list:
    """Runs of equal items become one repeated item, runs of equal pairs or triples a repeated group."""
    out: list = []
    for item in items:
        if out and out[-1][LABEL] == item[LABEL] and item[LABEL] != "(":
            out[-1] = _merged(out[-1], item, True)
        else:
            out.append(item)
    for width in (2, 3):
        if len(out) < 2 * width:
            break
        done, k = [], 0
        while k < len(out):
            key = [x[LABEL] for x in out[k : k + width]]
            to = k + width
            if len(key) == width and "(" not in key:
                while [x[LABEL] for x in out[to : to + width]] == key:
                    to += width
            if to - k >= 2 * width:
                below = out[k : k + width]
                for turn in range(k + width, to, width):
                    below = [_merged(x, y, False, True) for x, y in zip(below, out[turn : turn + width])]
                done.append(_group(below, True))
                k = to
            else:
                done.append(out[k])
                k += 1
        out = done
    return out


def _group(below: list, repeated: bool) -> list:
    return ["(", False, repeated, below, 0, 0, None, max(x[PAGES] for x in below), ()]


def _key(item: list) -> str:
    return "(" + ",".join(x[LABEL] for x in item[BELOW]) if item[LABEL] == "(" else item[LABEL]


def _grouped(items: list, groups: dict[tuple, list]) -> list:
    """items with those that follow each other as in a group of the other side made such a group (of one turn)."""
    if not groups:
        return items
    labels, out, k = [x[LABEL] for x in items], [], 0
    while k < len(items):
        for key in groups:
            if tuple(labels[k : k + len(key)]) == key:
                out.append(_group(items[k : k + len(key)], False))
                k += len(key)
                break
        else:
            out.append(items[k])
            k += 1
    return out


def _pairs(a: list[str], b: list[str]) -> Iterator[tuple[int, int]]:
    """Places of a and b that match, rising in both.

    Equal beginnings and ends match; between them the n-th occurrences of a key are
    partners, of which the longest rising run matches, and so on within its gaps.
    It takes n log n at any length.
    """
    todo = [(0, len(a), 0, len(b))]
    found = []
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            found.append((m, n))
        if i == m or j == n:
            continue
        places, seen = {}, {}
        for q in range(j, n):
            nth = seen[b[q]] = seen.get(b[q], 0) + 1
            places[b[q], nth] = q
        seen, ends, last, before = {}, [], [], {}
        for p in range(i, m):
            nth = seen[a[p]] = seen.get(a[p], 0) + 1
            q = places.get((a[p], nth))
            if q is not None:
                k = bisect_left(ends, q)
                before[q] = p, last[k - 1] if k else None
                ends[k:], last[k:] = ([q], [q]) if k == len(ends) else ([q, *ends[k + 1 :]], [q, *last[k + 1 :]])
        q = last[-1] if last else None
        if q is None:
            continue
        after_p, after_q = m, n
        while q is not None:
            p, former = before[q]
            found.append((p, q))
            todo.append((p + 1, after_p, q + 1, after_q))
            after_p, after_q, q = p, q, former
        todo.append((i, after_p, j, after_q))
    return iter(sorted(found))


def matched(a: list, b: list) -> Iterator[tuple[list | None, list | None]]:
    """Items of two levels in a common order, None where the other side has no partner."""
    groups = [{tuple(x[LABEL] for x in item[BELOW]): item for item in side if item[LABEL] == "("} for side in (a, b)]
    a, b = _grouped(a, groups[1]), _grouped(b, groups[0])
    i = j = 0
    for p, q in [*_pairs(list(map(_key, a)), list(map(_key, b))), (len(a), len(b))]:
        yield from ((x, None) for x in a[i:p])
        yield from ((None, y) for y in b[j:q])
        if p < len(a):
            yield a[p], b[q]
        i, j = p + 1, q + 1


def align(a: list, b: list, one_page: bool = False) -> list:
    """Two levels as one: what matches is merged, what only one has becomes optional. one_page: both are of one page."""
    if not a or not b:
        return _optional(a or b)
    out, optional = [], False
    for x, y in matched(a, b):
        optional = optional or x is None or y is None
        out.append(_merged(x, y, False, one_page) if x is not None and y is not None else _optional([x or y])[0])
    return fold(out) if optional else out


def page_wrapper(found: list[Block]) -> list:
    """The wrapper of one page: its blocks as nested items, folded from the innermost out."""
    top: list = []
    for b in found:  # a page's elements may have been made items before
        element = b.element
        while element is not None and element.item is not None:
            element.item, element = None, element.above
    for at, b in enumerate(found):
        fresh, element = [], b.element
        while element is not None and element.item is None:
            fresh.append(element)
            element = element.above
        level = top if element is None else element.item[BELOW]
        for element in reversed(fresh):
            element.item = [element.label, False, False, [], 0, 0, None, 1, ()]
            level.append(element.item)
            level = element.item[BELOW]
        level.append(["#", False, False, [], len(b.text), b.linked, at, 1, (digest(b.text) & 0xFFFFFFFF,)])
    return _folded(top)


def _shape(item: list) -> str:
    """What tells elements of one name apart: "-" holds text alone, "^" has a heading."""
    if tag_of(item) not in CONTAINERS:
        return ""
    if all(x[LABEL] == "#" for x in item[BELOW]):
        return "-"
    return "^" if any(tag_of(x) in HEADINGS for x in item[BELOW]) else ""


def _folded(items: list) -> list:
    # innermost levels first, without recursion: pages may be nested to any depth
    order, todo = [], [items]
    while todo:
        level = todo.pop()
        order.append(level)
        todo += [x[BELOW] for x in level if x[BELOW]]
    for level in reversed(order):
        for x in level:
            x[LABEL] += _shape(x)
        level[:] = fold(level)
    return items


def packed(wrapper: list) -> str:
    """A wrapper as JSON: its items in order with their depth, so that any depth can be written."""
    out, todo = [], [(0, x) for x in reversed(wrapper)]
    while todo:
        depth, x = todo.pop()
        out.append([depth, x[LABEL], int(x[OPTIONAL]), int(x[REPEATED]), x[CHARS], x[LINKED], x[PAGES], x[TEXTS]])
        todo += [(depth + 1, y) for y in reversed(x[BELOW])]
    return json.dumps(out, separators=(",", ":"), ensure_ascii=False)


def unpacked(text: str) -> list:
    levels: list[list] = [[]]
    for depth, label, optional, repeated, chars, linked, pages, texts in json.loads(text):
        item = [label, bool(optional), bool(repeated), [], chars, linked, None, pages, tuple(texts)]
        del levels[depth + 1 :]
        levels[depth].append(item)
        levels.append(item[BELOW])
    return levels[0]


def _deep(work):
    """Runs work where wrappers may be nested to any depth."""

    @functools.wraps(work)
    def run(*arguments):
        if sys.getrecursionlimit() < 1_000_000:
            sys.setrecursionlimit(1_000_000)
        return work(*arguments)

    return run


def _links(item: list) -> bool:
    return 2 * item[LINKED] > item[CHARS]


def _fixed(item: list) -> bool:
    """Whether a slot has hardly more than one text over the pages that have it."""
    if item[PAGES] < FIXED_PAGES:
        return False
    texts = item[TEXTS]
    different = len(texts) if len(texts) < KEPT else (KEPT - 1) * 2**32 / max(texts[-1], 1)
    return different <= 1 + FIXED_SHARE * item[PAGES]


class Wrapper:
    """A host's wrapper, to read its pages by; without one (None) a page's own stream is its wrapper."""

    def __init__(self, wrapper: list | None):
        self.items = wrapper
        self.weights: dict[int, tuple[float, float]] = {}
        self.fixed_count = False
        if wrapper is not None:
            self._weigh(wrapper)
            # where most text is fixed, pages are copies of each other: what varies tells nothing then
            slots = [x for x in self._slots(wrapper) if not _links(x)]
            self.fixed_count = 2 * sum(x[CHARS] for x in slots if _fixed(x)) < sum(x[CHARS] for x in slots)
            self._weigh(wrapper)

    def _slots(self, items: list) -> Iterator[list]:
        todo = list(items)
        while todo:
            x = todo.pop()
            if x[LABEL] == "#":
                yield x
            elif not bits_of(x) & HARD:
                todo += x[BELOW]

    def _weigh(self, items: list) -> None:
        """For each item its text over all pages, weighed by priors and plain."""
        order, todo = [], list(items)
        while todo:
            x = todo.pop()
            order.append(x)
            todo += x[BELOW]
        for x in reversed(order):
            if x[LABEL] == "#":
                plain = x[CHARS] * (WEIGH_LINKS if _links(x) else 1.0)
                self.weights[id(x)] = plain * (WEIGH_FIXED if self.fixed_count and _fixed(x) else 1.0), plain
                continue
            weighed, plain = (sum(self.weights[id(y)][k] for y in x[BELOW]) for k in (0, 1))
            bits = bits_of(x)
            factor = WEIGH_HARD if bits & HARD else (WEIGH_SOFT if bits & SOFT else 1.0) * (WEIGH_MAIN if bits & IS_MAIN else 1.0)
            self.weights[id(x)] = factor * weighed, plain

    def _of(self, item: list, which: int) -> float:
        """Text of an item on a page that has it."""
        return self.weights[id(item)][which] / max(item[PAGES], 1)

    def _level(self, page: list, items: list) -> list[tuple[list, list]]:
        """A page's items of one level, those in groups too, each with the wrapper's (its own where the wrapper has none)."""
        out = []
        for x, y in matched(page, items):
            if x is None:
                continue
            if y is None:
                self._weigh([x])
            if x[LABEL] == "(":
                out += self._level(x[BELOW], (y or x)[BELOW])
            else:
                out.append((x, y or x))
        return out

    @_deep
    def kept(self, found: list[Block]) -> list[int]:
        """The places of a page's blocks that are main text, by matching the page against the wrapper."""
        page = page_wrapper(found)
        items = self.items
        if items is None:
            self._weigh(page)
            items = page
        out: list[int] = []

        def take(item: list) -> None:
            places = [item[PLACES]]
            while places:
                at = places.pop()
                if type(at) is tuple:
                    places += at
                else:
                    out.append(at)

        # (page's level, wrapper's level, the way goes on, in an article, fixed texts go)
        todo = [(page, items, True, False, True)]
        while todo:
            own, known, choose, within, strict = todo.pop()
            level = self._level(own, known)
            whole, plain = (sum(self._of(y, k) for _, y in level) for k in (0, 1))
            chosen = next((x for x, y in level if choose and self._may_hold(y) and self._of(y, 0) >= SHARE * whole > 0), None)
            for x, y in level:
                if x[LABEL] == "#":
                    if not (strict and self.fixed_count and _fixed(y)) and (within or not _links(y)):
                        take(x)
                    continue
                bits, tag = bits_of(x), tag_of(x)
                if x is chosen:
                    top = tag in ("html", "body")
                    todo.append((x[BELOW], y[BELOW], not bits & IS_MAIN, within or bool(bits & IS_MAIN), top))
                elif chosen is not None:
                    title = tag in CONTAINERS and all(tag_of(z) in HEADINGS for z in x[BELOW]) and not chosen[LABEL].endswith("^")
                    if not bits and (tag not in CONTAINERS or title):
                        todo.append((x[BELOW], y[BELOW], False, within, True))
                elif not bits & (HARD | SOFT) or (2 * self._of(y, 1) > plain and (not bits & HARD or tag in OPEN_FURNITURE)):
                    todo.append((x[BELOW], y[BELOW], False, within or bool(bits & IS_MAIN), strict))
        return sorted(out)

    def _may_hold(self, item: list) -> bool:
        """Whether the way can go on to an element: it holds others, stands once on a page, or is an article, and is no furniture by its name."""
        bits, tag = bits_of(item), tag_of(item)
        return tag in CONTAINERS and (not item[REPEATED] or bool(bits & IS_MAIN)) and (not bits & HARD or tag in OPEN_FURNITURE)


def main_text(page: str | None, wrapper: Wrapper | None) -> str:
    """The main text of a page read through its host's wrapper: the blocks that this takes as running text."""
    found = blocks(page or "")
    return "\n".join(found[at].text for at in (wrapper or Wrapper(None)).kept(found))


def _host(url: str | None):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST_SQL, 1))


def _with_host(pages: DataFrame, known: DataFrame, hot: DataFrame) -> DataFrame:
    """pages (host, ...) with the columns of known (host, ...: strings or arrays), null where it has no such host.

    Known rows are broadcast up to BROADCAST_BYTES, by a sum over them; beyond,
    both sides are shuffled by host, those of hot hosts dealt to SALT tasks each. Hot hosts are
    broadcast: they are at most the number of pages divided by HOT.
    """
    columns = [c for c in known.columns if c != "host"]
    size = known.agg(F.sum(F.length("host") + 64 + sum(F.length(F.col(c).cast("string")) for c in columns))).first()[0] or 0
    known = known.withColumnRenamed("host", "__host")
    if size <= BROADCAST_BYTES:
        return pages.join(F.broadcast(known), pages["host"] == F.col("__host"), "left").drop("__host")
    hot = F.broadcast(hot.select(F.col("host").alias("__hot")))
    salt = F.when(F.col("__hot").isNull(), 0).otherwise(F.pmod(F.xxhash64("url", "page_id"), F.lit(SALT)).cast("int"))
    dealt = pages.join(hot, pages["host"] == F.col("__hot"), "left").withColumn("__salt", salt).drop("__hot")
    turns = F.when(F.col("__hot").isNull(), 0).otherwise(SALT - 1)
    named = known.join(hot, F.col("__host") == F.col("__hot"), "left").withColumn("__deal", F.explode(F.sequence(F.lit(0), turns))).drop("__hot")
    return dealt.join(named, (F.col("host") == F.col("__host")) & (F.col("__salt") == F.col("__deal")), "left").drop("__host", "__deal", "__salt")


def hot_hosts(pages: DataFrame) -> DataFrame:
    """(host) of hosts with more than HOT pages."""
    return materialise(pages.groupBy("host").count().where(F.col("count") > HOT).select("host"), "hot-hosts")


def infer(pages: DataFrame) -> DataFrame:
    """pages (host, html) -> (host, wrapper): one row for each host, its wrapper packed."""
    schema = "host string, wrapper string"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        align_deep = _deep(align)

        def out() -> pd.DataFrame:
            rows = [(h, packed(w)) for h, w in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=["host", "wrapper"])

        for pdf in batches:
            for host, page in zip(pdf["host"], pdf["html"]):
                own = _deep(page_wrapper)(blocks(page or ""))
                held[host] = align_deep(held[host], own) if host in held else own
            if len(held) > HELD:
                yield out()
        if held:
            yield out()

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        merged: list = []
        for k, text in enumerate(pdf["wrapper"].sort_values()):
            merged = _deep(align)(merged, unpacked(text)) if k else unpacked(text)
        return pd.DataFrame({"host": [pdf["host"].iat[0]], "wrapper": [packed(merged)]})

    parts = materialise(pages.select("host", "html").mapInPandas(partial, schema), "wrappers")
    while True:  # a host's parts are merged some at a time, so that no task holds all of a host's
        most = parts.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return parts
        turns = -(-most // MERGED)
        share = F.pmod(F.xxhash64("wrapper", F.monotonically_increasing_id()), F.lit(turns))
        parts = materialise(parts.withColumn("share", share).groupBy("host", "share").applyInPandas(lambda pdf: whole(pdf), schema), "wrappers")


@functools.lru_cache(maxsize=1024)
def _wrapper(text: str) -> Wrapper:
    return Wrapper(unpacked(text))


def extract(pages: DataFrame) -> DataFrame:
    """One row for each row of pages: page_id, url, text, n_chars.

    The text is the page's main blocks joined by a line feed, character
    references decoded, white space made one space; "" if there is none, or html
    is null. A page without a host is one of the host "". Pages of any length are
    read whole, elements nested to any depth; repeated rows are answered each; other columns are ignored.
    An empty table gives an empty result.
    """
    own = pages.select("page_id", "url", "html", _host("url").alias("host"))
    both = _with_host(own, infer(own), hot_hosts(own))

    def make():
        def run(texts: list, wrappers: list) -> tuple:
            found = [main_text(h, _wrapper(w) if w else None) for h, w in zip(texts, wrappers)]
            return found, list(map(len, found))

        return run

    return mapped(both, ["page_id", "url"], ["html", "wrapper"], make, {"text": ("string", pa.string()), "n_chars": ("long", pa.int64())})


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extract() of the whole table `pages`; nulls, empty and long pages, repeated rows and an empty table as there."""
    return extract(table(spark, sf_dir, "pages"))
