"""Personal data: high-recall candidate generators, and boosted trees that choose among them.

Base spans of four kinds (email, ip, card, phone) follow fixed rules and always
stay. Generators propose further, overlapping spans: written-out addresses,
numbers in other groupings, other kinds of address or number. Gradient boosted
trees over format and context features score each; those above their kind's
calibrated threshold are selected, the likeliest of overlapping ones first.

No table has labelled spans, so the trees are trained on contexts cut from the texts
of a bounded sample of the documents, with true spans and look-alikes (order numbers,
versions, dates, sums) planted in them; thresholds are calibrated on other contexts.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import random
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hashed_sample, mapped, shielded, table

# Kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone", "ipv6", "iban", "ssn", "secret")
BASE_KINDS = KINDS[:4]
_ORDER = {k: i for i, k in enumerate(KINDS)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a digit run that doesn't fit can't fit from a later digit of it either, so only run starts are tried
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_AT = re.compile(r"@|\b(?:at|AT)\b")
_ANY = re.compile(r"[0-9@]|\b(?:at|AT)\b")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Matches of local@domain, found from each @: the local part is the run before it, since the last match."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield "email", start, found.end()
            last = found.end()
        elif start < at:
            last = max(last, start)  # no match begins before: the run ends at this @
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[Span]:
    """Spans of the four base kinds, leftmost non-overlapping by kind, in no order. Linear in the text."""
    out: list[Span] = []
    if "@" in text:
        out += _emails(text)
    if _DIGITS.search(text):
        if "." in text:
            out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() < 38:
                digits = "".join(_DIGITS.findall(m[0]))
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGITS.findall(m[0])) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return out


# High-recall generators of further spans. Runs of digit groups, and windows of whole groups in them; a written-out address; others by
# their letters. Each starts at a boundary, from which one pass either matches or not, so that all are linear in the text.
_RUN = re.compile(r"(?<![0-9A-Za-z])[0-9]++(?:[ ._/()-]{1,3}[0-9]++)*+")
_GROUP = re.compile(r"[0-9]+")
_DOT = r"(?:\s?(?:\.|[(\[{]\s?(?:dot|DOT|\.)\s?[)\]}])\s?|\s(?:dot|DOT)\s)"
_WRITTEN_DOT = r"(?:\s?[(\[{]\s?(?:dot|DOT|\.)\s?[)\]}]\s?|\s(?:dot|DOT)\s)"
_GENERATORS = (
    ("email", re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:{_WRITTEN_DOT}[A-Za-z0-9_%+-]++){{0,3}}+(?:\s?[(\[{{]\s?(?:at|AT|@)\s?[)\]}}]\s?|\s(?:at|AT|@)\s)[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++")),
    ("ip", re.compile(rf"(?<![0-9A-Za-z.])[0-9]{{1,3}}+(?:{_DOT}[0-9]{{1,3}}+){{3}}(?![0-9A-Za-z])")),
    ("ipv6", re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}+(?::{1,2}[0-9A-Fa-f]{1,4}+){2,7}+(?![0-9A-Za-z:])")),
    ("iban", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")),
    ("secret", re.compile(r"(?<![0-9A-Za-z_+=-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[0-9A-Za-z_+-]{16,}+={0,2}+(?![0-9A-Za-z])")),
)
_HAS_SECRET = re.compile(r"[0-9A-Za-z_+-]{16}")
#: Digits of a phone number and of a card number outside the base kinds.
PHONE_DIGITS, CARD_DIGITS = (7, 15), (12, 19)


def _windows(text: str) -> Iterator[Span]:
    """Windows of whole digit groups that have as many digits as a phone, card or social security number."""
    for run in _RUN.finditer(text):
        if run.end() - run.start() < 7:
            continue
        groups = [(m.start(), m.end()) for m in _GROUP.finditer(text, run.start(), run.end())]
        for i, (a, _) in enumerate(groups):
            n = 0
            for j in range(i, len(groups)):  # at most as many as a card has digits
                first, b = groups[j]
                n += b - first
                if n > CARD_DIGITS[1]:
                    break
                start = a - 1 if a and text[a - 1] == "(" and ")" in text[a:b] else a
                if PHONE_DIGITS[0] <= n <= PHONE_DIGITS[1]:
                    yield "phone", start, b
                if CARD_DIGITS[0] <= n:
                    yield "card", a, b
                if n == 9 and b - a == 11 and text[a + 3] == text[a + 6] == "-":
                    yield "ssn", a, b


def candidates(text: str) -> list[Span]:
    """Spans that the generators propose, overlaps and all."""
    out: list[Span] = []
    digits = _DIGITS.search(text)
    if digits:
        out += _windows(text)
    for kind, p in _GENERATORS:
        if kind == "email" or digits:
            if kind == "email" and not _AT.search(text) or kind == "ipv6" and ":" not in text or kind == "secret" and not _HAS_SECRET.search(text):
                continue
            out += [(kind, m.start(), m.end()) for m in p.finditer(text)]
    return out


def _iban_ok(s: str) -> bool:
    s = re.sub(r"[^A-Z0-9]", "", s)
    return len(s) > 14 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


_WORD = re.compile(r"[^\W\d_]+")
#: Buckets of the word before a span, of the two before that, of the word after it, and of its own last word.
LAST, EARLIER, NEXT, OWN = 256, 64, 32, 32


def _bucket(word: str, buckets: int) -> int:
    return zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % buckets


def span_features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate as numbers; the words around it are hashed, what they mean is for the trees to learn."""
    kind, a, b = span
    own, before, after = text[a:b], text[max(0, a - 40) : a], text[b : b + 16]
    groups = [len(x) for x in _GROUP.findall(own)]
    digits = "".join(_GROUP.findall(own))
    number = [int(x) for x in _GROUP.findall(own)[:4]] if len(groups) > 2 and len(digits) < 40 else []
    date = len(number) == 3 and any(1 <= d <= 31 and 1 <= m <= 12 for d, m in (number[:2], number[1:], (number[1], number[0]), (number[2], number[1])))
    left, right = before[-1:], after[:1]
    sizes = (groups + [0, 0, 0, 0, 0])[:5]
    shape = [
        float(len(own)), float(len(digits)), float(len(groups)), *map(float, sizes), float(max(groups, default=0)), float(min(groups, default=0)),
        float(len({c for c in own if not c.isalnum()})), float(own.count(".")), float(own.count("-")), float("(" in own), float("/" in own), float(own.count(" ")),
        float(own[:1] == "("), float(digits[:1] == "0"), float(digits[:2] == "00"), float(digits[:1] == "1"), float(digits[:3] in ("978", "979", "000", "666")), float(digits[:1] == "9"),
        float(luhn(digits)) if 12 <= len(digits) <= 19 else -1.0, float(_iban_ok(own)) if kind == "iban" else -1.0, float(date), float(own.count(":")), float("::" in own),
        float(max(number, default=0) <= 255), float(sum(c.isalpha() for c in own)), float(sum(c.isupper() for c in own)), float(len(set(own.lower()))) if kind == "secret" else -1.0,
        float(all(c in "0123456789abcdef" for c in own.lower()) if kind == "secret" else -1.0),
    ]
    edge = [
        float(left in "\"'`" and left != ""), float(left in "=:" and left != ""), float(before.rstrip()[-1:] in tuple("=:")), float(bool(re.search(r"[=:]\s?[\"'`]?$", before))), float(left in "$€£#" and left != ""),
        float(bool(re.search(r"[0-9][ ._/()-]{0,3}$", before))), float(bool(re.match(r"[ ._/()-]{0,3}[0-9]", after))), float(left == "+"), float(right in "%°€$" and right != ""),
        float(right in "\"'`" and right != ""), float(left.isalnum()), float(right.isalnum()), float(a == 0 or left == "\n"), float(bool(re.search(r"[(\[{]", own))), float(" at " in own or " dot " in own),
    ]
    words = [0.0] * (LAST + EARLIER + NEXT + OWN)
    for k, w in enumerate(_WORD.findall(before)[:-4:-1]):
        words[LAST + _bucket(w, EARLIER) if k else _bucket(w, LAST)] = 1.0
    next_word = _WORD.match(after.lstrip())
    if next_word:
        words[LAST + EARLIER + _bucket(next_word[0], NEXT)] = 1.0
    if kind == "email":
        words[LAST + EARLIER + NEXT + _bucket(own[-8:].split(".")[-1].split()[-1], OWN)] = 1.0
    return [*(float(kind == k) for k in KINDS), *shape, *edge, *words]


@dataclass
class Tree:
    """A regression tree in arrays: feature (-1: leaf), cut, left and right child, value."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return self.value[at]
            low = x[rows, np.maximum(f, 0)] <= self.cut[at]
            at = np.where(inner, np.where(low, self.left[at], self.right[at]), at)


@dataclass
class Boosted:
    """Boosted trees with a threshold for each kind."""

    start: float
    rate: float
    trees: list[Tree]
    thresholds: dict[str, float] = field(default_factory=dict)
    #: Recall and precision of each kind on held-out contexts.
    report: dict[str, tuple[float, float, int]] = field(default_factory=dict)

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.start + self.rate * sum((t(x) for t in self.trees), np.zeros(len(x)))


class Binned:
    """Feature values in bins, for sums by node: flags (of values 0 and 1) by the rows where they are set, others by their bins."""

    def __init__(self, x: np.ndarray, bins: int):
        self.flags = np.nonzero(((x == 0) | (x == 1)).all(0))[0]
        self.others = np.setdiff1d(np.arange(x.shape[1]), self.flags)
        self.flag = x[:, self.flags] > 0
        self.row, self.column = np.nonzero(self.flag)
        self.cuts = []
        for f in self.others:
            values = np.unique(x[:, f])
            middles = (values[1:] + values[:-1]) / 2
            self.cuts.append(middles if len(middles) < bins else np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])))
        self.bin = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in zip(self.others, self.cuts)], 1)
        self.width = max(map(len, self.cuts), default=0) + 1

    def below(self, node: np.ndarray, nodes: int, rows: np.ndarray, *values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each of the values their sums over a node's rows at or below each cut: of flags (node x flag), of others (node x feature x cut).

        node is the node of each row, -1 for none; rows are those that have one.
        """
        some = node[self.row] >= 0
        row, at = self.row[some], (node[self.row] * len(self.flags) + self.column)[some]
        n, w = len(self.others), self.width
        wide = ((node[rows, None] * n + np.arange(n)) * w + self.bin[rows]).ravel()
        for v in values:
            total = np.bincount(node[rows], v[rows], nodes)
            low = total[:, None] - np.bincount(at, v[row], nodes * len(self.flags)).reshape(nodes, -1)
            yield low, np.bincount(wide, np.repeat(v[rows], n), nodes * n * w).reshape(nodes, n, w).cumsum(2)[:, :, :-1]

    def parted(self, rows: np.ndarray, column: int, cut: int) -> tuple[int, float, np.ndarray]:
        """(feature, threshold, which rows are at or below it) of a flag (cut -1) or another feature's cut."""
        if cut < 0:
            return int(self.flags[column]), 0.5, ~self.flag[rows, column]
        return int(self.others[column]), float(self.cuts[column][cut]), self.bin[rows, column] <= cut


def _grown(x: Binned, some: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: float = 0.5) -> Tree:
    """A tree on some rows by gradients and curvatures, a level at a time; a leaf has `least` of curvature."""
    value = lambda rows: float(-g[rows].sum() / (h[rows].sum() + 1.0))
    nodes = [[-1, 0.0, -1, -1, value(some)]]
    todo = [(0, some)]
    for _ in range(depth):
        todo = [(n, rows) for n, rows in todo if h[rows].sum() >= 2 * least]
        if not todo:
            break
        node = np.full(len(g), -1)
        for k, (_, rows) in enumerate(todo):
            node[rows] = k
        (flag_g, other_g), (flag_h, other_h) = x.below(node, len(todo), np.concatenate([rows for _, rows in todo]), g, h)
        fresh = []
        for k, (n, rows) in enumerate(todo):
            tg, th = g[rows].sum(), h[rows].sum()
            best = (1e-6, 0, 0)
            for cg, ch in ((flag_g[k], flag_h[k]), (other_g[k], other_h[k])):
                gain = cg**2 / (ch + 1.0) + (tg - cg) ** 2 / (th - ch + 1.0) - tg**2 / (th + 1.0)
                gain = np.where((ch < least) | (th - ch < least), 0.0, gain)
                if gain.size and gain.max() > best[0]:
                    at = np.unravel_index(int(np.argmax(gain)), gain.shape)
                    best = float(gain.max()), int(at[0]), int(at[1]) if len(at) > 1 else -1
            if best[0] <= 1e-6:
                continue
            nodes[n][0], nodes[n][1], low = x.parted(rows, *best[1:])
            for side, part in ((2, rows[low]), (3, rows[~low])):
                nodes[n][side] = len(nodes)
                fresh.append((len(nodes), part))
                nodes.append([-1, 0.0, -1, -1, value(part)])
        todo = fresh
    columns = list(zip(*nodes))
    return Tree(np.array(columns[0], np.int64), np.array(columns[1]), np.array(columns[2], np.int64), np.array(columns[3], np.int64), np.array(columns[4]))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 100, depth: int = 6, rate: float = 0.25, bins: int = 32, seed: int = 1) -> Boosted:
    """Trees fitted one after the other to what the former leave, each on a random half of the rows."""
    share = float(np.clip(y.mean() if len(y) else 0.0, 0.01, 0.99))
    model = Boosted(float(np.log(share / (1 - share))), rate, [])
    if not len(y):
        return model
    binned, margin, rng = Binned(x, bins), np.full(len(y), model.start), np.random.default_rng(seed)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        some = np.sort(rng.permutation(len(y))[: -(-len(y) // 2)])
        tree = _grown(binned, some, p - y, p * (1 - p), depth)
        model.trees.append(tree)
        margin += rate * tree(x)
    return model


class Planter:
    """Personal data and look-alikes, each as (kind, text, lead before it, rest after it)."""

    # Words that may stand before any number, true or not.
    ANY = ["", "", "", "", "and ", "is ", "at ", "on ", "or ", "with ", "the ", "to ", "from ", ": ", "- ", "("]
    TRUE = {
        "phone": ["call me at ", "reach Ann on ", "tel. ", "Tel: ", "phone: ", "phone ", "mobile ", "my cell is ", "fax: ", "text me at ", "ring ", "Telefon ", "téléphone ", "teléfono ", "call "],
        "email": ["write to ", "mail ", "e-mail: ", "contact: ", "reach me: ", "correo ", "courriel "], "ip": ["host ", "login from ", "client ", "address ", "server at "],
        "card": ["card ", "visa ", "credit card: ", "pay with ", "mastercard no. ", "Karte ", "carte ", "tarjeta "], "ipv6": ["host ", "client ", "login from ", "address "],
        "iban": ["iban ", "IBAN: ", "account ", "bank: ", "Konto "], "ssn": ["ssn ", "SSN is ", "social security number ", "SSN: ", "tax id "],
        "secret": ['token = "', "api_key: ", 'password="', "secret=", "Bearer ", 'key: "', "TOKEN = '", 'auth_token = "'],
    }
    FALSE = [
        "version ", "order ", "order no. ", "invoice ", "isbn ", "ISBN: ", "page ", "pages ", "total ", "ref ", "serial ", "date: ", "since ", "until ", "time ", "build ", "ticket ", "score ", "part no. ",
        "section ", "sum ", "batch ", "item ", "figure ", "table ", "price ", "chapter ", "published ", "commit ", "sha ", "checksum ", "file ", "id ", "revision ", "/", "www.",
    ]

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def d(self, k: int) -> str:
        return "".join(self.rng.choice("0123456789") for _ in range(k))

    def word(self) -> str:
        return "".join(self.rng.choice("abcdefghilmnoprstuvw") for _ in range(self.rng.randint(2, 9)))

    def letters(self, alphabet: str, k: int) -> str:
        return "".join(self.rng.choice(alphabet) for _ in range(k))

    def card(self, good: bool = True) -> str:
        body = self.rng.choice("3456") + self.d(14)
        return next(body + c for c in "0123456789" if luhn(body + c) == good)

    def iban(self, good: bool = True) -> str:
        body, land = self.d(18), self.rng.choice(["DE", "FR", "ES", "NL", "IT", "BE"])
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        check = check if good else (check + self.rng.randint(1, 90)) % 97
        s = f"{land}{check:02d}{body}"
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if self.rng.random() < 0.5 else s

    def ssn(self) -> str:
        return f"{self.rng.choice([self.rng.randint(1, 665), self.rng.randint(667, 899)]):03d}-{self.rng.randint(1, 99):02d}-{self.rng.randint(1, 9999):04d}"

    def phone(self) -> str:
        d, n = self.d, self.rng.choice("23456789")
        return self.rng.choice([
            f"({n}{d(2)}) {d(3)}-{d(4)}", f"{n}{d(2)}-{d(3)}-{d(4)}", f"{n}{d(2)}.{d(3)}.{d(4)}", f"{n}{d(2)} {d(3)} {d(4)}", f"1-{n}{d(2)}-{d(3)}-{d(4)}", f"0{n}{d(2)} {d(3)} {d(4)}",
            f"0{n}{d(1)} {d(7)}", f"0{n}{d(2)} {d(6)}", f"0{n}{d(2)} {d(7)}", f"0{n}{d(2)}/{d(7)}", f"0{n}{d(2)}-{d(6)}", f"0{n}{d(8)}", f"0{n}{d(9)}", f"00{n}{d(1)} {d(3)} {d(7)}", f"00{n}{d(10)}",
            f"0{n} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{n}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"(0{n}{d(2)}) {d(6)}", f"0{n}{d(1)} {d(4)} {d(4)}",
        ])

    def octets(self, join: str, top: int = 255) -> str:
        return join.join(str(self.rng.choice([self.rng.randint(0, top), self.rng.randint(0, 12)])) for _ in range(4))

    def hextets(self) -> list[str]:
        return [self.letters("0123456789abcdef", self.rng.randint(1, 4)) for _ in range(8)]

    def secret(self) -> str:
        hexes, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
        s = self.rng.choice([
            self.letters(hexes, self.rng.choice([32, 40, 40, 48, 64])), self.letters(hexes.upper(), 40), "AKIA" + self.letters(mixed[:26] + "0123456789", 16), "ghp_" + self.letters(mixed, 36),
            "sk-" + self.letters(mixed, 32), self.letters(mixed + "_-+", self.rng.randint(24, 44)),
        ])
        return s if re.search("[0-9]", s) and re.search("[A-Za-z]", s) else s + "a1"

    def true(self) -> tuple[str, str, str, str]:
        r, d, w = self.rng, self.d, self.word
        kind = r.choice(KINDS)
        after = r.choice(["", ".", ",", " " + w(), " or " + w(), ")", "\n", "; " + w()])
        lead = r.choice(self.TRUE[kind] if r.random() < 0.6 else self.ANY)
        if kind == "phone":
            text = self.phone()
        elif kind == "email":
            name, site, top = r.choice([f"{w()}.{w()}", w(), f"{w()}{d(2)}", f"{w()}_{w()}"]), r.choice([w(), f"{w()}{d(1)}"]), r.choice(["com", "org", "net", "de", "example.com", "co.uk"])
            a, b = r.choice([(" (at) ", "."), ("(at)", "."), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" at ", " dot "), (" (at) ", " (dot) "), (" @ ", " . "), (" {at} ", ".")])
            if "dot" in b:  # the name is written out as well
                name = name.replace(".", b)
            text = name + a + site + b + top.replace(".", b)
        elif kind == "ip":
            text = r.choice([self.octets("[.]"), self.octets(" . "), self.octets(" dot "), ".".join(self.octets(".").split(".")[:3]) + "[.]" + str(r.randint(0, 255)), self.octets("(dot)")])
        elif kind == "card":
            c = self.card()
            text = r.choice(["{}.{}.{}.{}", "{}/{}/{}/{}", "{}  {}  {}  {}", "{}_{}_{}_{}", "{}{}{}{}", "{} {} {} {}"]).format(*(c[i : i + 4] for i in (0, 4, 8, 12)))
            if text.count(" ") == 3 or text.isdigit():
                after = " " + d(3) + after if r.random() < 0.5 else " " + self.card() + after  # the base kind takes all as one
        elif kind == "ipv6":
            h = self.hextets()
            text = r.choice([":".join(h), f"{h[0]}:{h[1]}::{h[2]}", f"fe80::{h[0]}:{h[1]}:{h[2]}", f"2001:db8::{h[0]}:{h[1]}"])
        elif kind == "iban":
            text = self.iban()
        elif kind == "ssn":
            text = self.ssn()
        else:
            text = self.secret()
            lead = r.choice(self.TRUE[kind]) if r.random() < 0.85 else lead
            after = lead[-1:] + after if lead[-1:] in "\"'" else after
        return kind, text, lead, after

    def false(self) -> tuple[str, str, str, str]:
        r, d, w = self.rng, self.d, self.word
        year, month, day = str(r.randint(1900, 2030)), f"{r.randint(1, 12):02d}", f"{r.randint(1, 28):02d}"
        hexes = "0123456789abcdef"
        text = r.choice([
            f"{year}-{month}-{day}", f"{day}/{month}/{year}", f"{day}.{month}.{year}", f"{year}-{month}-{day} {d(2)}:{d(2)}", f"{year}{month}{day}", f"{year}-{r.randint(1900, 2030)}", f"{day}-{month}-{year}",
            f"{r.randint(1, 9)}{d(1)} {d(3)} {d(3)}", f"{r.randint(1, 9)}.{d(3)}.{d(3)}", f"{r.randint(1, 9)}{d(2)}.{d(3)}.{d(3)},{d(2)}", f"0.{d(r.randint(6, 12))}", f"{d(2)}.{d(4)}, {d(2)}.{d(4)}", f"{d(2)}.{d(5)} {d(2)}.{d(5)}",
            f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"978{d(10)}", f"{r.choice('123456789')}{d(r.randint(6, 9))}", f"{r.choice('123456789')}{d(r.randint(10, 18))}", self.card(False), f"{d(4)} {d(4)} {d(4)}", f"{d(4)}-{d(4)}-{d(4)}-{d(4)}",
            f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}", f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}.{d(4)}", f"{d(2)}:{d(2)}:{d(2)}", f"{d(1)}:{d(2)}:{d(2)}:{d(2)}", f"{d(2)}-{d(2)}-{d(2)}-{d(2)}",
            " ".join(d(r.randint(1, 4)) for _ in range(r.randint(4, 9))), " ".join(str(r.randint(1, 60)) for _ in range(r.randint(4, 9))), f"{r.choice(['000', '666', '9' + d(2)])}-{d(2)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}-{d(1)}",
            f"{d(3)}-{d(3)}-{d(4)}-{d(4)}", self.iban(False), f"{w()} (at) {w()} . {w()}", f"{w()} at {w()}. {w()}", f"{w()} [at] {d(2)}.{d(2)}", " . ".join(str(r.randint(256, 999)) for _ in range(4)),
            "-".join(self.letters(hexes, k) for k in (8, 4, 4, 4, 12)), f"{w()}-{w()}-{w()}-{w()}-{d(2)}", f"{w()}_{w()}_{w()}{d(4)}", w() + w() + w() + d(1), f"{d(4)}-{d(4)}", f"{d(3)}-{d(3)}", f"{d(5)}-{d(4)}",
            f"{d(2)}/{d(2)}/{d(2)}/{d(2)}/{d(2)}", f"{r.randint(1, 400)}-{r.randint(400, 900)}, {r.randint(1, 400)}-{r.randint(400, 900)}",
        ])
        hard = r.random()  # forms of true ones whose context speaks against them
        if hard < 0.08:
            text = r.choice([self.phone(), self.phone(), self.ssn(), self.letters(hexes, 40), self.letters(hexes, 64)])
            return "", text, r.choice(self.FALSE[:-2]), r.choice(["", ".", " " + w()])
        lead = r.choice(self.FALSE if r.random() < 0.4 else self.ANY)
        return "", text, lead, r.choice(["", ".", ",", " " + w(), " kg", "%", " EUR", " pages", ")", "\n"])


def planted(contexts: list[str], n: int, seed: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(features, labels, kinds) of the candidates that meet one of n spans planted into contexts, half of them true.

    A candidate is true if it is the planted span, with or without brackets at its ends;
    one of its kind that is cut otherwise is false: so the trees learn where a span ends.
    """
    planter, rng = Planter(seed), random.Random(seed + 1)
    x, y, kinds = [], [], []
    for k in range(n):
        kind, own, lead, after = planter.true() if k % 2 else planter.false()
        around = rng.choice(contexts) if contexts else ""
        cut = rng.randrange(len(around) + 1)
        left, right = around[:cut], around[cut:]
        left = left if not left or left[-1].isspace() else left + " "
        right = right if not right or not right[0].isalnum() else " " + right
        text = left + lead + own + after + right
        start = len(left) + len(lead)
        for span in candidates(text):
            if span[1] < start + len(own) and start < span[2]:
                true = kind == span[0] and text[span[1] : span[2]].strip("()") == own.strip("()")
                x.append(span_features(text, span))
                y.append(float(true))
                kinds.append(span[0])
    return np.array(x), np.array(y), kinds


#: Rows of the sample whose texts are contexts, characters of each, and spans planted for fitting and for the thresholds.
CONTEXTS, CONTEXT_CHARS, PLANTED = 4_000, 160, 12_000


def fit(contexts: list[str], seed: int = 42, n: int = PLANTED, precision: float = 0.97) -> Boosted:
    """The model: trees fitted on spans planted into two thirds of the contexts; thresholds, recall and precision on the others.

    A kind's threshold is the least at which that share of its selected held-out candidates is true.
    """
    contexts = sorted(contexts)
    held = contexts[::3]
    x, y, _ = planted([c for i, c in enumerate(contexts) if i % 3], n, seed)
    model = boost(x, y)
    hx, hy, kinds = planted(held, n // 2, seed + 7)
    margins, kinds = model.margins(hx), np.array(kinds)
    for kind in KINDS:
        own = kinds == kind
        m, good = margins[own], hy[own]
        order = np.argsort(-m, kind="stable")
        m, right = m[order], np.cumsum(good[order])
        ends = np.nonzero(np.append(m[1:] < m[:-1], True))[0] if len(m) else np.zeros(0, np.int64)
        ends = ends[right[ends] >= precision * (ends + 1)]
        cut = max(float(m[ends[-1]]), 0.0) if len(ends) else float("inf")
        chosen = margins[own] >= cut
        model.thresholds[kind] = cut
        model.report[kind] = (float(good[chosen].sum() / max(1.0, good.sum())), float(good[chosen].mean()) if chosen.any() else 1.0, int(good.sum()))
    return model


@functools.lru_cache(maxsize=4)
def _fitted(contexts: tuple[str, ...]) -> Boosted:
    return fit(list(contexts))


def trained(docs: DataFrame | None = None) -> Boosted:
    """The model for docs: contexts are cut from the texts of the CONTEXTS rows first by a hash of their id; none without docs."""
    if docs is None:
        return _fitted(())
    start = (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.greatest(F.length("text") - CONTEXT_CHARS, F.lit(0)) + 1) + 1).cast("int")
    some = docs.where("text is not null").select("doc_id", F.col("text").substr(start, F.lit(CONTEXT_CHARS)).alias("context"))
    return _fitted(tuple(sorted(r["context"] for r in hashed_sample(some, ["doc_id", "context"], CONTEXTS).collect())))


def find_spans(text: str | None, model: Boosted) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text, each by start, then kind as listed."""
    return find_all([text], model)[0]


def find_all(texts: list[str | None], model: Boosted) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text. Base spans stay whatever the trees say.

    All candidates are scored, those that meet a base span too; of the selected
    ones the likeliest goes first and takes its place among the added ones. One within a base span
    adds nothing and is left out.
    """
    out, rows, spots = [], [], []
    for i, text in enumerate(texts):
        text = text or ""
        if not _ANY.search(text):
            out.append(([], []))
            continue
        out.append((base_spans(text), []))
        for span in candidates(text):
            rows.append(span_features(text, span))
            spots.append((i, span))
            if len(rows) >= 4_096:  # bounded memory for texts full of numbers
                _select(rows, spots, model, out)
    _select(rows, spots, model, out)
    key = lambda s: (s[1], _ORDER[s[0]], s[2])
    for i, (base, scored) in enumerate(out):
        added: list[Span] = []
        if scored:
            within = sorted((a, b) for _, a, b in base)
            starts = [a for a, _ in within]
            reach = list(itertools.accumulate((b for _, b in within), max))
            taken: list[tuple[int, int]] = []
            for _, a, _, span in sorted(scored):
                b = span[2]
                k = bisect_right(starts, a)
                if k and reach[k - 1] >= b:
                    continue
                k = bisect_right(taken, (a, b))
                if (k and taken[k - 1][1] > a) or (k < len(taken) and taken[k][0] < b):
                    continue
                taken.insert(k, (a, b))
                added.append(span)
        out[i] = sorted(base, key=key), sorted(base + added, key=key)
    return out


def _select(rows: list, spots: list, model: Boosted, out: list) -> None:
    """Adds (rank, start, kind, span) of the candidates above their kind's threshold to their texts; empties rows and spots."""
    if rows:
        for m, (i, span) in zip(model.margins(np.array(rows)).tolist(), spots):
            if m >= model.thresholds.get(span[0], float("inf")):
                out[i][1].append((-m, span[1], _ORDER[span[0]], span))
    rows.clear()
    spots.clear()


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """text with each span, or union of overlapping ones, replaced by its first kind in brackets."""
    if not text or not spans:
        return text
    out, at, k = [], 0, 0
    while k < len(spans):
        kind, a, b = spans[k]
        k += 1
        while k < len(spans) and spans[k][1] < b:
            b = max(b, spans[k][2])
            k += 1
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def find_documents(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all of them).

    Null texts are as empty ones: no spans, the digest of nothing. Whole texts of
    any length in linear time; repeated rows are answered each, ids and other columns
    don't matter. An empty table gives an empty result. Without a model one is fitted on these docs (trained).
    """
    model = model or trained(docs)

    def make():
        def run(texts: list) -> tuple:
            rows = []
            for base, every in find_all(texts, model):
                names = [s[0] for s in base]
                rows.append((*map(names.count, BASE_KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every)))
            return tuple(zip(*rows)) or ((),) * 6

        return run

    added = {f"n_{k}": ("long", pa.int64()) for k in BASE_KINDS} | {"base_sha256": ("string", pa.string()), "spans": ("string", pa.string())}
    return mapped(docs, ["doc_id"], ["text"], make, added)


def redact(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """docs with personal data in text replaced, and n_chars, if there is one, set to the new length; other columns as they were.

    Null and empty texts stay as they are; long texts are read whole; repeated rows are
    redacted alike; columns of any name are kept. An empty table gives an empty result.
    """
    model = model or trained(docs)
    docs, back = shielded(docs, ["text", "n_chars"])
    columns = docs.columns

    def make():
        def run(texts: list) -> tuple:
            out = [redacted(t, every) for t, (_, every) in zip(texts, find_all(texts, model))]
            return out, [None if t is None else len(t) for t in out]

        return run

    out = mapped(docs, columns, ["text"], make, {"text": ("string", pa.string()), "__length": ("long", pa.int64())})
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.coalesce("__length", "n_chars").cast(docs.schema["n_chars"].dataType))
    return out.select(*back(out))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find_documents() of the whole table `documents`, by a model fitted on its contexts; awkward rows as there."""
    return find_documents(table(spark, sf_dir, "documents"))
