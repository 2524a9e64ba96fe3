"""Fill-in-the-middle transformation by succinct rank and select.

A batch of texts is one run of bytes. A packed bitvector marks the bytes at which a
token begins, a directory holds the number of set bits before each block, and so
rank (set bits before a byte) and select (byte of the k-th set bit) take a search in
the directory and a look at one block. The total popcount of a text's part is its
number of tokens n; select on two ranks gives the two cuts in bytes. A second
bitvector of the bytes that begin a character turns cuts into code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SENTINELS = ("<P>", "<S>", "<M>")
#: 64-bit words in a block of the directory; bytes whose masks are made at once (a multiple of 64); bytes of texts that share a bitvector, at least one text.
BLOCK, PIECE, SLICE_BYTES = 8, 1 << 20, 1 << 23

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class BitVector:
    """A packed bitvector with the popcount before each block of BLOCK words."""

    def __init__(self, packed: np.ndarray):
        words = np.zeros(-(-len(packed) // (8 * BLOCK)) * BLOCK, "<u8")
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        counts = np.bitwise_count(words).reshape(-1, BLOCK).sum(1, dtype=np.int64)
        self.before = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))

    def _block(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words of some blocks, and the set bits of a block before each of its words."""
        words = self.words.reshape(-1, BLOCK)[block]
        counts = np.bitwise_count(words).astype(np.int64)
        return words, np.cumsum(counts, 1) - counts

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place; a place may be the end."""
        at = np.asarray(at, np.int64)
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        block = np.minimum(word // BLOCK, max(len(self.before) - 2, 0))
        if len(self.before) == 1:
            return np.zeros(len(at), np.int64)
        words, before = self._block(block)
        own = word - block * BLOCK  # BLOCK at the end of the last block
        last, rows = np.minimum(own, BLOCK - 1), np.arange(len(at))
        part = np.where(own < BLOCK, np.bitwise_count(words[rows, last] & ((np.uint64(1) << bit) - np.uint64(1))), np.bitwise_count(words[rows, last]))
        return self.before[block] + before[rows, last] + part.astype(np.int64)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th set bit, counted from 0, for each k below the number of set bits."""
        k = np.asarray(k, np.int64)
        if not len(k):
            return k
        block = np.searchsorted(self.before, k, "right") - 1
        words, before = self._block(block)
        left = k - self.before[block]
        word = (before <= left[:, None]).sum(1) - 1
        rows = np.arange(len(k))
        left, bits = left - before[rows, word], words[rows, word]
        place = np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):  # halve the word towards the bit
            low = np.bitwise_count(bits & np.uint64((1 << width) - 1)).astype(np.int64)
            up = left >= low
            left, place = np.where(up, left - low, left), np.where(up, place + width, place)
            bits = np.where(up, bits >> np.uint64(width), bits)
        return (block * BLOCK + word) * 64 + place


def _packed(data: np.ndarray, marks) -> np.ndarray:
    """The packed bits of marks(piece, byte before it or None), made piece by piece."""
    out = np.zeros(-(-len(data) // 8), np.uint8)
    for at in range(0, len(data), PIECE):
        bits = np.packbits(marks(data[at : at + PIECE], data[at - 1] if at else None), bitorder="little")
        out[at >> 3 : (at >> 3) + len(bits)] = bits
    return out


def _ends_word(piece: np.ndarray, last) -> np.ndarray:
    """White space after a word: there a token begins."""
    space = _SPACE[piece]
    before = np.concatenate(([last is None or _SPACE[last]], space[:-1]))
    return space & ~before


def token_starts(data: np.ndarray, starts: np.ndarray) -> BitVector:
    """Marks where a token begins: a run of words' characters with the white space before it, or white space at a text's end.

    starts: the first byte of each text that is not empty.
    """
    bits = _packed(data, _ends_word)
    np.bitwise_or.at(bits, starts >> 3, np.left_shift(np.uint8(1), (starts & 7).astype(np.uint8)))
    return BitVector(bits)


def character_starts(data: np.ndarray) -> BitVector:
    return BitVector(_packed(data, lambda piece, _: (piece & 0xC0) != 0x80))


def cuts(data: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, ...]:
    """(n, first cut, second cut, characters before the first, between both) of the texts at offsets; cuts in bytes of data."""
    begin, end = offsets[:-1], offsets[1:]
    tokens, chars = token_starts(data, begin[end > begin]), character_starts(data)
    base = tokens.rank(begin)
    n = tokens.rank(end) - base
    a, b = h1 % (n + 1), h2 % (n + 1)

    def byte(unit: np.ndarray) -> np.ndarray:
        out, inner = end.copy(), unit < n
        out[inner] = tokens.select((base + unit)[inner])
        return out

    first, second = byte(np.minimum(a, b)), byte(np.maximum(a, b))
    at = chars.rank(first)
    return n, first, second, at - chars.rank(begin), chars.rank(second) - at


def _batch(texts: pa.Array, forms: list[str], h1: np.ndarray, h2: np.ndarray, marks: tuple[bytes, ...]) -> Iterator[list[pa.Array]]:
    """n, prefix_chars, middle_chars and output of some texts, slice by slice."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    p, s, m = marks
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1)
        own, data = offsets[i : j + 1] - offsets[i], whole[offsets[i] : offsets[j]]
        n, first, second, before, between = cuts(data, own, h1[i:j], h2[i:j])
        raw, out = memoryview(data), []
        for form, x, a, b, y in zip(forms[i:j], own[:-1].tolist(), first.tolist(), second.tolist(), own[1:].tolist()):
            if form == "plain":
                out.append(bytes(raw[x:y]))
            elif form == "psm":
                out.append(b"".join((p, raw[x:a], s, raw[b:y], m, raw[a:b])))
            else:
                out.append(b"".join((s, raw[b:y], p, raw[x:a], m, raw[a:b])))
        plain = np.array([f == "plain" for f in forms[i:j]], bool)
        yield [pa.array(n, pa.int64()), pa.array(before, pa.int64(), mask=plain), pa.array(between, pa.int64(), mask=plain), pa.array(out, pa.large_binary()).cast(pa.large_string()).cast(pa.string())]
        i = j


def _checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """A sentinel that overlaps with itself or lies in another could be found at a wrong place when a text is rebuilt."""
    for x in sentinels:
        if not x or any(x[:i] == x[-i:] for i in range(1, len(x))) or any(x in y for y in sentinels if y is not x):
            raise ValueError(f"{x!r} is no sentinel: it is empty, overlaps with itself or lies in another one")
    return sentinels


def _number(digest: Column, group: int) -> Column:
    return F.conv(F.substring(digest, 8 * group - 7, 8), 16, 10).cast("long")


def fill_in_middle(
    docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 42, share: int = 50, spm: int = 80, sentinels: tuple[str, str, str] = SENTINELS
) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output): one row for each row of docs; further columns, of any name, play no part.

    A text has n tokens: maximal runs of other characters with the ASCII white space before
    them, and white space at the end. Two cuts and the form are drawn from SHA-256 of
    "seed:key" (a null key as an empty string), so repeated rows come out alike. `share` of 100 texts are rearranged, `spm` of 100 of
    these with the suffix first, else with the prefix first; a text that is empty, or null (as empty), or holds a
    sentinel stays plain, and its chars are null. Texts are cut whole, however long.
    """
    p, s, m = _checked(sentinels)
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = docs.select(F.col(f"`{key}`").alias("key"), whole.alias("text"), digest.alias("digest"))
    holds = F.contains("text", F.lit(p)) | F.contains("text", F.lit(s)) | F.contains("text", F.lit(m))
    form = F.when((F.col("text") == "") | holds | (_number(F.col("digest"), 3) % 100 >= share), "plain").when(_number(F.col("digest"), 4) % 100 < spm, "spm").otherwise("psm")
    rows = rows.select("key", "text", form.alias("form"), _number(F.col("digest"), 1).alias("h1"), _number(F.col("digest"), 2).alias("h2"))
    marks = tuple(x.encode() for x in (p, s, m))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, forms, h1, h2 = batch.columns
            at = 0
            for made in _batch(texts, forms.to_pylist(), h1.to_numpy(), h2.to_numpy(), marks):
                n = len(made[0])
                columns = [keys.slice(at, n), made[0], forms.slice(at, n), *made[1:]]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "form", "prefix_chars", "middle_chars", "output"])
                at += n

    kind = docs.schema[key].dataType.simpleString()
    made = rows.mapInArrow(run, f"key {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return made.withColumnRenamed("key", key)


def restored(output: Column | str, form: Column | str, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that fill_in_middle() made an output from; null for a null output."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    p, s, m = _checked(sentinels)

    def parts(x: str, y: str, swap: bool) -> Column:
        body = F.substr(output, F.lit(len(x) + 1))
        first = F.substring_index(body, y, 1)
        rest = F.substr(body, F.length(first) + len(y) + 1)
        second = F.substring_index(rest, m, 1)
        middle = F.substr(rest, F.length(second) + len(m) + 1)
        return F.concat(second, middle, first) if swap else F.concat(first, middle, second)

    return F.when(form == "psm", parts(p, s, False)).when(form == "spm", parts(s, p, True)).otherwise(output)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fill_in_middle() of the whole table `documents`, outputs and the texts rebuilt from them as digests; awkward rows as there."""
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    back = digest(restored("output", "form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), back.alias("restored_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS ws,
             ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM d),
c AS (SELECT *, len(ws)::BIGINT AS n, least(h1 % (len(ws) + 1), h2 % (len(ws) + 1))::BIGINT AS a, greatest(h1 % (len(ws) + 1), h2 % (len(ws) + 1))::BIGINT AS b FROM w),
p AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                     WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
             coalesce(array_to_string(ws[1:a], ''), '') AS prefix, coalesce(array_to_string(ws[a + 1:b], ''), '') AS middle, coalesce(array_to_string(ws[b + 1:], ''), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN len(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN len(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(prefix || middle || suffix) AS restored_sha256
FROM p
"""
