"""Rank, select and cuts against plain Python; outputs and restored texts against the definition."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import fim_cuts as C

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXT = st.text(st.sampled_from(" \t\n\x0b\x1c\x85 ab<>PSMé日😀"), max_size=60)


def by_definition(key, text):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    tokens = TOKEN.findall(text)
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(tokens[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if text == "" or any(x in text for x in C.SENTINELS) or h3 % 100 >= 50:
        return key, n, "plain", None, None, text
    if h4 % 100 < 80:
        return key, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return key, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@given(st.lists(st.booleans(), max_size=2000))
@settings(max_examples=60, deadline=None)
def test_rank_and_select(bits):
    v = C.BitVector(np.packbits(np.array(bits, bool), bitorder="little"))
    ones = np.flatnonzero(bits)
    assert v.rank(np.arange(len(bits) + 1)).tolist() == [sum(bits[:i]) for i in range(len(bits) + 1)]
    assert v.select(np.arange(len(ones))).tolist() == ones.tolist()


@given(st.lists(TEXT, max_size=8), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
@settings(max_examples=200, deadline=None)
def test_cuts_of_a_batch(texts, h1, h2):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    each = np.full(len(texts), h1), np.full(len(texts), h2)
    for i, (n, first, second, before, between) in enumerate(zip(*C.cuts(data, offsets, *each))):
        tokens = TOKEN.findall(texts[i])
        a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
        prefix, middle = "".join(tokens[:a]), "".join(tokens[a:b])
        assert (n, before, between) == (len(tokens), len(prefix), len(middle))
        assert (first - offsets[i], second - offsets[i]) == (len(prefix.encode()), len((prefix + middle).encode()))


def test_pieces_and_slices(spark, monkeypatch):
    """Texts longer than a piece and a slice, in tasks' closures too."""
    monkeypatch.setattr(C, "PIECE", 64)
    data = np.frombuffer(("ab  é" * 100).encode(), np.uint8)
    whole = C.token_starts(data, np.array([0]))
    monkeypatch.setattr(C, "PIECE", 1 << 20)
    assert (whole.words == C.token_starts(data, np.array([0])).words).all()
    monkeypatch.setattr(C, "SLICE_BYTES", 40)
    import pyarrow as pa

    texts = ["word " * 30, "", "x", " y é ", "z " * 9] * 3
    made = [c for c in C._batch(pa.array(["skipped", *texts]).slice(1), ["spm"] * len(texts), np.arange(15) * 7, np.arange(15) * 11, (b"<P>", b"<S>", b"<M>"))]
    assert len(made) > 5 and [n for c in made for n in c[0].to_pylist()] == [len(TOKEN.findall(t)) for t in texts]


def test_awkward_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    more = [(i, t) for i, t in enumerate(["", None, " ", "a", " a", "a ", "x<S>y z", "<P", "P> <", "日本 語 \x85  b", "w " * 40_000, "\n\n"] * 12, 1000)] + [(None, "null key here"), (None, None), (1, "twice " * 5), (1, "twice " * 5)]
    rows = docs.select("doc_id", "text", "size", "digest").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    made = C.fill_in_middle(rows)
    got = made.withColumn("back", C.restored("output", "form")).collect()
    key = lambda r: tuple(map(repr, r))
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted((by_definition(*r[:2]) for r in rows.collect()), key=key)
    texts = sorted((r["text"] or "") for r in rows.collect())
    assert sorted(r["back"] for r in got) == texts and {r["form"] for r in got} == {"plain", "spm", "psm"}


def test_other_shares_and_sentinels(spark):
    rows = spark.createDataFrame([(i, f"some words of text {i} ") for i in range(60)], "`my key` long, `a.b` string")
    marks = ("<|pre|", "<|suf|", "<|mid|")
    made = C.fill_in_middle(rows, "a.b", "my key", seed=7, share=100, spm=0, sentinels=marks)
    got = made.withColumn("back", C.restored("output", "form", marks)).collect()
    assert {r["form"] for r in got} == {"psm"} and all(r["output"].startswith(marks[0]) and r["back"] == f"some words of text {r['my key']} " for r in got)
    for wrong in (("", "b", "c"), ("aba", "c", "d"), ("ab", "xaby", "d")):
        with pytest.raises(ValueError, match="no sentinel"):
            C.fill_in_middle(rows, "a.b", "my key", sentinels=wrong)


def test_empty_table(spark, empty):
    assert C.op13(spark, empty).collect() == []
