"""Personal data: what the trees add, on held-out contexts and in sentences, against a plain selection."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import pii_boost as P

from .conftest import prose, rows


@pytest.fixture(scope="module")
def model():
    rng = random.Random(9)
    return P.fit([prose(rng, 25) for _ in range(600)])


def added(text, model):
    base, every = P.find_spans(text, model)
    return [(k, text[a:b]) for k, a, b in every if (k, a, b) not in base]


@pytest.mark.parametrize("kind", P.KINDS)
def test_held_out(model, kind):
    recall, precision, n = model.report[kind]
    assert n > 100 and recall > 0.85 and precision >= 0.97


@pytest.mark.parametrize(
    "text, want",
    [
        ("Call me at 212-555-1234", [("phone", "212-555-1234")]),
        ("SSN is 123-45-6789", [("ssn", "123-45-6789")]),
        ("reach Ann on 0171 555 1234", [("phone", "0171 555 1234")]),
        ("and 030 1234567", [("phone", "030 1234567")]),
        ("call (212) 555-1234 now", [("phone", "(212) 555-1234")]),
        ("mail john.doe (at) mail.com", [("email", "john.doe (at) mail.com")]),
        ("from 10.0.0[.]5 it", [("ip", "10.0.0[.]5")]),
        ("card 4111 1111 1111 1111 123", [("card", "4111 1111 1111 1111")]),  # no base card: taken as one number it fails
        ('token = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b"', [("secret", "9233a8ecf7c5b09fe5949719b6b82bc439e9329b")]),
        ("iban DE89 3704 0044 0532 0130 00 it", [("iban", "DE89 3704 0044 0532 0130 00")]),
        ("version 1.2.3 of 2020-01-02, page 12, Apache License, Version 2.0.", []),
        ("ISBN 978-3-16-148410-0 in 1999-2004", []),
        ("order 212-555-1234", []),
        ("total 1 234 567", []),
        ("commit 9233a8ecf7c5b09fe5949719b6b82bc439e9329b", []),
    ],
)
def test_sentences(model, text, want):
    assert added(text, model) == want


def test_long_spans_are_whole(model):
    name = "very." * 40 + "long"
    text = f"write to {name} (at) {'host' * 20}.example.sub.of.a.long.name.com now"
    assert added(text, model) == [("email", text[9:-4])]
    key = "a1" * 200
    assert ("secret", 10, 10 + len(key)) in P.candidates('password="' + key + '"')


def plain(text, model):
    """Selection by its definition: all candidates, likeliest first, none within a base span or over an added one."""
    base = P.base_spans(text)
    scored = [(-model.margins(np.array([P.span_features(text, s)]))[0], s[1], P.KINDS.index(s[0]), s) for s in P.candidates(text)]
    out = []
    for m, *_, (kind, a, b) in sorted(scored):
        if -m >= model.thresholds[kind] and not any(x <= a and b <= y for _, x, y in base) and all(b <= x or y <= a for _, x, y in out):
            out.append((kind, a, b))
    key = lambda s: (s[1], P.KINDS.index(s[0]), s[2])
    return sorted(base, key=key), sorted(base + out, key=key)


PARTS = ["call ", "0171 555 1234", "+1 (988) 555-2485", "4111 1111 1111 1111", " 123", "a.b (at) c.com", "x@y.org", "10.0.0.1", "10.0.0[.]7", "123-45-6789", ", ", " and ", "2020-01-02", '"', "9233a8ecf7c5b09fe594"]


@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=8).map("".join), max_size=4))
@settings(max_examples=60, deadline=None)
def test_against_plain_selection(model, texts):
    assert P.find_all(texts, model) == [plain(t, model) for t in texts]


def test_query_against_plain_selection(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = P.trained(docs)
    got = sorted((str(r.doc_id), r.spans) for r in P.op6(spark, small).collect())
    assert got == sorted((str(r[0]), P.listed(plain(r[1] or "", model)[1])) for r in rows())


def test_many_candidates_in_one_text(model):
    # more than are scored at once, in linear time
    text = "0171 555 1234, " * 3000 + "7 " * 20_000
    base, every = P.find_spans(text, model)
    assert not base and sum(k == "phone" for k, *_ in every) == 3000


def test_redact(spark, model):
    long = "word " * 200_000 + "reach Ann on 0171 555 1234"
    data = [(2**60 + 1, "to a@b.co and +1 (988) 555-2485.", 5), (None, None, None), (3, "", 0), (4, long, None), (5, "SSN is 123-45-6789", 1), (5, "SSN is 123-45-6789", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, n_chars int")
    out = P.redact(df, model)
    got = sorted(map(tuple, out.collect()), key=str)
    want = [(2**60 + 1, "to [EMAIL] and [PHONE].", 23), (None, None, None), (3, "", 0), (4, "word " * 200_000 + "reach Ann on [PHONE]", None), *[(5, "SSN is [SSN]", 12)] * 2]
    want[3] = (4, want[3][1], len(want[3][1]))
    assert got == sorted(want, key=str) and out.columns == df.columns


def test_no_contexts():
    assert P.fit([], n=600).report["ipv6"][0] > 0.5


def test_written_out_names(model):
    for text, want in (("mail jane dot doe at example dot com now", "jane dot doe at example dot com"), ("contact: j [dot] van [dot] dyk [at] host [dot] org.", "j [dot] van [dot] dyk [at] host [dot] org")):
        a = text.index(want)
        assert ("email", a, a + len(want)) in P.candidates(text)
        assert added(text, model) == [("email", want)], text
    assert P.candidates("He sat. Meet me at noon.") == []
    assert len(P.candidates("a dot " * 5_000 + "b at c dot de")) < 5
