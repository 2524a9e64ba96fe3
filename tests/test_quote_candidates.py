"""quote_pairs finds quotations of any length, with and without ellipses, and moves only what matches."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import quotes as S

DOCS = [
    (1, "The river rose over the old stone bridge, and then the town was gone by morning."),
    (2, "Of floods: the river rose over the old stone bridges that a king had built for his horses and men."),
    (3, "flood"),
    (4, None),
    (5, "A king  had built \u201cfor his horses\u201d and men."),
]
PLAIN = {
    1: ("river rose", 2),  # two words
    2: ("lood", 2),  # part of a word
    3: ("river rose over the old stone bridge", 2),  # seven words, punctuation or letters follow
    4: ("iver rose over the old stone bridge, and th", 1),  # words cut at both ends
    5: ('built "for his horses" and men.', 1),
    6: ("nowhere to be found", 0),
    7: ("no document has these eight or more words anywhere at all", 0),
    8: ("", 4),
    9: (None, 0),
}
ELIDED = {
    10: ("the river rose ... a king had built for his horses and men", 1),  # an ellipsis among the first words
    11: ("The river rose [...] gone by morning", 1),  # short fragments only
    12: ("gone by morning ... The river rose over the old stone bridge, and then", 1),  # in any order, as in the reference
    13: ("the river rose over the old ... a king had built for his elephants", 0),
}


def found(spark, quotes, **given):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    rows = spark.createDataFrame([(k, text) for k, (text, _) in quotes.items()], "item_id long, quote string")
    n = {r["item_id"]: r["count"] for r in S.quote_pairs(rows, docs, "item_id", "doc_id", **given).groupBy("item_id").count().collect()}
    return {k: n.get(k, 0) for k in quotes}


def test_short_and_cut_quotations(spark):
    assert found(spark, PLAIN) == {k: n for k, (_, n) in PLAIN.items()}


def test_elided_quotations(spark):
    assert found(spark, ELIDED) == {k: n for k, (_, n) in ELIDED.items()}


def test_several_automata(spark):
    """Needles of more characters than one automaton may have are dealt to several; a part that is too large all the same is an error."""
    both = PLAIN | ELIDED
    assert found(spark, both, chars=60) == {k: n for k, (_, n) in both.items()}
    with pytest.raises(ValueError, match="set a larger limit"):
        found(spark, {k: (f"{'x' * 40} {k}", 0) for k in range(3)}, chars=2)


def test_nothing_to_look_for(spark):
    assert found(spark, {1: (None, 0)}) == {1: 0}
    none = spark.createDataFrame([], "doc_id long, text string")
    quotes = spark.createDataFrame([(1, "a b"), (2, "one two three four five six seven eight nine")], "item_id long, quote string")
    assert S.quote_pairs(quotes, none, "item_id", "doc_id").count() == 0


def corpus(n, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    common = " ".join(rng.choice(vocabulary) for _ in range(12))
    texts = [" ".join(rng.choice(vocabulary) for _ in range(60)) + (f" {common}" if i % 2 else "") for i in range(n)]
    quotes = [(i, " ".join(texts[7 * i].split()[3:20])) for i in range(20)] + [(100, common), (101, f"{common} {texts[1].split()[0]}"), (102, "never " * 9), (103, "w1 w2"), (104, f"{texts[4][:40]} ... {texts[4][-40:]}")]
    return [(i, t) for i, t in enumerate(texts)], quotes


def test_against_brute_force_without_a_cross_join(spark, monkeypatch):
    texts, quotes = corpus(400)
    docs, q = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(quotes, "item_id long, quote string")
    moved, keep = [], S._kept_runs

    def count(*given):
        out = keep(*given)
        moved.append(out.agg(F.count("*"), F.sum(F.size("hits"))).first())
        return out

    monkeypatch.setattr(S, "_kept_runs", count)
    pairs = S.quote_pairs(q, docs, "item_id", "doc_id")

    def holds(quote, text):
        parts = [p.strip() for p in quote.split("...") if len(p.strip()) >= 12]
        return quote in text if len(parts) <= 1 else all(p in text for p in parts)

    want = {(k, i) for k, quote in quotes for i, t in texts if holds(quote.strip(), t)}
    assert {tuple(r) for r in pairs.collect()} == want
    assert {i for k, i in want if k == 100} >= set(range(1, 400, 2))
    plan = pairs._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    # runs that leave a task: those of quotations first, the rarest of each then; all texts have 24,000
    assert moved[0][1] < 3_000 and moved[1][1] < 600 and moved[1][0] < 230, moved


def test_a_bitmap_that_is_too_small_only_moves_more(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_BITS", 64)
    monkeypatch.setattr(S, "EXACT", 0)
    texts, quotes = corpus(140)
    docs, q = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(quotes[:5] + quotes[20:], "item_id long, quote string")
    got = {tuple(r) for r in S.quote_pairs(q, docs, "item_id", "doc_id").collect()}
    assert {(0, 0), (1, 7), (104, 4)} <= got and {i for k, i in got if k == 100} == set(range(1, 140, 2))
