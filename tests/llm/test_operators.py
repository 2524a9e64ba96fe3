"""The operators' own interfaces and the parts they are made of."""

from __future__ import annotations

import itertools
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import byte_bpe, components, cube_mix, feistel_shard, fm_quality, html_wrappers, pii_boost, quality_rules, simhash_dedup, token_cache


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 2000 + i) for i in range(300)] + [(rng.randrange(5000, 6000), rng.randrange(5000, 6000)) for _ in range(400)] + [(7, 7)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    import sys

    sys.setrecursionlimit(10_000)
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r.node: r.root for r in components.connected_components(df).collect()}
    assert got == {x: find(x) for x in root}
    assert components.connected_components(df.limit(0)).count() == 0


def test_keep_one(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    classes = simhash_dedup.simhash_classes(docs)
    n = classes.select("root").distinct().count()
    got = simhash_dedup.simhash_classes(kept)
    assert kept.count() == n and got.select("root").distinct().count() == n


@given(st.lists(st.tuples(st.integers(0, 500), st.floats(0.05, 0.95)), min_size=1, max_size=60))
@settings(max_examples=60, deadline=None)
def test_flight_keeps_totals(units):
    size, p = np.array([float(s) for s, _ in units]), np.array([x for _, x in units])
    out = cube_mix.fly(p, size, np.random.default_rng(0).random(len(p)))
    assert out.min() >= 0 and out.max() <= 1
    assert abs(out.sum() - p.sum()) < 1e-3 and abs(out @ size - p @ size) < 1
    assert ((out > 1e-6) & (out < 1 - 1e-6)).sum() <= cube_mix.RESERVE + 2


def test_mix_of_many_chunks(spark):
    df = spark.range(6000).selectExpr("id AS seq", "1L AS stratum", "hash(id) * 1L AS key", "1 + id % 97 AS size", "0.37D AS p")
    got = cube_mix.balanced(df, chunk=512).join(df.select("seq", "size"), "seq").toPandas()
    assert len(got) == 6000 and set(got.p) == {0.0, 1.0}
    assert abs((got.p * got["size"]).sum() - 0.37 * got["size"].sum()) < 30 and abs(got.p.sum() - 0.37 * 6000) < 10


def test_identical_rows_are_dealt(spark):
    """50,000 rows that are all alike: no chunk holds more than about its share, and half of them are taken."""
    df = spark.range(50_000, numPartitions=7).selectExpr("monotonically_increasing_id() AS seq", "1L AS stratum", "7L AS key", "10L AS size", "0.5D AS p")
    turns = cube_mix._turns(df).toPandas()
    assert sorted(turns.turn) == list(range(50_000))
    got = cube_mix.balanced(df).toPandas()
    assert len(got) == 50_000 and set(got.p) == {0.0, 1.0} and abs(got.p.sum() - 25_000) <= 1
    n = -(-50_000 // cube_mix.CHUNK)
    dealt = cube_mix._turns(df).selectExpr(f"pmod(xxhash64(key, turn, 42), {n}) AS chunk").groupBy("chunk").count().toPandas()
    assert dealt["count"].max() < 1.2 * cube_mix.CHUNK


def test_sources_of_any_number(spark):
    rows = [(f"s{i:05}", 100) for i in range(3000)] + [(None, 50), ("", 10)]
    got = {r.source: r for r in cube_mix.targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    order = sorted(s for s, _ in rows if s is not None) + [None]
    assert [got[s].weight for s in order] == [(3.0, 1.0, 2.0)[i % 3] for i in range(len(order))]


def test_take_mix(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    taken = cube_mix.take_mix(docs)
    assert taken.columns == docs.columns
    assert taken.count() == cube_mix.mix_counts(docs).groupBy().sum("copies").first()[0]


def test_cascade_order_is_only_speed(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rules = quality_rules.rule_columns(quality_rules.BASE_RULES | quality_rules.RULES, quality_rules.measures())
    names = list(rules)
    kept = lambda order: sorted(str(r.doc_id) for r in quality_rules.cascade(docs, rules, order).where("rejected_by is null").collect())
    assert kept(names) == kept(names[::-1]) == sorted(str(r.doc_id) for r in quality_rules.keep_quality(docs).collect())
    assert sorted(quality_rules.cascade_order(docs, rules, 50)) == sorted(names)


def test_token_cache_encodes_only_misses(spark, small, tmp_path, monkeypatch):
    docs, path = spark.read.parquet(f"{small}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json")
    first = sorted(map(str, token_cache.count_tokens(docs, path, str(tmp_path)).collect()))
    stored = spark.read.parquet(str(tmp_path)).count()
    assert stored == docs.selectExpr("coalesce(text, '')").distinct().count()
    files = sorted(p for p in tmp_path.rglob("*.parquet"))
    monkeypatch.setattr(token_cache, "_encoded", lambda *_: pytest.fail("nothing was missing"))
    assert sorted(map(str, token_cache.count_tokens(docs, path, str(tmp_path)).collect())) == first
    assert sorted(p for p in tmp_path.rglob("*.parquet")) == files  # nothing was written
    monkeypatch.undo()
    assert token_cache.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), str(tmp_path)).count() == docs.count()


def test_second_batch_meets_the_first(spark, small, monkeypatch):
    docs, path = spark.read.parquet(f"{small}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json")
    asked, encode = [], token_cache._encoded

    def count(rows, wanted, path):
        asked.append({bytes(r.digest) for r in wanted.collect()})
        return encode(rows, wanted, path)

    monkeypatch.setattr(token_cache, "_encoded", count)
    got = sorted(map(str, token_cache.count_in_batches(docs, path).collect()))
    assert len(asked) == 2 and not asked[0] & asked[1]
    assert len(asked[0] | asked[1]) == docs.selectExpr("coalesce(text, '')").distinct().count()
    assert got == sorted(map(str, token_cache.count_tokens(docs, path).collect()))


@pytest.mark.parametrize("bits, most", [(8, 8), (8, 64), (8, 2**30), (2**16, 2**30)])
def test_bitmaps_decide_only_what_moves(spark, monkeypatch, bits, most):
    """With few bits nearly all texts are moved, by the size for their number those of several rows alone; counts are the same."""
    monkeypatch.setattr(token_cache, "LEAST_BITS", bits)
    monkeypatch.setattr(token_cache, "MOST_BITS", most)
    monkeypatch.setattr(token_cache, "SEEN", 3)
    moved, keep = [], token_cache.encode_counts

    def count_moved(texts, path):
        moved.append(texts.count())
        return keep(texts, path)

    monkeypatch.setattr(token_cache, "encode_counts", count_moved)
    docs = spark.createDataFrame([(i, f"text {i % 40}") for i in range(60)] + [(100, None)], "doc_id long, text string").repartition(4)
    count = token_cache.counter(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_cache.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert got == {r.doc_id: (len(r.text or ""), count(r.text or "")) for r in docs.collect()}
    # 41 digests, 20 of them of several rows
    assert moved == [41] if most == 8 else moved[0] <= 24 if most == 2**30 else moved[0] <= 41


def test_counter_special_strings():
    count = token_cache.counter(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("a<|endoftext|>b", "it's  fine\n\n x", "漢字 é\x1c ", "1234 5678"):
        assert count(text) == count.whole(text)


def test_machine_identity():
    """The sum-of-squares identity equals the sum over pairs."""
    rng = np.random.default_rng(0)
    m = fm_quality.Machine(0.1, rng.normal(size=50), rng.normal(size=(50, 3)))
    i, x = np.array([3, 7, 20, 41]), np.array([1.0, -2.0, 0.5, 3.0])
    pairs = sum(m.factors[a] @ m.factors[b] * x[p] * x[q] for (p, a), (q, b) in itertools.combinations(enumerate(i), 2))
    assert np.isclose(m.margin(i, x), 0.1 + m.linear[i] @ x + pairs)


def test_machine_learns_held_out(spark):
    rng = random.Random(2)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(40)) + "." for _ in range(300)]
    bad = ["### ".join(rng.choice(["alpha", "beta"]) for _ in range(40)) for _ in range(150)]
    data = [(i, t, len(t)) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame(data, "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(450)], "doc_id long, quality int")
    got = fm_quality.score_documents(docs, fm_quality.train(docs, labels)).where("held_out").collect()
    assert sum(r.predicted == int(r.doc_id < 300) for r in got) / len(got) > 0.98
    nothing = fm_quality.train(docs, labels.limit(0))
    assert all(abs(r.score - 0.5) < 1e-9 for r in fm_quality.score_documents(docs, nothing).collect())


@given(st.lists(st.sampled_from(["a", "b@", "@", ".", "c.d", "1", "4539", "-", " ", "+", "12", "255", "256", "_", "x@y.z", "1.2.3.4", "4111111111111111"]), max_size=14))
@settings(max_examples=300, deadline=None)
def test_base_spans(parts):
    from .test_contracts import pii

    text = "".join(parts)
    assert sorted(pii_boost.base_spans(text)) == sorted(pii(text))


@pytest.mark.parametrize("n", [1, 2, 3, 24, 25, 100, 4097])
def test_permutation(spark, n):
    got = [r.p for r in spark.range(n).select(feistel_shard.permuted(F.col("id"), n).alias("p")).collect()]
    assert sorted(got) == list(range(n)) and (n < 25 or got != list(range(n)))


def test_write_shards(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").drop("shard", "slot")
    feistel_shard.write_shards(docs, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    counts = [r["count"] for r in back.groupBy("shard").count().collect()]
    assert sum(counts) == docs.count() and max(counts) - min(counts) <= 1


@given(st.text(alphabet="<>/ab p\"'=&;!-#3", max_size=60))
@settings(max_examples=200, deadline=None)
def test_any_markup_is_borne(text):
    found = html_wrappers.blocks(text)
    html_wrappers.main_text(text, html_wrappers.Wrapper(html_wrappers.page_wrapper(found)))
    assert all(b.text and b.text == b.text.strip() for b in found)


def test_bpe_documents(spark, small):
    docs, path = spark.read.parquet(f"{small}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    back = byte_bpe.decode_documents(byte_bpe.encode_documents(docs.where("doc_id is not null"), path), path)
    want = sorted((r.doc_id, r.text or "") for r in docs.where("doc_id is not null").collect())
    assert sorted((r.doc_id, r.text) for r in back.collect()) == want


@given(st.text(max_size=40))
@settings(max_examples=200, deadline=None)
def test_bpe_is_tiktoken(text):
    import tiktoken

    bpe = byte_bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    global _TIK
    try:
        tik = _TIK
    except NameError:
        tik = _TIK = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    assert bpe.encode(text) == tik.encode_ordinary(text) and bpe.decode(bpe.encode(text)) == text.encode()
