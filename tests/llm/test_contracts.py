"""Each query against a brute-force version on the small tables, and on empty ones."""

from __future__ import annotations

import base64
import hashlib
import html
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
import public_tokenizers
import xxhash

from corpusloom.llm.queries import QUERIES

from .conftest import rows

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
BY_N = {int(k[2:].split("_")[0]): f for k, f in QUERIES.items()}


def result(spark, home, n):
    return [r.asDict() for r in BY_N[n](spark, home).collect()]


def bag(items):
    return Counter(tuple(x) for x in items)


@pytest.mark.parametrize("n", sorted(BY_N))
def test_empty_tables(spark, empty, n):
    assert result(spark, empty, n) == []


@pytest.mark.parametrize("n", [1, 2, 3, 8])
def test_reruns_agree(spark, small, n):
    assert bag(map(dict.values, result(spark, small, n))) == bag(map(dict.values, result(spark, small, n)))


def simhash(text):
    words = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, small):
    data = rows()
    fps = [simhash(r[1]) for r in data]
    root = {f: f for f in fps}
    find = lambda f: f if root[f] == f else find(root[f])
    for f in set(fps):
        for g in set(fps):
            if bin(f ^ g).count("1") <= 4:
                root[find(f)] = find(g)
    least = {}
    for r, f in zip(data, fps):
        if r[0] is not None:
            least[find(f)] = min(least.get(find(f), r[0]), r[0])
    want = bag((r[0], f"{f:016x}", least.get(find(f))) for r, f in zip(data, fps))
    assert bag((r["doc_id"], r["fingerprint"], r["component_id"]) for r in result(spark, small, 1)) == want


def test_mix(spark, small):
    data = rows()
    sizes = Counter()
    for r in data:
        sizes[r[3]] += len(SPACE.findall(r[1] or ""))
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, active = {}, 1.5 * sum(sizes.values()), set(order)
    while True:
        per = left / sum(weight[s] for s in active) if active else 0
        over = [s for s in active if per * weight[s] > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
            active.discard(s)
    target |= {s: per * weight[s] for s in active}
    got, taken = result(spark, small, 2), Counter()
    by_id = defaultdict(list)
    for r in data:
        by_id[r[0]].append(r)
    assert len(got) == len(data)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        sources = {x[3] for x in by_id[r["doc_id"]] if len(SPACE.findall(x[1] or "")) == r["size"] and sizes[x[3]] == r["source_size"]}
        assert any(math.isclose(r["target"], target[s], abs_tol=1e-6) for s in sources)
        taken[next(s for s in sources if math.isclose(r["target"], target[s], abs_tol=1e-6))] += r["taken"]
    for s in order:
        if sizes[s]:
            assert abs(taken[s] - target[s]) <= max(0.02 * target[s], max(len(SPACE.findall(r[1] or "")) for r in data if r[3] == s))


def quality(text):
    words = SPACE.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(wins)
    repeat = len({j for i, w in enumerate(wins) if seen[w] > 1 for j in range(i, i + 8)})
    chars, symbols = sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or "")
    adjacent = sum(a == b for a, b in zip(words, words[1:]))
    n, dup = len(words), len(lines) - len(set(lines))
    failed = n < 20 or 100 * repeat > 30 * n
    bad = 10 * symbols > n or 100 * dup > 40 * len(lines) or 10 * adjacent > 3 * n or chars < 2 * n or chars > 15 * n
    return n, chars, symbols, dup, repeat, failed, not (failed or bad)


def test_quality_rules(spark, small):
    keys = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    got = result(spark, small, 3)
    assert bag((r["doc_id"], *(r[k] for k in keys)) for r in got) == bag((r[0], *quality(r[1])) for r in rows())
    assert any(r["kept"] for r in got) and any(not r["kept"] and not r["base_failed"] for r in got)


def test_token_counts(spark, small):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in rows():
        n = len(t.encode(r[1] or "", add_special_tokens=False).ids)
        want.append((r[0], len((r[1] or "").encode()), n, n > 512))
    assert bag((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in result(spark, small, 4)) == bag(want)


def test_classifier(spark, small):
    got = result(spark, small, 5)
    assert bag((r["doc_id"], r["held_out"]) for r in got) == bag((r[0], r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in rows())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def pii(text):
    out, digits = [], lambda s: re.sub("[^0-9]", "", s)
    if "@" in text:  # else each start would be tried to the text's end
        out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], ["email", "ip", "card", "phone"].index(s[0])))


def test_pii(spark, small):
    want = []
    for r in rows():
        s = pii(r[1] or "")
        names = [x[0] for x in s]
        want.append((r[0], *(names.count(k) for k in ("email", "ip", "card", "phone")), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest()))
    got = result(spark, small, 6)
    assert bag((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == bag(want)
    spans = next(r["spans"] for r in got if r["doc_id"] == 170)
    assert [x.split(":")[0] for x in spans.split(",")] == ["email", "phone", "ip", "card"]


def test_topk(spark, small):
    import numpy as np

    data = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in data if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in ok:
        if q % 50 == 0:
            best = sorted((-int(np.dot(v, w)), j) for j, w in ok if j != q)[:5]
            want += [(q, k, j, -s) for k, (s, j) in enumerate(best, 1)]
    assert bag((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in result(spark, small, 7)) == bag(want)


def test_shards(spark, small):
    got = result(spark, small, 8)
    want = bag((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows())
    assert bag((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < 24
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[k]) for k in range(24)]
    assert max(counts) - min(counts) <= 1


def test_pages(spark, small):
    want = []
    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        found = re.search(r"(?s)<article>(.*)</article>", r.html or "")
        if found:
            parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", found[1])]
            text = "\n".join(p for p in parts if p)
        else:
            text = "plain < text & more" if r.page_id == 33 else ""
        want.append((r.page_id, r.url, text, len(text)))
    assert bag((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in result(spark, small, 9)) == bag(want)


def test_bpe(spark, small):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in rows():
        ids = t.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), sha(",".join(map(str, ids)).encode()), sha((r[1] or "").encode())))
    assert bag((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in result(spark, small, 10)) == bag(want)
