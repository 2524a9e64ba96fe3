"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing columns, copies."""

from __future__ import annotations

import random

import pytest

WORDS = "the and of thon ere tion shan edat onre ingth hea ntor lyst wher bleed inou".split()
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = (
    "size", "fp", "key", "seq", "count", "stratum", "digest", "shard", "slot", "rank", "root", "component_id", "n_words", "m", "host", "roles", "anchor", "p", "row_number", "row", "found", "owner", "kind", "hits",
    "__at", "__part", "__p", "__before", "__local", "__place", "__crc", "__size", "__row", "__seq", "__copies", "__copy", "__length", "__keep_id", "__n", "__fp", "__keep_fp", "__kept_0", "__kept_5", "__h", "__hot", "a.b",
)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def rows():
    rng = random.Random(5)
    out = []
    for i in range(60):
        text = prose(rng, rng.choice([3, 30, 80, 200]))
        out.append((i, text, "en", f"src{i % 4}", len(text)))
    base = prose(rng, 300)
    out += [(100 + i, base, "en", "src0", len(base)) for i in range(12)]
    out += [(120 + i, base + " " + w, "en", None, None) for i, w in enumerate(WORDS[:8])]
    junk = " ".join(w + "###" for w in base.split()[:50])
    out += [(140, junk, "en", "src1", len(junk)), (141, "Same line of words here\n" * 30, "en", "src2", None), (142, "go go go go go " * 20, "en", "src2", 0)]
    out += [(150, None, None, None, None), (151, "", "en", "", 0), (152, " \t\n ", "en", "src1", 4), (153, "one", "fr", "src1", 3), (154, "x" * 50_000, "en", "src3", 50_000)]
    out += [(155, prose(rng, 12_000), "en", "src3", None)]
    out += [(None, "no id but words " * 10, "en", "src1", 1), (None, None, None, None, None), (None, base, "en", "src1", 1)]
    out += [out[0], out[0], (160, "A B c D", "en", "src1", 7), (161, "a b C d", "en", "src1", 7)]
    out += [(170, "Mail bosbt.42@mail8.example.com or +1 (988) 555-2485, at 10.0.0.255 and 256.1.1.1, card 4111 1111 1111 1111 é 4111111111111112", "en", "src2", 1)]
    return out


def write(spark, home, table, data, schema, clash=True):
    df = spark.createDataFrame(data, schema)
    if clash:
        for c in CLASHES:
            if c not in df.columns:
                from pyspark.sql import functions as F

                df = df.withColumn(c, F.lit(f"clash of {c}"))
    df.repartition(3).write.mode("overwrite").parquet(f"{home}/{table}.parquet")


@pytest.fixture(scope="session")
def small(spark, tmp_path_factory):
    """A folder of small tables, every document table with clashing columns."""
    home = str(tmp_path_factory.mktemp("small"))
    write(spark, home, "documents", rows(), DOCUMENTS)
    rng = random.Random(6)
    vectors = [(i, [rng.gauss(0, 0.2) for _ in range(8)], i % 3) for i in range(330)]
    vectors += [(1000, None, 0), (1050, [0.1, None] * 4, 0), (1100, [float("nan")] * 8, 0), (1101, [float("inf")] * 8, 0), (1150, vectors[50][1], 1), (1151, vectors[50][1], 1), (None, vectors[0][1], 0)]
    write(spark, home, "embeddings", vectors, "vec_id long, embedding array<float>, label int")
    write(spark, home, "labels", [(i, int(i % 5 > 0), 0) for i in range(60)] + [(i, None, 0) for i in range(5)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    page = "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=x>Menu</a></ul></nav><div class='ad'>Buy</div><article><h1>T &amp; {0}</h1><p><b>First {0}<br>line.<p>Second&nbsp;{0}</p></article><div id=comments><p>nice</p></div><footer>&copy; x</footer></body></html>"
    pages = [(i, f"http://h{i % 3}.example.com/{i}", page.format(i)) for i in range(20)]
    pages += [(30, None, page.format("n")), (31, "http://h0.example.com/z", None), (32, "http://h0.example.com/y", ""), (33, "no url", "plain < text &amp; more"), pages[0], (None, "http://h1.example.com/q", page.format("q"))]
    write(spark, home, "pages", pages, "page_id long, url string, html string")
    return home


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    home = str(tmp_path_factory.mktemp("empty"))
    for table, schema in (("documents", DOCUMENTS), ("embeddings", "vec_id long, embedding array<float>, label int"), ("labels", "doc_id long, quality int, toxic int"), ("pages", "page_id long, url string, html string")):
        write(spark, home, table, [], schema, False)
    return home
