"""Numbers and running sums by range partitions, and the operators that rest on them, against plain versions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import agreement, frequency, joins, pipeline, ranges, sets, vectors, windows
from corpusloom.sources import readers
from corpusloom.streaming import trickle


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(i, rng.choice(["a", "b", None]), rng.randint(0, 30)) for i in range(500)] + [(7, "a", 3)] * 50
    return data, spark.createDataFrame(data, "id int, g string, v int").repartition(5)


def test_numbers(rows):
    data, df = rows
    got = ranges.numbered(df, [F.desc("v"), "id"], "n").collect()
    assert [(r.v, r.id) for r in sorted(got, key=lambda r: r.n)] == [(v, i) for i, _, v in sorted(data, key=lambda x: (-x[2], x[0]))]
    assert sorted(r.n for r in got) == list(range(1, len(data) + 1))
    assert ranges.numbered(df.limit(0), ["id"]).count() == 0


def test_numbers_within_groups(rows):
    data, df = rows
    got = ranges.numbered_within(df, ["g"], ["v", "id"], "n").collect()
    for g in ("a", "b", None):
        own = sorted((r for r in got if r.g == g), key=lambda r: r.n)
        assert [r.n for r in own] == list(range(1, len(own) + 1))
        assert [(r.v, r.id) for r in own] == sorted((v, i) for i, h, v in data if h == g)


def test_running_sums(rows):
    data, df = rows
    got = sorted(ranges.running(df.where("id <> 7"), ["id"], {"upto": "v"}).collect(), key=lambda r: r.id)
    total = 0
    for r in got:
        total += r.v
        assert r.upto == total


def test_lists_of_large_groups_are_refused(spark, rows):
    _, df = rows
    assert windows.ordered_rows(df, "g", ["v", "id"]).count() == df.count()
    with pytest.raises(Exception, match="more than 100 rows"):
        windows.ordered_lists(df, "g", ["v"], most=100).collect()


def test_alias_chains_of_any_length(spark):
    n = 40
    raw = spark.createDataFrame([("m0",), ("c0",), ("end",), ("two",)], "m string")
    groups = spark.createDataFrame([("G", 1), ("H", 2)], "group_id string, pos int")
    members = spark.createDataFrame([("G", 1, f"m{n}"), ("H", 2, "h")], "group_id string, pos int, member string")
    aliases = [(f"m{i}", 0, f"m{i + 1}") for i in range(n)] + [("c0", 0, "c1"), ("c1", 0, "c2"), ("c2", 0, "c0")] + [("two", 0, "c0"), ("two", 1, "h")]
    index = spark.createDataFrame([], "motif string, group_id string")
    got = joins.resolve(raw, "m", groups, members, spark.createDataFrame(aliases, "alias string, ord int, ref string"), index)
    assert {r.motif: r.group_id for r in got.collect()} == {"m0": "G", "c0": None, "end": None, "two": "H"}


def test_many_eras_are_joined_by_slices(spark):
    rng = random.Random(3)
    eras = [(f"e{i}", rng.randint(-500, 500)) for i in range(1200)]
    eras = [(e, a, a + rng.randint(1, 40)) for e, a in eras]
    years = [(i, rng.randint(-550, 550)) for i in range(80)]
    got = frequency.era_join(spark.createDataFrame(years, "id int, year int"), "year", spark.createDataFrame(eras, "era string, start int, end int"))
    assert sorted((r.id, r.era) for r in got.collect()) == sorted((i, e) for i, y in years for e, a, b in eras if a <= y < b)


def test_tiles_give_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 7)
    rng = random.Random(4)
    data = [(i, i % 2, [rng.gauss(0, 1) for _ in range(3)], float(rng.randint(0, 3))) for i in range(60)]
    df = spark.createDataFrame(data, "id int, g int, v array<double>, w double").repartition(4)
    unit = {i: [x / sum(y * y for y in v) ** 0.5 for x in v] for i, _, v, _ in data}
    cos = lambda a, b: sum(x * y for x, y in zip(unit[a], unit[b]))
    want = {(a, b): (round(cos(a, b), 4), b if data[b][3] > data[a][3] else a) for a in range(60) for b in range(a + 1, 60) if a % 2 == b % 2 and cos(a, b) >= 0.5}
    got = vectors.cosine_pairs(df, "g", "id", "v", 0.5, "w", None).collect()
    assert {(r.a, r.b): (r.cosine, r.keep) for r in got} == want and len(got) == len(want)
    near = vectors.nearest(df.where("id < 10"), df, "id", "v", "g", 4).collect()
    for q in range(10):
        best = sorted((-round(cos(q, j), 4), j) for j in range(60) if j != q and j % 2 == q % 2)[:4]
        assert sorted((r["rank"], r.id, r.cosine) for r in near if r.query == q) == [(n, j, -c) for n, (c, j) in enumerate(best, 1)]


def test_flat_fields_at_any_depth(spark):
    deep = '{"a": {"b": [1, {"c": "x"}, [], null, [true]]}, "d": "", "e": {}}'
    got = sets.flat_fields(spark.createDataFrame([(1, deep), (2, "broken"), (3, None)], "k int, doc string"), "k", "doc").collect()
    assert sorted((r.k, r.path, r.value) for r in got) == [(1, "a.b.1", "1"), (1, "a.b.2.c", "x"), (1, "a.b.5.1", "true"), (1, "d", "")]


def test_strict_lines_tell_the_place(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\nbroken\n')
    with pytest.raises(ValueError, match=r"x\.jsonl:4: no JSON"):
        readers.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int", strict=True)


def test_chunks_keep_their_marker(spark, tmp_path):
    (tmp_path / "a.yml").write_text("version: 1\nmotifs:\n- motif_id: x\n  label: one\n- motif_id: y\n  label: two\nother: 3\n")
    (tmp_path / "b.yml").write_text("- motif_id: z\n  label: three\n")
    chunks = readers.read_chunks(spark, str(tmp_path))
    assert sorted((r.kind, r.chunk.strip()) for r in chunks.collect()) == [
        ("header", "version: 1\nmotifs:"), ("item", "- motif_id: x\n  label: one"), ("item", "- motif_id: y\n  label: two"), ("item", "- motif_id: z\n  label: three"),
    ]
    got = readers.parse_chunks(chunks, "motif_id string, label string").collect()
    assert sorted((r.record.motif_id, r.record.label) for r in got) == [("x", "one"), ("y", "two"), ("z", "three")]


def test_paths_are_looked_up_in_any_form(spark):
    df = spark.createDataFrame([("./texts//a.md",), ("texts/a.md",), ("texts/./a.md",), ("texts/b.md",)], "path string")
    assert sets.by_path(df, "/texts/a.md").count() == 3


def test_merge_rewrites_only_its_parts(spark, tmp_path):
    target = str(tmp_path / "t")
    sink = trickle.merge_sink(target, "k", "o", 8)
    sink(spark.range(100).selectExpr("id AS k", "1 AS o", "'old' AS v"), 0)
    sink(spark.createDataFrame([(5, 2, "new"), (6, 0, "late")], "k long, o int, v string"), 1)
    parts = spark.read.parquet(target).groupBy("__epoch").agg(F.count_distinct("__part").alias("n")).collect()
    assert {r["__epoch"]: r.n for r in parts}[1] <= 2
    got = {r.k: r.v for r in trickle.read_merged(spark, target).collect()}
    assert len(got) == 100 and got[5] == "new" and got[6] == "old"
    sink(spark.createDataFrame([(5, 2, "new")], "k long, o int, v string"), 1)  # the same epoch again
    assert {r.k: r.v for r in trickle.read_merged(spark, target).collect()}[5] == "new"


def test_gate_and_jobs(spark):
    v = spark.createDataFrame([(1, None, "reject"), (2, None, "accept"), (3, "swap", "revise"), (4, "swap", "accept")], "id int, h string, v string")
    got = {(r.part, r["name"]): (r.n, r.rate) for r in agreement.gate_report(v, "h", "v").collect()}
    assert got["honeypot", "swap"] == (2, 0.5) and got["total", "escalations"] == (1, None) and got["total", "records_gated"] == (2, None)
    jobs = spark.createDataFrame([("1", "prepared", None), ("2", "in_progress", "b"), ("3", "failed", "c"), ("4", "prepared", None)], "s string, status string, batch_id string")
    decide = lambda **k: [r.decision for r in sorted(pipeline.job_decisions(jobs, "s", **k).collect(), key=lambda r: r.s)]
    assert decide() == ["create", "skip", "skip", "create"] and decide(retry_failed=True) == ["create", "skip", "create", "create"]
    assert decide(most=2) == ["create", "skip", "skip", "defer"] and decide(most=1) == ["defer", "skip", "skip", "defer"]
    assert decide(force=True) == ["create"] * 4
