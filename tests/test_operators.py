"""Operators on hand-made rows: the cases that the table queries don't reach."""

from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import lines as L
from corpusloom.functions import text as T
from corpusloom.operators import agreement, frequency, graph, integrity, joins, lines, pipeline, sets, vectors, windows
from corpusloom.sources import readers, sinks
from corpusloom.streaming import trickle


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_scalars(spark):
    v = lambda c: value(spark, c)
    assert v(T.slug(F.lit("  The Flood: & Fire!"))) == "the_flood_fire"
    assert v(T.titleize(F.lit("mcDuck of_the-North"))) == "McDuck Of The North"
    assert v(T.display_label(F.lit(None).cast("string"), F.lit("  "), F.lit(" x "))) == "x"
    assert v(T.path_tradition(F.lit("texts/public/norse/a.md"))) == "norse" and v(T.path_tradition(F.lit("a/b"))) == "unknown"
    assert v(T.year_label(F.lit(-300))) == "300 BCE" and v(T.midpoint(F.lit(-301), F.lit(-300))) == -301
    assert v(T.norm_ws(F.lit(" “a”\n—  b… "))) == '"a" - b...'
    assert v(T.jaccard(F.array().cast("array<int>"), F.array().cast("array<int>"))) == 1.0
    assert v(T.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)))) == pytest.approx(1 / 3)
    assert v(T.start_line_hint(F.lit("x\npassage_locator:\n  label: a\n  start: '68'\n"))) == 68
    assert v(T.first_sentences(F.lit("One. Two!\nThree? Four."), 3)) == "One. Two! Three?"
    assert v(T.evidence_quote(F.lit("Aa. " + "b" * 600 + "."), 480)) == "Aa."
    assert v(T.thousands(F.lit(1234567))) == "1,234,567"


def test_quotes(spark):
    text = F.lit("the sea rose over the land and drowned all men that lived there")
    ok = lambda q: value(spark, T.quote_matches(T.norm_ws(F.lit(q)), text))
    assert ok("rose over the land") and not ok("rose above the land")
    assert ok("the sea rose over ... drowned all men") and not ok("the sea rose over [...] drowned all women")
    assert ok("the sea rose over the land ... men") is False  # one long fragment: the whole must be there


def test_payloads(spark):
    parse = lambda s: value(spark, T.lenient_json(F.lit(s), "a int"))
    assert parse('```json\n{"a": 1}\n```').a == 1 and parse('so: {"a": 2} ok').a == 2 and parse("nothing") is None
    df = frame(spark, [([("message", "x"), ("other", "y"), ("message", "z")],)], "p array<struct<type:string,text:string>>")
    assert df.select(T.response_text(F.col("p")).alias("v")).first().v == "x\nz"


@given(st.lists(st.integers(0, 8), max_size=6), st.lists(st.integers(0, 8), max_size=6))
@settings(max_examples=15, deadline=None)
def test_jaccard_is_symmetric(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a array<int>, b array<int>")
    x, y = df.select(T.jaccard("a", "b"), T.jaccard("b", "a")).first()
    assert x == y and 0 <= x <= 1 and (x == 1) == (set(a) == set(b))


def doc(spark, text):
    return lines.to_lines(frame(spark, [(1, text)], "doc_id int, text string"))


def kept(df):
    return [r.line for r in df.orderBy("line_no").collect()]


def test_line_steps(spark):
    assert kept(lines.dehyphenate(doc(spark, "foo-\nbar-\nbaz-\nqux\nend"))) == ["foobar-", "bazqux", "end"]
    assert kept(lines.collapse_blanks(doc(spark, "a\n\n \n\t\n\nb"))).count("") <= 4
    assert kept(lines.collapse_blanks(doc(spark, "a\n\n\n\n\nb"))) == ["a", "", "", "b"]
    assert kept(lines.drop_furniture(doc(spark, "\n".join(["[12]", "Hosted by Google", "text"] + ["CHAPTER IV"] * 3)), min_repeats=3)) == ["text"]
    assert kept(lines.trim_range(doc(spark, "---\nt: a\n---\none\ntwo\nthree"), 5, 5)) == ["---", "t: a", "---", "two"]
    assert kept(lines.state_machine(doc(spark, "x\nON\na\nOFF\nb"), "^ON", "^OFF")) == ["ON", "a"]
    assert kept(lines.tail_cut(doc(spark, "\n".join(["a"] * 9 + ["INDEX"])), "INDEX")) == ["a"] * 9
    assert kept(lines.between_markers(doc(spark, "x\nA\n1\nB\ny\nC\n2\nD"), [("^A", "^B"), ("^C", "^D")])) == ["A", "1", "C", "2"]
    assert kept(lines.stop_at_garble(doc(spark, "good line here\n" + "z\n" * 6 + "after this"), 6)) == ["good line here"]
    assert kept(lines.tail_backtrack(doc(spark, "good line\nz\nCARD\nrest"), "CARD")) == ["good line"]
    assert kept(lines.min_run(doc(spark, "a\na\nX\na\na\na"), F.col("line") == "a", F.lit(True), 3)) == ["a", "a", "a"]
    assert kept(lines.guarded_trim(doc(spark, "h\nb\nc"), 2, 2, "^b")) == ["b"] and len(kept(lines.guarded_trim(doc(spark, "h\nb\nc"), 2, 2, "^z"))) == 3
    assert kept(lines.drop_listed(doc(spark, "a\n b \nc"), frame(spark, [("b",)], "line string"))) == ["a", "c"]


def test_cleaning_is_idempotent(spark):
    once = lines.to_text(lines.clean_ocr(doc(spark, "a long-\nword\n\n\n\n\n[3]\nend")))
    assert lines.to_text(lines.clean_ocr(lines.to_lines(once))).first().text == once.first().text
    assert value(spark, lines.plain(F.lit("\na \r\n\n\n\n\n\nb\n"))) == "a\n\n\nb"
    assert value(spark, lines.soft_hyphens(F.lit("wo¬\n\nrd"))) == "word" and value(spark, lines.neutral_angles(F.lit("<a>  b"))) == "(a) b"
    assert value(spark, lines.rejoin_paragraphs(F.lit("one,\n\ntwo"))) == "one, two" and value(spark, lines.opening(F.lit("a\nb\nc"), 2)) == "a\nb"


def test_sections_and_paragraphs(spark):
    got = {r.heading: r for r in lines.sections(doc(spark, "# t\n## A\nx\n#### deep\n## B\ny\n## A\nz")).collect()}
    assert got["A"].body == "z" and got["A"].start_line == 7 and got["B"].body == "y"
    assert [r.text for r in lines.paragraphs(doc(spark, "a\nb\n\n\nc")).orderBy("para_no").collect()] == ["a\nb", "c"]
    good = "some plain words here\nand more of them now\nto make a block"
    assert lines.quality_blocks(doc(spark, good + "\n\n^^ \\ 12\n!!\n??")).count() == 1


def test_lint(spark):
    text = "---\nt: <b>\n---\n<b>x</b> \n```\n<i>\n```\n`<u>` &amp;\n\n\n\nProject Gutenberg\n<script>\nno newline"
    got = {(r.line_no, r.rule) for r in lines.lint(doc(spark, text)).collect()}
    assert got == {(4, "raw HTML tag"), (4, "trailing whitespace"), (8, "undecoded HTML entity"), (9, "excessive blank lines"), (12, "distributor boilerplate"), (13, "script/style tag"), (14, "missing final newline")}
    assert lines.lint(doc(spark, "fine\n")).count() == 0


def test_line_classifiers(spark):
    v = lambda c: value(spark, c)
    assert v(L.foreign(F.lit("ἀνὴρ μοῦσα λόγος"))) and not v(L.foreign(F.lit("the ἀνὴρ and μοῦσα")))
    assert v(L.garble(F.lit("#% 12 ~~ ||"))) and not v(L.garble(F.lit("the man was here")))
    assert v(L.verso_caps_header(F.lit("12 THE LAND OF MEN"))) and not v(L.verso_caps_header(F.lit("12 the land")))
    assert v(L.no_word(F.lit("12 ab"))) and v(L.glyph_soup(F.lit("$% ^& a1"))) and v(L.no_stopword(F.lit("ka mata te")))
    assert v(L.vowel_final(F.lit("kia ora tatou koutou"))) and not v(L.vowel_final(F.lit("the land was ora")))
    assert v(L.short_tokens(F.lit("a bc de f gh"))) and not v(L.short_tokens(F.lit("a whale de f gh")))


def test_resolution(spark):
    groups = frame(spark, [("g1", 1), ("g2", 2)], "group_id string, pos int")
    members = frame(spark, [("g2", 2, "m"), ("g1", 1, "m"), ("g2", 2, "n")], "group_id string, pos int, member string")
    aliases = frame(spark, [("al", 1, "nowhere"), ("al", 2, "be"), ("al", 3, "m"), ("be", 1, "n"), ("c1", 1, "c2"), ("c2", 1, "c1")], "alias string, ord int, ref string")
    index = frame(spark, [("i", "g2"), ("lost", "gone"), ("m2", "g1")], "motif string, group_id string")
    raw = frame(spark, [(x,) for x in ("i", "g1", "m", "al", "c1", "none", "lost")], "motif string")
    got = {r.motif: r.group_id for r in joins.resolve(raw, "motif", groups, members, aliases, index).collect()}
    assert got == {"i": "g2", "g1": "g1", "m": "g1", "al": "g2", "c1": None, "none": None, "lost": None}


def test_joins(spark):
    eras = frame(spark, [("old", -10, 0), ("new", 0, 10)], "era string, start int, end int")
    got = frequency.era_join(frame(spark, [(-1,), (0,), (50,)], "y int"), "y", eras).orderBy("y").collect()
    assert [(r.y, r.era) for r in got] == [(-1, "old"), (0, "new")]
    look = joins.lookup(frame(spark, [("a",)], "k string"), "k", frame(spark, [("a", 2, "y"), ("a", 1, "x")], "k string, o int, v string"), "k", "v", "o")
    assert look.first().v == "x"
    assert joins.last_by(frame(spark, [("a", 1), ("a", 2)], "k string, o int"), "k", "o").first().o == 2
    listed = frame(spark, [("s", "f.002"), ("s", "x.001")], "s string, unit string")
    assert sorted(r.unit for r in joins.expand_ranges(frame(spark, [("s", "f", 1, 2)], "s string, p string, a int, b int"), "s", "p", "a", "b", listed).collect()) == ["f.001", "f.002", "x.001"]


def test_integrity(spark):
    rec = frame(spark, [(1, "t", "1", "3"), (2, "t", "2", "9"), (3, "t", "x", "1"), (4, "u", "1", "1")], "id int, src string, start string, end string")
    src = frame(spark, [("t", i) for i in range(1, 4)], "src string, line_no int")
    assert sorted(r.id for r in integrity.bad_line_ranges(rec, src, "src").collect()) == [2, 3, 4]
    arr = frame(spark, [(1, ["a", "a"], ["a"]), (2, ["a"], ["a", "z"])], "id int, ids array<string>, refs array<string>")
    assert integrity.repeated_ids(arr, "ids").first().id == 1 and integrity.dangling_within(arr, "refs", "ids").first().missing == ["z"]
    cover = integrity.bin_cover(frame(spark, [("a",), ("b",), ("c",)], "c string"), "c", frame(spark, [("a",), ("a",), ("b",), ("z",)], "c string"), "c")
    assert {(r.child, r.problem) for r in cover.collect()} == {("a", "repeated"), ("c", "unbinned"), ("z", "unknown")}
    v = integrity.verify_quotes(frame(spark, [(1, "s", "the old king"), (1, "s", "the new king"), (1, "q", "x")], "r int, s string, quote string"), frame(spark, [("s", "here the  old king")], "s string, text string"), "r", "s")
    row = integrity.quote_rollup(v, "r").first()
    assert (row.n_verified, row.n_failed, row.n_missing, row.rate, row.samples) == (1, 1, 1, 0.3333, ["the new king"])


def test_graph(spark):
    sets_ = graph.item_sets(frame(spark, [("g", r, i) for r in range(30) for i in ("ab" if r % 2 else "cd")] + [("g", 99, None)], "g string, r int, i string"), "g", "r", "i")
    counts = {(r.a, r.b): r for r in graph.pair_counts(sets_).collect()}
    assert set(counts) == {("a", "b"), ("c", "d")} and counts["a", "b"].n == 30 and counts["a", "b"].n_ab == 15
    assert {(r.a, r.b): r.pmi for r in graph.pmi_edges(graph.pair_counts(sets_)).collect()}["a", "b"] == 0.6931
    deal = graph.permute(sets_, 3).collect()
    assert {r.perm for r in deal} == {1, 2, 3} and {r.item for r in deal} == set("abcd")
    assert sorted(map(str, deal)) == sorted(map(str, graph.permute(sets_.repartition(5), 3).collect()))
    none = graph.null_summary(graph.conserved_edges(graph.pmi_edges(graph.pair_counts(sets_)), 1), graph.null_counts(sets_, 3, min_groups=99), 3).first()
    assert none.null_mean == 0 and none.z is None and none.p == 0.25
    edges = frame(spark, [("a", "b", 3, 9), ("b", "c", 3, 9), ("x", "y", 2, 5)], "a string, b string, n_groups int, cooccurrence int")
    labels = graph.label_propagation(edges)
    com = graph.communities(labels, edges).collect()
    assert {(r.size, r.internal_edges, r.mean_groups) for r in com} == {(3, 2, 3.0), (2, 1, 2.0)}
    assert len({r.label for r in labels.where("node IN ('a', 'b', 'c')").collect()}) == 1


def test_agreement(spark):
    rows = [("r1", 1, "l1", "a"), ("r1", 1, "l2", "a"), ("r2", 1, "l3", "a"), ("r2", 1, "l3", "b"), ("r1", 2, "l4", "a")]
    got = {(r.p, r.f): (r.readers, r.tier) for r in agreement.consensus(frame(spark, rows, "run string, p int, line string, f string"), "p", "run", "f", "line").collect()}
    assert got == {(1, "a"): (3, "confirmed"), (1, "b"): (1, "provisional")}


def test_pipeline_parts(spark):
    old, new = frame(spark, [("a", 1, "x"), ("b", 1, "y")], "k string, o int, v string"), frame(spark, [("a", 1, "z")], "k string, o int, v string")
    assert {r.k: r.v for r in pipeline.upsert(old, new, "k", "o").collect()} == {"a": "z", "b": "y"}
    assert pipeline.same_reviewer(frame(spark, [("m", "m"), ("m", "n")], "d string, r string"), "d", "r").count() == 1
    q = frame(spark, [(1, "queued", "s"), (2, "done", "s"), (3, "queued", "t")], "id int, status string, source string")
    assert [r.id for r in pipeline.queue_scan(q, ["queued"], source="s", limit=5).collect()] == [1]
    assert [r.shard_id for r in pipeline.shards(spark.range(5), "id", 2).orderBy("id").collect()] == ["0001", "0001", "0002", "0002", "0003"]


def test_windows_and_sets(spark):
    df = frame(spark, [("g", i, i % 3) for i in range(6)], "g string, i int, s int")
    assert [r.start for r in windows.offsets(df, "g", "i", "s").orderBy("i").collect()] == [0, 0, 1, 3, 3, 4]
    assert windows.islands(df, "g", "i", F.col("s") > 0).select("run").distinct().count() == 2
    assert sets.atlas({"a": df, "b": spark.range(2)}).where("collection = 'b'").count() == 2
    assert sets.large_groups(df, "g", "i", 7).count() == 0 and sets.training_gate(frame(spark, [("allowed",), ("no",), (None,)], "u string"), "u").count() == 1
    assert sets.isolated(F.lit("texts/x"), ["texts/experiential"]) is not None


def test_vectors(spark):
    df = frame(spark, [(1, "b", [1.0, 0.0], 1), (2, "b", [2.0, 0.1], 5), (3, "b", [0.0, 0.0], 1), (4, "c", [1.0, 0.0], 1)], "k int, blk string, v array<double>, n int")
    got = vectors.cosine_pairs(df, "blk", "k", "v", 0.9, "n").collect()
    assert [(r.a, r.b, r.keep, r.cosine) for r in got] == [(1, 2, 2, 0.9988)]
    xy = frame(spark, [(1, 10), (2, 20), (3, 25), (3, 40)], "x int, y int")
    assert vectors.spearman(xy, "x", "y").first().spearman == pytest.approx(0.9487)
    assert vectors.ks_distance(spark.range(10).toDF("v"), spark.range(5, 15).toDF("v"), "v").first().ks == 0.5


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "a.yml").write_text("record_id: r1\ntags: [x, y]\n")
    (tmp_path / "y" / "b.yml").write_text("a: [broken\n")
    got = {r.path.rsplit("/", 1)[1]: r for r in readers.read_yaml(spark, str(tmp_path / "y"), "record_id string, tags array<string>").collect()}
    assert got["a.yml"].record.tags == ["x", "y"] and got["b.yml"]._corrupt_record
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.md").write_text("---\nid: one\ntitle: 'Two: x'\n---\nBody\n---\nrest\n")
    (tmp_path / "m" / "b.md").write_text("No front\n")
    md = {r.path.rsplit("/", 1)[1]: r for r in readers.read_markdown(spark, str(tmp_path / "m")).collect()}
    assert md["a.md"].metadata == {"id": "one", "title": "Two: x"} and md["a.md"].body == "Body\n---\nrest\n" and md["b.md"].body == "No front\n"
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nbroken\n{"a": 2}\n')
    assert sorted(r.a for r in readers.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").collect() if r.a) == [1, 2]
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int", strict=True).collect()
    docs = spark.createDataFrame([(1, json.dumps({"quote": "q1", "x": [{"quote": " "}, {"y": {"quote": "q2"}}]})), (2, None)], "k int, d string")
    assert sorted(r.quote for r in readers.quotes(docs, "k", "d").collect()) == ["q1", "q2"]
    (tmp_path / "bin.txt").write_bytes(b"a\xffb")
    assert readers.read_binary_text(spark, str(tmp_path / "bin.txt")).first().content == "a�b"
    assert readers.raw_extensions(spark.createDataFrame([("t/a.PDF",), ("t/a.md",)], "path string")).count() == 1
    out = str(tmp_path / "t")
    sinks.write_new(spark.range(3), out, "id")
    assert sinks.write_new(spark.range(5), out, "id").count() == 2 and spark.read.parquet(out).count() == 5
    assert sinks.replace_block("a\n<!-- BEGIN x -->\nold\n<!-- END x -->\n", "x", "new") == "a\n<!-- BEGIN x -->\nnew\n<!-- END x -->\n"
    assert sinks.markdown_table(spark.range(1)) == "| id |\n| --- |\n| 0 |" and "count: 2" in sinks.yaml_index(spark.range(2), {"v": 1}, "rows")
    sinks.write_collections({"a": spark.range(2), "b": spark.range(3)}, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c")).count() == 5


def test_stream_merge(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, o int, v string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(1, 2, "c")], "k int, o int, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = trickle.trickle(spark, str(tmp_path / "in"), rows.schema)
    trickle.drain(stream, trickle.merge_sink(str(tmp_path / "out"), "k", "o"), str(tmp_path / "state"))
    out = lambda: {r.k: r.v for r in trickle.read_merged(spark, str(tmp_path / "out")).collect()}
    assert out() == {1: "c", 2: "b"}
    trickle.vacuum(spark, str(tmp_path / "out"))
    assert out() == {1: "c", 2: "b"} and spark.read.parquet(str(tmp_path / "out")).count() == 2
