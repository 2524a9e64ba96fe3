"""Templates of many kinds, each with a brute-force answer: the blocks that its maker put in as text."""

from __future__ import annotations

import functools
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import html_wrappers as H

VOCABULARY = "hour salt river stone lamp field bread night wheel cloud paper ship king wood rain".split()


def some(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def article(rng):
    return [some(rng, 5).title(), *(some(rng, rng.randint(15, 40)) + "." for _ in range(rng.randint(2, 6)))]


def menu(rng):
    return "<nav><ul>" + "".join(f"<li><a href=/{w}>{w}</a></li>" for w in rng.sample(VOCABULARY, 4)) + "</ul></nav>"


def paragraphs(texts):
    return f"<h1>{texts[0]}</h1>" + "".join(f"<p>{t}</p>" for t in texts[1:])


LEGAL = "All rights reserved by the society of hours"

# name -> page of (rng, texts of the article)
TEMPLATES = {
    "article": lambda r, t: f"<body>{menu(r)}<article>{paragraphs(t)}</article><footer>{some(r, 6)}</footer></body>",
    "has_comments": lambda r, t: f"<body>{menu(r)}<article class='post hentry has-comments'>{paragraphs(t)}</article><div class=comments><p>{some(r, 9)}</p></div></body>",
    "with_sidebar": lambda r, t: f"<body><main class='story with-sidebar'>{paragraphs(t)}</main><aside>{some(r, 8)}</aside></body>",
    "no_menu": lambda r, t: f"<body class=no-menu><article class='entry no-menu'>{paragraphs(t)}</article></body>",
    "social": lambda r, t: f"<body><article class='content social'>{paragraphs(t)}</article><div class=share-buttons>{some(r, 3)}</div></body>",
    "article_header": lambda r, t: f"<body><header>{some(r, 3)}</header><article><div class=article-header><h1>{t[0]}</h1></div>{''.join(f'<p>{x}' for x in t[1:])}</article></body>",
    "header_in_article": lambda r, t: f"<body><article><header><h1>{t[0]}</h1></header>{''.join(f'<p>{x}</p>' for x in t[1:])}<footer>{some(r, 2)}</footer></article></body>",
    "share_line": lambda r, t: f"<body><article>{paragraphs(t)}<p>Share this story</p></article></body>",
    "line_within": lambda r, t: f"<body><article><h1>{t[0]}</h1><p>{t[1]}</p><p>Read on below</p>{''.join(f'<p>{x}</p>' for x in t[2:])}</article></body>",
    "divs_only": lambda r, t: f"<body><div class=top>{LEGAL}</div><div class=x1>{paragraphs(t)}</div><div class=links>{''.join(f'<a href=x>{some(r, 3)}</a> ' for _ in range(4))}</div></body>",
    "table": lambda r, t: f"<body><table><tr><td>{menu(r)}<td>{paragraphs(t)}<td class=ad-box>{some(r, 5)}</table><p>{LEGAL}</body>",
    "layout_class": lambda r, t: f"<body><div id=wrapper class=sidebar-right>{menu(r)}<article>{paragraphs(t)}</article></div></body>",
    "comment_articles": lambda r, t: f"<body><article>{paragraphs(t)}</article><section><article class=comment><p>{some(r, 9)}</p></article></section></body>",
    "notice": lambda r, t: f"<body><noscript>Please turn scripts on</noscript><div>{paragraphs(t)}</div><div class=cookie-notice>{some(r, 4)}</div><form>{some(r, 2)}</form></body>",
    "pairs": lambda r, t: "<body><article>" + "".join(f"<h2>{x[:9]}</h2><p>{x}</p>" for x in t) + "</article></body>",
}


def wanted(name, texts):
    if name == "share_line":  # what stands among the paragraphs is the article's, whether or not it recurs
        return "\n".join([*texts, "Share this story"])
    if name == "line_within":
        return "\n".join([*texts[:2], "Read on below", *texts[2:]])
    return "\n".join(y for x in texts for y in ((x[:9].strip(), x) if name == "pairs" else (x,)))


@pytest.fixture(scope="module")
def hosts():
    """(url, html, main text) of a host for each template, and one of all templates."""
    rng, out = random.Random(8), []
    for name, make in TEMPLATES.items():
        for host in (f"{name.replace('_', '-')}.example.org", "mixed.example.org"):
            for k in range(7):
                texts = article(rng)
                out.append((f"http://{host}/{name}/{k}", make(rng, texts), wanted(name, texts)))
    return out


def known(pages):
    return H.Wrapper(H.unpacked(H.packed(functools.reduce(H._deep(H.align), (H._deep(H.page_wrapper)(H.blocks(p)) for p in pages)))))


def test_templates(spark, hosts):
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(hosts)], "page_id long, url string, html string, want string").repartition(5)
    got = {r.page_id: r.text for r in H.extract(df).collect()}
    for i, (url, _, want) in enumerate(hosts):
        assert got[i] == want, url


def test_joined_by_shuffle(spark, hosts, monkeypatch):
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(hosts)], "page_id long, url string, html string, want string")
    want = {r.page_id: r.text for r in H.extract(df).collect()}
    monkeypatch.setattr(H, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(H, "HOT", 50)  # mixed.example.org is hot
    assert {r.page_id: r.text for r in H.extract(df).collect()} == want


@pytest.mark.parametrize("name", ["divs_only", "table", "notice"])
def test_the_wrapper_decides(hosts, name):
    """Fixed notices beside the running text: a page alone can't tell."""
    own = [(p, want) for url, p, want in hosts if url.startswith(f"http://{name.replace('_', '-')}.")]
    wrapper = known([p for p, _ in own])
    assert [H.main_text(p, wrapper) for p, _ in own] == [want for _, want in own]
    if name != "divs_only":
        assert any(H.main_text(p, None) != want for p, want in own)


def test_the_slot_is_the_hosts_not_the_pages():
    """A page of little text: by itself its advert would be the running text, by its host's wrapper it is not."""
    rng = random.Random(4)
    page = lambda texts: f"<body><div>{some(rng, 12)}</div><div>{paragraphs(texts)}</div></body>"
    pages = [page(article(rng)) for _ in range(9)] + [page(["Hours", "Rain."])]
    assert H.main_text(pages[-1], known(pages)) == "Hours\nRain."
    assert H.main_text(pages[-1], None) != "Hours\nRain."


@pytest.mark.parametrize("host", ["copies", "copies and longer", "poems", "poems without elements"])
def test_main_text_that_recurs_stays(host):
    rng = random.Random(7)
    texts = article(rng) + article(rng)
    if host.startswith("poems"):
        refrain = "And the wheel of the mill goes round in the rain"
        pages = [[some(rng, 2), *[x for _ in range(4) for x in (some(rng, 9), refrain)]] for _ in range(4)]
    else:
        pages = [[*texts[:-1], some(rng, 20)] for _ in range(3)] + [[some(rng, 30) for _ in range(9)] for _ in range(2)]
        if host.endswith("longer"):
            pages += [[some(rng, 60) for _ in range(30)] for _ in range(2)]
    html = (lambda t: f"<body>{menu(rng)}{paragraphs(t)}<footer>x</footer></body>") if host.endswith("elements") else (lambda t: f"<body>{menu(rng)}<article>{paragraphs(t)}</article><footer>x</footer></body>")
    made = [html(t) for t in pages]
    assert [H.main_text(p, known(made)) for p in made] == ["\n".join(t) for t in pages]


def test_words_that_mark_are_priors():
    rng = random.Random(9)
    texts = article(rng)
    social = f"<body>{menu(rng)}<div class='content social'>{paragraphs(texts)}</div></body>"
    history = f"<body><article><h1>{texts[0]}</h1><div class=social-history>{texts[1]}</div><p>{texts[2]}</p></article></body>"
    sidebar = f"<body><div class=sidebar>{paragraphs(texts)}</div><div class=ad-box>{some(rng, 4)}</div></body>"
    form = f"<body><form action=/><div>{paragraphs(texts)}</div></form></body>"
    for page, want in ((social, texts), (history, texts[:3]), (sidebar, texts), (form, texts)):
        assert H.main_text(page, None) == H.main_text(page, known([page] * 4)) == "\n".join(want)
    names = {"ad": 1, "ad-box": 1, "site-footer": 1, "post-comments": 1, "social-history": 0, "article-header": 0, "has-comments": 0, "nav2": 1, "reading-list": 0}
    assert {n: int(H._marked([n])) for n in names} == names
    assert not H._marked(["content", "social"]) and H._marked(["post", "comment"])


def test_stripped_pages_keep_their_text(spark):
    """Sample pages without classes and ids, their articles plain divs: the wrapper finds the same text on 95 of 100."""
    import re

    pages = [(r["url"], r["html"]) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]
    bare = lambda h: re.sub(r"<(/?)(article|main)\b", r"<\1div", re.sub(r"\s(class|id)=(\"[^\"]*\"|[^\s>]+)", "", h))
    df = spark.createDataFrame([(i, u, h, bare(h)) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string, bare string")
    want = {r.page_id: r.text for r in H.extract(df).collect()}
    got = {r.page_id: r.text for r in H.extract(df.withColumn("html", F.col("bare"))).collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.95 * len(want) and all(want.values())


def test_pages_without_an_article_have_no_text():
    for page in ("", "<body><nav><a href=x>home</a></nav><footer>about us</footer></body>", "<body><script>x</script></body>"):
        assert H.main_text(page, None) == H.main_text(page, known([page] * 3)) == ""


def test_copies_are_no_template():
    # a host whose pages are copies but for a line keeps its text
    rng = random.Random(3)
    texts = article(rng)
    pages = [f"<body><article>{paragraphs(texts)}<p>copy {k}</p></article></body>" for k in range(5)]
    assert H.main_text(pages[2], known(pages)) == "\n".join([*texts, "copy 2"])


def test_deep_blocks_keep_their_roles():
    # 60 divs that are never closed, a footer in the last
    page = lambda k: "<body>" + "".join(f"<div>part {i} of {k}" for i in range(60)) + "<footer>about us</footer></body>"
    found = H.main_text(page(1), known([page(k) for k in range(3)]))
    assert found.split("\n") == [f"part {i} of 1" for i in range(60)]


def test_very_deep_pages_are_borne():
    page = "<body>" + "".join(f"<div>part {i}" for i in range(5000))
    wrapper = H.Wrapper(H.unpacked(H.packed(H._deep(H.align)(*(H._deep(H.page_wrapper)(H.blocks(page)) for _ in range(2))))))
    assert len(H.main_text(page, wrapper).split("\n")) == 5000


def test_texts_alike_at_their_beginning_vary():
    title = "Annual report of the society for the study of hours, part 0"
    page = lambda k: f"<body><h1>{title}{k}</h1><p>{'x' * k} body and more of it, page after page</p><div class=legal>Legal</div></body>"
    assert H.main_text(page(2), known([page(k) for k in range(1, 6)])) == f"{title}2\nxx body and more of it, page after page"


@pytest.mark.parametrize("width", [50, 119, 121, 200, 700])
def test_levels_of_any_width(width):
    # labels of which no two stand side by side twice, and notices that all pages share
    word = lambda i: "".join(chr(97 + int(d)) for d in f"{i:03}")
    page = lambda k: "<body><div class=legal>All rights</div>" + "".join(f"<div class={word(i)}>{i} of {k}</div>" for i in range(width)) + "<p>The end</p></body>"
    found = H.main_text(page(1), known([page(k) for k in range(4)]))
    assert found.split("\n") == [f"{i} of 1" for i in range(width)]


def test_lists_of_200_items():
    page = lambda k: "<body><p>Contents</p><ol>" + "".join(f"<li>{i} of {k}</li>" for i in range(200)) + "</ol></body>"
    wrapper = known([page(k) for k in range(4)])
    assert H.main_text(page(1), wrapper).split("\n") == [f"{i} of 1" for i in range(200)]
    assert [H.tag_of(x) for x in wrapper.items[0][H.BELOW]] == ["p", "ol"]


def test_levels_that_pages_widen_keep_their_roles():
    # each page adds three labels of its own; the notice stays ruled out however many pages there are
    word = lambda i: "".join(chr(97 + int(d)) for d in f"{i:04}")
    own = lambda k: "".join(f"<div class={word(3 * k + i)}>only {k} {i}</div>" for i in range(3))
    page = lambda k: f"<body><h1>title {k}</h1>{own(k)}<div class=legal>All rights</div></body>"
    pages = [page(k) for k in range(100)]
    for wrapper in (known(pages), known(pages[::-1]), *(known(pages[:n]) for n in range(36, 46))):
        assert H.main_text(page(7), wrapper) == "title 7\nonly 7 0\nonly 7 1\nonly 7 2"


def test_alignment_finds_groups_and_options():
    tree = lambda labels: H.fold([[x, False, False, [], 0, 0, None, 1, ()] for x in labels.split()])
    shape = lambda w: " ".join(("(" + shape(x[H.BELOW]) + ")" if x[H.LABEL] == "(" else x[H.LABEL]) + "*" * x[H.REPEATED] + "?" * x[H.OPTIONAL] for x in w)
    assert shape(tree("h1 p p p ul")) == "h1 p* ul"
    assert shape(tree("h1 h2 p h2 p h2 p")) == "h1 (h2 p)*"
    assert shape(H.align(tree("h1 p ul"), tree("h1 p p"))) == "h1 p* ul?"
    assert shape(H.align(tree("h1 h2 p h2 p"), tree("h1 h2 p x"))) == "h1 (h2 p)* x?"
    assert shape(H.align(tree("a b c d"), tree("x b y d"))) == "a? x? b c? y? d"


def test_pairs_match_as_many_as_brute_force_on_distinct_labels():
    rng = random.Random(2)
    for _ in range(200):
        a, b = rng.sample(range(12), 8), rng.sample(range(12), 8)
        best = [[0] * 9 for _ in range(9)]
        for i in range(8):
            for j in range(8):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        got = list(H._pairs([str(x) for x in a], [str(x) for x in b]))
        assert all(a[p] == b[q] for p, q in got) and all(x < y for u, v in zip(got, got[1:]) for x, y in zip(u, v))
        assert len(got) == best[8][8]


def test_elements_whose_content_is_shown():
    page = "<body><article><p>a <math><mi>x</mi></math> b</p><object><p>shown</p></object><svg><text>not</text></svg></article></body>"
    assert H.main_text(page, None) == "a x b\nshown"
