from __future__ import annotations

import re
from html import unescape

import pytest

from repseq.llm import html as H

LONG = "This sentence is long enough that a window of lines with it makes a surge all by itself. "


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""),
        ("", ""),
        ("plain text", "plain text"),
        ("<p>a &lt; b &amp c</p>", "a < b & c"),
        ("<p>one<br>two\n  three</p>", "one two three"),
        ("<title>t</title><style>p{}</style><script>var t='</p>'</script><article><h1>H</h1><p>x</article><footer>f</footer>", "H\nx"),
        ("<nav><a href='/'>menu</a></nav><article><p>text</p><div class='comment'>no<div>deep</div></div><p>more</p></article>", "text\nmore"),
        ("<article><p>cut off &am", "cut off &am"),
        ("<article><p>cut off</p><p cla", "cut off"),
        ("<article><p>x<!-- never closed <p>y", "x"),
        ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
        ("<main><form><p>mail</p></form><aside>side</aside><p>kept</main>", "kept"),
        ("<article></article>", ""),
    ],
)
def test_extract(page, want):
    assert H.extract(page) == want


def test_surge_and_dive_without_an_article():
    links = "".join(f"<li><a href='/{i}'>link number {i}</a></li>" for i in range(9))
    page = f"<ul>{links}</ul><div><p>{LONG}</p><p>{LONG * 3}</p></div><div class='cookie-notice'>We use cookies. {LONG}</div><ul>{links}</ul>"
    assert H.extract(page).split("\n")[-2:] == [LONG.strip(), (LONG * 3).strip()]
    assert "link number 8" not in H.extract(page).split("\n")[-1]


def test_regions():
    assert H.regions([0, 0, 50, 60, 0, 0, 0, 5, 0], 86) == [(0, 4)]
    assert H.regions([], 0) == [] and H.regions([0, 0], 0) == []


def test_edge_rows(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "<article>" + "<p>word</p>" * 50_000, "x"), (3, "u", "<article><p>a</article>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = H.extract_text(df).collect()
    assert sorted(len(r.text) for r in out) == [0, 0, 1, 50_000 * 5 - 1]
    assert H.extract_text(df.limit(0)).count() == 0


def test_query_against_the_articles(spark, small):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in H.op6_html(spark, small).collect():
        inside = re.sub(r"<[^<>]*$", "", pages[r.page_id].partition("<article>")[2].partition("</article>")[0])
        blocks = (" ".join(unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


ITEMS = "".join(f"<li><a href='/{i}'>item {i}</a></li>" for i in range(5))
SHARE = "<div class='share'>share this</div>"


@pytest.mark.parametrize(
    "page,want",
    [
        ("<article><p>text</p><p><a href='/x'>only a link</a></p></article>", "text\nonly a link"),
        (f"<article><p>text</p><ul>{ITEMS}</ul></article>", "text\nitem 0\nitem 1\nitem 2\nitem 3\nitem 4"),
        (f"<p><a name='top'>start</p><p>{LONG}</p><p>end</p>", f"start\n{LONG.strip()}\nend"),
        (f"<p><a href='/x'>start</p><p>{LONG}</p><p>end</p>", f"start\n{LONG.strip()}\nend"),
        (f"<h1>Heading</h1>{SHARE}<p>{LONG * 9}</p>{SHARE}<p>the tail</p>", f"Heading\n{(LONG * 9).strip()}\nthe tail"),
        (f"<p>{LONG * 9}</p><ul>{ITEMS}</ul><p>{LONG}</p>", f"{(LONG * 9).strip()}\nitem 3\nitem 4\n{LONG.strip()}"),
    ],
)
def test_no_text_is_dropped(page, want):
    assert H.extract(page) == want


P = "".join(f"<p>{'word ' * 30}{i}</p>" for i in range(3))
TEXT = "\n".join(f"{'word ' * 30}{i}" for i in range(3))


@pytest.mark.parametrize(
    "page,want",
    [
        (f'<body><nav><a href="/">Home</a></nav><div id="page" class="has-sidebar">{P}</div></body>', TEXT),
        (f'<body><div class="search">{P}</div><footer>Imprint</footer></body>', TEXT),
        (f'<body><article class="post search">{P}</article></body>', TEXT),
        (f'<body><nav><a href="/">Home</a><article>{P}</article></body>', TEXT),
        (f'<body><article>{P}<h2 id="comments">Comments on the law</h2><p>more of it</p></article></body>', f"{TEXT}\nComments on the law\nmore of it"),
        (f'<body><article>{P}' + "".join(f'<p><a href="/{i}">part {i}</a></p>' for i in range(4)) + "</article></body>", TEXT + "".join(f"\npart {i}" for i in range(4))),
        (f'<body><form id="f">{P}</form></body>', TEXT),
        (f'<body><article>{P}</article><section class="comments"><article><p>{"I say " * 40}</p></article></section></body>', None),
        (f'<body><div class="story">{P}</div><div class="comments"><p>{"I say " * 40}</p></div></body>', TEXT),
        (f'<body><article>{P}<div class="comments"><p>{"I say " * 90}</p></div></article></body>', TEXT),
        (f"<body><article>{P}<p>first<p>second<ul><li>a<li>b</ul></article></body>", f"{TEXT}\nfirst\nsecond\na\nb"),
    ],
)
def test_hints_do_not_drop_the_article(page, want):
    """Names that wrap the page, unclosed boilerplate, headings with marked ids, and blocks of links."""
    if want is not None:
        assert H.extract(page) == want


def test_very_long_page_without_tags():
    text = "word " * 200_000
    assert H.extract(text) == text.strip()


def test_without_article_tags(spark, small):
    """Where only the distribution tells (article and main renamed to div), the text agrees with the article's."""
    pages = [r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect() if r.html]
    import re as _re

    plain = [_re.sub(r"(?i)(</?)(article|main)\b", r"\1div", h) for h in pages]
    agree = sum(H.extract(a) == H.extract(b) for a, b in zip(pages, plain, strict=True)) / len(pages)
    assert agree > 0.95


def test_by_text_density_alone(spark, small):
    """Without the article's tags and without any class, id or role, lines still mostly are the article's."""
    recall, precise = [], []
    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        bare = re.sub(r'\s(?:class|id|role)="[^"]*"', "", re.sub(r"(?i)(</?)(article|main)\b", r"\1div", r.html or ""))
        want, got = set(H.extract(r.html).split("\n")), set(H.extract(bare).split("\n"))
        recall.append(len(want & got) / len(want))
        precise.append(sum(map(len, want & got)) / max(1, sum(map(len, got))))
    assert sum(recall) / len(recall) > 0.85 and sum(precise) / len(precise) > 0.85
