"""Visible text that stands in places where it is easily lost."""

import random

import pytest
from pyspark.sql import functions as F

from tamga.llm import html_text

PAGES = [
    # whatever stands around rows in a row group
    ("<table><tbody><form><tr><td>text</td></tr></form></tbody></table>", "text"),
    ("<table><form><tr><td>a</td><td>b</td></tr></form></table>", "a  b"),
    ("<table><tbody><tr><form><td>a</td><td>b</td></form></tr></tbody></table>", "a  b"),
    ("<table><tbody><center><tr><td>a</td></tr></center><tr><td>b</td></tr></tbody></table>", "a\nb"),
    ("<table><tbody><a href=x>link<tr><td>a</td></tr></tbody></table>", "link\na"),
    ("<table><tbody><div>note</div><tr><td>a</td></tr></tbody></table>", "note\na"),
    ("<table><thead><div hidden>no</div><tr><td>a</td></tr></thead></table>", "a"),
    ("<table><tr><td>x<table><tbody><div><tr><td>in</td></tr></div></tbody></table></td><td>y</td></tr></table>", "x   y\n\nin"),
    ("<form><table><tr><td>a</td></tr></table>b</form>c", "a\n\nb\n\nc"),
    # drawings paint what is in text elements, and nothing else
    ("<p>a <svg><title>no</title><desc>no</desc><defs><text>no</text></defs><g>no<path d='M0'/><text x=1>b</text><text>c</text></g></svg> d", "a b c d"),
    ("<svg><text>one<tspan>two</tspan><tspan dy=1>three</tspan></text></svg>after", "onetwo three after"),
    ("<svg><rect width=1/><foreignObject><div>html</div></foreignObject></svg>z", "html\nz"),
    ("<svg><style>p{}</style><script>no</script><circle r='1'/></svg><p>z", "z"),
    ("<svg><g><path d=x><p>z</p>", "z"),
    ("<svg hidden><text>no</text></svg>z", "z"),
    # formulas
    ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math>.", "so x=2."),
    ("<math><semantics><mi>y</mi><annotation encoding='t'>no</annotation></semantics><mphantom><mi>no</mi></mphantom><mspace/><mtext>if <b>so</b></mtext></math>", "yif so"),
    # what is invisible may hold what is visible
    ("<div style='visibility:hidden'>no<p style='visibility: visible'>yes</p>no<img alt=no></div>z", "yes\n\nz"),
    ("<div style='display:none'>no<p style='visibility:visible;display:block'>no</p></div>z", "z"),
    ("<p style='display:none;display:block'>yes", "yes"),
    ("<table><tr style='visibility:collapse'><td>no</td></tr><tr><td>a</td><td style='visibility:hidden'>no</td><td>b</td></tr></table>", "a    b"),
    ("<ruby>a<rp>(</rp><rt>b</rt><rp>)</rp></ruby>", "ab"),
    ("<details><p>no</p><summary>s</summary>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
    # spans
    ("<table><tr><td rowspan=0>a</td><td>b</td></tr><tr><td>c</td></tr><tr><td>d</td></tr></table>", "a  b\n   c\n   d"),
    ("<table><tr><td colspan=100000>a</td><td>b</td></tr><tr><td>cc</td><td>d</td></tr></table>", "a      b\ncc  d"),
    # old preformatted text
    ("a<xmp>\n <b>x</b>\n  y &amp;</xmp>b", "a\n\n <b>x</b>\n  y &amp;\n\nb"),
]


@pytest.mark.parametrize("page,want", PAGES)
def test_visible(page, want):
    assert html_text.page_text(page) == want


@pytest.mark.parametrize("tag", ["table", "div", "ul", "blockquote", "table><tr><td", "table><tr><div", "ol><li", "dl><dd", "span", "details open"])
def test_any_depth(tag):
    for n in (399, 3000):
        assert html_text.page_text(f"<{tag}>" * n + "deep").split()[-1] == "deep"


INLINE, BLOCKS = ("span", "b", "a", "em", "font"), ("div", "p", "section", "blockquote", "center", "h2", "article")
HIDDEN = ("<div hidden>{}</div>", "<script>{}</script>", "<span style='display:none'>{}</span>", "<template>{}</template>", "<!-- {} -->", "<noscript>{}</noscript>")


def random_page(rnd, words, hidden, depth=0):
    """Mark-up with a new word for every visible and every hidden text."""

    def word(of):
        of.append(f"w{len(words)}x{len(hidden)}")
        return of[-1]

    parts = []
    for _ in range(rnd.randint(1, 4)):
        kind = rnd.random()
        if kind < 0.3 or depth > 5:
            parts.append(word(words) + " ")
        elif kind < 0.4:
            parts.append(rnd.choice(HIDDEN).format(word(hidden)))
        elif kind < 0.55:
            tag = rnd.choice(INLINE)
            parts.append(f"<{tag}>{word(words)}</{tag}> ")
        elif kind < 0.65:
            invisible = word(hidden)
            parts.append(f"<div style='visibility:hidden'>{invisible}<div style='visibility:visible'>{random_page(rnd, words, hidden, depth + 2)}</div></div>")
        elif kind < 0.75:
            items = [random_page(rnd, words, hidden, depth + 1) for _ in range(rnd.randint(1, 3))]
            tag = rnd.choice(("ul", "ol"))
            parts.append(f"<{tag}>{''.join('<li>' + x for x in items)}</{tag}>")
        elif kind < 0.85:
            rows = [[word(words) for _ in range(rnd.randint(1, 3))] for _ in range(rnd.randint(1, 3))]
            parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{x}" for x in row) for row in rows) + "</table>")
        else:
            tag = rnd.choice(BLOCKS)
            inner = word(words) if tag in ("p", "h2") else random_page(rnd, words, hidden, depth + 1)
            parts.append(f"<{tag}>{inner}</{tag}>")
    return "".join(parts)


def test_every_visible_text_in_order():
    """All texts that are painted appear, in order, and nothing else does."""
    rnd = random.Random(12)
    for _ in range(400):
        words, hidden = [], []
        page = random_page(rnd, words, hidden)
        found = [x for x in html_text.page_text(page).split() if x.startswith("w")]
        assert found == words, page


def test_rows_and_columns_stay(spark):
    rows = [(1, "<title>t</title>x", "mine"), (1, "<title>t</title>x", "mine"), (2, None, None), (3, "", "")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id bigint, html string, title string").withColumn("read", F.lit(5)))
    assert sorted(((r.page_id, r.text, r.title, r.read) for r in got.collect()), key=str) == [(1, "x", "t", 5), (1, "x", "t", 5), (2, None, None, 5), (3, "", None, 5)]


@pytest.mark.parametrize("n", [100, 398, 400, 450, 5000, 60000])
def test_layout_at_any_depth(n):
    """What is hidden stays hidden, tables stay aligned, lists keep their markers, however deep the page is nested."""
    deep = "<div>" * n
    assert html_text.page_text(deep + "<span hidden>secret</span><b>seen</b>") == "seen"
    assert html_text.page_text(deep + "<p style='display: none'>secret<i>secret</i></p>seen") == "seen"
    assert html_text.page_text(deep + "<script>secret</script><span style='visibility:hidden'>secret<b style='visibility:visible'>seen</b></span>") == "seen"
    table = "<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>"
    assert html_text.page_text(deep + table) == "a    bb\nccc  d"
    assert html_text.page_text(deep + "<ol><li>one<li>two<ul><li>three</ul></ol>") == "1. one\n2. two\n   - three"
    assert html_text.page_text(deep + "<pre>a\n  b</pre>" + "</div>" * n + "end") == "a\n  b\n\nend"
    inner = "<span>" * n
    assert html_text.page_text(f"<table><tr><td>{inner}<b hidden>no</b>x{'</span>' * n}</td><td>y</td></tr></table>") == "x  y"


def test_deep_quotes_and_lists():
    assert html_text.page_text("<blockquote>" * 3000 + "said") == "> " * 3000 + "said"
    assert html_text.page_text("<ul><li>" * 2000 + "x") == "- " * 2000 + "x"


def test_end_tags_in_deep_pages():
    # each end tag finds its element, and none that lies behind a barrier
    n = 50_000
    assert html_text.page_text("<p>a" + "<b>" * n + "b<div>c") == "ab\n\nc"
    assert html_text.page_text("<p>a" + "<b>" * n + "</b>" * (n + 5) + "b</p>c") == "ab\n\nc"
    assert html_text.page_text("<div><table><tr><td>" + "<i>" * n + "x</div>y</td></tr></table>z</div>") == "xy\n\nz"


def test_buttons_and_fallback():
    assert html_text.page_text("a<input type=submit value='Send it'>b") == "aSend itb"
    assert html_text.page_text("<input type=RESET value=Clear> <input type=text value=typed><input value=typed><input type=hidden value=no><input type=submit>") == "Clear"
    assert html_text.page_text("<span style='visibility:hidden'><input type=submit value=no></span>x") == "x"
    assert html_text.page_text("a <progress value=1>fallback</progress><meter>fallback</meter> b") == "a b"
