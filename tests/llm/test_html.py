"""Layout-aware rendering of HTML."""

import random

import pytest

from textsieve.llm import html_layout as hl

CASES = [
    ("Hi <b>bold</b>\n there", "Hi bold there"),
    ("<p>one<p>two", "one\n\ntwo"),
    ("<div>a<div>b</div>c</div>", "a\nb\nc"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=9><li>x<li>y<li value=20>z</ol>", "9. x\n10. y\n20. z"),
    ("<h1>T</h1>x<p>y</p>", "T\n\nx\n\ny"),
    ("<table><tr><th>Name<th>No<tr><td>apple<td align=right>1</table>", "Name   No\napple   1"),
    ("<table><tr><td colspan=2>a wide cell<tr><td>b<td>c</table>", "a wide cell\nb  c"),
    ("<table><tr><td rowspan=2>r<td>s<tr><td>t</table>", "r  s\n   t"),
    ("<table><tr><td>x<br>y<td>z</table>", "x  z\ny"),
    ("<table><tr><td><table><tr><td>in</table><td>out</table>", "in  out"),
    ("<pre>\n a  b\n  c</pre>", " a  b\n  c"),
    ("x<script>var t='</p>';</script>y<style>p{}</style>", "xy"),
    ("<head><title>t</title></head><body>b", "b"),
    ("<p hidden>a</p><p style='color:red; display: none'>b</p><p style='visibility:hidden'>c</p>d", "d"),
    ("<style>.h, #i{display:none}</style><p class='k h'>a</p><p id=i>b</p><p class=hh>c</p>", "c"),
    ("<details><summary>S</summary>no</details><details open><summary>T</summary>yes</details>", "S\nT\nyes"),
    ("&lt;b&gt; &amp; &copy; &#233;&nbsp;x", "<b> & © é\xa0x"),
    ("<dl><dt>T<dd>D<dt>U<dd>E</dl>", "T\n  D\nU\n  E"),
    ("a</p>b</div></b>c", "a\n\nbc"),
    ("<table>x<tr><td>a<div>b<td>c<p>d</table>e", "x\n\na  c\nb\n   d\n\ne"),
    ("<b><p>x</b>y</p>z", "xy\n\nz"),
    ("a <!-- c --> b<!doctype html><?x y?>c", "a bc"),
    ("a < b > c <3", "a < b > c <3"),
    ("text <a href='x>y'>link</a", "text link"),
    ("<noscript>n</noscript><template>t</template><textarea>a\nb</textarea>", "a\nb"),
    ("", ""),
    ("<div></div>", ""),
]


VISIBLE = [
    ("<style>@media print { .noprint {display:none} } .x{display:none}</style><p class=noprint>a<p class=x>b", "a"),
    ("<style>@media (max-width:600px){nav{display:none} .s{display:none}}</style><nav>n</nav><p class=s>s", "n\n\ns"),
    ("<style>@media screen{.a{display:none}} @media print, all{.b{display:none}}</style><p class=a>a<p class=b>b<p>c", "c"),
    ("<style>@import 'x.css'; @supports (display:grid){p{display:none}} .q{content:'}'; display:none} .r{display:none</style><p>a<i class=q>q</i><b class=r>r</b>", "a"),
    ("<style media=print>p{display:none}</style><p>a", "a"),
    ("<p>E <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>tex</annotation></math> f", "E x=1 f"),
    ("a<svg><title>t</title><desc>d</desc><defs/><defs><text>no</text></defs><circle r=1 /><text>one</text><text>two</text></svg>b", "a\none\ntwo\nb"),
    ("<svg><title/><text>x</text></svg><p>y", "x\n\ny"),
    ("<p><a title=Bob's href=x>link</a> words that aren't here</p><p>it's", "link words that aren't here\n\nit's"),
    ("<p 'x>a</p><p y=\"b>c\" z='d>e'>f", "a\n\nf"),
    ("<p title=a=\"b>c</p><p id = 'x>y'>d\"e", "c\n\nd\"e"),
]


@pytest.mark.parametrize(("page", "want"), VISIBLE)
def test_visible_text_is_kept(page, want):
    assert hl.visible_text(page) == want


@pytest.mark.parametrize(("page", "want"), CASES)
def test_cases(page, want):
    got = hl.visible_text(page)
    assert got == want


def test_deep_nesting_and_random_markup():
    deep = "<div><ul><li>" * 5000 + "x"
    assert hl.visible_text(deep).strip().endswith("x")
    rng = random.Random(0)
    parts = ["<p>", "</p>", "<table>", "<tr>", "<td>", "</table>", "<li>", "<ul>", "</ul>", "word", " ", "<b>", "</b>", "<", ">", "&amp", "<br>", "<!--", "-->", "<pre>", "\n", "<script>", "</script>", "<a b='", "'"]
    for _ in range(2000):
        hl.visible_text("".join(rng.choice(parts) for _ in range(30)))


def test_every_visible_word_of_plain_markup_is_emitted():
    rng = random.Random(1)
    tags = ["p", "div", "li", "td", "span", "h2", "b", "blockquote", "section", "ul", "table", "tr"]
    for _ in range(300):
        words, page = [], []
        for i in range(25):
            tag = rng.choice(tags)
            page.append(f"<{tag}>" if rng.random() < 0.7 else f"</{tag}>")
            page.append(f" w{i} ")
            words.append(f"w{i}")
        assert sorted(w for w in hl.visible_text("".join(page)).split() if w.startswith("w")) == sorted(words)


def test_table_of_pages(spark):
    rows = [(1, "<p>a</p>"), (2, None), (3, ""), (3, ""), (None, "<p>" + "long " * 200_000)]
    got = sorted(((r["page_id"], r["text"]) for r in hl.extract(spark.createDataFrame(rows, "page_id long, html string")).collect()), key=repr)
    assert got == sorted([(1, "a"), (2, None), (3, ""), (3, ""), (None, ("long " * 200_000).strip())], key=repr)
    assert hl.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0
