from __future__ import annotations

import random
import time
from collections import Counter
from html.parser import HTMLParser

import pytest

from logloom.llm.rendering import VOID, render, rendered

CASES = {
    "<title>t</title><p>a  b\n c<p>d": "a b c\n\nd",
    "a<br>b<br><br>c": "a\nb\n\nc",
    "<h1>T</h1>x<div>y</div><div>z</div>": "T\n\nx\ny\nz",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e": "- a\n- b\n  - c\n- d\n\ne",
    "<ol start=9><li>a<li>b<li value=3>c</ol>": "9. a\n10. b\n3. c",
    "<table><tr><th>Name<th>n<tr><td>ab<td>1<tr><td>c<td>22</table>": "Name  n\nab    1\nc     22",
    "<table><td>a<td>b<tr><td colspan=2>wide cell<td>x</table>": "a  b\nwide cell  x",
    "<table><tr><td rowspan=2>a<td>b<tr><td>c</table>": "a  b\n   c",
    "<table><tr><td>a<br>b<td>c</table>": "a  c\nb",
    "<table>lost<tr><td>in</table>": "lost\n\nin",
    "<table><caption>Cap</caption><tr><td>a</table>": "Cap\na",
    "<table><tr><td>漢字<td>x<tr><td>abcd<td>y</table>": "漢字  x\nabcd  y",
    "<table><tr><td>o<td><table><tr><td>1<td>2<tr><td>3<td>4</table></table>": "o  1  2\n   3  4",
    "<b><p>one</b> two</p>three": "one two\n\nthree",
    "<p><b>a<br><p>c</b>": "a\n\nc",
    "<pre>\n a\n   b </pre>c": " a\n   b\n\nc",
    "x<script>a</p></script>y<style>p{}</style><!-- c > --><template>t</template>z": "xyz",
    "<p hidden>a</p><p style='color:red; display : NONE'>b</p><p style='visibility:hidden'>c</p>d": "d",
    "a<div style='visibility:hidden'>b<span style='visibility: visible'>c<i>d</i></span>e<hr><input value=f></div>g": "a\ncd\ng",
    "<ul><li>a<li style='visibility:collapse'>b</ul>": "- a",
    "x <math><mi>a</mi><mo>=</mo><mn>2</mn><annotation encoding=t>a=2</annotation></math> y": "x a=2 y",
    "<svg><title>t</title><desc>d</desc><defs><text>n</text></defs><text x=1>label</text><path d='M0'/></svg> y": "label y",
    "<input type=date value=2024-01-02><input type=new value=v><input type=checkbox value=on><input type=PASSWORD value=s>": "2024-01-02 v",
    "<details><summary>s</summary>not</details><details open><summary>t</summary>yes</details>": "s\nt\nyes",
    "&lt;b&gt; &amp;amp; &nbsp;&eacute;": "<b> &amp;  é",
    "<dl><dt>t<dd>d<dt>u<dd>v</dl>": "t\n    d\nu\n    v",
    "<blockquote>a<p>b</blockquote>c": "> a\n\n> b\n\nc",
    "<select><option>a<option>b</select>": "a\nb",
    "<textarea>a\n b</textarea>": "a\n b",
    "1 < 2 <3 a<b": "1 < 2 <3 a",
    "<p title='a>b' x=it's>k</p>": "k",
    "<head><meta x>seen": "seen",
    "<head><title>t</title><p>seen": "seen",
    "a</p>b</div>c": "a\n\nbc",
    "<a href=x>a</a><a href=y>b</a> <i> c </i>d": "ab c d",
    "": "", " \n ": "", "<!-- open": "", "<script>open": "", "<p": "", "x<p a='": "x",
}


@pytest.mark.parametrize("page", CASES)
def test_pages(page):
    assert render(page) == CASES[page]


class Words(HTMLParser):
    """The words of pages that are well formed and have no hidden parts."""

    def __init__(self):
        super().__init__()
        self.parts = []

    def handle_data(self, data):
        self.parts.append(data)

    def handle_starttag(self, tag, attrs):
        if tag not in ("b", "i", "a", "span"):
            self.parts.append(" ")

    handle_endtag = lambda self, tag: self.handle_starttag(tag, [])


def page(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(["text", "p", "div", "ul", "table", "b", "span", "h2", "pre", "br", "blockquote"])
        inner = lambda: page(rng, depth + 1) if depth < 4 else "w"
        if kind == "text" or depth >= 4:
            out.append(" ".join(f"w{rng.randrange(999)}" for _ in range(rng.randint(1, 6))) + rng.choice(["", " ", "\n"]))
        elif kind == "ul":
            out.append("<ul>" + "".join(f"<li>{inner()}</li>" for _ in range(rng.randint(0, 3))) + "</ul>")
        elif kind == "table":
            out.append("<table>" + "".join(
                "<tr>" + "".join(f"<td>{inner()}</td>" for _ in range(rng.randint(0, 3))) + "</tr>" for _ in range(2)) + "</table>")
        elif kind in VOID:
            out.append(f"<{kind}>")
        elif kind in ("p", "h2"):
            out.append(f"<{kind}>w{rng.randrange(99)} <i>x</i>y</{kind}>")
        else:
            out.append(f"<{kind}>{inner()}</{kind}>")
    return "".join(out)


def test_no_visible_word_is_lost():
    rng = random.Random(6)
    for _ in range(400):
        source = page(rng)
        words = Words()
        words.feed(source)
        words.close()
        got = Counter(w for w in render(source).replace("> ", " ").split() if w not in ("-", ">"))
        assert got == Counter("".join(words.parts).split()), source


def test_deep_and_long_pages_take_linear_time():
    for source in ("<div>" * 50_000 + "x", "<b>" * 3000 + "<p>" * 3000 + "x", "<ul><li>" * 3000 + "x", "<p a='" * 20_000,
                   "<!--" * 100_000, "<table><tr><td>" * 500 + "x", "<td>" * 20_000, "<" * 200_000, "&" * 200_000,
                   "<table>" + "<tr><td colspan=1000>x" * 300, "<table><tr><td>" + "y" * 100_000 + "<tr><td>a<td>b" * 2000):
        start = time.time()
        text = render(source)
        assert time.time() - start < 20 and len(text) < 4 * len(source) + 6_000_000


def test_table_of_pages(spark):
    rows = [(1, "u", "<p>a<p>b", "x"), (1, "u", "<p>a<p>b", "x"), (2, None, None, None), (None, "u", "", "x"), (3, "u", "w " * 300_000, "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.text, r.n_chars, r.n_lines) for r in rendered(df).collect()), key=repr)
    want = [(i, t, None if t is None else len(t), None if t is None else len(t.split("\n")) if t else 0)
            for i, t in ((1, "a\n\nb"), (1, "a\n\nb"), (2, None), (None, ""), (3, ("w " * 300_000).strip()))]
    assert got == sorted(want, key=repr)
    assert rendered(spark.createDataFrame([], df.schema)).collect() == []
