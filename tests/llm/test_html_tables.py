"""Tables whose tags are left out or misplaced lose no text; layout and cost of whole pages."""

import re
import time
from html.parser import HTMLParser

import pytest

from lodeline.llm import html_text
from lodeline.llm.html_text import extract
from lodeline.llm.queries import op2_html_text


@pytest.mark.parametrize(
    ("page", "lines"),
    [
        ("<table><colgroup><col><col><tr><td>x<td>y</table>", ["x  y"]),
        ("<table><colgroup><col><tbody><tr><td>x</td></tr></tbody></table>", ["x"]),
        ("<table><colgroup> <col> <thead><tr><th>h</thead><tr><td>x</table>", ["h", "x"]),
        ("<table><caption>c<colgroup><col><tr><td>x</table>", ["c", "x"]),
        ("<table><colgroup>stray<tr><td>x</table>", ["stray", "x"]),
        ("<table><tbody><td>a<td>b<tr><td>c</table>", ["a  b", "c"]),
        ("<table><thead><th>a<th>b<tbody><td>c</table>", ["a  b", "c"]),
        ("<table><td>a<td>b</table>", ["a  b"]),
        ("<table><tr>one<td>x</td></tr></table>", ["one", "x"]),
        ("<table><tbody>two <b>bold</b><tr><td>x</table>", ["two bold", "x"]),
        ("<table><tr><td>x</td><div>three</div></tr><tfoot>four</tfoot></table>", ["three", "four", "x"]),
        ("<table><tr hidden>no<td>no</td></tr><tbody style='display:none'>no</tbody><tr><td>x</table>", ["x"]),
    ],
)
def test_all_visible_text_of_a_table(page, lines):
    assert extract(page).split("\n") == lines


class Plain(HTMLParser):
    """Visible words in order, and of each table its rows of cell texts, read with the standard library."""

    UNSEEN = {"head", "script", "style", "template", "noscript", "iframe", "object", "audio", "video", "canvas", "math", "title"}
    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.words, self.rows, self.items = [], [], [], []

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            return
        held = dict(attrs)
        hidden = tag in self.UNSEEN or "hidden" in held or "none" in (held.get("style") or "") or "hidden" in (held.get("style") or "")
        self.stack.append((tag, hidden))
        if not any(h for _, h in self.stack):
            if tag == "tr":
                self.rows.append([])
            elif tag in ("td", "th") and self.rows:
                self.rows[-1].append([])
            elif tag == "li":
                self.items.append([])

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break

    def handle_data(self, data):
        if any(h for _, h in self.stack):
            return
        self.words += data.split()
        tags = [t for t, _ in self.stack]
        if self.rows and self.rows[-1] and ("td" in tags or "th" in tags):
            self.rows[-1][-1] += data.split()
        if self.items and "li" in tags:
            self.items[-1] += data.split()


def test_layout_of_the_whole_table(spark, sf_dir):
    """Words in order, each list item behind its mark on a line, and each row's cells on one line in aligned columns."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    found = {r.page_id: r for r in op2_html_text(spark, sf_dir).collect()}
    assert set(found) == set(pages)
    rows = items = 0
    for i, source in pages.items():
        plain = Plain()
        plain.feed(source or "")
        text = found[i].text or ""
        lines = text.split("\n")
        assert found[i].n_lines == (len(lines) if text else 0)
        marks = lambda ws: [w for w in ws if w != "*" and not re.fullmatch(r"\d+\.", w)]
        assert marks(text.split()) == marks(plain.words)
        for row in plain.rows:
            cells = [" ".join(c) for c in row if c]
            if len(cells) > 1:
                rows += 1
                assert any(all(c in line for c in cells) and [line.index(c) for c in cells] == sorted(line.index(c) for c in cells) for line in lines), cells
        for words in plain.items:
            if words:
                items += 1
                assert any(re.match(r"\s*(\*|\d+\.) ", line) and " ".join(words) in line for line in lines), words
    assert items > 0 or rows > 0


def test_columns_align():
    text = html_text.extract("<table><tr><th>a</th><th>long head</th><th>c</th></tr><tr><td>wide cell</td><td>x</td><td>y</td></tr><tr><td>z</td><td colspan=2>both</td></tr></table>")
    assert text.split("\n") == ["a          long head  c", "wide cell  x          y", "z          both"]


@pytest.mark.parametrize("part", ["<div>", "<ul><li>", "<span>a</span> ", "<p>a", "<b>", "<li>", "<td>", "</p>", "<table><tr><td>x</table>"])
def test_deep_and_long_pages_take_linear_time(part):
    def took(n):
        start = time.process_time()
        html_text.extract(part * n + "end")
        return time.process_time() - start

    took(100)
    assert took(40_000) < 12 * max(took(10_000), 0.05)


def test_nothing_is_lost_in_depth():
    for tag in ("div", "ul", "li", "table><tr><td", "blockquote", "b"):
        assert html_text.extract(f"<{tag}>" * 3000 + "deep word").split()[-2:] == ["deep", "word"]


def test_rows_that_repeat_and_empty_tables(spark):
    rows = [(1, "<p>a"), (1, "<p>a"), (None, "<p>a"), (2, None), (3, ""), (4, "<p>w " * 200_000)]
    pages = spark.createDataFrame([(i, h, "clash") for i, h in rows], "page_id long, html string, text string")
    found = sorted((r.page_id or 0, (r.text or "-")[:1], r.n_lines) for r in html_text.extracted(pages).collect())
    assert found == [(0, "a", 1), (1, "a", 1), (1, "a", 1), (2, "-", 0), (3, "-", 0), (4, "w", 399_999)]
    assert html_text.extracted(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # an attribute's value ends where HTML ends it
        ("<p title=it's>Hello</p> <p>we don't</p><p>end</p>", "Hello\n\nwe don't\n\nend"),
        ('<p class="a"">Lost text</p>', "Lost text"),
        ("<p a=\"1\"b='2'c=3 d>t</p>", "t"),
        ("<a href=/x/y/>z</a><b x=>y</b><i =a>w</i>", "zyw"),
        ('<p a="x>y</p>', ""),
        # rows and lines
        ("<table><tr><td>a<td rowspan=2>b<tr><td>c<tr><td>d<td>e</table>", "a  b\nc\nd  e"),
        ("<pre>\na\n\nb\n\n\nc</pre>", "a\n\nb\n\n\nc"),
        ("<p>x<pre>one\r\n\r\n  two</pre>y", "x\n\none\n\n  two\n\ny"),
        ("<ol reversed><li>a<li>b</ol>", "2. a\n1. b"),
        ("<ol start=5><li>a<li value=9>b<li>c</ol>", "5. a\n9. b\n10. c"),
        ("<ol start=-1><li>a<li>b</ol>", "-1. a\n0. b"),
        # what shows and what doesn't
        ("<span aria-hidden=true>seen</span>", "seen"),
        ("<textarea>\nq  r</textarea>", "q  r"),
        ("<select><option>a<option selected>b</select> c", "b c"),
        ("<select><option>a<option>b</select>", "a"),
        ("<select multiple><option>a<option>b</select>", "a b"),
        ("<svg><title>t</title><text>in</text><path/></svg>", "in"),
        ("<p style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</p>", "yes"),
        ("<style>.ad, p#x {display:none} /* .m {display:none} */ @media print {.m{display:none}}</style><p class='ad b'>no</p><p id=x>no</p><p class=m>m</p><div id=x>d</div>", "m\n\nd"),
        ("<details><summary>s</summary>body</details><details open><summary>s2</summary>body2</details>", "s\ns2\nbody2"),
    ],
)
def test_quotes_lines_and_visibility(page, text):
    assert extract(page) == text


@pytest.mark.parametrize("part", ["<p a", "<p a=b'", "<p a=' ", '<p "', "<p a=b c ", "<style>a{"])
def test_broken_tags_take_linear_time(part):
    def took(n):
        start = time.process_time()
        html_text.extract(part * n)
        return time.process_time() - start

    took(100)
    assert took(40_000) < 12 * max(took(10_000), 0.05)
