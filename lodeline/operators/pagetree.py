"""Pages as trees: elements and texts in their order, so that containers are ranges and parsers are expressions.

Elements are numbered as they open. Those that an element holds follow it
without a gap, and so do its texts among all texts; the tree has where both end,
and what an element holds is a slice. A page's tree is one struct of arrays, made
in Arrow batches; all that is asked of it is done by column functions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lodeline.functions.text import any_in, clipped, let, strip
from lodeline.session import bounded_batches

#: Elements without content; elements that open where one of the same group is open close it, up to a limit.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": ("li", "ul ol"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
CLOSES |= {block: ("p", "table td th caption") for block in "p ul ol dl div table section article aside main nav header footer form pre blockquote hr h1 h2 h3 h4 h5 h6".split()}
#: Elements whose text doesn't show.
DROPPED = ("script", "style", "nav", "header", "footer")

#: ``last`` is the number of the last element that an element holds, its own if it holds none; of the texts it holds those from ``head`` to before ``tail``.
TREE = "tag array<string>, cls array<string>, id array<string>, last array<int>, head array<int>, tail array<int>, text array<string>"


class _Builder(HTMLParser):
    def __init__(self, dropped: Sequence[str]):
        super().__init__(convert_charrefs=True)
        self.dropped, self.hidden = frozenset(dropped), 0
        self.tag, self.cls, self.id, self.last, self.head, self.tail, self.text = [], [], [], [], [], [], []
        self.stack: list[int] = []

    def _pop(self) -> None:
        i = self.stack.pop()
        self.last[i], self.tail[i] = len(self.tag) - 1, len(self.text)
        self.hidden -= self.tag[i] in self.dropped

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES:
            same, limit = (set(x.split()) for x in CLOSES[tag])
            for k in range(len(self.stack) - 1, -1, -1):
                name = self.tag[self.stack[k]]
                if name in limit:
                    break
                if name in same:
                    while len(self.stack) > k:
                        self._pop()
                    break
        held = dict(attrs)
        self.tag.append(tag)
        self.cls.append(" ".join((held.get("class") or "").split()))
        self.id.append(held.get("id") or "")
        self.last.append(len(self.tag) - 1)
        self.head.append(len(self.text))
        self.tail.append(len(self.text))
        if tag not in VOID:
            self.stack.append(len(self.tag) - 1)
            self.hidden += tag in self.dropped

    def handle_endtag(self, tag: str) -> None:
        if any(self.tag[i] == tag for i in self.stack):
            while self.tag[self.stack[-1]] != tag:
                self._pop()
            self._pop()

    def handle_data(self, data: str) -> None:
        if (bare := data.strip()) and not self.hidden:
            self.text.append(bare)

    def row(self, page: str | None) -> tuple:
        self.feed(page or "")
        self.close()
        while self.stack:
            self._pop()
        return self.tag, self.cls, self.id, self.last, self.head, self.tail, self.text


def with_tree(pages: DataFrame, html: str, as_: str = "tree", dropped: Sequence[str] = DROPPED) -> DataFrame:
    """``pages`` with the tree of a column, without the texts of some elements; a null or empty page has an empty tree."""
    bounded_batches(pages.sparkSession)
    names, hidden = [p.split(" ")[0] for p in TREE.split(", ")], tuple(dropped)

    @F.pandas_udf(TREE)
    def parse(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_Builder(hidden).row(v) for v in values], columns=names)

    return pages.withColumn(as_, parse(F.col(html)))


def _simple(tree: Column, part: str) -> Callable[[Column], Column]:
    """Whether element i fits a tag, a class, an id, or a tag with these."""
    tag = re.match(r"[\w-]*", part)[0]
    classes, ids = re.findall(r"\.([\w-]+)", part), re.findall(r"#([\w-]+)", part)

    def fits(i: Column) -> Column:
        ok = F.get(tree["tag"], i) == tag.lower() if tag else F.lit(True)
        for c in classes:
            ok = ok & F.contains(F.concat(F.lit(" "), F.get(tree["cls"], i), F.lit(" ")), F.lit(f" {c} "))
        for c in ids:
            ok = ok & (F.get(tree["id"], i) == c)
        return ok

    return fits


def holds(tree: Column, i: Column, j: Column) -> Column:
    """Whether element i holds element j, another one."""
    return (i < j) & (j <= F.get(tree["last"], i))


def select(tree: Column, selector: str, inside: Column | None = None) -> Column:
    """The numbers of the elements, in order, that fit a selector: tags, classes and ids, after one another for descent, between commas for alternatives."""
    span = lambda low, high: F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    every = span(F.lit(0), F.size(tree["tag"]) - 1) if inside is None else let(inside, lambda i: span(i + 1, F.get(tree["last"], i)))

    def chain(parts: list[str], pool: Column) -> Column:
        found = F.filter(pool, _simple(tree, parts[-1]))
        if len(parts) == 1:
            return found
        return let(chain(parts[:-1], pool), lambda above: F.filter(found, lambda j: F.exists(above, lambda i: holds(tree, i, j))))

    return let(every, lambda pool: F.array_sort(F.array_distinct(F.concat(*[chain(alternative.split(), pool) for alternative in selector.split(",")]))))


def first(tree: Column, selector: str, inside: Column | None = None) -> Column:
    """The number of the first element that fits, null without one."""
    return F.get(select(tree, selector, inside), F.lit(0))


def text(tree: Column, i: Column, separator: str = " ") -> Column:
    """The stripped texts in element i, joined; null if i is null."""

    def held(i: Column) -> Column:
        low = F.get(tree["head"], i)
        return F.when(i.isNotNull(), F.array_join(F.slice(tree["text"], low + 1, F.get(tree["tail"], i) - low), separator))

    return let(i, held)


def whole_text(tree: Column, separator: str = " ") -> Column:
    """All texts of the page, joined."""
    return F.array_join(tree["text"], separator)


#: Containers of a page's content, in the order in which they are tried.
CONTENT = (".con_wrap", ".content_wrap", ".sub_content", ".board_viewDetail", ".view_content", "main", "#content", "#sub_content", ".inner_wrap")
ROUTES = (".con_wrap", ".content_wrap", ".sub_content", "main", "#content")


def content_text(tree: Column, selectors: Sequence[str] = CONTENT, least: int = 100) -> Column:
    """The text of the first of some containers that is longer than ``least`` characters, else the page's."""
    found = [let(text(tree, first(tree, s)), lambda t: F.when(F.length(t) > least, t)) for s in selectors]
    return F.coalesce(*found, whole_text(tree))


def route_page(tree: Column, clean: Callable[[Column], Column], keywords: Sequence[str], selectors: Sequence[str] = ROUTES, longer: int = 150, least: int = 80, most: int = 4000) -> Column:
    """The cleaned content of a page of routes, cut to ``most`` characters; null if it is shorter than ``least`` or holds no keyword."""
    content = clean(content_text(tree, selectors, longer))
    return let(content, lambda c: F.when((F.length(c) >= least) & any_in(c, keywords), F.substring(c, 1, most)))


def post_page(tree: Column, title: str = ".board_viewTit", body: str = ".board_viewDetail", files: str = ".board_viewFile a, .file_list a, .attach a", most: int = 5, cut: int = 2000) -> Column:
    """A post as text: its title and the first ``most`` names of its files marked, the body between, cut to ``cut`` characters."""
    named = F.filter(F.transform(select(tree, files), lambda i: text(tree, i, "")), lambda t: t != "")
    some = lambda mark, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(mark), value))
    parts = F.concat_ws("\n", some("[제목] ", text(tree, first(tree, title), "")), some("", text(tree, first(tree, body), "\n")), let(named, lambda held: F.when(F.size(held) > 0, F.concat(F.lit("[첨부파일] "), F.array_join(F.slice(held, 1, most), ", ")))))
    tidy = F.regexp_replace(F.regexp_replace(parts, "[ \\t]+", " "), "\\n{3,}", "\n\n")
    return let(tidy, lambda t: strip(clipped(t, cut)))


def calendar(tree: Column, keywords: Sequence[str], year: str = ".calen_year", box: str = ".calen_box", month: str = ".fl_month strong", day: str = "strong", event: str = "span.list") -> Column:
    """A calendar as lines: the year, each month, and its days with their events; null if it has none or no keyword.

    The month that stands over a day is that of the box that holds both.
    """

    def lines(b: Column) -> Column:
        head = let(text(tree, first(tree, month, b), ""), lambda label: F.when(F.coalesce(label, F.lit("")) != "", F.array(F.concat(F.lit("\n▶ "), label))).otherwise(F.array().cast("array<string>")))
        entry = lambda li: F.concat(F.lit("  "), text(tree, first(tree, day, li), ""), F.lit(": "), text(tree, first(tree, event, li), ""))
        return F.concat(head, F.filter(F.transform(select(tree, "li", b), entry), lambda e: e.isNotNull()))

    number = F.regexp_extract(F.coalesce(text(tree, first(tree, year), ""), F.lit("")), r"([0-9]{4})", 1)
    top = F.when(number != "", F.array(F.concat(F.lit("[ "), number, F.lit(" 학년도 학사일정 ]")))).otherwise(F.array().cast("array<string>"))
    whole = F.regexp_replace(F.array_join(F.concat(top, F.flatten(F.transform(select(tree, box), lines))), "\n"), r"(?U)^\s+|\s+$", "")
    return let(whole, lambda w: F.when((w != "") & any_in(w, keywords), w))
