"""Trees of pages: implied ends, selectors, ranges of texts, and the parsers on pages as they are found."""

import time

from pyspark.sql import functions as F

from lodeline.functions.text import collapse
from lodeline.operators import crawl, pagetree
from lodeline.sources import documents as sources


def asked(spark, page, *columns):
    rows = pagetree.with_tree(spark.createDataFrame([(page,)], "h string"), "h")
    return list(rows.select(*[c(F.col("tree")).alias(f"c{i}") for i, c in enumerate(columns)]).first())


def texts(selector, separator=" "):
    return lambda tree: F.transform(pagetree.select(tree, selector), lambda i: pagetree.text(tree, i, separator))


PAGE = """<!doctype html><title>T &amp; U</title><nav>menu</nav><div id=top class=" a  b "><p>one<p class=x>two <b>bold</b><ul><li>l1<li>l2<ul><li>deep</ul><li>l3</ul>
<img src=x class=x><table><tr><td>c1<td>c2<tr><th>h<td class="x y">c3</table><script>if (a < b) { "</div>" }</script></div><div class=b>tail</i></div><p>open"""


def test_selectors_and_implied_ends(spark):
    found = asked(
        spark, PAGE, texts("p"), texts("li"), texts("td, th"), texts("div.b"), texts(".a .x"), texts("#top td.x"), texts("div.a li li"), texts(".xy"), texts("title", ""), lambda t: pagetree.whole_text(t, "|")
    )
    assert found[0] == ["one", "two bold", "open"]
    assert found[1] == ["l1", "l2 deep", "deep", "l3"] and found[2] == ["c1", "c2", "h", "c3"]
    assert found[3][-1] == "tail" and found[3][0].startswith("one") and found[3][0].endswith("c3")
    assert found[4][-1] == "c3" and found[5] == ["c3"] and found[6] == ["deep"] and found[7] == [] and found[8] == ["T & U"]
    assert "menu" not in found[9] and "if (a" not in found[9] and found[9].endswith("tail|open")


def test_pages_of_every_kind(spark):
    for page in (None, "", "<", "</div></p>", "<div", "<!-- x", "no tags", "<br/><br>", "<p>" * 3000 + "x", "<div>" * 3000 + "x"):
        found = asked(spark, page, lambda t: pagetree.whole_text(t), lambda t: F.size(t["tag"]), texts("p"), lambda t: pagetree.text(t, pagetree.first(t, "table")))
        assert found[3] is None and (page != "no tags" or found[0] == "no tags")
    assert found[0] == "x" and found[1] == 3000


POST = """<div class="board_viewTit"> 공지 <b>제목</b></div><div class="board_viewDetail"><p>첫째  줄</p><p>둘째<br>줄</p></div><div class="board_viewFile">%s</div>"""


def test_posts(spark):
    files = "".join(f"<a href=x>f{i}.hwp</a><a></a>" for i in range(7))
    cut = lambda t: pagetree.post_page(t, cut=12)
    assert asked(spark, POST % files, pagetree.post_page, cut) == ["[제목] 공지제목\n첫째 줄\n둘째\n줄\n[첨부파일] f0.hwp, f1.hwp, f2.hwp, f3.hwp, f4.hwp", "[제목] 공지제목\n첫째..."]
    assert asked(spark, POST % "", pagetree.post_page) == ["[제목] 공지제목\n첫째 줄\n둘째\n줄"]
    assert asked(spark, "<p>nothing of a post</p>", pagetree.post_page) == [""]


CALENDAR = """<div class="calen_year"><span>2026</span>년도</div><div class="calen_box"><div class="fl_month"><strong>3월</strong><span>MAR</span></div><ul><li><strong>02(월)</strong><span class="list">개강</span></li><li><strong>x</strong></li></ul></div>
<div class="calen_box"><ul><li><strong>05(목) ~ 09(월)</strong> <span class="list">수강신청 <b>정정</b></span></ul></div>"""


def test_calendars(spark):
    read = lambda words: lambda t: pagetree.calendar(t, words)
    expected = "[ 2026 학년도 학사일정 ]\n\n▶ 3월\n  02(월): 개강\n  05(목) ~ 09(월): 수강신청정정"
    assert asked(spark, CALENDAR, read(["수강신청"]), read(["졸업"])) == [expected, None]
    assert asked(spark, "<div class=calen_box></div>", read(["수강신청"])) == [None]


def test_a_year_of_days_is_read_in_proportion_to_them(spark):
    box = "<div class=calen_box><div class=fl_month><strong>{0}월</strong></div><ul>{1}</ul></div>"
    made = "<div class=calen_year>2026</div>" + "".join(box.format(m, "".join(f"<li><strong>{d}일</strong><span class=list>수강신청 {m * d}</span>" for d in range(1, 32))) for m in range(1, 13))
    start = time.monotonic()
    (found,) = asked(spark, made, lambda t: pagetree.calendar(t, ["수강신청"]))
    # every text of the page was looked at for every element of a day: minutes
    assert time.monotonic() - start < 60
    lines = ["[ 2026 학년도 학사일정 ]"] + [line for m in range(1, 13) for line in (f"\n▶ {m}월", *(f"  {d}일: 수강신청 {m * d}" for d in range(1, 32)))]
    assert found == "\n".join(lines)


def test_an_element_does_not_hold_the_one_that_closes_it(spark):
    size = lambda selector: lambda t: F.size(pagetree.select(t, selector))
    assert asked(spark, "<div><p>a<hr>b<p>c<i>d</i></div>e", size("p hr"), size("div hr"), size("p i"), size("div p"), texts("p"), texts("div")) == [0, 1, 1, 2, ["a", "c d"], ["a b c d"]]


def test_routes_and_contents(spark):
    long = "셔틀 노선 " * 40
    page = f"<header>h</header><div class=con_wrap>{long[:100]}</div><div id=content>{long}</div>"
    route = lambda t: pagetree.route_page(t, collapse, ["셔틀"])
    assert asked(spark, page, route, lambda t: pagetree.content_text(t)) == [long.strip(), long.strip()]
    assert asked(spark, "<p>셔틀</p>", route) == [None] and asked(spark, f"<p>{'x' * 200}</p>", route) == [None]
    assert len(asked(spark, f"<main>{'셔틀 ' * 3000}</main>", route)[0]) == 4000


def test_labelled_questions(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"question": " 학식? ", "label": 3}, {"question": "x", "label": "1"}, {"question": "", "label": 1}, {"question": "y", "label": "meal"}, {"question": "z"}, {"label": 2}]')
    assert sorted(map(tuple, sources.labelled(spark, str(tmp_path), range(5)).collect())) == [("x", 1), ("학식?", 3)]


def test_seeds_beyond_the_limit_are_cut_in_order(spark):
    seeds = spark.createDataFrame([(f"u{i}",) for i in range(9)], "url string").repartition(4)
    edges = spark.createDataFrame([("u0", "v")], "url string, link string")
    assert [r.url for r in crawl.walk(edges, seeds, 2, limit=3).orderBy("url").collect()] == ["u0", "u1", "u2"]
