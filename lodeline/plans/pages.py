"""Queries of the page parsers, over pages that Spark makes from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodeline.functions.text import collapse
from lodeline.operators import html, kb, pagetree
from lodeline.plans.registry import query
from lodeline.session import table


def escaped(text: Column) -> Column:
    """A text as it stands in a page."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def page(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


_ID = "conv_id * 1000 + turn"
_TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(13))"


@query(
    f"""WITH t AS (SELECT {_ID} AS id, {_TRIM.format("substr(text, 1, 30)")} AS title, list_filter(list_transform(string_split(text, '. '), lambda x: {_TRIM.format("x")}), lambda x: x <> '') AS ps, turn % 8 AS n FROM conversations),
p AS (SELECT id, list_filter([CASE WHEN title <> '' THEN '[제목] ' || title END, CASE WHEN len(ps) > 0 THEN array_to_string(ps, chr(10)) END, CASE WHEN n > 0 THEN '[첨부파일] ' || array_to_string(list_transform(generate_series(1, least(n, 5)), lambda i: 'f' || i || '.pdf'), ', ') END], lambda x: x IS NOT NULL) AS parts FROM t),
j AS (SELECT id, regexp_replace(regexp_replace(array_to_string(parts, chr(10)), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS post FROM p) SELECT id, {_TRIM.format("CASE WHEN length(post) > 200 THEN substr(post, 1, 200) || '...' ELSE post END")} AS post FROM j"""
)
def post_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.array_join(F.transform(F.split("text", r"\. "), lambda x: F.concat(F.lit("<p>"), escaped(x))), "")
    files = F.array_join(F.transform(F.filter(F.array(*[F.lit(i) for i in range(1, 9)]), lambda i: i <= F.col("turn") % 8), lambda i: F.concat(F.lit("<li><a href=x>f"), i.cast("string"), F.lit(".pdf</a><a> </a>"))), "")
    made = page("<nav>menu</nav><div class='x board_viewTit'> ", escaped(F.substring("text", 1, 30)), "</div><div class=board_viewDetail><script>no()</script>", body, "</div><div class=attach><ul>", files, "</ul></div>")
    rows = pagetree.with_tree(table(spark, sf_dir, "conversations").select(F.expr(_ID).alias("id"), made.alias("h")), "h")
    return rows.select("id", pagetree.post_page(F.col("tree"), cut=200).alias("post"))


@query("""WITH d AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, count(*) AS n FROM orders GROUP BY ALL), l AS (SELECT y, m, d, '  ' || d || '일: ' || CASE WHEN y % 3 > 0 THEN '수강신청 ' ELSE '행사 ' END || n AS line FROM d UNION ALL SELECT DISTINCT y, m, 0, chr(10) || '▶ ' || m || '월' FROM d)
SELECT y AS year, CASE WHEN y % 3 > 0 THEN '[ ' || y || ' 학년도 학사일정 ]' || chr(10) || string_agg(line, chr(10) ORDER BY m, d) END AS lines FROM l GROUP BY y""")
def calendar_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("m"), F.dayofmonth("o_orderdate").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    joined = lambda order, item: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, item.alias("x")))), lambda e: e["x"]), "")
    what = F.when(F.col("year") % 3 > 0, "수강신청 ").otherwise("행사 ")
    item = page("<li><strong>", F.col("d").cast("string"), "일</strong><span class='list'>", what, F.col("n").cast("string"), "</span>")
    months = days.groupBy("year", "m").agg(joined("d", item).alias("items"))
    box = page("<div class=calen_box><div class=fl_month><strong>", F.col("m").cast("string"), "월</strong><span>x</span></div><ul>", F.col("items"), "</ul></div>")
    years = months.groupBy("year").agg(joined("m", box).alias("boxes"))
    made = pagetree.with_tree(years.select("year", page("<div class='calen_year'>", F.col("year").cast("string"), "년</div>", F.col("boxes")).alias("h")), "h")
    return made.select("year", pagetree.calendar(F.col("tree"), ["수강신청"]).alias("lines"))


_WORDS = ("with", "avec", "nicht", "que")


@query(
    f"""WITH t AS (SELECT doc_id, {_TRIM.format("substr(text, 1, doc_id::INT % 300)")} AS a, {_TRIM.format("text")} AS b FROM documents), c AS (SELECT doc_id, trim(regexp_replace(CASE WHEN length(a) > 150 THEN a WHEN length(b) > 150 THEN b ELSE array_to_string(list_filter([a, b], lambda x: x <> ''), ' ') END, '\\s+', ' ', 'g')) AS content FROM t)
SELECT doc_id, CASE WHEN length(content) >= 80 AND ({" OR ".join(f"contains(content, '{w}')" for w in _WORDS)}) THEN substr(content, 1, 4000) END AS content FROM c"""
)
def route_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = page("<header>top</header><div class='con_wrap'>", escaped(F.substr("text", F.lit(1), (F.col("doc_id") % 300).cast("int"))), "</div><main>", escaped(F.col("text")), "</main><footer>end</footer>")
    rows = pagetree.with_tree(table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", made.alias("h")), "h")
    return rows.select("doc_id", pagetree.route_page(F.col("tree"), collapse, _WORDS).alias("content"))


@query(f"""WITH p AS (SELECT conv_id, turn, {_TRIM.format("substr(text, 1, 40)")} AS title, '2026-0' || (1 + turn % 9) || '-1' || (conv_id % 10) AS date FROM conversations), g AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM p WHERE length(regexp_replace(title, '\\s+', ' ', 'g')) > 5)
SELECT conv_id, turn::VARCHAR AS no, regexp_replace(title, '\\s+', ' ', 'g') AS title, CASE WHEN turn % 3 > 0 THEN date ELSE '' END AS date, n::BIGINT AS rank FROM g WHERE n <= 5""")
def board_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn").cast("string")
    date = F.when(F.col("turn") % 3 > 0, page("2026-0", (1 + F.col("turn") % 9).cast("string"), "-1", (F.col("conv_id") % 10).cast("string"))).otherwise("-")
    link = page('<a href="?mode=V&no=', turn, '">', escaped(F.substring("text", 1, 40)), "</a>")
    # every post stands twice: the first place counts
    row = page("<tr><td>", link, "</td><td>", date, "</td></tr>")
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", row.alias("r")))), lambda x: x["r"]), "").alias("rows"))
    found = html.board_posts(rows.select("conv_id", page("<table>", F.col("rows"), F.col("rows"), "</table>").alias("h")), "conv_id", "h")
    return found.select("conv_id", "no", "title", "date", F.col("rank").cast("bigint").alias("rank"))


MEALS = ("조식", "중식", "석식")


@query(
    """WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z]+') AS ws FROM conversations), c AS (SELECT conv_id, turn, who, r, ws FROM t, (VALUES ('직원', 0), ('학생', 1)) w(who, k), (VALUES ('R1', 0), ('R2', 1)) x(r, j)),
i AS (SELECT conv_id, r AS restaurant, ['조식', '중식', '석식'][turn % 3 + 1] AS meal_type, who AS staff_student, list_filter(list_slice(ws, CASE WHEN r = 'R1' THEN 1 ELSE 3 END + CASE WHEN who = '학생' THEN 1 ELSE 0 END, CASE WHEN r = 'R1' THEN 3 ELSE 6 END), lambda w: length(w) >= 2) AS items, turn, r FROM c WHERE NOT (r = 'R2' AND turn % 2 = 0))
SELECT conv_id, turn::BIGINT AS turn, restaurant, meal_type, staff_student, array_to_string(items, '/') AS items FROM i WHERE len(items) > 0"""
)
def cafeteria_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    dishes = lambda low, high: F.array_join(F.slice(words, F.lit(low), F.lit(high - low + 1)), "<br>")
    second = lambda low: F.when(F.col("turn") % 2 == 0, "운영안함").otherwise(dishes(low, 6))
    meal = F.element_at(F.array(*map(F.lit, MEALS)), (F.col("turn") % 3 + 1).cast("int"))
    rows = page("<tr><td rowspan=2>", meal, "<td>직원<td>", dishes(1, 3), "<td>", second(3), "</tr><tr><td>학생<td>", dishes(2, 3), "<td>", second(4), "</tr>")
    held = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", rows.alias("r")))).alias("rs"))
    made = held.select("conv_id", page("<table><tr><th>구분<th>대상<th>R1<th>R2</tr>", F.array_join(F.transform("rs", lambda x: x["r"]), ""), "</table>").alias("h"), F.transform("rs", lambda x: x["turn"]).alias("turns"))
    found = html.menu_table(html.cells(made, "conv_id", "h"), "conv_id", ["R1", "R2"])
    # two rows of the table for each turn, in their order
    turn = F.get("turns", (F.floor((F.floor(F.col("ord") / 1000) - 1) / 2)).cast("int")).cast("bigint")
    return found.join(made.select("conv_id", "turns"), "conv_id").select("conv_id", turn.alias("turn"), "restaurant", "meal_type", "staff_student", F.array_join("menu_items", "/").alias("items"))


@query("""WITH t AS (SELECT conv_id, turn, list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda w: length(w) >= 3) AS ws FROM conversations), i AS (SELECT conv_id, CASE turn % 3 WHEN 0 THEN '조식' WHEN 1 THEN '중식' END AS meal_type, turn, unnest(list_slice(ws, 1, 4)) AS item, generate_subscripts(list_slice(ws, 1, 4), 1) AS k FROM t),
f AS (SELECT conv_id, meal_type, item, min(turn * 100 + k) AS pos FROM i WHERE meal_type IS NOT NULL GROUP BY ALL) SELECT conv_id, meal_type, string_agg(item, '/' ORDER BY pos) AS items FROM f GROUP BY ALL""")
def dormitory_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.slice(F.filter(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.length(w) >= 3), 1, 4)
    cell = F.array_join(F.transform(words, lambda w: page(w, " 1.5.13[x]")), "<br>")
    at = lambda n: F.when(F.col("turn") % 3 == n, cell).otherwise("")
    rows = page("<tr><td>", at(0), "<td>", at(1), "<td>", at(2), "</tr>")
    held = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", rows.alias("r")))), lambda x: x["r"]), "").alias("rs"))
    made = held.select("conv_id", page("<table><tr><th>아침 Breakfast<th>점심<th>기타</tr>", F.col("rs"), "</table>").alias("h"))
    found = html.dorm_table(html.cells(made, "conv_id", "h"), "conv_id", [("아침", "조식"), ("점심", "중식")])
    return found.select("conv_id", "meal_type", F.array_join("menu_items", "/").alias("items"))


@query("""WITH p AS (SELECT page_id, list_distinct(list_filter(string_split(regexp_replace(url, '[?#].*$', ''), '/')[4:], lambda x: x <> '')) AS ps FROM pages), k AS (SELECT page_id, list_filter(string_split(regexp_replace(url, '[?#].*$', ''), '/')[4:], lambda x: x <> '') AS ps FROM pages),
u AS (SELECT page_id, unnest(ps) AS x, generate_subscripts(ps, 1) AS i FROM k), f AS (SELECT page_id, x, min(i) AS i FROM u GROUP BY ALL) SELECT p.page_id, coalesce(string_agg(x, ' > ' ORDER BY i), '') AS path FROM p LEFT JOIN f USING (page_id) GROUP BY p.page_id""")
def breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.filter(F.slice(F.split(F.regexp_replace("url", "[?#].*$", ""), "/"), 4, 100), lambda x: x != "")
    made = page("<ul class='nav'><li>no</ul><ul class=\"top breadcrumb\">", F.array_join(F.transform(parts, lambda x: page("<li>", escaped(x), "</li>")), ""), "</ul>")
    return table(spark, sf_dir, "pages").select("page_id", html.breadcrumb(made).alias("path"))


@query("SELECT DISTINCT url, CASE WHEN contains(url, 'blog') THEN NULL ELSE '<p>' || upper(url) END AS html FROM pages")
def fetched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeline.sources import external

    def fetch(url: str) -> str | None:
        if "blog" in url:
            raise OSError("no answer")
        return f"<p>{url.upper()}"

    return external.fetched(table(spark, sf_dir, "pages"), "url", fetch).select("url", "html")


@query("SELECT doc_id, title FROM (SELECT doc_id, string_split(text, chr(10))[1] AS title, text, doc_id % 3 AS c FROM documents) WHERE NOT (c = 2 AND (regexp_matches(title, 'the|der') OR length(title) < 30)) AND NOT contains(text, '<script')")
def schedule_title_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers admit by a further condition on titles, as for calendars."""
    docs = table(spark, sf_dir, "documents").where("NOT contains(text, '<script')").select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("id"), (F.col("doc_id") % 3).cast("string").alias("category"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"))
    noise = (F.col("category") == "2") & (F.col("title").rlike("the|der") | (F.length("title") < 30))
    return kb.admitted(docs, kb.Layer("all", 0, 0, clean=False), extra=~noise).select(F.col("ord").alias("doc_id"), "title")
