"""Queries over crawled pages: titles, main text, links, walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodeline.operators import crawl, html
from lodeline.plans.registry import query
from lodeline.session import checkpointed, table


def _text(sql: str) -> str:
    out = f"regexp_replace({sql}, '<[^>]*>', ' ', 'g')"
    for name, c in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("amp", "&")):
        out = f"replace({out}, '&{name};', '{c}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def _inside(source: str, name: str) -> str:
    return _text(f"regexp_extract({source}, '(?is)<{name}\\b[^>]*>(.*?)</{name}>', 1)")


def _bare(source: str) -> str:
    out = f"regexp_replace({source}, '(?s)<!--.*?-->', ' ', 'g')"
    for name in html.DROPPED:
        out = f"regexp_replace({out}, '(?is)<{name}\\b.*?</{name}>', ' ', 'g')"
    return out


@query(f"WITH t AS (SELECT page_id, url, {_inside('html', 'h1')} AS a, {_inside('html', 'h2')} AS b, {_inside('html', 'title')} AS c FROM pages) SELECT page_id, coalesce(" + ", ".join(f"CASE WHEN length({x}) > 3 AND NOT regexp_matches({x}, '(?i)^(ERROR|404|Not Found|Untitled)') THEN {x} END" for x in "abc") + ", url) AS title FROM t")
def html_title_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html.title(F.col("html"), F.col("url")).alias("title"))


@query(f"WITH b AS (SELECT page_id, {_bare('html')} AS bare FROM pages), t AS (SELECT page_id, {_inside('bare', 'article')} AS a, {_inside('bare', 'main')} AS m, {_inside('bare', 'body')} AS o, {_text('bare')} AS w FROM b) SELECT page_id, CASE WHEN length(a) >= 50 THEN a WHEN length(m) >= 50 THEN m WHEN length(o) >= 50 THEN o ELSE w END AS main_text FROM t")
def html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html.main_text(F.col("html")).alias("main_text"))


@query("""WITH h AS (SELECT DISTINCT page_id, url, trim(unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*\\bhref\\s*=\\s*["'']([^"''<>]*)["'']', 1))) AS href FROM pages),
r AS (SELECT page_id, url, regexp_replace(regexp_replace(CASE WHEN regexp_matches(href, '(?i)^https?://') THEN href ELSE regexp_extract(url, '^(https?://[^/?#]+)', 1) || href END, '#.*$', ''), '/+$', '') AS link FROM h WHERE regexp_matches(href, '(?i)^https?://') OR (starts_with(href, '/') AND NOT starts_with(href, '//')))
SELECT DISTINCT page_id, url, link FROM r WHERE contains(regexp_extract(link, '^https?://([^/]+)', 1), 'example') AND NOT contains(lower(link), 'login')""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.links(table(spark, sf_dir, "pages"), "url", "html", "example", keep=["page_id"])


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'c' || o_custkey AS url, 'o' || o_orderkey AS link FROM orders UNION SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem UNION SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem),
w AS (SELECT DISTINCT 'c' || o_custkey AS url, 0 AS depth FROM orders WHERE o_custkey % 20 = 1 UNION SELECT e.link, depth + 1 FROM w JOIN e USING (url) WHERE depth < 3) SELECT url, min(depth)::INT AS depth FROM w GROUP BY url""")
def bfs_depth_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every twentieth customer to their orders, the parts in these and the parts' suppliers."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    edge = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("url"), F.concat(F.lit(b), F.col(y).cast("string")).alias("link"))
    edges = edge(orders, "c", "o_custkey", "o", "o_orderkey").unionByName(edge(lines, "o", "l_orderkey", "p", "l_partkey")).unionByName(edge(lines, "p", "l_partkey", "s", "l_suppkey")).distinct()
    seeds = orders.where("o_custkey % 20 = 1").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("url"))
    return crawl.walk(checkpointed(edges), seeds, 3)


@query("""WITH p AS (SELECT page_id, (page_id % 9)::INT AS m, (page_id % 13)::INT AS k FROM pages), s AS (SELECT *, list_slice(['a', 'b', 'c', 'd', 'e', 'f', 'g', 'h'], 1, greatest(m - k, 0)) AS kept FROM p)
SELECT page_id, 'http://h.example/' || array_to_string(kept, '/') || CASE WHEN len(kept) > 0 THEN '/' ELSE '' END || 'x' || page_id || '?q=../' AS address FROM s""")
def resolved_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, k = F.col("page_id") % 9, F.col("page_id") % 13
    base = F.concat(F.lit("http://h.example/"), F.array_join(F.transform(F.slice(F.array(*map(F.lit, "abcdefgh")), F.lit(1), m.cast("int")), lambda x: F.concat(x, F.lit("/"))), ""), F.lit("page"))
    href = F.concat(F.repeat(F.lit("../"), k.cast("int")), F.lit("./x"), F.col("page_id").cast("string"), F.lit("?q=../#part"))
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(html.resolved(href, base), "#.*$", "").alias("address"))
