"""Parts of web pages by expressions: title, main text, breadcrumb, links, tables of cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodeline.functions.text import collapse, strip

#: Elements whose content isn't part of a page's main text.
DROPPED = ("script", "style", "nav", "header", "footer", "aside", "iframe")
#: The beginning of titles that say nothing.
NO_TITLE = r"(?i)^(ERROR|404|Not Found|Untitled)"


def without_elements(html: Column, names: Sequence[str] = DROPPED) -> Column:
    """The page without comments and some elements, one pattern for each so that none needs a back reference."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for name in names:
        out = F.regexp_replace(out, rf"(?is)<{name}\b.*?</{name}>", " ")
    return out


def text_of(html: Column) -> Column:
    """Tags as spaces, the five named entities resolved, white space collapsed."""
    out = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for name, character in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(character))
    return collapse(out)


def element(html: Column, name: str) -> Column:
    """The inside of the first element of a kind, empty without one."""
    return F.regexp_extract(html, rf"(?is)<{name}\b[^>]*>(.*?)</{name}>", 1)


def title(html: Column, fallback: Column, order: Sequence[str] = ("h1", "h2", "title"), garbage: str = NO_TITLE, least: int = 3) -> Column:
    """The first of some elements whose text is longer than ``least`` and no garbage, else the fallback."""
    found = [text_of(element(html, name)) for name in order]
    return F.coalesce(*[F.when((F.length(t) > least) & ~t.rlike(garbage), t) for t in found], fallback)


def main_text(html: Column, selectors: Sequence[str] = ("article", "main", "body"), least: int = 50, dropped: Sequence[str] = DROPPED) -> Column:
    """The text of the first of some elements that has ``least`` characters, else of the whole page."""
    bare = without_elements(html, dropped)
    found = [text_of(element(bare, name)) for name in selectors]
    return F.coalesce(*[F.when(F.length(t) >= least, t) for t in found], text_of(bare))


def breadcrumb(html: Column, css: str = "breadcrumb|location") -> Column:
    """The items of the first list or block whose class names a breadcrumb, joined by >."""
    block = F.regexp_extract(html, rf"""(?is)<(?:ul|ol|nav|div)\b[^>]*class="[^"]*(?:{css})[^"]*"[^>]*>(.*?)</(?:ul|ol|nav|div)>""", 1)
    items = F.transform(F.regexp_extract_all(block, F.lit(r"(?is)<(?:li|a|span)\b[^>]*>(.*?)</(?:li|a|span)>"), F.lit(1)), text_of)
    return F.array_join(F.array_distinct(F.filter(items, lambda x: x != "")), " > ")


def host(url: Column) -> Column:
    """The host of an http(s) address, empty if it is none."""
    return F.regexp_extract(url, r"^https?://([^/]+)", 1)


def without_dots(path: Column) -> Column:
    """A path without dot segments, however many: its segments are folded over a stack from which each ``..`` takes the last."""
    parts = F.split(path, "/")
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("folder"))

    def step(state: Column, part: Column) -> Column:
        # the empty segment ahead of the first slash stays
        shorter = F.when(F.size(state["kept"]) > 1, F.slice(state["kept"], F.lit(1), F.size(state["kept"]) - 1)).otherwise(state["kept"])
        kept = F.when(part == "..", shorter).when(part == ".", state["kept"]).otherwise(F.concat(state["kept"], F.array(part)))
        return F.struct(kept.alias("kept"), part.isin("..", ".").alias("folder"))

    # a path that ends in dots is a folder
    joined = lambda state: F.array_join(F.when(state["folder"], F.concat(state["kept"], F.array(F.lit("")))).otherwise(state["kept"]), "/")
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.aggregate(parts, start, step, joined)).otherwise(path)


#: The parts of an address: scheme, authority, path, query and fragment (the standard's expression for them).
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def resolved(href: Column, base: Column) -> Column:
    """The address that a reference means on a page, by the rules of the standard: scheme, authority, path, query and fragment in turn."""
    part = lambda address, i: F.regexp_extract(address, PARTS, i)
    has_host = lambda address: address.rlike("^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//")
    scheme, path, query, fragment = part(href, 1), part(href, 3), part(href, 4), part(href, 5)
    own_scheme, own_host, own_path, own_query = (part(base, i) for i in (1, 2, 3, 4))
    root = F.concat(own_scheme, F.lit("://"), own_host)
    folder = F.when((own_path == ""), F.lit("/")).otherwise(F.regexp_replace(own_path, "[^/]*$", ""))
    beside = F.concat(root, without_dots(F.concat(folder, path)), query, fragment)
    with_host = F.concat(F.lit("//"), part(href, 2), without_dots(path), query, fragment)
    return (
        F.when((scheme != "") & has_host(href), F.concat(scheme, F.lit(":"), with_host))
        .when(scheme != "", F.concat(scheme, F.lit(":"), without_dots(path), query, fragment))
        .when(has_host(href), F.concat(own_scheme, F.lit(":"), with_host))
        .when(path == "", F.concat(root, own_path, F.when(query != "", query).otherwise(own_query), fragment))
        .when(path.startswith("/"), F.concat(root, without_dots(path), query, fragment))
        .otherwise(beside)
    )


def resolve(href: Column, base: Column) -> Column:
    """resolved() without fragment and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(resolved(href, base), "#.*$", ""), "/+$", "")


def links(pages: DataFrame, url: str, html: str, scope: str = "", excluded: Sequence[str] = ("login",), keep: Sequence[str] = ()) -> DataFrame:
    """(keep, url, link): distinct links of each page, resolved, in hosts that contain ``scope`` and without excluded words."""
    hrefs = F.regexp_extract_all(html, F.lit(r"""(?is)<a\b[^>]*\bhref\s*=\s*["']([^"'<>]*)["']"""), F.lit(1))
    found = pages.select(*keep, url, F.explode(F.array_distinct(F.transform(hrefs, strip))).alias("href"))
    found = found.where(~F.col("href").rlike("(?i)^(mailto|javascript|tel|data):"))
    out = found.select(*keep, url, resolve(F.col("href"), F.col(url)).alias("link")).where(F.contains(host(F.col("link")), F.lit(scope)) & (host(F.col("link")) != ""))
    for word in excluded:
        out = out.where(~F.contains(F.lower("link"), F.lit(word)))
    return out.distinct()


def valid_url(url: Column, suffix: str, excluded: Sequence[str] = ("login", "logout", "download"), files: str = r"(?i)\.(jpg|jpeg|png|gif|zip|hwp|docx?|xlsx?|pptx?|mp4|css|js)$") -> Column:
    """Whether an address is in a domain, has no excluded word and isn't a file of no interest."""
    out = host(url).endswith(suffix) & ~F.regexp_replace(url, r"[?#].*$", "").rlike(files)
    for word in excluded:
        out = out & ~F.contains(url, F.lit(word))
    return out


def cells(pages: DataFrame, id_col: str, html: str) -> DataFrame:
    """(id_col, table, row, col, head, text): every cell of every table, numbered from 0; spans aren't repeated."""
    t = pages.select(id_col, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<table\b[^>]*>(.*?)</table>"), F.lit(1))).alias("table", "t"))
    r = t.select(id_col, "table", F.posexplode(F.regexp_extract_all("t", F.lit(r"(?is)<tr\b[^>]*>(.*?)(?=<tr\b|</tr>|\z)"), F.lit(1))).alias("row", "r"))
    raw = F.regexp_extract_all("r", F.lit(r"(?is)(<t[dh]\b[^>]*>.*?)(?=<t[dh]\b|</t[dh]>|\z)"), F.lit(1))
    c = r.select(id_col, "table", "row", F.posexplode(raw).alias("col", "c"))
    lines = F.regexp_replace("c", r"(?i)<br\s*/?>", "\n")
    text = F.array_join(F.filter(F.transform(F.split(lines, "\n"), text_of), lambda x: x != ""), "\n")
    return c.select(id_col, "table", "row", "col", F.col("c").rlike("(?i)^<th").alias("head"), text.alias("text"))


def menu_table(grid: DataFrame, id_col: str, restaurants: Sequence[str], closed: str = "운영안함", least: int = 2) -> DataFrame:
    """(id_col, ord, restaurant, meal_type, staff_student, menu_items) of a table of menus.

    ``grid`` is what cells() gives. The header names restaurants by column, the
    first cell of a full row spans the meal's rows and is filled forward, the
    next tells staff from students, the others follow the header's order.
    """
    head = grid.where("row = 0").where(F.col("text").isin(*restaurants)).select(id_col, "table", F.col("text").alias("restaurant"), F.row_number().over(Window.partitionBy(id_col, "table").orderBy("col")).alias("place"))
    width = head.groupBy(id_col, "table").agg(F.max("place").alias("n"))
    body = grid.where("row > 0").join(width, [id_col, "table"])
    rows = body.withColumn("count", F.count(F.lit(1)).over(Window.partitionBy(id_col, "table", "row")))
    full = F.col("count") >= F.col("n") + 2
    first = rows.where("col = 0").select(id_col, "table", "row", F.when(full, F.col("text")).alias("meal_type"))
    filled = first.withColumn("meal_type", F.last("meal_type", ignorenulls=True).over(Window.partitionBy(id_col, "table").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)))
    shift = F.when(full, 1).otherwise(0)
    who = rows.where(F.col("col") == shift).select(id_col, "table", "row", F.col("text").alias("staff_student"))
    values = rows.where(F.col("col") > shift).withColumn("place", F.col("col") - shift)
    found = values.join(head, [id_col, "table", "place"]).join(filled, [id_col, "table", "row"]).join(who, [id_col, "table", "row"])
    items = F.filter(F.transform(F.split("text", "\n"), strip), lambda x: F.length(x) >= least)
    order = (F.col("table") * 1_000_000 + F.col("row") * 1000 + F.col("place")).cast("bigint")
    return found.where(~F.contains("text", F.lit(closed))).select(id_col, order.alias("ord"), "restaurant", "meal_type", "staff_student", items.alias("menu_items")).where(F.size("menu_items") > 0)


def dorm_table(grid: DataFrame, id_col: str, meals: Sequence[tuple[str, str]], least: int = 3) -> DataFrame:
    """(id_col, meal_type, menu_items): the distinct dishes under each header that names a meal, in the order met, without allergen codes and bracketed notes."""
    label = F.lit(None).cast("string")
    for word, meal in reversed(meals):
        label = F.when(F.contains("text", F.lit(word)), F.lit(meal)).otherwise(label)
    head = grid.where("row = 0").select(id_col, "table", "col", label.alias("meal_type")).where("meal_type is not null")
    body = grid.where("row > 0").join(head, [id_col, "table", "col"])
    lines = body.select(id_col, "meal_type", "table", "row", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    bare = F.trim(F.regexp_replace(F.regexp_replace("raw", r"\[[^\]]*\]", ""), r"(\s*[0-9]+([.,][0-9]+)*[.,]?)+\s*$", ""))
    kept = lines.withColumn("item", bare).where(F.length("item") >= least)
    first = kept.groupBy(id_col, "meal_type", "item").agg(F.min(F.struct("table", "row", "line")).alias("at"))
    return first.groupBy(id_col, "meal_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "item"))), lambda x: x["item"]).alias("menu_items"))


def board_posts(pages: DataFrame, id_col: str, html: str, most: int = 5, least: int = 5) -> DataFrame:
    """(id_col, no, title, date, rank): the first posts of a listing, each once, with the date in the row of the post or an empty one."""
    rows = pages.select(id_col, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("ord", "row"))
    no = F.regexp_extract("row", r"""(?is)<a\b[^>]*href="[^"]*\bno=([0-9]+)[^"]*\"""", 1)
    posts = rows.where(F.col("row").rlike(r"""(?is)<a\b[^>]*href="[^"]*mode=V""")).select(id_col, "ord", no.alias("no"), text_of(F.regexp_extract("row", r"""(?is)<a\b[^>]*href="[^"]*mode=V[^"]*"[^>]*>(.*?)</a>""", 1)).alias("title"), F.regexp_extract("row", r"([0-9]{4}[-.][0-9]{2}[-.][0-9]{2})", 1).alias("date"))
    good = posts.where((F.col("no") != "") & (F.length("title") > least))
    once = good.withColumn("__n", F.row_number().over(Window.partitionBy(id_col, "no").orderBy("ord"))).where("__n = 1")
    w = Window.partitionBy(id_col).orderBy("ord")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select(id_col, "no", "title", "date", "rank")


def calendar_lines(pages: DataFrame, id_col: str, html: str) -> DataFrame:
    """(id_col, ord, year, month, day, event): the rows of calendars under the year and month headings before them."""
    parts = F.regexp_extract_all(html, F.lit(r"(?is)<(h[1-4]|dt|li|tr)\b[^>]*>(.*?)</\1>"), F.lit(2))
    rows = pages.select(id_col, F.posexplode(F.transform(parts, text_of)).alias("ord", "line"))
    w = Window.partitionBy(id_col).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    some = lambda x: F.when(x != "", x)
    dated = rows.withColumn("year", F.last(some(F.regexp_extract("line", r"^(20[0-9]{2})\s*년?", 1)), ignorenulls=True).over(w)).withColumn("month", F.last(some(F.regexp_extract("line", r"(?:^|\s)([0-9]{1,2})월$", 1)), ignorenulls=True).over(w))
    event = r"^([0-9]{1,2}(?:\([^)]*\))?(?:\s*[~-]\s*[0-9]{1,2}(?:\([^)]*\))?)?)\s+(.+)$"
    return dated.where(F.col("line").rlike(event)).select(id_col, "ord", "year", "month", F.trim(F.regexp_extract("line", event, 1)).alias("day"), F.regexp_extract("line", event, 2).alias("event"))
