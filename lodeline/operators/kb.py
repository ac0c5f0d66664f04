"""A layered knowledge base: admission, ids, metadata, upsert, versions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from lodeline.functions.rules import small
from lodeline.functions.text import any_in, collapse, lines_without, strip, without
from lodeline.operators.dedup import keep_first_content, suffix_repeats
from lodeline.operators.html import host
from lodeline.operators.keywords import with_hits
from lodeline.session import checkpointed


def noise_density(content: Column, pattern: str) -> Column:
    """Matches of a pattern per thousand characters, a shorter text counting as a thousand."""
    return F.regexp_count(content, F.lit(pattern)) / F.greatest(F.length(content) / 1000, F.lit(1.0))


def has_keyword(text: Column, category: Column, words: Mapping[str, Sequence[str]]) -> Column:
    """Whether a text has a keyword of its category; categories without keywords admit all."""
    out = F.lit(True)
    for name, held in words.items():
        if held:
            out = F.when(category == name, any_in(text, held)).otherwise(out)
    return out


def blocked_hosts(docs: DataFrame, blocked: DataFrame, category: str, url: str) -> DataFrame:
    """The documents whose host isn't blocked for their category (category, host)."""
    b = small(blocked.select(F.col(category).alias("__c"), F.col("host").alias("__h")))
    return docs.join(b, (docs[category] == b["__c"]) & (host(docs[url]) == b["__h"]), "left_anti")


def pruned_urls(url: Column, category: Column, archive: str = "library", board: str = "board", open_to: str = "notice", foreign: Sequence[str] = (), homepages: Sequence[str] = ()) -> Column:
    """False for pages of the archive host outside boards of the one category, for some hosts, and for homepages."""
    archived = F.contains(url, F.lit(archive))
    home = F.regexp_replace(url, "^/+|/+$", "").isin(*homepages) if homepages else F.lit(False)
    return ~((archived & ((category != open_to) | ~F.contains(url, F.lit(board)))) | any_in(url, foreign) | home)


#: How a page of navigation alone begins, and the words one of which a page with news has.
NAVIGATION = r"공과대학\s*\|\s*학과"
NEWS = ("공지사항", "채용", "장학", "모집", "안내", "결과", "선발", "2025", "2026", "2024")


def navigation_only(url: Column, content: Column, part: str, start: str = NAVIGATION, news: Sequence[str] = NEWS) -> Column:
    """Whether a page whose address holds ``part`` is navigation alone: it begins like one and has no word of news. False where either is null."""
    return F.coalesce(F.contains(url, F.lit(part)) & content.rlike(rf"\A(?:{start})") & ~any_in(content, news), F.lit(False))


def mapped_category(docs: DataFrame, names: Mapping[int, str], default: str | None = None, id_col: str = "category_id", as_: str = "category") -> DataFrame:
    """``docs`` with the name of each category number; one without a name goes, or gets ``default`` if there is one."""
    name = F.lit(None).cast("string")
    for number, text in names.items():
        name = F.when(F.col(id_col) == number, text).otherwise(name)
    held = docs.withColumn(as_, name)
    return held.where(F.col(as_).isNotNull()) if default is None else held.withColumn(as_, F.coalesce(as_, F.lit(default)))


@dataclass(frozen=True)
class Cleaner:
    """Patterns by which boilerplate leaves a document: inline, whole lines, then footers."""

    inline: Sequence[str] = ()
    line: str = r"^\b$"
    footer: Sequence[str] = ()

    def clean(self, text: Column) -> Column:
        """Invisible and hard spaces as spaces, boilerplate out, lines joined, spaces collapsed."""
        out = F.regexp_replace(text, r"[\x{FEFF}\x{200B}\x{00A0}]+", " ")
        out = lines_without(without(out, self.inline, " "), self.line)
        out = without(out, self.footer, " ")
        return strip(F.regexp_replace(out, r"(?U)\s{2,}", " "))


def cleaned_documents(docs: DataFrame, cleaner: Cleaner, garbage_title: str, least: int = 80, keywords: Mapping[str, Sequence[str]] | None = None, blocked: DataFrame | None = None, category: str = "category", url: str = "url", navigation: str | None = None) -> DataFrame:
    """Documents that survive a rebuild, with clean content and title: host, navigation, title, length and keyword tests in this order.

    ``navigation`` is the part of an address in whose pages navigation alone is looked for.
    """
    rows = blocked_hosts(docs, blocked, category, url) if blocked is not None else docs
    if navigation:
        rows = rows.where(~navigation_only(F.col(url), F.col("content"), navigation))
    rows = rows.withColumn("content", cleaner.clean(F.coalesce("content", F.lit("")))).withColumn("title", strip(F.coalesce("title", F.lit(""))))
    rows = rows.where(~F.col("title").rlike(garbage_title) & (F.length("content") >= least))
    both = F.lower(F.concat_ws(" ", "title", "content"))
    return rows.where(has_keyword(both, F.col(category), keywords or {}))


def scalar_metadata(base: Column, added: Column) -> Column:
    """Two maps in one, the second wins; entries without a value are left out."""
    kept = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(added), k))
    return F.map_filter(F.map_concat(kept, added), lambda k, v: v.isNotNull())


@dataclass(frozen=True)
class Layer:
    """How a layer admits documents. ``suffix_first``: repeated ids are told apart before short texts go."""

    name: str
    rank: int
    least: int
    suffix_first: bool = False
    clean: bool = True
    realtime: bool = False


STATIC = Layer("static", 0, 150)
LEGACY = Layer("legacy", 1, 50)
CURATED = Layer("curated", 2, 20, suffix_first=True)
REALTIME = Layer("realtime", 3, 0, clean=False, realtime=True)


def admitted(docs: DataFrame, layer: Layer, noise: Sequence[str] = (), density: str | None = None, keywords: Mapping[str, Sequence[str]] | None = None, extra: Column | None = None) -> DataFrame:
    """(ord, id, category, title, content, layer, layer_rank, is_realtime) of the documents that a layer admits.

    ``docs`` has ord, id, category, title, content. Order of tests: ``extra`` (as
    for addresses and titles), cleaning, length, density of noise, keywords;
    repeated ids get the ordinal of the unfiltered input as a suffix.
    """
    rows = docs.where(extra) if extra is not None else docs
    content = collapse(without(F.coalesce("content", F.lit("")), noise)) if layer.clean else F.col("content")

    def passes(text: Column) -> Column:
        out = F.length(text) >= layer.least
        if density:
            out = out & (noise_density(text, density) <= 2.5)
        return out & has_keyword(text, F.col("category"), keywords or {})

    # an array of one or no document: its text is cleaned once, while conditions on a column repeat the column's expression
    held = F.filter(F.array(F.struct(content.alias("content"))), lambda d: passes(d["content"]))
    kept = rows.select("ord", "id", "category", "title", F.inline(held))
    if layer.suffix_first:
        kept = suffix_repeats(kept, "id", "ord", "__id", among=rows)
    else:
        # what is read twice isn't cleaned twice
        kept = suffix_repeats(checkpointed(kept) if layer.clean else kept, "id", "ord", "__id")
    return kept.select("ord", F.col("__id").alias("id"), "category", "title", "content", F.lit(layer.name).alias("layer"), F.lit(layer.rank).alias("layer_rank"), F.lit(layer.realtime).alias("is_realtime"))


def layered(layers: Sequence[DataFrame], key: str = "id") -> DataFrame:
    """One row an id: of the highest layer that has it, the last in its order."""
    rows = layers[0]
    for layer in layers[1:]:
        rows = rows.unionByName(layer, allowMissingColumns=True)
    # each task keeps its best row of an id before anything is shuffled
    best = F.max_by(F.struct(*rows.columns), F.struct("layer_rank", "ord")).alias("r")
    return rows.groupBy(F.col(key).alias("__key")).agg(best).select("r.*")


def run_report(rows: DataFrame, by: str, names: Sequence[str], write: Callable[[DataFrame], object]) -> DataFrame:
    """Write rows, and report (by, n, n_chars) for each of some values of a column, and in the end for all rows (null).

    The counts are observed as the rows pass on their way to be written: neither
    they nor what was written is read again for it. ``write`` runs one action.
    """
    seen = Observation()
    chars = F.coalesce(F.length("content"), F.lit(0)).cast("bigint")
    kinds = [*names, None]
    own = [F.lit(True) if name is None else F.col(by).eqNullSafe(F.lit(name)) for name in kinds]
    metrics = [m for i, c in enumerate(own) for m in (F.count(F.when(c, 1)).alias(f"n{i}"), F.coalesce(F.sum(F.when(c, chars)), F.lit(0)).cast("bigint").alias(f"c{i}"))]
    write(rows.observe(seen, *metrics))
    held = seen.get
    return rows.sparkSession.createDataFrame([(name, held[f"n{i}"], held[f"c{i}"]) for i, name in enumerate(kinds)], f"{by} string, n bigint, n_chars bigint")


def merged(existing: DataFrame, fresh: DataFrame, key: str, order: str) -> DataFrame:
    """Rows by key: new values win, old keys keep their place in ``order`` and new keys follow in theirs."""
    old = existing.withColumn("__new", F.lit(0))
    new = fresh.withColumn("__new", F.lit(1))
    both = old.unionByName(new)
    w = Window.partitionBy(key)
    first = F.first(F.struct("__new", order)).over(w.orderBy("__new", order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = F.row_number().over(w.orderBy(F.col("__new").desc(), F.col(order).desc()))
    placed = both.withColumn("__first", first).withColumn("__n", last).where("__n = 1")
    return placed.withColumn("is_new", F.col("__first.__new") == 1).withColumn(order, F.col(f"__first.{order}")).drop("__new", "__first", "__n")


def union_dedup(fresh: DataFrame, existing: DataFrame, content: str, order: str) -> DataFrame:
    """New and then existing rows without those whose content was met before."""
    both = fresh.withColumn("__src", F.lit(0)).unionByName(existing.withColumn("__src", F.lit(1)))
    return keep_first_content(both, content, ["__src", order]).drop("__src")


def page_scores(pages: DataFrame, specs: DataFrame, id_col: str, url: str, title: str, breadcrumb: Column, content: str) -> DataFrame:
    """(id_col, category, score): the best category of each page.

    ``specs`` has category, ord, keywords, priority. A keyword in the address
    brings 100, one in title or breadcrumb 50, each in the first 1000 characters
    2, then the priority; of equals the first spec. Each field of a page is
    searched once for all keywords. A category without a hit has its priority
    alone, so of those only the first of the highest priority can win.
    """
    wanted = specs.select("ord", "category", "priority", F.explode("keywords").alias("keyword"))
    meta = F.lower(F.concat_ws(" ", F.col(title), breadcrumb))
    rows = pages.select(id_col, F.lower(url).alias("__u"), meta.alias("__m"), F.lower(F.substring(content, 1, 1000)).alias("__c"))
    for field in ("__u", "__m", "__c"):
        rows = with_hits(rows, field, wanted.select("keyword"), f"{field}_held")
    kind = lambda field: F.transform(F.coalesce(f"{field}_held", F.array().cast("array<string>")), lambda w: F.struct(w.alias("keyword"), F.lit(field).alias("at")))
    found = rows.select(id_col, F.explode(F.concat(kind("__u"), kind("__m"), kind("__c"))).alias("h")).select(id_col, "h.keyword", "h.at")
    any_of = lambda field: F.max((F.col("at") == field).cast("int"))
    points = 100 * any_of("__u") + 50 * any_of("__m") + 2 * F.count(F.when(F.col("at") == "__c", 1)) + F.col("priority")
    scored = found.join(wanted, "keyword").groupBy(id_col, "ord", "category", "priority").agg(points.alias("score")).select(id_col, "score", "ord", "category")
    # one row
    least = specs.agg(F.max(F.struct("priority", (-F.col("ord")).alias("o"), "category")).alias("b")).where("b IS NOT NULL").select(F.col("b.priority").alias("score"), (-F.col("b.o")).alias("ord"), "b.category")
    without = pages.select(id_col).join(F.broadcast(least), F.lit(True))
    best = F.max(F.struct(F.col("score").cast("bigint").alias("score"), (-F.col("ord")).alias("o"), "category"))
    return scored.unionByName(without.select(id_col, "score", "ord", "category")).groupBy(id_col).agg(best.alias("b")).select(id_col, F.col("b.category").alias("category"), F.col("b.score").alias("score"))
