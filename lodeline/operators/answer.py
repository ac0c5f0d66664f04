"""From a question to an answer: the classifier chain, gates, fallbacks, departments, metadata filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lodeline.functions.rules import DEPARTMENT_SUFFIXES, DEPARTMENT_WORDS, PARTICLES, argmax_label, cascade, lexicon_scores
from lodeline.functions.text import any_in, normalise
from lodeline.operators.classify import gram_counts, similarity
from lodeline.operators.keywords import with_hits

#: The weight of the centroid cosine beside keyword weights, and what a generic request adds to its label.
COSINE, REQUEST = 8.0, 1.5


def label_of(name: Column, labels: Mapping[str, int]) -> Column:
    """A model's label as a number: by its name, else by its first digits if they are a label, else 0."""
    digits = F.regexp_extract(F.coalesce(name, F.lit("")), "([0-9]+)", 1)
    out = F.when(digits.isin(*[str(v) for v in labels.values()]), digits.cast("int")).otherwise(0)
    for text, value in labels.items():
        out = F.when(name == text, value).otherwise(out)
    return out


def classified(questions: DataFrame, id_col: str, text_col: str, rules: Sequence, words: DataFrame, centroids: DataFrame, labels: Sequence[int], request: Column | None = None, request_label: int = 1, model: DataFrame | None = None) -> DataFrame:
    """(id_col, label, score, how): the override, else the model's answer (id_col, label, score), else keywords and centroids.

    The costly last step is computed for the questions alone that the first two
    leave. ``request`` is a condition on the text that favours one label.
    """
    ruled = questions.select(id_col, text_col, cascade(normalise(F.col(text_col)), rules).alias("label"))
    done = ruled.where("label is not null").select(id_col, "label", F.lit(0.99).alias("score"), F.lit("override").alias("how"))
    left = ruled.where("label is null").select(id_col, text_col)
    if model is not None:
        done = done.unionByName(left.join(model, id_col).select(id_col, "label", "score", F.lit("model").alias("how")))
        left = left.join(model, id_col, "left_anti")
    near = similarity(gram_counts(left, id_col, text_col), centroids, id_col)
    scores = lexicon_scores(left, words, labels, id_col, text_col).join(near, [id_col, "label"], "left").join(left, id_col)
    bonus = F.when((F.col("label") == request_label) & request, REQUEST).otherwise(0.0) if request is not None else F.lit(0.0)
    total = F.round(F.col("score") + COSINE * F.coalesce("cosine", F.lit(0.0)) + bonus, 6)
    best = argmax_label(scores.select(id_col, "label", total.alias("score")), id_col)
    return done.unionByName(best.select(id_col, "label", F.col("confidence").alias("score"), F.lit("keyword").alias("how")))


@dataclass(frozen=True)
class Gate:
    """When a source of answers is asked: a word of every group, and not a word of every excluded group together."""

    name: str
    groups: tuple[tuple[str, ...], ...]
    unless: tuple[tuple[str, ...], ...] = ()

    def opens(self, text: Column) -> Column:
        ok = F.lit(True)
        for group in self.groups:
            ok = ok & any_in(text, group)
        if self.unless:
            bar = F.lit(True)
            for group in self.unless:
                bar = bar & any_in(text, group)
            ok = ok & ~bar
        return ok


#: Words of the gates to the meal and the notice report.
DORM, ADMIN = ("기숙사", "학생생활관"), ("신청", "입사", "비용", "가격", "조건", "선발", "연락처", "방법", "규정")
MEAL_GATE = Gate("meal", (("학식", "메뉴", "식단", "식당", "학생식당", "오늘 밥", "점심 뭐", "저녁 뭐", "아침 뭐", "오늘 뭐 먹", "기숙사 식당", "기숙사 밥", "기숙사 뭐", "학생회관"),), (DORM, ADMIN))
NOTICE_GATE = Gate("notice", (("최신 공지사항", "최근 공지사항", "공지사항 확인", "공지사항 알려", "오늘 공지", "이번 주 공지", "지금 공지", "최근 올라온", "올라온 공지", "최신 공지", "공지 목록", "공지사항 목록"),))
DEPARTMENT_GATE = Gate("department", (tuple(x + p for x in DEPARTMENT_SUFFIXES for p in PARTICLES), DEPARTMENT_WORDS))


def dispatched(questions: DataFrame, id_col: str, text_col: str, gates: Sequence[Gate], answers: Mapping[str, DataFrame], last: DataFrame) -> DataFrame:
    """(id_col, answer, how): the first open gate whose source (id_col, answer) has an answer, else that of ``last``.

    A gate whose source has none lets the question pass on. A question that is
    answered isn't asked again: each source sees what the ones before it left.
    """
    left, out = questions.select(id_col, text_col), None
    for name, source, condition in [*((g.name, answers[g.name], g.opens(F.col(text_col))) for g in gates), ("curated", last, F.lit(True))]:
        found = left.where(condition).join(source.where("answer is not null").select(id_col, "answer"), id_col).select(id_col, "answer", F.lit(name).alias("how"))
        out = found if out is None else out.unionByName(found)
        left = left.join(found.select(id_col), id_col, "left_anti")
    return out.unionByName(left.select(id_col, F.lit(None).cast("string").alias("answer"), F.lit(None).cast("string").alias("how")))


def first_answer(questions: DataFrame, id_col: str, sources: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """(id_col, answer, how): of several sources (id_col, answer) in order the first with an answer."""
    rows = None
    for n, (name, source) in enumerate(sources):
        part = source.where("answer is not null").select(id_col, "answer", F.lit(name).alias("how"), F.lit(n).alias("n"))
        rows = part if rows is None else rows.unionByName(part)
    best = rows.groupBy(id_col).agg(F.min_by(F.struct("answer", "how"), "n").alias("b"))
    return questions.select(id_col).join(best, id_col, "left").select(id_col, "b.answer", "b.how")


def department_of(text: Column, suffixes: Sequence[str] = ("융합학부", "학부", "학과", "전공"), least: int = 3, letter: str = "가-힣A-Za-z") -> Column:
    """A department's name: letters up to a suffix, the longest suffixes tried first; null below ``least`` characters."""
    name = F.regexp_extract(text, f"([{letter}]+(?:{'|'.join(suffixes)}))", 1)
    return F.when(F.length(name) >= least, name)


def department_pages(questions: DataFrame, docs: DataFrame, id_col: str, name: str, doc_id: str, title: str, order: str, prefix: str) -> DataFrame:
    """(id_col, doc_id): the first document with the name in its title, those whose id begins with ``prefix`` first.

    The names that a title holds are found in one pass over it; the first document
    of each name is found once, then joined with the questions that name it.
    """
    asked = questions.select(id_col, F.col(name).alias("__name")).where("__name IS NOT NULL")
    d = docs.select(F.col(doc_id).alias("__d"), F.col(title).alias("__t"), F.col(order).alias("__o"))
    tier = F.when(F.col("__d").cast("string").startswith(prefix), 0).otherwise(1)
    held = with_hits(d, "__t", asked.select("__name"), "__held").select(F.explode("__held").alias("__name"), tier.alias("__r"), "__o", "__d")
    first = held.groupBy("__name").agg(F.min(F.struct("__r", "__o", "__d")).alias("b")).select("__name", F.col("b.__d").alias(doc_id))
    return asked.join(first, "__name").select(id_col, doc_id)


#: Which entities filter documents of which category.
FILTERS = {"department": ("graduation", "notice"), "building": ("cafeteria",), "meal": ("cafeteria",), "stop": ("shuttle",), "major_type": ("graduation",)}


def metadata_filter(category: Column, entities: Mapping[str, Column], common: str = "공통", filters: Mapping[str, Sequence[str]] = FILTERS, everywhere: Sequence[str] = ("year", "date")) -> Column:
    """A map of what a document's metadata must be: the category, its entities that were found, and the common department if a graduation question names none."""
    pairs = [F.struct(F.lit("category").alias("k"), category.alias("v"))]
    for name, value in entities.items():
        asked = F.lit(True) if name in everywhere else category.isin(*filters.get(name, ("",)))
        if name == "department":
            value = F.coalesce(value, F.when((category == "graduation") & entities.get("major_type", F.lit(None)).isNull(), F.lit(common)))
        pairs.append(F.struct(F.lit(name).alias("k"), F.when(asked, value).alias("v")))
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["v"].isNotNull()))


def matches(metadata: Column, wanted: Column) -> Column:
    """Whether metadata has every wanted value; a key that it lacks doesn't count against it."""
    return F.forall(F.map_entries(wanted), lambda p: F.coalesce(F.element_at(metadata, p["key"]) == p["value"], F.lit(True)))


def authoritative(docs: DataFrame, url: str, table: Sequence[tuple[str, str, str]], id_col: str = "id", title: str = "title") -> DataFrame:
    """``docs`` with the id and title of the first entry (part of the address, id, title) that an address holds."""
    own_id, own_title = F.col(id_col), F.col(title)
    for part, new_id, new_title in reversed(table):
        own_id = F.when(F.contains(url, F.lit(part)), F.lit(new_id)).otherwise(own_id)
        own_title = F.when(F.contains(url, F.lit(part)), F.lit(new_title)).otherwise(own_title)
    return docs.withColumns({id_col: own_id, title: own_title})
