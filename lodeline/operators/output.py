"""Post-processing of generated answers, prompts and contexts; the generator itself is pluggable."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, functions as F

from lodeline.functions.rules import latin_words, small, untrusted
from lodeline.functions.text import any_in, count_of, deduplicated, let, sanitised, strip, without


class Generator(Protocol):
    """Turns a prompt and a context into an answer, both columns."""

    def __call__(self, question: Column, context: Column) -> Column: ...


def extractive(question: Column, context: Column) -> Column:
    """The stand-in for a language model: the first paragraph of the context."""
    return F.split(context, "\n\n").getItem(0)


def context_of(hits: Column, most: int = 3, cut: int = 600) -> Column:
    """The first hits (date, content) as paragraphs: decoration runs out, a known date ahead, cut to ``cut`` characters."""

    def one(hit: Column) -> Column:
        body = F.regexp_replace(hit["content"], "[=─━-]{3,}", "")
        known = (F.coalesce(hit["date"], F.lit("")) != "") & (hit["date"] != "unknown")
        return F.substring(F.concat(F.when(known, F.concat(F.lit("["), hit["date"], F.lit("] "))).otherwise(""), body), 1, cut)

    return F.array_join(F.transform(F.slice(hits, 1, most), one), "\n\n")


def tagged_context(hits: Column, most: int = 3) -> Column:
    """The first hits (layer, title, content), each after its layer and title."""
    return F.array_join(F.transform(F.slice(hits, 1, most), lambda h: F.concat(F.lit("["), h["layer"], F.lit("] "), h["title"], F.lit("\n"), h["content"])), "\n\n")


def with_source(answer: Column, hits: Column, note: str) -> Column:
    """The answer with a note if a hit is from the realtime layer."""
    return F.when(F.exists(hits, lambda h: h["is_realtime"]), F.concat(answer, F.lit(note))).otherwise(answer)


def prompts(questions: DataFrame, table: DataFrame, category: str, question: str, context: str) -> DataFrame:
    """``questions`` with a column messages: the category's instructions (category, instructions), the context and the question."""
    joined = questions.join(small(table.select(F.col("category").alias(category), "instructions")), category, "left")
    user = F.concat(F.lit("[참고정보]\n"), F.coalesce(context, F.lit("")), F.lit("\n\n[질문]\n"), F.col(question))
    return joined.withColumn("messages", F.array(F.struct(F.lit("system").alias("role"), F.coalesce("instructions", F.lit("")).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))).drop("instructions")


#: Phrases that leave an answer, in order.
STRIPS = (
    r"제공된\s*(문서|컨텍스트|자료)에\s*(따르면|의하면|서는)?",
    "안녕하세요[,! ]*",
    r"죄송합니다[,.]?\s*현재 실시간 데이터를 제공하는 기능이 없습니다[.!]?\s*",
    r"죄송합니다[,.]?\s*하지만 ",
    r"\[참고정보\]",
    r"\[질문\]",
    r"위 \[참고정보\]만 사용해서 한국어로만 답변하세요\.",
    r"(?s)⚠️\s*규칙:.*",
    r"\d+\.\s*(반드시|위 \[참고|대학 이름|정보가 부족)",
)
GENERAL_STRIPS = (r"(?s)⚠️\s*규칙:.*", r"(?s)\[검색 결과\].*", r"(?s)\[질문\].*")


@dataclass(frozen=True)
class Shown:
    """What a category's answers must be, tested in this order.

    ``required``: a phrase, and the sentence put ahead of an answer without it.
    ``until``: a closing after which an answer is cut. ``about``: words, and the
    answer that replaces one with none of them. ``foreign``: whether an answer
    goes that has more than two Latin words of five letters, or fewer blocks of
    two Korean letters than twice its Latin words. ``stale``: words that an answer
    holds all, one that it doesn't hold, and the answer that then replaces it.
    ``dated``: whether it must hold a date (see rules.undated).
    """

    required: tuple[str, str] | None = None
    until: str | None = None
    about: tuple[tuple[str, ...], str] | None = None
    foreign: bool = False
    stale: tuple[tuple[str, ...], str, str] | None = None
    dated: bool = False

    def apply(self, text: Column) -> Column:
        out = text
        if self.required:
            out = F.when(~F.contains(out, F.lit(self.required[0])), F.concat(F.lit(self.required[1]), out)).otherwise(out)
        if self.until:
            at = F.locate(self.until, out)
            out = F.when(at > 0, F.substr(out, F.lit(1), at + len(self.until) - 1)).otherwise(out)
        if self.about:
            out = F.when((out != "") & ~any_in(out, self.about[0]), F.lit(self.about[1])).otherwise(out)
        fresh = out
        if self.stale:
            held, missing, answer = self.stale
            every = F.lit(True)
            for word in held:
                every = every & F.contains(out, F.lit(word))
            fresh = F.when(every & ~F.contains(out, F.lit(missing)), F.lit(answer)).otherwise(out)
        if self.foreign:
            latin = F.size(latin_words(out, 5))
            blocks = F.size(F.regexp_extract_all(out, F.lit("[가-힣]{2,}"), F.lit(0)))
            fresh = F.when((latin > 2) | ((latin > 0) & (blocks < 2 * latin)), "").otherwise(fresh)
        return fresh


def post_processed(text: Column, category: Column, fallbacks: Mapping[str, str], other: str, strips: Sequence[str] = STRIPS, shown: Mapping[str, Shown] | None = None, **trust) -> Column:
    """An answer fit to show: phrases out, foreign scripts out, lines once, emptied if untrusted, then the category's rules (``shown``) and fallback.

    ``trust`` is passed to rules.untrusted(). A null answer counts as an empty one.
    """
    held = shown or {}
    out = deduplicated(sanitised(without(F.coalesce(text, F.lit("")), strips)))
    schedule = category.isin(*[name for name, s in held.items() if s.dated]) if any(s.dated for s in held.values()) else None
    first = F.when(untrusted(out, schedule=schedule, **trust), "").otherwise(out)

    def ruled(value: Column) -> Column:
        done = value
        for name, rules in held.items():
            done = F.when(category == name, rules.apply(value)).otherwise(done)
        return done

    last = F.lit(other)
    for name, answer in fallbacks.items():
        last = F.when(category == name, F.lit(answer)).otherwise(last)
    # each value is bound once: the rules name it many times
    return let(let(first, ruled), lambda value: F.when(strip(value) == "", last).otherwise(strip(value)))


def post_processed_general(text: Column, has_web: Column, failed: str, empty: str, note: str) -> Column:
    """A general answer fit to show: failed without Korean, an excuse if empty, a note if it rests on no search."""
    out = strip(without(deduplicated(sanitised(text)), GENERAL_STRIPS))
    korean = count_of(out, "가-힣")
    shown = F.when(has_web, out).otherwise(F.concat(out, F.lit(note)))
    return F.when((F.length(out) > 20) & (korean < 5), F.lit(failed)).when(out == "", F.lit(empty)).otherwise(shown)
