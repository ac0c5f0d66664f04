"""Reports from daily snapshots: newest day, filters that fall back, pivots, ordered lists."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodeline.functions.text import any_in, strip
from lodeline.operators import keywords as hits
from lodeline.operators.keywords import Times, with_hits
from lodeline.session import checkpointed


def latest_snapshot(items: DataFrame, day: str, today: str | None = None) -> DataFrame:
    """The items of today's snapshot if there is one, else of the newest.

    The day is looked up first, so that a table partitioned by it is read for
    that day alone.
    """
    days = items.agg(F.max(day).alias("newest"), F.max(F.col(day).cast("string") == F.lit(today)).alias("has")).first()
    if days["newest"] is None:
        return items.where(F.lit(False))
    return items.where(F.col(day).cast("string") == F.lit(today) if days["has"] else F.col(day) == F.lit(days["newest"]))


def filter_or_all(df: DataFrame, condition: Column, group: Sequence[str] = ()) -> DataFrame:
    """The rows that fulfil a condition, or all rows of a group in which none does."""
    fits = F.coalesce(condition, F.lit(False))
    if group:
        some = df.withColumn("__fits", fits).groupBy(*group).agg(F.max("__fits").alias("__some"))
        return df.withColumn("__fits", fits).join(some, list(group)).where(F.col("__fits") | ~F.col("__some")).drop("__fits", "__some")
    return df.where(fits) if not df.where(fits).isEmpty() else df


def ordered_join(value: Column, order: Column, separator: str = "\n") -> Column:
    """Aggregate: values joined in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"]), separator)


def forward_fill(df: DataFrame, value: str, group: Sequence[str], order: str) -> DataFrame:
    """Nulls of a column filled with the last value before them in the group."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))


def first_n(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def matched_first(df: DataFrame, condition: Column, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows of the matching ones in order, then of the others."""
    return df.withColumn("matched", F.coalesce(condition, F.lit(False))).orderBy(F.col("matched").desc(), *order).limit(n)


def last_wins_pivot(df: DataFrame, rows: str, columns: str, values: Sequence[str], cell: Column, order: str) -> DataFrame:
    """One row per value of ``rows`` with a column per value of ``columns``: the last cell in order."""
    return df.groupBy(rows).pivot(columns, list(values)).agg(F.max_by(cell, F.col(order)))


#: Meals in the order of a report, and the words that ask for one.
MEALS = ("조식", "중식", "석식")
ASKED = (("조식", ("아침", "조식")), ("중식", ("점심", "중식")), ("석식", ("저녁", "석식")))


def clean_item(name: Column) -> Column:
    """A dish without allergen numbers at its end and without notes of what is included."""
    bare = F.trim(F.regexp_replace(name, r"(\s+\d+(?:,\d+)*)+\s*$", ""))
    return F.trim(F.regexp_replace(bare, r"(?i)\([a-z\s]+included\)", ""))


def dishes(items: Column, most: int = 7, script: str = "가-힣") -> Column:
    """Cleaned dishes with a character of the script, the first ``most``, joined."""
    return F.array_join(F.slice(F.transform(F.filter(items, lambda x: x.rlike(f"[{script}]")), clean_item), 1, most), " / ")


def asked_meal(question: Column) -> Column:
    """The meal that a question names, null if none."""
    out = F.lit(None).cast("string")
    for meal, words in reversed(ASKED):
        out = F.when(any_in(question, words), F.lit(meal)).otherwise(out)
    return out


def meal_report(items: DataFrame, question: str, restaurants: Sequence[str], dormitory: str, header: str, footer: str, most: int = 6) -> DataFrame:
    """One row (answer) with the meals of a day, none if a filter leaves nothing.

    ``items`` has ord, restaurant, meal_type, staff_student, menu_items.
    Students' rows if there are any; the restaurant that the question names if it
    has rows; the meal that it names in any case; of several rows for a
    restaurant and a meal the last; the first ``most`` restaurants in order.
    """
    rows = filter_or_all(items, F.col("staff_student") == "학생")
    named = dormitory if any(w in question for w in ("기숙사", "생활관")) else next((r for r in restaurants if r in question), None)
    if named:
        rows = filter_or_all(rows, F.col("restaurant") == named)
    meal = next((m for m, words in ASKED if any(w in question for w in words)), None)
    rows = rows.where((F.col("restaurant") != "") & (F.col("meal_type") != ""))
    rows = rows.where(F.col("meal_type") == meal) if meal else rows
    order = rows.groupBy("restaurant").agg(F.min("ord").alias("first")).orderBy("first").limit(most)
    cells = rows.groupBy("restaurant", "meal_type").agg(dishes(F.max_by("menu_items", "ord")).alias("said")).where("said <> ''")
    place = F.array_position(F.array(*map(F.lit, MEALS)), F.col("meal_type"))
    lines = cells.where(place > 0).groupBy("restaurant").agg(ordered_join(F.concat(F.lit("  "), F.col("meal_type"), F.lit(": "), F.col("said")), place).alias("lines"))
    blocks = order.join(lines, "restaurant", "left").select("first", F.concat_ws("\n", F.concat(F.lit("【"), F.col("restaurant"), F.lit("】")), "lines", F.lit("")).alias("block"))
    return blocks.agg(ordered_join(F.col("block"), F.col("first")).alias("body"), F.count(F.lit(1)).alias("n")).where("n > 0").select(F.concat(F.lit(f"{header}\n\n"), F.col("body"), F.lit(f"\n{footer}")).alias("answer"))


#: Words by which a question asks for one kind of notice, in order.
NOTICE_WORDS = ("채용", "취업", "장학", "학사", "행사", "일반")


def entry(title: Column, date: Column, board: Column) -> Column:
    """A line of a list of notices; a missing date is left out."""
    dated = F.concat(F.lit("• ["), date, F.lit("] ["), board, F.lit("] "), title)
    return F.when(F.coalesce(date, F.lit("")) != "", dated).otherwise(F.concat(F.lit("• ["), board, F.lit("] "), title))


def notice_report(items: DataFrame, question: str, header: str, footer: str, summary: str = "공지사항 목록", most: int = 10) -> DataFrame:
    """One row (answer) that lists the first notices (ord, title, date, board), those that the question asks for first; none without a notice."""
    rows = items.where((F.coalesce("title", F.lit("")) != "") & ~F.contains("title", F.lit(summary))).withColumn("title", strip(F.col("title"))).where(F.length("title") >= 5)
    word = next((w for w in NOTICE_WORDS if w in question.lower()), None)
    fits = (F.contains("board", F.lit(word)) | F.contains(F.lower("title"), F.lit(word))) if word else F.lit(True)
    listed = matched_first(rows, fits, ["ord"], most).withColumn("line", entry(F.col("title"), F.col("date"), F.col("board")))
    body = listed.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((~F.col("matched")).alias("m"), "ord", "line"))), lambda x: x["line"]), "\n").alias("body"), F.count(F.lit(1)).alias("n"))
    return body.where("n > 0").select(F.concat(F.lit(f"{header}\n\n"), F.col("body"), F.lit(f"\n\n{footer}")).alias("answer"))


def keywords(question: Column, stop: Sequence[str], word: str = "[가-힣A-Za-z0-9]") -> Column:
    """A question's words of two characters or more without stop words; repeats stay."""
    return F.filter(F.regexp_extract_all(question, F.lit(f"{word}{{2,}}"), F.lit(0)), lambda w: ~w.isin(*stop))


def _topics(questions: DataFrame, notices: DataFrame, question_id: str, words: str, notice_id: str, title: str, content: str) -> tuple[DataFrame, DataFrame]:
    """How often each question asks each word (q, word, times), and the words that each notice holds (n, in_t, in_c)."""
    asked = questions.select(F.col(question_id).alias("q"), F.explode(words).alias("word")).groupBy("q", "word").agg(F.count(F.lit(1)).alias("times"))
    asked = checkpointed(asked)
    text = notices.select(F.col(notice_id).alias("n"), F.col(title).alias("t"), F.col(content).alias("c"))
    return asked, with_hits(with_hits(text, "t", asked.select("word"), "in_t"), "c", asked.select("word"), "in_c").select("n", "in_t", "in_c")


def _topic_joined(asked: DataFrame, held: DataFrame) -> DataFrame:
    """(q, n, score) of all questions and notices that score above 0."""
    points = lambda words, p: F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.struct(w.alias("word"), F.lit(p).alias("p")))
    found = held.select("n", F.explode(F.concat(points(F.col("in_t"), 2), points(F.col("in_c"), 1))).alias("f")).select("n", "f.word", "f.p")
    return found.join(asked, "word").groupBy("q", "n").agg(F.sum(F.col("p") * F.col("times")).cast("bigint").alias("score"))


def topic_scores(questions: DataFrame, notices: DataFrame, question_id: str, words: str, notice_id: str, title: str, content: str) -> DataFrame:
    """(question_id, notice_id, score): 2 for each keyword in the title and 1 for each in the content, scores above 0 alone.

    Each notice is searched once for all keywords, and the keywords it holds are
    joined with the questions that ask them, repeated ones counted each time.
    """
    scored = _topic_joined(*_topics(questions, notices, question_id, words, notice_id, title, content))
    return scored.select(F.col("q").alias(question_id), F.col("n").alias(notice_id), "score")


def topic_search(questions: DataFrame, notices: DataFrame, question_id: str, words: str, notice_id: str, title: str, content: str) -> DataFrame:
    """(question_id, notice_id, score): topic_best of topic_scores, for notices with distinct ids.

    A task scores its notices for all questions, keeps the best of each question
    and hands on these alone: neither its memory nor what is shuffled grows with
    the notices. Questions of more than keywords.TIMES words by questions go by joins.
    """
    asked, held = _topics(questions, notices, question_id, words, notice_id, title, content)
    asked = asked.where("word IS NOT NULL")
    cells = asked.agg(F.count_distinct("word") * F.count_distinct(F.struct("q"))).first()[0]
    scored = _topic_joined(asked, held) if cells > hits.TIMES else _best_in_tasks(asked, held)
    return topic_best(scored.select(F.col("q").alias(question_id), F.col("n").alias(notice_id), "score"), question_id, notice_id)


def _best_in_tasks(asked: DataFrame, held: DataFrame) -> DataFrame:
    """(q, n, score): of each task's notices (n, in_t, in_c) the best for each question, of equals the first."""
    wanted = Times.of(asked.select("q", "word", "times").collect())
    sent = held.sparkSession.sparkContext.broadcast(wanted)
    kinds = dict(asked.dtypes)["q"], dict(held.dtypes)["n"]
    arrow = to_arrow_type(asked.schema["q"].dataType), to_arrow_type(held.schema["n"].dataType)
    place = lambda n: (n is not None, n)  # noqa: E731 - nulls first, as Spark orders them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        best, first = np.zeros(len(wanted.queries)), [None] * len(wanted.queries)
        for batch in batches:
            for low in range(0, batch.num_rows, wanted.texts):
                ids, in_t, in_c = (column.to_pylist() for column in batch.slice(low, wanted.texts).columns)
                order = sorted(range(len(ids)), key=lambda i: place(ids[i]))
                scores = wanted.sums((2, [in_t[i] for i in order]), (1, [in_c[i] for i in order]))
                at = scores.argmax(axis=0)
                top = scores[at, np.arange(len(best))]
                for q in np.nonzero((top > 0) & (top >= best))[0].tolist():
                    mine = ids[order[at[q]]]
                    if top[q] > best[q] or place(mine) < place(first[q]):
                        best[q], first[q] = top[q], mine
        found = np.nonzero(best)[0].tolist()
        yield pa.RecordBatch.from_arrays([pa.array([wanted.queries[q] for q in found], arrow[0]), pa.array([first[q] for q in found], arrow[1]), pa.array(best[found].astype(np.int64))], ["q", "n", "score"])

    return held.mapInArrow(run, f"q {kinds[0]}, n {kinds[1]}, score bigint")


def topic_best(scores: DataFrame, question_id: str, notice_id: str) -> DataFrame:
    """The best notice of each question, the first of equals."""
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col(notice_id).alias("o")))
    return scores.groupBy(question_id).agg(best.alias("b")).select(question_id, F.col("b.o").alias(notice_id), (-F.col("b.s")).alias("score"))
