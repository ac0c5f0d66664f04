"""Rules as expressions and small tables: lexicons, routes, aliases, cascades."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodeline.functions.text import any_in, normalise
from lodeline.operators.keywords import with_hits
from lodeline.session import checkpointed

#: Rows up to which a rule table is broadcast; a larger one is left to the planner.
BROADCAST_ROWS = 100_000


def small(rules: DataFrame) -> DataFrame:
    """A rule table, marked for broadcast if a count shows that it is small."""
    return F.broadcast(rules) if rules.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rules


def lexicon(spark: SparkSession, words: Mapping[int, Mapping[str, float]]) -> DataFrame:
    """(label, keyword, weight) with normalised keywords."""
    rows = [(label, keyword, float(weight)) for label, held in words.items() for keyword, weight in held.items()]
    return spark.createDataFrame(rows, "label int, keyword string, weight double").withColumn("keyword", normalise(F.col("keyword")))


def lexicon_scores(questions: DataFrame, words: DataFrame, labels: Sequence[int], id_col: str, text_col: str) -> DataFrame:
    """(id_col, label, score): the weights of the keywords that each question holds, 0 for labels without one.

    All keywords are found in one pass over a question; every label is present
    for every question, null texts included. Ids are unique.
    """
    held = with_hits(questions.select(id_col, normalise(F.col(text_col)).alias("__text")), "__text", words.select("keyword"), "__hits")
    weights = words.where(F.col("label").isin(*labels)).groupBy("label", "keyword").agg(F.sum("weight").alias("weight"))
    found = held.select(id_col, F.explode("__hits").alias("keyword")).join(weights, "keyword").select(id_col, "label", "weight")
    none = questions.select(id_col, F.explode(F.array(*[F.lit(label) for label in labels])).alias("label"), F.lit(0.0).alias("weight"))
    return found.unionByName(none).groupBy(id_col, "label").agg(F.sum("weight").alias("score"))


def argmax_label(scores: DataFrame, id_col: str) -> DataFrame:
    """(id_col, label, score, confidence): the best label, the lowest of equals; confidence is its share of all positive scores."""
    best = F.max_by(F.struct("label", "score"), F.struct(F.col("score"), -F.col("label")))
    total = F.sum(F.greatest(F.col("score"), F.lit(0.0)))
    found = scores.groupBy(id_col).agg(best.alias("b"), total.alias("t"))
    return found.select(id_col, F.col("b.label").alias("label"), F.col("b.score").alias("score"), F.when(F.col("t") > 0, F.col("b.score") / F.col("t")).otherwise(0.0).alias("confidence"))


@dataclass(frozen=True)
class Rule:
    """A step of a cascade: the label if the text holds a word of every group and none of the excluded ones."""

    label: int
    groups: tuple[tuple[str, ...], ...]
    none_of: tuple[str, ...] = ()


def cascade(text: Column, rules: Sequence[Rule]) -> Column:
    """The label of the first rule that fits, null if none does."""
    out = F.lit(None).cast("int")
    for rule in reversed(rules):
        fits = F.lit(True)
        for group in rule.groups:
            fits = fits & any_in(text, group)
        for word in rule.none_of:
            fits = fits & ~F.contains(text, F.lit(word))
        out = F.when(fits, rule.label).otherwise(out)
    return out


#: Words of the override rules for questions in Korean.
COME = ("어떻게 오", "오는 방법", "오는지", "찾아오", "어떻게 가", "가는 방법", "가는지")
PLACE = ("학교",)
ENROL = ("수강신청", "수강 신청", "수강정정", "대기번호", "수강대기")
MEAL = ("학식", "식단", "학생식당", "학생회관", "기숙사 식당", "제1학생회관", "제2학생회관", "제3학생회관", "제4학생회관", "밥")
OPEN = ("몇 시", "운영 시간", "영업 시간", "언제까지", "몇시", "열어", "닫아", "영업", "운영")
FOOD = ("식당", "메뉴", "밥", "식단", "점심", "저녁", "아침")
EVENT = ("특강", "세미나", "행사", "공고", "모집", "채용", "설명회")
BUS = ("셔틀", "버스")


def override_rules(places: Sequence[str] = PLACE) -> list[Rule]:
    """The override cascade; ``places`` are further names of the institution."""
    return [
        Rule(4, (COME, tuple(places))),
        Rule(2, (ENROL,), ("졸업",)),
        Rule(3, (MEAL, OPEN)),
        Rule(3, (("식당",), OPEN), BUS),
        Rule(1, (("기숙사", "생활관"),), FOOD + BUS),
        Rule(1, (EVENT,)),
        Rule(1, (("도서관", "열람실"),), BUS),
    ]


#: The shorter lists of the variant without the general rule on restaurants.
SHORT_MEAL, SHORT_OPEN = ("학식", "식단", "학생식당", "학생회관", "밥"), ("몇 시", "몇시", "운영", "영업", "열어", "닫아", "언제까지")


def short_override_rules(places: Sequence[str] = PLACE) -> list[Rule]:
    """The variant with six rules; it is meant for text in lower case whose white space is as it came."""
    return [Rule(4, (COME, tuple(places))), Rule(2, (ENROL,), ("졸업",)), Rule(3, (SHORT_MEAL, SHORT_OPEN)), *override_rules(places)[4:]]


def first_route(questions: DataFrame, routes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, priority, answer): of the routes (priority, keywords, answer) whose keywords the text all holds the first.

    Keywords are found in one pass over a text and joined with the routes by
    equality; a route fits if all its distinct keywords were found. A route without
    keywords fits every text, as an empty conjunction does. Ids and priorities are unique.
    """
    keyed = routes.select("priority", "answer", F.array_distinct("keywords").alias("ks"))
    wanted = keyed.select("priority", "answer", F.size("ks").alias("n"), F.explode("ks").alias("keyword"))
    held = with_hits(questions.select(id_col, F.col(text_col).alias("__text")), "__text", wanted.select("keyword"), "__hits")
    met = held.select(id_col, F.explode("__hits").alias("keyword")).join(wanted, "keyword").groupBy(id_col, "priority", "answer", "n").agg(F.count(F.lit(1)).alias("m")).where("m = n")
    # of the routes without keywords only the first can matter: one row
    free = keyed.where(F.size("ks") == 0).agg(F.min(F.struct("priority", "answer")).alias("r")).where("r IS NOT NULL").select("r.*")
    anywhere = questions.select(id_col).join(F.broadcast(free), F.lit(True))
    both = met.select(id_col, "priority", "answer").unionByName(anywhere.select(id_col, "priority", "answer"))
    return both.groupBy(id_col).agg(F.min(F.struct("priority", "answer")).alias("b")).select(id_col, F.col("b.priority").alias("priority"), F.col("b.answer").alias("answer"))


def shadowed_routes(routes: DataFrame) -> DataFrame:
    """(priority, blocked_by): routes that an earlier one always precedes, because its keywords are substrings of theirs; the first such route.

    Of routes with the same keywords the first stands for all. The keywords that
    a route's own hold are found in one pass, and only routes whose rarest keyword
    is among them are looked at further. A route without keywords precedes all later ones.
    """
    own = routes.select("priority", F.array_sort(F.array_distinct("keywords")).alias("ks"))
    own = checkpointed(own)
    words = own.select(F.explode("ks").alias("keyword")).distinct()
    # no keyword reaches over the mark between two of them
    held = checkpointed(with_hits(own.select("priority", F.array_join("ks", "\x01").alias("__text")), "__text", words, "__hits").drop("__text"))
    often = held.select(F.explode("__hits").alias("keyword")).groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))
    firsts = own.groupBy("ks").agg(F.min("priority").alias("blocked_by"))
    keyed = firsts.select("ks", "blocked_by", F.explode("ks").alias("keyword")).join(often, "keyword").groupBy("ks", "blocked_by").agg(F.min(F.struct("n", "keyword"))["keyword"].alias("keyword"))
    met = held.select("priority", "__hits", F.explode("__hits").alias("keyword")).join(keyed, "keyword").where((F.col("blocked_by") < F.col("priority")) & (F.size(F.array_except("ks", "__hits")) == 0)).select("priority", "blocked_by")
    # one row
    free = firsts.where(F.size("ks") == 0).select(F.col("blocked_by").alias("blocked_by"))
    anywhere = own.select("priority").join(F.broadcast(free), F.col("priority") > F.col("blocked_by"))
    return met.unionByName(anywhere).groupBy("priority").agg(F.min("blocked_by").alias("blocked_by"))


#: Characters at the beginning of a text, at most, that a question has to hold so that the whole text is looked for in it.
BEGINS = 8


def either_contains(questions: DataFrame, answers: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, ord, answer): the first curated question that holds the text or is held by it.

    Curated questions are looked for in the texts, and the texts in the curated
    questions, each in one pass; both kinds of hits are joined by equality. A text
    in a question is no longer than the longest of them, and begins like some
    piece of one: all other texts are left out before they are looked for, so that
    what is looked for grows with the curated questions and not with the texts.
    """
    asked = questions.select(id_col, F.col(text_col).alias("__text"))
    own = answers.select("ord", "question", "answer")
    inside = with_hits(asked, "__text", own.select("question"), "__hits").select(id_col, F.explode("__hits").alias("question")).join(own, "question").select(id_col, "ord", "answer")
    longest = own.agg(F.max(F.length("question"))).first()[0] or 0
    pieces = F.transform(F.sequence(F.lit(1), F.length("question")), lambda i: F.transform(F.sequence(F.lit(1), F.lit(BEGINS)), lambda n: F.substr("question", i, n)))
    begins = own.where(F.length("question") > 0).select(F.explode(F.flatten(pieces)).alias("__begin")).distinct()
    short = asked.where(F.length("__text") <= longest).withColumn("__begin", F.substring("__text", 1, BEGINS))
    held = short.join(small(checkpointed(begins)), "__begin", "left_semi").unionByName(short.where("__begin = ''")).drop("__begin")
    around = with_hits(own, "question", held.select("__text"), "__hits").select("ord", "answer", F.explode("__hits").alias("__text")).join(held, "__text").select(id_col, "ord", "answer")
    return inside.unionByName(around).groupBy(id_col).agg(F.min(F.struct("ord", "answer")).alias("b")).select(id_col, F.col("b.ord").alias("ord"), F.col("b.answer").alias("answer"))


def exact_answer(questions: DataFrame, answers: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, answer) where a curated question is the text."""
    return questions.join(small(answers), questions[text_col] == answers["question"]).groupBy(questions[id_col]).agg(F.min_by(answers["answer"], answers["ord"]).alias("answer"))


def curated(questions: DataFrame, answers: DataFrame, routes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, answer, how) for every question: exact, else the first route, else a substring either way, else null."""
    exact = exact_answer(questions, answers, id_col, text_col).select(id_col, F.col("answer").alias("a1"))
    route = first_route(questions, routes, id_col, text_col).select(id_col, F.col("answer").alias("a2"))
    near = either_contains(questions, answers, id_col, text_col).select(id_col, F.col("answer").alias("a3"))
    all_ = questions.select(id_col).join(exact, id_col, "left").join(route, id_col, "left").join(near, id_col, "left")
    how = F.when(F.col("a1").isNotNull(), "exact").when(F.col("a2").isNotNull(), "route").when(F.col("a3").isNotNull(), "near")
    return all_.select(id_col, F.coalesce("a1", "a2", "a3").alias("answer"), how.alias("how"))


def alias_of(text: Column, table: Mapping[str, Sequence[str]]) -> Column:
    """The first canonical name one of whose aliases the text holds, spaces apart; null if none."""
    flat = F.regexp_replace(text, " ", "")
    out = F.lit(None).cast("string")
    for name, aliases in reversed(table.items()):
        out = F.when(any_in(flat, [a.replace(" ", "") for a in aliases]), F.lit(name)).otherwise(out)
    return out


@dataclass(frozen=True)
class Entities:
    """Alias tables of a domain and the categories in which each is looked for."""

    tables: Mapping[str, Mapping[str, Sequence[str]]]
    categories: Mapping[str, Sequence[str]]
    extra: Mapping[str, Column] = field(default_factory=dict)

    def extract(self, text: Column, category: Column) -> Column:
        """A struct of the entities, each null outside its categories."""
        fields = [F.when(category.isin(*self.categories[name]), alias_of(text, table)).alias(name) for name, table in self.tables.items()]
        fields += [F.when(category.isin(*self.categories[name]) if name in self.categories else F.lit(True), value).alias(name) for name, value in self.extra.items()]
        return F.struct(*fields)


#: Greetings, requests for help, abbreviations of meals and buildings.
GREETINGS = ("안녕", "안녕하세요", "하이", "hello", "hi", "반가워", "고마워", "감사", "땡큐", "잘가")
HELP = ("뭐 할 수", "무엇을 할 수", "기능", "도움말", "사용법", "help")
MEALS = {"조식": ["조식", "아침"], "중식": ["중식", "점심", "런치"], "석식": ["석식", "저녁", "저녁밥"]}
BUILDINGS = {
    "제1학생회관": ["제1학생회관", "1학생회관", "1학", "1학식", "제1학식"],
    "제2학생회관": ["제2학생회관", "2학생회관", "2학", "2학식", "제2학식"],
    "제3학생회관": ["제3학생회관", "3학생회관", "3학", "3학식", "제3학식"],
    "제4학생회관": ["제4학생회관", "4학생회관", "4학", "4학식", "제4학식"],
    "생활과학대학": ["생활과학대학", "생과대", "생활과학대", "생활대"],
}


def guardrail(text: Column, domain: Sequence[str], greeting: str, off_topic: str) -> Column:
    """A canned answer to a greeting or a text without a word of the domain, else null."""
    norm = normalise(text)
    flat = F.regexp_replace(norm, " ", "")
    greets = any_in(flat, GREETINGS) | any_in(norm, HELP)
    known = any_in(flat, [w.lower().replace(" ", "") for w in domain])
    return F.when(greets, F.lit(greeting)).when(~known, F.lit(off_topic))


#: Shorthand of buildings and how it is written out, in order.
SHORTHAND = (
    ("(?<!제)([1-4])학생회관", "제$1학생회관"),
    (r"(?<![제\d])([1-4])학(?=\s|$|[에서의뭐밥먹알이])", "제$1학생회관"),
    ("(?<![가-힣])중도(?![서관가-힣])", "중앙도서관"),
)


def normalise_question(text: Column, abbreviations: Sequence[tuple[str, str]] = (), shorthand: Sequence[tuple[str, str]] = SHORTHAND) -> Column:
    """Shorthand written out by ordered patterns, then abbreviations replaced literally in text padded by a space."""
    q = F.trim(text)
    for pattern, full in shorthand:
        q = F.regexp_replace(q, pattern, full)
    q = F.concat(q, F.lit(" "))
    for short, full in abbreviations:
        q = F.replace(q, F.lit(short), F.lit(full))
    return F.trim(q)


#: What a question for a fact asks.
FACTUAL = (
    "수도", "뜻이", "뜻은", "언제", "어디서", "어디에", "어디 있", "누가", "몇 명", "몇명", "인구", "면적", "위치", "역사",
    "언제야", "몇 년", "몇년도", "나이", "설립", "창립", "발명", "발견", "최초", "기원", "출신", "국적",
    "어떤 나라", "어느 나라", "무슨 나라", "수도는", "가격은", "얼마야", "몇 층",
)


def factual(question: Column, words: Sequence[str] = FACTUAL) -> Column:
    """Whether a question asks for a fact, for which the web is searched; false for a null question."""
    return F.coalesce(any_in(question, words), F.lit(False))


#: Suffixes of departments, the particles that may follow them, and what a question about one asks.
DEPARTMENT_SUFFIXES = ("학과", "학부", "전공")
PARTICLES = ("", "가", "는", "을", "이", "에서", "에", "의")
DEPARTMENT_WORDS = ("뭐야", "소개", "알려줘", "정보", "어떤", "설명", "배워", "진로", "취업", "커리큘럼")


def asks_department(question: Column, suffixes: Sequence[str] = DEPARTMENT_SUFFIXES, particles: Sequence[str] = PARTICLES, words: Sequence[str] = DEPARTMENT_WORDS) -> Column:
    """Whether a question names a department, with a particle or without, and asks what it is; false for a null question."""
    named = any_in(question, [s + p for s in suffixes for p in particles])
    return F.coalesce(named & any_in(question, words), F.lit(False))


#: Patterns of generated text that can't be trusted, in any case of letters.
JUNK = (
    "축하합니다",
    r"[A-D]\.\s+\d+월",
    r"선택\s*문제",
    r"답안\s*:",
    r"[A-D]\.\s+[가-힣]",
    "청계천",
    "관광객",
    "(이 방법|이 서비스).{0,30}국제",
    r"\d+%\s*(선택|응답|비율)",
    "신안산|보수원|청계|한강|강남|강북|종로",
    "(Line|line|호선).{0,20}연결",
    "관광객.{0,30}방문",
    r"해당.{0,20}데이터베이스.{0,20}없습니다.{0,30}www\.",
)
#: Terms that only a model's own training explains, in any case of letters.
JARGON = (
    "academic quarter",
    "Cal-리포트",
    "분기.*대한 정보",
    r"(?<![\p{L}\p{N}_])quarter(?![\p{L}\p{N}_])",
    r"시즌 \d",
    r"국제문화.*회관.*\d{4}",
    "근처이나.*오랜만",
)
#: Latin words that an answer may hold.
LATIN = ("course", "credit", "campus", "portal", "master", "doctor", "national", "university", "schedule")
#: A date in an answer about the calendar, and what shows that an answer without one is made up.
DATED = r"\d{4}년\s*\d{1,2}월|\d{1,2}월\s*\d{1,2}일|\d{2}\.\d{2}"
UNDATED = "[A-Za-z]{5,}|시즌|새 정 |분기"


def latin_words(text: Column, least: int, beside: str = r"\p{L}\p{N}_") -> Column:
    """The runs of ``least`` Latin letters or more that no character of ``beside``, any letter, digit or underscore, adjoins."""
    return F.regexp_extract_all(text, F.lit(f"(?<![{beside}])[A-Za-z]{{{least},}}(?![{beside}])"), F.lit(0))


def undated(text: Column, dated: str = DATED, garbage: str = UNDATED) -> Column:
    """Whether an answer about dates has none, and shows that it is made up."""
    return ~text.rlike(dated) & text.rlike(garbage)


def untrusted(text: Column, junk: Sequence[str] = (*JUNK, *JARGON), wrong: Sequence[str] = (), right: str = "", long_word: int = 6, allowed: Sequence[str] = LATIN, most: int = 3, script: str = "가-힣", least: int = 15, schedule: Column | None = None, beside: str = r"\p{L}\p{N}_") -> Column:
    """Whether generated text can't be shown.

    It shows a junk pattern, a wrong name without the right one, ``most`` long
    Latin words (see latin_words(), as for ``beside``) that aren't ``allowed``, too few characters of its script, or,
    where ``schedule`` is true, no date but signs of invention. All patterns
    are alternatives of one expression, so a text is searched once for them.
    """
    out = text.rlike("(?i)" + "|".join(f"(?:{p})" for p in junk)) if junk else F.lit(False)
    if wrong:
        out = out | (any_in(text, wrong) & ~F.contains(text, F.lit(right)))
    words = latin_words(text, long_word, beside)
    foreign = F.filter(words, lambda w: ~F.lower(w).isin(*allowed)) if allowed else words
    short = F.length(F.regexp_replace(text, f"[^{script}]", "")) < least
    if schedule is not None:
        out = out | (F.coalesce(schedule, F.lit(False)) & undated(text))
    return out | (F.size(foreign) >= most) | short
