"""Text functions and rules on small fixtures, Korean ones included."""

import datetime

from pyspark.sql import functions as F

from lodeline.functions import rules, text


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("x")).first()["x"]


def test_normalise_handles_all_white_space(spark):
    assert one(spark, "  A　b\t\nC ", text.normalise) == "a b c"
    assert one(spark, None, text.normalise) is None
    assert one(spark, "", text.normalise) == ""


def test_ngrams_and_features(spark):
    assert one(spark, "ab C", text.ngrams) == ["ab", "bc", "abc"]
    assert one(spark, "x", text.ngrams) == []
    assert one(spark, "학식 밥", lambda t: text.features(t, text.HANGUL_WORD)) == ["학식", "식밥", "학식밥", "학식", "밥", "학식", "밥"]


def test_chunks_join_to_the_text(spark):
    value = "안녕\n하세요 hello"
    assert "".join(one(spark, value, text.chunks)) == value


def test_lines_once(spark):
    value = "a\na\n\na\nb\nc\nb\nb\nc\nb"
    assert one(spark, value, text.deduplicated) == "a\n\nb\nc\nc"
    assert one(spark, one(spark, value, text.deduplicated), text.deduplicated) == "a\n\nb\nc"


def test_sanitised_drops_or_empties(spark):
    assert one(spark, "오늘 学 메뉴입니다  좋아요", text.sanitised) == "오늘 메뉴입니다 좋아요"
    assert one(spark, "学生食堂 메뉴", text.sanitised) == ""
    assert one(spark, "", text.sanitised) == ""


def test_dates_and_years(spark):
    today = F.lit(datetime.date(2026, 6, 30))
    ask = lambda q: one(spark, q, lambda t: text.date_of(t, today))
    assert ask("오늘 학식") == "2026-06-30"
    assert ask("내일 학식") == "2026-07-01"
    assert ask("2026년 3월 5일 메뉴") == "2026-03-05"
    assert ask("메뉴") is None
    year = lambda q: one(spark, q, text.year_of)
    assert [year(q) for q in ("2021학번", "21학번", "99 학번", "x")] == ["2021", "2021", "1999", None]


def test_safe_id_keeps_hangul(spark):
    assert one(spark, "공지: 수강 신청!", text.safe_id) == "공지수강신청"


def test_question_normaliser(spark):
    ask = lambda q: one(spark, q, lambda t: rules.normalise_question(t, [("솔캠", "솔잎캠퍼스")]))
    assert ask("1학생회관 메뉴") == "제1학생회관 메뉴"
    assert ask("제1학생회관 메뉴") == "제1학생회관 메뉴"
    assert ask("2학 밥") == "제2학생회관 밥"
    assert ask("중도 자리") == "중앙도서관 자리"
    assert ask("솔캠 어디") == "솔잎캠퍼스 어디"


def test_override_cascade_order(spark):
    ask = lambda q: one(spark, q, lambda t: rules.cascade(text.normalise(t), rules.override_rules()))
    assert ask("학교 오는 방법 알려줘") == 4
    assert ask("수강신청 언제") == 2
    assert ask("졸업 수강신청 공고") == 1
    assert ask("학식 몇 시") == 3
    assert ask("기숙사 신청") == 1
    assert ask("기숙사 메뉴") is None
    assert ask("도서관 셔틀") is None


def test_alias_and_guardrail(spark):
    assert one(spark, "1 학식 뭐야", lambda t: rules.alias_of(t, rules.BUILDINGS)) == "제1학생회관"
    assert one(spark, "런치 메뉴", lambda t: rules.alias_of(t, rules.MEALS)) == "중식"
    ask = lambda q: one(spark, q, lambda t: rules.guardrail(t, ("졸업", "셔틀"), "hello", "off"))
    assert [ask(q) for q in ("안녕 하세요", "졸업 학점", "날씨 어때")] == ["hello", None, "off"]


def test_routes_shadowed_and_repeated(spark):
    routes = spark.createDataFrame([(0, ["셔틀"], "bus"), (1, ["셔틀", "시간"], "times"), (2, ["식당"], "food")], "priority int, keywords array<string>, answer string")
    asked = spark.createDataFrame([(1, "셔틀 시간 알려줘"), (2, "식당 어디"), (3, "없음"), (4, None)], "id int, q string")
    assert sorted((r.id, r.answer) for r in rules.first_route(asked, routes, "id", "q").collect()) == [(1, "bus"), (2, "food")]
    assert [tuple(r) for r in rules.shadowed_routes(routes).collect()] == [(1, 0)]


def test_lexicon_has_every_label(spark):
    words = rules.lexicon(spark, {0: {"TOEIC": 5}, 1: {"공지": 6}})
    asked = spark.createDataFrame([(1, "toeic 공지"), (2, None)], "id int, q string")
    scores = rules.lexicon_scores(asked, words, [0, 1, 2], "id", "q")
    assert sorted(tuple(r) for r in scores.collect()) == [(1, 0, 5.0), (1, 1, 6.0), (1, 2, 0.0), (2, 0, 0.0), (2, 1, 0.0), (2, 2, 0.0)]
    best = {r.id: (r.label, r.confidence) for r in rules.argmax_label(scores, "id").collect()}
    assert best == {1: (1, 6 / 11), 2: (0, 0.0)}


def test_untrusted(spark):
    ask = lambda q: one(spark, q, lambda t: rules.untrusted(t, wrong=("딴대학교",), right="우리대학교", allowed=("campus",)))
    good = "오늘 학생 식당의 점심 메뉴는 비빔밥과 된장국입니다"
    assert not ask(good)
    assert ask("짧다") and ask(good + " 축하합니다") and ask(good + " 딴대학교") and ask(good + " alpha1 quarterly lantern meadows")
    assert not ask(good + " 딴대학교 우리대학교")


def test_short_override_rules(spark):
    ask = lambda q: one(spark, q, lambda t: rules.cascade(F.lower(t), rules.short_override_rules()))
    assert ask("밥 몇시") == 3 and ask("식당 운영") is None and ask("기숙사 신청") == 1


def test_accented_letters_end_latin_words_where_sql_says_so(spark):
    from lodeline.functions import rules, text

    rows = spark.createDataFrame([("éabcdefé", "Lesé x"), ("xabcdefx9", "Lest")], "t string, title string")
    found = rows.select(F.size(rules.latin_words(F.col("t"), 6)), F.size(rules.latin_words(F.col("t"), 6, "0-9A-Za-z_")), F.col("title").rlike(f"(?i)^(The|Les){text.WORD_END}")).collect()
    assert [tuple(r) for r in found] == [(0, 1, True), (0, 0, False)]
