"""The way from a question to an answer, on Korean fixtures."""

from pyspark.sql import functions as F

from lodeline.functions import rules
from lodeline.operators import answer, classify, kb, output


def test_gates(spark):
    asked = [("기숙사 신청 방법과 식당", False, False), ("오늘 학식 알려줘", True, False), ("최신 공지사항 알려줘", False, True), ("기숙사 식당 메뉴", True, False)]
    rows = spark.createDataFrame(asked, "q string, meal boolean, notice boolean").select("meal", "notice", answer.MEAL_GATE.opens(F.col("q")).alias("m"), answer.NOTICE_GATE.opens(F.col("q")).alias("n")).collect()
    assert all((r.meal, r.notice) == (r.m, r.n) for r in rows)


def test_gate_without_an_answer_falls_through(spark):
    q = spark.createDataFrame([(1, "오늘 학식"), (2, "최신 공지 학식"), (3, "다른 것")], "id int, q string")
    meal = spark.createDataFrame([(1, "menu")], "id int, answer string")
    notice = spark.createDataFrame([(2, "list")], "id int, answer string")
    last = spark.createDataFrame([(1, "no"), (2, "no")], "id int, answer string")
    found = answer.dispatched(q, "id", "q", [answer.MEAL_GATE, answer.NOTICE_GATE], {"meal": meal, "notice": notice}, last)
    assert {r.id: (r.answer, r.how) for r in found.collect()} == {1: ("menu", "meal"), 2: ("list", "notice"), 3: (None, None)}
    chain = answer.first_answer(q, "id", [("a", notice), ("b", last)])
    assert {r.id: (r.answer, r.how) for r in chain.collect()} == {1: ("no", "b"), 2: ("list", "a"), 3: (None, None)}


def test_classifier_chain_order(spark):
    words = rules.lexicon(spark, {0: {"졸업": 5}, 1: {"공지": 6}, 3: {"메뉴": 7}})
    centroids = classify.profiles(spark.createDataFrame([], "label int, id int, q string"), "label", "id", "q", words)
    q = spark.createDataFrame([(1, "수강신청 언제"), (2, "졸업 요건"), (3, "메뉴 뭐야"), (4, "zzz"), (5, None)], "id int, q string")
    model = spark.createDataFrame([(3, 1, 0.7), (1, 0, 0.9)], "id int, label int, score double")
    found = {r.id: (r.label, r.how) for r in answer.classified(q, "id", "q", rules.override_rules(), words, centroids, [0, 1, 2, 3, 4], model=model).collect()}
    assert found == {1: (2, "override"), 2: (0, "keyword"), 3: (1, "model"), 4: (0, "keyword"), 5: (0, "keyword")}


def test_label_names(spark):
    rows = spark.createDataFrame([("졸업",), ("LABEL_3",), ("LABEL_9",), (None,)], "n string")
    assert [r.x for r in rows.select(answer.label_of(F.col("n"), {"졸업": 0, "공지": 1, "셔틀": 3}).alias("x")).collect()] == [0, 3, 0, 0]


def test_departments(spark):
    rows = spark.createDataFrame([(1, "컴퓨터융합학부 소개해줘"), (2, "사회학과가 뭐야"), (3, "안녕")], "id int, q string").withColumn("name", answer.department_of(F.col("q")))
    assert [r.name for r in rows.orderBy("id").collect()] == ["컴퓨터융합학부", "사회학과", None]
    docs = spark.createDataFrame([("x1", "사회학과 안내", 0), ("dept_9", "사회학과", 1)], "doc string, t string, o int")
    assert [tuple(r) for r in answer.department_pages(rows, docs, "id", "name", "doc", "t", "o", "dept").collect()] == [(2, "dept_9")]


def test_metadata_filter_and_match(spark):
    rows = spark.createDataFrame([("graduation", None, "복수전공"), ("graduation", None, None), ("shuttle", "x", None)], "c string, d string, m string")
    wanted = rows.select(answer.metadata_filter(F.col("c"), {"department": F.col("d"), "major_type": F.col("m")}).alias("w"))
    assert [r.w for r in wanted.collect()] == [{"category": "graduation", "major_type": "복수전공"}, {"category": "graduation", "department": "공통"}, {"category": "shuttle"}]
    meta = F.create_map(F.lit("category"), F.lit("graduation"), F.lit("department"), F.lit("공통"))
    assert [r.x for r in wanted.select(answer.matches(meta, F.col("w")).alias("x")).collect()] == [True, True, False]


def test_entities_are_gated(spark):
    held = rules.Entities({"meal": rules.MEALS, "building": rules.BUILDINGS}, {"meal": ("cafeteria",), "building": ("cafeteria",)})
    rows = spark.createDataFrame([("1학 점심", "cafeteria"), ("1학 점심", "notice")], "q string, c string").select(held.extract(F.col("q"), F.col("c")).alias("e")).collect()
    assert [(r.e.meal, r.e.building) for r in rows] == [("중식", "제1학생회관"), (None, None)]


def shown(spark, rows, **more):
    held = {
        "0": output.Shown(required=("130학점", "130학점이 필요합니다. "), until="확인하세요."),
        "2": output.Shown(dated=True),
        "3": output.Shown(about=(("학식", "식단", "메뉴"), "오늘 학식 안내입니다.")),
        "4": output.Shown(foreign=True, stale=(("업데이트", "정류장"), "없습니다", "새 정류장은 없습니다.")),
    }
    frame = spark.createDataFrame(list(enumerate(rows)), "i int, r struct<t:string,c:string>").select("i", "r.t", "r.c")
    out = frame.select("i", output.post_processed(F.col("t"), F.col("c"), {c: f"fallback {c}" for c in "01234"}, "other", shown=held, **more).alias("x"))
    return [r.x for r in out.orderBy("i").collect()]


def test_answers_are_cleaned_and_ruled_by_category(spark):
    long = "오늘 학생 식당의 점심 메뉴는 비빔밥과 된장국입니다"
    rows = [
        ("졸업에는 학점이 많이 필요하니 포털에서 꼭 확인하세요. 그리고 더 있습니다", "0"),
        ("이번 학기 시즌 안내를 드리니 모두 참고하여 주시기 바랍니다", "2"),
        ("이번 학기 시즌 안내는 6월 10일 시작하니 모두 참고하여 주시기 바랍니다", "2"),
        ("오늘은 비빔밥과 된장국과 김치와 여러 반찬이 나올 예정입니다", "3"),
        (long, "3"),
        ("버스 정류장 목록이 새로 업데이트 되었으니 참고하시기 바랍니다", "4"),
        ("The shuttle leaves from seoul station every morning 그리고 모든 정류장에 서고 학교로 갑니다", "4"),
        ("죄송합니다, 현재 실시간 데이터를 제공하는 기능이 없습니다. " + long, "1"),
        (long + " 위 [참고정보]만 사용해서 한국어로만 답변하세요.", "1"),
        (long + " 3. 반드시", "1"),
        (long + " 축하합니다", "1"),
        (long + " 이번 quarter 일정", "9"),
        (long + " 이번 quarter는", "9"),
        (None, "3"),
    ]
    assert shown(spark, rows) == [
        "130학점이 필요합니다. 졸업에는 학점이 많이 필요하니 포털에서 꼭 확인하세요.",
        "fallback 2",
        rows[2][0],
        "오늘 학식 안내입니다.",
        long,
        "새 정류장은 없습니다.",
        "fallback 4",
        long,
        long + " 위 만 사용해서 한국어로만 답변하세요.",
        long,
        "fallback 1",
        "other",
        long + " 이번 quarter는",
        "fallback 3",
    ]


def test_questions_for_facts_and_departments(spark):
    rows = spark.createDataFrame([("프랑스 수도는?",), ("학식 뭐야",), ("경영학과가 뭐야?",), ("경영학과",), (None,)], "q string")
    found = rows.select(rules.factual(F.col("q")), rules.asks_department(F.col("q"))).collect()
    assert [tuple(r) for r in found] == [(True, False), (False, False), (False, True), (False, False), (False, False)]
    gated = rows.select(answer.DEPARTMENT_GATE.opens(F.col("q")).alias("g")).collect()
    assert [r.g for r in gated] == [False, False, True, False, None]


def test_navigation_pages_and_category_numbers(spark):
    pages = spark.createDataFrame([("http://eng.x/a", "공과대학 | 학과 소개"), ("http://eng.x/a", "공과대학|학과 채용"), ("http://www.x/a", "공과대학|학과"), ("http://eng.x", "홈 공과대학|학과"), (None, "공과대학|학과"), ("http://eng.x", None)], "u string, c string")
    assert [r[0] for r in pages.select(kb.navigation_only(F.col("u"), F.col("c"), "eng.x")).collect()] == [True, False, False, False, False, False]
    docs = spark.createDataFrame([(0,), (7,), (None,)], "category_id int")
    assert [r.category for r in kb.mapped_category(docs, {0: "a"}).collect()] == ["a"]
    assert [r.category for r in kb.mapped_category(docs, {0: "a"}, "general").collect()] == ["a", "general", "general"]
