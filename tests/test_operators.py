"""Retrieval, knowledge base, pages, walks, reports, output, sources and streams on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from lodeline.operators import classify, crawl, dedup, html, kb, output, reports, retrieval
from lodeline.sources import documents as sources
from lodeline.streaming import updates


def test_boosts_closed_form_and_guard(spark):
    dense = spark.createDataFrame([(1, "a", 0.05, 0), (1, "b", 0.04, 1), (2, "a", 0.05, 0)], "query_id int, id string, similarity double, rank int")
    sparse = spark.createDataFrame([(1, "b", 3.0, 0), (1, "c", 2.0, 1)], "query_id int, id string, score double, rank int")
    fused = {(r.query_id, r.id): r.score for r in retrieval.fuse(dense, sparse).collect()}
    assert fused[1, "b"] == pytest.approx(1.2 / 61 + 1 / 60) and fused[1, "c"] == pytest.approx(1 / 61)
    boosts = spark.createDataFrame([(1, "c"), (1, "c"), (1, "z"), (1, "z")], "query_id int, id string")
    found = {(r.query_id, r.id): r.score for r in retrieval.boosted(retrieval.fuse(dense, sparse), boosts).collect()}
    assert found[1, "c"] == pytest.approx(4 / 61, abs=1e-9) and found[1, "z"] == pytest.approx(0.1)
    hits = retrieval.hybrid(dense, sparse, boosts, 3).collect()
    assert {r.query_id for r in hits} == {1}  # query 2 has a far, unboosted best hit
    assert [r.id for r in sorted(hits, key=lambda r: r["rank"])][0] == "z"


def test_dedup_and_suffix(spark):
    rows = spark.createDataFrame([(0, "a", "x"), (1, "b", "x"), (2, "a", "y"), (3, None, None), (4, None, None)], "ord int, k string, c string")
    assert [r.ord for r in dedup.keep_first_content(rows, "c", ["ord"]).orderBy("ord").collect()] == [0, 2, 3]
    assert [r.ord for r in dedup.keep_last(rows, ["k"], "ord").orderBy("ord").collect()] == [1, 2, 4]
    assert [r.unique_id for r in dedup.suffix_repeats(rows.where("k is not null"), "k", "ord").orderBy("ord").collect()] == ["a", "b", "a_2"]


def test_layers_last_wins_and_suffix_order(spark):
    rows = spark.createDataFrame([(0, "p", "c", "t", "short"), (1, "p", "c", "t", "x" * 60), (2, "p", "c", "t", "y" * 200)], "ord int, id string, category string, title string, content string")
    assert [r.id for r in kb.admitted(rows, kb.LEGACY).orderBy("ord").collect()] == ["p", "p_2"]
    assert [r.id for r in kb.admitted(rows, kb.CURATED).orderBy("ord").collect()] == ["p_1", "p_2"]
    both = kb.layered([kb.admitted(rows, kb.STATIC), kb.admitted(rows, kb.LEGACY), kb.admitted(rows, kb.REALTIME)])
    assert {r.id: r.layer for r in both.collect()} == {"p": "realtime", "p_1": "realtime", "p_2": "realtime"}


def test_a_text_is_cleaned_once(spark):
    texts = ["note x\n " + "a  b\t" * 60, "token " * 40, "auf " * 50, "note x", "", None, "token" + "!! " * 60, "token!! " * 3 + "z" * 150, " token" + "q" * 145, "token" + "q" * 144]
    docs = [(i, f"k{i // 2}", (None, "en", "de", "es")[i % 4], "t", t) for i, t in enumerate(texts * 4)]
    passes = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            passes.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame(docs, "ord int, id string, category string, title string, content string").repartition(3)
    words = {"en": ["token"], "de": ["auf"], "es": []}
    found = kb.admitted(rows.mapInArrow(counted, rows.schema), kb.STATIC, ["note[^\n]*"], "!!", words).collect()

    def clean(text):
        return " ".join("".join(line + "\n" for line in ("" if line.startswith("note") else line for line in (text or "").split("\n"))).split())

    held = [(i, k, c, clean(t)) for i, k, c, _, t in docs]
    held = [(i, k, c, t) for i, k, c, t in held if len(t) >= 150 and t.count("!!") / max(len(t) / 1000, 1) <= 2.5 and (not words.get(c) or any(w in t for w in words[c]))]
    first = {k: min(i for i, own, _, _ in held if own == k) for _, k, _, _ in held}
    assert sorted((r.ord, r.id, r.category, r.content) for r in found) == [(i, k if first[k] == i else f"{k}_{i}", c, t) for i, k, c, t in held] and held
    assert passes.value == len(docs)
    # one expression for what is inline, one for white space
    plan = kb.admitted(rows, kb.CURATED, ["note[^\n]*"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 2


def test_merge_keeps_places(spark):
    old = spark.createDataFrame([("a", 0, 1), ("b", 1, 1)], "url string, ord int, v int")
    new = spark.createDataFrame([("b", 0, 2), ("c", 1, 2)], "url string, ord int, v int")
    assert sorted((r.url, r.ord, r.v, r.is_new) for r in kb.merged(old, new, "url", "ord").collect()) == [("a", 0, 1, False), ("b", 1, 2, False), ("c", 1, 2, True)]


def test_rebuild_cleaner(spark):
    docs = spark.createDataFrame([("0", "good title", "메뉴\n본문 바로가기 x\n" + "가" * 90, "https://ok.org/a"), ("0", "ERROR page", "가" * 90, "https://ok.org/b"), ("0", "t", "가" * 90, "https://bad.org/c")], "category string, title string, content string, url string")
    blocked = spark.createDataFrame([("0", "bad.org")], "category string, host string")
    kept = kb.cleaned_documents(docs, kb.Cleaner(line="^본문\\s*바로가기"), html.NO_TITLE, 80, {"0": ["메뉴"]}, blocked).collect()
    assert [r.content for r in kept] == ["메뉴 " + "가" * 90]


MENU = "<table><tr><th>구분<th>대상<th>제1학생회관<th>제2학생회관</tr><tr><td rowspan=2>중식<td>직원<td>국밥<br>김치 9<td>운영안함</tr><tr><td>학생<td>라면<br>ramen<br>밥 1,2<td>돈까스</tr></table>"


def test_tables_fill_forward(spark):
    grid = html.cells(spark.createDataFrame([(1, MENU)], "id int, h string"), "id", "h")
    items = html.menu_table(grid, "id", ["제1학생회관", "제2학생회관"], least=1)
    found = {(r.restaurant, r.meal_type, r.staff_student): r.menu_items for r in items.collect()}
    assert found == {("제1학생회관", "중식", "직원"): ["국밥", "김치 9"], ("제1학생회관", "중식", "학생"): ["라면", "ramen", "밥 1,2"], ("제2학생회관", "중식", "학생"): ["돈까스"]}
    answer = reports.meal_report(items, "점심 뭐야", ["제1학생회관"], "학생생활관", "H", "F").first()["answer"]
    assert answer == "H\n\n【제1학생회관】\n  중식: 라면 / 밥\n\n【제2학생회관】\n  중식: 돈까스\n\nF"
    assert reports.meal_report(items, "저녁 뭐야", [], "", "H", "F").count() == 0


def test_dorm_table_and_board(spark):
    page = "<table><tr><th>날짜<th>아침<th>점심</tr><tr><td>월<td>우유 2<br>우유 2<br>된장국[A] 5.6<td>비빔밥</tr></table>"
    grid = html.cells(spark.createDataFrame([(1, page)], "id int, h string"), "id", "h")
    found = {r.meal_type: r.menu_items for r in html.dorm_table(grid, "id", [("아침", "조식"), ("점심", "중식")], 2).collect()}
    assert found == {"조식": ["우유", "된장국"], "중식": ["비빔밥"]}
    board = '<tr><td><a href="?mode=V&no=12">수강신청 안내문</a><td>2026-06-01</tr><tr><td><a href="?mode=V&no=12">수강신청 안내문</a></tr><tr><td><a href="?mode=V&no=13">짧다</a></tr><tr><td><a href="?mode=V&no=14">장학금 신청 안내</a></tr>'
    posts = html.board_posts(spark.createDataFrame([(1, board)], "id int, h string"), "id", "h").orderBy("rank").collect()
    assert [(r.no, r.date) for r in posts] == [("12", "2026-06-01"), ("14", "")]


def test_links_resolve(spark):
    page = '<a href="/a/#x">1</a><a href="b?c=1">2</a><a href="../up/">3</a><a href="//h.org/z">4</a><a href="https://other.net/q">5</a><a href="mailto:a@b">6</a><a href="/login">7</a>'
    found = html.links(spark.createDataFrame([("https://h.org/d/e/f.html", page)], "url string, h string"), "url", "h", "h.org")
    assert {r.link for r in found.collect()} == {"https://h.org/a", "https://h.org/d/e/b?c=1", "https://h.org/d/up", "https://h.org/z"}


def test_calendar(spark):
    page = "<h3>2026년</h3><h4>3월</h4><ul><li>2(월) 1학기 개강</li><li>제목만</li></ul><h4>6월</h4><ul><li>20(토) 종강</li></ul>"
    found = html.calendar_lines(spark.createDataFrame([(1, page)], "id int, h string"), "id", "h").orderBy("ord").collect()
    assert [(r.year, r.month, r.event) for r in found] == [("2026", "3", "1학기 개강"), ("2026", "6", "종강")]


def test_walk_over_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "url string, link string")
    seeds = spark.createDataFrame([("a",)], "url string")
    assert {r.url: r.depth for r in crawl.walk(edges, seeds, 3).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert crawl.walk(edges, seeds, 9, limit=2).count() == 2
    assert {r.url for r in crawl.walk(edges, seeds, 9, kept=spark.createDataFrame([("b",)], "url string")).collect()} == {"a", "b", "c"}
    assert crawl.walk(edges.limit(0), seeds, 3).count() == 1


def test_filter_or_all_and_latest(spark):
    rows = spark.createDataFrame([("d1", 1), ("d2", 2), ("d2", 3)], "day string, v int")
    assert reports.filter_or_all(rows, F.col("v") > 5).count() == 3 and reports.filter_or_all(rows, F.col("v") > 2).count() == 1
    assert reports.latest_snapshot(rows, "day").count() == 2 and reports.latest_snapshot(rows, "day", "d1").count() == 1
    assert reports.latest_snapshot(rows.limit(0), "day").count() == 0


def test_notice_report(spark):
    items = spark.createDataFrame([(0, "공지사항 목록 요약", "", "b"), (1, "짧음", "", "b"), (2, "일반 안내 사항", "2026-06-01", "일반공지"), (3, "장학금 신청 안내", "", "장학공지")], "ord int, title string, date string, board string")
    assert reports.notice_report(items, "장학 알려줘", "H", "F").first()["answer"] == "H\n\n• [장학공지] 장학금 신청 안내\n• [2026-06-01] [일반공지] 일반 안내 사항\n\nF"
    assert reports.notice_report(items.limit(1), "", "H", "F").count() == 0


def test_post_processing(spark):
    rows = spark.createDataFrame([("안녕하세요! 졸업에는 학점이 많이 필요하니 꼭 확인하시기 바랍니다", "0"), ("짧다", "1"), ("짧다", "9")], "t string, c string")
    found = [r.x for r in rows.select(output.post_processed(F.col("t"), F.col("c"), {"1": "fallback"}, "other", shown={"0": output.Shown(required=("130학점", "130학점이 필요합니다. "))}).alias("x")).collect()]
    assert found == ["130학점이 필요합니다. 졸업에는 학점이 많이 필요하니 꼭 확인하시기 바랍니다", "fallback", "other"]
    general = spark.createDataFrame([("답변입니다",), ("only english words in this text",), ("",)], "t string").select(output.post_processed_general(F.col("t"), F.lit(False), "bad", "none", "!").alias("x"))
    assert [r.x for r in general.collect()] == ["답변입니다!", "bad", "none"]


def test_prompts_and_context(spark):
    table = spark.createDataFrame([("0", "be brief")], "category string, instructions string")
    row = output.prompts(spark.createDataFrame([("0", "q", "ctx"), ("9", "q", None)], "category string, q string, c string"), table, "category", "q", "c").orderBy("category").collect()
    assert row[0].messages[0].content == "be brief" and row[1].messages[0].content == "" and "ctx" in row[0].messages[1].content
    hits = spark.createDataFrame([([("2026-01-01", "a===b"), ("unknown", "c")],)], "h array<struct<date:string,content:string>>")
    assert hits.select(output.context_of(F.col("h")).alias("x")).first()["x"] == "[2026-01-01] ab\n\nc"


def test_sources(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "a.json").write_text(json.dumps({"data": [{"user": " 하나 "}, "둘", {"question": ["셋", {"text": "넷"}]}, {"a": "다섯", "b": ""}, {"n": 1}]}))
    assert [r.question for r in sources.questions(spark, str(tmp_path / "q")).orderBy("ord").collect()] == ["하나", "둘", "셋", "넷", "다섯"]
    (tmp_path / "d.json").write_text(json.dumps([{"doc_id": "x", "title": "t"}, {"id": "y", "category_id": 3}]))
    assert [r.id for r in sources.documents(spark, str(tmp_path / "d.json")).collect()] == ["x", "y"]
    assert sources.documents(spark, str(tmp_path / "none.json")).count() == 0
    with pytest.raises(FileNotFoundError):
        sources.first_existing(spark, [str(tmp_path / "none.json")])
    (tmp_path / "snap" / "meal").mkdir(parents=True)
    (tmp_path / "snap" / "meal" / "2026-06-11.json").write_text(json.dumps({"category": "cafeteria", "date": "2026-06-11", "crawled_at": "x", "items": [{"restaurant": "r", "title": "점심!", "menu_items": ["a"]}, {"restaurant": "s", "title": "저녁", "date": "2026-06-12"}]}))
    items = sources.snapshots(spark, str(tmp_path / "snap"))
    docs = sources.realtime_documents(items.select("source", "snapshot_date", "ord", "item.title", "item.content", "item.date"), {"meal": "cafeteria"})
    assert [r.id for r in docs.orderBy("ord").collect()] == ["realtime_cafeteria_2026-06-11_점심_0", "realtime_cafeteria_2026-06-12_저녁_1"]


def test_versions_and_stream(spark, tmp_path):
    store = sources.Versions(spark, str(tmp_path / "store"))
    assert store.current() is None
    store.upsert(spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 1)], "id string, ord int, v int"), "id", "ord")
    landing = tmp_path / "landing"
    spark.createDataFrame([("b", 5, 9), ("c", 6, 9)], "id string, ord int, v int").write.parquet(str(landing))
    stream = updates.files(spark, str(landing), spark.read.parquet(str(landing)).schema)
    updates.upserts(stream, store, "id", "ord", str(tmp_path / "progress")).awaitTermination()
    assert sorted((r.id, r.v) for r in store.current().collect()) == [("a", 2), ("b", 9), ("c", 9)]
    updates.upserts(stream, store, "id", "ord", str(tmp_path / "progress")).awaitTermination()
    assert store.current().count() == 3
    ran = []
    assert updates.once_a_day(lambda day: day == "x", "y", ran.append) and not updates.once_a_day(lambda day: True, "y", ran.append)
    assert ran == ["y"]


def test_embedding_and_classifier(spark):
    docs = spark.createDataFrame([(1, "a a b", 0.0), (2, "c d", 1.0), (3, "c c d e", 1.0)], "id int, t string, label double")
    vectors = sources.with_embedding(docs, sources.hashing_embedding(8), "t").collect()
    assert [sum(r.embedding) for r in vectors] == [3.0, 2.0, 4.0]
    grown = classify.augment(docs, "label", "id", "t")
    assert {r.label: r["count"] for r in grown.groupBy("label").count().collect()}[1.0] == 2
    model = classify.text_pipeline(docs, "label", "id", "t", rounds=5)
    assert classify.text_predict(model, docs, "id", "t").count() == 3


def test_write_json_to_any_folder(spark, tmp_path):
    assert sources.write_json(spark.range(2), [str(tmp_path / "o")]) == 1
    (tmp_path / "file").write_text("x")
    with pytest.raises(OSError):
        sources.write_json(spark.range(2), [str(tmp_path / "file" / "o")])


def test_external_sources(spark, tmp_path):
    from lodeline.sources import external

    (tmp_path / "a.pdf").write_bytes(b"hello")
    (tmp_path / "b.pdf").write_bytes(b"\xff")
    (tmp_path / "c.txt").write_bytes(b"no")
    found = external.extracted_files(spark, str(tmp_path), lambda b: b.decode()).collect()
    assert sorted((r.path[-5:], r.text) for r in found) == [("a.pdf", "hello"), ("b.pdf", "")]
    urls = spark.createDataFrame([("http://a/1",), ("http://a/1",), ("http://b/2",)], "url string")
    pages = external.fetched(urls, "url", lambda u: None if u.endswith("2") else f"<p>{u}")
    assert sorted((r.url, r.html) for r in pages.collect()) == [("http://a/1", "<p>http://a/1"), ("http://b/2", None)]


def test_registered_functions(spark):
    from lodeline.functions.register import register

    assert "lodeline_host" in register(spark)
    row = spark.sql("select lodeline_normalise('  A　B ') a, lodeline_tokens('Ab c de') b, lodeline_host('https://h.org/x') c, lodeline_safe_id('공지: 1!') d, lodeline_chunks('abcdefg') e").first()
    assert tuple(row) == ("a b", ["ab", "de"], "h.org", "공지1", ["abcde", "fg"])


def test_grid_search_and_ensemble(spark):
    rows = spark.createDataFrame([(i, "aa bb" if i % 2 else "cc dd", float(i % 2)) for i in range(40)], "id int, t string, label double")
    best, scores = classify.grid_search(rows, "label", "id", "t", [1.0, 4.0], held_out=0.4, rounds=5)
    assert best in scores and max(scores.values()) == 1.0
    said = {r.id: r.label for r in classify.ensemble(rows, rows.select("id", "t"), "label", "id", "t", (1, 2), rounds=5).collect()}
    assert all(said[i] == i % 2 for i in range(40))
