"""Queries of reports, small rules, sources and stores, over rows of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodeline.functions import register, rules
from lodeline.operators import answer, crawl, dedup, output, reports
from lodeline.plans.registry import query
from lodeline.plans.routing import TURN
from lodeline.plans.search import LETTERS, letters
from lodeline.session import checkpointed, scratch, table
from lodeline.sources import documents as sources

RESTAURANTS = tuple(f"Brand#{a}{b}" for a in range(1, 6) for b in range(1, 6))


@query("""WITH i AS (SELECT p_partkey AS ord, p_brand AS r, ['조식', '중식', '석식'][p_partkey % 3 + 1] AS m, trim(p_name) AS name FROM part WHERE p_partkey % 2 = 0 AND p_brand <> ''), f AS (SELECT r, min(ord) AS first FROM i GROUP BY r ORDER BY first LIMIT 6),
c AS (SELECT r, m, '밥 / ' || arg_max(name, ord) || ' 국' AS said FROM i GROUP BY r, m), l AS (SELECT r, string_agg('  ' || m || ': ' || said, chr(10) ORDER BY list_position(['조식', '중식', '석식'], m)) AS lines FROM c GROUP BY r)
SELECT 'H' || chr(10) || chr(10) || string_agg('【' || r || '】' || chr(10) || lines || chr(10), chr(10) ORDER BY first) || chr(10) || 'F' AS answer FROM f JOIN l USING (r)""")
def meal_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    meal = F.element_at(F.array(*[F.lit(m) for m in reports.MEALS]), (F.col("p_partkey") % 3 + 1).cast("int"))
    items = F.array(F.lit("밥 1,2"), F.concat(F.trim("p_name"), F.lit(" 국 3")), F.lit("soup"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("restaurant"), meal.alias("meal_type"), F.when(F.col("p_partkey") % 2 == 0, "학생").otherwise("직원").alias("staff_student"), items.alias("menu_items"))
    return reports.meal_report(rows, "오늘 메뉴", RESTAURANTS, "기숙사", "H", "F")


@query("""WITH i AS (SELECT p_partkey AS ord, p_brand AS r, trim(p_name) AS name FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 = 1 AND p_brand = 'Brand#11'), a AS (SELECT p_partkey AS ord, p_brand AS r, trim(p_name) AS name FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 = 1 AND NOT EXISTS (SELECT 1 FROM part WHERE p_partkey % 2 = 0 AND p_brand = 'Brand#11')),
u AS (SELECT * FROM i UNION ALL SELECT * FROM a), f AS (SELECT r, min(ord) AS first, arg_max(name, ord) AS name FROM u GROUP BY r ORDER BY first LIMIT 6) SELECT 'H' || chr(10) || chr(10) || string_agg('【' || r || '】' || chr(10) || '  중식: 밥 / ' || name || ' 국' || chr(10), chr(10) ORDER BY first) || chr(10) || 'F' AS answer FROM f HAVING count(*) > 0""")
def meal_report_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question that names a restaurant and a meal."""
    items = F.array(F.lit("밥 1,2"), F.concat(F.trim("p_name"), F.lit(" 국 3")), F.lit("soup"))
    meal = F.element_at(F.array(*[F.lit(m) for m in reports.MEALS]), (F.col("p_partkey") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("restaurant"), meal.alias("meal_type"), F.when(F.col("p_partkey") % 2 == 0, "학생").otherwise("직원").alias("staff_student"), items.alias("menu_items"))
    return reports.meal_report(rows, "Brand#11 점심 알려줘", RESTAURANTS, "기숙사", "H", "F")


@query("""WITH n AS (SELECT doc_id AS ord, trim(substr(string_split(text, chr(10))[1], 1, 60)) AS title, CASE WHEN doc_id % 2 = 0 THEN '2026-06-1' || (doc_id % 10) ELSE '' END AS date, CASE WHEN doc_id % 9 = 0 THEN '장학공지' ELSE source END AS board FROM documents), r AS (SELECT * FROM n WHERE title <> '' AND length(title) >= 5 AND NOT contains(title, 'Summary')),
l AS (SELECT *, contains(board, '장학') OR contains(lower(title), '장학') AS fits FROM r), t AS (SELECT * FROM l ORDER BY fits DESC, ord LIMIT 10) SELECT 'H' || chr(10) || chr(10) || string_agg(CASE WHEN date <> '' THEN '• [' || date || '] [' || board || '] ' || title ELSE '• [' || board || '] ' || title END, chr(10) ORDER BY fits DESC, ord) || chr(10) || chr(10) || 'F' AS answer FROM t HAVING count(*) > 0""")
def notice_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("2026-06-1"), (F.col("doc_id") % 10).cast("string"))).otherwise("")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.trim(F.substring(F.substring_index("text", "\n", 1), 1, 60)).alias("title"), date.alias("date"), F.when(F.col("doc_id") % 9 == 0, "장학공지").otherwise(F.col("source")).alias("board"))
    return reports.notice_report(rows, "장학 공지 알려줘", "H", "F", "Summary")


@query(f"WITH u AS (SELECT {TURN} AS qid FROM conversations) SELECT qid, CASE WHEN qid % 2 = 0 THEN 'a' || qid WHEN qid % 3 = 0 THEN 'b' || qid WHEN qid % 5 > 0 THEN 'c' END AS answer, CASE WHEN qid % 2 = 0 THEN 'first' WHEN qid % 3 = 0 THEN 'second' WHEN qid % 5 > 0 THEN 'third' END AS how FROM u")
def fallback_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "conversations").select(F.expr(TURN).alias("qid"))
    said = lambda where, value: u.select("qid", F.when(F.expr(where), value).alias("answer"))
    own = lambda mark: F.concat(F.lit(mark), F.col("qid").cast("string"))
    return answer.first_answer(u, "qid", [("first", said("qid % 2 = 0", own("a"))), ("second", said("qid % 3 = 0", own("b"))), ("third", said("qid % 5 > 0", F.lit("c")))])


_PIECE = "trim(regexp_replace(substr(text, 1, 60), '\\s+', ' ', 'g'))"


@query(f"""WITH t AS (SELECT {TURN} AS qid, conv_id, CASE conv_id % 4 WHEN 0 THEN '' WHEN 1 THEN '답변입니다 ' ELSE {_PIECE} END || CASE conv_id % 3 WHEN 0 THEN '' ELSE ' [질문] again' END AS t, conv_id % 2 = 0 AS web FROM conversations), o AS (SELECT *, trim(regexp_replace(t, '\\[질문\\].*', '')) AS o FROM t)
SELECT qid, CASE WHEN length(o) > 20 AND NOT contains(o, '답변') THEN 'failed' WHEN o = '' THEN 'empty' WHEN web THEN o ELSE o || ' (note)' END AS shown FROM o""")
def general_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    piece = F.trim(F.regexp_replace(F.substring("text", 1, 60), r"\s+", " "))
    said = F.concat(F.when(F.col("conv_id") % 4 == 0, "").when(F.col("conv_id") % 4 == 1, "답변입니다 ").otherwise(piece), F.when(F.col("conv_id") % 3 == 0, "").otherwise(" [질문] again"))
    rows = table(spark, sf_dir, "conversations").select(F.expr(TURN).alias("qid"), said.alias("t"), (F.col("conv_id") % 2 == 0).alias("web"))
    return rows.select("qid", output.post_processed_general(F.col("t"), F.col("web"), "failed", "empty", " (note)").alias("shown"))


#: What is appended to questions, and what becomes of it.
SHORT = ((" 2학생회관 메뉴", " 제2학생회관 메뉴"), (" 제3학생회관", " 제3학생회관"), (" 1학 뭐야", " 제1학생회관 뭐야"), (" 12학", " 12학"), (" 중도 자리", " 중앙도서관 자리"), (" 우리중도", " 우리중도"), (" 컴공 졸업", " 컴퓨터공학 졸업"), ("", ""))


@query(f"SELECT {TURN} AS qid, trim(trim(text) || ([{', '.join(repr(b) for _, b in SHORT)}])[({TURN}) % {len(SHORT)} + 1]) AS question FROM conversations")
def written_out_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.element_at(F.array(*[F.lit(a) for a, _ in SHORT]), (F.expr(TURN) % len(SHORT) + 1).cast("int"))
    rows = table(spark, sf_dir, "conversations").select(F.expr(TURN).alias("qid"), F.concat(F.trim("text"), ending).alias("t"))
    return rows.select("qid", rules.normalise_question(F.col("t"), [("컴공 ", "컴퓨터공학 ")]).alias("question"))


_HITS = "h AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k, doc_id, source, string_split(text, chr(10))[1] AS title FROM documents)"


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.first_n(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.substring_index("text", "\n", 1).alias("title")), ["lang"], ["doc_id"], 4)
    hit = F.struct("doc_id", F.col("source").alias("layer"), "title", F.col("title").alias("content"), (F.col("doc_id") % 7 == 0).alias("is_realtime"))
    return rows.groupBy("lang").agg(F.array_sort(F.collect_list(hit)).alias("hits"))


@query(f"WITH {_HITS} SELECT lang, string_agg('[' || source || '] ' || title || chr(10) || title, chr(10) || chr(10) ORDER BY k) FILTER (k <= 3) AS context, 'said' || CASE WHEN bool_or(doc_id % 7 = 0) THEN ' (now)' ELSE '' END AS answer FROM h WHERE k <= 4 GROUP BY lang")
def tagged_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("lang", output.tagged_context(F.col("hits")).alias("context"), output.with_source(F.lit("said"), F.col("hits"), " (now)").alias("answer"))


@query(f"SELECT {TURN} AS qid, CASE role WHEN 'user' THEN 'be brief' ELSE '' END AS system, '[참고정보]' || chr(10) || substr(text, 1, 20) || chr(10) || chr(10) || '[질문]' || chr(10) || text AS prompt FROM conversations")
def prompt_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = spark.createDataFrame([("user", "be brief")], "category string, instructions string")
    rows = table(spark, sf_dir, "conversations").select(F.expr(TURN).alias("qid"), "role", "text", F.substring("text", 1, 20).alias("context"))
    m = output.prompts(rows, told, "role", "text", "context")
    return m.select("qid", F.col("messages")[0]["content"].alias("system"), F.col("messages")[1]["content"].alias("prompt"))


#: Phrases and the label that the cascade of six rules gives them.
PHRASES = ((" 학교 오는 방법", 4), (" 수강신청 언제", 2), (" 수강신청 졸업", None), (" 학식 몇 시", 3), (" 식당 운영", None), (" 기숙사 신청", 1), (" 기숙사 밥", None), (" 특강 안내", 1), (" 도서관 자리", 1), (" 도서관 버스", None), ("", None))


@query(f"SELECT {TURN} AS qid, ([{', '.join('NULL' if n is None else str(n) for _, n in PHRASES)}])[({TURN}) % {len(PHRASES)} + 1]::INT AS label FROM conversations")
def short_override_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.element_at(F.array(*[F.lit(a) for a, _ in PHRASES]), (F.expr(TURN) % len(PHRASES) + 1).cast("int"))
    rows = table(spark, sf_dir, "conversations").select(F.expr(TURN).alias("qid"), F.concat(F.lower("text"), ending).alias("t"))
    return rows.select("qid", rules.cascade(F.col("t"), rules.short_override_rules()).alias("label"))


NAMES = (("LABEL_3", 3), ("notice", 1), ("label 9", 0), ("2", 2), ("", 0), (None, 0), ("x42", 0))


@query(f"SELECT {TURN} AS qid, ([{', '.join(str(n) for _, n in NAMES)}])[({TURN}) % {len(NAMES)} + 1]::INT AS label FROM conversations")
def label_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(a) for a, _ in NAMES]), (F.expr(TURN) % len(NAMES) + 1).cast("int"))
    rows = table(spark, sf_dir, "conversations").select(F.expr(TURN).alias("qid"), name.alias("n"))
    return rows.select("qid", answer.label_of(F.col("n"), {"graduation": 0, "notice": 1, "schedule": 2, "meal": 3, "shuttle": 4}).alias("label"))


@query("SELECT doc_id::VARCHAR AS id, source AS title, md5(text) AS digest, (doc_id % 5)::INT AS category_id FROM documents")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON and read again; some have their id under its other name."""
    own = F.col("doc_id").cast("string")
    rows = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 2 == 0, own).alias("id"), F.when(F.col("doc_id") % 2 == 1, own).alias("doc_id"), F.col("source").alias("title"), F.col("text").alias("content"), (F.col("doc_id") % 5).cast("int").alias("category_id"))
    with scratch(spark) as path:
        rows.write.json(f"{path}/docs")
        read = sources.documents(spark, sources.first_existing(spark, [f"{path}/none", f"{path}/docs"]), multiline=False)
        return checkpointed(read.select("id", "title", F.md5("content").alias("digest"), "category_id"))


@query("SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%d') AS date FROM events WHERE event_id % 3 > 0 OR day(ts) % 2 = 0")
def daily_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily partitions, the odd days of which are written again without a third of their rows."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("date"), F.dayofmonth("ts").alias("d"))
    with scratch(spark) as path:
        sources.write_daily(rows.drop("d"), f"{path}/days", ("date",))
        sources.write_daily(rows.where("d % 2 = 1 AND event_id % 3 > 0").drop("d"), f"{path}/days", ("date",))
        # odd days whose rows are all left out keep what they had
        held = spark.read.schema("event_id bigint, user_id bigint, event_type string, date string").parquet(f"{path}/days")
        return checkpointed(held)


@query("SELECT doc_id, string_split(text, chr(10))[1] AS title, CASE WHEN contains(text, chr(10)) THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS content FROM documents WHERE doc_id % 4 <> 1")
def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that is rebuilt with fewer rows: the second version alone is read, and split into titles and contents."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("document"))
    with scratch(spark) as path:
        store = sources.Versions(spark, f"{path}/store")
        store.write(rows)
        number = store.write(rows.where("doc_id % 4 <> 1"))
        return checkpointed(sources.stored(spark, f"{path}/store/v{number}").select("doc_id", "title", "content"))


@query(f"SELECT {TURN} AS qid, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS norm, array_to_string(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]{{2,}}'), ' ') AS tokens, substr(md5(text), 1, 12) AS hash FROM conversations")
def registered_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    register.register(spark)
    return table(spark, sf_dir, "conversations").select(F.expr(TURN).alias("qid"), F.expr("lodeline_normalise(text)").alias("norm"), F.expr("array_join(lodeline_tokens(text), ' ')").alias("tokens"), F.expr("lodeline_content_hash(text)").alias("hash"))


@query("""WITH e AS (SELECT DISTINCT 'c' || o_custkey AS url, 'c' || (o_custkey + 1 + o_orderkey % 3) AS link FROM orders), s AS (SELECT DISTINCT url FROM e WHERE substr(url, 2)::BIGINT % 50 = 1), k AS (SELECT url FROM e WHERE substr(url, 2)::BIGINT % 2 = 0),
d1 AS (SELECT DISTINCT link AS url FROM s JOIN e USING (url) WHERE link NOT IN (SELECT url FROM s)), d2 AS (SELECT DISTINCT e.link AS url FROM d1 JOIN e USING (url) WHERE d1.url IN (SELECT url FROM k) AND e.link NOT IN (SELECT url FROM s) AND e.link NOT IN (SELECT url FROM d1))
SELECT url, 0 AS depth FROM s UNION ALL SELECT url, 1 FROM d1 UNION ALL SELECT url, 2 FROM d2""")
def gated_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk over customers' orders on which, after the seeds, pages of even number alone pass on their links."""
    rows = table(spark, sf_dir, "orders")
    name = lambda c: F.concat(F.lit("c"), c.cast("string"))
    edges = rows.select(name(F.col("o_custkey")).alias("url"), name(F.col("o_custkey") + 1 + F.col("o_orderkey") % 3).alias("link")).distinct()
    number = F.substring("url", 2, 20).cast("bigint")
    return crawl.walk(edges, edges.where(number % 50 == 1), 2, kept=edges.where(number % 2 == 0).select("url").distinct()).select("url", "depth")


SEEDS = [{"title": "Routes", "content": "The shuttle runs on weekdays.", "category_id": 4}, {"id": "hours", "title": "Hours", "content": "Open from nine.", "date": "2026-01-02"}, {"id": "again", "title": "Hours", "content": "Open from nine."}]


@query("""WITH s AS (SELECT 'static_' || substr(md5('Routes' || chr(10) || 'The shuttle runs on weekdays.'), 1, 12) AS id, 'The shuttle runs on weekdays.' AS content, '2026-06-10' AS date, 0 AS k UNION ALL SELECT 'hours', 'Open from nine.', '2026-01-02', 1 UNION ALL SELECT 'd' || doc_id, text, '', doc_id + 10 FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY substr(md5(content), 1, 12) ORDER BY k) AS n FROM s) SELECT id, date FROM r WHERE n = 1""")
def seeded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after some that are written by hand; of equal contents the first stays."""
    seeds = sources.static_documents(spark, SEEDS, "2026-06-10").select("id", "content", "date", F.when(F.col("id") == "hours", 1).when(F.col("id") == "again", 2).otherwise(0).cast("bigint").alias("k"))
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("content"), F.lit("").alias("date"), (F.col("doc_id") + 10).alias("k"))
    return dedup.keep_first_content(seeds.unionByName(docs), "content", ["k"]).select("id", "date")


@query("SELECT doc_id, " + " || ',' || ".join(f"(length(lower(text)) - length(replace(lower(text), '{c}', '')))" for c in LETTERS) + " AS vector FROM documents")
def letter_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by a pluggable function of the text."""
    found = sources.with_embedding(table(spark, sf_dir, "documents").select("doc_id", "text"), letters, "text")
    return found.select("doc_id", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",").alias("vector"))
