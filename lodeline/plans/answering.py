"""Queries of the way from a question to an answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodeline.functions import rules
from lodeline.operators import answer, classify, output
from lodeline.plans import learning, routing
from lodeline.plans.registry import query
from lodeline.session import table

_PF = f"""g AS (SELECT qid, gram, count(*) AS n FROM ({learning._grams("fu", "qid")}) GROUP BY ALL), p AS (SELECT label, gram, sum(w)::DOUBLE AS weight FROM (SELECT label, w, unnest(gs) AS gram FROM (SELECT label, w, list_concat(list_concat(list_transform(generate_series(1, length(kw) - 1), lambda i: substr(kw, i, 2)), list_transform(generate_series(1, length(kw) - 2), lambda i: substr(kw, i, 3))), list_concat(list_transform(generate_series(1, length(kw) - 3), lambda i: substr(kw, i, 4)), [kw, kw])) AS gs FROM lx)) GROUP BY ALL),
gn AS (SELECT qid, sqrt(sum(n * n)) AS a FROM g GROUP BY qid), pn AS (SELECT label, sqrt(sum(weight * weight)) AS b FROM p GROUP BY label),
c AS (SELECT qid, label, sum(n * weight) / (any_value(a) * any_value(b)) AS cosine FROM g JOIN p USING (gram) JOIN gn USING (qid) JOIN pn USING (label) GROUP BY ALL)"""


@query(
    f"""WITH {routing._LEX}, ov AS (SELECT qid, norm, {routing._cascade_sql()} AS label FROM u), fu AS (SELECT u.qid, u.norm, replace(u.norm, ' ', '') AS flat FROM u JOIN ov USING (qid) WHERE ov.label IS NULL), {_PF},
t AS (SELECT sc.qid, sc.label, round(sc.score + 8.0 * coalesce(c.cosine, 0.0) + CASE WHEN sc.label = 1 AND contains(fu.norm, 'be') AND NOT contains(fu.norm, 'er') THEN 1.5 ELSE 0.0 END, 6) AS score FROM sc JOIN fu USING (qid) LEFT JOIN c ON c.qid = sc.qid AND c.label = sc.label),
b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, label) AS n, sum(greatest(score, 0)) OVER (PARTITION BY qid) AS total FROM t)
SELECT qid, label::INT AS label, 0.99::DOUBLE AS score, 'override' AS how FROM ov WHERE label IS NOT NULL UNION ALL SELECT qid, label::INT, round(CASE WHEN total > 0 THEN score / total ELSE 0 END, 5), 'keyword' FROM b WHERE n = 1"""
)
def classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = rules.lexicon(spark, routing.LEXICON)
    none = spark.createDataFrame([], "label int, id int, text string")
    centroids = classify.profiles(none, "label", "id", "text", words)
    norm = F.lower("text")
    request = F.contains(norm, F.lit("be")) & ~F.contains(norm, F.lit("er"))
    found = answer.classified(routing.turns(spark, sf_dir), "qid", "text", routing.CASCADE, words, centroids, list(routing.LEXICON), request)
    return found.withColumn("score", F.round("score", 5))


GATES = [answer.Gate("meal", (("thinner", "hation"),), (("the",), ("of",))), answer.Gate("notice", (("then", "inge"),))]


@query(f"""WITH u AS (SELECT {routing.TURN} AS qid, text FROM conversations WHERE role = 'user'), m AS (SELECT qid, 'm' || (qid % 7) AS a FROM u WHERE qid % 2 = 0 AND (contains(text, 'thinner') OR contains(text, 'hation')) AND NOT (contains(text, 'the') AND contains(text, 'of'))),
n AS (SELECT qid, 'n' || (qid % 5) AS a FROM u WHERE qid % 3 > 0 AND (contains(text, 'then') OR contains(text, 'inge'))), l AS (SELECT qid, 'c' AS a FROM u WHERE qid % 5 > 0)
SELECT u.qid, coalesce(m.a, n.a, l.a) AS answer, CASE WHEN m.a IS NOT NULL THEN 'meal' WHEN n.a IS NOT NULL THEN 'notice' WHEN l.a IS NOT NULL THEN 'curated' END AS how FROM u LEFT JOIN m USING (qid) LEFT JOIN n USING (qid) LEFT JOIN l USING (qid)""")
def dispatch_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = routing.turns(spark, sf_dir)
    said = lambda mark, n: F.concat(F.lit(mark), (F.col("qid") % n).cast("string")).alias("answer")
    answers = {"meal": u.where("qid % 2 = 0").select("qid", said("m", 7)), "notice": u.where("qid % 3 > 0").select("qid", said("n", 5))}
    return answer.dispatched(u, "qid", "text", GATES, answers, u.where("qid % 5 > 0").select("qid", F.lit("c").alias("answer")))


@query("""WITH q AS (SELECT item_id, regexp_extract(text, '([A-Za-z]+(?:tion|ing))', 1) AS name FROM benchmark), p AS (SELECT q.item_id, doc_id, row_number() OVER (PARTITION BY q.item_id ORDER BY CASE WHEN starts_with(doc_id::VARCHAR, '1') THEN 0 ELSE 1 END, doc_id) AS n
FROM q JOIN (SELECT doc_id, string_split(text, chr(10))[1] AS title FROM documents) d ON length(name) >= 3 AND contains(title, name)) SELECT item_id, doc_id FROM p WHERE n = 1""")
def department_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select("item_id", answer.department_of(F.col("text"), ("tion", "ing"), 3, "A-Za-z").alias("name"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"))
    return answer.department_pages(q, d, "item_id", "name", "doc_id", "title", "doc_id", "1")


@query("""SELECT conv_id, turn, array_to_string(list_filter(['category=' || cat, 'department=' || CASE WHEN cat IN ('graduation', 'notice') THEN coalesce(dep, CASE WHEN cat = 'graduation' AND maj IS NULL THEN 'common' END) END, 'major_type=' || CASE WHEN cat = 'graduation' THEN maj END, 'stop=' || CASE WHEN cat = 'shuttle' THEN st END, 'year=' || yr], lambda x: x IS NOT NULL), ';') AS wanted
FROM (SELECT *, CASE conv_id % 3 WHEN 0 THEN 'graduation' WHEN 1 THEN 'notice' ELSE 'shuttle' END AS cat, CASE WHEN contains(text, 'thinner') THEN 'd1' END AS dep, CASE WHEN contains(text, 'hation') THEN 'm1' END AS maj, CASE WHEN contains(text, 'and') THEN 's1' END AS st, CASE WHEN turn > 2 THEN '2026' END AS yr FROM conversations)""")
def metadata_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = lambda word, value: F.when(F.contains("text", F.lit(word)), F.lit(value))
    category = F.when(F.col("conv_id") % 3 == 0, "graduation").when(F.col("conv_id") % 3 == 1, "notice").otherwise("shuttle")
    found = {"department": has("thinner", "d1"), "major_type": has("hation", "m1"), "stop": has("and", "s1"), "year": F.when(F.col("turn") > 2, "2026")}
    wanted = answer.metadata_filter(category, found, "common")
    pairs = F.array_join(F.transform(F.map_entries(wanted), lambda p: F.concat(p["key"], F.lit("="), p["value"])), ";")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", pairs.alias("wanted"))


@query("""SELECT page_id, CASE WHEN contains(url, '/fr/') THEN 'CALENDAR' WHEN contains(url, 'blog') THEN 'BLOG' ELSE 'p' || page_id END AS id, CASE WHEN contains(url, '/fr/') THEN 'Calendar' WHEN contains(url, 'blog') THEN 'Blog' ELSE url END AS title FROM pages""")
def authority_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("url").alias("title"), "url")
    return answer.authoritative(pages, "url", [("/fr/", "CALENDAR", "Calendar"), ("blog", "BLOG", "Blog")]).select("page_id", "id", "title")


#: What is appended to every turn by its id, so that each pattern has hits and near misses.
ENDINGS = (
    "", " 축하합니다", " B. 6월", " 선택 문제", " 답안 :", " C. 다음", " 청계천 근처", " 관광객 안내", " 이 방법은 좋은 국제 교류", " 30% 응답", " 강남 캠퍼스", " 2호선과 연결", " 해당 학교 데이터베이스에 정보가 없습니다 https://www.",
    " academic QUARTER", " Cal-리포트", " 분기 일정에 대한 정보", " 이번 quarter 일정", " 시즌 2", " 국제문화 회관 2024", " 근처이나 오랜만", " 축하 합니다", " E. 6월", " quarters", " 시즌", " 새 정 안내", " 6월 10일 시즌", " 분기 2026년 3월",
)
_ENDED = f"e AS (SELECT {routing.TURN} AS qid, lower(substr(text, 1, 40)) || ([{', '.join(repr(x) for x in ENDINGS)}])[({routing.TURN}) % {len(ENDINGS)} + 1] AS t FROM conversations)"


def _ended(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.expr(routing.TURN) % len(ENDINGS) + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select(F.expr(routing.TURN).alias("qid"), F.concat(F.lower(F.substring("text", 1, 40)), ending).alias("t"))


@query(
    f"""WITH {_ENDED} SELECT qid, (regexp_matches(t, '(?i)축하합니다') OR regexp_matches(t, '(?i)[A-D]\\.\\s+\\d+월') OR regexp_matches(t, '선택\\s*문제') OR regexp_matches(t, '답안\\s*:') OR regexp_matches(t, '(?i)[A-D]\\.\\s+[가-힣]') OR contains(t, '청계천') OR contains(t, '관광객')
OR regexp_matches(t, '(이 방법|이 서비스).{{0,30}}국제') OR regexp_matches(t, '\\d+%\\s*(선택|응답|비율)') OR regexp_matches(t, '신안산|보수원|청계|한강|강남|강북|종로') OR regexp_matches(t, '(?i)(line|호선).{{0,20}}연결') OR regexp_matches(t, '해당.{{0,20}}데이터베이스.{{0,20}}없습니다.{{0,30}}www\\.')
OR regexp_matches(t, '(?i)academic quarter') OR contains(t, 'Cal-리포트') OR regexp_matches(t, '분기.*대한 정보') OR regexp_matches(t, '(?i)(^|[^\\p{{L}}\\p{{N}}_])quarter($|[^\\p{{L}}\\p{{N}}_])') OR regexp_matches(t, '시즌 \\d') OR regexp_matches(t, '국제문화.*회관.*\\d{{4}}') OR regexp_matches(t, '근처이나.*오랜만')) AS junk,
(NOT regexp_matches(t, '\\d{{4}}년\\s*\\d{{1,2}}월|\\d{{1,2}}월\\s*\\d{{1,2}}일|\\d{{2}}\\.\\d{{2}}') AND regexp_matches(t, '[A-Za-z]{{5,}}|시즌|새 정 |분기')) AS undated FROM e"""
)
def junk_and_undated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ended(spark, sf_dir).select("qid", rules.untrusted(F.col("t"), most=10**6, least=0).alias("junk"), rules.undated(F.col("t")).alias("undated"))


#: Rules of categories, with words that the turns have.
SHOWN = {
    "0": output.Shown(required=("the", "The rest: "), until="and"),
    "1": output.Shown(dated=True),
    "2": output.Shown(about=(("tion", "ing"), "Nothing is said.")),
    "3": output.Shown(foreign=True, stale=(("on", "en"), "th", "No news.")),
}


@query(f"""WITH t AS (SELECT {routing.TURN} AS qid, (conv_id % 4)::VARCHAR AS c, substr(text, 1, conv_id % 90) || CASE WHEN conv_id % 3 = 0 THEN ' 안내 드립니다 확인 바랍니다 여기 저기' ELSE '' END AS t FROM conversations), r AS (SELECT *, CASE WHEN contains(t, 'the') THEN t ELSE 'The rest: ' || t END AS q FROM t),
s AS (SELECT qid, CASE c WHEN '0' THEN CASE WHEN instr(q, 'and') > 0 THEN substr(q, 1, instr(q, 'and') + 2) ELSE q END WHEN '2' THEN CASE WHEN t <> '' AND NOT contains(t, 'tion') AND NOT contains(t, 'ing') THEN 'Nothing is said.' ELSE t END
WHEN '3' THEN CASE WHEN len(list_filter(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Za-z]{{5,}}'))) > 2 OR (len(list_filter(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Za-z]{{5,}}'))) > 0 AND len(regexp_extract_all(t, '[가-힣]{{2,}}')) < 2 * len(list_filter(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Za-z]{{5,}}')))) THEN '' WHEN contains(t, 'on') AND contains(t, 'en') AND NOT contains(t, 'th') THEN 'No news.' ELSE t END ELSE t END AS shown FROM r) SELECT qid, shown FROM s""")
def category_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.substr("text", F.lit(1), (F.col("conv_id") % 90).cast("int")), F.when(F.col("conv_id") % 3 == 0, " 안내 드립니다 확인 바랍니다 여기 저기").otherwise(""))
    rows = table(spark, sf_dir, "conversations").select(F.expr(routing.TURN).alias("qid"), (F.col("conv_id") % 4).cast("string").alias("c"), said.alias("t"))
    shown = F.col("t")
    for name, held in SHOWN.items():
        shown = F.when(F.col("c") == name, held.apply(F.col("t"))).otherwise(shown)
    return rows.select("qid", shown.alias("shown"))


ASKED = ("", " 수도는 어디야", " 인구", " 경영학과가 뭐야", " 전공 소개", " 학과", " 몇 층", " 뭐야", " 학부에서 배워", " 얼마")
_ASKED = f"a AS (SELECT {routing.TURN} AS qid, text || ([{', '.join(repr(x) for x in ASKED)}])[({routing.TURN}) % {len(ASKED)} + 1] AS t FROM conversations WHERE role = 'user')"
_ANY = lambda words: "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


@query(f"WITH {_ASKED} SELECT qid, {_ANY(rules.FACTUAL)} AS factual, {_ANY(rules.DEPARTMENT_SUFFIXES)} AND {_ANY(rules.DEPARTMENT_WORDS)} AS department FROM a")
def question_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, ASKED)), (F.col("qid") % len(ASKED) + 1).cast("int"))
    rows = routing.turns(spark, sf_dir).select("qid", F.concat("text", ending).alias("t"))
    return rows.select("qid", rules.factual(F.col("t")).alias("factual"), rules.asks_department(F.col("t")).alias("department"))
