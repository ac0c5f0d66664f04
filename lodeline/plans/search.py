"""Queries of hybrid retrieval: postings, BM25, nearest vectors, fusion, boosts, guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodeline.operators import retrieval, vectors
from lodeline.plans.registry import query
from lodeline.session import checkpointed, scratch, spread, table

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def category_of(text: Column) -> Column:
    """The category of a question, by the letters that only one language here has."""
    return F.when(text.rlike("[êèç]"), "fr").when(text.rlike("[äöüß]"), "de").when(text.rlike("[ñóí]"), "es").otherwise("en")


def letters(text: Column) -> Column:
    """A vector that both engines can compute: how often each Latin letter occurs."""
    lower = F.lower(text)
    return F.array(*[(F.length(lower) - F.length(F.replace(lower, F.lit(c), F.lit("")))).cast("float") for c in LETTERS])


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").withColumn("category", category_of(F.col("text")))


def title(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.index(spread(table(spark, sf_dir, "documents")), "doc_id", "text", "lang")
    q = questions(spark, sf_dir)
    return retrieval.bm25(found, q, "item_id", "text", category="category")


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", F.col("lang").alias("category"), letters(F.col("text")).alias("v"))
    q = questions(spark, sf_dir).select("item_id", "category", letters(F.col("text")).alias("qv"))
    return vectors.nearest(docs, q, "doc_id", "v", "category", "item_id", "qv")


PRIORITIES = [("thinner", 3), ("than", 7), ("then", 7), ("with", 11), ("las", 22), ("den", 20), ("les", 10), ("with", 999_999_999)]


def _boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "lang", title(F.col("text")).alias("title"))
    q = questions(spark, sf_dir)
    by_word = retrieval.priority_hits(q, spark.createDataFrame(PRIORITIES, "keyword string, target bigint"), docs, "doc_id", "item_id", "text")
    by_title = retrieval.title_hits(docs, q, "doc_id", "title", "item_id", "text", least=12, category=("lang", "category"))
    return by_word.unionByName(by_title.select("query_id", "id"))


_T = "[\\p{L}\\p{N}]{2,}"
_Q = "q AS (SELECT item_id, text, CASE WHEN regexp_matches(text, '[êèç]') THEN 'fr' WHEN regexp_matches(text, '[äöüß]') THEN 'de' WHEN regexp_matches(text, '[ñóí]') THEN 'es' ELSE 'en' END AS category FROM benchmark)"
_BM = (
    _Q
    + f""", terms AS (SELECT lang AS category, doc_id AS id, unnest(regexp_extract_all(lower(text), '{_T}')) AS term FROM documents),
tf AS (SELECT category, id, term, count(*) AS tf FROM terms GROUP BY ALL),
st AS (SELECT lang AS category, doc_id AS id, len(regexp_extract_all(lower(text), '{_T}')) AS dl FROM documents),
col AS (SELECT category, count(*) AS n, avg(dl) AS avgdl FROM st GROUP BY category),
df AS (SELECT category, term, count(*) AS df FROM tf GROUP BY ALL),
raw AS (SELECT df.category, term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df JOIN col USING (category)),
mean AS (SELECT category, avg(raw) AS mean FROM raw GROUP BY category),
idf AS (SELECT raw.category, term, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM raw JOIN mean USING (category)),
asked AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '{_T}')) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT query_id, tf.category, tf.id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) * times), 6) AS score
  FROM asked JOIN tf USING (term) JOIN idf ON idf.category = tf.category AND idf.term = tf.term JOIN st ON st.category = tf.category AND st.id = tf.id JOIN col ON col.category = tf.category GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, category ORDER BY score DESC, id) - 1 AS rank FROM sc),
sparse AS (SELECT rk.query_id, rk.category, rk.id, rk.score, rk.rank FROM rk JOIN q ON q.item_id = rk.query_id AND q.category = rk.category WHERE rank < 15 AND score > 0)"""
)


def _vec(t: str) -> str:
    return "[" + ", ".join(f"length({t}) - length(replace({t}, '{c}', ''))" for c in LETTERS) + "]::DOUBLE[]"


_DN = f"""dv AS (SELECT doc_id AS id, lang AS category, {_vec("lower(text)")} AS v FROM documents), qv AS (SELECT item_id AS query_id, category, {_vec("lower(text)")} AS qv FROM q),
ds AS (SELECT query_id, category, id, CASE WHEN list_dot_product(v, v) > 0 AND list_dot_product(qv, qv) > 0 THEN round(list_dot_product(v, qv) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(qv, qv))), 6) END AS similarity FROM dv JOIN qv USING (category)),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id, category ORDER BY similarity DESC NULLS LAST, id) - 1 AS rank FROM ds), dense AS (SELECT * FROM dr WHERE rank < 15 AND similarity IS NOT NULL)"""
_FU = _BM + ", " + _DN + ", fused AS (SELECT query_id, id, sum(part) AS score FROM (SELECT query_id, id, 1.2 / (60 + rank) AS part FROM dense UNION ALL SELECT query_id, id, 1.0 / (60 + rank) FROM sparse) GROUP BY ALL)"
_BO = (
    _FU
    + ", pr AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{k}', {t})" for k, t in PRIORITIES)
    + f""") AS p(keyword, target)), bw AS (SELECT item_id AS query_id, target AS id FROM q JOIN pr ON contains(text, keyword) WHERE target IN (SELECT doc_id FROM documents)),
ti AS (SELECT doc_id AS id, lang, lower(string_split(text, chr(10))[1]) AS title FROM documents),
bt AS (SELECT item_id AS query_id, id FROM (SELECT item_id, category, regexp_extract_all(lower(text), '{_T}') AS ts FROM q) JOIN ti ON ti.lang = category WHERE len(list_filter(ts, lambda t: contains(title, t))) >= 12),
bn AS (SELECT query_id, id, count(*) AS n FROM (SELECT * FROM bw UNION ALL SELECT * FROM bt) GROUP BY ALL),
boosted AS (SELECT coalesce(f.query_id, b.query_id) AS query_id, coalesce(f.id, b.id) AS id, round(CASE WHEN f.score IS NOT NULL THEN f.score * pow(2.0, coalesce(n, 0)) ELSE 0.05 * pow(2.0, n - 1) END, 9) AS score, coalesce(n, 0)::BIGINT AS n_boosts
  FROM fused f FULL OUTER JOIN bn b ON f.query_id = b.query_id AND f.id = b.id)"""
)


@query(f"WITH st AS (SELECT lang AS category, len(regexp_extract_all(lower(text), '{_T}')) AS dl FROM documents) SELECT category, count(*)::BIGINT AS n, round(avg(dl), 6) AS avgdl FROM st GROUP BY category")
def doc_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.index(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    return retrieval.collection(found).select("category", "n", F.round("avgdl", 6).alias("avgdl"))


@query(f"SELECT category, term, count(DISTINCT id)::BIGINT AS df FROM (SELECT lang AS category, doc_id AS id, unnest(regexp_extract_all(lower(text), '{_T}')) AS term FROM documents) GROUP BY ALL")
def term_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.term_frequencies(retrieval.index(table(spark, sf_dir, "documents"), "doc_id", "text", "lang"))


@query(f"WITH {_BM} SELECT query_id, category, id, score, rank::BIGINT AS rank FROM sparse")
def bm25_top15_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sparse(spark, sf_dir).select("query_id", "category", "id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("""WITH s AS (SELECT q.vec_id AS query_id, v.label::INT AS category, v.vec_id AS id, round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6) AS similarity
FROM embeddings v JOIN (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q ON v.label = q.label), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, category ORDER BY similarity DESC, id) - 1 AS rank FROM s)
SELECT query_id, category, id, similarity, rank::BIGINT AS rank FROM r WHERE rank < 15""")
def dense_knn_top15(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "embeddings")
    found = vectors.nearest(held, held.where("vec_id % 20 = 0"), "vec_id", "embedding", "label", "vec_id", "embedding")
    return found.select("query_id", "category", "id", "similarity", F.col("rank").cast("bigint").alias("rank"))


@query()
def indexed_knn_top15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As dense_knn_top15, through an index built for it and as many cells as a recall of 0.9 takes; SQL has no such index."""
    held = table(spark, sf_dir, "embeddings")
    asked = held.where("vec_id % 20 = 0")
    with scratch(spark) as path:
        index = vectors.build(held, "vec_id", "embedding", "label", path)
        probes = vectors.probes_for(index, asked, "label", "vec_id", "embedding")
        found = vectors.search(index, asked, "label", "vec_id", "embedding", 15, probes)
        return checkpointed(found.select("query_id", "category", "id", "similarity", F.col("rank").cast("bigint").alias("rank")))


@query(f"WITH {_FU} SELECT query_id, id, round(score, 9) AS score FROM fused")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fuse(_dense(spark, sf_dir), _sparse(spark, sf_dir)).withColumn("score", F.round("score", 9))


@query(f"WITH {_BO} SELECT query_id, id, score, n_boosts FROM boosted")
def rrf_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.boosted(retrieval.fuse(_dense(spark, sf_dir), _sparse(spark, sf_dir)), _boosts(spark, sf_dir))


@query(f"WITH {_BO} SELECT query_id, id, count(*)::BIGINT AS n FROM (SELECT * FROM bw UNION ALL SELECT * FROM bt) GROUP BY ALL")
def title_and_priority_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boosts(spark, sf_dir).groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_BO}, fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM boosted), top AS (SELECT * FROM fr WHERE rank < 3),
ok AS (SELECT t.query_id FROM top t LEFT JOIN dense d ON d.query_id = t.query_id AND d.id = t.id WHERE t.rank = 0 AND (t.n_boosts > 0 OR d.similarity IS NULL OR d.similarity >= 0.9))
SELECT query_id, id, score, n_boosts, rank::BIGINT AS rank FROM top WHERE query_id IN (SELECT query_id FROM ok)"""
)
def hybrid_search_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.hybrid(_dense(spark, sf_dir), _sparse(spark, sf_dir), _boosts(spark, sf_dir), 3, 0.9)
    return hits.select("query_id", "id", "score", "n_boosts", F.col("rank").cast("bigint").alias("rank"))
