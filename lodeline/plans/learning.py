"""Queries of classification: n-grams, centroids, metrics, votes, a trained pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodeline.operators import classify
from lodeline.plans.registry import query
from lodeline.session import checkpointed, spread, table

_FLAT = "replace(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' ', '')"


def _grams(source: str, key: str) -> str:
    """SQL for the grams of some rows: n-grams of two to four characters, and tokens twice."""
    parts = [f"SELECT {key}, unnest(list_transform(generate_series(1, length(flat) - {n - 1}), lambda i: substr(flat, i, {n}))) AS gram FROM {source}" for n in (2, 3, 4)]
    token = f"SELECT {key}, unnest(regexp_extract_all(norm, '[\\p{{L}}\\p{{N}}]{{1,}}')) AS gram FROM {source}"
    return " UNION ALL ".join([*parts, token, token])


_BENCH = "b AS (SELECT item_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS norm, replace(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' ', '') AS flat FROM benchmark)"
_EX = "e AS (SELECT lang AS label, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS norm, replace(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' ', '') AS flat FROM documents)"
_COS = f"""WITH {_BENCH}, {_EX}, g AS (SELECT item_id, gram, count(*) AS n FROM ({_grams("b", "item_id")}) GROUP BY ALL), p AS (SELECT label, gram, count(*)::DOUBLE AS weight FROM ({_grams("e", "label")}) GROUP BY ALL),
gn AS (SELECT item_id, sqrt(sum(n * n)) AS a FROM g GROUP BY item_id), pn AS (SELECT label, sqrt(sum(weight * weight)) AS b FROM p GROUP BY label),
c AS (SELECT item_id, label, round(sum(n * weight) / (any_value(a) * any_value(b)), 6) AS cosine FROM g JOIN p USING (gram) JOIN gn USING (item_id) JOIN pn USING (label) GROUP BY ALL)"""


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


@query(f"WITH {_BENCH} SELECT item_id, gram, count(*)::BIGINT AS n FROM ({_grams('b', 'item_id')}) GROUP BY ALL")
def char_ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.gram_counts(table(spark, sf_dir, "benchmark"), "item_id", "text")


@query(f"WITH {_EX} SELECT label, gram, count(*)::DOUBLE AS weight FROM ({_grams('e', 'label')}) GROUP BY ALL")
def centroid_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.profiles(_examples(spark, sf_dir), "lang", "doc_id", "text")


@query(f"{_COS} SELECT item_id, label, cosine FROM c")
def centroid_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.similarity(char_ngram_counts(spark, sf_dir), centroid_profiles(spark, sf_dir), "item_id").withColumn("cosine", F.round("cosine", 6))


@query(f"{_COS} SELECT item_id, label, cosine FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY cosine DESC, label) AS n FROM c) WHERE n = 1")
def centroid_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeline.operators.retrieval import ranked

    return ranked(centroid_cosine(spark, sf_dir), "item_id", "cosine", "label", 1).drop("rank")


@query("SELECT label, n, max(n) OVER () AS largest FROM (SELECT quality AS label, count(*)::BIGINT AS n FROM labels GROUP BY quality)")
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.class_distribution(table(spark, sf_dir, "labels"), "quality")


@query("""WITH r AS (SELECT quality AS t, CASE WHEN doc_id % 7 = 0 THEN toxic ELSE quality END AS p FROM labels), l AS (SELECT t AS label FROM r UNION SELECT p FROM r),
c AS (SELECT label, (SELECT count(*) FROM r WHERE t = label) AS a, (SELECT count(*) FROM r WHERE p = label) AS s, (SELECT count(*) FROM r WHERE p = label AND t = label) AS h FROM l)
SELECT label, round(CASE WHEN s > 0 THEN h / s ELSE 0 END, 9) AS precision, round(CASE WHEN a > 0 THEN h / a ELSE 0 END, 9) AS recall, round(CASE WHEN a + s > 0 THEN 2 * h / (a + s) ELSE 0 END, 9) AS f1 FROM c""")
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").withColumn("p", F.when(F.col("doc_id") % 7 == 0, F.col("toxic")).otherwise(F.col("quality")))
    return classify.macro_f1(rows, "quality", "p").select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("""WITH v AS (SELECT user_id, unnest([value, 100.0, event_id % 300]) AS p, generate_subscripts([value, 100.0, event_id % 300], 1) - 1 AS label FROM events), m AS (SELECT user_id, label, round(avg(p), 9) AS p FROM v GROUP BY ALL)
SELECT user_id, label::INT AS label, p AS probability FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, label) AS n FROM m) WHERE n = 1""")
def soft_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.array(F.col("value"), F.lit(100.0), (F.col("event_id") % 300).cast("double")).alias("probs"))
    return classify.soft_vote(rows, "user_id", "probs")


_WB = f"""t AS (SELECT conv_id * 1000 + turn AS tid, text FROM conversations), w AS (SELECT tid, ' ' || unnest(list_filter(string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' '), lambda x: x <> '')) || ' ' AS w FROM t),
g AS ({" UNION ALL ".join(f"SELECT tid, unnest(list_transform(generate_series(1, length(w) - {n - 1}), lambda i: substr(w, i, {n}))) AS gram FROM w" for n in (2, 3, 4, 5))}),
c AS (SELECT tid, gram, count(*) AS n FROM g GROUP BY ALL), df AS (SELECT gram, count(*) AS df FROM c GROUP BY gram), idf AS (SELECT gram, df, ln((1.0 + (SELECT count(*) FROM t)) / (1.0 + df)) + 1.0 AS idf FROM df)"""


@query(f"WITH {_WB}, r AS (SELECT tid, gram, (1.0 + ln(n)) * idf AS raw FROM c JOIN idf USING (gram)), s AS (SELECT tid, sqrt(sum(raw * raw)) AS size FROM r GROUP BY tid) SELECT tid, gram, round(raw / size, 9) AS weight FROM r JOIN s USING (tid)")
def bounded_gram_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.expr("conv_id * 1000 + turn").alias("tid"), "text")
    turns = spread(turns)
    idf = classify.inverse_frequencies(classify.document_frequencies(turns, "tid", "text"), turns.count())
    return classify.text_weights(turns, "tid", "text", idf).select("tid", "gram", F.round("weight", 9).alias("weight"))


@query()
def tfidf_logreg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled documents' quality by a model of the whole labelled text; the optimum of a regression isn't SQL's."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").cast("double").alias("label")), "doc_id")
    rows = checkpointed(rows.select("doc_id", "text", "label"))
    model = classify.text_pipeline(rows, "label", "doc_id", "text", rounds=50, vocabulary=1 << 16)
    return classify.text_predict(model, rows.select("doc_id", "text"), "doc_id", "text").select("doc_id", "prediction")


@query("""WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT n.source, n.n::BIGINT AS own, (max(n) OVER () - n.n)::BIGINT AS made FROM n""")
def augmented_class_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    grown = classify.augment(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "source", "doc_id", "text")
    return grown.groupBy("source").agg(F.count(F.when(F.col("copy") == 0, 1)).alias("own"), F.count(F.when(F.col("copy") > 0, 1)).alias("made"))
