"""Queries of snapshot reports over events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodeline.functions.text import snippet
from lodeline.operators import reports
from lodeline.plans.registry import query
from lodeline.session import checkpointed, scratch, spread, table

TYPES = ("click", "error", "purchase", "signup", "view")


def streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream. A pattern finds a table that is one file and one that is a folder of files alike, which a plain path or a name in the folder above doesn't."""
    from lodeline.streaming import updates

    return updates.files(spark, f"{sf_dir}/[{name[0]}]{name[1:]}.parquet", table(spark, sf_dir, name).schema)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))


@query("SELECT event_id, event_type, value FROM events WHERE ts::DATE = (SELECT max(ts::DATE) FROM events)")
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.latest_snapshot(events(spark, sf_dir), "day", "1999-01-01").select("event_id", "event_type", "value")


@query("SELECT event_id, user_id FROM (SELECT *, max((value > 400)::INT) OVER (PARTITION BY user_id) AS has FROM events) WHERE value > 400 OR has = 0")
def filter_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.filter_or_all(table(spark, sf_dir, "events"), F.col("value") > 400, ["user_id"]).select("event_id", "user_id")


@query("SELECT user_id, " + ", ".join(f'max_by(value, event_id) FILTER (event_type = \'{t}\') AS "{t}"' for t in TYPES) + " FROM events GROUP BY user_id")
def report_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.last_wins_pivot(table(spark, sf_dir, "events"), "user_id", "event_type", TYPES, F.col("value"), "event_id")


@query("SELECT user_id, string_agg(event_type, ' / ' ORDER BY event_id) AS listed FROM (SELECT * FROM events WHERE event_type <> 'view') GROUP BY user_id")
def report_string_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type <> 'view'").groupBy("user_id").agg(reports.ordered_join(F.col("event_type"), F.col("event_id"), " / ").alias("listed"))


@query("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS filled FROM events")
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("filled"))
    return reports.forward_fill(rows, "filled", ["user_id"], "event_id")


@query("SELECT o_custkey, o_orderkey, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank FROM orders) WHERE rank <= 5")
def first_n_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.first_n(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 5).select("o_custkey", "o_orderkey", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT o_orderkey, o_orderpriority = '1-URGENT' AS matched FROM orders ORDER BY matched DESC, o_orderkey LIMIT 10")
def stable_partition_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.matched_first(table(spark, sf_dir, "orders"), F.col("o_orderpriority") == "1-URGENT", ["o_orderkey"], 10).select("o_orderkey", "matched")


STOP = ("and", "the", "with")
_KW = "SELECT item_id, list_filter(regexp_extract_all(text, '[a-zA-Z]{2,}'), lambda w: NOT list_contains(['and', 'the', 'with'], w)) AS kw FROM benchmark"
_SC = f"WITH q AS ({_KW}), n AS (SELECT doc_id, string_split(text, chr(10))[1] AS title, text AS content FROM documents), s AS (SELECT item_id, doc_id, 2 * len(list_filter(kw, lambda w: contains(title, w))) + len(list_filter(kw, lambda w: contains(content, w))) AS score FROM q, n), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM s WHERE score > 0) WHERE k = 1)"


def _topic(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    q = table(spark, sf_dir, "benchmark").select("item_id", reports.keywords(F.col("text"), STOP, "[a-zA-Z]").alias("kw"))
    n = spread(table(spark, sf_dir, "documents")).select("doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"))
    return q, n, checkpointed(reports.topic_search(q, n, "item_id", "kw", "doc_id", "title", "content"))


@query(f"{_SC} SELECT item_id, doc_id, score::BIGINT AS score FROM b")
def topic_search_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topic(spark, sf_dir)[2]


@query(f"{_SC}, t AS (SELECT b.item_id, b.doc_id, content, list_filter(kw, lambda w: contains(content, w))[1] AS first FROM b JOIN n USING (doc_id) JOIN q ON q.item_id = b.item_id) SELECT item_id, doc_id, trim(substr(content, CASE WHEN first IS NULL THEN 1 ELSE greatest(instr(content, first) - 1 - 50, 0) + 1 END, 350), ' ' || chr(10)) AS snippet FROM t")
def topic_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, n, best = _topic(spark, sf_dir)
    return n.join(F.broadcast(best.join(q, "item_id")), "doc_id").select("item_id", "doc_id", snippet(F.col("content"), F.col("kw")).alias("snippet"))


@query("SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def stream_watermark_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeline.streaming import updates

    stream = updates.event_time(streamed(spark, sf_dir, "events"))
    with scratch(spark) as root:
        updates.counted(updates.windowed_counts(stream, "ts", ["event_type"], late="60 days"), f"{root}/counts", f"{root}/progress").awaitTermination()
        held = updates.counts_so_far(spark, f"{root}/counts", f"{root}/progress", ["event_type"])
        return checkpointed(held.select("event_type", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n"))


@query("""WITH a AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations WHERE role <> 'user'), p AS (SELECT id, unnest(generate_series(0, ceil(length(text) / 500.0)::INT)) AS ord, text, ceil(length(text) / 500.0)::INT AS n FROM a)
SELECT id, ord::INT AS ord, CASE WHEN ord < n THEN substr(text, ord * 500 + 1, 500) ELSE '' END AS token, ord = n AS done FROM p""")
def stream_pieces_sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeline.streaming import sink, updates

    stream = streamed(spark, sf_dir, "conversations").where("role <> 'user'")
    rows = updates.pieces(stream.select(F.expr("conv_id * 1000 + turn").alias("id"), "text"), "id", "text", 500)
    with scratch(spark) as root:
        sink.send(rows, f"{root}/sent", f"{root}/progress").awaitTermination()
        return checkpointed(sink.sent(spark, f"{root}/sent", "id bigint, ord int, token string, done boolean").select("id", "ord", "token", "done"))


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def stream_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeline.sources.documents import Versions
    from lodeline.streaming import updates

    with scratch(spark) as root:
        store = Versions(spark, f"{root}/store")
        stream = streamed(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
        updates.upserts(stream, store, "user_id", "event_id", f"{root}/progress").awaitTermination()
        return checkpointed(store.current())
