"""Structured Streaming: keep a store current, count events, replay answers in pieces (sent by ``sink``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lodeline.functions.text import chunks
from lodeline.sources.documents import Versions


def files(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 100, format: str = "parquet", names: str = "*") -> DataFrame:
    """A stream of the files that land in a folder, those alone whose names fit a pattern."""
    return spark.readStream.schema(schema).format(format).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", names).load(path)


def event_time(stream: DataFrame, column: str = "ts") -> DataFrame:
    """The column as a timestamp with a zone, which watermarks need."""
    return stream.withColumn(column, F.col(column).cast("timestamp"))


def upserts(stream: DataFrame, store: Versions, key: str, order: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Each micro-batch is merged into the store by key; all that is there if ``interval`` is None, else for ever at that pace.

    A batch that is run again after a failure replaces rows by the same rows.
    """

    def merge(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.upsert(batch, key, order)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window_start, keys, n): events in tumbling windows; those later than the watermark are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")


def first_seen(stream: DataFrame, time: str, key: str, late: str = "2 days") -> DataFrame:
    """The first event of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def pieces(answers: DataFrame, id_col: str, text: str, size: int = 5) -> DataFrame:
    """(id_col, ord, token, done): an answer in pieces, then an empty one that ends it."""
    parts = F.concat(F.transform(chunks(F.col(text), size), lambda t: F.struct(t.alias("token"), F.lit(False).alias("done"))), F.array(F.struct(F.lit("").alias("token"), F.lit(True).alias("done"))))
    return answers.select(id_col, F.posexplode(parts).alias("ord", "x")).select(id_col, "ord", "x.token", "x.done")


def once_a_day(exists: Callable[[str], bool], today: str, crawl: Callable[[str], None]) -> bool:
    """Run ``crawl`` for today unless today's snapshot exists; whether it ran."""
    if exists(today):
        return False
    crawl(today)
    return True


def counted(stream: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Write windowed counts to files once their window is closed: all that is there if ``interval`` is None, else for ever at that pace."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def counts_so_far(spark: SparkSession, path: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """(window_start, keys, n, closed): the closed windows from counted()'s files, and the open ones from its state, read where it lies."""
    closed = spark.read.schema(", ".join(["window_start timestamp", *[f"{k} string" for k in keys], "n bigint"])).parquet(path).withColumn("closed", F.lit(True))
    held = spark.read.format("statestore").load(checkpoint)
    still = held.select(F.col("key.window.start").alias("window_start"), *[F.col(f"key.{k}").cast("string").alias(k) for k in keys], F.col("value.count").alias("n"), F.lit(False).alias("closed"))
    return closed.unionByName(still)
