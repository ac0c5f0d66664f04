"""Bytes from outside: binary files and addresses, turned to text by pluggable functions in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


def extracted_files(spark: SparkSession, path: str, extract: Callable[[bytes], str], names: str = "*.pdf") -> DataFrame:
    """(path, text) of binary files; a file that ``extract`` can't read gives the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for content in batch.column(1):
                try:
                    texts.append(extract(content.as_py()))
                except Exception:  # noqa: BLE001 - whatever a parser raises means an unreadable file
                    texts.append("")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["path", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", names).load(path)
    return files.select("path", "content").mapInArrow(run, "path string, text string")


def fetched(urls: DataFrame, url: str, fetch: Callable[[str], str | None], per_host: int = 8) -> DataFrame:
    """(url, html) of addresses; null where ``fetch`` fails. Addresses are dealt by host and a number, so that no host gets more than ``per_host`` tasks at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = []
            for value in batch.column(0).to_pylist():
                try:
                    pages.append(fetch(value))
                except Exception:  # noqa: BLE001 - a page that can't be had is null
                    pages.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pages, pa.string())], ["url", "html"])

    host = F.regexp_extract(url, r"^https?://([^/]+)", 1)
    dealt = urls.select(F.col(url).alias("url")).distinct().repartition(host, F.pmod(F.xxhash64("url"), F.lit(per_host)))
    return dealt.mapInArrow(run, "url string, html string")
