"""Reading and writing documents, questions, snapshots and versions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lodeline.functions.text import safe_id, strip

DOCUMENT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "title", "content", "url")] + [T.StructField("category_id", T.IntegerType()), T.StructField("date", T.StringType()), T.StructField("breadcrumb", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))]
)
MENU = "array<struct<restaurant:string,meal_type:string,staff_student:string,date:string,title:string,menu_items:array<string>,content:string,source:string>>"
NOTICE = "array<struct<url:string,board:string,title:string,date:string,content:string,crawled_at:string,status:string>>"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in whatever store it is."""
    jvm = spark.sparkContext._jvm
    held = jvm.org.apache.hadoop.fs.Path(path)
    return held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(held)


def first_existing(spark: SparkSession, paths: Sequence[str], required: bool = True) -> str | None:
    """The first of some paths that exists; FileNotFoundError if none does and one is required."""
    for path in paths:
        if exists(spark, path):
            return path
    if required:
        raise FileNotFoundError(", ".join(paths))
    return None


def static_documents(spark: SparkSession, rows: Sequence[dict[str, Any]], date: str | None = None, schema: T.StructType = DOCUMENT) -> DataFrame:
    """Documents that are written by hand, as seeds or for a service that isn't crawled: a few rows with the fields of DOCUMENT.

    Fields that a row lacks are null, ``date`` stands in for a missing date, and a row without an id gets one of its title and content.
    """
    held = spark.createDataFrame([tuple(row.get(n) for n in schema.fieldNames()) for row in rows], schema)
    own = F.concat(F.lit("static_"), F.substring(F.md5(F.concat_ws("\n", "title", "content")), 1, 12))
    return held.withColumn("id", F.coalesce("id", own)).withColumn("date", F.coalesce("date", F.lit(date).cast("string")))


#: A labelled question, for training or testing; the label may be a number or its text.
LABELLED = T.StructType([T.StructField(n, T.StringType()) for n in ("question", "label")])


def labelled(spark: SparkSession, path: str, labels: Sequence[int]) -> DataFrame:
    """(question, label) of a file or folder of JSON arrays; a question that is empty or whose label is none of ``labels`` is left out."""
    rows = spark.read.schema(LABELLED).option("multiLine", True).json(path).select(strip(F.col("question")).alias("question"), F.col("label").try_cast("int").alias("label"))
    return rows.where((F.col("question") != "") & F.col("label").isin(*labels))


def documents(spark: SparkSession, path: str, schema: T.StructType = DOCUMENT, multiline: bool = True) -> DataFrame:
    """A file or folder of JSON arrays of documents (or one a line); empty if there is none. ``doc_id`` stands in for a missing ``id``."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    wide = T.StructType([*schema.fields, T.StructField("doc_id", T.StringType())])
    return spark.read.schema(wide).option("multiLine", multiline).json(path).withColumn("id", F.coalesce("id", "doc_id")).drop("doc_id")


#: Keys of containers and of texts in a list of questions, in the order in which they are tried.
CONTAINERS = ("data", "questions", "items", "test", "examples")
TEXTS = ("question", "user", "text", "query", "input", "utterance")


def _question_texts(data: Any) -> Iterator[str]:
    stack = [data]
    while stack:
        now = stack.pop()
        if isinstance(now, str):
            yield now
        elif isinstance(now, list):
            stack.extend(reversed(now))
        elif isinstance(now, dict):
            inner = next((now[k] for k in CONTAINERS if isinstance(now.get(k), list)), None)
            if inner is None:
                inner = next((now[k] for k in TEXTS if isinstance(now.get(k), (str, list))), None)
            if inner is None and now and all(isinstance(v, str) for v in now.values()):
                inner = list(now.values())
            if inner is not None:
                stack.append(inner)


def questions(spark: SparkSession, path: str) -> DataFrame:
    """(path, ord, question): the questions in JSON files of any of the known shapes, stripped, empty ones left out."""

    @F.pandas_udf("array<string>")
    def read(values: pd.Series) -> pd.Series:
        return values.map(lambda v: list(_question_texts(json.loads(v))))

    files = spark.read.option("wholetext", True).text(path).withColumn("path", F.input_file_name())
    held = files.select("path", F.posexplode(read("value")).alias("ord", "q"))
    return held.select("path", "ord", strip(F.col("q")).alias("question")).where("question <> ''")


def flat_questions(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The question of rows that have it under one of the known names."""
    names = [n for n in TEXTS if n in rows.columns]
    return rows.select(*keep, strip(F.coalesce(*names)).alias("question")).where("question <> ''")


def snapshots(spark: SparkSession, path: str, items: str = MENU) -> DataFrame:
    """(source, snapshot_date, crawled_at, ord, item): every item of every daily file below a folder, numbered in its file."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("category", "date", "crawled_at")] + [T.StructField("items", T._parse_datatype_string(items))])
    raw = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path).withColumn("file", F.input_file_name())
    source = F.regexp_extract("file", r"([^/]+)/[^/]+$", 1)
    day = F.regexp_extract("file", r"([^/]+)\.json$", 1)
    return raw.select(source.alias("source"), day.alias("snapshot_date"), "crawled_at", F.posexplode("items").alias("ord", "item"))


def realtime_documents(items: DataFrame, categories: dict[str, str]) -> DataFrame:
    """Snapshot items (source, snapshot_date, ord, title, content, date) as documents of the realtime layer; the item's date, else the snapshot's."""
    category = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in categories.items() for x in kv]), F.col("source")), F.col("source")) if categories else F.col("source")
    date = F.coalesce(F.nullif(F.col("date"), F.lit("")), F.col("snapshot_date"))
    return items.select("ord", F.concat_ws("_", F.lit("realtime"), category, date, safe_id(F.col("title")), F.col("ord").cast("string")).alias("id"), category.alias("category"), "title", "content", date.alias("date"))


def stored(spark: SparkSession, path: str) -> DataFrame:
    """A store's rows; a document is split at its first line into title and content."""
    rows = spark.read.parquet(path)
    parts = F.split("document", "\n", 2)
    return rows.withColumn("title", parts.getItem(0)).withColumn("content", F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")))


def write_json(df: DataFrame, paths: Sequence[str]) -> int:
    """One JSON file in each folder that can be written; an error only if none can. Returns the number written."""
    done, last = 0, None
    for path in paths:
        try:
            df.coalesce(1).write.mode("overwrite").json(path)
            done += 1
        except Exception as error:  # noqa: BLE001 - any store's error means the same here
            last = error
    if not done:
        raise OSError("no output folder can be written") from last
    return done


class Versions:
    """A table as numbered folders with a pointer: a rebuild shows only when it is whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _numbers(self) -> list[int]:
        if not exists(self.spark, self.path):
            return []
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and exists(self.spark, f"{self.path}/{n}/_SUCCESS"))

    def current(self) -> DataFrame | None:
        """The newest whole version, None before the first."""
        found = self._numbers()
        return self.spark.read.parquet(f"{self.path}/v{found[-1]}") if found else None

    def write(self, df: DataFrame, by: Sequence[str] = ()) -> int:
        """A new version, partitioned by some columns; the old ones stay readable."""
        number = (self._numbers() or [0])[-1] + 1
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{self.path}/v{number}")
        return number

    def upsert(self, fresh: DataFrame, key: str, order: str, by: Sequence[str] = ()) -> int:
        """A new version in which new rows replace those of the same key, of several the last in order."""
        old = self.current()
        rows = fresh.withColumn("__new", F.lit(1))
        if old is not None:
            rows = old.withColumn("__new", F.lit(0)).unionByName(rows, allowMissingColumns=True)
        best = F.max_by(F.struct(*[c for c in rows.columns if c != "__new"]), F.struct("__new", order)).alias("r")
        return self.write(rows.groupBy(F.col(key).alias("__k")).agg(best).select("r.*"), by)


def write_daily(df: DataFrame, path: str, by: Sequence[str] = ("category", "date")) -> None:
    """Daily partitions; those in ``df`` are replaced, the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def with_embedding(docs: DataFrame, embed: Callable[[Column], Column], text: str, as_: str = "embedding") -> DataFrame:
    """``docs`` with vectors from a pluggable function of the text column."""
    return docs.withColumn(as_, embed(F.col(text)))


def hashing_embedding(size: int = 64) -> Callable[[Column], Column]:
    """The stand-in for a sentence encoder: counts of hashed tokens, in expressions alone."""

    def embed(text: Column) -> Column:
        buckets = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda t: F.pmod(F.xxhash64(t), F.lit(size)))
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(buckets, lambda b: b == i)).cast("float"))

    return embed
