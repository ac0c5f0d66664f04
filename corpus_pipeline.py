"""From raw documents to a training mix: language, near-copies, benchmark passages, secrets, sources.

Each stage takes the session, the documents that the stage before it kept, and
the folder of the tables. run() applies them in order; what a stage returns is
written to the shared folder that spark.checkpoint.dir names and read again, and
goes when the next stage's output is whole.

All stages treat rows one by one or by their texts: repeated rows share their
text's fate, a stage on an empty table returns an empty one, and further columns
of the input, whatever their names, are left behind by the first stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodeline.llm import decontam, langid, mixing, secret_scan, simhash
from lodeline.session import shared_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language isn't recognised, go; so do null and empty texts."""
    return langid.keep_known(docs, langid.train(docs)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with a five-word similarity of 0.8 or more the one with the smallest id stays.

    Null, empty and blank texts are one group, and of rows that repeat one stays;
    rows without an id stay only if their group has none (see simhash.keep_one).
    """
    return simhash.keep_one(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go; null and empty texts, on either side, overlap with nothing."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Values of secrets are blanked out and n_chars follows; no document goes, and null and empty texts stay as they are."""
    blanked = secret_scan.redact(docs, secret_scan.train(docs))
    return blanked.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources and shuffled; copy and shuffle_key are added.

    A null source is a source of its own; rows that repeat an id are drawn alike.
    """
    return mixing.mix(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("mixing", mixed),
]

#: Two stages score with trained models and one walks a graph, which SQL can't express.
ORACLE_SQL = None


def _drop(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the result reads the last stage's folder, which stays."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _drop(spark, before)
        before = path
    return docs
