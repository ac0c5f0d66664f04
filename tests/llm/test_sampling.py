"""Bounded samples."""

import zlib

from pyspark.sql import functions as F

from lodeline.llm import sampling


def test_sample_is_bounded_and_repeatable(spark):
    rows = spark.range(50_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "few").otherwise("many").alias("lang"))
    one = sampling.least_by_hash(rows, "lang", "doc_id", 300, 1)
    two = sampling.least_by_hash(rows.repartition(7), "lang", "doc_id", 300, 1)
    assert one == two and len(one) == 600 and sum(lang == "few" for _, lang in one) == 300
    assert len(sampling.least_by_hash(rows.limit(20), "lang", "doc_id", 300, 1)) == 20
    assert sampling.least_by_hash(rows.limit(0), "lang", "doc_id", 300, 1) == []


def test_whole_ranking_agrees(spark):
    rows = spark.range(9_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("one"))
    found = {i for i, _ in sampling.least_by_hash(rows, "one", "doc_id", 50, 3)}
    u = F.shiftrightunsigned(F.xxhash64(F.lit(3), "doc_id"), 11)
    assert found == {r.doc_id for r in rows.orderBy(u).limit(50).collect()}


def test_nulls_and_repeats(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (2, None)], "doc_id long, lang string")
    assert sampling.least_by_hash(rows, "lang", "doc_id", 5, 1) == [(1, "a")]
    assert {r.doc_id for r in sampling.only_ids(rows, "doc_id", [1, 9]).collect()} == {1}
    held = {r.doc_id: r.t for r in rows.where("doc_id is not null").select("doc_id", sampling.in_training().alias("t")).collect()}
    assert held == {i: zlib.crc32(str(i).encode()) % 5 != 0 for i in (1, 2)}
