"""Bounded samples of rows, drawn by hash so that they don't depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodeline.llm.arrow import free


def in_training(id_col: str = "doc_id") -> Column:
    """False for the held-out fifth: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0


#: How many times the rows asked for are ranked, so that the draw doesn't come out short.
SPARE = 4


def least_by_hash(rows: DataFrame, label: str, id_col: str, per_label: int, seed: int) -> list[tuple]:
    """(id, label) of at most ``per_label`` distinct ids for each label: those with the smallest hashes.

    Rows are counted by label first, and only those whose hash is below about
    SPARE * per_label / rows are ranked: no task gets more than some multiple of
    what is asked for, whatever the number of rows and partitions, and the driver
    gets what is asked for.
    """
    picked = rows.select(F.col(id_col).alias("id"), F.col(label).alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("id")), 11).cast("double") * F.lit(2.0**-53)
    counted = picked.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    ranked = picked.join(counted, "label").withColumn("u", u).where(F.col("u") * F.col("n") < F.lit(float(SPARE * per_label)))
    order = Window.partitionBy("label").orderBy("u", "id")
    first = ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_label)
    return sorted({(r[0], r[1]) for r in first.select("id", "label").collect()})


def only_ids(docs: DataFrame, id_col: str, ids: list) -> DataFrame:
    """The rows whose id is one of a bounded list, sent to the executors as a small table."""
    name = free("id", docs)
    small = docs.sparkSession.createDataFrame([(i,) for i in ids], f"{name} {docs.schema[id_col].dataType.simpleString()}")
    return docs.join(F.broadcast(small), docs[id_col] == small[name], "left_semi")
