"""Numbers in a global order by prefix sums over range partitions: no task sees more than its part, whatever the keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from lodeline.session import checkpointed


def numbered(df: DataFrame, order: Sequence[str], as_: str = "n", base: int = 0) -> DataFrame:
    """``df`` with ``base`` plus each row's place in the order of some columns, nulls first; rows that are equal in all of them come in any order.

    Rows are dealt by ranges and sorted, each partition's rows are counted, and the
    counts before a partition are added to the places in it. The sorted rows are
    written to the shared folder, so that a lost task can't deal them anew.
    """
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    held = checkpointed(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__k", within))
    # a row for each partition
    counts = held.groupBy("__part").agg(F.count(F.lit(1)).alias("__c"))
    before = counts.select("__part", (F.sum("__c").over(Window.orderBy("__part")) - F.col("__c")).alias("__before"))
    return held.join(F.broadcast(before), "__part").withColumn(as_, F.col("__before") + F.col("__k") + base).drop("__part", "__k", "__before")


def within_key(df: DataFrame, key: str, order: Sequence[str], as_: str = "n") -> DataFrame:
    """``df`` with each row's place from 0 among those of its key, in the order of some columns; a null key is a key.

    A row's place is its global one less that of the key's first row, so that a
    key that holds most of the rows is numbered by all tasks.
    """
    placed = numbered(df, [key, *[c for c in order if c != key]], "__g")
    first = placed.groupBy(F.col(key).alias("__key")).agg(F.min("__g").alias("__first"))
    return placed.join(first, F.col(key).eqNullSafe(F.col("__key"))).withColumn(as_, F.col("__g") - F.col("__first")).drop("__g", "__key", "__first")


def sequential_ids(df: DataFrame, order: Sequence[str], base: int, prefix: str = "", as_: str = "id") -> DataFrame:
    """``df`` with ids from ``base`` on, in order, behind a prefix."""
    return numbered(df, order, "__n", base).withColumn(as_, F.concat(F.lit(prefix), F.col("__n").cast("string"))).drop("__n")
