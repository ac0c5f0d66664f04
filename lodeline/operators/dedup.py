"""Duplicates by key: first kept, last kept, or told apart by a suffix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodeline.functions.text import content_hash


def keep_first(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """Of the rows with equal keys the first in ``order``, all columns kept. Null keys are equal to each other."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def keep_last(df: DataFrame, keys: Sequence[str | Column], order: str) -> DataFrame:
    """Of the rows with equal keys the last in ``order``."""
    return keep_first(df, keys, [F.col(order).desc()])


def keep_first_content(df: DataFrame, content: str, order: Sequence[str | Column]) -> DataFrame:
    """Of the rows with equal content, by the first twelve hex digits of its MD5, the first; a column ``hash`` is added.

    Only hashes and order columns are compared in the shuffle's sort; texts move once.
    """
    return keep_first(df.withColumn("hash", content_hash(F.col(content))), ["hash"], order)


def repeats(df: DataFrame, key: str, order: str, as_: str = "repeats", among: DataFrame | None = None) -> DataFrame:
    """``df`` with a column that is false for the first row of each key, in ``order``, which is total.

    With ``among``, of which ``df`` is a part, the first row is that among all of its rows.

    Only the first place of each key is gathered, after each task's own, so a
    crowded key is no task's alone. Null keys are equal to each other.
    """
    first = (df if among is None else among).groupBy(F.col(key).alias("__key")).agg(F.min(order).alias("__first"))
    return df.join(first, F.col(key).eqNullSafe(F.col("__key"))).withColumn(as_, F.col(order) > F.col("__first")).drop("__key", "__first")


def suffix_repeats(df: DataFrame, key: str, order: str, as_: str = "unique_id", among: DataFrame | None = None) -> DataFrame:
    """A column with the key, and the ordinal appended from its second occurrence on, ``among`` more rows if these are given."""
    own = F.col(key).cast("string")
    return repeats(df, key, order, "__again", among).withColumn(as_, F.when(F.col("__again"), F.concat_ws("_", own, F.col(order).cast("string"))).otherwise(own)).drop("__again")
