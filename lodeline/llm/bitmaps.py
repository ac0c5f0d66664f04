"""Bitmaps of bounded size that leave most rows out of a shuffle; what they let through is decided by a join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def bitmap(numbers: DataFrame, bits: int) -> np.ndarray:
    """The set of the numbers (the one column of ``numbers``, from 0 to ``bits`` - 1) as bytes.

    Built in the cluster; the driver gets at most ``bits`` / 8 bytes, whatever the rows.
    """
    at = F.col(numbers.columns[0]) + 1
    parts = numbers.groupBy(F.bitmap_bucket_number(at).alias("i")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("held")).collect()
    out = np.zeros(max(bits // 8, 4096), np.uint8)
    for row in parts:
        out[(row.i - 1) * 4096 : row.i * 4096] = np.frombuffer(row.held, np.uint8)
    return out


def in_bitmap(held: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Which of the numbers are in the set."""
    return (held[numbers >> 3] >> (numbers & 7).astype(np.uint8) & 1).astype(bool)


def modulo(column: Column, bits: int) -> Column:
    """A hash as a number from 0 to ``bits`` - 1."""
    return F.pmod(column, F.lit(bits))
