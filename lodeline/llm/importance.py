"""Importance resampling: documents drawn in proportion to how much likelier they are under the target than under the raw text.

Two bags of hashed words and word pairs are estimated: of the target rows and of
all rows. A document's weight is the ratio of its probability under the two; in
logarithms, the sum over its n-grams. Adding Gumbel noise to log-weights and
taking the k largest draws k documents without replacement in proportion to the
weights. The noise is a hash of the id, so a draw can be repeated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lodeline.llm.arrow import bound_batches, by_text, free, materialise, spans
from lodeline.llm.kernels import SPACE, Block, combine, fold, hash_runs
from lodeline.llm.sampling import least_by_hash

#: Buckets of n-gram hashes, as a power of two; the two models are arrays of this size.
BITS = 16
SEED = 4
#: Added to every bucket's count.
SMOOTH = 1.0
#: Rows from which the target's model is learned, at most; the raw model counts all rows.
TARGET_ROWS = 20_000
#: Width of the bins by which the k-th largest key is found.
BIN_BITS = 16


def buckets(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket and the text of every word and of every pair of neighbouring words, folded to lower case."""
    block = Block(texts)
    starts, ends = block.runs(~SPACE)
    h = hash_runs(fold(block.data), starts, ends)
    owner = block.owner(starts)
    if len(h) > 1:
        pair = owner[1:] == owner[:-1]
        both = np.concatenate((h, combine([h[:-1], h[1:]])[pair]))
        owner = np.concatenate((owner, owner[1:][pair]))
    else:
        both = h
    return (both >> np.uint64(64 - BITS)).astype(np.int64), owner


def counts(docs: DataFrame, target_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of all rows and of the target rows by bucket: every task sums its own, the driver gets one row a bucket."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for batch in batches:
            texts, wanted = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for low, high in spans(texts):
                bucket, owner = buckets(texts[low:high])
                raw += np.bincount(bucket, minlength=1 << BITS)
                target += np.bincount(bucket[wanted[low:high][owner]], minlength=1 << BITS)
        met = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(raw[met]), pa.array(target[met])], ["bucket", "raw", "target"])

    rows = docs.select(F.col(text_col).cast("binary").alias("t"), F.coalesce(F.col(target_col), F.lit(False)).alias("w"))
    found = rows.mapInArrow(run, "bucket bigint, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    out = np.zeros((2, 1 << BITS))
    at = found.column("bucket").to_numpy()
    out[0][at], out[1][at] = found.column("raw").to_numpy(), found.column("target").to_numpy()
    return out[0], out[1]


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket the logarithm of target over raw probability; nothing but zeros without target rows."""
    if not target.sum():
        return np.zeros(len(raw))
    p = (target + SMOOTH) / (target + SMOOTH).sum()
    q = (raw + SMOOTH) / (raw + SMOOTH).sum()
    return np.log(p / q)


def gumbel(id_col: str, seed: int = SEED) -> Column:
    """Gumbel noise that is a function of the id and the seed."""
    half = F.lit(2.0**-53)
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 11).cast("double") * half + half / 2
    return -F.log(-F.log(u))


def weigh(docs: DataFrame, target_col: str, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """(id_col, n_grams, log_weight, key): the log importance weight of each whole text and that plus its Gumbel noise.

    Null and empty texts have no n-grams, weight 0. Rows that repeat an id have
    the same noise.
    """
    ratio = log_ratio(*counts(docs, target_col, text_col))
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(columns: list[pa.Array], texts: list[bytes | None]) -> list[pa.Array]:
        bucket, owner = buckets(texts)
        n = len(texts)
        return [columns[0], pa.array(np.bincount(owner, minlength=n)), pa.array(np.bincount(owner, shared.value[bucket], n).astype(float))]

    kind = docs.schema[id_col].dataType.simpleString()
    scored = by_text(docs, [id_col], text_col, f"{id_col} {kind}, n_grams bigint, log_weight double", run)
    return scored.withColumn("key", F.col("log_weight") + gumbel(id_col, seed))


def _ordered(key: Column, low: float, high: float) -> Column:
    """Which of 2**BIN_BITS equal bins between low and high a key lies in."""
    bins = 1 << BIN_BITS
    return F.least(F.greatest(F.floor((key - F.lit(low)) / F.lit(high - low) * bins), F.lit(0)), F.lit(bins - 1))


def threshold(keys: DataFrame, k: int) -> tuple[float, int]:
    """The k-th largest key exactly, and how many keys are larger.

    Bins are counted and only the bin with the k-th key is divided again, until
    its keys are one value: counts of bins reach the driver, never keys.
    """
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    above = 0
    while high > low:
        inside = keys.where(F.col("key").between(low, high))
        top = math.nextafter(high, math.inf) if isinstance(high, float) else high + 1
        binned = inside.groupBy(_ordered(F.col("key"), low, top).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        for row in sorted(binned.collect(), reverse=True):
            if above + row["n"] >= k:
                low, high = row["low"], row["high"]
                break
            above += row["n"]
    return low, above


def resample(scored: DataFrame, k: int, id_col: str = "doc_id") -> DataFrame:
    """``scored`` with a column kept: true for the k rows with the largest keys, or all if there are fewer.

    Among equal keys the rows with the larger hashes of their ids come first.
    Which of the rows that agree in both are taken, such as those without an id,
    depends on their places in the checkpoint, so that exactly k are true; no
    task sorts them.
    """
    if k <= 0:
        return scored.withColumn("kept", F.lit(False))
    tie, row = free("tie", scored), free("row", scored)
    held = materialise(scored.withColumn(tie, F.shiftrightunsigned(F.xxhash64(id_col), 11)).withColumn(row, F.monotonically_increasing_id()))
    if held.count() <= k:
        return held.drop(tie, row).withColumn("kept", F.lit(True))
    kept, equal, left = F.lit(False), F.lit(True), k
    for column in ("key", tie, row):
        among = held.where(equal)
        least, above = threshold(among.select(F.col(column).alias("key")), left)
        kept = kept | (equal & (F.col(column) > F.lit(least)))
        equal = equal & (F.col(column) == F.lit(least))
        left -= above
        if held.where(equal).count() == left:
            break
    return held.withColumn("kept", kept | equal).drop(tie, row)


def select(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", share: float | None = None, seed: int = SEED) -> DataFrame:
    """(id_col, n_grams, log_weight, key, kept): a draw of ``share`` of the documents towards the rows labelled 1.

    Without ``share`` it is the share of 1 among all labels, so that as much is
    drawn as the labels say is of target quality; without labels, all. The raw
    model counts all documents, the target's at most TARGET_ROWS rows labelled
    1, drawn by the hash of their ids, which are few enough to be broadcast: no
    text is shuffled. Empty tables give empty results; rows that
    repeat are weighed and drawn one by one; further columns are ignored.
    """
    judged = labels.where(F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("__label"))
    total, good = judged.agg(F.count(F.lit(1)), F.sum("__label")).first()
    share = share if share is not None else (good / total if total else 1.0)
    wanted = [i for i, _ in least_by_hash(judged.where("__label = 1"), "__label", id_col, TARGET_ROWS, seed)]
    kind = docs.schema[id_col].dataType.simpleString()
    targets = docs.sparkSession.createDataFrame([(i, True) for i in wanted], f"__id {kind}, __target boolean")
    rows = docs.select(id_col, text_col)
    marked = rows.join(F.broadcast(targets), rows[id_col] == F.col("__id"), "left")
    return resample(weigh(marked, "__target", id_col, text_col, seed), math.ceil(share * docs.count()), id_col)
