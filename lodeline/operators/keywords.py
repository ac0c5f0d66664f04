"""Which of many keywords each text holds, in one pass by an automaton over all of them.

The automaton (goto, failure and output links) takes a text's length and its hits,
whatever the number of keywords. Keywords of at most MOST_BYTES go to all
executors. A larger table is dealt in chunks of that size, each text meets every
chunk once, and no task and no driver holds more than one chunk.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodeline.session import bounded_batches, checkpointed

#: Bytes of keywords in one automaton, a few dozen times as much when it is built, and texts that meet it in one task.
MOST_BYTES, TEXTS = 4 << 20, 10_000
#: Words by queries, at most, whose times a task holds; more are joined. Texts by words, at most, that are summed up at once.
TIMES, CELLS = 1 << 22, 1 << 20


class Automaton:
    """The distinct keywords that a text holds, in the order of the keywords."""

    def __init__(self, words: list[str]):
        self.built = ahocorasick.Automaton()
        self.empty = [i for i, w in enumerate(words) if not w]
        self.words = words
        for i, word in enumerate(words):
            if word:
                self.built.add_word(word, i)
        if len(self.built):
            self.built.make_automaton()

    def held(self, text: str | None) -> list[str] | None:
        if text is None:
            return None
        found = {i for _, i in self.built.iter(text)} if len(self.built) else set()
        return [self.words[i] for i in sorted(found.union(self.empty))]


def held_keywords(spark: SparkSession, words: list[str], text: Column) -> Column:
    """The array of those of some distinct keywords that a text holds; null for a null text, and every text holds an empty keyword."""
    shared = spark.sparkContext.broadcast(words)
    built: list[Automaton] = []

    @F.pandas_udf("array<string>")
    def held(texts: pd.Series) -> pd.Series:
        if not built:
            built.append(Automaton(shared.value))
        return texts.map(built[0].held)

    return held(text)


def _in_chunks(texts: DataFrame, text_col: str, words: DataFrame, chunks: int, as_: str) -> DataFrame:
    """``texts`` with their hits, for keywords (k) that no one task is to hold; rows are numbered, meet each chunk, and their hits are gathered again."""
    rows = checkpointed(texts.withColumn("__row", F.monotonically_increasing_id()))
    parts = max(1, rows.count() // TEXTS)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keyed = words.select(F.pmod(F.xxhash64("k"), F.lit(chunks)).cast("int").alias("c"), every(parts).alias("j"), F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("__row"), F.col("k").alias("t"))
    met = rows.select(every(chunks).alias("c"), F.pmod(F.xxhash64("__row"), F.lit(parts)).cast("int").alias("j"), F.lit(1).alias("side"), "__row", F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own, automaton = None, [], None
        for batch in batches:
            out_row, out_hits = [], []
            for c, j, side, row, t in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if (c, j) != part:
                    part, own, automaton = (c, j), [], None
                if side == 0:
                    own.append(t)
                    continue
                automaton = automaton or Automaton(own)
                if found := automaton.held(t):
                    out_row.append(row)
                    out_hits.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(out_row, pa.int64()), pa.array(out_hits, pa.list_(pa.string()))], ["__row", "hits"])

    found = keyed.unionByName(met).repartition("c", "j").sortWithinPartitions("c", "j", "side").mapInArrow(run, "__row bigint, hits array<string>")
    gathered = found.groupBy("__row").agg(F.flatten(F.collect_list("hits")).alias("__hits"))
    hits = F.when(F.col(text_col).isNotNull(), F.coalesce("__hits", F.array().cast("array<string>")))
    return rows.join(gathered, "__row", "left").withColumn(as_, hits).drop("__row", "__hits")


def with_hits(texts: DataFrame, text_col: str, keywords: DataFrame, as_: str = "hits") -> DataFrame:
    """``texts`` with an array of the distinct keywords (the one column of ``keywords``) that each text holds.

    Matching is literal and of whole keywords anywhere in the text. A null text
    has null, null keywords are left out, an empty keyword is in every text, and
    repeated rows each have their hits.
    """
    bounded_batches(texts.sparkSession)
    words = keywords.select(F.col(keywords.columns[0]).alias("k")).where("k IS NOT NULL").distinct()
    # the size is taken first: a table of any size is read for it, but none is collected above the bound
    size, count = words.agg(F.sum(F.octet_length("k") + 8), F.count(F.lit(1))).first()
    if (size or 0) <= MOST_BYTES:
        held = sorted(r.k for r in words.limit(count).collect())
        return texts.withColumn(as_, held_keywords(texts.sparkSession, held, F.col(text_col)))
    return _in_chunks(texts, text_col, words, -(-size // MOST_BYTES), as_)


@dataclass(frozen=True)
class Times:
    """How often each query asks each word, so that a text's hits give its sum for every query in one product."""

    queries: list
    words: dict[str, int]
    times: np.ndarray

    @classmethod
    def of(cls, asked: Iterable[tuple]) -> Times:
        """The times of (query, word, times)."""
        asked = list(asked)
        queries, words = ({v: i for i, v in enumerate(dict.fromkeys(row[at] for row in asked))} for at in (0, 1))
        times = np.zeros((len(words), len(queries)))
        for query, word, n in asked:
            times[words[word], queries[query]] += n
        return cls(list(queries), words, times)

    @property
    def texts(self) -> int:
        """How many texts are summed up at once."""
        return max(1, CELLS // max(1, len(self.words)))

    def sums(self, *weighed: tuple[int, list[list[str] | None]]) -> np.ndarray:
        """For texts and queries the sum of the times of the words held, those of each list of hits with its weight."""
        held = np.zeros((len(weighed[0][1]), len(self.words)))
        for weight, hits in weighed:
            for i, own in enumerate(hits):
                at = [j for j in map(self.words.get, own or ()) if j is not None]
                held[i, at] += weight
        return held @ self.times
