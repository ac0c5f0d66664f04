"""Benchmark decontamination by spaced-seed hashing.

A mask names the positions of a window of tokens that count; the others may
differ. Windows of benchmark items and of documents are hashed under every mask
and joined by hash; document windows that can't have a partner are left out
before the join by a bitmap of bounded size. A hit fixes how the document and
the item lie against each other, and the tokens of that alignment are compared
around it: an overlap is the stretch in which matches outweigh substitutions
four to one, and it counts from MATCHED matching tokens on.

Items of SHORT tokens or fewer must lie in the text whole; from TOLERANT tokens
on one of them may differ. One of the item's halves then agrees, so halves (or
the whole of items without tolerance) are what is hashed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from lodeline.llm.alike import texts_of
from lodeline.llm.arrow import bound_batches, by_text, free, materialise
from lodeline.llm.bitmaps import bitmap, in_bitmap
from lodeline.llm.kernels import TOKEN, Block, combine, fold, hash_runs

#: The masks; 1 is a position that counts. Any stretch with MATCHED or more matches, four a substitution, has a window that agrees under one of them.
MASKS = ("111011010011", "110101110011", "111100101011", "101110011101")
#: Matching tokens that make an overlap.
MATCHED = 13
#: A substitution costs as much as so many matches bring.
COST = 4
#: Items with at most so many tokens must lie in the text whole, and from how many on one token may differ.
SHORT, TOLERANT = 13, 8
#: Tokens after which a text may repeat so that the inner windows of the run are left out.
PERIOD = 16
#: Bits of the bitmap as powers of two: the least, the most (64 MB), and how many for each benchmark window between them.
LEAST_BITS, MOST_BITS, SPARSE = 25, 29, 6
#: Texts that a task remembers in order not to look up their copies, and found rows that are broadcast; more are joined by a shuffle.
SEEN, BROADCAST_ROWS = 200_000, 200_000


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens of a block, and for each text the number of tokens before it (one more entry at the end)."""
    block = Block(texts)
    starts, ends = block.runs(TOKEN)
    before = np.append(np.searchsorted(starts, block.starts), len(starts))
    return hash_runs(fold(block.data), starts, ends), before


def window_hashes(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the counting tokens of each window of the mask's span, told apart by mask."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    salt = np.full(n, int(mask, 2) << 8 | len(mask), np.uint64)
    return combine([salt, *(hashes[i : i + n] for i, c in enumerate(mask) if c == "1")])


def item_masks(n: int) -> list[tuple[str, int | None]]:
    """The masks under which an item of n tokens is hashed, each at one place or (None) at all."""
    if n > SHORT:
        return [(mask, None) for mask in MASKS]
    if n >= TOLERANT:
        half = n // 2
        return [("1" * half, 0), ("1" * half, n - half)]
    return [("1" * n, 0)]


def edges_of_runs(h: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which of the windows ``at`` are no inner ones of a run of some period; ``low`` and ``high`` bound the windows of each one's own text.

    Text that repeats every q tokens has the same hash at every qth window. Of a
    run the first and the last q windows stay, which have all its hashes: an
    alignment of two runs inside them matches no more than those at their ends.
    """
    out = np.ones(len(at), bool)
    for q in range(1, PERIOD + 1):
        some = np.flatnonzero(out & (at - q >= low) & (at + q < high))
        own = h[at[some]]
        out[some[(h[at[some] - q] == own) & (h[at[some] + q] == own)]] = False
    return out


def item_windows(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of an item's windows under its masks, and their places."""
    hashes, _ = tokens([text])
    h, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for mask, place in item_masks(len(hashes)) if len(hashes) else []:
        own = window_hashes(hashes, mask)
        every = np.arange(len(own))
        keep = every[edges_of_runs(own, every, np.zeros_like(every), np.full_like(every, len(own)))] if place is None else np.array([place])
        h.append(own[keep])
        at.append(keep)
    return np.concatenate(h), np.concatenate(at)


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """The best stretch of an alignment, of equally good ones the longest: first and last-plus-one document token, and matches. Document token i lies on item token i - diagonal."""
    low, high = max(0, diagonal), min(len(doc), diagonal + len(item))
    same = doc[low:high] == item[low - diagonal : high - diagonal]
    total = np.concatenate(([0], np.cumsum(np.where(same, 1, -COST))))
    least = np.minimum.accumulate(total)
    gain = (total - least)[::-1]
    end = len(gain) - 1 - int(np.argmax(gain))
    start = int(np.argmin(total[: end + 1]))
    return low + start, low + end, int(same[start:end].sum())


def counts_as(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """The overlap of an alignment if it counts: of an item up to SHORT tokens the whole, of others the best stretch with MATCHED matches."""
    n = len(item)
    if n > SHORT:
        found = overlap(doc, item, diagonal)
        return found if found[2] >= MATCHED else None
    if diagonal < 0 or diagonal + n > len(doc):
        return None
    matches = int((doc[diagonal : diagonal + n] == item).sum())
    return (diagonal, diagonal + n, matches) if matches >= n - (n >= TOLERANT) else None


def best(doc: np.ndarray, item: np.ndarray, diagonals: list[int]) -> tuple[int, int, int, int] | None:
    """Of all alignments that count: first token, tokens and matches of that with the most matches, the first in the text among equals, and how many there are."""
    found = [x for d in sorted(diagonals) if (x := counts_as(doc, item, d))]
    if not found:
        return None
    first, end, matches = max(found, key=lambda x: (x[2], -x[0], x[1]))
    return first, end - first, matches, len(found)


def _items(benchmark: DataFrame, item_text: str, least_tokens: int) -> DataFrame:
    """(ikey, it): the distinct texts of the benchmark with at least so many tokens."""
    bound_batches(benchmark.sparkSession)

    def run(columns: list[pa.Array], texts: list[bytes | None]) -> list[pa.Array]:
        _, before = tokens(texts)
        keep = pa.array(np.flatnonzero(np.diff(before) >= max(least_tokens, 1)))
        return [columns[0].take(keep), pa.array(texts, pa.binary()).take(keep)]

    text = F.col(item_text)
    rows = benchmark.where(text.isNotNull()).select(F.xxhash64(text.cast("binary")).alias("k"), text.alias("t"))
    return by_text(rows, ["k"], "t", "ikey bigint, it binary", run).groupBy("ikey").agg(F.first("it").alias("it"))


def _found(docs: DataFrame, benchmark: DataFrame, text_col: str, item_text: str, least_tokens: int) -> DataFrame:
    """(node, ikey, first_token, n_tokens, n_matched, n_alignments) for the distinct texts of documents and items that overlap."""
    spark = docs.sparkSession
    items = materialise(_items(benchmark, item_text, least_tokens))

    def item_rows(batches):
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, at = item_windows(text)
                n = len(tokens([text])[0])
                spans = [m for m, _ in item_masks(n)]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), key)), pa.array(at), pa.array([",".join(spans)] * len(h), pa.string())], ["h", "ikey", "place", "masks"])

    windows = materialise(items.mapInArrow(item_rows, "h bigint, ikey bigint, place bigint, masks string"))
    # the masks in use: the four and at most one for each length up to SHORT
    masks = sorted({m for row in windows.select("masks").distinct().collect() for m in row.masks.split(",")})
    total = windows.count()
    bits = min(max(LEAST_BITS, total.bit_length() + SPARSE), MOST_BITS)
    places = windows.select(F.explode(F.array(F.shiftrightunsigned("h", 64 - bits), F.col("h").bitwiseAND(F.lit((1 << bits) - 1)))).alias("p"))
    marks: Broadcast = spark.sparkContext.broadcast(bitmap(places, 1 << bits))
    seen: set[int] = set()

    def lookups(columns: list[pa.Array], texts: list[bytes | None]) -> list[pa.Array]:
        nodes = columns[0].to_numpy(zero_copy_only=False)
        fresh = []
        for i, node in enumerate(nodes.tolist()):
            if node not in seen:
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                fresh.append(i)
        nodes = nodes[fresh]
        hashes, before = tokens([texts[i] for i in fresh])
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3]
        for mask in masks if len(hashes) else []:
            h = window_hashes(hashes, mask)
            at = np.flatnonzero(in_bitmap(marks.value, (h >> np.uint64(64 - bits)).astype(np.int64)))
            at = at[in_bitmap(marks.value, (h[at] & np.uint64((1 << bits) - 1)).astype(np.int64))]
            text = np.searchsorted(before, at, "right") - 1
            inside = at + len(mask) <= before[text + 1]
            at, text = at[inside], text[inside]
            if len(at):
                run = edges_of_runs(h, at, before[text], before[text + 1] - len(mask) + 1)
                at, text = at[run], text[run]
                out.append((h[at].view(np.int64), nodes[text], at - before[text]))
        return [pa.array(np.concatenate(x)) for x in zip(*out, strict=True)]

    text = F.col(text_col)
    rows = docs.where(text.isNotNull()).select(F.xxhash64(text).alias("node"), text.alias("t"))
    hits = by_text(rows, ["node"], "t", "h bigint, node bigint, at bigint", lookups)
    met = hits.join(windows.select("h", "ikey", "place"), "h").select("node", "ikey", (F.col("at") - F.col("place")).alias("d"))
    pairs = materialise(met.groupBy("node", "ikey").agg(F.collect_set("d").alias("d")))
    told = texts_of(rows, pairs.select("node")).join(pairs, "node").join(items, "ikey")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            nodes, texts = batch.column(0).to_pylist(), batch.column(3)
            for i, node in enumerate(nodes):
                if node != last:
                    last, own = node, tokens([texts[i].as_py()])[0]
                if x := best(own, tokens([batch.column(4)[i].as_py()])[0], batch.column(2)[i].as_py()):
                    out.append((node, batch.column(1)[i].as_py(), *x))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(6)], ["node", "ikey", "first_token", "n_tokens", "n_matched", "n_alignments"])

    schema = "node bigint, ikey bigint, first_token bigint, n_tokens bigint, n_matched bigint, n_alignments bigint"
    return materialise(told.select("node", "ikey", "d", "t", "it").mapInArrow(compare, schema))


def _joinable(found: DataFrame) -> DataFrame:
    """Marked for broadcasting if a count shows that it is small."""
    return F.broadcast(found) if found.count() <= BROADCAST_ROWS else found


def overlaps(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least_tokens: int = 1
) -> DataFrame:
    """Pairs of a document and a benchmark item that overlap: (id_col, item_id, first_token, n_tokens, n_matched, n_alignments).

    One row for each such pair with the longest overlap, the first in the text
    among equally long ones; tokens count from 0. Null and empty texts on either
    side overlap with nothing; items of fewer than ``least_tokens`` tokens are
    left out, which by default is none. Rows that repeat give repeated results,
    an empty table an empty one, and further columns are ignored. The benchmark
    may have any size: it is never gathered in the driver or in a worker.
    """
    found = _joinable(_found(docs, benchmark, text_col, item_text, least_tokens))
    ids = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("node")).where(F.col(text_col).isNotNull())
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_col).alias("item"), F.xxhash64(F.col(item_text).cast("binary")).alias("ikey"))
    joined = ids.join(found, "node").join(items, "ikey")
    return joined.select(F.col("id").alias(id_col), F.col("item").alias("item_id"), "first_token", "n_tokens", "n_matched", "n_alignments")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text: str = "text", least_tokens: int = 1) -> DataFrame:
    """The documents that overlap with no benchmark item, all columns kept.

    Each row is judged by its text, so null or repeated ids don't matter; null
    and empty texts stay, and empty tables change nothing. Items of fewer than
    ``least_tokens`` tokens are left out, which by default is none.
    """
    name = free("node", docs)
    bad = materialise(_found(docs, benchmark, text_col, item_text, least_tokens).select(F.col("node").alias(name)).distinct())
    marked = docs.withColumn(name, F.when(F.col(text_col).isNotNull(), F.xxhash64(F.col(text_col))))
    return marked.join(_joinable(bad), name, "left_anti").select(*docs.columns)
