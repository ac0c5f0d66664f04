"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's score is a logistic model over its hashed tokens and their first
bytes, which inflected and compound forms of an insult share. A document is
toxic if at least one sentence is, so its score is the noisy-or of theirs: 1
minus the product of (1 - sentence score). Weights are learned from document
labels by descending the likelihood of that noisy-or; which sentences offend is
never told, and found again by their scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodeline.llm.arrow import by_text, materialise
from lodeline.llm.kernels import TOKEN, Block, fold, hash_runs
from lodeline.llm.sampling import in_training, least_by_hash

#: Buckets of token hashes, as a power of two.
BITS = 18
#: Documents of either label from which the weights are learned, at most, and tokens of them that one task keeps.
PER_LABEL = 3000
SEED = 9
#: Bytes of the beginnings of longer tokens that are features of their own.
PREFIXES = (4, 5, 6, 7)
#: A feature is learned if at least so many toxic documents have it, and its odds there are at least so many times those elsewhere.
SEEN, ENRICHED = 3, 3.0
#: A sentence with at least this score is reported.
OFFENDS = 0.5
#: Bytes that end a sentence: . ! ? and newline.
STOP = np.zeros(256, bool)
STOP[[46, 33, 63, 10]] = True


def instances(texts: list[bytes | None]) -> tuple[Block, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The block; the buckets (one row a feature kind, 1 << BITS if it has none) and the sentence of each token; and for each sentence with a token its text, first and last-plus-one byte."""
    block = Block(texts)
    starts, ends = block.runs(TOKEN)
    data = fold(block.data)
    bucket = np.full((1 + len(PREFIXES), len(starts)), 1 << BITS, np.int64)
    bucket[0] = (hash_runs(data, starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)
    for row, n in enumerate(PREFIXES, 1):
        longer = np.flatnonzero(ends - starts > n)
        h = hash_runs(data, starts[longer], starts[longer] + n)
        bucket[row, longer] = ((h * np.uint64(2 * row + 1)) >> np.uint64(64 - BITS)).astype(np.int64)
    stops = np.cumsum(STOP[block.data]) if len(block.data) else np.zeros(0, np.int64)
    piece = stops[starts] if len(starts) else np.zeros(0, np.int64)
    fresh = np.concatenate((np.ones(1, bool), piece[1:] != piece[:-1])) if len(piece) else np.zeros(0, bool)
    sentence = np.cumsum(fresh) - 1
    first = starts[fresh]
    last = ends[np.concatenate((fresh[1:], np.ones(1, bool)))] if len(fresh) else first
    return block, bucket, sentence, block.owner(first), first, last


@dataclass
class Model:
    """Weights of the buckets and the bias."""

    weights: np.ndarray
    bias: float

    def sentences(self, bucket: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        """The logit of each sentence."""
        return self.bias + np.bincount(sentence, self.weights[bucket].sum(axis=0), n)

    def score(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Of each text the noisy-or of its sentences, their number, and the offending ones as start:end in code points, joined by commas."""
        block, bucket, sentence, owner, first, last = instances(texts)
        z = self.sentences(bucket, sentence, len(owner))
        hazard = np.bincount(owner, np.logaddexp(0, z), len(texts))
        points = block.code_points()
        spans: list[list[str]] = [[] for _ in texts]
        for s in np.flatnonzero(z >= np.log(OFFENDS / (1 - OFFENDS))):
            base = points[block.starts[owner[s]]]
            spans[owner[s]].append(f"{points[first[s]] - base}:{points[last[s]] - base}")
        return -np.expm1(-hazard), np.bincount(owner, minlength=len(texts)), [",".join(x) for x in spans]


@dataclass
class Bags:
    """Labelled documents: the label and the number of sentences of each, and its sentences' learned features.

    ``features`` and ``sentences`` have one entry for each occurrence of a
    feature: its number and that of the sentence within its document.
    """

    labels: np.ndarray
    sizes: np.ndarray
    features: list[np.ndarray]
    sentences: list[np.ndarray]


def fit(bags: Bags, names: np.ndarray, rounds: int = 300, decay: float = 2e-4, rate: float = 0.15) -> Model:
    """Learn the weights of the buckets ``names`` by full-batch Adam on the balanced noisy-or likelihood.

    Documents without sentences teach nothing; without documents of both labels
    the model gives everything the score 0.
    """
    used = np.flatnonzero(bags.sizes > 0)
    y = bags.labels[used].astype(float)
    if not len(used) or y.min() == y.max():
        return Model(np.zeros((1 << BITS) + 1), -40.0)
    counts = bags.sizes[used]
    base = np.concatenate(([0], np.cumsum(counts)[:-1]))
    at = np.concatenate([bags.features[i] for i in used]).astype(np.int64)
    sentence = np.concatenate([bags.sentences[i].astype(np.int64) + first for i, first in zip(used, base, strict=True)])
    bag = np.repeat(np.arange(len(used)), counts)
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    theta = np.zeros(len(names) + 1)
    theta[-1] = -5.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        z = theta[-1] + np.bincount(sentence, theta[at], len(bag))
        hazard = np.bincount(bag, np.logaddexp(0, z), len(y))
        pull = balance * np.where(y == 1, -1 / np.maximum(np.expm1(np.minimum(hazard, 500)), 1e-12), 1.0)
        slope = pull[bag] / (1 + np.exp(np.minimum(-z, 500)))
        grad = np.append(np.bincount(at, slope[sentence], len(names)), slope.sum())
        grad[:-1] += decay / 100 * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta -= rate / (1 + step / 100) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    weights = np.zeros((1 << BITS) + 1)
    weights[names] = theta[:-1]
    return Model(weights, float(theta[-1]))


def enriched(sample: DataFrame) -> np.ndarray:
    """The sorted buckets that at least SEEN toxic documents of rows (y, t) have, with odds ENRICHED times those elsewhere.

    Documents are counted in the cluster; the driver gets such buckets alone.
    """
    none = 1 << BITS

    def run(columns: list[pa.Array], texts: list[bytes | None]) -> list[pa.Array]:
        _, bucket, sentence, owner, _, _ = instances(texts)
        y = columns[0].to_numpy(zero_copy_only=False)
        text = owner[sentence] if len(sentence) else np.zeros(0, np.int64)
        held = np.unique(np.tile(text, len(bucket)) * (none + 1) + bucket.ravel())
        # the number of the absent feature stands for the document itself, which has a sentence
        held = np.unique(np.concatenate((held, np.unique(owner) * (none + 1) + none)))
        return [pa.array(held % (none + 1)), pa.array(y[held // (none + 1)].astype(np.int64))]

    held = by_text(sample, ["y"], "t", "bucket bigint, y bigint", run).groupBy("bucket").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
    held = materialise(held)
    whole = held.where(F.col("bucket") == none).first()
    if whole is None or not whole.toxic or not whole.clean:
        return np.zeros(0, np.int64)
    odds = lambda n, total: (F.col(n) + 0.5) / (total - F.col(n) + 0.5)
    told = held.where((F.col("bucket") < none) & (F.col("toxic") >= SEEN) & (odds("toxic", whole.toxic) >= ENRICHED * odds("clean", whole.clean)))
    return np.array(sorted(r.bucket for r in told.select("bucket").collect()), np.int64)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = PER_LABEL) -> Model:
    """Learn from at most ``per_label`` documents of each label, held-out ids left out.

    The features to learn are chosen in the cluster; of each sampled document the
    driver gets the number of its sentences and the places of those features.
    """
    known = labels.where(in_training(id_col) & F.col(label_col).isin(0, 1)).select(id_col, F.col(label_col).cast("int").alias(label_col))
    picked = dict(least_by_hash(known, label_col, id_col, per_label, SEED))
    kind = docs.schema[id_col].dataType.simpleString()
    told = docs.sparkSession.createDataFrame(list(picked.items()), f"i {kind}, y int")
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    sample = materialise(rows.join(F.broadcast(told), "i").dropDuplicates(["i"]).select("i", "y", "t"))
    names = enriched(sample)
    shared = docs.sparkSession.sparkContext.broadcast(names)

    def run(columns: list[pa.Array], texts: list[bytes | None]) -> list[pa.Array]:
        number = np.full((1 << BITS) + 1, -1, np.int32)
        number[shared.value] = np.arange(len(shared.value))
        _, bucket, sentence, owner, _, _ = instances(texts)
        found = number[bucket]
        row, token = np.nonzero(found >= 0)
        order = np.argsort(token, kind="stable")
        row, token = row[order], token[order]
        own, where = found[row, token], sentence[token]
        sizes = np.bincount(owner, minlength=len(texts))
        first = np.cumsum(sizes) - sizes
        text = owner[where] if len(where) else np.zeros(0, np.int64)
        cuts = np.searchsorted(text, np.arange(1, len(texts)))
        parts = zip(np.split(own, cuts), np.split(where - first[text] if len(text) else where, cuts), strict=True)
        packed = [(f.astype(np.int32).tobytes(), w.astype(np.int32).tobytes()) for f, w in parts]
        return [*columns, pa.array(sizes.astype(np.int64)), *(pa.array([x[k] for x in packed], pa.binary()) for k in (0, 1))]

    out = by_text(sample, ["i", "y"], "t", f"i {kind}, y int, n bigint, f binary, s binary", run).toArrow()
    ids, held = out.column("i").to_pylist(), [out.column(k).to_pylist() for k in "ynfs"]
    order = sorted(range(len(ids)), key=lambda i: str(ids[i]))
    y, n, f, s = ([column[i] for i in order] for column in held)
    unpack = lambda xs: [np.frombuffer(x, np.int32) for x in xs]
    return fit(Bags(np.array(y, np.int64), np.array(n, np.int64), unpack(f), unpack(s)), names)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, predicted, n_sentences, offending) for every whole text.

    ``score`` is the noisy-or, 0 for null, empty and tokenless texts;
    ``predicted`` is 1 from 0.5 on; ``offending`` lists the sentences with a
    score of OFFENDS or more as start:end in code points. Rows are scored one
    by one, so repeats, null ids and further columns make no difference.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(columns: list[pa.Array], texts: list[bytes | None]) -> list[pa.Array]:
        score, n, spans = shared.value.score(texts)
        return [columns[0], pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(spans)]

    kind = docs.schema[id_col].dataType.simpleString()
    return by_text(docs, [id_col], text_col, f"{id_col} {kind}, score double, predicted int, n_sentences bigint, offending string", run)
