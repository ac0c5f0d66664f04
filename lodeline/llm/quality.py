"""Quality rules and a calibrated classifier over hashed word and character n-grams.

The base rules count words, symbols, repeated lines and repeated windows of
words. A text that passes them is judged by logistic regression on the relative
frequencies of its hashed words, word pairs and character n-grams, trained on
labelled rows; its score is calibrated on rows kept out of the fit and compared
with a fixed threshold.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodeline.llm.arrow import by_text
from lodeline.llm.kernels import SPACE, Block, combine, hash_runs, mix
from lodeline.llm.sampling import least_by_hash, only_ids

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Buckets of n-gram hashes, as a power of two, and the lengths of character n-grams.
BITS, GRAMS = 16, (3, 4)
#: Rows of either label from which the classifier is learned, at most.
PER_LABEL = 1000
SEED = 6
#: A text is kept from this calibrated probability of good quality on.
KEEP = 0.4


@dataclass
class Counts:
    """The base counts of the texts of a block, one entry a text."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray

    def failed(self) -> np.ndarray:
        """Too few words, or too many of them in repeated windows."""
        return (self.n_words < LEAST_WORDS) | (100 * self.n_repeat_words > MOST_REPEATED * self.n_words)


def repeated_words(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each text, its words that lie in a window of WINDOW words found twice or more in it; windows are compared by 64-bit hashes."""
    size = len(hashes) - WINDOW + 1
    if size <= 0:
        return np.zeros(n, np.int64)
    window = combine([hashes[i : i + size] for i in range(WINDOW)] + [mix(owner[:size].astype(np.uint64) + np.uint64(1))])
    whole = owner[:size] == owner[WINDOW - 1 :]
    window, place = window[whole], np.flatnonzero(whole)
    if not len(window):
        return np.zeros(n, np.int64)
    order = np.argsort(window, kind="stable")
    ranked = window[order]
    equal = np.concatenate(([False], ranked[1:] == ranked[:-1], [False]))
    twice = place[order[equal[1:] | equal[:-1]]]
    depth = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(depth, twice, 1)
    np.add.at(depth, twice + WINDOW, -1)
    return np.bincount(owner[np.cumsum(depth[:-1]) > 0], minlength=n)


def base(block: Block, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, owner: np.ndarray) -> Counts:
    """The base counts of a block whose words and word hashes are given."""
    n = len(block.starts)
    points = block.code_points()
    texts = [block.joined[a:b] for a, b in zip(block.starts, block.ends, strict=True)]
    dup = []
    for t in texts:
        lines = [x for x in t.split(b"\n") if x.strip()] if b"\n" in t else []
        dup.append(len(lines) - len(set(lines)))
    return Counts(
        np.bincount(owner, minlength=n),
        np.bincount(owner, points[ends] - points[starts], n).astype(np.int64),
        np.fromiter((len(t) - len(t.translate(None, SYMBOLS)) for t in texts), np.int64, n),
        np.array(dup, np.int64),
        repeated_words(hashes, owner, n),
    )


def read(texts: list[bytes | None]) -> tuple[Block, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The block, and starts, ends, hashes and texts of its words."""
    block = Block(texts)
    starts, ends = block.runs(~SPACE)
    return block, starts, ends, hash_runs(block.data, starts, ends), block.owner(starts)


#: Odd multipliers of the characters of an n-gram, by length and place.
_GRAM = {n: np.random.default_rng(n).integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1) for n in GRAMS}


def features(block: Block, hashes: np.ndarray, owner: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """KINDS kinds of features as (bucket, text) of each occurrence: words, pairs of neighbouring words, and character n-grams by code point."""
    pair = owner[1:] == owner[:-1]
    pairs = combine([hashes[:-1], hashes[1:]])[pair] if len(hashes) > 1 else np.zeros(0, np.uint64)
    out = [(hashes, owner), (pairs, owner[1:][pair])]
    letters = np.frombuffer(block.joined.decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    points = block.code_points()
    if len(letters) == points[-1]:
        inside = np.searchsorted(points[block.starts], np.arange(len(letters)), "right") - 1
        inside[points[block.ends[:-1]]] = -1  # what stands between texts
    else:  # bytes that aren't UTF-8: text by text
        each = [block.joined[a:b].decode("utf-8", "replace") + "\n" for a, b in zip(block.starts, block.ends, strict=True)]
        letters = np.frombuffer("".join(each).encode("utf-32-le"), np.uint32).astype(np.uint64)
        inside = np.repeat(np.arange(len(each)), [len(t) for t in each])
        inside[np.cumsum([len(t) for t in each]) - 1] = -1
    for n in GRAMS:
        size = max(len(letters) - n + 1, 0)
        gram = np.zeros(size, np.uint64)
        with np.errstate(over="ignore"):
            for i, factor in enumerate(_GRAM[n]):
                gram += letters[i : i + size] * factor
        whole = (inside[:size] == inside[n - 1 : n - 1 + size]) & (inside[:size] >= 0)
        out.append((gram[whole], inside[:size][whole]))
    return [((h >> np.uint64(64 - BITS)).astype(np.int64), t) for h, t in out]


@dataclass
class Model:
    """Weights for each kind of feature, bias, and the line that calibrates the score."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def logit(self, kinds: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
        """Uncalibrated: the bias and the mean weight of the features of each kind."""
        z = np.full(n, self.bias)
        for k, (bucket, text) in enumerate(kinds):
            z += np.bincount(text, self.weights[k][bucket], n) / np.maximum(np.bincount(text, minlength=n), 1)
        return z

    def probability(self, kinds: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
        """The calibrated probability of good quality."""
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logit(kinds, n) + self.shift, -40, 40)))


KINDS = 2 + len(GRAMS)


def _adam(x_at: np.ndarray, x_row: np.ndarray, x: np.ndarray, y: np.ndarray, size: int, rounds: int, rate: float, decay: float) -> np.ndarray:
    theta, m, v = (np.zeros(size + 1) for _ in range(3))
    balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
    for step in range(1, rounds + 1):
        z = theta[-1] + np.bincount(x_row, theta[x_at] * x, len(y))
        slope = balance * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        grad = np.append(np.bincount(x_at, slope[x_row] * x, size), slope.sum())
        grad[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return theta


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = 80, rate: float = 0.5, decay: float = 1e-7) -> Model:
    """Learn from rows of (feature, relative frequency), feature = kind << BITS | bucket; every fifth row only calibrates.

    Without both labels the model gives every text the probability 1.
    """
    y = labels.astype(float)
    told = np.arange(len(y)) % 5 != 0
    if len(y) < 10 or y[told].min() == y[told].max() or y[~told].min() == y[~told].max():
        return Model(np.zeros((KINDS, 1 << BITS)), 40.0, 1.0, 0.0)
    own = np.flatnonzero(told)
    at = np.concatenate([rows[i][0] for i in own])
    row = np.repeat(np.arange(len(own)), [len(rows[i][0]) for i in own])
    x = np.concatenate([rows[i][1] for i in own])
    names, place = np.unique(at, return_inverse=True)
    theta = _adam(place, row, x, y[own], len(names), rounds, rate, decay)
    weights = np.zeros(KINDS << BITS)
    weights[names] = theta[:-1]
    rest = np.flatnonzero(~told)
    z = np.array([theta[-1] + float(weights[rows[i][0]] @ rows[i][1]) for i in rest])
    line = _adam(np.zeros(len(z), np.int64), np.arange(len(z)), z / max(z.std(), 1e-9), y[rest], 1, 500, 0.05, 1e-3)
    return Model(weights.reshape(KINDS, -1), float(theta[-1]), float(line[0] / max(z.std(), 1e-9)), float(line[1]))


def rows_of(texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's features with their relative frequencies within their kind."""
    out = []
    for t in texts:
        block, _, _, hashes, owner = read([t])
        at, x = [], []
        for k, (bucket, _) in enumerate(features(block, hashes, owner)):
            names, times = np.unique(bucket, return_counts=True)
            at.append(names + (k << BITS))
            x.append(times / max(len(bucket), 1))
        out.append((np.concatenate(at).astype(np.int32), np.concatenate(x).astype(np.float32)))
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = PER_LABEL) -> Model:
    """Learn from at most ``per_label`` rows of either label; their features reach the driver as bucket numbers and frequencies."""
    known = labels.where(F.col(label_col).isin(0, 1)).select(id_col, F.col(label_col).cast("int").alias(label_col))
    picked = dict(least_by_hash(known, label_col, id_col, per_label, SEED))

    def run(columns: list[pa.Array], texts: list[bytes | None]) -> list[pa.Array]:
        rows = rows_of(texts)
        return [columns[0], *(pa.array([r[c].tobytes() for r in rows], pa.binary()) for c in (0, 1))]

    kind = docs.schema[id_col].dataType.simpleString()
    found = by_text(only_ids(docs, id_col, list(picked)), [id_col], text_col, f"{id_col} {kind}, at binary, x binary", run).dropDuplicates([id_col]).toArrow()
    ids = found.column(0).to_pylist()
    order = sorted(range(len(ids)), key=lambda i: hashlib.md5(str(ids[i]).encode()).digest())
    rows = [tuple(np.frombuffer(found.column(c)[i].as_py(), kind) for c, kind in ((1, np.int32), (2, np.float32))) for i in order]
    return fit(rows, np.array([picked[ids[i]] for i in order]))


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability) for every whole text.

    ``kept`` is false if a base rule fails, else whether the calibrated
    probability reaches ``keep``. A null text counts as empty: no words, so it
    fails. Rows are judged one by one; repeats, null ids and further columns
    make no difference.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(columns: list[pa.Array], texts: list[bytes | None]) -> list[pa.Array]:
        block, starts, ends, hashes, owner = read(texts)
        c = base(block, starts, ends, hashes, owner)
        p = shared.value.probability(features(block, hashes, owner), len(texts))
        failed = c.failed()
        counts = (c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words)
        return [columns[0], *(pa.array(x.astype(np.int64)) for x in counts), pa.array(failed), pa.array(~failed & (p >= keep)), pa.array(p)]

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, probability double"
    return by_text(docs, [id_col], text_col, schema, run)
