"""Whitening of vectors of integers by a compensated covariance.

Three passes over the vectors: their number and exact sums; the outer products of
the centred vectors, accumulated in double-double by error-free transformations,
with the high and low parts of tasks merged in two levels; and the projections.
The driver gets matrices of the vectors' dimension, whatever the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lodeline.llm import eigen, twofold
from lodeline.llm.arrow import bound_batches

#: An entry c becomes floor(SCALE * c) + SHIFT; beyond LARGEST in size it counts as LARGEST.
SCALE, SHIFT, LARGEST = 1024.0, 100_000, 2.0**61
#: Components at most, and the least share of the variance that can be told from none.
COMPONENTS, LEAST_SHARE = 8, 1e-24
#: Vectors whose products are made together.
ROWS = 256


@dataclass(frozen=True)
class Fit:
    """The number of vectors, their sums, and eigenvalues and vectors (columns) of the covariance; None for no vectors."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    @property
    def mean(self) -> twofold.Pair:
        return twofold.of_fractions([Fraction(s, self.n) for s in self.sums])


def _whole(vectors: pa.Array, dimension: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """For the vectors of one array that aren't null and have finite entries only: their places and, by length, their integers."""
    vectors = vectors.cast(pa.list_(pa.float64())) if not pa.types.is_list(vectors.type) else vectors
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    places, found = [], []
    for length in np.unique(lengths).tolist():
        if length == 0 or dimension not in (None, length):
            continue
        at = np.flatnonzero(lengths == length)
        entries = vectors.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, length)
        with np.errstate(invalid="ignore", over="ignore"):
            finite = np.isfinite(entries).all(axis=1)
            scaled = np.clip(np.floor(SCALE * entries[finite]), -LARGEST, LARGEST)
        if not finite.any():
            continue
        places.append(at[finite])
        found.append(scaled.astype(np.int64) + SHIFT)
    return (np.concatenate(places) if places else np.zeros(0, np.int64)), found


def totals(vectors: DataFrame, vector_col: str) -> tuple[int, tuple[int, ...]]:
    """The number of vectors of the commonest length (ties: the longer) and their exact sums, entry by entry."""
    bound_batches(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            for x in _whole(batch.column(0))[1]:
                n, sums = held.get(x.shape[1], (0, [0] * x.shape[1]))
                # halves of the integers add up without overflow
                more = [(int(h) << 32) + int(low) for h, low in zip((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), strict=True)]
                held[x.shape[1]] = n + len(x), [a + b for a, b in zip(sums, more, strict=True)]
        for d, (n, sums) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([n], pa.int64()), pa.array([[str(s) for s in sums]], pa.list_(pa.string()))], ["d", "n", "sums"])

    parts = vectors.select(vector_col).mapInArrow(run, "d int, n bigint, sums array<string>")
    each = parts.select("d", "n", F.posexplode("sums").alias("i", "s")).groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    largest = each.where("i = 0").orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not largest:
        return 0, ()
    rows = each.where(F.col("d") == largest[0].d).orderBy("i").collect()
    return largest[0].n, tuple(int(r.s) for r in rows)


def products(rows: twofold.Pair) -> twofold.Pair:
    """The sum of the outer products of the rows with themselves, upper triangle, in double-double."""
    d = rows[0].shape[1]
    out = np.zeros((d, d)), np.zeros((d, d))
    for at in range(0, len(rows[0]), ROWS):
        high, low = (part[at : at + ROWS] for part in rows)
        for i in range(d):
            own = twofold.total(twofold.multiply((high[:, i : i + 1], low[:, i : i + 1]), (high[:, i:], low[:, i:])))
            out[0][i, i:], out[1][i, i:] = twofold.add((out[0][i, i:], out[1][i, i:]), own)
    return out


def _stored(state: list[twofold.Pair]) -> Iterator[pa.RecordBatch]:
    packed = b"".join(np.ascontiguousarray(x).tobytes() for pair in state for x in pair)
    yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], ["state"])


def gathered(vectors: DataFrame, vector_col: str, shapes: list[tuple[int, ...]], of_batch: Callable[[pa.Array], list[twofold.Pair] | None]) -> list[twofold.Pair]:
    """The sums over all rows of double-double arrays of these shapes; ``of_batch`` gives those of one batch, None for nothing.

    Each task adds up its rows; about the square root of the tasks merge those
    states, and one task merges the rest, high and low parts together.
    """
    bound_batches(vectors.sparkSession)
    sizes = [int(np.prod(s)) for s in shapes]

    def unpacked(raw: bytes) -> list[twofold.Pair]:
        flat, at, out = np.frombuffer(raw), 0, []
        for size, shape in zip(sizes, shapes, strict=True):
            out.append((flat[at : at + size].reshape(shape), flat[at + size : at + 2 * size].reshape(shape)))
            at += 2 * size
        return out

    def summed(states: Iterator[list[twofold.Pair] | None]) -> Iterator[pa.RecordBatch]:
        held = None
        for state in states:
            if state is not None:
                held = state if held is None else [twofold.add(a, b) for a, b in zip(held, state, strict=True)]
        if held is not None:
            yield from _stored(held)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from summed(of_batch(batch.column(0)) for batch in batches)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from summed(unpacked(raw) for batch in batches for raw in batch.column(0).to_pylist())

    picked = vectors.select(vector_col)
    parts = picked.mapInArrow(first, "state binary")
    tasks = picked.rdd.getNumPartitions()
    if tasks > 4:
        parts = parts.repartition(math.isqrt(tasks - 1) + 1).mapInArrow(merge, "state binary")
    found = parts.repartition(1).mapInArrow(merge, "state binary").collect()
    return unpacked(found[0][0]) if found else [(np.zeros(s), np.zeros(s)) for s in shapes]


def _centred(x: np.ndarray, mean: twofold.Pair) -> twofold.Pair:
    return twofold.add(twofold.of_integers(x), twofold.negative(mean))


def fit(vectors: DataFrame, vector_col: str = "embedding") -> Fit | None:
    """The whitening of all vectors of ``vectors`` that are whole; None if there is none."""
    n, sums = totals(vectors, vector_col)
    if not n:
        return None
    d = len(sums)
    mean = Fit(n, sums, *[np.zeros(0)] * 3).mean

    def of_batch(column: pa.Array) -> list[twofold.Pair] | None:
        found = _whole(column, d)[1]
        return [products(_centred(found[0], mean))] if found else None

    high, low = gathered(vectors, vector_col, [(d, d)], of_batch)[0]
    high, low = (np.triu(m) + np.triu(m, 1).T for m in (high, low))
    count = np.full((d, d), float(n)), np.zeros((d, d))
    covariance = twofold.divide((high, low), count)
    values, x = eigen.symmetric(covariance)
    trace = twofold.total((np.diag(covariance[0]).copy(), np.diag(covariance[1]).copy()))[0]
    explained = values / trace if trace > 0 else np.zeros(d)
    k = min(COMPONENTS, d)
    return Fit(n, sums, values[:k], x[:, :k], explained[:k])


def project(x: np.ndarray, model: Fit) -> np.ndarray:
    """The whitened components of vectors of integers, one row each; nan where a component has no variance."""
    high, low = _centred(x, model.mean)
    weights = np.where(model.explained > LEAST_SHARE, 1.0, np.nan) / np.sqrt(np.where(model.explained > LEAST_SHARE, model.values, 1.0))
    return (high @ model.vectors + low @ model.vectors) * weights


def identity_error(vectors: DataFrame, model: Fit, vector_col: str = "embedding") -> float | None:
    """The largest entry, in size, of the whitened vectors' covariance minus the identity; None if no component has variance.

    The projections' mean is zero but for rounding; what is left of it is subtracted.
    """
    able = np.flatnonzero(model.explained > LEAST_SHARE)
    if not len(able):
        return None
    k = len(able)

    def of_batch(column: pa.Array) -> list[twofold.Pair] | None:
        found = _whole(column, len(model.sums))[1]
        if not found:
            return None
        rows = np.ascontiguousarray(project(found[0], model)[:, able])
        pair = rows, np.zeros_like(rows)
        return [products(pair), twofold.total(pair)]

    both, mean = gathered(vectors, vector_col, [(k, k), (k,)], of_batch)
    count = np.float64(model.n), np.float64(0)
    mean = twofold.divide(mean, (np.full(k, count[0]), np.zeros(k)))
    outer = twofold.multiply((mean[0][:, None], mean[1][:, None]), (mean[0][None, :], mean[1][None, :]))
    cov = twofold.add(twofold.divide(both, (np.full((k, k), count[0]), np.zeros((k, k)))), twofold.negative(outer))[0]
    return float(np.abs(np.triu(cov - np.eye(k))).max())


def deviations(x: np.ndarray, model: Fit) -> list[int | None]:
    """The exact sum over entries of (n * x - sum)^2 of each vector; None beyond 64 bits."""
    most = max(abs(int(x.min())), abs(int(x.max())), 1) * model.n + max(abs(s) for s in model.sums)
    if most * most * x.shape[1] < 1 << 63:
        y = model.n * x - np.array(model.sums, np.int64)
        return (y * y).sum(axis=1).tolist()
    if 2 * most < 1 << 62:
        # differences fit, their squares don't: those are added up as halves of 32 bits
        y = np.abs(model.n * x - np.array(model.sums, np.int64)).view(np.uint64)
        high, low = (y >> np.uint64(31)).astype(object), (y & np.uint64((1 << 31) - 1)).astype(object)
        out = ((high << 31) + low) ** 2
    else:
        out = (model.n * x.astype(object) - np.array(model.sums, object)) ** 2
    return [int(v) if v < 1 << 63 else None for v in out.sum(axis=1)]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error): a row for each vector and component up to COMPONENTS.

    Vectors that are null or hold a null or an entry that isn't finite go, and so
    do those of another length than most (ties: the longer), which have no
    covariance with the rest. Entries count as floor(SCALE * c) + SHIFT. Rows that
    repeat an id have results of their own, a null id stays, other columns aren't
    read, and an empty table gives an empty result. A component without variance
    has a null ``whitened`` and doesn't count in ``identity_error``, which is null
    if there is no other; ``explained`` is 0 if all vectors are equal, and
    ``deviation`` is null where it exceeds 64 bits. Of equal eigenvalues any
    orthogonal vectors may be taken, the same for all rows.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    model = fit(vectors, vector_col)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    error, d, k = identity_error(vectors, model, vector_col), len(model.sums), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = _whole(batch.column(1), d)
            if not len(at):
                continue
            x, m = found[0], len(at)
            white = project(x, model).ravel()
            deviation = pa.array(deviations(x, model), pa.int64())
            columns = [
                batch.column(0).take(pa.array(np.repeat(at, k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, model.n, np.int64)),
                deviation.take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(white, mask=np.isnan(white)),
                pa.array(np.tile(model.explained, m)),
                pa.array([error] * (m * k), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select(id_col, vector_col).mapInArrow(run, schema)
