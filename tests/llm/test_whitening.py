"""Double-double sums against fractions, eigenvectors against the matrix, and the query against a plain recomputation."""

import math
from fractions import Fraction

import numpy as np
import pytest

from lodeline.llm import eigen, queries, twofold, whitening


def exact(pair):
    return [Fraction(h) + Fraction(low) for h, low in zip(*(np.ravel(x).tolist() for x in pair), strict=True)]


def test_twofold_arithmetic():
    rng = np.random.default_rng(3)
    a, b = ((x, x * rng.normal(size=500) * 1e-17) for x in (rng.normal(size=500) * 10.0 ** rng.integers(-8, 8, 500) for _ in range(2)))
    for f, g in ((twofold.add, lambda x, y: x + y), (twofold.multiply, lambda x, y: x * y), (twofold.divide, lambda x, y: x / y)):
        for x, y, z in zip(exact(a), exact(b), exact(f(a, b)), strict=True):
            assert abs(z - g(x, y)) <= Fraction(1, 2**98) * max(abs(g(x, y)), abs(x) + abs(y) if f is twofold.add else 0)
    s, e = twofold.two_sum(a[0], b[0])
    p, q = twofold.two_product(a[0], b[0])
    assert all(Fraction(w) + Fraction(x) == Fraction(y) + Fraction(z) for w, x, y, z in zip(s, e, a[0], b[0], strict=True))
    assert all(Fraction(w) + Fraction(x) == Fraction(y) * Fraction(z) for w, x, y, z in zip(p, q, a[0], b[0], strict=True))
    for n in (1, 2, 3, 7, 64, 101):
        big = rng.normal(size=n) * 1e16
        assert abs(exact(twofold.total((big, np.zeros(n))))[0] - sum(map(Fraction, big.tolist()))) <= Fraction(1, 10**12)
    x = np.array([2**62 - 1, -(2**61) + 3, 5])
    assert exact(twofold.of_integers(x)) == x.tolist()


def matrices(n):
    rng = np.random.default_rng(n)
    b = rng.normal(size=(n, n))
    yield b @ b.T
    yield np.eye(n)
    yield np.diag(np.arange(n) % 3).astype(float)
    yield b[:, : max(1, n // 3)] @ b[:, : max(1, n // 3)].T
    q, _ = np.linalg.qr(b)
    m = (q * 10.0 ** -np.linspace(0, 14, n)) @ q.T
    yield (m + m.T) / 2
    yield np.ones((n, n)) * 1e10 + np.diag(np.arange(n))
    yield np.diag(np.ones(n)) * 2 - np.diag(np.ones(n - 1), 1) - np.diag(np.ones(n - 1), -1)


@pytest.mark.parametrize("n", [1, 2, 3, 8, 33, 64])
def test_eigenvectors(n):
    for a in matrices(n):
        size = max(np.abs(a).max(), 1e-300)
        d, e, q = eigen.tridiagonal(a)
        t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
        assert np.abs(q @ t @ q.T - a).max() <= 1e-13 * size
        values, vectors = eigen.divide_and_conquer(d, e)
        assert np.abs(vectors * values @ vectors.T - t).max() <= 1e-13 * size and np.abs(vectors.T @ vectors - np.eye(n)).max() <= 1e-13
        values, x = eigen.symmetric((a, np.zeros_like(a)))
        assert (np.diff(values) <= 0).all() and np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-13 * size * n
        assert np.abs(a @ x - x * values).max() <= 1e-13 * size * n and np.abs(x.T @ x - np.eye(n)).max() <= 1e-13


def plain(rows):
    """vec_id to (n, deviation, whitened, explained) from exact integers and numpy's own solver; rows are (id, vector)."""
    held = [(i, [math.floor(1024 * float(c)) + 100_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, d = len(held), len(held[0][1])
    sums = [sum(x[k] for _, x in held) for k in range(d)]
    y = np.array([[n * x[k] - sums[k] for k in range(d)] for _, x in held], object)
    cov = np.array((y.T @ y) / Fraction(n) ** 3, float)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    centred = (y / Fraction(n)).astype(float)
    return held, n, (y * y).sum(axis=1), centred @ vectors / np.sqrt(values), values / np.trace(cov)


def compare(found, rows, tolerance=1e-7):
    held, n, deviation, white, explained = plain(rows)
    k = white.shape[1]
    got = {}
    for r in found:
        got.setdefault(r.vec_id, {})[r.component] = r
    assert len(found) == len(held) * k
    table = np.array([[got[i][c + 1].whitened for c in range(k)] for i, _ in held])
    for (i, _), dev in zip(held, deviation, strict=True):
        assert all((r.n, r.deviation) == (n, dev if dev < 1 << 63 else None) for r in got[i].values()), i
        assert all(abs(r.explained - explained[c - 1]) <= 1e-10 * explained[c - 1] + 1e-15 for c, r in got[i].items())
    sign = np.sign((table * white).sum(axis=0))
    assert np.abs(table * sign - white).max() < tolerance
    error = np.abs(table.T @ table / n - np.eye(k)).max()
    assert len({r.identity_error for r in found}) == 1 and abs(found[0].identity_error - error) < 1e-9 and error < 1e-9


def test_query_against_numpy(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    compare(queries.op12_whitening(spark, sf_dir).collect(), rows)


def test_offsets_and_many_partitions(spark):
    rng = np.random.default_rng(8)
    # a large common offset and very unequal variances
    x = rng.normal(size=(600, 12)) * 10.0 ** np.linspace(4, -2, 12) @ np.linalg.qr(rng.normal(size=(12, 12)))[0] + 1e7
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(23)
    # numpy's solver, in doubles, knows the smallest of these components to few digits
    compare(whitening.whiten(docs).collect(), rows, 1e-3)


def test_rows_of_every_kind(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(90, None, 1), (91, [1.0, None], 1), (92, [nan, 1.0], 1), (93, [1.0, inf], 1), (94, [], 1), (95, [1.0], 1), (96, [1.0, 2.0, 3.0], 1)]
    good = [(1, [0.5, -2.0], 1), (2, [3.25, 1.0], 1), (None, [0.0, 0.0], 1), (2, [3.25, 1.0], 1)]
    shape = "vec_id long, embedding array<double>, component int"
    found = whitening.whiten(spark.createDataFrame(bad + good, shape)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in found) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 1), (2, 2), (2, 2)]
    assert {r.n for r in found} == {4} and found[0].identity_error < 1e-12
    assert abs(sum(r.explained for r in found if r.vec_id == 1) - 1) < 1e-12
    assert whitening.whiten(spark.createDataFrame([], shape)).collect() == [] == whitening.whiten(spark.createDataFrame(bad[:5], shape)).collect()
    same = whitening.whiten(spark.createDataFrame([(1, [2.0, 3.0], 0), (2, [2.0, 3.0], 0)], shape)).collect()
    assert {(r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(0, None, 0.0, None)}
    flat = whitening.whiten(spark.createDataFrame([(1, [2.0, 3.0], 0), (2, [4.0, 3.0], 0)], shape)).collect()
    assert {(r.component, r.whitened) for r in flat} == {(1, 1.0), (1, -1.0), (2, None)} and {r.identity_error for r in flat} == {0.0}
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300], 0), (2, [-1e300], 0), (3, [5.0], 0)], shape)).collect()
    assert [r.deviation for r in huge if r.vec_id == 1] == [None] and len(huge) == 3
    wide = whitening.whiten(spark.createDataFrame([(1, [2e6], 0), (2, [0.0], 0)], shape)).collect()
    assert [r.deviation for r in wide] == [(1024 * 2 * 10**6) ** 2] * 2


def test_deviations_of_every_size():
    for scale in (1, 1 << 12, 1 << 30, 1 << 52):
        x = np.array([[3, -7], [11, 5], [2, 2]], np.int64) * scale
        model = whitening.Fit(3, tuple(x.sum(axis=0).tolist()), *[np.zeros(0)] * 3)
        expected = [sum((3 * int(a) - s) ** 2 for a, s in zip(row, model.sums, strict=True)) for row in x]
        assert whitening.deviations(x, model) == [v if v < 1 << 63 else None for v in expected]
