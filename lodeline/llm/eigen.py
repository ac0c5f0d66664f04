"""Eigenvalues and vectors of a symmetric matrix: tridiagonal form, divide and conquer, refinement in double-double."""

from __future__ import annotations

import numpy as np

from lodeline.llm import twofold

EPSILON = float(np.finfo(float).eps)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and the orthogonal q with a = q t q', by Householder reflections."""
    a, n = a.astype(np.float64).copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.abs(v).max()
        if size == 0:
            continue
        v /= size
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        # both sides of the rest are reflected, and so are the columns of q
        a[k + 1 :, k:] -= 2 * np.outer(v, v @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def _roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """For each root of 1 + rho * sum(z^2 / (d - x)) the nearest pole's index and the root's distance from it.

    d ascends strictly, no z is 0 and rho > 0: there is a root after each pole.
    Roots are bisected over the bit patterns of their distance, to the last bit.
    """
    n = len(d)
    after = np.append(d[1:], d[-1] + rho * float(z @ z))
    gap = after - d
    square = rho * z * z

    def value(pole, distance):
        with np.errstate(divide="ignore"):
            return 1 + (square[None, :] / ((d[None, :] - d[pole][:, None]) - distance[:, None])).sum(axis=1)

    here = np.arange(n)
    # the function rises between poles: where it is not positive in the middle, the root is nearer to the next pole
    late = value(here, gap / 2) <= 0
    late[-1] = False
    pole = np.where(late, here + 1, here)
    sign = np.where(late, -1.0, 1.0)
    low = np.zeros(n, np.int64)
    high = np.where(late | (here < n - 1), gap / 2, gap * (1 + 4 * EPSILON)).view(np.int64)
    for _ in range(64):
        middle = low + (high - low) // 2
        above = value(pole, sign * middle.view(np.float64)) * sign > 0
        high = np.where(above, middle, high)
        low = np.where(above, low, middle)
    # the least distance that isn't 0 at the pole itself
    return pole, sign * np.maximum(high, 1).view(np.float64)


def rank_one(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of diag(d) + rho z z' for rho >= 0."""
    n = len(d)
    order = np.argsort(d, kind="stable")
    d, z = d[order].copy(), z[order].copy()
    back = np.eye(n)[:, order]
    most = 8 * EPSILON * max(np.abs(d).max(), rho * float(z @ z))
    # a weight so small that it changes nothing is left out; of two equal poles a rotation frees one
    free = np.flatnonzero(rho * np.abs(z) * np.linalg.norm(z) <= most)
    held = np.ones(n, bool)
    held[free] = False
    last = -1
    for i in np.flatnonzero(held):
        if last >= 0:
            r = np.hypot(z[last], z[i])
            c, s = z[i] / r, z[last] / r
            if abs((d[i] - d[last]) * c * s) <= most:
                z[i], z[last] = r, 0.0
                d[last], d[i] = c * c * d[last] + s * s * d[i], s * s * d[last] + c * c * d[i]
                back[:, [last, i]] = back[:, [last, i]] @ np.array([[c, s], [-s, c]])
                held[last] = False
        last = i
    values, vectors = d.copy(), np.eye(n)
    at = np.flatnonzero(held)
    if len(at):
        poles, weights = d[at], z[at]
        pole, distance = _roots(poles, weights, rho)
        values[at] = poles[pole] + distance
        # weights for which the computed roots are exact keep the vectors orthogonal
        apart = (poles[pole][None, :] - poles[:, None]) + distance[None, :]
        between = poles[None, :] - poles[:, None]
        np.fill_diagonal(between, 1.0)
        ratio = apart / np.where(np.eye(len(at), dtype=bool), 1.0, between)
        weights = np.copysign(np.sqrt(np.abs(np.prod(ratio, axis=1)) / rho), weights)
        own = weights[:, None] / apart
        vectors[np.ix_(at, at)] = own / np.linalg.norm(own, axis=0)
    return values, back @ vectors


def divide_and_conquer(d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of the tridiagonal matrix with diagonal d and off-diagonal e."""
    n = len(d)
    if n == 1:
        return d.copy(), np.eye(1)
    half = n // 2
    rho = abs(e[half - 1])
    first, second = d[:half].copy(), d[half:].copy()
    first[-1] -= rho
    second[0] -= rho
    (d1, q1), (d2, q2) = divide_and_conquer(first, e[: half - 1]), divide_and_conquer(second, e[half:])
    q = np.zeros((n, n))
    q[:half, :half], q[half:, half:] = q1, q2
    values = np.concatenate((d1, d2))
    if rho == 0:
        return values, q
    values, vectors = rank_one(values, np.concatenate((q1[-1], np.copysign(1.0, e[half - 1]) * q2[0])), rho)
    return values, q @ vectors


def refined(a: twofold.Pair, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, and vectors to the last bits of a double, from nearly right vectors x of a (Ogita and Aishima)."""
    n = len(x)
    for _ in range(8):
        held = x, np.zeros_like(x)
        r = twofold.add((np.eye(n), np.zeros((n, n))), twofold.negative(twofold.product(twofold.transpose(held), held)))
        s = twofold.product(twofold.transpose(held), twofold.product(a, held))
        one = np.ones(n), np.zeros(n)
        values = twofold.divide((np.diag(s[0]), np.diag(s[1])), twofold.add(one, (-np.diag(r[0]), -np.diag(r[1]))))[0]
        s, r = s[0], r[0]
        gap, turn = values[None, :] - values[:, None], np.abs(s + values[None, :] * r)
        np.fill_diagonal(turn, 0)
        # vectors whose values differ by less than the matrix is known to are only kept orthogonal
        far = (np.abs(gap) > 16 * turn) & (gap != 0)
        step = np.where(far, (s + values[None, :] * r) / np.where(far, gap, 1.0), r / 2)
        x = x + x @ step
        if np.abs(step).max() <= 8 * EPSILON:
            break
    for _ in range(12):
        held = x, np.zeros_like(x)
        r = np.eye(n) - twofold.product(twofold.transpose(held), held)[0]
        x = x + x @ r / 2
        if np.abs(r).max() <= 8 * EPSILON:
            break
    return values, x / np.linalg.norm(x, axis=0)


def symmetric(a: twofold.Pair) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors, as columns, of a symmetric double-double matrix; the largest entry of a vector is positive."""
    scale = np.abs(a[0]).max() if a[0].size else 0.0
    if scale == 0:
        return np.zeros(len(a[0])), np.eye(len(a[0]))
    # a power of two, so that scaling is exact
    scale = 2.0 ** np.floor(np.log2(scale))
    a = a[0] / scale, a[1] / scale
    d, e, q = tridiagonal(a[0])
    _, vectors = divide_and_conquer(d, e)
    values, x = refined(a, q @ vectors)
    order = np.argsort(-values, kind="stable")
    values, x = values[order] * scale, x[:, order]
    return values, x * np.where(np.take_along_axis(x, np.abs(x).argmax(axis=0)[None, :], 0)[0] < 0, -1.0, 1.0)
