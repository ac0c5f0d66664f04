"""Double-double numbers: unevaluated sums of two doubles, with error-free transformations (Knuth, Dekker)."""

from __future__ import annotations

from fractions import Fraction

import numpy as np

Pair = tuple[np.ndarray, np.ndarray]
_SPLIT = 134217729.0  # 2^27 + 1


def two_sum(a, b) -> Pair:
    """a + b, rounded, and what rounding lost."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def _quick(a, b) -> Pair:
    """two_sum for abs(a) >= abs(b)."""
    s = a + b
    return s, b - (s - a)


def _halves(a) -> Pair:
    t = _SPLIT * a
    high = t - (t - a)
    return high, a - high


def two_product(a, b) -> Pair:
    """a * b, rounded, and what rounding lost."""
    p = a * b
    (ah, al), (bh, bl) = _halves(a), _halves(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def add(a: Pair, b: Pair) -> Pair:
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = _quick(s, e + t)
    return _quick(s, e + f)


def negative(a: Pair) -> Pair:
    return -a[0], -a[1]


def multiply(a: Pair, b: Pair) -> Pair:
    p, e = two_product(a[0], b[0])
    return _quick(p, e + (a[0] * b[1] + a[1] * b[0]))


def divide(a: Pair, b: Pair) -> Pair:
    first = a[0] / b[0]
    rest = add(a, negative(multiply((first, np.zeros_like(first)), b)))
    second = rest[0] / b[0]
    rest = add(rest, negative(multiply((second, np.zeros_like(second)), b)))
    high, low = _quick(first, second)
    return _quick(high, low + rest[0] / b[0])


def total(a: Pair) -> Pair:
    """The sum along the first axis, by halving."""
    high, low = a
    while len(high) > 1:
        half = len(high) // 2
        odd = (high[2 * half :], low[2 * half :])
        high, low = add((high[:half], low[:half]), (high[half : 2 * half], low[half : 2 * half]))
        if len(odd[0]):
            first = add((high[:1], low[:1]), odd)
            high[:1], low[:1] = first
    return high[0], low[0]


def of_integers(x: np.ndarray) -> Pair:
    """64-bit integers, exactly (up to 2^62 in size)."""
    high = x.astype(np.float64)
    return high, (x - high.astype(np.int64)).astype(np.float64)


def of_fractions(x: list[Fraction]) -> Pair:
    high = np.array([float(v) for v in x])
    return high, np.array([float(v - Fraction(h)) for v, h in zip(x, high.tolist(), strict=True)])


def product(a: Pair, b: Pair) -> Pair:
    """The matrix product."""
    out = np.zeros((a[0].shape[0], b[0].shape[1])), np.zeros((a[0].shape[0], b[0].shape[1]))
    for k in range(a[0].shape[1]):
        out = add(out, multiply((a[0][:, k : k + 1], a[1][:, k : k + 1]), (b[0][k : k + 1], b[1][k : k + 1])))
    return out


def transpose(a: Pair) -> Pair:
    return a[0].T, a[1].T
