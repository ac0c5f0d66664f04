"""Numpy kernels over blocks of UTF-8 text: words, stable hashes, windows."""

from __future__ import annotations

import numpy as np

#: The white space that separates words: space and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: Bytes of a token: ASCII letters and digits, and every byte of a longer UTF-8 sequence.
TOKEN = np.zeros(256, bool)
TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_seed = np.random.default_rng(20240101)
_BYTE = _seed.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(64, _PRIME))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(max(n, 2 * len(_POWERS)), _PRIME))
    return _POWERS


class Block:
    """Texts joined by newlines, as bytes with the place of each text."""

    def __init__(self, texts: list[bytes | None]):
        held = [t or b"" for t in texts]
        self.joined = b"\n".join(held)
        self.data = np.frombuffer(self.joined, np.uint8)
        lengths = np.fromiter(map(len, held), np.int64, len(held))
        self.starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1])) if held else np.zeros(0, np.int64)
        self.ends = self.starts + lengths

    def runs(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of bytes for which ``member`` is true; no run crosses texts if newline isn't one."""
        inside = np.concatenate(([False], member[self.data], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        return edges[::2], edges[1::2]

    def owner(self, positions: np.ndarray) -> np.ndarray:
        """The index of the text in which each byte position lies."""
        return np.searchsorted(self.starts, positions, "right") - 1

    def code_points(self) -> np.ndarray:
        """For each byte position and the end, the code points of the block before it."""
        return np.concatenate(([0], np.cumsum((self.data & 0xC0) != 0x80)))


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes, the same on every machine."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    firsts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    within = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
    at = within + np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        terms = _BYTE[data[at]] * _powers(int(lengths.max()))[within]
        return mix(np.add.reduceat(terms, firsts) + lengths.astype(np.uint64))


def combine(hashes: list[np.ndarray]) -> np.ndarray:
    """An order-dependent hash of several hashes."""
    with np.errstate(over="ignore"):
        out = np.zeros_like(hashes[0])
        for h in hashes:
            out = mix(out * _PRIME + h)
    return out


def fold(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and the letters U+00C0 to U+00DE in lower case; no length changes."""
    out = LOWER[data]
    if len(data):
        after = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][after] += 32
    return out
