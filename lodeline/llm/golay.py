"""The perfect binary Golay code (23, 12, 7) as a fuzzy hash.

Every word of 23 bits is within 3 bits of exactly one codeword, so decoding is a
hash with 4096 values that tolerates errors. A word and all words one bit away
decode to one codeword or to six; two words that differ in at most two bits have
a word within one bit of both, so their sets of codewords meet.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

#: Length and generator polynomial x^11+x^9+x^7+x^6+x^5+x+1 of the code.
LENGTH, GENERATOR = 23, 0b101011100011


def _remainder(word: int) -> int:
    for shift in range(LENGTH - 1, 10, -1):
        if word >> shift & 1:
            word ^= GENERATOR << (shift - 11)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and of the high 11 bits, and the error that each syndrome stands for."""
    unit = [_remainder(1 << i) for i in range(LENGTH)]
    low, high = np.zeros(1 << 12, np.int32), np.zeros(1 << 11, np.int32)
    for i in range(12):
        low[np.arange(1 << 12) >> i & 1 == 1] ^= unit[i]
    for i in range(11):
        high[np.arange(1 << 11) >> i & 1 == 1] ^= unit[12 + i]
    error = np.zeros(1 << 11, np.int32)
    for n in (1, 2, 3):
        for places in combinations(range(LENGTH), n):
            word, syndrome = 0, 0
            for i in places:
                word |= 1 << i
                syndrome ^= unit[i]
            error[syndrome] = word
    return low, high, error


_LOW, _HIGH, _ERROR = _tables()


def decode(words: np.ndarray) -> np.ndarray:
    """The index, 0 to 4095, of the codeword nearest to each word of 23 bits."""
    words = words.astype(np.int64)
    nearest = words ^ _ERROR[_LOW[words & 0xFFF] ^ _HIGH[words >> 12]]
    return nearest >> 11


def nearby(words: np.ndarray, bits: int = LENGTH) -> np.ndarray:
    """For each word, the indices of its own codeword and of those of the words one of ``bits`` bits away, one per column."""
    flips = np.concatenate(([0], 1 << np.arange(bits, dtype=np.int64)))
    return decode(words.astype(np.int64)[:, None] ^ flips[None, :])
