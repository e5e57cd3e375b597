"""The binary Golay code of length 23, as tables made from its generator polynomial.

It is perfect: every 23-bit word is within 3 bits of exactly one of its 4096 codewords. keys() gives a
word's codewords within 4 bits: one if the nearest is within 2 bits, six if it is 3 bits away. Any
two words that differ in at most 2 bits have one of these in common.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


_MADE: list = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Made once in each process. Syndromes of the upper 12 bits; by syndrome, the nearest error and the five of weight 4 (or -1)."""
    if _MADE:
        return _MADE[0]
    high = np.array([_remainder(x << 11) for x in range(4096)], dtype=np.int64)
    single = [_remainder(1 << i) for i in range(23)]
    errors = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            syndrome = 0
            for i in bits:
                syndrome ^= single[i]
            if weight < 4 or len(errors[syndrome]) and errors[syndrome][0].bit_count() == 3:
                errors[syndrome].append(sum(1 << i for i in bits))
    table = np.full((2048, 6), -1, dtype=np.int64)
    for s, found in enumerate(errors):
        table[s, : len(found)] = found
    _MADE.append((high, table))
    return high, table


def keys(words: np.ndarray) -> np.ndarray:
    """(n, 6): numbers (0 to 4095) of the codewords within 4 bits of each 23-bit word, -1 where fewer."""
    high, table = _tables()
    words = words.astype(np.int64)
    errors = table[high[words >> 11] ^ (words & 2047)]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11)
