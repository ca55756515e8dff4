"""The binary Golay code of length 23: every 23-bit word is within three bits of exactly one codeword.

``near_codewords`` decodes a word to all codewords within four bits of it: one codeword for a
word at most two bits from the nearest, six for the words that are three bits away. Two words
that differ in at most one bit always have a codeword in common: the nearest one of the first
is at most four bits from the second.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

# Fixed value: generator polynomial of the code.
GENERATOR = 0b110001110101
LENGTH, PARITY = 23, 11
MOST = 6


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, PARITY - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - PARITY)
    return word


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low and high half words, and per syndrome the error patterns of weight up to four (-1: none)."""
    low = np.array([_remainder(x) for x in range(1 << 12)], np.int32)
    high = np.array([_remainder(x << 12) for x in range(1 << 11)], np.int32)
    patterns = np.full((1 << PARITY, MOST), -1, np.int32)
    found = np.zeros(1 << PARITY, int)
    single = [_remainder(1 << b) for b in range(LENGTH)]
    for weight in range(5):
        for bits in combinations(range(LENGTH), weight):
            syndrome = 0
            for b in bits:
                syndrome ^= single[b]
            patterns[syndrome, found[syndrome]] = sum(1 << b for b in bits)
            found[syndrome] += 1
    return low, high, patterns


def near_codewords(words: np.ndarray) -> np.ndarray:
    """Indices (0 to 4095) of the codewords within four bits of each 23-bit word; shape (n, 6), -1 where there are fewer."""
    low, high, patterns = tables()
    words = words.astype(np.int32)
    errors = patterns[low[words & 0xFFF] ^ high[words >> 12]]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> PARITY)
