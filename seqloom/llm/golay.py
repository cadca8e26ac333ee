"""The perfect binary (23, 12, 7) Golay code as a fuzzy hash of 23-bit words."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

# fixed value: the generator polynomial of the code
GENERATOR = 0b101011100011


def remainder(x: np.ndarray) -> np.ndarray:
    """Syndrome: the remainder of 23-bit words by the generator polynomial."""
    x = x.copy()
    for bit in range(22, 10, -1):
        x = np.where(x >> bit & 1, x ^ (GENERATOR << (bit - 11)), x)
    return x


@cache
def near_errors() -> np.ndarray:
    """For each syndrome, the error patterns of weight up to four that have it: one, or one and five (-1 fills up)."""
    table, used = np.full((2048, 6), -1, np.int64), np.zeros(2048, np.int64)
    for weight in range(5):
        patterns = np.array([sum(1 << b for b in c) for c in combinations(range(23), weight)], np.int64)
        for s, e in zip(remainder(patterns).tolist(), patterns.tolist()):
            table[s, used[s]] = e
            used[s] += 1
    return table


def segment_keys(segments: np.ndarray) -> np.ndarray:
    """Codeword indices within four bits of each 23-bit word, -1 for none, in six columns."""
    errors = near_errors()[remainder(segments)]
    return np.where(errors < 0, -1, (segments[:, None] ^ errors) >> 11)
