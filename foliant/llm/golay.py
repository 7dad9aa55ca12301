"""The extended binary Golay code as a fuzzy hash.

A 23-bit word gets a parity bit, so it is even and lies either within two bits of one codeword of the [24, 12, 8] code or at four bits from
exactly six. The 12-bit messages of those codewords are its keys: two words that differ in at most two of the 23 bits always
share a key, words that differ in three or four share one about two times in three.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, which generates the [23, 12, 7] code
KEYS = 6


def _checks() -> np.ndarray:
    """The 12 check bits of every message: 11 remainder bits and the overall parity."""
    out = np.zeros(4096, dtype=np.int64)
    for m in range(4096):
        r = m << 11
        for b in range(22, 10, -1):
            if r >> b & 1:
                r ^= GENERATOR << (b - 11)
        word = m << 11 | r
        out[m] = r << 1 | (word.bit_count() & 1)
    return out


CHECKS = _checks()


def _leaders() -> np.ndarray:
    """For every syndrome of an even word the error patterns of least weight: one (repeated) or six."""
    syndrome = np.array([int(CHECKS[1 << (b - 12)]) if b >= 12 else 1 << b for b in range(24)])
    out = np.full((4096, KEYS), -1, dtype=np.int64)
    n = np.zeros(4096, dtype=np.int64)
    for weight in (0, 2, 4):
        for at in combinations(range(24), weight):
            s = e = 0
            for b in at:
                s ^= int(syndrome[b])
                e |= 1 << b
            if weight < 4 or n[s] == 0 or int(out[s, 0]).bit_count() == 4:
                if n[s] < KEYS:
                    out[s, n[s]] = e
                    n[s] += 1
    return out


LEADERS = _leaders()


def keys(words: np.ndarray) -> np.ndarray:
    """The messages (n x 6, -1 where there is only one) of the codewords nearest to each 23-bit word."""
    w = words.astype(np.int64)
    even = w << 1 | (np.bitwise_count(w) & 1)
    message, check = even >> 12, even & 4095
    e = LEADERS[CHECKS[message] ^ check]
    return np.where(e >= 0, message[:, None] ^ (e >> 12), -1)
