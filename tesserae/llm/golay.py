"""The perfect binary Golay code [23, 12, 7] as vectorised lookup tables.

Every 23-bit word lies within 3 bits of exactly one codeword. A word at distance 3 has five more codewords at
distance 4; a nearer word has none. So if two words differ in one bit, the codeword nearest to
either one is within 4 bits of the other: nearest(x) is among near(y), and nearest(y) among near(x).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

#: Fixed value: the code's generator polynomial, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
LENGTH, CHECK = 23, 11


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK)
    return word


class Golay:
    """Decoding tables, built once a process."""

    def __init__(self) -> None:
        self.low = np.array([_remainder(w) for w in range(1 << 12)], np.uint32)
        self.high = np.array([_remainder(w << 12) for w in range(1 << 11)], np.uint32)
        self.error = np.zeros(1 << CHECK, np.uint32)
        for weight in (1, 2, 3):
            for places in combinations(range(LENGTH), weight):
                e = sum(1 << p for p in places)
                self.error[_remainder(e)] = e
        infos = [w << CHECK for w in range(1 << 12)]
        seven = [c for i in infos if (c := i | _remainder(i)).bit_count() == 7]
        self.others = np.full((1 << CHECK, 5), -1, np.int32)
        for s, e in enumerate(self.error.tolist()):
            if e.bit_count() == 3:
                self.others[s] = [c >> CHECK for c in seven if c & e == e]

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.low[words & 0xFFF] ^ self.high[words >> 12]

    def nearest(self, words: np.ndarray) -> np.ndarray:
        """Index (12 bits) of the one codeword within 3 bits."""
        return ((words ^ self.error[self.syndrome(words)]) >> CHECK).astype(np.int64)

    def near(self, words: np.ndarray) -> np.ndarray:
        """Indices of all codewords within 4 bits, six columns; -1 where there is none."""
        first = self.nearest(words)[:, None]
        more = self.others[self.syndrome(words)]
        return np.hstack([first, np.where(more >= 0, first ^ more, -1)])
