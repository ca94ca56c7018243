"""Hashes of words and word runs, in numpy inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers; powers and inverses are taken modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MASK = (1 << 64) - 1
MEMO_WORDS = 300_000


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Powers:
    """Powers of a base and of its inverse, grown as needed."""

    def __init__(self, base: int) -> None:
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            inverse = pow(self.base, -1, 1 << 64)
            for name, step in (("up", self.base), ("down", inverse)):
                steps = np.full(n, step, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


def finish(x: np.ndarray) -> np.ndarray:
    """Spread the bits of uint64 values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Runs:
    """Hashes of any word run of one document from prefix sums."""

    def __init__(self, hashes: np.ndarray, powers: Powers) -> None:
        up, self.down = powers.to(len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[: len(hashes)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return finish((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))
