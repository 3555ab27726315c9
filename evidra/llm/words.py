"""Hashes of words and of runs of words in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words that a worker keeps the hashes of, at most.
KEPT_WORDS = 100_000
#: Odd, so that it can be divided out.
FACTOR = 0x9E3779B97F4A7C15


class _Hashes(dict):
    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        got = self[word] = xxhash.xxh3_64_digest(word)
        return got


_HASHES = _Hashes()


def split(text: str, fold: bool = False) -> list[bytes]:
    """Runs of characters other than space and U+0009 to U+000D, as UTF-8; fold: A-Z lower-cased."""
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if fold else raw).split()


def hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    return np.frombuffer(b"".join(map(_HASHES.__getitem__, words)), ">u8").astype(np.uint64)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k words (none if there are fewer), built from runs of half the length."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, done, power, n = None, 0, h, 1  # power: runs of n words
    while True:
        if k & n:
            if out is None:
                out, done = power, n
            else:
                m = len(h) - done - n + 1
                out, done = out[:m] * np.uint64(pow(FACTOR, n, 1 << 64)) + power[done : done + m], done + n
        if done == k:
            return out
        m = len(power) - n
        power = power[:m] * np.uint64(pow(FACTOR, n, 1 << 64)) + power[n : n + m]
        n *= 2


def mixed(h: np.ndarray) -> np.ndarray:
    """The hashes with all bits spread, one to one."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))
