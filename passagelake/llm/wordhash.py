"""Hashes of the words of many texts at once, without a Python object per word.

A batch of texts becomes one byte array. A word's hash is a polynomial in its bytes: all
terms are computed in one product with the powers of the base, summed from word start to word
start, and divided by the power that the word began at.
"""

from __future__ import annotations

import numpy as np

from .common import worker_cache

BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse, modulo 2**64."""
    cache = worker_cache("words")
    if len(cache.get("powers", ((),))[0]) < n:
        size = max(n, (1 << 20) + (1 << 17))
        up = np.full(size, BASE & _MASK, np.uint64)
        down = np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        cache["powers"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return cache["powers"]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    return h * np.uint64(0xBF58476D1CE4E5B9)


def hashed_words(data: np.ndarray, gap: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The hash of every word of some bytes, given where the gaps are and where words begin."""
    up, down = _powers(len(data))
    if not len(starts):
        return np.empty(0, np.uint64)
    terms = np.where(gap, np.uint64(0), _BYTES[data]) * up[: len(data)]
    return mix(np.add.reduceat(terms, starts) * down[starts])


class Words:
    """The words of some texts: ``hashes``, byte ``starts``, and the ``bounds`` of each text's words."""

    def __init__(self, texts: list[str], fold: bool = True):
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = b" " + b" ".join(parts) + b" "
        self.raw = np.frombuffer(data, np.uint8)
        self.bytes = FOLD[self.raw] if fold else self.raw
        #: where each text begins
        self.text_starts = 1 + np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)))
        self.space = SPACE[self.bytes]
        begins = np.flatnonzero(self.space[:-1] & ~self.space[1:]) + 1
        self.starts = begins
        self.ends = np.flatnonzero(~self.space[:-1] & self.space[1:]) + 1
        self.bounds = np.searchsorted(begins, self.text_starts)
        self.hashes = hashed_words(self.bytes, self.space, begins)

    def __len__(self) -> int:
        return len(self.hashes)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` words in a row, and the bounds of each text's shingles. A text of
    fewer words, but not none, has all of them as its one shingle."""
    h, bounds = words.hashes, words.bounds
    n = len(h)
    rolled = np.zeros(n, np.uint64)
    factor = np.uint64(0x9DDFEA08EB382D69)
    counts = np.diff(bounds)
    full = np.maximum(counts - size + 1, 0)
    with np.errstate(over="ignore"):
        # Horner over the next words; what runs beyond a text is left out below
        padded = np.concatenate((h, np.zeros(size, np.uint64)))
        for k in range(size):
            rolled = rolled * factor + padded[k : k + n]
        starts = bounds[:-1]
        own = np.repeat(starts - (np.cumsum(full) - full), full) + np.arange(int(full.sum()))
        values = mix(rolled[own])
        short = np.flatnonzero((counts > 0) & (counts < size))
        extra = np.empty(len(short), np.uint64)
        for j, t in enumerate(short):
            acc = np.uint64(0)
            for x in h[bounds[t] : bounds[t + 1]]:
                acc = acc * factor + x
            extra[j] = mix(np.array([acc + np.uint64(int(counts[t]))], np.uint64))[0]
    if not len(short):
        return values, np.concatenate(([0], np.cumsum(full)))
    full[short] = 1
    out = np.empty(int(full.sum()), np.uint64)
    ends = np.cumsum(full)
    is_short = np.zeros(len(out), bool)
    is_short[(ends - 1)[short]] = True
    out[is_short] = extra
    out[~is_short] = values
    return out, np.concatenate(([0], ends))
