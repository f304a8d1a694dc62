"""Vectorised hashing of words and shingles in numpy: 64 bits, equal on every machine and in every process."""

from __future__ import annotations

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240607))
#: A random number for each byte, and odd multipliers.
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
FOLD = np.uint64(0xD6E8FEB86659FD93)

BLANK = np.zeros(256, bool)
BLANK[[0x20, 9, 10, 11, 12, 13]] = True
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers = np.array([1], np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE ** 0 .. n - 1, modulo 2 ** 64."""
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, 4096) - 1, BASE, np.uint64), dtype=np.uint64)])
    return _powers[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def words_in(data: np.ndarray, separators: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of lower-cased bytes."""
    inside = ~separators[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    at = np.flatnonzero(inside)
    lengths = ends - starts
    firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    within = np.arange(len(at)) - np.repeat(firsts, lengths)
    with np.errstate(over="ignore"):
        terms = BYTE[LOWER[data[at]]] * powers(int(lengths.max()))[within]
        return starts, ends, mixed(np.add.reduceat(terms, firsts) + lengths.astype(np.uint64))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of every run of k words (with fewer words: of all of them, if there are any)."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    size = min(n, k)
    out = np.full(n - size + 1, size, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = out * FOLD + words[i : n - size + 1 + i]
    return mixed(out)
