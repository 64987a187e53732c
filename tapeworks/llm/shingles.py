"""Hashed word shingles of texts, many texts at a time, in numpy."""

from __future__ import annotations

import hashlib

import numpy as np

SHINGLE = 5
_RNG = np.random.default_rng(0x7A9E)
BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
_POWERS = {b: np.ones(1, np.uint64) for b in (BASE, INVERSE)}


def mix(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64: a bijection whose output bits all depend on all input bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1, modulo 2^64."""
    p = _POWERS[base]
    while len(p) < n:
        with np.errstate(over="ignore"):
            p = np.concatenate([p, p * np.uint64(pow(base, len(p), 2**64))])
        _POWERS[base] = p
    return p[:n]


def normalise(text: str | None) -> str:
    """Lower-cased words, one space between them."""
    return " ".join(text.lower().split()) if text else ""


def digest(normal: str) -> bytes:
    return hashlib.blake2b(normal.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def shingle_hashes(normal: str, k: int = SHINGLE) -> np.ndarray:
    """One 64-bit hash for each run of k words (of all words, if fewer), in order, repeats included."""
    if not normal:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(normal.encode("utf-8", "surrogatepass"), np.uint8)
    gaps = np.flatnonzero(raw == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(raw)]))
    n = max(1, len(starts) - k + 1)
    a, b = starts[:n], ends[min(k, len(starts)) - 1 :][:n]
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE[raw] * powers(BASE, len(raw)))))
        return mix((sums[b] - sums[a]) * powers(INVERSE, len(raw))[a])
