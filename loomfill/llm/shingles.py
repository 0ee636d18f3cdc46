"""Shingle sets of texts as sorted arrays of 64-bit hashes, in numpy."""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
_RNG = np.random.default_rng(20_240_601)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) << U(1) | U(1)
#: ASCII white space ends words; everything else belongs to one.
_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
_P, _P_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_STEP = _RNG.integers(1, 1 << 63, 16, dtype=np.uint64) << U(1) | U(1)
_powers = np.zeros((2, 0), np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers (a bijection)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power_tables(n: int) -> np.ndarray:
    """Powers of an odd multiplier and of its inverse modulo 2**64."""
    global _powers
    if _powers.shape[1] < n:
        size = max(1 << 14, 1 << (n - 1).bit_length())
        made = np.ones((2, size), np.uint64)
        made[0, 1:], made[1, 1:] = U(_P), U(_P_INV)
        _powers = np.cumprod(made, axis=1, dtype=np.uint64)
    return _powers


def word_hashes(text: bytes) -> np.ndarray:
    """A hash for each word of ``text`` (runs without ASCII white space), in order."""
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _IN_WORD[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix64((total[end] - total[start]) * down[start])


def shingle_set(text: str, width: int = 3) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words after lower-casing
    A-Z. With fewer words the whole sequence is one shingle; without words the set is empty."""
    words = word_hashes(text.encode().lower())  # bytes.lower() changes A-Z only
    width = min(width, len(words))
    if not width:
        return words
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = out * U(0x9E3779B97F4A7C15) + words[k : k + n] * _STEP[k]
    return np.unique(mix64(out))


def set_digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
