"""Vectorised 64-bit hashes of words and byte windows (all arithmetic is modulo 2**64)."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _table(kind: str, n: int) -> np.ndarray:
    """Powers 0..n-1 of the base ("up") or of its inverse ("down")."""
    if len(_powers[kind]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        factors = np.full(size, _BASE if kind == "up" else _INVERSE, np.uint64)
        factors[0] = 1
        _powers[kind] = np.multiply.accumulate(factors)
    return _powers[kind][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """Sums of byte * base**place up to each place; one entry more than there are bytes."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _table("up", len(raw)), out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed hashes of byte spans; equal bytes have equal hashes wherever they are."""
    down = _table("down", len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash for each run of bytes other than the six ASCII white-space characters, in order."""
    if not len(raw):
        return np.zeros(0, np.uint64)
    edge = np.diff(np.concatenate([[True], _SPACES[raw], [True]]).astype(np.int8))
    return spans(prefix_sums(raw), np.flatnonzero(edge == -1), np.flatnonzero(edge == 1))


_STEP = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingles(text: str, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles of a text in lower case (A-Z); fewer words: one shingle."""
    w = word_hashes(np.frombuffer(text.encode().lower(), np.uint8))
    n = len(w)
    if not n:
        return w
    width = min(size, n)
    h = np.full(n - width + 1, np.uint64(width))
    for k in range(width):
        h += mix(w[k : n - width + 1 + k] * _STEP[k % len(_STEP)] + np.uint64(k))
    return np.unique(mix(h))
