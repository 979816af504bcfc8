"""Hashes of words and of runs of words, computed over the bytes of a text at once."""

from __future__ import annotations

import numpy as np

#: Fixed multipliers of the 64-bit mixing function.
MIX_1, MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * MIX_1
    x = x ^ (x >> np.uint64(33))
    x = x * MIX_2
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, BASE)]))


_POWERS = _powers(1 << 16)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if n >= len(_POWERS):
        _POWERS = _powers(2 * n)
    return _POWERS[: n + 1]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of bytes that are not white space (space, tab to carriage return)."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of every word of a text, with A to Z in lower case.

    The hash sums mixed (byte, position in the word) pairs, so that one running sum over the text
    serves all words, and mixes in the word's length.
    """
    if not text:
        return np.zeros(0, np.uint64)
    data = _LOWER[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    starts, ends = word_spans(data)
    lengths = ends - starts
    at = np.arange(len(data))
    if len(starts):
        at = at - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(data)]])))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mix(data.astype(np.uint64) + (at.astype(np.uint64) << np.uint64(8)) + BASE), out=sums[1:])
    return mix(sums[ends] - sums[starts] + lengths.astype(np.uint64) * BASE)


def run_hashes(words: np.ndarray, offsets: list[int]) -> np.ndarray:
    """A hash of the words at the given offsets from every position where all of them exist."""
    n = len(words) - max(offsets)
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, offset in enumerate(offsets):
        out += words[offset : offset + n] * powers(len(offsets))[k + 1]
    return mix(out)
