"""Words of UTF-8 text as numpy arrays: places, hashes, shingles."""

from __future__ import annotations

import numpy as np

#: Bytes that part words: space and \x09-\x0D.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that part letter runs: everything but ASCII letters, digits and non-ASCII.
MARKS = np.ones(256, bool)
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (one to one)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _power(kind: str, base: int, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind][:n]


def spans(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACES):
    """Start and end byte and row of every word; words never cross rows."""
    inside = ~apart[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each word; ``lower`` folds A-Z."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    if n:
        values = _VALUES[_LOWER[data] if lower else data]
        np.cumsum(values * _power("up", _BASE, n), out=sums[1:])
    shifted = (sums[ends] - sums[starts]) * _power("down", _INVERSE, n + 1)[starts]
    return mix(shifted ^ (ends - starts).astype(np.uint64))


def windows(hashed: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words inside a row, and the run's first word."""
    n = len(hashed) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(rows[:n] == rows[size - 1:])
    total = np.zeros(len(first), np.uint64)
    for k in range(size):
        total = mix(total + hashed[first + k] + np.uint64(k + 1))
    return total, first
