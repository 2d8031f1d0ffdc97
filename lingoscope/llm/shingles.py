"""Word shingles as sets of 64-bit hashes, for whole batches of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lingoscope.llm.common import utf8_of

WORDS = 5
_rng = np.random.default_rng(20250101)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BYTE_CODE[65:91] = BYTE_CODE[97:123]  # A-Z count as a-z
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
STEP = np.uint64(0xD6E8FEB86659FD93)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((BASE, BASE_INVERSE)):
            with np.errstate(over="ignore"):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                np.multiply.accumulate(p, out=p)
            _powers[k] = p
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64 bits that leaves no structure."""
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text after text, and each text's bounds among them."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    inside = ~SPACE[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    first = bounds[:-1][bounds[:-1] < n]
    opens[first] = inside[first]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    last = bounds[1:][bounds[1:] > 0] - 1
    closes[last] = inside[last]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    power, inverse = _power(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * power, out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return mixed(h), np.searchsorted(starts, bounds)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """For each text its distinct shingles, sorted.

    A text of fewer words has its whole sequence as one shingle; one without
    words, or a null, has none.
    """
    data, bounds = utf8_of(texts)
    h, at = word_hashes(data, bounds)
    out = []
    if len(h) >= words:
        joined = h[: len(h) - words + 1].copy()
        for k in range(1, words):
            joined = joined * STEP + h[k : len(h) - words + 1 + k]
        joined = mixed(joined)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= words:
            s = np.sort(joined[a : b - words + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            out.append(s)
        elif b > a:
            x = np.array([b - a], np.uint64)
            for w in range(a, b):
                x = x * STEP + h[w : w + 1]
            out.append(mixed(x, 0x5BD1E995))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def linked(a: np.ndarray, b: np.ndarray, percent: int = 75) -> bool:
    """Whether 100 * |a and b| >= percent * |a or b|, for sorted distinct shingles."""
    if not len(a) or not len(b):
        return False
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = int((a[at] == b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)
