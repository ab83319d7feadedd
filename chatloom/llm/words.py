"""Words of many texts at once: places and 64-bit hashes, by array operations over UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_power = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random-looking 64-bit number for each byte value, and for each in lower case (A-Z only).
VALUE = mix(np.arange(1, 257, dtype=np.uint64))
LOWER = VALUE.copy()
LOWER[65:91] = VALUE[97:123]

#: Bytes that part words: white space; and everything in ASCII but letters and digits.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
SIGNS = np.zeros(256, bool)
SIGNS[:128] = True
SIGNS[48:58] = SIGNS[65:91] = SIGNS[97:123] = False


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _power, _inverse
    if len(_power) < n:
        size = max(n, 1 << 20)
        _power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, _BASE, np.uint64))), dtype=np.uint64)
        _inverse = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, pow(_BASE, -1, 1 << 64), np.uint64))), dtype=np.uint64)
    return _power, _inverse


def prefix(values: np.ndarray) -> np.ndarray:
    """Running polynomial sums; ``span`` reads the hash of any stretch from them."""
    power, _ = powers(len(values) + 1)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * power[: len(values)], dtype=np.uint64)))


def span(sums: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of stretches [s, e): the same content gives the same hash wherever it stands."""
    _, inverse = powers(len(sums))
    return mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each text the number of words before it (length texts + 1)."""
    n = len(data)
    inside = ~separators[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < n]
    start[first] = inside[first]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    last = offsets[1:]
    last = last[last > 0] - 1
    end[last] = inside[last]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, e, at = words(data, offsets, separators)
    return span(prefix(LOWER[data]), s, e), at


def grams(hashes: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n words in a row that start at each word and end in the same text; which word each starts at."""
    size = np.diff(at)
    ok = np.zeros(len(hashes) + 1, np.int32)
    full = np.flatnonzero(size >= n)
    np.add.at(ok, at[full], 1)
    np.add.at(ok, at[full + 1] - n + 1, -1)
    begin = np.flatnonzero(np.cumsum(ok[:-1]) > 0)
    out = np.zeros(len(begin), np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(3) + hashes[begin + k] + np.uint64(k + 1))
    return out, begin


def cuts(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of texts of at most ``most`` bytes together; a longer text is a run of its own."""
    out, a, rows = [], 0, len(offsets) - 1
    while a < rows:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(max(b, a + 1), rows)
        out.append((a, b))
        a = b
    return out
