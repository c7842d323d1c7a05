"""Vectorised 64-bit hashes of the words of many texts at once.

A word's hash is a polynomial of its bytes modulo 2**64, read off prefix sums
and divided by the power of its position (an odd base has an inverse), then
mixed.  No Python object is made per word.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
WINDOW = 1 << 20

#: Byte -> class. A word is a run of bytes of one class; class 0 separates words.
SPACE_CLASSES = np.ones(256, np.uint8)
SPACE_CLASSES[[0x20, *range(0x09, 0x0E)]] = 0
#: Letters, digits and all non-ASCII bytes are 1, other printable bytes 2.
PUNCT_CLASSES = np.where(
    [b >= 0x80 or chr(b).isalnum() for b in range(256)], 1, 2).astype(np.uint8) * SPACE_CLASSES
PUNCT_CLASSES[:0x20] = 0
LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
LOWER[ord("A"):ord("Z") + 1] += np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(seed: int, salt: int = 0) -> np.uint64:
    return mix(np.array([(seed * 0x9E3779B97F4A7C15 + salt + 1) % (1 << 64)], np.uint64))[0]


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_CACHE: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > WINDOW:
        return _powers(n, BASE), _powers(n, INVERSE)
    if WINDOW not in _CACHE:
        _CACHE[WINDOW] = _powers(WINDOW, BASE), _powers(WINDOW, INVERSE)
    return _CACHE[WINDOW]


def word_spans(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; words never cross from one text into the next."""
    if not data.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes[data]
    change = np.ones(data.size + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[offsets[:-1]] = True
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    keep = kind[starts] != 0
    return starts[keep], ends[keep]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every span of ``data``, A-Z lower-cased; windows of whole spans bound the memory."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        end = max(at + 1, int(np.searchsorted(ends, base + WINDOW, side="right")))
        size = int(ends[end - 1]) - base
        powers, inverses = _power_tables(size)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(LOWER[data[base:base + size]] * powers[:size], out=sums[1:])
        s, e = starts[at:end] - base, ends[at:end] - base
        out[at:end] = mix((sums[e] - sums[s]) * inverses[s] + (e - s).astype(np.uint64))
        at = end
    return out


def words(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes in text order and the number of words of each text."""
    starts, ends = word_spans(data, offsets, classes)
    counts = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    return span_hashes(data, starts, ends), counts.astype(np.int64)
