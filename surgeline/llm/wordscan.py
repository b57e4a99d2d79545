"""Words, lines and shingles of many texts at once, as numpy arrays.

A word is a maximal run of bytes other than white space (0x20, 0x09-0x0D). Words, lines and shingles
are known by 64-bit hashes: a polynomial over random byte values, mixed. Equal texts have equal
hashes; two different ones of a pair of documents collide with a chance of about 1e-19.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import CHUNK_BYTES

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240611))
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
LOWER_VALUES = BYTE_VALUES.copy()
LOWER_VALUES[65:91] = BYTE_VALUES[97:123]
BASE = int(_rng.integers(1 << 40, 1 << 63)) | 1
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**i modulo 2**64, or of its inverse, for i up to n."""
    key = "inverse" if inverse else "plain"
    if key not in _powers or len(_powers[key]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        steps = np.full(size, pow(BASE, -1, 1 << 64) if inverse else BASE, dtype=np.uint64)
        steps[0] = 1
        _powers[key] = np.cumprod(steps)
    return _powers[key]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


@dataclass
class Scan:
    data: np.ndarray  # bytes of all texts
    offsets: np.ndarray  # of the texts in data
    space: np.ndarray
    starts: np.ndarray  # of the words in data
    ends: np.ndarray
    first: np.ndarray  # index of each text's first word; one more at the end
    prefix: np.ndarray  # running polynomial

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        span = self.prefix[ends] - self.prefix[starts]
        return mix(span * powers(len(self.data), True)[starts] + (ends - starts).astype(np.uint64))

    def words(self) -> np.ndarray:
        return self.hashes(self.starts, self.ends)


def scan(texts: pa.Array, lower: bool) -> Scan:
    """A null text counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    raw = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    body = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(body, np.uint8)[raw[0] : raw[-1]] if body is not None and raw[-1] > raw[0] else np.zeros(0, np.uint8)
    offsets = raw - raw[0]
    n = len(data)
    space = SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    inside = offsets[:-1][(offsets[:-1] < n) & (offsets[1:] > offsets[:-1])]
    begins[inside] = ~space[inside]  # a text starts a word anew
    stops = ~space
    stops[:-1] &= space[1:]
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    stops[last] = ~space[last]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((LOWER_VALUES if lower else BYTE_VALUES)[data] * powers(n)[:n], out=prefix[1:])
    return Scan(data, offsets, space, starts, ends, np.searchsorted(starts, offsets), prefix)


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * U(0x9E3779B97F4A7C15) + words[k : k + n]
    return mix(h)


def shingle_sets(found: Scan, size: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each text; of fewer words the whole sequence is one; of none, none."""
    words = found.words()
    runs = windows(words, size)
    sets = []
    for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
        if b - a >= size:
            sets.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            sets.append(windows(words[a:b], b - a) ^ U(b - a))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
