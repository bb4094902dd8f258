"""Words of whole batches of texts, as arrays.

A word is a run of ASCII letters and digits and of characters beyond ASCII,
with A-Z lower-cased: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. In UTF-8 every
byte of a character beyond ASCII is 128 or more, so runs of bytes are runs of
characters, and one pass of numpy over a batch's bytes finds and hashes all
words of all its texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once (at least one text); bounds a worker's memory.
BYTES_AT_ONCE = 1_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_ROOT = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_ROOT, pow(_ROOT, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a hash's bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Words(NamedTuple):
    """``data``: lower-cased bytes; ``start``, ``end``, ``hash``, ``text`` (its
    row) by word; ``count``: words by row."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    text: np.ndarray
    count: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def _arrays(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    wide = pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    if not len(col) or offsets is None:
        return np.zeros(len(col) + 1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


def tokenize(col: pa.Array) -> Words:
    """The words of a string array; null has none."""
    off, raw = _arrays(col)
    data = _LOWER[raw]
    n = len(data)
    inside = _WORD[data]
    first = off[:-1][off[:-1] < off[1:]]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    begin[first] = inside[first]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    last = off[1:][off[:-1] < off[1:]] - 1
    stop[last] = inside[last]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    up, down = _grown(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(data * up[:n], out=total[1:], dtype=np.uint64)
    h = mix((total[end] - total[start]) * down[start])
    text = np.searchsorted(off, start, side="right") - 1
    return Words(data, start, end, h, text, np.bincount(text, minlength=len(col)))


def chunks(col: pa.Array, most: int = BYTES_AT_ONCE) -> Iterator[tuple[int, pa.Array]]:
    """Slices of at most ``most`` bytes, or of one text, with their first row."""
    off, _ = _arrays(col)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, col.slice(i, j - i)
        i = j


def hash_words(words: list[str]) -> np.ndarray:
    """The hashes that ``tokenize`` gives these words, each one word already."""
    return tokenize(pa.array(words, pa.string())).hash if words else np.zeros(0, np.uint64)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive word hashes, rows not regarded."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(_ROOT) + h[i : i + n]
    return mix(out)


class Lookup:
    """Finds values in a sorted array of distinct ones, most misses by one bit."""

    BITS = 22

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.seen = np.zeros(1 << self.BITS, bool)
        self.seen[(keys >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``values`` that hold a key, and which key."""
        maybe = np.flatnonzero(self.seen[(values >> np.uint64(64 - self.BITS)).astype(np.int64)])
        if not len(maybe):
            return maybe, maybe
        at = np.minimum(np.searchsorted(self.keys, values[maybe]), len(self.keys) - 1)
        ok = self.keys[at] == values[maybe]
        return maybe[ok], at[ok]
