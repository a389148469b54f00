"""Words, word hashes and shingle hashes of Arrow text columns, in numpy.

All functions work on the UTF-8 buffer of a whole batch; every byte over 0x7F is
a word byte in both alphabets, so splitting bytes equals splitting characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
SAME = _BYTES.astype(np.uint8)
#: Words between white space: [^\x20\x09-\x0D]+
SPACED = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: Words of letters and digits, after lower-casing: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)

_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = U(0xD6E8FEB86659FD93)
_POWERS: list[np.ndarray] = []
#: Bytes that are hashed at a time; a longer word is hashed by itself.
STRETCH = 1 << 19


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's and its inverse's first powers; a worker keeps those for a stretch, longer rows are made anew."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, STRETCH + 1)
        up, down = np.full(size, _BASE, U), np.full(size, _INVERSE, U)
        up[0] = down[0] = 1
        np.cumprod(up, dtype=U, out=up)
        np.cumprod(down, dtype=U, out=down)
        if size > STRETCH + 1:
            return up, down
        _POWERS[:] = [up, down]
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finish that spreads every bit over all bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Words:
    """Words of some texts: `low` the lower-cased bytes, word i is low[start[i]:end[i]], text d has words first[d]:first[d + 1]."""

    low: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes, the same in any batch."""
        if not len(self.start):
            return np.empty(0, U)
        out = np.empty(len(self.start), U)
        i = 0
        while i < len(out):  # whole words of about STRETCH bytes at a time: a long text needs no more memory than a short one
            low = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, low + STRETCH, "right")))
            start, end = self.start[i:j] - low, self.end[i:j] - low
            up, down = _powers(int(end[-1]) + 1)
            total = np.zeros(int(end[-1]) + 1, U)
            total[1:] = self.low[low : self.end[j - 1]]
            total[1:] += U(1)
            total[1:] *= up[:-1]
            np.cumsum(total, dtype=U, out=total)
            out[i:j] = mix((total[end] - total[start]) * down[start])
            i = j
        return out

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def spaced(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, place of each word in them): the words in order with one space between every two."""
        size = self.end - self.start
        place = np.cumsum(size + 1) - size - 1
        out = np.full(int(size.sum()) + max(0, len(size) - 1), 0x20, np.uint8)
        i = 0
        while i < len(size):
            j = max(i + 1, int(np.searchsorted(place, place[i] + STRETCH, "right")) - 1) if i + 1 < len(size) else len(size)
            n = size[i:j]
            at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(place[i:j], n) + at] = self.low[np.repeat(self.start[i:j], n) + at]
            i = j
        return out, place


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    low = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return low, at


def slices(at: np.ndarray, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each; a longer text is a range by itself."""
    row, rows = 0, len(at) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, min(stop, rows)
        row = stop


def split(data: np.ndarray, at: np.ndarray, alphabet: np.ndarray, fold: np.ndarray = LOWER) -> Words:
    """Lower-case A-Z, or fold bytes otherwise, and split; `at` are the texts' offsets into `data`."""
    low = fold[data[at[0] : at[-1]]]
    at = at - at[0]
    inside = alphabet[low]
    before, after = np.zeros(len(low), bool), np.zeros(len(low), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cuts = at[(at > 0) & (at < len(low))]
    before[cuts] = after[cuts - 1] = False
    start = np.flatnonzero(inside & ~before)
    return Words(low, start, np.flatnonzero(inside & ~after) + 1, np.searchsorted(start, at))


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first word) of every run of k words; a text of fewer, but some, has its whole sequence as one."""
    h, first = words.hashes(), words.first
    owner = words.owner()
    if len(h) >= k:
        total = np.zeros(len(h) - k + 1, U)
        for j in range(k):
            total = total * _STEP + h[j : len(h) - k + 1 + j]
        at = np.flatnonzero(owner[: len(h) - k + 1] == owner[k - 1 :])
        total, text = mix(total[at]), owner[at]
    else:
        total, text, at = np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64)
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.zeros(len(short), U)
        for i, d in enumerate(short):
            value, step = 0, int(_STEP)
            for x in h[first[d] : first[d + 1]].tolist():
                value = value * step + x
            extra[i] = value + int(counts[d]) & 0xFFFFFFFFFFFFFFFF
        total, text, at = np.append(total, mix(extra ^ _BASE)), np.append(text, short), np.append(at, first[short])
    return total, text, at
