"""Lookup tables of any size for map tasks: broadcast in blocks, each of a bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, SparkContext

from .words import U


class Blocks:
    """Values that tasks go through one at a time.

    The maker keeps each value under its stated bound; however many there are,
    a worker holds a single one in memory, or the only one for good.
    """

    def __init__(self, sc: SparkContext, values: Iterable):
        self.held: list[Broadcast] = [sc.broadcast(v) for v in values]

    def __iter__(self) -> Iterator:
        for b in self.held:
            yield b.value
            if len(self.held) > 1:
                vars(b).pop("_value", None)

    def __len__(self) -> int:
        return len(self.held)


class HashTable:
    """Places of 64-bit keys in a sorted array, behind a bitmap of the keys' high bits, `spare` more than count them."""

    def __init__(self, keys: np.ndarray, spare: int = 5):
        self.keys = np.unique(keys)
        bits = min(26, max(16, int(len(self.keys)).bit_length() + spare))
        self.shift = U(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(self.keys >> self.shift).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in h that have a key, the keys' places)."""
        if not len(self.keys) or not len(h):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        maybe = np.flatnonzero(self.seen[(h >> self.shift).astype(np.int64)])
        at = np.searchsorted(self.keys, h[maybe])
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == h[maybe]
        return maybe[hit], at[hit]


def give_back() -> None:
    """Hand freed memory back to the system, where the C library can: a worker's next task may be another stage's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
