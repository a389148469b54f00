"""Similarity of each row to the labelled rows of each class, without a row for a pair.

The pool is written once, dealt by a hash of the key, in the shared folder.  Rows
are packed in blocks by a hash of their id (of one key, where only rows of one key
meet); a task takes one block at a time and reads its part of the pool, so that
no pair of blocks is shuffled.  Items are 64-bit hashes; what many of a block's
rows share is counted by a matrix product, the rest by an inverted index.
Statistics are those of the block's similarities.  Where a row has more than KEPT
of these, means and deviations are merged from meeting to meeting and each
(row, class) is given bounds around its middle values, which are narrowed by
counting values in bins, a pass at a time, until what lies between them is few.
A set similarity follows from both sizes and the shared items, so that of sets only
pairs that share items are gone through, where these are few.  What is held is how
often a row met each (shared, size), where sizes are few; of sets of many sizes it is
the values around each row's middle, between bounds from what was met so far: the
pool is in the order of a hash of the id then, so that what comes first is a random
part of it.  A row whose middle falls out of its bounds is gone through once more.
Memory is a block's, whatever the pool and the groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch

CLASSES = (1, 2, 3, 4)
#: Most rows of a block; values of a row that are kept in the first pass; bins of a pass; values between bounds that are few.
BLOCK, KEPT, BINS, FEW = 256, 1 << 20, 64, 1000
#: Similarities of a block that are held at a time; rows of the pool that it meets at a time; rows of a part of the pool; bytes of a part that a task keeps; items of a block that are counted by a matrix product.
CELLS, MET, PART, KEEP, DENSE = 1 << 24, 2048, 16_384, 64 << 20, 512
#: Square of a distance, over the vectors' own, up to which it is computed by differences; values of a row from which its median is looked for between bounds, and values that give the bounds.
NEAR, LONG, LOOKS = 1e-3, 4096, 1024
#: Shared items a pair of a block's rows up to which only pairs that share some are gone through; (row, shared, size) that are held before equal ones are put together; bits of each of the last two.
LIGHT, HELD, BITS = 0.6, 1 << 21, 24
#: Items of a block of sets, about; pairs of a block that are held; rows of the pool whose sizes are looked at, and how many sizes are many; half the width of a row's bounds, over the root of what it met.
ITEMS, PAIRS, SEEN, SIZES, WIDTH = 1 << 20, 1 << 20, 2000, 128, 2.5
STATS = ("mean", "std", "min", "median", "max")


def _vectors(values: pa.ListArray) -> np.ndarray:
    flat, n = values.flatten().to_numpy(zero_copy_only=False), _lengths(values)
    width = int(n.max(initial=0))
    if (n == width).all():
        return flat.reshape(len(n), width)
    out = np.full((len(n), width), np.nan)
    whole = n == width
    out[whole] = flat[np.repeat(whole, n)].reshape(-1, width)
    return out


def _lengths(values: pa.ListArray) -> np.ndarray:
    return np.diff(values.offsets.to_numpy())


def _even(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of unlike sizes as ones without numbers."""
    if x.shape[1] != y.shape[1]:
        width = max(x.shape[1], y.shape[1])
        x, y = (v if v.shape[1] == width else np.full((len(v), width), np.nan) for v in (x, y))
    return x, y


def _unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1; 0 stays 0."""
    n = np.sqrt((x * x).sum(axis=1))[:, None]
    with np.errstate(invalid="ignore"):
        return x / np.where(n == 0, 1.0, n)


class Cosine:
    """Cosine similarity of each vector of a block with each of others; 0 where one is 0."""

    def __init__(self, values: pa.ListArray):
        self.x = _vectors(values)

    def __call__(self, others: pa.ListArray) -> np.ndarray:
        x, y = _even(self.x, _vectors(others))
        return _unit(x) @ _unit(y).T


class Euclidean(Cosine):
    """Euclidean distance of each vector of a block to each of others."""

    def __call__(self, others: pa.ListArray) -> np.ndarray:
        x, y = _even(self.x, _vectors(others))
        with np.errstate(invalid="ignore", over="ignore"):
            whole = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)
            out = x @ (-2 * y.T)
            out += whole
            near, to = np.nonzero(~(out > NEAR * whole))  # and what has no number
            for lo in range(0, len(near), 1 << 16):
                at = near[lo : lo + (1 << 16)], to[lo : lo + (1 << 16)]
                out[at] = ((x[at[0]] - y[at[1]]) ** 2).sum(axis=1)  # differences, not products: near vectors stay exact
            return np.sqrt(out, out=out)


class Terms:
    """Cosine similarity of sparse vectors, lists of (term's hash, weight), of a block with others; 0 where one is empty."""

    sparse = False

    def __init__(self, values: pa.ListArray):
        self.n = _lengths(values)
        code, weight = self.parts(values)
        row = np.repeat(np.arange(len(self.n)), self.n)
        self.own = self.size(self.n, row, weight)
        self.codes, place = np.unique(code, return_inverse=True)
        self.shift = np.uint64(64 - max(10, len(self.codes).bit_length() + 4))  # a map of the codes' high bits
        high, n = np.unique(self.codes.view(np.uint64) >> self.shift, return_counts=True)  # in the codes' order but for their sign
        self.start, self.depth = np.full(1 << int(np.uint64(64) - self.shift), -1, np.int32), int(n.max(initial=0))
        self.start[high] = np.searchsorted(self.codes, (high << self.shift).view(np.int64))
        df = np.bincount(place, minlength=len(self.codes))
        often = np.argsort(-df, kind="stable")[:DENSE]
        often = often[df[often] > max(1, len(self.n) // 32)]
        self.shared = (df * (df - 1.0)).sum() / max(len(self.n), 1) ** 2  # by two of the block, on average
        self.light = self.sparse and self.shared <= LIGHT
        if self.light:
            often = often[:0]
        self.dense = np.full(len(self.codes), -1)
        self.dense[often] = np.arange(len(often))
        at = self.dense[place]
        self.matrix = np.zeros((len(self.n), len(often)), weight.dtype)
        self.matrix[row[at >= 0], at[at >= 0]] = weight[at >= 0]
        rare = np.flatnonzero(at < 0)
        rare = rare[np.argsort(place[rare], kind="stable")]
        self.row, self.weight = row[rare], weight[rare]
        self.first = np.searchsorted(place[rare], np.arange(len(self.codes) + 1))

    def found(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of some codes are the block's, and their places among its own."""
        place = self.start[code.view(np.uint64) >> self.shift]
        maybe = np.flatnonzero(place >= 0)
        place, code = place[maybe], code[maybe]
        miss = np.flatnonzero(self.codes[place] != code)
        for _ in range(self.depth - 1):  # codes of the same high bits follow each other
            place[miss] = np.minimum(place[miss] + 1, len(self.codes) - 1)
            miss = miss[self.codes[place[miss]] != code[miss]]
        there = np.ones(len(maybe), bool)
        there[miss] = False
        return maybe[there], place[there]

    def parts(self, values: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        flat = values.flatten()
        return flat.field("term").to_numpy(zero_copy_only=False), flat.field("weight").to_numpy(zero_copy_only=False).astype(float)

    def size(self, n: np.ndarray, row: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return np.sqrt(np.bincount(row, weight * weight, len(n)))

    def __call__(self, others: pa.ListArray) -> np.ndarray:
        n = _lengths(others)
        code, weight = self.parts(others)
        row = np.repeat(np.arange(len(n)), n)
        size, out = self.size(n, row, weight), np.zeros((len(self.n), len(n)))
        if len(self.codes) and len(code):
            held, place = self.found(code)
            row, weight = row[held], weight[held]
            at = self.dense[place]
            matrix = np.zeros((len(n), self.matrix.shape[1]), weight.dtype)
            matrix[row[at >= 0], at[at >= 0]] = weight[at >= 0]
            out += self.matrix @ matrix.T
            rare = np.flatnonzero(at < 0)
            many = self.first[place[rare] + 1] - self.first[place[rare]]
            upto = np.cumsum(many)
            for lo, hi in _stretches(upto, 1 << 22):
                k, own = many[lo:hi], rare[lo:hi]
                i = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + np.repeat(self.first[place[own]], k)
                cell = self.row[i] * len(n) + np.repeat(row[own], k)
                out += np.bincount(cell, self.weighed(i, np.repeat(weight[own], k)), out.size).reshape(out.shape)
        return self.measured(out, self.own[:, None], size)

    def weighed(self, i: np.ndarray, weight: np.ndarray) -> np.ndarray | None:
        return self.weight[i] * weight

    def measured(self, both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        norm = a * b
        return np.divide(both, norm, out=np.zeros(norm.shape), where=norm > 0)


class Jaccard(Terms):
    """Shared over all distinct items of each two sets of hashes; 0 without items."""

    sparse = True

    def parts(self, values: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        code = values.flatten().to_numpy(zero_copy_only=False)
        return code, np.ones(len(code), np.float32)  # counts below 2^24 are exact

    def size(self, n: np.ndarray, row: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return n

    def weighed(self, i: np.ndarray, weight: np.ndarray) -> None:
        return None

    def shares(self, others: pa.ListArray) -> tuple[np.ndarray | None, np.ndarray]:
        """Shared items of each pair, flat, and no cells; of pairs that are few: their shared items are how often a cell is among the cells."""
        n = _lengths(others)
        code = others.flatten().to_numpy(zero_copy_only=False)
        none = np.zeros(0, np.int64)
        if not len(self.codes) or not len(code):
            return None, none
        held, place = self.found(code)
        row, cells = np.repeat(np.arange(len(n)), n)[held], len(self.n) * len(n)
        at = self.dense[place]
        rare = np.flatnonzero(at < 0)
        many = self.first[place[rare] + 1] - self.first[place[rare]]
        both = None  # of each pair
        if not self.light:
            matrix = np.zeros((len(n), self.matrix.shape[1]), np.float32)
            matrix[row[at >= 0], at[at >= 0]] = 1
            both = (self.matrix @ matrix.T).astype(np.int32).ravel()
        elif many.sum() * 8 > cells:
            both = np.zeros(cells, np.int32)
        found, waiting, start = [], 0, self.row * len(n)
        at, last, row = self.first[place[rare]], self.first[place[rare] + 1], row[rare]
        while len(at):  # the next of the block's rows with each item
            found.append(start[at] + row)
            waiting += len(at)
            at = at + 1
            more = np.flatnonzero(at < last)
            at, last, row = at[more], last[more], row[more]
            if both is not None and (waiting > 1 << 22 or not len(at)):
                both += np.bincount(np.concatenate(found), minlength=cells).astype(np.int32)
                found, waiting = [], 0
        return both, np.concatenate(found) if found else none

    def pairs(self, others: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Places (row of the block, row of the others) as one number, in order, and shared items of the pairs that share some."""
        both, found = self.shares(others)
        if both is None:
            return np.unique(found, return_counts=True)
        cell = np.flatnonzero(both)
        return cell, both[cell].astype(np.int64)

    def tally(self, others: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(row, shared, size) as one number, of all pairs that share items, and how often it is."""
        n, (both, found) = _lengths(others), self.shares(others)
        if both is None:
            cell, shared = np.unique(found, return_counts=True)
        else:
            sizes, which = np.unique(n, return_inverse=True)
            wide = int(both.max(initial=0)) + 1
            if not self.light and len(self.n) * len(sizes) * wide <= 4 * len(both):  # the pool's rows follow each other by size: these are few
                bins = both.reshape(len(self.n), -1) + (which * wide).astype(np.int32)
                bins += (np.arange(len(self.n)) * (len(sizes) * wide)).astype(np.int32)[:, None]
                counts = np.bincount(bins.ravel(), minlength=len(self.n) * len(sizes) * wide)
                cell = np.flatnonzero(counts)
                cell = cell[cell % wide > 0]
                at = cell // wide
                return (at // len(sizes) << 2 * BITS) | (cell % wide << BITS) | sizes[at % len(sizes)], counts[cell]
            cell = np.flatnonzero(both)
            shared = both[cell].astype(np.int64)
        return np.unique((cell // len(n) << 2 * BITS) | (shared << BITS) | n[cell % len(n)], return_counts=True)

    def measured(self, both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        whole = (a + b).astype(float) - both
        return np.divide(both, np.maximum(whole, 1, out=whole), out=whole)


class Dice(Jaccard):
    """Twice the shared over the sum of distinct items of each two sets of hashes; 0 without items."""

    def measured(self, both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 2 * both / np.maximum(a + b, 1)


def _stretches(upto: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cuts of items with running sums `upto` into stretches of about `most` each."""
    lo = 0
    while lo < len(upto):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


METRICS: dict[str, Callable[[pa.ListArray], Callable[[pa.ListArray], np.ndarray]]] = {"terms": Terms, "cosine": Cosine, "euclidean": Euclidean, "jaccard": Jaccard, "dice": Dice}


def _coded(value: Column, metric: str) -> Column:
    """`value` as the metric takes it: items as hashes, distinct ones once."""
    if metric in ("jaccard", "dice"):
        return F.transform(F.array_distinct(value), lambda x: F.xxhash64(x))
    if metric == "terms":
        return F.transform(value, lambda x: F.struct(F.xxhash64(x["term"]).alias("term"), x["weight"].cast("double").alias("weight")))
    return value.cast("array<double>")


def _median(y: np.ndarray) -> float:
    """The median of numbers: partitioned are those between two bounds around the middle of some of them, if it is there."""
    n, below, inside = len(y), 0, y
    if n >= LONG:
        some = np.sort(y[:: n // LOOKS])
        off = len(some) // 32
        low, high = some[len(some) // 2 - off], some[len(some) // 2 + off]
        below, inside = np.count_nonzero(y < low), y[(y >= low) & (y <= high)]
        if not below <= (n - 1) // 2 <= n // 2 < below + len(inside):
            below, inside = 0, y
    a, b = (n - 1) // 2 - below, n // 2 - below
    z = np.partition(inside, (a, b) if a < b else b)
    return (z[a] + z[b]) / 2


def _statistics(held: list[np.ndarray], own: np.ndarray) -> np.ndarray:
    """STATS of each row of similarities (parts side by side; a row's own place, or -1, doesn't count); not a number without any."""
    x = np.concatenate(held, axis=1)
    held.clear()
    out = np.full((len(x), len(STATS)), np.nan)
    inside = own >= 0
    x[inside, own[inside]] = x[inside, -1]  # the last one takes its place
    for rows, n in ((np.flatnonzero(~inside), x.shape[1]), (np.flatnonzero(inside), x.shape[1] - 1)):
        for lo in range(0, len(rows) if n else 0, 32):
            at = rows[lo : lo + 32]
            y = x[at, :n]
            lost = np.isnan(y)
            if lost.any():  # vectors of unlike sizes
                for i, z, gone in zip(at, y, lost, strict=True):
                    z = z[~gone]
                    if len(z):
                        out[i] = z.mean(), z.std(), z.min(), np.median(z), z.max()
                continue
            out[at, 0], out[at, 2], out[at, 4] = y.mean(axis=1), y.min(axis=1), y.max(axis=1)
            out[at, 3] = [_median(z) for z in y]
            y -= out[at, 0, None]
            out[at, 1] = np.sqrt(np.einsum("ij,ij->i", y, y) / n)
    return out


def _middle(x: np.ndarray, count: np.ndarray, none: int) -> float:
    """The median of numbers above 0, each `count` times, and of `none` zeros."""
    n = int(count.sum())
    ranks = np.array([(n + none - 1) // 2 - none, (n + none) // 2 - none])
    at = np.maximum(ranks, 0)
    if n <= 4 * len(x):
        found = np.partition(np.repeat(x, count), at)[at]
    else:
        order = np.argsort(x)
        found = x[order][np.searchsorted(np.cumsum(count[order]), at, "right")]
    return float(found[ranks >= 0].sum() / 2)


class _Tally:
    """How often each row of a block of sets met each (shared items, size) in one class; pairs without shared items are the rest."""

    def __init__(self, own: Jaccard):
        self.own, self.met, self.self = own, 0, np.zeros(len(own.n), bool)
        self.keys, self.counts, self.held, self.limit = [], [], 0, HELD

    def meet(self, others: pa.ListArray, same: np.ndarray) -> None:
        key, count = self.own.tally(others)
        self.met, self.self = self.met + len(others), self.self | (same >= 0)
        self.keys.append(key)
        self.counts.append(count)
        self.held += len(key)
        if self.held > self.limit:
            self.merge()
            self.limit = max(HELD, 2 * self.held)

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        key, count = np.concatenate([np.zeros(0, np.int64), *self.keys]), np.concatenate([np.zeros(0, np.int64), *self.counts])
        if count.sum() <= 4 * len(key):  # most were met once
            key, count = np.unique(np.repeat(key, count), return_counts=True)
        else:
            order = np.argsort(key)
            key, count = key[order], count[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            key, count = key[first], np.add.reduceat(count, first)
        self.keys, self.counts, self.held = [key], [count], len(key)
        return key, count

    def statistics(self) -> np.ndarray:
        """STATS of each row, without the row itself; not a number where it met none."""
        own, rows = self.own, len(self.own.n)
        key, count = self.merge()
        mine = np.flatnonzero(self.self & (own.n > 0))  # shares all its items with itself
        size = own.n[mine].astype(np.int64)
        count[np.searchsorted(key, (mine << 2 * BITS) | (size << BITS) | size)] -= 1
        key, count = key[count > 0], count[count > 0]
        row, mask = key >> 2 * BITS, (1 << BITS) - 1
        x = own.measured(key >> BITS & mask, own.n[row], key & mask)
        n = self.met - self.self.astype(np.int64)
        edge = np.searchsorted(row, np.arange(rows + 1))
        none = n - np.diff(np.concatenate([[0], np.cumsum(count)])[edge])
        out = np.zeros((rows, len(STATS)))
        every = np.maximum(n, 1)
        out[:, 0] = mean = np.bincount(row, count * x, rows) / every
        out[:, 1] = np.sqrt((np.bincount(row, count * (x - mean[row]) ** 2, rows) + none * mean**2) / every)
        some = np.flatnonzero(edge[1:] > edge[:-1])
        if len(some):
            out[some, 2], out[some, 4] = np.where(none[some] > 0, 0.0, np.minimum.reduceat(x, edge[some])), np.maximum.reduceat(x, edge[some])
        for i in np.flatnonzero((n > 0) & (n // 2 >= none)).tolist():  # the others' middle is 0
            out[i, 3] = _middle(x[edge[i] : edge[i + 1]], count[edge[i] : edge[i + 1]], int(none[i]))
        out[n == 0] = np.nan
        return out


class _Spread:
    """Moments of each row of a block of sets in one class, and its values around the middle, so far: what is below is counted, what is above is left."""

    def __init__(self, own: Jaccard):
        rows = len(own.n)
        self.own, self.n = own, np.zeros(rows, np.int64)
        self.center, self.sum, self.square = None, np.zeros(rows), np.zeros(rows)
        self.least, self.most = np.full(rows, np.inf), np.full(rows, -np.inf)
        self.low, self.high, self.below = np.full(rows, -np.inf), np.full(rows, np.inf), np.zeros(rows, np.int64)
        self.kept, self.held, self.limit = [], 0, PAIRS // 2  # (row, value, how often) each

    def meet(self, others: pa.ListArray, same: np.ndarray) -> None:
        (self._few if self.own.light else self._every)(others, same)

    def _every(self, others: pa.ListArray, same: np.ndarray) -> None:
        both, _ = self.own.shares(others)
        shape = len(self.n), len(others)
        x = np.zeros(shape) if both is None else self.own.measured(both.reshape(shape), self.own.n[:, None], _lengths(others))
        mine = np.flatnonzero(same >= 0)
        x[mine, same[mine]] = np.nan
        self.n += len(others) - (same >= 0)
        if self.center is None:
            self.center = np.nan_to_num(x).mean(axis=1)
        self.least, self.most = np.fmin(self.least, np.fmin.reduce(x, axis=1)), np.fmax(self.most, np.fmax.reduce(x, axis=1))
        self.below += np.count_nonzero(x < self.low[:, None], axis=1)
        row, col = np.nonzero((x >= self.low[:, None]) & (x <= self.high[:, None]))
        self._keep(row.astype(np.int32), x[row, col], np.ones(len(row), np.int32))
        x -= self.center[:, None]
        x[mine, same[mine]] = 0
        self.sum += x.sum(axis=1)
        self.square += np.einsum("ij,ij->i", x, x)

    def _few(self, others: pa.ListArray, same: np.ndarray) -> None:
        rows, n = len(self.n), _lengths(others)
        cell, shared = self.own.pairs(others)
        row, col = np.divmod(cell, len(n))
        other = col != same[row]
        row, col, shared = row[other], col[other], shared[other]
        x = self.own.measured(shared, self.own.n[row], n[col])
        met = len(n) - (same >= 0)
        none = met - np.bincount(row, minlength=rows)  # share nothing
        if self.center is None:
            self.center = np.bincount(row, x, rows) / len(n)
        self.n += met
        off = x - self.center[row]
        self.sum += np.bincount(row, off, rows) - none * self.center
        self.square += np.bincount(row, off * off, rows) + none * self.center**2
        first = np.flatnonzero(np.diff(row, prepend=-1))
        if len(first):
            at = row[first]
            self.least[at], self.most[at] = np.minimum(self.least[at], np.minimum.reduceat(x, first)), np.maximum(self.most[at], np.maximum.reduceat(x, first))
        some = np.flatnonzero(none)
        self.least[some], self.most[some] = np.minimum(self.least[some], 0), np.maximum(self.most[some], 0)
        self.below += np.bincount(row[x < self.low[row]], minlength=rows) + np.where(self.low > 0, none, 0)
        inside = np.flatnonzero((x >= self.low[row]) & (x <= self.high[row]))
        self._keep(row[inside].astype(np.int32), x[inside], np.ones(len(inside), np.int32))
        some = np.flatnonzero((none > 0) & (self.low <= 0) & (self.high >= 0))
        self._keep(some.astype(np.int32), np.zeros(len(some)), none[some].astype(np.int32))

    def _keep(self, *made: np.ndarray) -> None:
        self.kept.append(made)
        self.held += len(made[0])

    def _merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, value, how often) in order, each once, and where each row begins."""
        row, x, count = (np.concatenate([k[i] for k in self.kept]) if self.kept else np.zeros(0, t) for i, t in enumerate((np.int32, float, np.int32)))
        self.kept = []
        order = np.lexsort((x, row))
        row, x, count = row[order], x[order], count[order]
        first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (x[1:] != x[:-1]))[: len(row)])
        row, x, count = row[first], x[first], np.add.reduceat(count, first) if len(first) else count
        self.kept, self.held = [(row, x, count)], len(row)
        return row, x, count, np.searchsorted(row, np.arange(len(self.n) + 1))

    def settle(self) -> None:
        """Bounds around the middle of what was met, if much is held; what comes next falls around it as well where the order is random."""
        if self.held <= self.limit:
            return
        row, x, count, edge = self._merged()
        upto = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        off = WIDTH * np.sqrt(self.n) + 2
        start, size = upto[edge[:-1]] - self.below, upto[edge[1:]] - upto[edge[:-1]]
        for rank, bound in ((np.floor(self.n / 2 - off), self.low), (np.ceil(self.n / 2 + off), self.high)):
            some = np.flatnonzero((rank >= self.below) & (rank < self.below + size))
            bound[some] = x[np.searchsorted(upto, start[some] + rank[some], "right") - 1]
        less = x < self.low[row]
        self.below += np.bincount(row[less], count[less], len(self.n)).astype(np.int64)
        inside = np.flatnonzero(~less & (x <= self.high[row]))
        self.kept, self.held = [(row[inside], x[inside], count[inside])], len(inside)
        self.limit = max(PAIRS // 2, 2 * self.held)

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """STATS of each row, not a number where it met none; rows whose middle isn't held."""
        _, x, count, edge = self._merged()
        upto = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        n, out = np.maximum(self.n, 1), np.full((len(self.n), len(STATS)), np.nan)
        mean = self.sum / n
        middle, lost = np.zeros(len(n)), np.zeros(len(n), bool)
        for rank in ((self.n - 1) // 2, self.n // 2):
            place = rank - self.below
            there = (place >= 0) & (place < upto[edge[1:]] - upto[edge[:-1]])
            lost |= ~there & (self.n > 0)
            some = np.flatnonzero(there & (self.n > 0))
            middle[some] += x[np.searchsorted(upto, upto[edge[some]] + place[some], "right") - 1] / 2
        center = np.zeros(len(n)) if self.center is None else self.center
        out[:, 0], out[:, 1], out[:, 2], out[:, 3], out[:, 4] = center + mean, np.sqrt(np.maximum(self.square / n - mean**2, 0)), self.least, middle, self.most
        out[self.n == 0] = np.nan
        return out, np.flatnonzero(lost)


class _Moments:
    """Count, mean, sum of squared differences, least and greatest of one block's rows by class, over the meetings so far."""

    def __init__(self, rows: int, classes: int):
        shape = (rows, classes)
        self.n, self.mean, self.square = np.zeros(shape, np.int64), np.zeros(shape), np.zeros(shape)
        self.low, self.high = np.full(shape, np.inf), np.full(shape, -np.inf)

    def meet(self, c: int, x: np.ndarray) -> None:
        """x: a block's rows with some of the pool's of class c; not a number where they don't meet."""
        n = (~np.isnan(x)).sum(axis=1)
        some, filled = n > 0, np.nan_to_num(x)
        mean = np.divide(filled.sum(axis=1), n, out=np.zeros(len(n)), where=some)
        square = np.nansum((x - mean[:, None]) ** 2, axis=1)
        every = np.maximum(self.n[:, c] + n, 1)
        step = np.where(some, mean - self.mean[:, c], 0.0)
        self.square[:, c] += square + step**2 * self.n[:, c] * n / every
        self.mean[:, c] += step * n / every
        self.n[:, c] += n
        self.low[:, c] = np.fmin(self.low[:, c], np.fmin.reduce(x, axis=1))
        self.high[:, c] = np.fmax(self.high[:, c], np.fmax.reduce(x, axis=1))


class _Middle:
    """Bounds, by two for the two middle values, of each (row, class): how many values are below them, and how many within."""

    NAMES = ("low", "high", "below", "inside", "rank")

    def __init__(self, **flat):
        self.low, self.high, self.below, self.inside, self.rank = (np.asarray(flat[k], float) for k in self.NAMES)
        self.counts = np.zeros((len(self.low), BINS), np.int64)
        self.least, self.most = np.full((len(self.low), BINS), np.inf), np.full((len(self.low), BINS), -np.inf)
        self.held: list[list[np.ndarray]] = [[] for _ in self.low]

    @classmethod
    def of(cls, m: _Moments) -> _Middle:
        two = lambda x: np.repeat(np.where(m.n > 0, x, 0).ravel(), 2)
        rank = np.stack([np.maximum(m.n - 1, 0) // 2, m.n // 2], axis=2).ravel()
        return cls(low=two(m.low), high=two(m.high), below=np.zeros(rank.size), inside=two(m.n), rank=rank)

    def flat(self) -> dict[str, np.ndarray]:
        return {k: getattr(self, k) for k in self.NAMES}

    def open(self) -> np.ndarray:
        """Which bounds must be narrowed yet."""
        return (self.low < self.high) & (self.inside > FEW)

    def _own(self, c: int, classes: int, rows: int, k: int) -> np.ndarray:
        return (np.arange(rows) * classes + c) * 2 + k

    def count(self, c: int, classes: int, x: np.ndarray) -> None:
        for k in (0, 1):
            at = self._own(c, classes, len(x), k)
            low, high = self.low[at, None], self.high[at, None]
            with np.errstate(invalid="ignore", divide="ignore"):
                place = np.floor((x - low) / (high - low) * BINS)
                row, col = np.nonzero((x >= low) & (x <= high) & self.open()[at, None])
            cell = at[row], np.minimum(place[row, col].astype(np.int64), BINS - 1)
            np.add.at(self.counts, cell, 1)
            np.minimum.at(self.least, cell, x[row, col])
            np.maximum.at(self.most, cell, x[row, col])

    def narrowed(self) -> _Middle:
        """Each open bound's bin that holds its middle value, between the least and the greatest value there."""
        upto = self.below[:, None] + np.cumsum(self.counts, axis=1)
        place = np.minimum((upto <= self.rank[:, None]).sum(axis=1), BINS - 1)
        row = np.arange(len(place))
        new = {"low": self.least[row, place], "high": self.most[row, place], "below": upto[row, place] - self.counts[row, place], "inside": self.counts[row, place], "rank": self.rank}
        return _Middle(**{k: np.where(self.open(), v, getattr(self, k)) for k, v in new.items()})

    def hold(self, c: int, classes: int, x: np.ndarray) -> None:
        for k in (0, 1):
            for i, at in enumerate(self._own(c, classes, len(x), k).tolist()):
                if self.low[at] < self.high[at]:
                    self.held[at].append(x[i][(x[i] >= self.low[at]) & (x[i] <= self.high[at])])

    def values(self) -> np.ndarray:
        """The mean of the two middle values of each (row, class)."""
        out = self.low.copy()
        for at, held in enumerate(self.held):
            if held:
                out[at] = np.sort(np.concatenate(held))[int(self.rank[at] - self.below[at])]
        return out.reshape(-1, 2).mean(axis=1)


class _Pool:
    """The written pool: parts by key, each in files that a task reads batch by batch."""

    def __init__(self, path: str):
        self.path, self.part, self.kept = path, None, []

    def _batches(self, part: int) -> Iterator[pa.RecordBatch | None]:
        store, top = fs.FileSystem.from_uri(self.path)
        where = f"{top}/part={part}"
        if store.get_file_info(where).type == fs.FileType.NotFound:
            return
        for f in sorted(f.path for f in store.get_file_info(fs.FileSelector(where)) if f.path.endswith(".parquet")):
            with store.open_input_file(f) as opened:
                yield from pq.ParquetFile(opened, buffer_size=1 << 20).iter_batches(MET)  # page by page
            yield None

    def read(self, part: int) -> Iterator[pa.RecordBatch | None]:
        """All batches of a part, None after each file; a small part is kept until another is read."""
        if part == self.part:
            yield from self.kept
            return
        self.part, self.kept, kept = None, [], []
        for batch in self._batches(part):
            kept = None if kept is None or sum(b.nbytes for b in [*kept, batch] if b) > KEEP else [*kept, batch]
            yield batch
        if kept is not None:
            self.part, self.kept = part, kept


def pooled_stats(rows: DataFrame, pool: DataFrame, metric: str, *, key: str | None = None, empty: float = 0.0, classes: tuple[int, ...] = CLASSES) -> DataFrame:
    """id and, for each class r, mean_r, std_r (population), min_r, median_r and max_r of the similarity of each of `rows` (id, value[, key]) to the rows of `pool` (id, value, r[, key]) of class r, another id and, if asked, the same key; `empty` where there are none.

    `value` is a vector or a list of items, as the metric takes; a null one is
    empty, vectors of unlike sizes have no similarity.  Ids are unique and not
    null; a row whose key is null meets none, nor does a pool row whose class is
    null.  Other columns aren't read; an empty table gives no rows, an empty
    pool `empty`.
    """
    spark, kind, n_classes = rows.sparkSession, rows.schema["id"].dataType.simpleString(), len(classes)
    if kind not in ("string", "bigint"):
        raise ValueError("ids must be bigint or string")
    name = F.to_json(F.struct(key)) if key else F.lit("")
    value = _coded(F.coalesce("value", F.array().cast(rows.schema["value"].dataType)), metric).alias("value")
    met = pool.where(F.col("r").isin(*classes)).select("id", "r", name.alias("name"), value, *[F.col(k).alias("__key") for k in [key] if k])
    met = met.where("__key is not null").drop("__key") if key else met
    groups = met.groupBy("name").agg(F.count("*").alias("met"))
    sizes = groups.agg(F.sum("met"), F.max("met"), F.count("*")).first()
    n_pool, most, n_keys = sizes[0] or 0, sizes[1] or 0, sizes[2]
    sets = metric in ("jaccard", "dice")
    parts = max(1, min(n_keys, n_pool // MET))
    part, salt = F.pmod(F.xxhash64("name"), F.lit(parts)).cast("int"), F.pmod(F.xxhash64("id"), F.lit(n_pool // PART + 1))
    path = scratch(spark, "pool")
    height, mixed = max(1, min(BLOCK, CELLS // max(most, 1))), False
    if sets:
        seen = met.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_pool // SEEN + 1)) == 0).select(F.size("value").alias("n"))
        items, many = seen.agg(F.avg("n"), F.count_distinct("n")).first()
        height, mixed = max(1, min(8 * BLOCK, max(BLOCK, most // 64), int(ITEMS // max(items or 0, 1.0)))), many >= SIZES
    order = [F.xxhash64("id", F.lit(2))] if mixed else [F.size("value")] if sets else []
    dealt = met.withColumn("part", part).withColumn("salt", salt).repartition("part", "salt").sortWithinPartitions("part", "name", "r", *order, "id")
    dealt.drop("salt").write.partitionBy("part").parquet(path)

    rest = rows.where(F.coalesce(~F.col("r").isin(*classes), F.lit(True))) if rows is pool else rows
    own = rest.select("id", name.alias("name"), value, *[F.col(k).alias("__key") for k in [key] if k])
    own = own.where("__key is not null").drop("__key") if key else own
    if rows is pool:  # values are computed once
        own = own.unionByName(spark.read.schema(met.schema).parquet(path).select("id", "name", "value"))
    number = own.groupBy("name").agg(F.ceil(F.count("*") / height).alias("blocks")).join(groups, "name")
    count = number.agg(F.sum("blocks")).first()[0] or 0
    own = own.join(F.broadcast(number) if n_keys <= 100_000 else number, "name").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    left = own.groupBy("name", "block").agg(F.first("met").alias("met"), F.sort_array(F.collect_list(F.struct("id", "value"))).alias("rows"))  # of a block
    left = left.select(F.concat("name", F.lit(":"), "block").alias("own"), "name", part.alias("part"), "met", F.col("rows")["id"].alias("ids"), F.col("rows")["value"].alias("values"))
    n_tasks = max(1, min(count, 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    together = lambda df: df.repartition(n_tasks, "own").sortWithinPartitions("part", "own")
    left = together(left).persist()
    measure, names = METRICS[metric], [f"{s}_{r}" for r in classes for s in STATS]

    def meetings(first: pa.RecordBatch, held: _Pool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(class, similarities, places of the rows themselves or -1) of each meeting of a block."""
        own = measure(first["values"].flatten())
        return ((c, own(others), same) for c, others, same in met_by(first, held) if c >= 0)

    def met_by(first: pa.RecordBatch, held: _Pool, ids: np.ndarray | None = None) -> Iterator[tuple[int, pa.ListArray | None, np.ndarray | None]]:
        """(class, values of the pool, places of the rows themselves or -1) of each meeting of a block, or of some ids of it; class -1 after each file."""
        ids = np.array(first["ids"][0].as_py()) if ids is None else ids
        order = np.argsort(ids)
        for m in held.read(first["part"][0].as_py()):
            if m is None:
                yield -1, None, None
                continue
            if key:
                m = m.filter(pc.equal(m["name"], first["name"][0]))
            r = m["r"].to_numpy()
            for c, label in enumerate(classes):
                at = np.flatnonzero(r == label)
                if len(at):
                    some = m if len(at) == len(r) else m.take(pa.array(at))
                    others = np.array(some["id"].to_pylist()) if kind == "string" else some["id"].to_numpy()
                    place = order[np.minimum(np.searchsorted(ids[order], others), len(ids) - 1)]
                    mine = np.flatnonzero(ids[place] == others)
                    same = np.full(len(ids), -1)
                    same[place[mine]] = mine
                    yield c, some["value"], same

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (b.slice(i, 1) for b in batches for i in range(b.num_rows))

    def without_own(x: np.ndarray, same: np.ndarray) -> np.ndarray:
        inside = np.flatnonzero(same >= 0)
        x[inside, same[inside]] = np.nan
        return x

    def row(first: pa.RecordBatch, stats: np.ndarray, met: np.ndarray, middle: _Middle | None) -> pa.RecordBatch:
        flat = middle and {k: v.tolist() for k, v in middle.flat().items()}
        made = {"own": first["own"][0].as_py(), "ids": first["ids"][0].as_py(), "stats": stats.tolist(), "met": met.tolist(), "middle": flat, "open": middle is not None and bool(middle.open().any())}
        return pa.RecordBatch.from_pylist([made], schema=arrow)

    def of_all(first: pa.RecordBatch, held: _Pool, values: pa.ListArray, ids: np.ndarray) -> np.ndarray:
        """STATS by row and class of some rows of a block, whose similarities are held."""
        own, n = measure(values), len(ids)
        parts, place, wide = [[] for _ in classes], np.full((n_classes, n), -1), [0] * n_classes
        for c, others, same in met_by(first, held, ids):
            if c >= 0:
                place[c] = np.where(same >= 0, same + wide[c], place[c])
                wide[c] += len(others)
                parts[c].append(own(others))
        return np.stack([_statistics(p, place[c]) if p else np.full((n, len(STATS)), np.nan) for c, p in enumerate(parts)], axis=1)

    def of_sets(first: pa.RecordBatch, held: _Pool, values: pa.ListArray, ids: np.ndarray) -> np.ndarray:
        """STATS by row and class of rows of a block of sets."""
        own, n, many = measure(values), len(ids), first["met"][0].as_py()
        if not own.light and n * many <= CELLS:
            return of_all(first, held, values, ids)
        if not mixed:
            tallies = [_Tally(own) for _ in classes]
            for c, others, same in met_by(first, held, ids):
                if c >= 0:
                    tallies[c].meet(others, same)
                if sum(t.held for t in tallies) > 2 * PAIRS:  # the pool's sizes are many
                    break
            else:
                return np.stack([t.statistics() for t in tallies], axis=1)
        step = max(1, int(PAIRS / min(many, MET if mixed else PART) / min(1.0, own.shared + 1 / 8)))
        if n > step:
            return np.concatenate([of_sets(first, held, values.slice(lo, step), ids[lo : lo + step]) for lo in range(0, n, step)])
        spreads = [_Spread(own) for _ in classes]
        for c, others, same in met_by(first, held, ids):
            if c >= 0:
                spreads[c].meet(others, same)
            for s in spreads:
                if mixed or c < 0:
                    s.settle()
        found, lost = zip(*[s.statistics() for s in spreads], strict=True)
        found, again, few = np.stack(found, axis=1), np.unique(np.concatenate(lost)), max(1, CELLS // many)
        for lo in range(0, len(again), few):
            at = again[lo : lo + few]
            found[at] = of_all(first, held, values.take(pa.array(at)), ids[at])
        return found

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Pool(path)
        for first in each(batches):
            n = len(first["ids"][0])
            if sets or first["met"][0].as_py() <= KEPT:
                found = (of_sets if sets else of_all)(first, held, first["values"].flatten(), np.array(first["ids"][0].as_py()))
                some = ~np.isnan(found[:, :, 0])
                yield row(first, np.where(some[:, :, None], found, empty).reshape(n, -1), some, None)
                continue
            block = _Moments(n, n_classes)
            for c, x, same in meetings(first, held):
                block.meet(c, without_own(x, same))
            found = {"mean": block.mean, "std": np.sqrt(block.square / np.maximum(block.n, 1)), "min": block.low, "median": np.zeros(block.n.shape), "max": block.high}
            table = np.stack([np.where(block.n > 0, found[s], empty) for s in STATS], axis=2).reshape(n, -1)
            yield row(first, table, block.n > 0, _Middle.of(block))

    def narrowed(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = _Pool(path)
            for first in each(batches):
                middle = _Middle(**first["middle"][0].as_py())
                for c, x, same in meetings(first, held):
                    (middle.hold if last else middle.count)(c, n_classes, without_own(x, same))
                table, met = np.array(first["stats"][0].as_py()), np.array(first["met"][0].as_py())
                if last:
                    median = table.reshape(len(table), n_classes, len(STATS))[:, :, STATS.index("median")]
                    median[met] = middle.values().reshape(met.shape)[met]
                else:
                    middle = middle.narrowed()
                yield row(first, table, met, middle)

        return run

    bounds = "struct<" + ", ".join(f"{k}: array<double>" for k in _Middle.NAMES) + ">"
    schema = f"own string, ids array<{kind}>, stats array<array<double>>, met array<array<boolean>>, middle {bounds}, open boolean"
    floats = pa.list_(pa.float64())
    id_kind = pa.string() if kind == "string" else pa.int64()
    arrow = pa.schema([("own", pa.string()), ("ids", pa.list_(id_kind)), ("stats", pa.list_(floats)), ("met", pa.list_(pa.list_(pa.bool_()))), ("middle", pa.struct([(k, floats) for k in _Middle.NAMES])), ("open", pa.bool_())])
    found = left.mapInArrow(moments, schema).persist()
    many = found.where("middle is not null")
    state, passes = many, []
    while state.where("open").limit(1).count():
        state = together(left.drop("met").join(state.select("own", "stats", "met", "middle"), "own")).mapInArrow(narrowed(False), schema).persist()
        passes.append(state)
    if many.limit(1).count():
        last = together(left.drop("met").join(state.select("own", "stats", "met", "middle"), "own")).mapInArrow(narrowed(True), schema)
        found = found.where("middle is null").unionByName(last)
    out = found.select(F.explode(F.arrays_zip("ids", "stats")).alias("x")).select(F.col("x.ids").alias("id"), *[F.col("x.stats")[i].alias(n) for i, n in enumerate(names)])
    return rows.select("id").join(out, "id", "left").na.fill(empty, names)
