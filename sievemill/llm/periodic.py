"""Runs of repeated words, found on a harmonic grid with prefix hashes.

A run is a longest stretch of words with smallest period q that is `times` * q
long at least (three times, or more), and LEAST words.  For each period q the
grid has a point at every multiple of q, so a text of n words has some n ln n
(period, point) pairs.  A run holds two whole cells of its period's grid, next
to each other and equal.  All pairs of a stretch of texts are taken together in
numpy: a first probe of the prefix hashes drops pairs whose cells differ; of
pairs that follow each other in one run the first stays; for these, the longest
common extensions of the two points to the right and to the left are found by
one binary search over all of them.  What is long enough is deduplicated by its
ends, the smallest period stays, and the words themselves are compared.  A hash
that lied is found so, and that text and period are gone through word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import small_batches
from .words import SAME, SPACED, U, Words, buffers, mix, slices, split

#: Words of a run at least, and (period, point) pairs that are taken at a time.
LEAST, PAIRS = 24, 1 << 20
_BASE = U(0x9E3779B97F4A7C15)


@dataclass
class Grid:
    """Words of some texts with their prefix hashes: `sums[i]` is the sum of the first i words' hashes times rising powers of the base."""

    words: Words
    text: bytes
    place: np.ndarray
    sums: np.ndarray
    powers: np.ndarray

    @classmethod
    def of(cls, words: Words) -> Grid:
        n = len(words.start)
        powers = np.full(n + 1, _BASE, U)
        powers[0] = 1
        np.cumprod(powers, dtype=U, out=powers)
        sums = np.zeros(n + 1, U)
        np.cumsum(mix(words.hashes()) * powers[:-1], dtype=U, out=sums[1:])
        text, place = words.spaced()
        return cls(words, text.tobytes(), place, sums, powers)

    def equal(self, a: np.ndarray, q: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the stretches of `size` words at a and at a + q have equal hashes."""
        s, b = self.sums, a + q
        return (s[a + size] - s[a]) * self.powers[q] == s[b + size] - s[b]

    def bytes(self, i: int, j: int) -> bytes:
        """The words i to j, that one left out, with a space between every two."""
        return self.text[self.place[i] : self.place[j - 1] + self.words.end[j - 1] - self.words.start[j - 1]] if j > i else b""

    def word(self, i: int) -> bytes:
        return self.bytes(i, i + 1)

    def extended(self, a: np.ndarray, q: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
        """The longest common extension of points a and a + q, of `most` words at most: to the right (step 1) or the left (-1); one search over all."""
        low, high = np.zeros(len(a), np.int64), most.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_] + 1) // 2
            start = a[open_] if step > 0 else a[open_] - middle
            same = self.equal(start, q[open_], middle)
            low[open_[same]] = middle[same]
            high[open_[~same]] = middle[~same] - 1
        return low

    def pairs(self, times: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, period, point) of all grid points with two whole cells, in that order, in stretches of about PAIRS; a (text, period) is whole."""
        count = np.diff(self.words.first)
        texts = np.flatnonzero(count >= max(least, times))
        periods = count[texts] // times
        before = np.append(0, np.cumsum(periods))
        lo, total = 0, int(before[-1])
        while lo < total:
            k = np.arange(lo, min(lo + PAIRS, total))
            at = np.searchsorted(before, k, "right") - 1
            q, text = k - before[at] + 1, texts[at]
            points = count[text] // q - 1
            end = max(1, int(np.searchsorted(np.cumsum(points), PAIRS, "right")))
            q, text, points = q[:end], text[:end], points[:end]
            number = np.arange(int(points.sum())) - np.repeat(np.cumsum(points) - points, points)
            q, text = np.repeat(q, points), np.repeat(text, points)
            yield text, q, self.words.first[text] + number * q
            lo += end

    def runs(self, times: int = 3, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
        """The runs of each text: (start, length, period) by start, then period; start counts the text's own words."""
        found: list[tuple[np.ndarray, ...]] = []
        doubtful: set[tuple[int, int]] = set()
        first = self.words.first
        for text, q, a in self.pairs(times, least):
            hit = np.flatnonzero(self.equal(a, q, np.ones_like(q)))
            hit = hit[self.equal(a[hit], q[hit], q[hit])]
            text, q, a = text[hit], q[hit], a[hit]
            if not len(a):
                continue
            head = np.ones(len(a), bool)
            head[1:] = (text[1:] != text[:-1]) | (q[1:] != q[:-1]) | (a[1:] != a[:-1] + q[1:])
            last = np.append(np.flatnonzero(head)[1:], len(a)) - 1
            until = a[last] + 2 * q[last]
            text, q, a = text[head], q[head], a[head]
            right = self.extended(a, q, first[text + 1] - a - q, 1)
            start = a - self.extended(a, q, a - first[text], -1)
            end = a + q + right
            doubtful.update(zip(text[end < until].tolist(), q[end < until].tolist(), strict=True))
            whole = end - start >= np.maximum(least, times * q)
            found.append((text[whole], start[whole], end[whole], q[whole]))
        text, start, end, q = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.empty(0, np.int64)] * 4
        order = np.lexsort((q, end, start, text))
        text, start, end, q = text[order], start[order], end[order], q[order]
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(first) - 1)]
        held: dict[int, set[tuple[int, int]]] = {}
        for t, i, j, p in zip(text.tolist(), start.tolist(), end.tolist(), q.tolist(), strict=True):
            if (i, j) not in held.setdefault(t, set()) and (t, p) not in doubtful:
                if self.bytes(i, j - p) == self.bytes(i + p, j):
                    held[t].add((i, j))
                    out[t].append((i - int(first[t]), j - i, p))
                else:
                    doubtful.add((t, p))
        for t in {t for t, _ in doubtful}:
            out[t] = self._by_words(t, out[t], sorted(p for u, p in doubtful if u == t), times, least)
        return out

    def _by_words(self, t: int, known: list[tuple[int, int, int]], periods: list[int], times: int, least: int) -> list[tuple[int, int, int]]:
        """The runs of text t, those of some periods found by comparing words one by one."""
        lo, hi = int(self.words.first[t]), int(self.words.first[t + 1])
        words = [self.word(i) for i in range(lo, hi)]
        best = {(i, n): p for i, n, p in known}
        for p in periods:
            same = np.array([x == y for x, y in zip(words, words[p:], strict=False)], bool)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
            for i, j in edge.reshape(-1, 2).tolist():
                if (n := j - i + p) >= max(least, times * p):
                    best[i, n] = min(p, best.get((i, n), p))
        return sorted((i, n, p) for (i, n), p in best.items())


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; of equal ones that of the smallest start, then period."""
    best = None
    for run in runs:  # by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(grid: Grid, t: int, runs: list[tuple[int, int, int]]) -> bytes:
    """Text t's words with one space between them, without those that a run contains after its first period."""
    lo, hi = int(grid.words.first[t]), int(grid.words.first[t + 1])
    kept, at = [], lo
    for start, stop in sorted((lo + i + p, lo + i + n) for i, n, p in runs):
        if start > at:
            kept.append(grid.bytes(at, start))
        at = max(at, stop)
    if hi > at:
        kept.append(grid.bytes(at, hi))
    return b" ".join(kept)


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _repeats(times: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column(0))
            for lo, hi in slices(at):
                grid = Grid.of(split(data, at[lo : hi + 1], SPACED, SAME))
                runs = grid.runs(times, least)
                record = lambda r: dict(zip(RUN.names, r, strict=True)) if r else None
                own = [
                    pa.array(np.diff(grid.words.first)),
                    pa.array([[record(r) for r in rs] for rs in runs], pa.list_(RUN)),
                    pa.array([record(strongest(rs)) for rs in runs], RUN),
                    pa.array([collapsed(grid, t, rs).decode() for t, rs in enumerate(runs)], pa.string()),
                ]
                rest = [batch.column(i).slice(lo, hi - lo) for i in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays(rest + own, names=[*batch.schema.names[1:], "n_words", "runs", "strongest", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", times: int = 3, least: int = LEAST) -> DataFrame:
    """The columns `keep` and n_words, runs (array of start, length, period, by start and then period), strongest, collapsed, for every row.

    Words are what white space separates, as they stand, numbered from 0.
    `strongest` is the run with the greatest length / period (of equal ones the
    smallest start, then period), null without runs.  `collapsed` is the text
    with one space between words, without the words that a run contains after
    its first period.  A null or empty text has no words and collapses to an
    empty one.  Rows are independent: null and repeated ids stay as they are;
    columns that aren't kept aren't read, and one that is kept may not have a
    name of the result (ValueError).  An empty table gives no rows.
    """
    if times < 3:
        raise ValueError("a run has three periods at least")
    if clash := {"n_words", "runs", "strongest", "collapsed"} & set(keep):
        raise ValueError(f"kept columns have names of the result: {sorted(clash)}")
    rows = small_batches(docs.select(F.col(text_col).alias("__text"), *keep))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    run = "struct<start: bigint, length: bigint, period: bigint>"
    return rows.mapInArrow(_repeats(times, least), f"{kinds}{', ' if keep else ''}n_words bigint, runs array<{run}>, strongest {run}, collapsed string")


def planted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` in which the texts of some ids get a periodic end, as a test of the search.

    With h the crc32 of the decimal id and g = h div 10, a text of n > 0 words
    whose h is a multiple of 10 repeats the p = 1 + (n - a) div (3 + g mod 8)
    words from a = g mod n on.  A null id changes nothing.
    """
    own = "__"
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    h, words, n, a, p = (f"{own}{x}" for x in ("h", "words", "n", "a", "p"))
    rows = docs.withColumn(h, F.crc32(F.col(id_col).cast("string").cast("binary")))
    rows = rows.withColumn(words, F.when(F.col(h) % 10 == 0, F.regexp_extract_all(text_col, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(0))))
    rows = rows.withColumn(n, F.when(F.size(words) > 0, F.size(words)))
    rows = rows.withColumn(a, F.expr(f"{h} div 10 % {n}")).withColumn(p, F.expr(f"1 + ({n} - {a}) div (3 + {h} div 10 % 8)"))
    changed = F.expr(f"array_join(transform(sequence(0, {n} - 1), i -> {words}[cast(if(i < {a}, i, {a} + (i - {a}) % {p}) as int)]), ' ')")
    return rows.withColumn(text_col, F.when(F.col(n) > 0, changed).otherwise(F.col(text_col))).select(docs.columns)
