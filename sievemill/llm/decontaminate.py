"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of consecutive words, each a set of
shingles.  A document holds a window only if it holds all its shingles, so the
necessary prefix is one shingle: the rarest.  Pass 1 counts the benchmark's
shingles over all documents (a window with a shingle that never occurs goes).
Pass 2 joins the documents' shingles with the windows' rarest ones, drops
meetings whose window would begin before or end after the document, and
compares the remaining windows word by word.

Both passes read the documents once and shuffle counts only.  The benchmark is
taken in blocks of a bounded size, of which tasks hold one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Blocks, HashTable
from .storage import fresh, small_batches
from .words import ALNUM, Words, buffers, shingles, slices, split

#: Bytes of benchmark text in a block, about.
BLOCK = 8 << 20


@dataclass
class Windows:
    """Distinct windows of a block of items; window w has the words of `words[w]` and belongs to items `owners[w]`."""

    words: list[tuple[bytes, ...]] = field(default_factory=list)
    owners: list[list[str]] = field(default_factory=list)
    parts: list[np.ndarray] = field(default_factory=list)  # hashes of a window's shingles, by offset
    hashes: list[np.ndarray] = field(default_factory=list)  # of its words

    @classmethod
    def of(cls, items: list[tuple[str, str]], window: int, k: int) -> Windows:
        out, known = cls(), {}
        data, at = buffers(pa.array([t for _, t in items], pa.large_string()))
        if not items:
            return out
        words = split(data, at, ALNUM)
        h, first = words.hashes(), words.first
        lengths = np.diff(first)
        by_size = {}
        for g in range(1, k + 1):  # shingles of items of g words or more come first, in order; those of shorter items are appended
            n_own = np.where(lengths >= g, lengths - g + 1, 0)
            by_size[g] = shingles(words, g)[0], np.cumsum(n_own) - n_own
        for i, (item, _) in enumerate(items):
            n = int(first[i + 1] - first[i])
            size = min(window, n)
            if not n:
                continue
            g = min(k, size)
            values, begin = by_size[g]
            lo = int(begin[i])
            for s in range(first[i], first[i + 1] - size + 1):
                spelled = tuple(words.low[words.start[j] : words.end[j]].tobytes() for j in range(s, s + size))
                w = known.setdefault(spelled, len(out.words))
                if w == len(out.words):
                    out.words.append(spelled)
                    out.owners.append([])
                    from_ = lo + s - int(first[i])
                    out.parts.append(values[from_ : from_ + size - g + 1])
                    out.hashes.append(h[s : s + size])
                if item not in out.owners[w]:
                    out.owners[w].append(item)
        return out


class Prefixes:
    """The windows of a block by their rarest shingle."""

    def __init__(self, windows: Windows, counts: dict[int, int], window: int, k: int):
        live, rare, offset = [], [], []
        for w, parts in enumerate(windows.parts):
            seen = [counts.get(int(p), 0) for p in parts]
            at = min(range(len(seen)), key=lambda j: (seen[j], j))
            if seen[at]:
                live.append(w)
                rare.append(parts[at])
                offset.append(at)
        self.words = [windows.words[w] for w in live]
        self.owners = [windows.owners[w] for w in live]
        self.size = np.array([len(x) for x in self.words], np.int64)
        self.offset = np.array(offset, np.int64)
        self.matrix = np.zeros((len(live), window), np.uint64)
        for i, w in enumerate(live):
            self.matrix[i, : self.size[i]] = windows.hashes[w]
        self.by_size = {}
        for g in range(1, k + 1):
            own = np.flatnonzero(np.minimum(self.size, k) == g)
            if len(own):
                keys = np.array([rare[i] for i in own], np.uint64)
                order = np.argsort(keys, kind="stable")
                table = HashTable(keys)
                self.by_size[g] = (table, own[order], np.append(np.searchsorted(keys[order], table.keys), len(own)))

    def matches(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence."""
        found_at, found = [], []
        owner, h = words.owner(), words.hashes()
        for g, (table, lists, cuts) in self.by_size.items():
            values, _, place = shingles(words, g)
            hit, key = table.find(values)
            n = cuts[key + 1] - cuts[key]
            w = lists[np.repeat(cuts[key] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            s = np.repeat(place[hit], n) - self.offset[w]
            stop = s + self.size[w]
            fits = (s >= 0) & (stop <= len(h))
            s, w, stop = s[fits], w[fits], stop[fits]
            fits = owner[s] == owner[stop - 1] if len(s) else fits[:0]
            s, w = s[fits], w[fits]
            same = np.ones(len(s), bool)
            for j in range(self.matrix.shape[1]):
                same &= (self.size[w] <= j) | (h[np.minimum(s + j, len(h) - 1)] == self.matrix[w, j])
            s, w = s[same], w[same]
            exact = [all(words.low[words.start[a + j] : words.end[a + j]].tobytes() == x for j, x in enumerate(self.words[b])) for a, b in zip(s.tolist(), w.tolist(), strict=True)]
            found_at.append(s[np.array(exact, bool)])
            found.append(w[np.array(exact, bool)])
        return (np.concatenate(found_at), np.concatenate(found)) if found else (np.empty(0, np.int64),) * 2


def _counter(tables: Blocks, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column(0))
            for b, (sizes, table) in enumerate(tables):
                total = np.zeros(len(table.keys), np.int64)
                for lo, hi in slices(at):
                    words = split(data, at[lo : hi + 1], ALNUM)
                    for g in sizes:
                        total += np.bincount(table.find(shingles(words, g)[0])[1], minlength=len(total))
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), b, np.int32)), pa.array(some), pa.array(total[some])], names=["block", "place", "n"])

    return run


@dataclass
class Finder:
    """Scans texts for the windows of all blocks."""

    blocks: Blocks

    def scan(self, texts: pa.Array) -> tuple[list[int], list[int], list[list[str]]]:
        """(words, hit words, item ids in order) of each text."""
        data, at = buffers(texts)
        n_words, n_hit, items = [], [], []
        for lo, hi in slices(at):
            words = split(data, at[lo : hi + 1], ALNUM)
            cover = np.zeros(len(words.start) + 1, np.int64)
            found: list[set[str]] = [set() for _ in range(hi - lo)]
            owner = words.owner()
            for prefixes in self.blocks:
                s, w = prefixes.matches(words)
                np.add.at(cover, s, 1)
                np.add.at(cover, s + prefixes.size[w], -1)
                for d, x in zip(owner[s].tolist(), w.tolist(), strict=True):
                    found[d].update(prefixes.owners[x])
            hit = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
            n_words += np.diff(words.first).tolist()
            n_hit += np.diff(hit[words.first]).tolist()
            items += [sorted(x) for x in found]
        return n_words, n_hit, items


def _dealt(rows: DataFrame, name: str) -> DataFrame:
    """Rows written in a folder for each `block`, so that a block is read by itself."""
    path = fresh(rows.sparkSession, name)
    rows.write.partitionBy("block").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def finder(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, k: int = 3, item_col: str = "item_id", item_text: str = "text", text_col: str = "text") -> Finder:
    """Read the benchmark block by block, count its shingles over all of `docs` and order them by rarity.

    Items whose id is null, or whose text has no words, have no windows.
    """
    spark = small_batches(docs).sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).where("item is not null")
    weight = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-weight // BLOCK) or 1
    items = _dealt(items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))), "benchmark")
    cut = lambda b: Windows.of([tuple(r) for r in items.where(F.col("block") == b).select("item", "text").collect()], window, k)

    def table(windows: Windows) -> tuple[list[int], HashTable]:
        keys = np.concatenate(windows.parts) if windows.parts else np.empty(0, np.uint64)
        return sorted({min(k, len(x)) for x in windows.words}), HashTable(keys)

    tables = Blocks(spark.sparkContext, (table(cut(b)) for b in range(blocks)))
    counted = docs.select(text_col).mapInArrow(_counter(tables, k), "block int, place bigint, n bigint")
    counted = _dealt(counted.groupBy("block", "place").agg(F.sum("n").alias("n")), "rarities")

    def prefixes(b: int) -> Prefixes:
        windows = cut(b)
        keys = table(windows)[1].keys
        counts = {int(keys[r.place]): r.n for r in counted.where(F.col("block") == b).collect()}
        return Prefixes(windows, counts, window, k)

    return Finder(Blocks(spark.sparkContext, (prefixes(b) for b in range(blocks))))


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of `docs`.

    Words are runs of digits, a-z (after lower-casing A-Z) and characters beyond
    ASCII; a word within an occurrence of a window is hit.  Null and empty texts
    have no words; rows with equal or null ids are rows like any other; only id
    and text are read; an empty table gives no rows, an empty benchmark no hits.
    """
    found = finder(docs, benchmark, text_col=text_col, **options)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_hit, items = found.scan(batch.column(1))
            sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            columns = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    rows = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    out = rows.mapInArrow(run, f"id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean")
    return out.withColumnRenamed("id", id_col)


def clean_rows(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs`, all columns of whatever names, that hold no window of the benchmark.

    Null and empty texts hold none; repeated rows and null ids are rows like any
    other; an empty table stays empty, an empty benchmark drops nothing.
    """
    found = finder(docs, benchmark, text_col=text_col, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit = found.scan(batch.column(batch.schema.get_field_index(text_col)))[1]
            yield batch.filter(pa.array([x == 0 for x in n_hit], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
