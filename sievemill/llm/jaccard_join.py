"""N-gram Jaccard join by T-occurrence search.

A document is the set of its shingles.  Two sets x, y with Jaccard similarity of
num / den at least share T = ceil(num * |x| / den) shingles of x or more, so

1. an inverted index over all shingles tells how many documents hold each one; a
   document of which fewer than T shingles occur elsewhere is linked with none
   and goes no further;
2. the other sets keep their shared shingles, rarest first.  Any T - 1 of a
   set's lists may be skipped, as a partner occurs in one of the others at
   least; so a set is sent to the rarest of its lists only, which are cut into
   blocks of documents, and within a block it is searched by DivideSkip: its
   lists there are ordered by length, the short ones merged with a count of
   each document's occurrences, and documents that can still reach T are sought
   in the long ones by binary probes;
3. blocks of four lists join most of what belongs together, in time linear in
   the length of a list.  Lists that then still hold several components are
   read whole: pairs across components that sizes and places allow are probed
   shingle by shingle, first a share of them, at last all that are left.  Exact
   copies are one set from the start.  So no group of copies is expanded into
   its pairs and no link that could join two components is missed.

The index travels as packed numpy arrays, one value for each batch of documents
and range of shingle hashes.  Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, merged
from .packed import pack, unpack
from .storage import discard, n_parts, small_batches, written
from .words import SPACED, U, buffers, mix, shingles, slices, split

#: Stands for a null doc_id.
NO_ID = (1 << 63) - 1
#: Short lists of a document whose blocks it is searched in; documents (and bytes of shingles) of a block; bytes that are searched together.
LISTS, BLOCK, BLOCK_BYTES, BATCH_BYTES = 4, 64, 32 << 20, 4 << 20
#: Shares of the pairs across components that are decided in turn; the last turn decides all that are left.
WAVES = (8, 1)
#: Documents of a slice of a list; pairs that a task tests at a time.
SLICE, MEETINGS = 1000, 1 << 20
_RANKS = 28


def _deal(ids: np.ndarray, parts: int) -> np.ndarray:
    return (mix(ids.astype(U)) % U(parts)).astype(np.int64)


def _index(k: int, parts: int, alphabet: np.ndarray):
    """(doc_id, text) -> (part, kind, body): kind 0 has set sizes, kind 1 the postings of a range of hashes."""
    edges = np.array([-(-(j << 64) // parts) for j in range(parts)], U)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, at = buffers(batch.column(1))
            for lo, hi in slices(at):
                ids, out = all_ids[lo:hi], []
                h, doc, _ = shingles(split(data, at[lo : hi + 1], alphabet), k)
                order = np.argsort(h, kind="stable")
                h, doc = h[order], doc[order]
                fresh = np.ones(len(h), bool)
                fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                h, doc = h[fresh], doc[fresh]
                out.append((int(_deal(ids[:1], parts)[0]), 0, pack(ids, np.bincount(doc, minlength=hi - lo).astype(np.int32))))
                cuts = np.append(np.searchsorted(h, edges), len(h))
                for j in np.flatnonzero(np.diff(cuts)).tolist():
                    own = doc[cuts[j] : cuts[j + 1]]
                    present = np.zeros(hi - lo, bool)
                    present[own] = True
                    place = np.cumsum(present) - 1
                    hs = h[cuts[j] : cuts[j + 1]]
                    out.append((j, 1, pack(ids[present], place[own].astype(np.uint16 if present.sum() < 65536 else np.int32), np.diff(hs, prepend=U(0)))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["part", "kind", "body"])

    return run


def _shared(parts: int):
    """The rows of one range of hashes -> (part, kind, body) dealt by document: sizes, and the postings of shingles that two documents hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, tokens, part = [], [], 0
        for batch in batches:
            out = []
            for part, kind, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                a = unpack(body)
                if kind == 0:
                    to = _deal(a[0], parts)
                    for j in np.unique(to).tolist():
                        out.append((j, 0, pack(a[0][to == j], a[1][to == j])))
                else:
                    docs.append(a[0][a[1]])
                    tokens.append(np.cumsum(a[2], dtype=U))
            if out:
                yield _rows(out)
        if not docs:
            return
        doc, token = np.concatenate(docs), np.concatenate(tokens)
        docs.clear()
        tokens.clear()
        order = np.argsort(token, kind="stable")
        doc, token = doc[order], token[order]
        first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        df = np.diff(np.append(first, len(token)))
        kept = df > 1
        rank = np.cumsum(kept) - 1
        if kept.sum() >> _RANKS:
            raise ValueError("too many shingles in one range: use more shuffle partitions")
        key = (np.minimum(df, 32767) << 48) | (part << _RANKS) | rank
        held = np.repeat(kept, df)
        doc, key = doc[held], np.repeat(key, df)[held]
        to = _deal(doc, parts)
        order = np.lexsort((doc, to))
        doc, key, to = doc[order], key[order], to[order]
        cuts = np.searchsorted(to, np.arange(parts + 1))
        for j in np.flatnonzero(np.diff(cuts)).tolist():
            d = doc[cuts[j] : cuts[j + 1]]
            starts = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
            yield _rows([(j, 1, pack(d[starts], np.diff(np.append(starts, len(d))).astype(np.int32), key[cuts[j] : cuts[j + 1]]))])

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["part", "kind", "body"])


def _sets(num: int, den: int):
    """The rows of one deal of documents -> (doc_id, n, m, twin): m is the shared shingles, rarest first, where they suffice for a link; twin is a digest of a set that is shared whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, docs, keys = [], [], [], []
        for batch in batches:
            for kind, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                a = unpack(body)
                if kind == 0:
                    ids.append(a[0])
                    sizes.append(a[1])
                else:
                    docs.append(np.repeat(a[0], a[1]))
                    keys.append(a[2])
        if not ids:
            return
        doc_id, place = np.unique(np.concatenate(ids), return_inverse=True)
        n = np.bincount(place, np.concatenate(sizes)).astype(np.int64)
        doc = np.searchsorted(doc_id, np.concatenate(docs)) if docs else np.empty(0, np.int64)
        key = np.concatenate(keys) if keys else np.empty(0, np.int64)
        order = np.lexsort((key, doc))
        doc, key = doc[order], key[order]
        again = np.zeros(len(doc), bool)
        again[1:] = (doc[1:] == doc[:-1]) & (key[1:] == key[:-1])  # rows that share a doc_id are one document
        n -= np.bincount(doc[again], minlength=len(n))
        doc, key = doc[~again], key[~again]
        cuts = np.searchsorted(doc, np.arange(len(n) + 1))
        m, twin = [], []
        for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            enough = n[i] > 0 and b - a >= -(-num * int(n[i]) // den)
            m.append(key[a:b].tobytes() if enough else None)
            twin.append(hashlib.sha1(m[-1]).hexdigest() if enough and b - a == n[i] else None)
        for a in range(0, len(n), 2000):
            s = slice(a, a + 2000)
            yield pa.RecordBatch.from_arrays([pa.array(doc_id[s]), pa.array(n[s]), pa.array(m[s], pa.binary()), pa.array(twin[s], pa.string())], names=["doc_id", "n", "m", "twin"])

    return run


def _again(parts: int):
    """(doc_id, n, m) -> the rows of `_index` for the shingles in m."""
    edges = np.array([-(-(j << 64) // parts) for j in range(parts)], U)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            lists = [np.frombuffer(m, np.int64) for m in batch.column(2).to_pylist()]
            if not lists:
                continue
            h, doc = mix(np.concatenate(lists).astype(U)), np.repeat(np.arange(len(ids)), [len(x) for x in lists])
            order = np.argsort(h, kind="stable")
            h, doc = h[order], doc[order]
            out = [(int(_deal(ids[:1], parts)[0]), 0, pack(ids, batch.column(1).to_numpy().astype(np.int32)))]
            cuts = np.append(np.searchsorted(h, edges), len(h))
            for j in np.flatnonzero(np.diff(cuts)).tolist():
                out.append((j, 1, pack(ids, doc[cuts[j] : cuts[j + 1]].astype(np.uint16), np.diff(h[cuts[j] : cuts[j + 1]], prepend=U(0)))))
            yield _rows(out)

    return run


def _short_lists(num: int, den: int):
    """(doc_id, n, m) -> the rarest shingles of each document, all but T - 1: key, doc_id, n, size (of m), place, few (places in which a larger partner meets it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[np.ndarray]] = [[] for _ in range(6)]
            for d, n, m in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                keys = np.frombuffer(m, np.int64)
                size = len(keys)
                q = size - -(-num * n // den) + 1
                few = size - -(-2 * num * n // (num + den)) + 1
                for c, x in zip(columns, (keys[:q], np.full(q, d), np.full(q, n), np.full(q, size), np.arange(q), np.full(q, few)), strict=True):
                    c.append(x)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["key", "doc_id", "n", "size", "place", "few"])

    return run


def _decide(num: int, den: int):
    """Pairs with both lists -> the linked pairs, by binary probes of the one list's shingles in the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, ma, mb = (batch.column(i).to_pylist() for i in range(6))
            keep = []
            for i in range(batch.num_rows):
                x, y = np.frombuffer(ma[i], np.int64), np.frombuffer(mb[i], np.int64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(den * both >= num * (na[i] + nb[i] - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("m").alias(f"m{x}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    return rows.select("a", "b", "na", "nb", "ma", "mb").mapInArrow(_decide(num, den), "a bigint, b bigint")


class LocalIndex:
    """Inverted lists of some documents' shingles, searched by T-occurrence; lists hold the documents of one block only."""

    def __init__(self, sets: list[np.ndarray], n: np.ndarray, block: np.ndarray, num: int, den: int):
        self.n, self.num, self.den = n, num, den
        sizes = np.array([len(x) for x in sets])
        self.at = np.append(0, np.cumsum(sizes))
        owner = np.repeat(np.arange(len(sets)), sizes)
        h = mix(np.concatenate(sets).astype(U) + mix(block.astype(U) + U(1))[owner])
        order = np.argsort(h, kind="stable")
        new = np.ones(len(h), bool)
        new[1:] = h[order[1:]] != h[order[:-1]]
        number = np.cumsum(new) - 1
        #: The list of each shingle of each document; documents of all lists, list by list, in order; lists' bounds.
        self.lists = np.empty(len(h), np.int64)
        self.lists[order] = number
        self.docs = owner[order]
        self.start = np.append(np.flatnonzero(new), len(h))
        #: (list, document) as one number, ascending: what binary probes search.
        self.code = number * len(sets) + self.docs

    def partners(self, x: int, component: np.ndarray) -> np.ndarray:
        """Later documents of other components that link with x, by DivideSkip.

        A partner shares T shingles or more with x.  x's lists are ordered by
        length; the short ones are merged, counting each document's
        occurrences, and of the L longest, which aren't read, a document is
        sought by binary probes if it occurs T - L times in the short ones.
        """
        own = self.lists[self.at[x] : self.at[x + 1]]
        length = self.start[own + 1] - self.start[own]
        own, length = own[length > 1], length[length > 1]
        least = -(-self.num * int(self.n[x]) // self.den)
        if len(own) < least:
            return own[:0]
        own = own[np.argsort(length, kind="stable")]
        skip = int(least / (0.02 * math.log2(int(length.max())) + 1)) if least > 1 else 0
        skip = min(skip, least - 1)
        short, long = own[: len(own) - skip], own[len(own) - skip :]
        size = self.start[short + 1] - self.start[short]
        met = self.docs[np.repeat(self.start[short] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
        y, both = np.unique(met[met > x], return_counts=True)
        y, both = y[(may := (both >= least - skip) & (component[y] != component[x]))], both[may]
        if len(y) and skip:
            probes = long[:, None] * len(self.n) + y
            place = np.minimum(np.searchsorted(self.code, probes), len(self.code) - 1)
            both = both + (self.code[place] == probes).sum(axis=0)
        return y[self.den * both >= self.num * (self.n[x] + self.n[y] - both)]


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, m) -> a row for each of the first LISTS short lists of a document: key, salt (of lists of more than BLOCK documents), turn, doc_id, n, m."""
    for batch in batches:
        out: list[tuple] = []
        for d, n, m in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            keys = np.frombuffer(m, np.int64)[:LISTS].copy()
            turn = mix(keys.astype(U) * U(0x9E3779B97F4A7C15) + U(d & 0xFFFFFFFFFFFFFFFF))
            salt = (turn >> U(8)).astype(np.int64) % ((keys >> 48) // BLOCK + 1)
            out += zip(keys.tolist(), salt.tolist(), turn.astype(np.int64).tolist(), [d] * len(keys), [n] * len(keys), [m] * len(keys), strict=True)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names=["key", "salt", "turn", "doc_id", "n", "m"])


def _searched(num: int, den: int):
    """Rows of `_blocked` in the order of (key, salt, turn) -> links (a, b) that connect what belongs together within each block.

    A block ends after BLOCK documents, or when they are large; its last
    document is the first of the next, if that is of the same list.
    """

    def links(rows: list[tuple]) -> pa.RecordBatch:
        blocks = np.array([r[0] for r in rows])
        ids, n = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        index = LocalIndex([np.frombuffer(r[3], np.int64) for r in rows], n, blocks, num, den)
        component, out = np.arange(len(rows)), []
        for x in range(len(rows) - 1):
            if blocks[x] == blocks[x + 1]:
                for y in index.partners(x, component).tolist():
                    if component[x] != component[y]:
                        component[component == component[y]] = component[x]
                        out.append((ids[x], ids[y]))
        a, b = (np.array([p[i] for p in out], np.int64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []  # (block, doc_id, n, m)
        last, block, held, size, total = None, 0, 0, 0, 0
        for batch in batches:
            for key, salt, d, n, m in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5)), strict=True):
                if (key, salt) != last or held >= BLOCK or size > BLOCK_BYTES:
                    again = rows[-1] if rows and (key, salt) == last else None
                    if total > BATCH_BYTES:
                        yield links(rows)
                        rows, total = [], 0
                    last, block, held, size = (key, salt), block + 1, 0, 0
                    if again:
                        rows.append((block, *again[1:]))
                        held, size, total = 1, len(again[3]), total + len(again[3])
                rows.append((block, d, n, m))
                held, size, total = held + 1, size + len(m), total + len(m) + 100
        if rows:
            yield links(rows)

    return run


def _named(short: DataFrame, labels: DataFrame) -> DataFrame:
    """The short lists with each document's component so far."""
    named = short.join(labels.select(F.col("node").alias("doc_id"), "label"), "doc_id", "left")
    return written(named.withColumn("label", F.coalesce("label", "doc_id")), "named-lists")


def _crossing(named: DataFrame, wave: int, num: int, den: int) -> DataFrame:
    """Of the pairs across components that short lists allow, one in `wave` by a hash of the pair; 1: all.

    Only lists of several components are read.  A list of more than SLICE
    documents is dealt into slices, and each two slices meet in a group of
    their own, so no task holds a long list.
    """
    lists = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("held"))
    lists = written(lists.where("lo <> hi").select("key", F.expr(f"(held - 1) div {SLICE} + 1").alias("slices")), "mixed-lists")
    live = named.join(lists, "key").withColumn("own", F.pmod(F.xxhash64("doc_id", "key"), F.col("slices")))
    live = live.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    live = live.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id", "n", "size", "place", "few", "label")
    live = live.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return live.mapInArrow(_meet(wave, num, den), "a bigint, b bigint").distinct()


def _meet(wave: int, num: int, den: int):
    """Rows in groups (key, i, j) -> the pairs of slices i and j that can be links.

    Of a linked pair the smaller set meets the larger in its first `few`
    places, and where they first meet, what is left of both lists holds the
    overlap they need.
    """

    def pairs(c: list[np.ndarray], ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, i, j, own, ids, n, size, place, few, label = c
        last = np.repeat(ends[1:], np.diff(ends))
        row = np.arange(len(ids))
        cuts = np.append(0, np.cumsum(last - row - 1))
        lo = 0
        while lo < len(row):
            hi = max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + MEETINGS, "right")) - 1)
            count = last[lo:hi] - row[lo:hi] - 1
            x = np.repeat(row[lo:hi], count)
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(count) - count, count)
            ok = (label[x] != label[y]) & ((i[x] == j[x]) | (own[x] != own[y]))
            x, y = x[ok], y[ok]
            ok = (n[x] * den >= n[y] * num) & (n[y] * den >= n[x] * num)
            ok &= np.minimum(size[x] - place[x], size[y] - place[y]) * (num + den) >= (n[x] + n[y]) * num
            first = (n[x] < n[y]) | ((n[x] == n[y]) & (ids[x] < ids[y]))
            ok &= np.where(first, place[x] < few[x], place[y] < few[y])
            a, b = np.minimum(ids[x], ids[y])[ok], np.maximum(ids[x], ids[y])[ok]
            if wave > 1:
                ok = mix(a.astype(U) * U(0x9E3779B97F4A7C15) + b.astype(U)) % U(wave) == 0
                a, b = a[ok], b[ok]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            c = [batch.column(k).to_numpy() for k in range(10)]
            c = c if held is None else [np.append(a, b) for a, b in zip(held, c, strict=True)]
            new = np.ones(len(c[0]), bool)
            new[1:] = (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1]) | (c[2][1:] != c[2][:-1])
            starts = np.flatnonzero(new)
            if len(starts):
                yield from pairs([x[: starts[-1]] for x in c], starts)
                held = [x[starts[-1] :] for x in c]
        if held is not None and len(held[0]):
            yield from pairs(held, np.array([0, len(held[0])]))

    return run


def jaccard_components(docs: DataFrame, *, k: int = 5, num: int = 4, den: int = 5, alphabet: np.ndarray = SPACED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every distinct doc_id.

    Sets link when den * |x & y| >= num * |x | y|; component_id is the smallest
    doc_id reachable by links, itself included.  Fewer than k words are one
    shingle; a text without words, or null, is empty and linked with nothing.
    Rows with one doc_id are one document with the union of their sets; a null
    doc_id is such a document too and the last to name a component.  Other
    columns are not read; an empty table gives no rows.
    """
    parts = n_parts(small_batches(docs).sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).alias("text"))
    packed = "part int, kind int, body binary"
    index = rows.mapInArrow(_index(k, parts, alphabet), packed).repartitionById(parts, F.col("part"))
    dealt = index.mapInArrow(_shared(parts), packed).repartitionById(parts, F.col("part"))
    sets = written(dealt.mapInArrow(_sets(num, den), "doc_id bigint, n bigint, m binary, twin string"), "sets")

    twins = sets.where("twin is not null").select("doc_id", "twin", "n")
    leaders = twins.groupBy("twin", "n").agg(F.min("doc_id").alias("leader"), F.count("*").alias("held")).where("held > 1").select("twin", "leader")
    copies = written(twins.join(written(leaders, "leaders"), "twin").select("doc_id", "leader"), "copies")
    single = sets.where("m is not null").select("doc_id", "n", "m").join(copies.where("doc_id <> leader").select("doc_id"), "doc_id", "left_anti")
    # copies made their shingles common: count once more among the sets that are left
    index = written(single, "single").mapInArrow(_again(parts), packed).repartitionById(parts, F.col("part"))
    dealt = index.mapInArrow(_shared(parts), packed).repartitionById(parts, F.col("part"))
    single = written(dealt.mapInArrow(_sets(num, den), "doc_id bigint, n bigint, m binary, twin string").where("m is not null").select("doc_id", "n", "m"), "shared-sets")

    short = written(single.mapInArrow(_short_lists(num, den), "key bigint, doc_id bigint, n bigint, size bigint, place bigint, few bigint"), "short-lists")
    blocks = single.mapInArrow(_blocked, "key bigint, salt bigint, turn bigint, doc_id bigint, n bigint, m binary")
    blocks = blocks.repartition(parts, "key", "salt").sortWithinPartitions("key", "salt", "turn")
    labels = components(blocks.mapInArrow(_searched(num, den), "a bigint, b bigint"))
    for wave in WAVES:
        named = _named(short, labels)
        labels = merged(labels, written(_linked(_crossing(named, wave, num, den), single, num, den), "cross-links"))
        discard(named)

    kin = copies.join(labels.select(F.col("node").alias("leader"), "label"), "leader", "left").select("doc_id", F.coalesce("label", "leader").alias("label"))
    lone = labels.join(copies.select(F.col("doc_id").alias("node")), "node", "left_anti").select(F.col("node").alias("doc_id"), "label")
    kin = written(kin.unionByName(lone), "kin")
    first = written(kin.groupBy("label").agg(F.min("doc_id").alias("component_id")), "components")
    kin = kin.join(first, "label").select("doc_id", "component_id")
    out = sets.select("doc_id", F.col("n").alias("n_shingles")).join(kin, "doc_id", "left")
    known = lambda c: F.when(c != NO_ID, c)
    discard(short)
    return out.select(known(F.col("doc_id")).alias("doc_id"), "n_shingles", known(F.coalesce("component_id", "doc_id")).alias("component_id"))
