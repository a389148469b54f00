"""Near copies by 64-bit fingerprints under Golay-code fuzzy hashing.

Each word shingle's hash votes on 64 bits.  Distinct fingerprints are linked
when they differ in at most three bits:

1. of four quarters of 16 bits one is then equal, and of the two halves of the
   other 48 bits one differs in at most one bit;
2. a 24-bit half is decoded to codewords of the extended binary Golay code.  A
   word at odd distance from the code (1 or 3) has one nearest codeword; a word
   at even distance gets the codewords of its 24 neighbours, one or six.  Two
   words that differ in one bit are of unlike parity, and the odd one's
   codeword is among the other's, so they share a key;
3. a key is (quarter, its bits, half, codeword).  Fingerprints of one key are
   verified bit by bit, in tasks that hold one group at a time.  A group of more
   than GROUP is dealt into blocks, twice, which joins what is dense; what still
   holds several components is refined: the bits that needn't be equal yet are
   cut into four, of which one is equal, and each makes a smaller group.  With
   twelve such bits a group can't exceed GROUP, so this ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, roots
from .storage import n_parts, small_batches, written
from .words import SPACED, U, Words, buffers, mix, slices, split

#: Shingles that are hashed at a time, and fingerprints of one key that are compared pair by pair.
STRETCH, GROUP = 1 << 16, 1 << 12
#: Bits in which linked fingerprints differ at most; the keys are made for three.
RADIUS = 3


def _shingles(words: Words, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, 64-bit hash) of each run of k words joined by a space, of the whole sequence where there are fewer; a stretch at a time."""
    text, place = words.spaced()
    stop, view = place + words.end - words.start, text.tobytes()
    count = np.diff(words.first)
    runs = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    begin = np.append(0, np.cumsum(runs))
    for low in range(0, int(begin[-1]), STRETCH):
        i = np.arange(low, min(low + STRETCH, int(begin[-1])))
        owner = np.searchsorted(begin, i, "right") - 1
        first = words.first[owner] + i - begin[owner]
        last = first + np.minimum(count[owner], k) - 1
        digest = xxhash.xxh64_intdigest
        h = [digest(view[a:b], 42) for a, b in zip(place[first].tolist(), stop[last].tolist(), strict=True)]
        yield owner, np.array(h, U)


def fingerprints(data: np.ndarray, at: np.ndarray, k: int = 3) -> np.ndarray:
    """The fingerprint of each text: bit b is set if it is in over half of its shingles' hashes."""
    words = split(data, at, SPACED)
    votes, total = np.zeros((len(at) - 1, 64), np.int64), np.zeros(len(at) - 1, np.int64)
    for owner, h in _shingles(words, k):
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        cut = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        votes[owner[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
        total[owner[cut]] += np.diff(np.append(cut, len(owner)))
    return np.packbits(2 * votes > total[:, None], axis=1).view(">u8").ravel().astype(U)


def _fingerprinted(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column(1))
            made = [fingerprints(data, at[lo : hi + 1], k) for lo, hi in slices(at)]
            found = np.concatenate(made).view(np.int64) if made else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["id", "fp"])

    return run


#: The perfect binary Golay code's generator polynomial, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 (fixed value).
GENERATOR = 0b101011100011
HALF = 24


def _remainder(v: np.ndarray) -> np.ndarray:
    """23-bit words modulo the generator."""
    v = v.copy()
    for bit in range(22, 10, -1):
        v ^= np.where(v >> bit & 1, GENERATOR << (bit - 11), 0)
    return v


def _error_table() -> np.ndarray:
    """The error of up to three bits that each remainder stands for; the code is perfect, so there is one for each."""
    one = 1 << np.arange(23)
    two = (one[:, None] | one)[np.triu_indices(23, 1)]
    three = np.unique((two[:, None] | one)[(two[:, None] & one) == 0])
    errors = np.concatenate([[0], one, two, three])
    table = np.full(1 << 11, -1)
    table[_remainder(errors)] = errors
    return table


ERRORS = _error_table()
#: Remainder of each single bit of a word.
SINGLE = _remainder(1 << np.arange(23))


def codewords(w: np.ndarray) -> np.ndarray:
    """24-bit words -> a row of up to six 12-bit codeword indices each, filled with -1.

    The low 23 bits belong to the perfect code, the highest is their parity.
    """
    v = w & 0x7FFFFF
    s = _remainder(v)
    own = (v ^ ERRORS[s]) >> 11
    # neighbours: the parity bit's keeps v, the other 23 change one bit of it
    near = (v[:, None] ^ (1 << np.arange(23)) ^ ERRORS[s[:, None] ^ SINGLE]) >> 11
    near = np.sort(np.concatenate([own[:, None], near], axis=1), axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    near = -np.sort(-near, axis=1)[:, :6]
    odd = np.bitwise_count(w) & 1 == 1
    near[odd], near[odd, 0] = -1, own[odd]
    return near


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in fp, key) of all keys of fingerprints."""
    places, found = [], []
    quarter = [(fp >> U(16 * q) & U(0xFFFF)).astype(np.int64) for q in range(4)]
    for q in range(4):
        a, b, c = (quarter[i] for i in range(4) if i != q)
        for half, word in enumerate((a << 8 | b >> 8, (b & 0xFF) << 16 | c)):
            code = codewords(word)
            row, col = np.nonzero(code >= 0)
            places.append(row)
            found.append(((quarter[q][row] << 2 | q) << 1 | half) << 12 | code[row, col])
    return np.concatenate(places), np.concatenate(found)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp) -> key, open (bits that needn't be equal), fp."""
    for batch in batches:
        fp = batch.column(0).to_numpy().view(U)
        at, key = keys(fp)
        quarter = (key >> 13 & 3).astype(U)
        free = ~(U(0xFFFF) << (quarter * U(16)))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(free.view(np.int64)), pa.array(fp[at].view(np.int64))], names=["key", "open", "fp"])


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, open, fp) -> four rows each: a quarter of the open bits is equal from now on."""
    for batch in batches:
        key, free, fp = (batch.column(i).to_numpy().view(U) for i in range(3))
        rank = np.zeros((len(fp), 64), np.uint8)
        bits = (free[:, None] >> np.arange(64, dtype=U) & U(1)).astype(bool)
        rank[bits] = (np.cumsum(bits, axis=1) - 1)[bits] % 4
        for part in range(4):
            shut = ((bits & (rank == part)).astype(U) << np.arange(64, dtype=U)).sum(axis=1, dtype=U)
            new = mix(mix(key * U(5) + U(part + 1)) ^ fp & shut)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (new, free & ~shut, fp)], names=["key", "open", "fp"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp) in the order of key -> links that connect what is near within each key's rows; a group may span batches."""

    def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        at, a, b = np.arange(len(key)), [fp[:0]], [fp[:0]]
        for step in range(1, len(key)):
            at = at[: np.searchsorted(at, len(key) - step)]
            at = at[key[at] == key[at + step]]
            if not len(at):
                break
            near = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= RADIUS]
            a.append(fp[near])
            b.append(fp[near + step])
        nodes, least = roots(np.concatenate(a), np.concatenate(b))
        leaf = nodes != least
        return pa.RecordBatch.from_arrays([pa.array(x[leaf].view(np.int64)) for x in (least, nodes)], names=["a", "b"])

    key, fp = np.empty(0, np.int64), np.empty(0, U)
    for batch in batches:
        key, fp = np.append(key, batch.column(0).to_numpy()), np.append(fp, batch.column(1).to_numpy().view(U))
        end = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if end:
            yield links(key[:end], fp[:end])
            key, fp = key[end:], fp[end:]
    if len(key):
        yield links(key, fp)


def _joined(rows: DataFrame) -> DataFrame:
    """Links within the groups of (key, fp)."""
    parts = n_parts(rows.sparkSession)
    dealt = rows.select("key", "fp").repartition(parts, "key").sortWithinPartitions("key")
    return written(dealt.mapInArrow(_linked, "a bigint, b bigint"), "near")


def linked_components(distinct: DataFrame) -> DataFrame:
    """(node, label) for all distinct fingerprints `fp` that have one within RADIUS bits, one label for each component."""
    rows = written(distinct.select("fp").mapInArrow(_keyed, "key bigint, open bigint, fp bigint"), "keys")
    links = None
    add = lambda new: new if links is None else links.unionByName(new)
    while True:
        hot = rows.groupBy("key").agg(F.count("*").alias("held")).where(F.col("held") > GROUP)
        hot = written(hot, "hot-keys")
        links = add(_joined(rows.join(hot, "key", "left_anti")))
        if hot.isEmpty():
            return components(links)
        warm = written(rows.join(hot, "key"), "hot-rows")
        for deal in range(2):
            block = F.pmod(F.xxhash64("fp", F.lit(deal)), F.expr(f"1 + held div {GROUP // 2}"))
            links = add(_joined(warm.select(F.xxhash64("key", block).alias("key"), "fp")))
        labels = components(links).withColumnRenamed("node", "fp")
        named = written(warm.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp")), "named")
        mixed = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
        rest = named.join(mixed, "key", "left_semi").select("key", "open", "fp")
        rows = written(rest.mapInArrow(_refined, "key bigint, open bigint, fp bigint"), "refined")


def near_copies(docs: DataFrame, *, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id for every row.

    Words are lower-cased (A-Z); fewer than k are one shingle.  A text without
    words, or null, has the fingerprint zero and is linked like any other.
    component_id is the smallest doc_id reachable by links, itself included; a
    null doc_id names no component, and where a component has no other id,
    component_id is null.  Rows that share a doc_id are rows of their own.
    Other columns aren't read; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = small_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    rows = written(rows.mapInArrow(_fingerprinted(k), f"id {kind}, fp bigint"), "fingerprints")
    first = written(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    labels = linked_components(first).select(F.col("node").alias("fp"), "label")
    first = written(first.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp")), "labels")
    least = first.groupBy("label").agg(F.min("first").alias("component_id"))
    named = written(first.join(least, "label").select("fp", "component_id"), "names")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(named, "fp").select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")
