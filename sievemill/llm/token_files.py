"""Token ids in Parquet: list columns with chosen encodings, row groups and page indexes.

Texts are range-partitioned by doc_id before they are encoded, so the token ids
never cross the network: each task encodes its range and writes one file.  Ids
are written dictionary- or delta-encoded in small pages with a page index, so
that a reader can take some columns of some doc_ids and leave the rest.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import fresh, n_parts, small_batches, written
from .words import LOWER, buffers, slices

#: Token ids of chunks that a worker keeps (4 bytes each); when full it starts anew, and results are the same.
REMEMBERED = 3_000_000
_BYTES = np.arange(256)
_BLANK = np.isin(_BYTES, [0x20, 0x0A])
_LETTER = ((_BYTES | 0x20) >= 0x61) & ((_BYTES | 0x20) <= 0x7A)
#: Second bytes of the letters from U+00C0 to U+00FF, whose first is C3.
_SECOND = (_BYTES >= 0x80) & (_BYTES <= 0xBF) & (_BYTES != 0x97) & (_BYTES != 0xB7)
_SIGNS = [i for i in range(0x21, 0x7F) if not chr(i).isalnum() and i != 0x27]


class ChunkEncoder:
    """Token ids of texts as little-endian 32-bit integers, by the library on distinct chunks.

    A text is cut before each space or line feed, and between a Latin-1 letter and
    an ASCII sign other than ``'`` and those that follow a letter in a special
    token: the tokenizer drops white space, and its words end there, so the ids
    of a text are those of its chunks in order.  ASCII chunks that can't begin a
    special token are taken in lower case, as the tokenizer does anyway.  Arrow finds the distinct chunks of
    a batch, the library encodes those that the worker hasn't met, and the ids
    are gathered by numpy.  `whole` turns the chunks off for tokenizers where
    white space makes tokens.
    """

    def __init__(self, path: str, whole: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.whole = whole
        self.folds = isinstance(self.library.normalizer, normalizers.Sequence) and any(isinstance(n, normalizers.Lowercase) for n in self.library.normalizer)
        #: The same model for words of Latin-1 letters in lower case, which need no normalizing and no splitting but at spaces.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        for token, i in self.library.get_vocab().items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)
        special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.begins = np.isin(_BYTES, [t[0] for t in special]) | (_BYTES >= 0x80)
        self.folds &= not any(t[:1].isalpha() for t in special)
        self.stops = np.isin(_BYTES, sorted(set(_SIGNS) - {b for t in special for a, b in zip(t, t[1:]) if _LETTER[a]}))
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.arena, self.used = np.zeros(1 << 20, "<u4"), 0

    def _add(self, chunks: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.places)
        while len(self.start) < n + len(chunks):
            self.start, self.size = np.append(self.start, np.zeros_like(self.start)), np.append(self.size, np.zeros_like(self.size))
        while len(self.arena) < self.used + len(ids):
            self.arena = np.append(self.arena, np.zeros_like(self.arena))
        self.arena[self.used : self.used + len(ids)] = ids
        self.start[n : n + len(chunks)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(chunks)] = sizes
        self.used += len(ids)
        self.places.update(zip(chunks, range(n, n + len(chunks)), strict=True))

    def _call(self, chunks: list[str]) -> None:
        for i in range(0, len(chunks), 10_000):
            part = chunks[i : i + 10_000]
            found = [e.ids for e in self.library.encode_batch_fast(part, add_special_tokens=False)]
            sizes = np.array([len(x) for x in found], np.int64)
            self._add(part, np.fromiter((t for x in found for t in x), "<u4", int(sizes.sum())), sizes)

    def learn(self, chunks: list[str]) -> None:
        """Encode new chunks: words of Latin-1 letters many at a time, which tokens that end a word part again."""
        bare = [c.lstrip(" ").lower() for c in chunks]
        easy = [self.folds and w.isalpha() and max(w) < "Ā" and "İ" not in c for c, w in zip(chunks, bare, strict=True)] if self.ends.any() else [False] * len(chunks)
        words = [(c, w) for c, w, e in zip(chunks, bare, easy, strict=True) if e]
        hard = [c for c, e in zip(chunks, easy, strict=True) if not e]
        for i in range(0, len(words), 2000):
            group = words[i : i + 2000]
            ids = np.array(self.plain.encode(" ".join([w for _, w in group]), add_special_tokens=False).ids, "<u4")
            cuts = np.append(0, np.flatnonzero(self.ends[ids]) + 1)
            if len(cuts) == len(group) + 1 and cuts[-1] == len(ids):
                self._add([c for c, _ in group], ids, np.diff(cuts))
            else:
                hard += [c for c, _ in group]
        self._call(hard)

    def _cut(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, chunk offsets) of texts at offsets `at`; every text's first and last offset is among them."""
        bounds = np.zeros(len(data) + 1, bool)
        bounds[:-1] = _BLANK[data]
        letter = _LETTER[data]
        letter[1:] |= (data[:-1] == 0xC3) & _SECOND[data[1:]]
        bounds[1:-1] |= letter[:-1] & self.stops[data[1:]]
        bounds[at] = True
        cuts = np.flatnonzero(bounds)
        if self.folds and len(cuts) > 1:
            odd = np.append(0, np.cumsum(self.begins[data]))
            keep = odd[cuts[1:]] > odd[cuts[:-1]]
            data = np.where(np.repeat(keep, np.diff(cuts)), data, LOWER[data])
        return np.where(data == 0x0A, np.uint8(0x20), data), cuts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each text has)."""
        if self.whole:
            found = [e.ids for e in self.library.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            sizes = np.array([len(x) for x in found], np.int64)
            return np.fromiter((t for x in found for t in x), "<u4", int(sizes.sum())), sizes
        data, at = buffers(texts)
        data, at = data[at[0] : at[-1]], at - at[0]
        if not len(data):
            return np.empty(0, "<u4"), np.zeros(len(at) - 1, np.int64)
        data, cuts = self._cut(data, at)
        chunks = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if self.used > REMEMBERED:
            self._forget()
        new = [c for c in distinct if c not in self.places]
        if new:
            self.learn(new)
        place = np.fromiter(map(self.places.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        size, start = self.size[place], self.start[place]
        upto = np.cumsum(size)
        ids = self.arena[np.repeat(start - upto + size, size) + np.arange(int(upto[-1]))]
        total = np.append(0, upto)[np.searchsorted(cuts, at)]
        return ids, np.diff(total)


_LOADED: dict[tuple[str, bool], ChunkEncoder] = {}


def loaded(path: str, whole: bool) -> ChunkEncoder:
    """This worker's encoder for the tokenizer; tasks that follow find its chunks again."""
    if (path, whole) not in _LOADED:
        _LOADED[path, whole] = ChunkEncoder(path, whole)
    return _LOADED[path, whole]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, *, id_col: str = "doc_id", text_col: str = "text", meta: list[str] = (), files: int | None = None, whole_texts: bool = False, encoding: str = "delta", row_group_bytes: int = 32 << 20, page_bytes: int = 128 << 10) -> None:
    """Encode every text and write (id, metadata, n_tokens, ids) in ascending id order, one range of ids a file.

    encoding: "dictionary" or "delta" (DELTA_BINARY_PACKED) for ids and n_tokens.
    A null text counts as empty, null ids come first, rows with equal ids follow
    each other by their texts' checksums, over several files if there are many,
    and an empty table writes no rows.  Other columns, of whatever names, are
    not read.  A text of any length is encoded whole, in the memory of one task.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding: {encoding}")
    spark = docs.sparkSession
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(c).alias(f"meta_{c}") for c in meta], F.col(text_col).alias("text"))
    rows = rows.withColumn("__crc", F.crc32(F.coalesce("text", F.lit(""))))
    rows = rows.repartitionByRange(files or n_parts(spark), "doc_id", "__crc").sortWithinPartitions("doc_id", "__crc", "text").drop("__crc")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(tokenizer, whole_texts)
        for batch in batches:
            _, places = buffers(batch.column("text"))
            for lo, hi in slices(places):
                part = batch.slice(lo, hi - lo)
                ids, sizes = encoder.encode(part.column("text"))
                if end_id is not None:
                    ids, sizes = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
                at = np.append(0, np.cumsum(sizes)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(ids.view("<i4")))
                kept = [part.column(i) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(sizes), lists], names=[*part.schema.names[:-1], "n_tokens", "ids"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    options = {"parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": 2000, "parquet.columnindex.truncate.length": 32, "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": str(encoding == "dictionary").lower(), "compression": "zstd"}
    out = rows.mapInArrow(encode, f"{kept}, n_tokens bigint, ids array<int>")
    out.write.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def read_token_files(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The written rows; `columns` and filters on doc_id reach the scan and its page index."""
    found = spark.read.parquet(path)
    return found.select(*columns) if columns else found


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        at, raw = ids.offsets.to_numpy(), memoryview(ids.values.to_numpy().astype("<u4", copy=False)).cast("B")
        sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64()), batch.column("file"), batch.column("place")], names=["doc_id", "n_tokens", "ids_crc32", "file", "place"])


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the files' rows, read back.

    Files hold disjoint ranges of (id, text checksum) in the order of their
    numbers, so a row's start is its file's start (one row a file is summed in
    order) and the running sum within its file.
    """
    names = spark.read.parquet(path).select("doc_id", "ids", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("place"))
    rows = names.mapInArrow(_crc, "doc_id bigint, n_tokens bigint, ids_crc32 bigint, file string, place bigint")
    return _with_starts(rows)


def _with_starts(rows: DataFrame) -> DataFrame:
    rows = written(rows, "token-digest")
    files = file_bases(rows.groupBy("file").agg(F.sum("n_tokens").alias("all")))
    within = W.partitionBy("file").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return rows.join(files, "file").select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def file_bases(files: DataFrame) -> DataFrame:
    """(file, base) of rows (file, all), one a file: the sum of `all` over the files before it, by the numbers in their names."""
    number = lambda r: F.coalesce(F.regexp_extract("file", r, 1).try_cast("long"), F.lit(0))
    order = W.orderBy(number(r"part-(\d+)"), number(r"-c(\d+)\."), "file").rowsBetween(W.unboundedPreceding, -1)
    return files.select("file", F.coalesce(F.sum("all").over(order), F.lit(0)).alias("base"))


def encoded_digest(docs: DataFrame, tokenizer: str, end_id: int | None, **options) -> DataFrame:
    """Write the token files in the shared folder and return their digest."""
    path = fresh(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer, end_id, **options)
    return token_digest(docs.sparkSession, path)
