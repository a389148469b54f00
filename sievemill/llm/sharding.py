"""Two-pass external shuffle into shards of equal row counts.

Pass 1 scatters the rows by a seeded hash of the whole row into buckets that fit
a worker's memory.  Buckets follow each other in the session's shuffle
partitions, whose counts, one number a partition, give each its place in the
global order.  Pass 2 takes a partition's buckets one at a time, permutes each
by Fisher-Yates and writes its rows into the folders of their shards; shard s
takes places floor(s * n / shards) up to the next shard's first, so row counts
differ by one at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import fresh, n_parts, small_batches

OWN = {"__bucket", "__part", "__row", "__shard", "__slot"}


def _row_hash(docs: DataFrame, seed: int) -> F.Column:
    """A hash of all columns; columns without an order or a hash (maps) count by their JSON text."""
    plain = (T.AtomicType, T.ArrayType, T.StructType)
    parts = [F.col(f"`{f.name}`") if isinstance(f.dataType, plain) and "map<" not in f.dataType.simpleString() else F.to_json(F.struct(F.col(f"`{f.name}`"))) for f in docs.schema.fields]
    return F.xxhash64(*[x for p in parts for x in (p, p.isNull())], F.lit(seed))


def _row_bytes(docs: DataFrame) -> F.Column:
    """About how many bytes a row takes."""
    total = F.lit(64)
    for f in docs.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(F.struct(c))
        total = total + F.coalesce(F.octet_length(c), F.lit(0)) if isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)) else total + 8
    return total.cast("long")


def scattered(docs: DataFrame, buckets: int, parts: int, seed: int) -> DataFrame:
    """`docs` with __row (its hash), __bucket and __part; buckets are dealt to partitions in order."""
    rows = docs.withColumn("__row", _row_hash(docs, seed)).withColumn("__bucket", F.pmod("__row", F.lit(buckets)))
    return rows.withColumn("__part", F.expr(f"cast(__bucket * {parts} div {buckets} as int)"))


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A uniform permutation of 0..n-1, the same for the same seed and bucket."""
    order = np.arange(n)
    np.random.default_rng([seed & 0xFFFFFFFF, bucket]).shuffle(order)
    return order


def shuffle_to_shards(docs: DataFrame, shards: int = 40, *, seed: int = 20, bucket_bytes: int = 32 << 20, path: str | None = None) -> str:
    """Write all rows of `docs`, in shuffled order, under `path` (default: the shared folder) and return it.

    A folder __shard=s holds a shard: the columns of `docs` and __slot, gapless
    from 0 in each shard, by which its files follow each other.  Null ids, null
    texts and repeated rows are rows like any other.  Rows with one id are
    scattered by their other columns; rows that are equal in all columns share
    a bucket, which is permuted in pieces of four times `bucket_bytes` if they
    are very many.  A row must fit a worker's memory.  Columns of `docs` named
    as in OWN are an error; an empty table writes none.
    """
    spark, path = docs.sparkSession, path or fresh(docs.sparkSession, "shards")
    taken = OWN & set(docs.columns)
    if taken:
        raise ValueError(f"column names in use: {sorted(taken)}")
    weighed = small_batches(docs).agg(F.sum(_row_bytes(docs))).first()[0] or 0
    parts = n_parts(spark)
    buckets = max(parts, -(-weighed // bucket_bytes))
    counts = dict(scattered(docs, buckets, parts, seed).groupBy("__part").count().collect())  # one number a partition
    each = np.array([counts.get(p, 0) for p in range(parts)], np.int64)
    base, n = np.concatenate([[0], np.cumsum(each)]), int(each.sum())
    first = np.array([-(-s * n // shards) for s in range(shards + 1)], np.int64)
    names = docs.columns

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        place, size = -1, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal place, size
            rows = pa.Table.from_batches(held)
            bucket = rows.column("__bucket")[0].as_py()
            rows = rows.take(pc.sort_indices(rows, [("__row", "ascending")]))
            rows = rows.take(pa.array(fisher_yates(rows.num_rows, seed, bucket)))
            places = place + np.arange(rows.num_rows)
            shard = np.searchsorted(first, places, "right") - 1
            rows = rows.select(names).append_column("__slot", pa.array(places - first[shard], pa.int64())).append_column("__shard", pa.array(shard, pa.int32()))
            place, size = place + rows.num_rows, 0
            held.clear()
            yield from rows.to_batches(max_chunksize=2000)

        for batch in batches:
            ids = batch.column("__bucket").to_numpy()
            if place < 0 and len(ids):
                place = int(base[batch.column("__part")[0].as_py()])
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)] if len(ids) else []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if held and (held[0].column("__bucket")[0].as_py() != ids[lo] or size > 4 * bucket_bytes):
                    yield from flush()
                held.append(batch.slice(lo, hi - lo))
                size += held[-1].nbytes
        if held:
            yield from flush()

    rows = scattered(docs, buckets, parts, seed).repartitionById(parts, F.col("__part")).sortWithinPartitions("__bucket", "__row")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = rows.mapInArrow(permute, f"{schema}, __slot bigint, __shard int")
    out.write.option("compression", "zstd").partitionBy("__shard").parquet(path)
    return path


def read_shards(docs: DataFrame, path: str) -> DataFrame:
    """The written rows with __slot and __shard; `docs` are those that were written, for their columns."""
    return docs.sparkSession.read.schema(T.StructType([*docs.schema.fields, T.StructField("__slot", T.LongType()), T.StructField("__shard", T.IntegerType())])).parquet(path)


def shard_digest(docs: DataFrame, shards: int = 40, **options) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of the rows in the written shards."""
    docs = docs.select("doc_id", "text")
    rows = read_shards(docs, shuffle_to_shards(docs, shards, **options))
    text = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), F.col("__shard").alias("shard"), F.col("__slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
