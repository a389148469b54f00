"""The operators as filtering stages: documents in, documents out, all columns kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .jaccard_join import jaccard_components
from .mixing import mix, word_count
from .sharding import OWN, read_shards, shuffle_to_shards
from .storage import free


def one_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """The document with the smallest doc_id of each component of near copies.

    Of rows with one doc_id the first by text stays; rows without an id can't
    be told apart and all stay, as do texts without words.  Other columns may
    have any names; an empty table stays empty.
    """
    named = docs.where("doc_id is not null")
    groups = jaccard_components(named, **options)
    first = groups.where("doc_id = component_id").select("doc_id")
    out = named.join(first, "doc_id", "left_semi")
    (turn,) = free(docs.columns, "__turn")
    order = W.partitionBy("doc_id").orderBy("text")
    out = out.withColumn(turn, F.row_number().over(order)).where(F.col(turn) == 1)
    return out.select(docs.columns).unionByName(docs.where("doc_id is null"))


def mixed(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Each document as often as the mix takes it: complete epochs, and once more if it is sampled.

    A document without words adds nothing to a budget and isn't taken; rows
    that share doc_id, source and size share what is taken of them.  A null
    source is a source, the last; other columns may have any names; an empty
    table stays empty.
    """
    quality = labels.groupBy("doc_id").agg(F.max("quality").alias("label"))
    weight = F.when(F.col("label") == 1, 2.0).when(F.col("label") == 0, 0.5).otherwise(1.0)
    sized = docs.select("doc_id", "source", word_count("text").alias("size"))
    taken = mix(sized.join(quality, "doc_id", "left").withColumn("quality", weight), **options).where("taken > 0")
    doc, source, size, copies, held, own, turn = free(docs.columns, "__id", "__source", "__size", "__copies", "__held", "__own", "__turn")
    taken = taken.groupBy("doc_id", "source", "size").agg(F.sum(F.expr("taken div size")).alias(copies), F.count("*").alias(held))
    taken = taken.select(F.col("doc_id").alias(doc), F.col("source").alias(source), F.col("size").alias(size), copies, held)
    rows = docs.withColumn(own, word_count("text"))
    rows = rows.join(taken, F.col("doc_id").eqNullSafe(F.col(doc)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(own) == F.col(size)))
    extra = F.pmod(F.xxhash64("text"), F.col(held)) < F.col(copies) % F.col(held)
    times = F.expr(f"{copies} div {held}") + extra.cast("long")
    return rows.withColumn(turn, F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select(docs.columns)


def sharded(docs: DataFrame, shards: int = 40, **options) -> DataFrame:
    """All rows with shard and slot, read from the written shards.

    A column of `docs` that has one of these names, or one of the shuffle's own,
    gets underscores behind its name until it is a free one.  Nulls, repeated
    rows and empty tables count as `shuffle_to_shards` says.
    """
    used = [*OWN, "shard", "slot"]
    clash = [c for c in docs.columns if c.lower() in used]
    docs = docs.withColumnsRenamed(dict(zip(clash, free([*docs.columns, *used], *clash), strict=True)))
    rows = read_shards(docs, shuffle_to_shards(docs, shards, **options))
    return rows.withColumnsRenamed({"__shard": "shard", "__slot": "slot"})
