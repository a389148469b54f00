"""The fixed query of each operator, over its whole tables, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as archives with revisits, read back."""
    from .warc import round_trip

    return round_trip(_read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _base32(sha1: str) -> str:
    """DuckDB SQL: base 32 of 40 hexadecimal digits, five digits making four signs."""
    signs = []
    for i in range(8):
        number = f"CAST('0x' || substr({sha1}, {5 * i + 1}, 5) AS BIGINT)"
        signs += [f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (({number} >> {s}) & 31) AS BIGINT), 1)" for s in (15, 10, 5, 0)]
    return " || ".join(signs)


OP1_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, {_base32("h")} AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM f
"""


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under a Jaccard similarity of 0.8 of their 5-word shingles."""
    from .jaccard_join import jaccard_components

    return jaccard_components(_read(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words in all documents."""
    from .decontaminate import contamination

    return contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written delta-encoded in doc_id order and read back."""
    from .token_files import encoded_digest

    return encoded_digest(_read(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), 2)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of all documents under a model of the trusted ones, and whether each is kept."""
    from .quality import classify

    return classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the sources' targets; labelled quality weighs 2 (good) or 0.5 (bad), none 1."""
    from .mixing import mix, word_count

    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", word_count("text").alias("size"))
    labels = _read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("label"))
    quality = F.when(F.col("label") == 1, 2.0).when(F.col("label") == 0, 0.5).otherwise(1.0)
    return mix(docs.join(labels, "doc_id", "left").withColumn("quality", quality))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a PNG, written, read back with all checks and described."""
    from .media import media_column, media_features
    from .storage import written

    media = written(media_column(_read(spark, sf_dir, "documents")), "media", compression="none")
    return media_features(media).withColumn("feature", F.lower(F.hex("phash"))).drop("phash")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents shuffled into 40 shards and read back."""
    from .sharding import shard_digest

    return shard_digest(_read(spark, sf_dir, "documents"), 40)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the compiled transducer."""
    from .token_counts import count_tokens

    return count_tokens(_read(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of all documents, filed as source/lang/doc_id; a null part is the sign U+0000."""
    from .licenses import licenses

    docs = _read(spark, sf_dir, "documents")
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    path = F.concat_ws("/", part("source"), part("lang"), part("doc_id"))
    return licenses(docs.select(path.alias("path"), "text", "doc_id"), keep=("doc_id",))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of all embeddings."""
    from .whitening import whiten

    return whiten(_read(spark, sf_dir, "embeddings"), 16)


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their components within three bits."""
    from .simhash import near_copies

    return near_copies(_read(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents, some with planted ones, and digests of the runs and of what is left without them."""
    from .periodic import periodic_runs, planted

    found = periodic_runs(planted(_read(spark, sf_dir, "documents").select("doc_id", "text")))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "strongest.start",
        "strongest.length",
        "strongest.period",
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_decontamination": op3_decontamination,
    "op4_token_files": op4_token_files,
    "op5_quality": op5_quality,
    "op6_mixing": op6_mixing,
    "op7_media": op7_media,
    "op8_sharding": op8_sharding,
    "op9_token_counts": op9_token_counts,
    "op10_licenses": op10_licenses,
    "op11_whitening": op11_whitening,
    "op12_simhash": op12_simhash,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {"op1_warc": OP1_SQL}
