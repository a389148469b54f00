"""The four feature sets as ordered (feature, transform) lists, built by rule."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ngrams import GRAMS
from ..functions.text import tokens
from ..operators.counting import FIELDS, transform_of
from ..sources.formats import feature_manifest

STATS = ("min", "mean", "median", "max", "std")
PAIRS = [(a, b) for i, a in enumerate(FIELDS) for b in FIELDS[i + 1 :]]


def counting_names(position_grams: tuple[str, ...] = ("unigram",)) -> list[str]:
    """Counting features; of the position statistics only those of `position_grams`: 142 by default, 262 with all."""
    out = [f"{kind}_{f}_{g}" for f in FIELDS for g in GRAMS for kind in ("count_of", "count_of_unique", "ratio_of_unique")]
    out += [f"{kind}_of_digit_in_{f}" for f in FIELDS for kind in ("count", "ratio")]
    out.append(f"{FIELDS[-1]}_missing")
    for g in GRAMS:
        out += [f"{kind}_of_{a}_{g}_in_{b}" for a, b in permutations(FIELDS, 2) for kind in ("count", "ratio")]
        out += [f"{o}_{g}_in_query_div_query_{g}{tail}" for o in FIELDS[1:] for tail in ("", f"_in_{o}")]
    out += [f"{norm}pos_of_{o}_{g}_in_{t}_{s}" for g in position_grams for t, o in permutations(FIELDS, 2) for norm in ("", "normalized_") for s in STATS]
    return out


def distance_names() -> list[str]:
    """Set similarities of each pair of fields."""
    return [f"{m}_of_{g}_between_{a}_{b}" for m in ("jaccard_coef", "dice_dist") for g in GRAMS for a, b in PAIRS]


def _vector_names(kind: str, pooled: str = "") -> list[str]:
    cosines = [f"{a}_{b}_{kind}{pooled}_cosine_sim" for a, b in PAIRS]
    return cosines + [f"{f}_{kind}{pooled}_cosine_sim_stats_by_{by}" for f in FIELDS[1:] for by in ("relevance", "query_relevance")]


def feature_set(name: str) -> list[str]:
    """Features of low_1, low_2, low_3 or high, in order."""
    shared = counting_names() + distance_names()
    if name == "low_1":
        return [*shared, *[f"{f}_tfidf_individual_svd100" for f in FIELDS], *_vector_names("tfidf")]
    if name == "low_2":
        stats = [f"{f}_tfidf_individual_svd150_cosine_sim_stats_by_{by}" for f in FIELDS[1:] for by in ("relevance", "query_relevance")]
        return [*shared, *[f"{f}_tfidf_individual_svd150" for f in FIELDS], *stats, *[f"{a}_{b}_tfidf_common_svd150_cosine_sim" for a, b in PAIRS], *_vector_names("tfidf")]
    if name == "low_3":
        return [*shared, *[f"{f}_tfidf_individual_svd100" for f in FIELDS], *_vector_names("tfidf"), *_vector_names("bow")]
    if name == "high":
        pairs = [f"{q}_{t}_{g}_cooccurrence_tfidf" for q, grams in (("query_unigram", ("unigram",)), ("query_bigram", ("unigram",)), ("query_id", ("unigram",))) for t in FIELDS[1:] for g in grams]
        return [*shared, *[f"{f}_tfidf" for f in FIELDS], *_vector_names("tfidf"), *_vector_names("bow"), *pairs, "qid"]
    raise ValueError(f"no feature set {name}")


def manifest(spark: SparkSession, name: str) -> DataFrame:
    """place, feature, transform of a set."""
    return feature_manifest(spark, feature_set(name))


def square_roots(name: str) -> int:
    """How many features of the set are taken as square roots."""
    return sum(transform_of(f) == "sqrt" for f in feature_set(name))


def feature_matrix(samples: DataFrame, name: str) -> tuple[DataFrame, int]:
    """(id, label, features) of a whole set for samples (id, query, title, description, relevance), and its width."""
    from ..operators.feature_table import Table

    rows = samples.select("id", F.col("query").alias("qid"), "relevance", *[tokens(F.col(f)).alias(f"{f}_tokens") for f in FIELDS])
    return Table(rows).matrix(feature_set(name))
