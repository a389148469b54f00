"""Expressions against worked examples and plain loops."""

import itertools
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemill.functions import arrays, ngrams, text
from sievemill.functions.stem import porter, stem_column
from sievemill.operators import counting


def one(spark, column, words):
    return spark.createDataFrame([(words,)], "w array<string>").select(column(F.col("w"))).first()[0]


@pytest.mark.parametrize("n", range(7))
def test_ngrams_and_terms(spark, n):
    w = ["I", "am", "Denny", "boy", "I", "x"][:n]
    runs = lambda k: ["_".join(w[i : i + k]) for i in range(n - k + 1)]
    assert one(spark, ngrams.bigrams, w) == (runs(2) if n > 1 else w)
    assert one(spark, ngrams.trigrams, w) == (runs(3) if n > 2 else runs(2) if n > 1 else w)
    assert one(spark, ngrams.fourgrams, w) == (runs(4) if n > 3 else runs(3) if n > 2 else runs(2) if n > 1 else w)
    pairs, triples = ["_".join(p) for p in itertools.combinations(w, 2)], ["_".join(p) for p in itertools.combinations(w, 3)]
    assert one(spark, ngrams.biterms, w) == (pairs if n > 1 else w)
    assert one(spark, ngrams.triterms, w) == (triples if n > 2 else pairs if n > 1 else w)
    skipped = [f"{w[i]}_{w[i + k]}" for i in range(n - 1) for k in (1, 2) if i + k < n]
    assert one(spark, lambda c: ngrams.bigrams(c, skip=1), w) == (skipped if n > 1 else w)
    triple = [f"{w[i]}_{w[i + a]}_{w[i + a + b]}" for i in range(n - 2) for a in (1, 2) for b in (1, 2) if i + a + b < n]
    assert one(spark, lambda c: ngrams.trigrams(c, skip=1), w) == (triple if n > 2 else skipped if n > 1 else w)


def test_cooccurrence(spark):
    df = spark.createDataFrame([(["sled", "rope"], ["a", "b"])], "a array<string>, b array<string>")
    assert df.select(ngrams.cooccurrences(F.col("a"), F.col("b"))).first()[0] == ["sledXa", "sledXb", "ropeXa", "ropeXb"]


def test_array_statistics(spark):
    r = random.Random(1)
    rows = [([r.choice("abcdef") for _ in range(r.randint(0, 6))], [r.choice("abcdef") for _ in range(r.randint(0, 6))]) for _ in range(60)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    a, b = F.col("a"), F.col("b")
    p = arrays.positions(a, b)
    got = df.select("a", "b", p.alias("p"), *[f(p).alias(n) for n, f in arrays.STATS.items()], arrays.jaccard(a, b).alias("j"), arrays.dice(a, b).alias("d"), arrays.intersect_count(a, b).alias("i")).collect()
    for x in got:
        places = [i for i, w in enumerate(x.b, 1) if w in x.a] or [0]
        assert x.p == places and (x["min"], x["max"]) == (min(places), max(places))
        assert math.isclose(x["mean"], statistics.fmean(places)) and x["median"] == statistics.median(places)
        assert math.isclose(x["std"], statistics.pstdev(places), abs_tol=1e-12)
        sa, sb = set(x.a), set(x.b)
        assert x.j == (len(sa & sb) / len(sa | sb) if sa | sb else 0)
        assert x.d == (2 * len(sa & sb) / (len(sa) + len(sb)) if sa or sb else 0)
        assert x.i == sum(w in sb for w in x.a) and math.isclose(x.d, 2 * x.j / (1 + x.j))


def test_vectors(spark):
    x, y = np.array([1.0, 2, -3]), np.array([0.5, 0, 2])
    df = spark.createDataFrame([(x.tolist(), y.tolist(), [0.0, 0.0, 0.0])], "x array<double>, y array<double>, z array<double>")
    got = df.select(arrays.cosine(F.col("x"), F.col("y")), arrays.cosine(F.col("x"), F.col("z")), arrays.euclidean(F.col("x"), F.col("y")), arrays.softmax(F.col("x"))).first()
    assert math.isclose(got[0], x @ y / np.linalg.norm(x) / np.linalg.norm(y)) and got[1] == 0 and math.isclose(got[2], np.linalg.norm(x - y))
    assert np.allclose(got[3], np.exp(x) / np.exp(x).sum())


def test_cleaning(spark):
    df = spark.createDataFrame([("<p>Sony PlayStation 4 16 GB</p>",), (None,), ("12-ounce K-Cups the 2 tb",)], "t string")
    got = [r[0] for r in df.select(text.clean_text(F.col("t"), html=True, synonyms={"the": "das"})).collect()]
    assert got == [" sony ps4 16gb ", "", "12 oz k cup das 2tb"]
    words = spark.createDataFrame([(["not", "good", "not", "x", "not"],), ([],)], "w array<string>")
    assert [r[0] for r in words.select(text.replace_negations(F.col("w"), {"good": "bad"})).collect()] == [["bad", "not", "x", "not"], []]
    tokens = spark.createDataFrame([("Été_1 a I'm ß 42 ok!",)], "t string").select(text.tokens(F.col("t"))).first()[0]
    assert tokens == ["été_1", "42", "ok"]


@pytest.mark.parametrize("word, stem", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("formalize", "formal"), ("hopefulness", "hope"), ("revival", "reviv"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control"), ("roll", "roll"), ("is", "is")])
def test_porter(word, stem):
    assert porter(word) == stem


def test_stems_are_joined_back(spark):
    df = spark.createDataFrame([(1, "cats"), (2, "cats"), (3, None)], "id long, w string")
    assert sorted(map(tuple, stem_column(df, "w").collect())) == [(1, "cat"), (2, "cat"), (3, None)]


def test_all_counting_features(spark):
    df = spark.createDataFrame([(["red", "sled"], ["a", "red", "sled", "7"], ["red"]), ([], [], [])], "query_tokens array<string>, title_tokens array<string>, description_tokens array<string>")
    out = counting.counting_features(df)
    made = [c for c in out.columns if c not in df.columns and out.schema[c].dataType.typeName() != "array"]
    assert len(made) == 262
    row = out.first()
    assert row.count_of_query_unigram_in_title == 2 and row.pos_of_query_unigram_in_title_mean == 1.5 and row.pos_of_title_unigram_in_query_min == 2.0
    assert out.collect()[1].description_missing == 1 and counting.transform_of("count_of_x") == "sqrt" and counting.transform_of("ratio") == "identity"
    assert len(counting.distances()) == 18


def test_feature_sets():
    from sievemill.plans.feature_sets import counting_names, feature_set, square_roots

    assert [len(feature_set(n)) for n in ("low_1", "low_2", "low_3", "high")] == [170, 177, 177, 184]
    assert square_roots("high") == 69 and len(counting_names()) == 142 and len(set(counting_names(("unigram", "bigram", "trigram")))) == 262
    with pytest.raises(ValueError):
        feature_set("other")
