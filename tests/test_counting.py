"""Counting features of whole rows against the expressions, and that they stay cheap on long texts."""

import math
import time

from pyspark.sql import functions as F

from sievemill.operators import counting

WORDS = "red shoes for men blue hat red_shoes 12 a_b b_c a c".split()
ROWS = [(i, [WORDS[(i * j) % 12] for j in range(i % 5)], [WORDS[(i + j * j) % 12] for j in range(i % 9)], [WORDS[(i * 5 + j * 7) % 11] for j in range(i % 13)]) for i in range(80)]
KINDS = "id long, query_tokens array<string>, title_tokens array<string>, description_tokens array<string>"


def test_equal_the_expressions(spark, monkeypatch):
    df = spark.createDataFrame([*ROWS, (80, ["a", "b_c"], ["a_b", "c"], ["a_b_c"])], KINDS).repartition(3)
    parts = counting.with_grams(df).withColumns(counting.basic_counts() | counting.intersect_counts())
    want = counting.position_stats(parts).withColumns(counting.distances())
    monkeypatch.setattr(counting, "SLICE", 30)
    got = counting.counting_features(df, sets=True)
    names = [c for c, k in want.dtypes if not k.startswith("array")]
    assert [c for c, k in got.dtypes if not k.startswith("array")] == names and len(names) == 281
    assert dict(got.select(names).dtypes) == dict(want.select(names).dtypes)
    both = zip(got.select(names).orderBy("id").collect(), want.select(names).orderBy("id").collect(), strict=True)
    for x, y in both:
        assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(x, y, strict=True)), (x.id, [n for n in names if not math.isclose(x[n], y[n], abs_tol=1e-9)])


def test_long_texts_are_linear(spark):
    began = time.perf_counter()
    n = 40_000
    words = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("w"), i.cast("string")))
    df = spark.range(4).select("id", words.alias("query_tokens"), words.alias("title_tokens"), words.alias("description_tokens"))
    got = counting.counting_features(df).select("count_of_title_trigram_in_description", "pos_of_title_unigram_in_query_max").distinct().collect()
    assert [tuple(r) for r in got] == [(n - 2, float(n))]
    assert time.perf_counter() - began < 60
