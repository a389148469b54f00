"""Grams of an expression cost what grams of a column cost."""

import time

from pyspark.sql import functions as F

from sievemill.functions import ngrams, text


def test_words_are_computed_once_a_row(spark):
    n = 4000
    df = spark.range(2).select(F.concat(F.lit("ab "), F.repeat(F.lit("cd ef "), n // 2)).alias("t"))
    began = time.perf_counter()
    w = text.tokens(F.col("t"))
    got = df.select(F.size(ngrams.trigrams(w)), F.element_at(ngrams.bigrams(w), 1), F.size(ngrams.cooccurrences(F.slice(w, 1, 300), ngrams.bigrams(w))), F.size(ngrams.fourgrams(w))).distinct().collect()
    assert [tuple(r) for r in got] == [(n - 1, "ab_cd", 300 * n, n - 2)]
    assert time.perf_counter() - began < 30


def test_short_lists(spark):
    row = spark.createDataFrame([(["a"], [], None)], "a array<string>, b array<string>, c array<string>")
    got = row.select(ngrams.trigrams(F.col("a")), ngrams.bigrams(F.col("b")), ngrams.cooccurrences(F.col("a"), F.col("b")), ngrams.bigrams(F.col("c")), ngrams.cooccurrences(F.col("a"), F.col("c"))).first()
    assert tuple(got) == (["a"], [], [], None, None)


def test_negations_of_long_texts(spark):
    n = 60_000
    words = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.when(i % 3 == 0, "not").when(i % 3 == 1, "good").otherwise("x"))
    began = time.perf_counter()
    got = spark.range(1).select(text.replace_negations(words, {"good": "bad"}).alias("w")).first().w
    assert got[:4] == ["good", "x", "bad", "x"] and len(got) == n - (n // 3 - 1) and got[-1] == "not"
    assert time.perf_counter() - began < 20
    rows = spark.createDataFrame([(["not", "not", "good", None, "not", None, "good", "not"],), ([],), (None,)], "w array<string>")
    plain = [r[0] for r in rows.select(text.replace_negations(F.col("w"), {"good": "bad"})).collect()]
    assert plain == [["not", "bad", None, "not", None, "good", "not"], [], None]
    chained = rows.limit(1).select(text.replace_negations(F.array(F.lit("not"), F.lit("not"), F.lit("good")), {"not": "so", "good": "bad"})).first()[0]
    assert chained == ["so", "good"]


def test_cooccurrence_text(spark):
    """The joined pairs, without a string for each: 4 million pairs of two rows in little time."""
    rows = spark.createDataFrame([(["a", "b"], ["x", "y_z", "x"]), ([], ["x"]), (["a"], []), ([], []), (None, ["x"]), (["a"], None), (["a", None, "b"], ["x", None]), (["a"], [None])], "a array<string>, b array<string>")
    for join, between in (("X", " "), ("", ""), ("-", ", ")):
        got = rows.select(F.array_join(ngrams.cooccurrences(F.col("a"), F.col("b"), join), between).alias("plain"), ngrams.cooccurrence_text(F.col("a"), F.col("b"), join, between).alias("text")).collect()
        assert [r.plain for r in got] == [r.text for r in got]
    words = F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: F.concat(F.lit("w"), i))
    made = ngrams.cooccurrence_text(words, words)
    got = spark.range(2).select(F.length(made).alias("n")).collect()
    plain = [f"w{i}" for i in range(1, 2001)]
    n = sum(map(len, plain)) * 2 * len(plain) + 2 * len(plain) ** 2 - 1
    assert [r.n for r in got] == [n, n]
