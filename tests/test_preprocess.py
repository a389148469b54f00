"""The preprocessing composite against plain loops."""

import re

from pyspark.sql import functions as F

from sievemill.functions.stem import porter
from sievemill.operators.preprocess import preprocess
from sievemill.operators.vectorize import stacked_rows


def test_words_stop_list_and_stems(spark):
    texts = ["The running dogs, and the HOUSES of relational men", "", None, "a the of", "The the running" * 50, "this houses of running"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").withColumn("other", F.lit(1))
    stop = ["the", "of", "this", "hous", "runs"]
    cut = lambda t: re.findall(r"\w{2,}", (t or "").lower())
    ways = {
        (True, False): lambda t: [x for x in map(porter, cut(t)) if x not in stop],
        (True, True): lambda t: [porter(x) for x in cut(t) if x not in stop],
        (False, False): lambda t: [x for x in cut(t) if x not in stop],
    }
    for (stem, first), want in ways.items():
        got = {r.id: r.t_tokens for r in preprocess(df, ["t"], stop=stop, stem=stem, stop_first=first).collect()}
        assert all(got[i] == want(t) for i, t in enumerate(texts))
    assert ways[True, False](texts[5]) == ["thi", "run"] and ways[True, True](texts[5]) == ["hous", "run"]
    assert preprocess(df.limit(0), ["t"]).collect() == []


def test_fields_below_each_other(spark):
    df = spark.createDataFrame([(1, ["a"], ["b", "c"]), (2, None, [])], "id long, q array<string>, p array<string>")
    assert sorted(((r.field, r.id, r.words) for r in stacked_rows(df, ["q", "p"]).collect()), key=str) == sorted([("q", 1, ["a"]), ("p", 1, ["b", "c"]), ("q", 2, None), ("p", 2, [])], key=str)
