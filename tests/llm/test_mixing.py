import math
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from sievemill.llm.mixing import mix, source_targets, word_count
from sievemill.llm.stages import mixed


def water(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        got = {s: left * w[s] / sum(w[t] for t in free) for s in free}
        over = {s for s in free if got[s] > cap * sizes[s] + 1e-9}
        if not over:
            return got | {s: cap * sizes[s] for s in full}
        full |= over


def test_targets_and_taken(spark):
    r = np.random.default_rng(2)
    rows = [(i, "hot" if i % 3 == 0 else [None, "ä", "b", "Z", "c"][int(r.integers(5))], int(r.integers(0, 60)), float(r.choice([0.5, 1, 2]))) for i in range(3000)]
    rows += [(None, "b", 10, None), (7, "b", 5, -1.0), (7, "b", 5, -1.0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, quality double").withColumn("bin", F.lit("clash")).withColumn("k", F.lit(0))
    got = mix(df, bins=16).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mix(df.repartition(5), bins=64).collect()))
    sizes = defaultdict(int)
    for _, s, n, _ in rows:
        sizes[s] += n
    want, source = water(sizes), {(i, n): s for i, s, n, _ in rows}
    taken = defaultdict(int)
    for x in got:
        s = source[x.doc_id, x["size"]]
        assert x.source_size == sizes[s] and math.isclose(x.target, want[s]) and x.taken <= 2 * x["size"]
        assert x.taken % max(x["size"], 1) == 0
        assert x["size"] == 0 or x.taken // x["size"] in (int(x.target // x.source_size), int(x.target // x.source_size) + 1)
        taken[s] += x.taken
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes)


def test_quality_raises_the_chance(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(1).cast("long").alias("size"), F.when(F.col("id") % 2 == 0, 4.0).otherwise(1.0).alias("quality"))
    got = mix(df, share=0.3).groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum("taken").alias("n")).collect()
    n = {r.odd: r.n for r in got}
    assert n[0] + n[1] == 1200 and n[0] > 2 * n[1]


def test_empty_and_wordless(spark):
    df = spark.createDataFrame([(1, "a", 0, 1.0)], "doc_id long, source string, size long, quality double")
    assert [r.taken for r in mix(df).collect()] == [0]
    assert mix(df.limit(0)).collect() == []
    assert source_targets(df.limit(0)).collect() == []
    texts = spark.createDataFrame([(None,), ("",), (" \t",), ("a",), ("a\x0bb\x1c\xa0c  d\n",)], "t string")
    assert [r[0] for r in texts.select(word_count("t")).collect()] == [0, 0, 0, 1, 3]


def test_stage_repeats_rows(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("w w w"), "id").alias("text"), F.when(F.col("id") % 3 == 0, "x").otherwise(F.concat(F.lit("s"), F.col("id") % 2)).alias("source"), F.lit(1).alias("taken"))
    docs = docs.union(docs.limit(2))
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = mixed(docs, labels)
    assert got.columns == docs.columns
    words = got.groupBy("source").agg(F.sum(word_count("text")).alias("n"))
    n = {r.source: r.n for r in words.collect()}
    want = water({r.source: r.n for r in docs.groupBy("source").agg(F.sum(word_count("text")).alias("n")).collect()})
    assert all(abs(n[s] - want[s]) <= 8 for s in want)
    assert mixed(docs.limit(0), labels).collect() == []
