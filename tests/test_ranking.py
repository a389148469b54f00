"""Ranks, running sums, numbered lines and pairwise fits, in many ranges, files and blocks, against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemill.operators import decode, folds, learners, metrics, ranking
from sievemill.sources import formats


@pytest.fixture(params=[1_000_000, 20])
def ranges(request, monkeypatch):
    monkeypatch.setattr(ranking, "ROWS", request.param)
    return request.param


def test_ranks_and_sums(spark, ranges):
    r = random.Random(1)
    rows = [(i, r.choice([None, 1.5, 1.5, r.random(), float("-inf")]), r.choice(["a", "b", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, p double, k string").repartition(5)
    for keys in ((), ("k",)):
        got = {x.id: x for x in ranking.running_sums(df, ["p", "id"], {"n": F.lit(1), "s": F.col("id")}, keys).collect()}
        for group in ([None] if not keys else ["a", "b", None]):
            own = sorted((x for x in rows if not keys or x[2] == group), key=lambda x: (x[1] is not None, x[1] or 0, x[0]))
            total = 0
            for place, x in enumerate(own, 1):
                total += x[0]
                assert (got[x[0]].n, got[x[0]].s) == (place, total)
    assert ranking.ranked(df.limit(0), ["p"], "rank").collect() == []


def test_folds_dictionary_and_break_even(spark, ranges):
    docs = spark.range(103).select((F.col("id") * 7).alias("id"), F.concat(F.lit("w"), F.col("id") % 41).alias("w")).repartition(3)
    got = [x.fold for x in folds.contiguous_folds(docs, "id", 7).orderBy("id").collect()]
    assert got == [k + 1 for k, part in enumerate(np.array_split(np.arange(103), 7)) for _ in part]
    words = sorted({f"w{i}" for i in range(41)})
    assert {x.w: x.qid for x in folds.dictionary(docs, "w").collect()} == {w: i + 1 for i, w in enumerate(words)}
    assert sorted(x.fold for x in folds.contiguous_folds(docs.limit(2), "id", 7).collect()) == [1, 2]
    r = random.Random(3)
    rows = [(float(r.randint(0, 60)), r.choice([1.0, -1.0])) for _ in range(200)]
    best = metrics.break_even(spark.createDataFrame(rows, "p double, y double"), "p", "y").first()
    t = sum(y > 0 for _, y in rows)
    cuts = [(sum(y > 0 for p, y in rows if p >= c), sum(p >= c for p, _ in rows)) for c in {p for p, _ in rows}]
    assert math.isclose(best.best_f1, max(2 * tp / (k + t) for tp, k in cuts)) and math.isclose(best.best_accuracy, max((tp + len(rows) - t - (k - tp)) / len(rows) for tp, k in cuts))


def test_cutoffs_by_key(spark, ranges):
    rows = [(i, float((i * 37) % 101), "ab"[i % 2]) for i in range(90)]
    got = {(x.g, x.k): x.cutoff for x in decode.cutoffs(spark.createDataFrame(rows, "id long, prediction double, g string"), [0.0, 0.3, 0.9], keys=("g",)).collect()}
    for g in "ab":
        own = sorted(p for _, p, x in rows if x == g)
        assert [got[g, k] for k in (1, 2, 3)] == [own[int(len(own) * c - 1)] for c in (0.0, 0.3, 0.9)]


def test_lines_keep_their_order_over_files_of_any_size(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        folder = tmp_path / "v"
        folder.mkdir()
        at = 0
        for part, n in enumerate([5, 2000, 1, 0, 700, 40]):
            (folder / f"part-{part:05d}-x.txt").write_text("".join(f"{float(at + i)}\n" for i in range(n)))
            at += n
        got = formats.read_vector(spark, str(folder)).collect()
        assert len(got) == at and [r for r in got if r["index"] != int(r.value)][:5] == []
        df = spark.range(3000).select("id", F.col("id").cast("double").alias("x"))
        formats.write_vector(df.repartition(6), "x", str(tmp_path / "w"), "id")
        assert all(r["index"] == int(r.value) for r in formats.read_vector(spark, str(tmp_path / "w")).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_pairwise_fit_equals_a_fit_on_pairs(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(60, 3))
    y = np.digitize(x @ [1.0, -2.0, 0.5] + r.normal(size=60), [-1, 0, 1]).astype(float)
    rows = [(i, "ab"[i % 2], float(y[i]), x[i].tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, g string, label double, features array<double>")
    for block in (7, 500):
        got = np.array(learners.rank_fit(df, "g", block=block))
        s = x.std(axis=0)
        d = np.array([(x[i] - x[j]) / s for i in range(60) for j in range(60) if i % 2 == j % 2 and y[i] > y[j]])
        w = got * s
        slope = -(d * (1 / (1 + np.exp(d @ w)))[:, None]).mean(axis=0) + 0.01 * w
        assert np.abs(slope).max() < 1e-8
    assert learners.rank_fit(df.limit(0), "g") == []


def test_sums_of_ordered_pairs():
    r = np.random.default_rng(5)
    high, low, w = r.normal(size=(9, 3)), r.normal(size=(700, 3)), np.array([1.0, -2.0, 0.5])
    total = np.zeros(1 + 3 + 9)
    learners._ordered_sums(high, low, w, total)
    d = (high[:, None] - low[None]).reshape(-1, 3)
    p = 1 / (1 + np.exp(d @ w))
    assert np.allclose(total, [len(d), *-(p @ d), *(d.T @ (d * (p * (1 - p))[:, None])).ravel()])
