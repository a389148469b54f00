"""Pooled similarity statistics against plain loops."""

import numpy as np
import pyarrow as pa
import pytest

from sievemill.operators import pooling

R = np.random.default_rng(11)


def similarity(metric, a, b):
    if metric in ("cosine", "euclidean"):
        a, b = np.array(a or [], float), np.array(b or [], float)
        if metric == "euclidean":
            return float(np.sqrt(((a - b) ** 2).sum()))
        n = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
        return float(a @ b / n) if n else 0.0
    a, b = set(a or []), set(b or [])
    whole = len(a | b) if metric == "jaccard" else len(a) + len(b)
    return (1 if metric == "jaccard" else 2) * len(a & b) / whole if whole else 0.0


def brute(rows, metric, keyed, empty):
    out = {}
    for i, q, _, v in rows:
        stats = []
        for r in (1, 2, 3, 4):
            x = [similarity(metric, v, w) for j, p, s, w in rows if j != i and s == r and (not keyed or (p == q and q is not None))]
            stats += [np.mean(x), np.std(x), min(x), np.median(x), max(x)] if x else [empty] * 5
        out[i] = stats
    return out


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "jaccard", "dice"])
@pytest.mark.parametrize("kept", [pooling.KEPT, 0])
def test_equals_plain_loops(spark, monkeypatch, metric, kept):
    monkeypatch.setattr(pooling, "BLOCK", 16)
    monkeypatch.setattr(pooling, "KEPT", kept)
    monkeypatch.setattr(pooling, "FEW", 3)
    monkeypatch.setattr(pooling, "BINS", 4)
    vectors = metric in ("cosine", "euclidean")
    value = (lambda: R.integers(-2, 3, 3).astype(float).tolist()) if vectors else (lambda: [f"w{x}" for x in R.integers(0, 8, R.integers(0, 7))])
    rows = [(i, "hot" if i % 3 else f"k{i % 5}", int(R.choice([1, 1, 1, 2, 4])), value()) for i in range(70)]
    rows += [(100, None, 2, value()), (101, "k1", None, value())]
    if not vectors:
        rows += [(102, "hot", 2, None), (103, "hot", 2, [])]
    kind = "array<double>" if vectors else "array<string>"
    df = spark.createDataFrame(rows, f"id long, q string, r int, value {kind}").repartition(3)
    for key in (None, "q"):
        got = {x.id: list(x)[1:] for x in pooling.pooled_stats(df, df, metric, key=key, empty=-1.0).collect()}
        want = brute(rows, metric, key is not None, -1.0)
        assert set(got) == set(want)
        for i, x in want.items():
            assert np.allclose(got[i], x, atol=1e-9), (i, key, got[i], x)
    assert pooling.pooled_stats(df.limit(0), df, metric).collect() == []
    alone = pooling.pooled_stats(df, df.limit(0), metric, empty=-2.0).first()
    assert set(list(alone)[1:]) == {-2.0}


def test_long_rows_and_near_vectors(monkeypatch):
    """Medians between bounds, and distances of vectors that are nearly or quite equal."""
    for y in (R.normal(size=9001), R.normal(size=9000), np.repeat([0.0, 1.0], 5000), np.sort(R.normal(size=10_000)), np.r_[np.zeros(6000), R.normal(size=3000)], np.tile([5.0] + [0.0] * 7 + [1.0] * 8, 1024)):
        assert pooling._median(y) == np.median(y)
    x = R.normal(size=(40, 16)) * 1e3
    x = np.concatenate([x, x + 1e-9 * R.normal(size=x.shape), x])
    lists = pa.array(x.tolist(), pa.list_(pa.float64()))
    want = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    got = pooling.Euclidean(lists)(lists)
    assert np.allclose(got, want, rtol=1e-12, atol=0) and (np.diag(got) == 0).all()
    calls = []
    monkeypatch.setattr(np, "partition", lambda y, k: calls.append(len(y)) or np.sort(y))
    pooling._median(R.normal(size=100_000))
    assert max(calls) < 20_000  # not the whole row
    unlike = pa.array([[1.0, 2.0], [1.0], [0.0, 0.0], [np.inf, 1.0]], pa.list_(pa.float64()))
    cosine, euclidean = pooling.Cosine(unlike)(unlike), pooling.Euclidean(unlike)(unlike)
    assert cosine[0, 2] == 0 and np.isnan(cosine[1]).all() and np.isnan(euclidean[1]).all() and euclidean[0, 3] == np.inf


@pytest.mark.parametrize("light", [0.0, 0.6, 1e9])
def test_tallies_of_sets(monkeypatch, light):
    """Statistics from how often each (shared, size) was met are those of all similarities; rows that share nothing are not held."""
    monkeypatch.setattr(pooling, "LIGHT", light)
    monkeypatch.setattr(pooling, "HELD", 500)
    codes = R.integers(-(1 << 63), (1 << 63) - 1, 400)
    codes = np.r_[codes, codes[:50] ^ 1]  # neighbours with the same high bits
    made = lambda n, most: pa.array([np.unique(codes[R.zipf(1.4, R.integers(0, most)) % len(codes)]).tolist() for _ in range(n)], pa.list_(pa.int64()))
    for most in (4, 60, 4000):
        rows, others = made(40, most), made(300, most)
        for metric in (pooling.Jaccard, pooling.Dice):
            own = metric(rows)
            tally = pooling._Tally(own)
            tally.meet(others, np.full(40, -1))
            tally.meet(rows, np.arange(40))
            want = pooling._statistics([np.concatenate([own(others), own(rows)], axis=1)], 300 + np.arange(40))
            assert np.allclose(tally.statistics(), want, atol=1e-12)
    apart = pooling.Jaccard(pa.array([[i, i + 1000] for i in range(200)], pa.list_(pa.int64())))
    tally = pooling._Tally(apart)
    tally.meet(pa.array([[i, 5000] for i in range(200)], pa.list_(pa.int64())), np.full(200, -1))
    assert tally.held == 200 and tally.met == 200  # of 40,000 pairs
    assert np.allclose(tally.statistics(), [1 / 600, np.sqrt(199) / 600, 0, 0, 1 / 3])


@pytest.mark.parametrize("metric", ["jaccard", "dice"])
def test_sets_of_many_sizes(spark, monkeypatch, metric):
    """The same statistics where values around the middle are held instead of tallies."""
    monkeypatch.setattr(pooling, "SIZES", 0)
    rows = [(i, f"k{i % 2}", 1 + i % 4, [f"w{x}" for x in R.integers(0, 60, R.integers(0, 40))]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, q string, r int, value array<string>").repartition(3)
    for key in (None, "q"):
        got = {x.id: list(x)[1:] for x in pooling.pooled_stats(df, df, metric, key=key, empty=-1.0).collect()}
        want = brute(rows, metric, key is not None, -1.0)
        assert set(got) == set(want) and all(np.allclose(got[i], x, atol=1e-9) for i, x in want.items())


@pytest.mark.parametrize("light", [0.0, 1e9])
@pytest.mark.parametrize("width", [2.5, 0.0])
def test_held_values_do_not_grow_with_the_pool(monkeypatch, light, width):
    """Sets of unlike sizes: few values are held, medians are exact or their rows are named."""
    monkeypatch.setattr(pooling, "LIGHT", light)
    monkeypatch.setattr(pooling, "PAIRS", 1000)
    monkeypatch.setattr(pooling, "WIDTH", width)
    codes = R.integers(-(1 << 63), (1 << 63) - 1, 3000)
    made = lambda n: pa.array([R.choice(codes, R.integers(0, 600), replace=False).tolist() for _ in range(n)], pa.list_(pa.int64()))
    rows, pool = made(10), [made(100) for _ in range(60)]
    for metric in (pooling.Jaccard, pooling.Dice):
        own = metric(rows)
        spread, tally, most = pooling._Spread(own), pooling._Tally(own), 0
        for others in pool:
            spread.meet(others, np.full(10, -1))
            spread.settle()
            tally.meet(others, np.full(10, -1))
            most = max(most, spread.held)
        spread.meet(rows, np.arange(10))
        found, lost = spread.statistics()
        want = pooling._statistics([np.concatenate([own(others) for others in [*pool, rows]], axis=1)], 6000 + np.arange(10))
        tally.merge()
        assert most < 10_000 < tally.held
        sure = np.setdiff1d(np.arange(10), lost)
        assert np.allclose(found[sure], want[sure], atol=1e-12) and (len(lost) == 0 or not width)
        columns = [i for i, s in enumerate(pooling.STATS) if s != "median"]
        assert np.allclose(found[:, columns], want[:, columns], atol=1e-12)
