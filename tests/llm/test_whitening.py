"""Whitening against numpy."""

from pathlib import Path

import numpy as np
import pytest

from sievemill.llm import whitening

KINDS = "vec_id long, embedding array<float>, component string, x int"


def brute(rows, count=16):
    """Dropped rows left out; integers as Python's, the rest by numpy."""
    good = [(i, v) for i, v, *_ in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    sizes = {}
    x = [(i, tuple(int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v)) for i, v in good]
    for v in {v for _, v in x}:
        sizes[len(v)] = sizes.get(len(v), 0) + 1
    width = max(sizes, key=lambda s: (sizes[s], s))
    x = [(i, v) for i, v in x if len(v) == width]
    fit = sorted({v for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[n * c - s for c, s in zip(v, sums, strict=True)] for v in fit], float) / n
    cov = centred.T @ centred / n
    e, vectors = np.linalg.eigh(cov)
    e, vectors = e[::-1][:count], vectors[:, ::-1][:, :count]
    out = {}
    for i, v in x:
        whole = [n * c - s for c, s in zip(v, sums, strict=True)]
        y = np.array(whole, float) / n @ vectors / np.sqrt(np.maximum(e, 1e-300))
        out.setdefault((i, sum(c * c for c in whole)), []).append(np.abs(y))
    return n, e / np.trace(cov), out


def held(df):
    got = {}
    for r in df.collect():
        got.setdefault((r.vec_id, r.deviation), []).append(r)
    return got


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_numpy(spark, seed):
    r = np.random.default_rng(seed)
    rows = [(i, (r.normal(size=20) * np.linspace(3, 0.2, 20)).astype(np.float32).tolist(), "clash", 1) for i in range(300)]
    rows += [(1000 + i, rows[5][1], None, None) for i in range(100)]  # one vector that is a quarter of all rows counts once
    rows += [(None, rows[7][1], "", 0), ((1 << 60) + 1, rows[8][1], "", 0), (3, rows[3][1], "", 0)]
    rows += [(2000, None, "", 0), (2001, [], "", 0), (2002, [1.0] * 19 + [None], "", 0), (2003, [float("nan")] * 20, "", 0), (2004, [float("inf")] + [0.0] * 19, "", 0), (2005, [1.0, 2.0], "", 0)]
    df = whitening.whiten(spark.createDataFrame(rows, KINDS))
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    n, explained, want = brute(rows)
    got = held(df)
    assert set(got) == set(want) and n == 300
    for key, found in got.items():
        by = {c: sorted((abs(x.whitened) for x in found if x.component == c)) for c in range(1, 17)}
        assert all(len(v) == len(want[key]) for v in by.values())
        for c in range(1, 17):
            assert np.allclose(by[c], [y[c - 1] for y in want[key]], atol=1e-9)
    one = df.limit(16).collect()
    assert all(x.n == 300 and 0 <= x.identity_error < 1e-10 and abs(x.explained / explained[x.component - 1] - 1) < 1e-10 for x in one)


def test_signs_are_one_for_all_rows(spark):
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=3).astype(np.float32).tolist(), "", 0) for i in range(50)]
    got = whitening.whiten(spark.createDataFrame(rows, KINDS)).toPandas().pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert got.shape == (50, 3) and np.allclose(got.T @ got / 50, np.eye(3), atol=1e-10)


def test_odd_tables(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0], "", 0), (2, [1.0, 2.0], "", 0)], KINDS)
    got = whitening.whiten(same).collect()
    assert sorted((x.vec_id, x.component, x.n, x.deviation, x.whitened, x.explained, x.identity_error) for x in got) == [(i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    assert whitening.whiten(same.limit(0)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None, "", 0)], KINDS)).collect() == []
    wide = spark.createDataFrame([(i, [float(3e38 if i == j else -i) for j in range(3)], "", 0) for i in range(4)], KINDS)
    assert len(whitening.whiten(wide).collect()) == 12


def test_deviations_beyond_64_bits_are_null():
    w = whitening.Whitening(1 << 40, [0, 0], np.ones(2), np.eye(2), 2.0)
    whole = w.whole(np.array([[1 << 30, 1], [1, 2]]))
    assert whole.tolist() == [[1 << 70, 1 << 40], [1 << 40, 1 << 41]] and w.deviations(whole) == [None, None]
    assert whitening.Whitening(3, [1, 2], np.ones(2), np.eye(2), 2.0).deviations(np.array([[2, -3]])) == [13]


def test_whole_table_equals_numpy(spark):
    path = Path("/root/testdata/sf0.01/embeddings.parquet")
    if not path.exists():
        pytest.skip("needs the driver's tables")
    df = spark.read.parquet(str(path))
    n, _, want = brute([(x.vec_id, x.embedding) for x in df.collect()])
    got = held(whitening.whiten(df))
    assert set(got) == set(want)
    for key, found in got.items():
        assert all(x.n == n and abs(abs(x.whitened) - want[key][0][x.component - 1]) < 1e-9 for x in found)
