"""Periodic runs against a search of every period, word by word."""

import hashlib
import random
import re
import zlib
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest

from sievemill.llm import periodic, queries
from sievemill.llm.words import SAME, SPACED, split

WORD = r"[^\x20\x09-\x0D]+"


def brute(words, times=3, least=24):
    best = {}
    n = len(words)
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, times * p):
                best.setdefault((i, j - i + p), p)  # rising periods: the first is the smallest
            i = j + 1
    return sorted((i, m, p) for (i, m), p in best.items())


def digest(doc_id, text):
    """The contract's row, plainly."""
    words = re.findall(WORD, text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join("%d,%d,%d\n" % r for r in runs)), sha(left))


def grid(texts):
    data = [t.encode() for t in texts]
    at = np.append(0, np.cumsum([len(x) for x in data])).astype(np.int64)
    return periodic.Grid.of(split(np.frombuffer(b"".join(data), np.uint8), at, SPACED, SAME))


def texts(r):
    out = ["", "a", "a " * 23, "a " * 24, "a b " * 12, "a b " * 11 + "a", "A a " * 30, "x " * 500, "  " * 30, "a\x0bb\tc\n" * 9, "a b a b a " * 20]
    for _ in range(150):
        words = [r.choice("abc") for _ in range(r.randint(0, 40))]
        for _ in range(r.randint(0, 3)):
            period = [r.choice("abcd") for _ in range(r.randint(1, 12))]
            words += (period * r.randint(2, 9))[: r.randint(1, 90)] + [r.choice("abcd") for _ in range(r.randint(0, 5))]
        out.append(" ".join(words))
    thue = [0]
    for _ in range(10):
        thue += [1 - x for x in thue]
    out += [" ".join("ab"[x] for x in thue), " ".join("ab"[x] for x in thue * 3)]
    fib, last = "ab", "a"
    for _ in range(12):
        fib, last = fib + last, fib
    out.append(" ".join(fib))
    return out


@pytest.mark.parametrize("pairs", [50, 1 << 20])
def test_runs_equal_brute_force(monkeypatch, pairs):
    monkeypatch.setattr(periodic, "PAIRS", pairs)
    some = texts(random.Random(pairs))
    if pairs < 100:
        some = [t for t in some if len(t) < 800]
    g = grid(some)
    for text, runs in zip(some, g.runs(), strict=True):
        assert runs == brute(re.findall(WORD, text)), text
    for text, runs in zip(some, g.runs(times=4, least=8), strict=True):
        assert runs == brute(re.findall(WORD, text), 4, 8), text


@pytest.mark.parametrize("bits", [1, 3, 6])
def test_hashes_that_lie_do_no_harm(monkeypatch, bits):
    true = periodic.Grid.equal

    def lying(self, a, q, size):
        lie = (a * 31 + q * 17 + size * 7) % (1 << bits) == 0
        return true(self, a, q, size) | lie

    some = [t for t in texts(random.Random(9)) if len(t) < 400]
    want = [brute(re.findall(WORD, t)) for t in some]
    monkeypatch.setattr(periodic.Grid, "equal", lying)
    got = grid(some).runs()
    assert got == want


def test_query_equals_brute_force(spark, tmp_path):
    r = random.Random(2)
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 10 == 0][:120]
    rows = [(i, " ".join(r.choices(["a", "b", "É", "word"], k=r.choice([0, 1, 5, 30, 300])))) for i in ids]
    rows += [(10_000 + i, t) for i, t in enumerate(texts(r)) if len(t) < 2000] + [(None, "a b c " * 20), (None, None), (ids[0], None), (ids[1], " "), (ids[2], "a " * 50), (ids[2], "a " * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as runs", "'' as __p")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((digest(*x) for x in rows), key=str)


def test_operator_keeps_columns_and_odd_tables(spark):
    df = spark.createDataFrame([(1, "a " * 30, "k"), (None, None, None)], "doc_id long, text string, collapsed string")
    got = {x.doc_id: x for x in periodic.periodic_runs(df).collect()}
    assert got[1].collapsed == "a" and got[1].n_words == 30 and tuple(got[1].strongest) == (0, 30, 1) and [tuple(x) for x in got[1].runs] == [(0, 30, 1)]
    assert got[None].collapsed == "" and got[None].runs == [] and got[None].strongest is None
    assert periodic.periodic_runs(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic.periodic_runs(df, keep=("doc_id", "collapsed"))


def test_whole_table_equals_brute_force(spark):
    path = Path("/root/testdata/sf0.001")
    if not path.exists():
        pytest.skip("needs the driver's tables")
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{path}/documents.parquet").collect()]
    rows = [x for x in rows if len(x[1] or "") < 8000]  # the brute force is quadratic
    got = {x[0]: tuple(x) for x in queries.op13_periodic_runs(spark, str(path)).collect()}
    assert all(got[x[0]] == digest(*x) for x in rows) and len(rows) > 150
