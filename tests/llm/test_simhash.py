"""Fingerprints, codeword keys and components against brute force."""

import random
import re
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
import xxhash

from sievemill.llm import simhash
from sievemill.llm.components import roots

KINDS = "doc_id long, text string, fp string, key int"


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def labels(prints):
    """The least node reachable by pairs within three bits."""
    fp = np.array(prints, np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp) <= 3
    a, b = np.nonzero(near)
    nodes, least = roots(a, b)
    return dict(zip(nodes.tolist(), least.tolist(), strict=True))


def expected(rows):
    prints = [fingerprint(r[1]) for r in rows]
    root, first = labels(prints), {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            first[root[i]] = min(r[0], first.get(root[i], r[0]))
    return sorted(((r[0], f"{p:016x}", first.get(root[i])) for i, (r, p) in enumerate(zip(rows, prints, strict=True))), key=str)


def test_documents_equal_brute_force(spark):
    r = random.Random(3)
    words = ["w%d" % i for i in range(50)] + ["É", "Ünï", " ", "x y"]
    texts = ["", None, " \t\n", "one", "ONE", "one two", "one\x0btwo ", "a b c", "A  b\tc", "a b c d"]
    texts += [" ".join(r.choices(words, k=r.choice([2, 3, 30, 400]))) for _ in range(120)]
    base = [r.choice(words) for _ in range(3000)]
    for i in range(80):  # near copies of a long text, and a long one past a stretch
        copy = list(base)
        for _ in range(i % 5):
            copy[r.randrange(3000)] = "changed%d" % r.randrange(5)
        texts.append(" ".join(copy))
    texts.append(" ".join(r.choices(words, k=70_000)))
    rows = [(i * 3, t, "clash", 1) for i, t in enumerate(texts)] + [(0, "a b c", "", 0), (None, "a b c", "", 0), (None, "alone as can be", "", 0), (-5, texts[150], "", 0)]
    df = spark.createDataFrame(rows, KINDS)
    assert sorted(map(tuple, simhash.near_copies(df).collect()), key=str) == expected(rows)
    assert simhash.near_copies(df.limit(0)).collect() == []


def test_golay_keys_cover_three_bits():
    r = np.random.default_rng(1)
    fp = r.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, 4000, dtype=np.uint64)
    other = fp.copy()
    for _ in range(3):
        other ^= np.uint64(1) << r.integers(0, 64, 4000).astype(np.uint64)
    own = [set() for _ in range(8000)]
    place, key = simhash.keys(np.concatenate([fp, other]))
    for i, k in zip(place.tolist(), key.tolist(), strict=True):
        own[i].add(k)
    assert all(own[i] & own[4000 + i] for i in range(4000))
    assert 8 <= min(map(len, own)) and max(map(len, own)) <= 48


def test_golay_code_is_perfect():
    assert (simhash.ERRORS >= 0).all() and len(np.unique(simhash.ERRORS)) == 2048
    w = np.arange(0, 1 << 24, 4099)
    code = simhash.codewords(w)
    assert {int(x) for x in (code >= 0).sum(axis=1)} == {1, 6}
    for bit in range(24):  # a neighbour shares a codeword
        near = simhash.codewords(w ^ (1 << bit))
        assert ((code[:, :, None] == near[:, None, :]) & (code[:, :, None] >= 0)).any(axis=(1, 2)).all()


@pytest.mark.parametrize("group", [4, 16, 1 << 12])
def test_hot_keys_lose_no_link(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    r = random.Random(group)
    centre, prints = r.getrandbits(64), {0}
    for _ in range(300):  # a dense ball, chains and far points that share keys
        x = centre
        for _ in range(r.choice([1, 2, 3, 5, 9])):
            x ^= 1 << r.randrange(64)
        prints.add(x)
    chain = r.getrandbits(64)
    for i in range(0, 60, 3):
        chain ^= 7 << i
        prints.add(chain)
    prints |= {r.getrandbits(64) & 0xFFFF for _ in range(150)}
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    found = simhash.linked_components(spark.createDataFrame([(x,) for x in signed], "fp long"))
    got = {x.node: x.label for x in found.collect()}
    want = labels(prints)
    groups = {}
    for i, x in enumerate(signed):
        groups.setdefault(want[i], []).append(got.get(x, x))
    assert all(len(set(g)) == 1 for g in groups.values()) and len({g[0] for g in groups.values()}) == len(groups)


def test_refining_keeps_near_pairs():
    import pyarrow as pa

    r = random.Random(8)
    for _ in range(200):
        x = r.getrandbits(64)
        y = x
        for b in r.sample(range(64), r.randint(0, 3)):
            y ^= 1 << b
        free = r.getrandbits(64) | (x ^ y)
        signed = np.array([x, y, free], np.uint64).view(np.int64).tolist()
        batch = pa.RecordBatch.from_arrays([pa.array([7, 7]), pa.array([signed[2]] * 2), pa.array(signed[:2])], names=["key", "open", "fp"])
        rows = [z for b in simhash._refined(iter([batch])) for z in b.to_pylist()]
        assert any(a["key"] == b["key"] and a["fp"] != b["fp"] or x == y for a, b in combinations(rows, 2))


def test_whole_table_equals_brute_force(spark):
    path = Path("/root/testdata/sf0.01/documents.parquet")
    if not path.exists():
        pytest.skip("needs the driver's tables")
    df = spark.read.parquet(str(path))
    rows = [(x.doc_id, x.text) for x in df.collect()]
    assert sorted(map(tuple, simhash.near_copies(df).collect()), key=str) == expected(rows)
