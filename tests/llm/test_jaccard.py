import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import sievemill.llm.jaccard_join as module
from sievemill.llm.components import components, merged
from sievemill.llm.jaccard_join import LocalIndex, jaccard_components
from sievemill.llm.stages import one_of_each_group

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_set(text):
    w = WORD.findall((text or "").translate(UPPER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = {}
    for i, t in rows:
        sets[i] = sets.get(i, frozenset()) | shingle_set(t)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets, key=lambda i: (i is None, i))
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)), key=lambda i: (i is None, i))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n=260):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["Été", "straße", "A-b", "ß"]
    text = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passage, bases = text(60), [text(r.randint(5, 150)) for _ in range(12)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "a b c d e"), (6, "a b c d"), (7, text(3000))]
    for i in range(8, n):
        kind = r.random()
        if kind < 0.3:
            rows.append((i, text(r.randint(1, 80))))
        elif kind < 0.5:
            rows.append((i, text(30) + "\n" + passage + " " + text(r.choice([2, 10, 40]))))
        else:
            w = r.choice(bases).split()
            for _ in range(r.choice([0, 0, 1, 1, 2, 4, 8])):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((i, " ".join(w).upper() if r.random() < 0.2 else "  ".join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()}
    want = brute(rows)
    assert got == want
    assert max(sum(c == i for _, c in want.values()) for i in want) > 5


def test_blocks_and_slices_of_few_documents(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK", 2)
    monkeypatch.setattr(module, "SLICE", 3)
    monkeypatch.setattr(module, "MEETINGS", 10)
    rows = corpus(5, 150)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_search_finds_every_partner_of_a_block():
    r = np.random.default_rng(1)
    base = [r.choice(10**6, size, replace=False) for size in (1, 5, 40, 300)]
    sets, block = [], []
    for b in range(3):
        for i in range(40):
            x = base[i % 4].copy()
            x[: int(r.integers(0, len(x) // 3 + 1))] += 10**7 * (i + 1)
            sets.append(np.sort(x))
            block.append(b)
    n, block = np.array([len(x) for x in sets]), np.array(block)
    index = LocalIndex(sets, n, block, 4, 5)
    for x in range(len(sets)):
        want = [y for y in range(x + 1, len(sets)) if block[x] == block[y] and 5 * len(both := set(sets[x]) & set(sets[y])) >= 4 * (n[x] + n[y] - len(both))]
        assert index.partners(x, np.arange(len(sets))).tolist() == want


def test_queries_against_all_rows(spark):
    """Ids divisible by 100 of the middle table against all rows: all links are within components."""
    path = "/root/testdata/sf0.01/documents.parquet"
    if not Path(path).exists():
        pytest.skip("needs the driver's tables")
    docs = spark.read.parquet(path)
    got = {r.doc_id: r.component_id for r in jaccard_components(docs).collect()}
    sets = {r.doc_id: shingle_set(r.text) for r in docs.collect()}
    links = 0
    for a in (i for i in sets if i % 100 == 0 and sets[i]):
        for b in sets:
            if a != b and sets[b] and 100 * (both := len(sets[a] & sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - both):
                links += 1
                assert got[a] == got[b]
    assert links


def test_threshold_is_met_exactly(spark):
    base = [f"t{i}" for i in range(22)]  # 18 shingles
    rows = [(1, " ".join(base)), (2, " ".join([*base, "x", "y"])), (3, " ".join([*base, "p", "q", "r", "s"])), (4, " ".join([*base, "p", "q", "r", "s", "t"]))]
    got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in brute(rows).items()}


def test_odd_rows(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (9, "u v w x y z"), (9, "a b c d e f"), (11, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit(1)).withColumn("m", F.lit("x")).withColumn("n", F.lit(2))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()}
    assert got == {5: (2, 5), None: (2, 5), 9: (4, 9), 11: (1, 11)}
    assert jaccard_components(docs.limit(0)).collect() == []


@pytest.mark.parametrize("parts", [1, 7])
def test_components(spark, parts):
    r = random.Random(4)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(r.randrange(2000, 2100), r.randrange(2000, 2100)) for _ in range(60)] + [(7, 7), (None, 3)]
    got = {x.node: x.label for x in components(spark.createDataFrame(links, "a long, b long").repartition(parts)).collect()}
    half = spark.createDataFrame(links, "a long, b long").repartition(parts)
    again = merged(components(half.where("a % 2 = 0")), half.where("a % 2 = 1"))
    assert {x.node for x in again.collect()} == got.keys() and len({x.label for x in again.collect()}) == len(set(got.values()))
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        if a is not None and a != b:
            root[find(a)] = find(b)
    assert got.keys() == root.keys()
    assert len(set(got.values())) == len({find(i) for i in root})
    assert all(find(i) == find(c) for i, c in got.items())


def test_stage_keeps_one_of_each_group(spark):
    rows = corpus(3, 120) + [(None, "null id"), (None, "null id"), (50, "repeated id and another text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("__size", F.lit(1))
    got = one_of_each_group(docs)
    want = brute([r for r in rows if r[0] is not None])
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == sorted(i for i, (_, c) in want.items() if c == i)
    assert got.where("doc_id is null").count() == 2


def test_hashes_do_not_depend_on_the_stretch(monkeypatch):
    import pyarrow as pa

    from sievemill.llm import words

    texts = ["", "a", "Long " * 500 + "x" * 900, None, "été und so weiter", "x" * 5000, "a b  a"]
    data, at = words.buffers(pa.array(texts))
    whole = words.split(data, at, words.SPACED)
    want = whole.hashes()
    for stretch in (1, 7, 64, 1000):
        monkeypatch.setattr(words, "STRETCH", stretch)
        monkeypatch.setattr(words, "_POWERS", [])
        assert (whole.hashes() == want).all()
    by = {}
    for i, h in enumerate(want.tolist()):
        by.setdefault(bytes(whole.low[whole.start[i] : whole.end[i]]), set()).add(h)
    assert all(len(x) == 1 for x in by.values()) and len(set.union(*by.values())) == len(by)
