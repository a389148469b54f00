import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sievemill.llm import decontaminate
from sievemill.llm.decontaminate import Windows, clean_rows, contamination
from sievemill.llm.words import ALNUM, buffers, shingles, split

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(docs, items):
    cut = lambda t: WORD.findall((t or "").translate(UPPER))
    windows = {}
    for i, t in items:
        w = cut(t)
        if i is not None and w:
            for x in [tuple(w[j : j + 10]) for j in range(len(w) - 9)] if len(w) >= 10 else [tuple(w)]:
                windows.setdefault(x, set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, held = cut(t), set(), set()
        for size in {len(x) for x in windows}:
            for j in range(len(w) - size + 1):
                if found := windows.get(tuple(w[j : j + size])):
                    hit.update(range(j, j + size))
                    held |= found
        out.append((d, len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit)))
    return out


def tables(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["Été", "naïve", "7"]
    text = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    items = [(i, text(r.choice([1, 2, 3, 9, 10, 11, 30]))) for i in range(40)]
    items += [(100, None), (101, ""), (102, "..!"), (None, text(12)), (3, text(12)), (103, items[6][1]), (104, "zz " * 12)]
    docs = [(0, None), (1, ""), (2, "?!"), (None, items[4][1]), (3, text(5000) + items[8][1]), (4, "zz zz " * 20), (4, "zz zz " * 20)]
    for i in range(5, 120):
        w = text(r.randint(0, 60)).split()
        if r.random() < 0.6:
            at = r.randint(0, len(w))
            w[at:at] = re.sub(" ", lambda _: r.choice([" ", ", ", "--", "\n"]), r.choice(items[:40])[1]).upper().split(" ")
        docs.append((i, " ".join(w)))
    return docs, items


def key(row):
    return tuple((x is not None, x) for x in row)


def test_equals_brute_force_in_one_block_and_in_many(spark, monkeypatch):
    docs, items = tables(1)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("id", F.lit("clash")).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("block", F.lit(9))
    want = sorted(brute(docs, items), key=key)
    assert sorted(map(tuple, contamination(d, b).collect()), key=key) == want
    monkeypatch.setattr(decontaminate, "BLOCK", 500)
    assert sorted(map(tuple, contamination(d, b).collect()), key=key) == want
    kept = clean_rows(d, b)
    assert kept.columns == d.columns
    assert sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is not None, x)) == sorted((r[0] for r in want if not r[5]), key=lambda x: (x is not None, x))


def test_empty_tables(spark):
    docs, items = tables(2)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert contamination(d.limit(0), b).collect() == []
    assert contamination(d, b.limit(0)).where("contaminated").count() == 0
    assert clean_rows(d, b.limit(0)).count() == len(docs)


def test_windows_have_their_own_shingles_beside_items_of_one_and_two_words():
    for seed in range(30):
        r = random.Random(seed)
        items = [(str(i), " ".join(f"w{r.randrange(3000)}" for _ in range(r.choice([1, 2]) if r.random() < 0.2 else r.randint(3, 60)))) for i in range(60)]
        made = Windows.of(items, 10, 3)
        alone = split(*buffers(pa.array([b" ".join(w).decode() for w in made.words], pa.large_string())), ALNUM)
        for g in (1, 2, 3):
            values, text, place = shingles(alone, g)
            for w in [w for w, x in enumerate(made.words) if min(3, len(x)) == g]:
                own = values[text == w]
                assert np.array_equal(made.parts[w], own)


def test_equals_brute_force_with_many_short_items(spark):
    for seed in range(3):
        r = random.Random(seed)
        items = [(i, " ".join(f"w{r.randrange(500)}" for _ in range(r.choice([1, 2]) if r.random() < 0.3 else r.randint(3, 40)))) for i in range(120)]
        docs = [(i, " ".join(["x"] * r.randint(0, 5) + [r.choice(items)[1]] + ["y"] * r.randint(0, 5))) for i in range(100)]
        d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        assert sorted(map(tuple, contamination(d, b).collect()), key=key) == sorted(brute(docs, items), key=key)
