import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievemill.llm import licenses as module
from sievemill.llm.licenses import TEMPLATES, licenses, scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(rows, least=0.7):
    names = [n for n in sorted(TEMPLATES) for _ in TEMPLATES[n]]
    templates = [Counter(cut(t)) for n in sorted(TEMPLATES) for t in TEMPLATES[n]]
    terms = set().union(*templates)
    df = Counter(t for _, x in rows for t in set(cut(x)) & terms)
    weight = lambda t: math.log((1 + len(rows)) / (1 + (df[t] if t in terms else 1))) + 1
    vector = lambda c: {t: n * weight(t) for t, n in c.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = {}
    for path, text in rows:
        best = (0.0, None)
        for unit in [text or "", *(text or "").split("\n")]:
            v = vector(Counter(cut(unit)))
            for name, t in zip(names, map(vector, templates)):
                if v:
                    s = round(sum(x * v.get(k, 0.0) for k, x in t.items()) / norm(v) / norm(t), 6)
                    if s > best[0]:
                        best = (s, name)
        out[path] = best if best[0] >= least else (None, None)
    return out


ROWS = [
    ("a/b/LICENSE", TEMPLATES["MIT"][0] + "\n" + TEMPLATES["MIT"][1]),
    ("a/b/c/x", "plain words of no license"),
    ("a/b/c/y", "some text here " * 9 + "\nlicensed under the apache license version 2.0\nmore text "),
    ("a/NOTICE", TEMPLATES["ISC"][0]),
    ("a/z/q", None),
    ("a/z/r", ""),
    ("w", "License license 2 0"),
    ("v/u", "work under the terms of the " * 2000 + "\n" + TEMPLATES["GPL-3.0"][1]),
    (None, TEMPLATES["MPL-2.0"][0]),
    ("a/z/same", "x"),
    ("a/z/same", "x"),
]


def test_scan_equals_brute_force(spark):
    files = spark.createDataFrame(ROWS, "path string, text string").withColumn("license", F.lit("clash")).withColumn("share", F.lit(1))
    got = {r.path: (r.similarity, r.license) for r in scan(files).collect()}
    want = brute(ROWS)
    assert {p: x[1] for p, x in got.items()} == {p: x[1] for p, x in want.items()}
    assert all(x is None or abs(x - got[p][0]) < 2e-6 for p, (x, _) in want.items())


def test_nearest_directory_is_inherited(spark):
    files = spark.createDataFrame(ROWS, "path string, text string").withColumn("folder", F.lit("clash"))
    got = licenses(files)
    rows = {r.path: r for r in got.collect()}
    assert got.count() == len(ROWS)
    assert rows["a/b/c/x"].inherited_from == "a/b/LICENSE" and rows["a/b/c/x"].effective == "MIT"
    assert rows["a/b/c/y"].effective == "Apache-2.0" and rows["a/b/c/y"].inherited == "MIT"
    assert rows["a/z/q"].inherited_from == "a/NOTICE" and rows["a/z/same"].effective == "ISC"
    assert rows["v/u"].license == "GPL-3.0" and rows["v/u"].inherited is None
    assert rows[None].license == "MPL-2.0" and rows[None].inherited is None
    assert licenses(files.limit(0)).collect() == []


APACHE, MIT, MPL = TEMPLATES["Apache-2.0"][0], TEMPLATES["MIT"][0], TEMPLATES["MPL-2.0"][0]
NOTICES = [
    ("1", "Copyright (c) 2020 Jane Doe. Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("2", "Copyright (c) 2020. Released under the MIT License.", "MIT"),
    ("3", "A title\n\n" + TEMPLATES["MIT"][1].replace(" person", "\n// person").replace(" to deal", "\n// to deal") + "\n//\n" + "further words of a text " * 9, "MIT"),
    ("4", "A first sentence of many other words than these. " + MPL + " Then a last sentence of many other words.", "MPL-2.0"),
    ("5", "Nothing here but plain words. Licensed doctors work here!", None),
    ("6", "copyright 2020 c released under the MIT License", "MIT"),
]


def test_notices_beside_other_words(spark):
    rows = [(p, t) for p, t, _ in NOTICES] + [(f"f{i}", f"copyright c 2020 word{i}") for i in range(200)]
    files = spark.createDataFrame(rows, "path string, text string")
    got = {r.path: r for r in scan(files).collect()}
    assert {p: got[p].license for p, _, _ in NOTICES} == {p: x for p, _, x in NOTICES}
    assert got["1"].similarity == got["2"].similarity == 1.0
    assert 0.3 < got["3"].share < 0.5


def test_all_words_are_weighed_by_their_document_frequency(spark, monkeypatch):
    rows = [(p, t) for p, t, _ in NOTICES] + [(f"f{i}", f"copyright c 2020 word{i}") for i in range(200)]
    df, n = Counter(t for _, x in rows for t in set(cut(x))), len(rows)
    vector = lambda text: {t: c * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in Counter(cut(text)).items()}
    u, v = vector(NOTICES[5][1]), vector(MIT)
    norm = lambda x: math.sqrt(sum(y * y for y in x.values()))
    want = sum(x * v.get(t, 0.0) for t, x in u.items()) / norm(u) / norm(v)
    files = spark.createDataFrame(rows, "path string, text string")
    for held, table in ((2_000_000, 1 << 21), (2, 1)):
        monkeypatch.setattr(module, "HELD", held)
        monkeypatch.setattr(module, "TABLE", table)
        got = {r.path: r.similarity for r in scan(files).collect()}
        assert abs(got["6"] - want) < 2e-6


def test_inheritance_equals_brute_force(spark):
    r = random.Random(9)
    paths = {"/".join(r.choice("ab") for _ in range(r.randint(1, 5))) + f"/f{i}" for i in range(120)}
    rows = [(p, r.choice([APACHE, MIT, "plain words", "LICENSED\n" + "other words " * 30 + "\n\n" + MPL, None])) for p in sorted(paths)]
    rows += [(p.rpartition("/")[0] + "/LICENSE.txt", "terms " * 300 + "\n\n" + APACHE) for p in sorted(paths)[::30]]
    got = {x.path: x for x in licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    held = {}
    for x in scan(spark.createDataFrame(rows, "path string, text string")).collect():
        if x.license and (x.share >= 0.5 or x.path.endswith("LICENSE.txt")):
            folder = x.path.rpartition("/")[0]
            held[folder] = min(held.get(folder, (1,)), (-x.similarity, x.path, x.license))
    assert any("LICENSE" in x[1] for x in held.values())
    for p, x in got.items():
        up = p.rpartition("/")[0]
        while up and up not in held:
            up = up.rpartition("/")[0]
        assert (x.inherited_from, x.inherited) == (held[up][1:] if up in held else (None, None)), p


def test_query_takes_null_negative_and_repeated_ids(spark, tmp_path):
    from sievemill.llm.queries import op10_licenses

    rows = [(None, "plain words here", "en", "s"), (-7, MIT, "en", None), (-7, MIT, "en", None), (3, "plain", None, None), (4, "plain too", "en", None), (5, None, None, "a/b")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(((r.doc_id, r.effective) for r in op10_licenses(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(None, None), (-7, "MIT"), (-7, "MIT"), (3, None), (4, "MIT"), (5, None)], key=str)
    with pytest.raises(ValueError):
        licenses(spark.createDataFrame([("a", "b", 1)], "path string, text string, share int"), keep=("share",))
