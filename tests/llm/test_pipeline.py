"""Each stage of the pipeline against brute force on its own input."""

from collections import Counter, defaultdict
from pathlib import Path

import pytest

import corpus_pipeline
from sievemill.llm import quality
from tests.llm.test_decontaminate import brute as windows
from tests.llm.test_jaccard import WORD
from tests.llm.test_jaccard import brute as groups
from tests.llm.test_mixing import water

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, held = docs.columns, [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, held[-1], DATA).write.parquet(str(tmp_path / str(i)))
        held.append(spark.read.parquet(str(tmp_path / str(i))))
    assert all(x.columns == columns for x in held[:-1])
    rows = [x.select("doc_id", "source", "text").collect() for x in held]
    ids = [Counter(r.doc_id for r in x) for x in rows]
    labels = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = quality.classify(docs, spark.read.parquet(f"{DATA}/labels.parquet")).where("keep")
    assert ids[1] == Counter(r.doc_id for r in kept.collect())
    good = [i for i in ids[0] if i in labels and labels[i].quality == 1 and labels[i].toxic == 0]
    assert sum(i in ids[1] for i in good) >= 0.97 * len(good)
    assert ids[2] == Counter(i for i, (_, c) in groups([(r.doc_id, r.text) for r in rows[1]]).items() if i == c)
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    assert ids[3] == Counter(x[0] for x in windows([(r.doc_id, r.text) for r in rows[2]], items) if not x[5])
    size = lambda r: len(WORD.findall(r.text or ""))
    before, after = defaultdict(int), defaultdict(int)
    for r in rows[3]:
        before[r.source] += size(r)
    for r in rows[4]:
        after[r.source] += size(r)
    longest = max(size(r) for r in rows[3])
    assert all(abs(after[s] - t) <= longest for s, t in water(before).items()) and max(ids[4].values()) <= 2
    assert ids[5] == ids[4] and set(columns) < set(held[5].columns)
    shards = Counter(r.shard for r in held[5].select("shard").collect())
    assert set(shards) == set(range(40)) and max(shards.values()) - min(shards.values()) <= 1


def test_run_leaves_its_result_and_deletes_the_way_there(spark):
    from sievemill.llm import storage

    before = storage.made()
    out = corpus_pipeline.run(spark, DATA)
    got = out.select("doc_id", "shard").collect()
    assert got and len({r.shard for r in got}) == 40
    left = [p.rpartition("/")[2].rpartition("-")[0] for p in storage._MADE[before:]]
    assert left == ["shards"]


CLASHES = ["__turn", "__id", "__source", "__size", "__copies", "__held", "__own", "__n_chars", "__nats", "nats", "shard", "__Slot", "__bucket", "label", "size", "taken", "bin", "key"]


def test_stages_keep_columns_of_their_own_names(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    odd = docs.unionByName(docs.limit(2)).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")))
    plain = odd.withColumns({c: F.lit(i) for i, c in enumerate(CLASHES)})
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, plain, DATA)
        rows = got.collect()
        assert rows and stage(spark, plain.limit(0), DATA).collect() == []
        if i < 4:
            assert got.columns == plain.columns
            assert all(r[c] == j for r in rows for j, c in enumerate(CLASHES))
        else:
            assert len(rows) == plain.count() and len(set(got.columns)) == len(got.columns) == len(plain.columns) + 2
            assert {r["shard_"] for r in rows} == {CLASHES.index("shard")} and all(r["shard"] in range(40) and r["__nats"] == CLASHES.index("__nats") for r in rows)
