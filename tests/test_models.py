"""Forests, ensembles, learners, objectives and files."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievemill.operators import decode, ensemble, folds, forest, learners, lsa, metrics, objectives
from sievemill.sources import formats

R = np.random.default_rng(8)
X = R.normal(size=(300, 4))
Y = np.where(X[:, 0] > 0.2, 2.0, -1.0) + 0.5 * (X[:, 1] > 0) + 0.05 * R.normal(size=300)


def _rows(spark, x=X, y=Y):
    return spark.createDataFrame([(i, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, features array<double>, y double")


def test_forest_learns_and_all_ways_to_apply_it_agree(spark):
    config = forest.ForestConfig(max_leaf_forest=30, opt_interval=10, normalize_target=True, min_pop=5, reg_L2=0.01)
    nodes = forest.train_arrays(X, Y, config)
    rows = _rows(spark)
    a = rows.select("id", forest.predict_expression(nodes.to_dict("records")).alias("p")).orderBy("id").toPandas().p
    b = forest.predict(rows, nodes).orderBy("id").toPandas().prediction
    assert np.allclose(a, b) and np.mean((b - Y) ** 2) < 0.1 * np.var(Y)
    grown = forest.train(rows, config).toPandas()
    assert np.allclose(forest.predict(rows, grown).orderBy("id").toPandas().prediction, b)
    single = sum(forest.predict(rows, nodes[nodes.tree == t]).orderBy("id").toPandas().prediction.to_numpy() for t in sorted(nodes.tree.unique()))
    assert np.allclose(single, b)
    reached = forest.predict(rows, nodes, leaves=True).select(F.size("rules")).distinct().collect()
    assert [r[0] for r in reached] == [nodes.tree.max() + 1]
    more = forest.train_arrays(X, Y - nodes[nodes.tree < 0].weight.sum(), forest.ForestConfig(max_leaf_forest=40, opt_interval=10, min_pop=5, reg_L2=0.01), start=nodes)
    assert (more["le"] < 0).sum() > (nodes["le"] < 0).sum()
    with pytest.raises(ValueError):
        forest.train_arrays(X, Y, config, weights=np.ones(3))


def test_first_split_equals_the_scan_in_sql(spark):
    nodes = forest.train_arrays(X, Y, forest.ForestConfig(max_leaf_forest=2, min_pop=10, reg_L2=0.1))
    root = nodes[(nodes.tree == 0) & (nodes.node == 0)].iloc[0]
    long = _rows(spark).select(F.lit(0).alias("node"), F.posexplode("features").alias("feature", "value"), F.lit(1.0).alias("w"), F.col("y").alias("r"))
    best = forest.best_splits(forest.split_scan(long, 0.1 * len(Y))).first()
    assert best.feature == root.feature and math.isclose(best.border, root.border)


def test_forest_configuration():
    c = forest.ForestConfig.parse("reg_L2=0.5,max_leaf_forest=7 # comment\nNormalizeTarget\nvalid_interval=3\ntest_interval=130")
    assert (c.reg_L2, c.max_leaf_forest, c.normalize_target, c.test_interval, c.warnings) == (0.5, 7, True, 100, ["unknown option valid_interval"])
    with pytest.raises(ValueError):
        forest.ForestConfig.parse("reg_L2=1,reg_L2=2")
    assert [r.reg_L2 for r in forest.parse_runs("max_tree=3\n@reg_L2=1\n@reg_L2=2")] == [1.0, 2.0]
    assert [forest.aligned_interval(t, 100) for t in (500, 260, 60, 100)] == [500, 300, 50, 100]


def test_soft_kappa_gradient_is_a_derivative(spark):
    y, p = np.array([1, 2, 4, 3, 2, 1]), R.normal(size=(6, 4))
    df = spark.createDataFrame([(i, int(a), b.tolist(), 1.0) for i, (a, b) in enumerate(zip(y, p))], "id long, label int, preds array<double>, weight double")
    got = {(r.id, r.n): r.grad for r in objectives.softkappa_rows(df).collect()}
    h = np.bincount(y, minlength=5)[1:]
    e = sum((i - j) ** 2 * h[i] * h[j] for i in range(4) for j in range(4))

    def loss(q):
        q = np.exp(q)
        q /= q.sum(axis=1, keepdims=True)
        return len(y) * sum((y[i] - j - 1) ** 2 * q[i, j] for i in range(6) for j in range(4)) / e

    for i, n in ((0, 0), (3, 2), (5, 3)):
        d = np.zeros_like(p)
        d[i, n] = 1e-6
        assert math.isclose(got[i, n + 1], (loss(p + d) - loss(p - d)) / 2e-6, rel_tol=1e-4, abs_tol=1e-8)
    old = objectives.softkappa_rows(df, predicted_histogram=True).agg(F.avg("hess")).first()[0]
    assert math.isclose(old, 0.000125, rel_tol=1e-6)


def test_loss_derivatives(spark):
    df = spark.createDataFrame([(0.3, 1.0), (-1.2, -1.0), (2.0, 1.0)], "p double, y double")
    for kind in ("LS", "Expo", "Log", "LogRe2", "Logit"):
        at = lambda d: df.select(objectives.forest_loss(kind, F.col("p") + d, F.col("y"))).toPandas().iloc[:, 0].to_numpy()  # noqa: B023, E731
        d1, d2 = (df.select(c).toPandas().iloc[:, 0].to_numpy() for c in objectives.forest_derivatives(kind, F.col("p"), F.col("y")))
        assert np.allclose(d1, -(at(1e-5) - at(-1e-5)) / 2e-5, atol=1e-4) and np.allclose(d2, (at(1e-3) - 2 * at(0) + at(-1e-3)) / 1e-6, atol=1e-3)


def test_decode_edges(spark):
    df = spark.createDataFrame([(i, float(i // 2)) for i in range(100)], "id long, prediction double")
    counts = {r.score: r["count"] for r in decode.cdf_decode(df, [F.lit(c) for c in (0.0762, 0.2215, 0.3925)]).groupBy("score").count().collect()}
    assert counts == {1: 6, 2: 14, 3: 16, 4: 64}
    none = {r.score: r["count"] for r in decode.cdf_decode(df, [F.lit(c) for c in (0.0, 0.2215, 0.3925)]).groupBy("score").count().collect()}
    assert none == {2: 21, 3: 16, 4: 63}
    assert decode.cdf_decode(df.limit(0), [F.lit(0.1)] * 3).collect() == []


def test_kappas(spark):
    df = spark.createDataFrame([(a, a) for a in (1, 2, 3, 4, 4)], "a int, b int")
    for kind in metrics.PENALTIES:
        assert metrics.kappa(df, "a", "b", kind=kind).first().kappa == 1.0
    flat = spark.createDataFrame([(2, 2)] * 3, "a int, b int")
    assert metrics.kappa(flat, "a", "b").first().kappa is None
    a, b = R.integers(1, 5, 200), R.integers(1, 5, 200)
    d = np.subtract.outer(np.arange(5), np.arange(5)) ** 2
    want = 1 - 200 * ((a - b) ** 2).sum() / (d * np.outer(np.bincount(a, minlength=5), np.bincount(b, minlength=5))).sum()
    got = metrics.kappa(spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a int, b int"), "a", "b").first().kappa
    assert math.isclose(got, want) and math.isclose(got, ensemble._kappa(a, b))


def test_folds_are_stratified_and_repeatable(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).alias("s"))
    out = folds.stratified_folds(df, "s")
    per = out.groupBy("run", "s", "fold").count().groupBy("run", "s").agg((F.max("count") - F.min("count")).alias("d"))
    assert per.agg(F.max("d")).first()[0] <= 1 and out.count() == 300
    split = folds.splits(out)
    assert split.where("split = 'train'").count() == 300 and split.count() == 900


def test_ensemble_selection_never_falls(spark):
    rows = [(f"m{k}", 1, f, i, i % 4 + 1, float(i % 4 + R.normal() * k)) for k in (1, 2, 3) for f in (1, 2) for i in range(60)]
    preds = spark.createDataFrame(rows, "model string, run int, fold int, id long, target int, prediction double")
    cdfs = spark.createDataFrame([(1, f, [0.25, 0.5, 0.75]) for f in (1, 2)], "run int, fold int, cdf array<double>")
    got = ensemble.select_models(preds, cdfs, bags=2, top=1, tries=4, fraction=1.0).toPandas().sort_values(["bag", "step"])
    for _, g in got.groupby("bag"):
        assert (g.kappa.diff().dropna() > 0).all() and abs(g.weight.sum()) > 0 and g.model.iloc[0] == "m1"


@pytest.mark.parametrize("name", sorted(learners.CUSTOM))
def test_numpy_learners_beat_a_constant(name):
    y = np.clip(np.rint(2.5 + 1.2 * X[:, 0]), 1, 4)
    p = learners.CUSTOM[name](X[:200], y[:200], np.ones(200), {}, np.random.default_rng(1))(X[200:])
    assert np.corrcoef(p, y[200:])[0, 1] > 0.7


def test_search_draws():
    space = {"a": learners.Space("quniform", 0, 10, 2), "b": learners.Space("loguniform", -1, 1), "c": learners.Space("choice", options=("x", "y"))}
    one = learners.draw_trials(space, 20, whole=("a",))
    assert one == learners.draw_trials(space, 20, whole=("a",)) and all(t["a"] % 2 == 0 and t["c"] in "xy" and math.exp(-1) <= t["b"] <= math.e for t in one)
    assert learners.matching_models(["reg_a", "cls_b"], ["reg"]) == ["reg_a"]


def test_singular_values(spark):
    m = R.random((12, 6)) * (R.random((12, 6)) < 0.6)
    weights = spark.createDataFrame([(i, f"t{j}", float(m[i, j])) for i in range(12) for j in range(6) if m[i, j]], "row long, term string, weight double")
    terms = lsa.indexed_terms(weights.select("term").distinct())
    s, v = lsa.fit_svd(weights, terms, 3)
    assert np.allclose(s, np.linalg.svd(m, compute_uv=False)[:3])
    got = lsa.project(weights.withColumnRenamed("row", "id"), terms, v).orderBy("id").toPandas()
    assert np.allclose(np.abs(np.array(got.vector.tolist())), np.abs(m[got.id] @ np.linalg.svd(m)[2][:3].T))


def test_files(spark, tmp_path):
    t = lambda n: str(tmp_path / n)
    (tmp_path / "s.csv").write_text('id,query,product_title,product_description,median_relevance,relevance_variance\n1,a,"b, c",,4,0.5\n2,,x,"l1\nl2",1,0\n')
    got = formats.read_samples(spark, t("s.csv")).orderBy("id").collect()
    assert got[0].product_description == "" and got[0].product_title == "b, c" and got[1].query == "" and got[1].product_description == "l1\nl2"
    (tmp_path / "d.csv").write_text("#no,x\nmens,man\na,b\nmens,mam\n")
    assert formats.read_dictionary(spark, t("d.csv")) == {"mens": "mam", "a": "b"}
    df = spark.createDataFrame([(1, 2, "train", 5, [0.5, 0.0, 0.0], 3)], "run int, fold int, split string, id long, features array<double>, label int")
    formats.write_features(df, t("f"))
    assert formats.read_features(spark, t("f"), ["label"]).first().label == 3
    formats.write_libsvm(df, t("l"))
    back = formats.read_libsvm(spark, t("l"), 3).first()
    assert back.label == 3 and back.features.toArray().tolist() == [0.5, 0, 0]
    formats.write_vector(df.select("id", (F.col("id") / 3).alias("w")), "w", t("v"), "id")
    assert formats.read_vector(spark, t("v")).first().value == 1.666667
    preds = spark.createDataFrame([("m", 1, 1, 7, 2, 1.5)], "model string, run int, fold int, id long, target int, prediction double")
    formats.write_predictions(preds, t("p"))
    assert formats.read_predictions(spark, t("p")).select(*preds.columns).first() == preds.first()
    for k in (1, 2):
        formats.append_trials(spark.createDataFrame([(k, 0.5)], "trial int, kappa_mean double"), t("t"))
    assert spark.read.parquet(t("t")).count() == 2
    (tmp_path / "log").write_text("trial_counter,kappa_mean,kappa_std,eta,task\n1,0.6,0.01,0.1,reg\n")
    assert formats.read_trial_csv(spark, t("log")).first().params == {"eta": "0.1", "task": "reg"}
    (tmp_path / "empty").write_text("trial_counter,kappa_mean,kappa_std\n")
    assert formats.read_trial_csv(spark, t("empty")).count() == 0
    assert formats.feature_manifest(spark, ["count_of_x", "ratio"]).collect()[0].transform == "sqrt"


def test_forest_files(spark, tmp_path):
    t = lambda n: str(tmp_path / n)
    (tmp_path / "x").write_text("0 1.5 2\n3 0 0\n")
    (tmp_path / "xs").write_text("sparse 3\n1:1.5 2:2\n0:3\n")
    dense = formats.read_dense(spark, t("x"))
    assert dense.orderBy("index").collect() == formats.read_sparse(spark, t("xs")).orderBy("index").collect()
    (tmp_path / "bad").write_text("1 2\n1 2 3\n")
    (tmp_path / "twice").write_text("sparse 3\n1 1\n")
    (tmp_path / "far").write_text("sparse 3\n7:1\n")
    for read, n in ((formats.read_dense, "bad"), (formats.read_sparse, "twice"), (formats.read_sparse, "far")):
        with pytest.raises(ValueError):
            read(spark, t(n))
    (tmp_path / "w").write_text("1\n2\n")
    assert formats.with_weights(dense, formats.read_vector(spark, t("w"))).count() == 2
    with pytest.raises(ValueError):
        formats.with_weights(dense.limit(1), formats.read_vector(spark, t("w")))
    (tmp_path / "n").write_text("a\nb\nc\n")
    assert formats.read_feature_names(spark, t("n"), 3) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        formats.read_feature_names(spark, t("n"), 4)
    assert formats.merge_features([dense, dense]).select(F.size("features")).first()[0] == 6
    nodes = spark.createDataFrame(forest.train_arrays(X, Y, forest.ForestConfig(max_leaf_forest=5)), forest.NODES)
    name = formats.write_model(nodes, t("model"))
    assert name.endswith("-01") and formats.read_model(spark, name).count() == nodes.count()
    damaged = formats.write_model(nodes.where("node <> 1"), t("model"), 2)
    with pytest.raises(ValueError):
        formats.read_model(spark, damaged)
    report = metrics.binary_report(spark.createDataFrame([(1.0, 1.0), (-1.0, 1.0)], "p double, y double"), "p", "y")
    formats.write_evaluation(report, t("e"), 1, 5)
    assert spark.read.csv(t("e"), header=True).first().accuracy == "0.5"
    assert isinstance(nodes.toPandas(), pd.DataFrame)


def test_learners_predict_every_run_and_fold(spark):
    from sievemill.plans.q_models import QUERIES

    got = QUERIES["learner_svr"](spark, "/root/testdata/sf0.001").select("run", "fold").distinct().collect()
    assert sorted(map(tuple, got)) == [(run, fold) for run in (1, 2, 3) for fold in (1, 2, 3)]


def test_singular_values_make_their_rows_once(spark):
    m = R.random((300, 120)) * (R.random((300, 120)) < 0.2)
    seen = spark.sparkContext.accumulator(0)

    def read(x):
        seen.add(1)
        return x

    weights = spark.createDataFrame([(i, f"t{j:03}", float(m[i, j])) for i in range(300) for j in range(120) if m[i, j]], "row long, term string, weight double")
    terms = lsa.indexed_terms(weights.select("term").distinct()).persist()
    counted = spark.createDataFrame(weights.rdd.map(read), weights.schema)
    s, v = lsa.fit_svd(counted, terms, 20)
    assert np.allclose(s, np.linalg.svd(m, compute_uv=False)[:20]) and v.shape == (120, 20)
    assert seen.value <= 2 * weights.count()


def test_support_vectors_in_chunks(monkeypatch):
    y = 2.5 + X[:, 0]
    whole = learners.support_vectors(X[:200], y[:200], np.ones(200), {"dim": 20, "steps": 30}, np.random.default_rng(1))(X[200:])
    monkeypatch.setattr(learners, "LIFTED", 20 * 7)
    parts = learners.support_vectors(X[:200], y[:200], np.ones(200), {"dim": 20, "steps": 30}, np.random.default_rng(1))(X[200:])
    assert np.allclose(whole, parts, atol=1e-9)


def test_ensemble_selection_gives_the_kappa_of_what_it_chose(spark):
    x = {(f, k): np.array([i % 4 + 1 + R.normal() * k for i in range(50)]) for f in (1, 2) for k in (1, 2, 3)}
    rows = [(f"m{k}", 1, f, i, i % 4 + 1, float(x[f, k][i])) for f, k in x for i in range(50)]
    preds = spark.createDataFrame(rows, "model string, run int, fold int, id long, target int, prediction double").repartition(5)
    cdfs = spark.createDataFrame([(1, f, [0.25, 0.5, 0.75]) for f in (1, 2)], "run int, fold int, cdf array<double>")
    got = ensemble.select_models(preds, cdfs, bags=2, top=2, tries=3, fraction=1.0)
    assert not any("FlatMapGroupsInPandas" in line for line in got._jdf.queryExecution().toString().splitlines())
    y = np.arange(50) % 4 + 1
    for _, g in got.toPandas().sort_values(["bag", "step"]).groupby("bag"):
        for n in range(1, len(g) + 1):
            w, m = g.weight.to_numpy()[:n], [int(v[1]) for v in g.model[:n]]
            want = np.mean([ensemble._kappa(ensemble._decode(sum(a * x[f, k] for a, k in zip(w, m, strict=True)) / w.sum(), np.array([0.25, 0.5, 0.75])), y) for f in (1, 2)])
            assert abs(want - g.kappa.iloc[n - 1]) < 1e-9


def test_split_samples_are_cut_by_number(spark, tmp_path):
    from sievemill.plans import fixtures

    spark.range(30_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality", "cast(id % 3 = 0 as int) as toxic").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    out = fixtures.split_samples(spark, str(tmp_path))
    sizes = out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 9 * 30_000 and len(sizes) == 3 and max(sizes) < 120_000
