"""Queries that train, select and apply models, and round trips of their files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import boosted, decode, ensemble, folds, forest, growth, guided, learners, metrics
from ..sources.scratch import scratch
from .fixtures import MODELS_SQL, distributions, labelled, model_predictions, numeric_rows, read, samples, split_samples

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function by its name, with its SQL."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


SCAN = """rows AS (SELECT l_returnflag AS node, l_quantity AS value, 1 + l_linenumber / 10.0::DOUBLE AS w, l_discount - 0.05 AS r FROM lineitem),
per AS (SELECT node, value, sum(w) AS w, sum(w * r) AS wr, count(*) AS n FROM rows GROUP BY ALL),
run AS (SELECT node, value, sum(w) OVER u AS wl, sum(wr) OVER u AS rl, sum(n) OVER u AS nl, sum(w) OVER t AS wt, sum(wr) OVER t AS rt, sum(n) OVER t AS nt, lead(value) OVER (PARTITION BY node ORDER BY value) AS next FROM per WINDOW u AS (PARTITION BY node ORDER BY value ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY node)),
scan AS (SELECT node, (value + next) / 2 AS border, rl * rl / (wl + 10) + (rt - rl) * (rt - rl) / (wt - wl + 10) AS gain FROM run WHERE next IS NOT NULL AND nl >= 10 AND nt - nl >= 10)"""


def _scan(spark, sf) -> DataFrame:
    rows = read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("node"), F.lit(0).alias("feature"), F.col("l_quantity").alias("value"), (1 + F.col("l_linenumber") / 10.0).alias("w"), (F.col("l_discount") - 0.05).alias("r"))
    return forest.split_scan(rows, 10.0)


@query(f"WITH {SCAN} SELECT node, border, round(gain, 5) AS gain FROM scan")
def split_scan(spark, sf):
    """Gain of every split."""
    return _scan(spark, sf).select("node", "border", F.round("gain", 5).alias("gain"))


@query(f"WITH {SCAN} SELECT node, border, round(gain, 5) AS gain FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, border) AS k FROM scan) WHERE k = 1")
def best_split(spark, sf):
    """The best split of every node."""
    return forest.best_splits(_scan(spark, sf)).select("node", "border", F.round("gain", 5).alias("gain"))


@query("SELECT l_orderkey * 10 + l_linenumber AS id, round((x - 0.3 * p) / (w + 0.3) + p, 6) AS value, round(pow(x - 0.3 * p, 2) / (w + 0.3) + (0.3 - 0.6) * p * p / 2, 6) AS gain FROM (SELECT *, l_quantity AS w, l_discount * 100 - 5 AS x, l_tax AS p FROM lineitem)")
def leaf_gain(spark, sf):
    """Value and gain of a leaf."""
    rows = numeric_rows(spark, sf).select("id", F.col("features")[0].alias("w"), (F.col("features")[1] - 5).alias("x"), (F.col("features")[2] / 100).alias("p"))
    lam = F.lit(0.3)
    return rows.select("id", F.round(forest.leaf_value(F.col("w"), F.col("x"), lam, F.col("p")), 6).alias("value"), F.round(forest.split_gain(F.col("w"), F.col("x"), lam, F.col("p")), 6).alias("gain"))


@query("SELECT l_orderkey * 10 + l_linenumber AS id, CAST(CASE WHEN l_quantity <= 24.5 THEN 1 ELSE 2 END AS INT) AS node FROM lineitem")
def applied_split(spark, sf):
    """Rows moved to the children of a split."""
    rows = numeric_rows(spark, sf).select("id", "features").withColumn("node", F.lit(0))
    split = spark.createDataFrame([(0, 0, 24.5, 1, 2)], "node int, feature int, border double, le int, gt int")
    return forest.apply_split(rows, split).select("id", "node")


@query("SELECT l_orderkey * 10 + l_linenumber AS id, round(l_extendedprice / 10000 - (SELECT avg(l_extendedprice / 10000) FROM lineitem), 6) AS target FROM lineitem")
def centred_target(spark, sf):
    """Targets without their mean, as residuals of the constant."""
    rows = numeric_rows(spark, sf).select("id", "y")
    mean = rows.agg(F.avg("y").alias("m"))
    return rows.crossJoin(F.broadcast(mean)).select("id", F.round(F.col("y") - F.col("m"), 6).alias("target"))


# A small hand-made forest (tree, node, border, weight, feature, le, gt, parent).
SMALL = [(0, 0, 24.5, 0.0, 0, 1, 2, -1), (0, 1, 4.5, 0.0, 1, 3, 4, 0), (0, 2, 0.0, 2.5, -1, -1, -1, 0), (0, 3, 0.0, -0.5, -1, -1, -1, 1), (0, 4, 0.0, 0.75, -1, -1, -1, 1), (1, 0, 3.5, 0.0, 3, 1, 2, -1), (1, 1, 0.0, 0.125, -1, -1, -1, 0), (1, 2, 0.0, -0.25, -1, -1, -1, 0)]
SMALL_SQL = "CASE WHEN l_quantity <= 24.5 THEN CASE WHEN l_discount * 100 <= 4.5 THEN -0.5::DOUBLE ELSE 0.75 END ELSE 2.5 END + CASE WHEN l_linenumber <= 3.5 THEN 0.125::DOUBLE ELSE -0.25 END"


def _small(spark) -> DataFrame:
    return spark.createDataFrame(SMALL, forest.NODES)


@query(f"SELECT l_orderkey * 10 + l_linenumber AS id, {SMALL_SQL} AS prediction FROM lineitem")
def forest_prediction(spark, sf):
    """A forest as one column."""
    return numeric_rows(spark, sf).select("id", forest.predict_expression(_small(spark).collect()).alias("prediction"))


@query(f"SELECT l_orderkey * 10 + l_linenumber AS id, {SMALL_SQL} AS prediction FROM lineitem")
def forest_prediction_batches(spark, sf):
    """The same forest by Arrow batches."""
    return forest.predict(numeric_rows(spark, sf).select("id", "features"), _small(spark).toPandas()).select("id", "prediction")


@query("SELECT CAST(r AS BIGINT) AS rule, count(*) AS n FROM (SELECT unnest([CASE WHEN l_quantity <= 24.5 THEN CASE WHEN l_discount * 100 <= 4.5 THEN 3 ELSE 4 END ELSE 2 END, CASE WHEN l_linenumber <= 3.5 THEN 6 ELSE 7 END]) AS r FROM lineitem) GROUP BY r")
def leaf_features(spark, sf):
    """How often each leaf is reached."""
    rows = forest.predict(numeric_rows(spark, sf).select("id", "features"), _small(spark).toPandas(), leaves=True)
    return rows.select(F.explode("rules").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


RULES = {"x0<=24.5000 & x1<=4.50000": "l_quantity <= 24.5 AND l_discount * 100 <= 4.5", "x0<=24.5000 & x1>4.50000": "l_quantity <= 24.5 AND l_discount * 100 > 4.5", "x0>24.5000": "l_quantity > 24.5", "x3<=3.50000": "l_linenumber <= 3.5", "x3>3.50000": "l_linenumber > 3.5"}


@query(" UNION ALL ".join(f"SELECT '{rule}' AS rule, CAST(2 AS BIGINT) AS n, count(*) AS n_rows FROM lineitem WHERE {where}" for rule, where in RULES.items()))
def rule_counts(spark, sf):
    """Leaves that are the same rule, in a forest that has each tree twice, and the lines that reach one."""
    import pandas as pd

    nodes = pd.DataFrame(SMALL + [(t + 2, *rest) for t, *rest in SMALL], columns=[x.split()[0] for x in forest.NODES.split(", ")])
    registry = forest.registered(nodes)
    rows = forest.rule_features(numeric_rows(spark, sf).select("id", "features"), nodes, registry)
    reached = rows.select(F.explode(F.map_keys("rules")).alias("id")).groupBy("id").agg(F.count("*").alias("n_rows"))
    ids = spark.createDataFrame([(int(r.id), int(r.tree), int(r.node)) for r in registry.itertuples()], "id int, tree int, node int")
    table = spark.createDataFrame([tuple(x) for x in nodes.itertuples(index=False, name=None)], forest.NODES)
    named = forest.rules(table).join(ids, ["tree", "node"]).join(reached, "id").groupBy("rule").agg(F.max("n_rows").alias("n_rows"))
    return forest.rule_counts(table).join(named, "rule")


# The small forest after its node 2 was split again.
AGAIN = [(0, 2, 3.5, 0.0, 2, 5, 6, 0) if (t, k) == (0, 2) else (t, k, *rest) for t, k, *rest in SMALL] + [(0, 5, 0.0, 1.5, -1, -1, -1, 2), (0, 6, 0.0, 3.0, -1, -1, -1, 2)]


@query("""SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_quantity <= 24.5 THEN CASE WHEN l_discount * 100 <= 4.5 THEN '1 ' ELSE '2 ' END || CASE WHEN l_linenumber <= 3.5 THEN '3' ELSE '4' END
ELSE CASE WHEN l_linenumber <= 3.5 THEN '3 ' ELSE '4 ' END || CASE WHEN l_tax * 100 <= 3.5 THEN '5' ELSE '6' END END AS rules FROM lineitem""")
def rule_features(spark, sf):
    """Rules that hold for each line, by ids that survive another split of the forest."""
    import pandas as pd

    names = [x.split()[0] for x in forest.NODES.split(", ")]
    before, after = pd.DataFrame(SMALL, columns=names), pd.DataFrame(AGAIN, columns=names)
    rows = forest.rule_features(numeric_rows(spark, sf).select("id", "features"), after, forest.registered(after, forest.registered(before)))
    return rows.select("id", F.array_join(F.map_keys("rules"), " ").alias("rules"))


@query(f"SELECT l_orderkey * 10 + l_linenumber AS id, unnest(['both', 'first', 'second']) AS model, unnest([{SMALL_SQL}, {SMALL_SQL.partition(' END + ')[0]} END, {SMALL_SQL.partition(' END + ')[2]}]) AS prediction FROM lineitem")
def forest_batch_prediction(spark, sf):
    """Predictions of three forests in one pass over the lines."""
    nodes = _small(spark).toPandas()
    models = {"both": nodes, "first": nodes[nodes["tree"] == 0], "second": nodes[nodes["tree"] == 1]}
    return forest.predict_models(numeric_rows(spark, sf).select("id", "features"), models).select("id", "model", "prediction")


@query()
def forest_training(spark, sf):
    """One forest on all order lines, grown round by round over the cluster, and its nodes."""
    rows = numeric_rows(spark, sf).select("features", "y")
    return growth.grow_forest(rows, forest.ForestConfig.parse("max_leaf_forest=20,opt_interval=10,NormalizeTarget,reg_L2=0.001"))


def _tested(algorithm: str):
    def run(spark, sf):
        rows = numeric_rows(spark, sf).select("id", "features", "y")
        config = forest.ForestConfig.parse(f"algorithm={algorithm},max_leaf_forest=9,opt_interval=3,test_interval=3,NormalizeTarget,reg_L2=0.001,reg_depth=1.2")
        return growth.train_test(rows.where("id % 3 <> 0").drop("id"), rows.where("id % 3 = 0").drop("id"), config)[1]

    run.__doc__ = f"Tests of a forest on a third of the lines while it grows on the others, under the penalty {algorithm}."
    return run


for _name in ("RGF_Opt", "RGF_Sib"):
    QUERIES[f"forest_test_{_name[4:].lower()}"] = _tested(_name)


def _documents(spark, sf) -> DataFrame:
    """id, x (four numbers) of all documents."""
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "n_chars")
    words = F.size(F.split("text", " "))
    marks = F.length("text") - F.length(F.regexp_replace("text", "[!#$%&*|]", ""))
    capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]", ""))
    features = F.array(F.log1p(F.col("n_chars").cast("double")), F.log1p(words.cast("double")), marks / F.greatest(F.col("n_chars"), F.lit(1)), capitals / F.greatest(F.col("n_chars"), F.lit(1)))
    return docs.select("id", features.alias("x"))


def _learner_rows(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = labelled(spark, sf).join(_documents(spark, sf), "id")
    rows = rows.select("id", F.col("relevance").cast("double").alias("label"), (1 - F.col("variance") / 2).alias("weight"), "x")
    rows = rows.withColumn("features", array_to_vector("x"))
    train = rows.where("id % 3 = 0")
    return train, rows.where("id % 3 <> 0")


@query()
def refit_predictions(spark, sf):
    """A learner fitted on all labelled documents: raw prediction, rank and rating of all others, rated by the labels' shares."""
    train, valid = _learner_rows(spark, sf)
    known = train.unionByName(valid)
    rest = _documents(spark, sf).join(known.select("id"), "id", "left_anti")
    return learners.refit("reg_linear", known, rest, {"rounds": 20})


def _built_in(name: str, shift: float = 0.0, **params):
    def run(spark, sf):
        train, valid = _learner_rows(spark, sf)
        if shift:
            train = train.withColumn("label", F.col("label") - shift)
        if name == "logistic":
            train = learners.balanced_weights(train)
        out = learners.fit_predict(name, train, valid, params)
        return out.select("id", F.col("label").cast("int").alias("target"), (F.col("prediction") + shift).alias("prediction"))

    run.__doc__ = f"Validation predictions of the learner {name}."
    return run


for _name, _params in {"reg_linear": {}, "softmax": {}, "soft_kappa": {"eta": 0.1}, "ridge": {"reg": 1.0}, "lasso": {"reg": 0.05}, "reg_tree": {"rounds": 5, "depth": 3}, "gbm": {"rounds": 5, "depth": 3}, "forest": {"trees": 5, "depth": 4}, "factorization": {"k": 2, "iterations": 10}, "cocr": {}, "ebc": {}}.items():
    QUERIES[f"learner_{_name}"] = _built_in(_name, **_params)
QUERIES["learner_logistic"] = _built_in("logistic", 1.0)


@query()
def learner_ranking(spark, sf):
    """A logistic model of feature differences within languages scores the documents."""
    train, valid = _learner_rows(spark, sf)
    group = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    w = learners.rank_fit(train.join(group, "id").select("id", "lang", "label", F.col("x").alias("features")), "lang")
    score = sum((F.col("x")[i] * c for i, c in enumerate(w)), F.lit(0.0))
    return valid.select("id", F.col("label").cast("int").alias("target"), score.alias("prediction"))


def _folded(spark, sf) -> DataFrame:
    train, valid = _learner_rows(spark, sf)
    rows = train.unionByName(valid).select("id", "label", "weight", F.col("x").alias("features"))
    return rows.join(split_samples(spark, sf).select("run", "fold", "split", "id"), "id")


def _custom(name: str, **params):
    def run(spark, sf):
        return learners.cross_predict(_folded(spark, sf), name, params, bag=0.9)

    run.__doc__ = f"Validation predictions of the learner {name}, one fit per fold."
    return run


for _name, _params in {"extra_trees": {"trees": 5}, "svr": {"steps": 50}, "neural_net": {"steps": 50}}.items():
    QUERIES[f"learner_{_name}"] = _custom(_name, **_params)


@query()
def parameter_search(spark, sf):
    """Kappa over the folds of the first run of guided trials of the boosted linear learner, each fold fitted on all its rows."""
    rows = _folded(spark, sf).where("run = 1").persist()
    dist = distributions(split_samples(spark, sf)).where("run = 1").select("fold", "cdf")
    space = {"eta": learners.Space("quniform", 0.1, 1.0, 0.1), "l1": learners.Space("loguniform", -4, 2), "l2": learners.Space("loguniform", -4, 4)}
    held = [r.fold for r in rows.select("fold").distinct().orderBy("fold").collect()]

    def evaluate(batch: list[dict]) -> list[tuple[float, float]]:
        parts = []
        for trial, params in enumerate(batch):
            for fold in held:
                own = rows.where(F.col("fold") == fold)
                model = boosted.fit(own.where("split = 'train'"), "squared", rounds=10, **params)
                valid = boosted.predict(own.where("split = 'valid'"), model, "squared")
                parts.append(valid.select(F.lit(trial).alias("trial"), "fold", "id", F.col("label").cast("int").alias("target"), "prediction"))
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        scored = decode.cdf_decode(every.join(dist, "fold"), [F.col("cdf")[i] for i in range(3)], ("trial", "fold"))
        k = metrics.kappa(scored, "score", "target", keys=("trial", "fold"))
        found = {r.trial: (r.m, r.s) for r in k.groupBy("trial").agg(F.avg("kappa").alias("m"), F.stddev_pop("kappa").alias("s")).collect()}
        return [found.get(t, (float("nan"), float("nan"))) for t in range(len(batch))]

    log = guided.search(spark, space, evaluate, scratch(spark, "trials"), 6, batch=3, startup=3)
    rows.unpersist()
    return log.select("trial", "kappa_mean", "kappa_std", F.array_join(F.transform(F.array_sort(F.map_entries("params")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("params"))


@query()
def ensemble_selection(spark, sf):
    """Bagged greedy selection among eight models, until no model raises the mean kappa."""
    split = split_samples(spark, sf)
    return ensemble.select_models(model_predictions(split), distributions(split), bags=10, top=5, tries=10)


@query(f"""WITH {MODELS_SQL}, chosen AS (SELECT * FROM (VALUES (0, 'm1', 1.0::DOUBLE), (0, 'm2', 0.5::DOUBLE), (1, 'm3', 1.0::DOUBLE)) v(bag, model, weight)),
b AS (SELECT bag, id * 100 + run * 10 + fold AS id, sum(weight * prediction) / sum(weight) AS prediction FROM predictions JOIN chosen USING (model) GROUP BY ALL), m AS (SELECT id, avg(prediction) AS prediction FROM b GROUP BY id),
r AS (SELECT *, row_number() OVER (ORDER BY prediction, id) - 1 AS rk, count(*) OVER () AS n FROM m)
SELECT id, round(prediction, 6) AS prediction, CAST(CASE WHEN rk < floor(n * 0.1::DOUBLE - 1) THEN 1 WHEN rk >= floor(n * 0.1::DOUBLE) AND rk < floor(n * 0.2::DOUBLE - 1) THEN 2 WHEN rk >= floor(n * 0.2::DOUBLE) AND rk < floor(n * 0.9::DOUBLE - 1) THEN 3 ELSE 4 END AS INT) AS score FROM r""")
def ensemble_application(spark, sf):
    """Ratings of a chosen ensemble, of all runs and folds."""
    test = model_predictions(split_samples(spark, sf)).select("model", (F.col("id") * 100 + F.col("run") * 10 + F.col("fold")).alias("id"), "prediction")
    chosen = spark.createDataFrame([(0, "m1", 1.0), (0, "m2", 0.5), (1, "m3", 1.0)], "bag int, model string, weight double")
    return ensemble.apply_ensemble(test, chosen, [0.1, 0.2, 0.9]).withColumn("prediction", F.round("prediction", 6))


@query(f"""WITH {MODELS_SQL}, chosen AS (SELECT * FROM (VALUES (0, 'm1', 1.0::DOUBLE), (0, 'm2', 0.5::DOUBLE), (1, 'm3', 1.0::DOUBLE)) v(bag, model, weight)),
b AS (SELECT bag, id * 100 + run * 10 + fold AS id, sum(weight * prediction) / sum(weight) AS prediction FROM predictions JOIN chosen USING (model) GROUP BY ALL), m AS (SELECT id, avg(prediction) AS prediction FROM b GROUP BY id)
SELECT id, round(prediction, 6) AS prediction, CAST(CASE WHEN prediction <= 1.4 THEN 1 WHEN prediction <= 2.6 THEN 2 WHEN prediction <= 3.3 THEN 3 ELSE 4 END AS INT) AS score FROM m""")
def ensemble_by_cutoffs(spark, sf):
    """Ratings of a chosen ensemble by cutoffs of its predictions."""
    test = model_predictions(split_samples(spark, sf)).select("model", (F.col("id") * 100 + F.col("run") * 10 + F.col("fold")).alias("id"), "prediction")
    chosen = spark.createDataFrame([(0, "m1", 1.0), (0, "m2", 0.5), (1, "m3", 1.0)], "bag int, model string, weight double")
    return ensemble.apply_ensemble(test, chosen, [], cutoffs=[1.4, 2.6, 3.3]).withColumn("prediction", F.round("prediction", 6))


@query(f"""WITH {MODELS_SQL}, r AS (SELECT prediction, row_number() OVER (PARTITION BY model, run, fold ORDER BY prediction, id) - 1 AS rk, count(*) OVER (PARTITION BY model, run, fold) AS n FROM predictions), k AS (SELECT * FROM (VALUES (1, 0.1::DOUBLE), (2, 0.2::DOUBLE), (3, 0.9::DOUBLE)) v(k, c))
SELECT k, round(avg(prediction) * 1.5, 6) AS cutoff FROM r, k WHERE rk = (CAST(trunc(n * c - 1) AS BIGINT) % n + n) % n GROUP BY k""")
def cutoff_rescaling(spark, sf):
    """Mean cutoffs of all models' runs and folds, scaled to a test set."""
    parts = decode.cutoffs(model_predictions(split_samples(spark, sf)), [0.1, 0.2, 0.9], keys=("model", "run", "fold"))
    return ensemble.rescaled_cutoffs(parts, 300, 200).withColumn("cutoff", F.round("cutoff", 6))


@query(f"""WITH x AS (SELECT doc_id AS id, (doc_id % {folds.MODULUS} * 48271 + 2015) % {folds.MODULUS} AS x FROM documents), u AS (SELECT id, CAST((x * x % {folds.MODULUS} * 16807 + 2015) % {folds.MODULUS} AS DOUBLE) / {float(folds.MODULUS)}::DOUBLE AS u FROM x)
SELECT id, CAST({' + '.join(f'CAST(u >= {s!r}::DOUBLE AS INT)' for s in folds.SHARES)} AS BIGINT) AS copies FROM u""")
def bootstrap_sample(spark, sf):
    """How often a bootstrap takes each document; 0 for those out of bag."""
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    taken = folds.bootstrap(docs, 2015).groupBy("id").agg(F.count("*").alias("copies"))
    return taken.unionByName(folds.out_of_bag(docs, 2015).withColumn("copies", F.lit(0).cast("long")))


@query()
def feature_manifests(spark, sf):
    """The four feature sets with each feature's transform."""
    from .feature_sets import manifest

    out = None
    for name in ("low_1", "low_2", "low_3", "high"):
        part = manifest(spark, name).withColumn("set", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def _feature_set(name: str):
    def run(spark, sf):
        from .feature_sets import feature_matrix

        rows, width = feature_matrix(samples(spark, sf), name)
        cells = F.transform(F.array_sort(F.map_entries("features")), lambda e: F.concat_ws(":", (e["key"] + 1).cast("string"), F.round(e["value"], 6).cast("string")))
        return rows.select("id", "label", F.lit(width).alias("width"), F.size("features").alias("n_values"), F.array_join(cells, " ").alias("features"))

    run.__doc__ = f"All features of the set {name} for all samples, as `place:value`."
    return run


for _name in ("low_1", "low_2", "low_3", "high"):
    QUERIES[f"feature_set_{_name}"] = _feature_set(_name)
