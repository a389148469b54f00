"""Queries on folds, distributions, decoding, agreement and objectives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import decode, ensemble, folds, metrics, objectives
from .fixtures import MODELS_SQL, distributions, labelled, model_predictions, read, split_samples

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

LABELLED = "labelled AS (SELECT doc_id AS id, CAST(1 + 2 * quality + toxic AS INT) AS relevance, CAST(doc_id % 7 AS DOUBLE) / 7 AS variance FROM labels)"


def query(sql: str | None = None):
    """Register a function by its name, with its SQL."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS index, 1 AS relevance FROM documents")
def row_numbers(spark, sf):
    """A constant label and the place of each document."""
    return folds.row_index(read(spark, sf, "documents").select("doc_id"), "doc_id").withColumn("relevance", F.lit(1))


@query("WITH " + LABELLED + " SELECT id, " + ", ".join(f"CAST(relevance = {k} AS INT) AS relevance_{k}" for k in (1, 2, 3, 4)) + " FROM labelled")
def one_hot_labels(spark, sf):
    """A column for each class."""
    return folds.one_hot_labels(labelled(spark, sf), "relevance").drop("relevance", "variance")


@query("WITH d AS (SELECT source, row_number() OVER (ORDER BY source) AS qid FROM (SELECT DISTINCT source FROM documents WHERE lang = 'en' AND source < 'src7')) SELECT doc_id, qid FROM documents LEFT JOIN d USING (source)")
def dictionary_codes(spark, sf):
    """Codes of the sources among some of them; null for others."""
    docs = read(spark, sf, "documents").select("doc_id", "source", "lang")
    return folds.encode(docs, folds.dictionary(docs.where("lang = 'en' and source < 'src7'"), "source"), "source").select("doc_id", "qid")


FOLDED = "folded AS (SELECT r.run, l.id, l.relevance, l.variance, CAST((row_number() OVER (PARTITION BY r.run, l.relevance ORDER BY (l.id * 7919 + 2015 + 1000 * r.run) % 10007, l.id) - 1) % 3 + 1 AS INT) AS fold FROM labelled l, (SELECT CAST(unnest([1, 2, 3]) AS INT) AS run) r)"
SPLIT = f"{LABELLED}, {FOLDED}, split AS (SELECT f.run, h.fold, f.id, f.relevance, f.variance, CASE WHEN f.fold = h.fold THEN 'train' ELSE 'valid' END AS split FROM folded f JOIN (SELECT DISTINCT run, fold FROM folded) h ON h.run = f.run)"


@query(f"WITH {LABELLED}, {FOLDED} SELECT run, id, fold FROM folded")
def stratified_folds(spark, sf):
    """Three runs of three stratified folds."""
    return folds.stratified_folds(labelled(spark, sf), "relevance").select("run", "id", "fold")


@query(f"WITH {SPLIT} SELECT run, fold, split, id FROM split")
def fold_splits(spark, sf):
    """Training third and validation rest of every fold."""
    return split_samples(spark, sf).select("run", "fold", "split", "id")


@query(f"WITH {LABELLED} SELECT relevance, array_to_string(list(id ORDER BY id), ',') AS members FROM labelled GROUP BY relevance")
def group_index(spark, sf):
    """Ids of each class."""
    return folds.index_lists(labelled(spark, sf), ["relevance"]).select("relevance", F.array_join(F.transform("members", lambda i: i.cast("string")), ",").alias("members"))


@query(f"WITH {SPLIT} SELECT run, fold, split, count(*) AS n FROM split GROUP BY ALL")
def group_sizes(spark, sf):
    """Rows of every split."""
    return split_samples(spark, sf).groupBy("run", "fold", "split").agg(F.count("*").alias("n"))


@query(f"WITH {LABELLED} SELECT CAST(k AS INT) AS relevance, count(id) AS n FROM (SELECT unnest([1, 2, 3, 4, 5]) AS k) LEFT JOIN labelled ON relevance = k GROUP BY k")
def label_histogram(spark, sf):
    """Class counts, empty classes with 0."""
    return folds.histogram(labelled(spark, sf), "relevance", 1, 5)


@query(f"WITH {SPLIT} SELECT run, fold, CAST(k AS INT) AS relevance, round(avg(CASE WHEN relevance <= k THEN 1.0 ELSE 0.0 END), 6) AS cdf FROM split, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE split = 'train' GROUP BY run, fold, k")
def empirical_cdf(spark, sf):
    """Distribution of the training rows of every fold."""
    train = split_samples(spark, sf).where("split = 'train'")
    keys = ("run", "fold")
    return folds.cdf(folds.histogram(train, "relevance", keys=keys), "relevance", keys).withColumn("cdf", F.round("cdf", 6))


@query(f"WITH {SPLIT}, c AS (SELECT run, fold, k, avg(CASE WHEN relevance <= k THEN 1.0 ELSE 0.0 END) AS cdf FROM split, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE split = 'train' GROUP BY run, fold, k), m AS (SELECT k, avg(cdf) AS c FROM c GROUP BY k) SELECT CAST(k AS INT) AS relevance, round(c - lag(c, 1, 0.0) OVER (ORDER BY k), 6) AS pdf FROM m")
def class_pdf(spark, sf):
    """Differences of the mean distribution."""
    train, keys = split_samples(spark, sf).where("split = 'train'"), ("run", "fold")
    return folds.pdf(folds.cdf(folds.histogram(train, "relevance", keys=keys), "relevance", keys), "relevance").withColumn("pdf", F.round("pdf", 6))


@query(f"WITH {SPLIT}, m AS (SELECT run, fold, max(sqrt(variance)) AS m FROM split WHERE split = 'train' GROUP BY ALL) SELECT run, fold, split, id, round(CASE WHEN m > 0 THEN (1 + (m - sqrt(variance)) / m) / 2 ELSE 1.0 END, 6) AS weight FROM split JOIN m USING (run, fold)")
def sample_weights(spark, sf):
    """Weights that fall with the raters' variance."""
    return folds.sample_weights(split_samples(spark, sf)).select("run", "fold", "split", "id", F.round("weight", 6).alias("weight"))


@query("SELECT doc_id, CAST(ntile(7) OVER (ORDER BY doc_id) AS INT) AS fold FROM documents")
def contiguous_folds(spark, sf):
    """Seven runs of documents."""
    return folds.contiguous_folds(read(spark, sf, "documents").select("doc_id"), "doc_id", 7)


@query("SELECT doc_id, CAST(ntile(7) OVER (ORDER BY (doc_id * 7919 + 42) % 10007, doc_id) AS INT) AS fold FROM documents")
def shuffled_folds(spark, sf):
    """Seven runs of documents in a shuffled order."""
    return folds.contiguous_folds(read(spark, sf, "documents").select("doc_id"), "doc_id", 7, seed=42)


@query("SELECT doc_id AS id, (doc_id * 104729 + 2015) % 10007 < 0.7 * 10007 AS chosen FROM documents")
def random_subset(spark, sf):
    """A seeded sample and its complement."""
    return folds.subset(read(spark, sf, "documents").select(F.col("doc_id").alias("id")), 0.7, 2015)




def _part(spark, sf):
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("prediction"))


@query(f"WITH q AS (SELECT p_partkey AS id, p_retailprice AS prediction FROM part) SELECT id, row_number() OVER (ORDER BY prediction, id) - 1 AS rank FROM q")
def ordinal_rank(spark, sf):
    """Unique ranks."""
    return decode.ordinal_rank(_part(spark, sf)).select("id", "rank")


# Shares of the four classes, summed up.
CDF = [0.0762, 0.2215, 0.3925]
RANKED = "r AS (SELECT id, prediction, row_number() OVER (ORDER BY prediction, id) - 1 AS rk, count(*) OVER () AS n FROM q)"
DECODED = f"CASE WHEN rk < floor(n * {CDF[0]} - 1) THEN 1 WHEN rk >= floor(n * {CDF[0]}) AND rk < floor(n * {CDF[1]} - 1) THEN 2 WHEN rk >= floor(n * {CDF[1]}) AND rk < floor(n * {CDF[2]} - 1) THEN 3 ELSE 4 END"


@query(f"WITH q AS (SELECT p_partkey AS id, p_retailprice AS prediction FROM part), {RANKED} SELECT id, CAST({DECODED} AS INT) AS score FROM r")
def cdf_decode(spark, sf):
    """Ratings by rank and distribution."""
    return decode.cdf_decode(_part(spark, sf), [F.lit(c) for c in CDF]).select("id", "score")


@query(f"WITH q AS (SELECT p_partkey AS id, p_retailprice AS prediction FROM part), {RANKED} SELECT id, CAST(CASE WHEN rk < floor(n * {CDF[0]}) THEN 1 WHEN rk < floor(n * {CDF[1]}) THEN 2 WHEN rk < floor(n * {CDF[2]}) THEN 3 ELSE 4 END AS INT) AS score FROM r")
def cdf_decode_gapless(spark, sf):
    """Ratings without the published gaps."""
    return decode.cdf_decode(_part(spark, sf), [F.lit(c) for c in CDF], gapless=True).select("id", "score")


CUTS = f"cuts AS (SELECT k, prediction AS cutoff FROM r JOIN (SELECT unnest([1, 2, 3]) AS k, unnest([{', '.join(map(str, CDF))}]) AS c) ON rk = CAST(floor(n * c - 1) AS BIGINT))"


@query(f"WITH q AS (SELECT p_partkey AS id, p_retailprice AS prediction FROM part), {RANKED}, {CUTS} SELECT CAST(k AS INT) AS k, cutoff FROM cuts")
def cdf_cutoffs(spark, sf):
    """Predictions at the classes' last ranks."""
    return decode.cutoffs(_part(spark, sf), CDF)


@query("SELECT p_partkey AS id, CAST(CASE WHEN p_retailprice <= 950 THEN 1 WHEN p_retailprice <= 1200 THEN 2 WHEN p_retailprice <= 1500 THEN 3 ELSE 4 END AS INT) AS score FROM part")
def cutoff_decode(spark, sf):
    """Ratings by cutoffs."""
    return _part(spark, sf).select("id", decode.cutoff_decode(F.col("prediction"), [950, 1200, 1500]).alias("score"))


@query("SELECT p_partkey AS id, CAST(greatest(round_even(p_retailprice / 500 - 2, 0), 1) AS INT) AS rounded, CAST(greatest(ceil(p_retailprice / 500 - 2), 1) AS INT) AS raised FROM part")
def simple_decoders(spark, sf):
    """Rounded and raised ratings."""
    p = F.col("prediction") / 500 - 2
    return _part(spark, sf).select("id", decode.round_decode(p).alias("rounded"), decode.ceil_decode(p).alias("raised"))


P4 = "[sin(CAST(p_partkey AS DOUBLE)), cos(CAST(p_partkey AS DOUBLE)), sin(2.0::DOUBLE * p_partkey), cos(3.0::DOUBLE * p_partkey)]"


def _p4(spark, sf):
    k = F.col("p_partkey").cast("double")
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array(F.sin(k), F.cos(k), F.sin(2.0 * k), F.cos(3.0 * k)).alias("p"))


@query(f"WITH v AS (SELECT p_partkey AS id, {P4} AS p FROM part), e AS (SELECT id, p, list_transform(p, lambda x: exp(x - list_max(p))) AS e FROM v) SELECT id, round(list_sum(list_transform(e, lambda x, i: x / list_sum(e) * i)), 6) AS expected, round(1 / (1 + exp(-p[1])), 6) AS sigmoid FROM e")
def expected_rating(spark, sf):
    """Softmax, its expected class, and a sigmoid."""
    rows = _p4(spark, sf)
    return rows.select("id", F.round(decode.expected_value(arrays.softmax(F.col("p"))), 6).alias("expected"), F.round(arrays.sigmoid(F.col("p")[0]), 6).alias("sigmoid"))


@query(f"WITH v AS (SELECT p_partkey AS id, {P4} AS p FROM part) SELECT id, round(1 + p[1] + p[2] + p[3], 6) AS soft, CAST(1 + CAST(p[1] > 0 AS INT) + CAST(p[2] > 0 AS INT) + CAST(p[3] > 0 AS INT) AS DOUBLE) AS hard, round(1 + list_sum(p), 6) AS total FROM v")
def threshold_rules(spark, sf):
    """Ratings from thresholds, soft and hard, and from sums."""
    p = F.col("p")
    return _p4(spark, sf).select("id", F.round(decode.ebc_rule(p), 6).alias("soft"), decode.ebc_rule(p, hard=True).alias("hard"), F.round(decode.cocr_rule(p), 6).alias("total"))


R2 = "rated AS (SELECT l_returnflag AS g, CAST(l_linenumber % 4 + 1 AS INT) AS a, CAST((l_linenumber + l_orderkey % 3) % 4 + 1 AS INT) AS b FROM lineitem)"


def _rated(spark, sf):
    n = F.col("l_linenumber")
    return read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), (n % 4 + 1).cast("int").alias("a"), ((n + F.col("l_orderkey") % 3) % 4 + 1).cast("int").alias("b"))


@query(f"WITH {R2}, k AS (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS INT) AS v) SELECT x.v AS a, y.v AS b, count(r.a) AS n FROM k x CROSS JOIN k y LEFT JOIN rated r ON r.a = x.v AND r.b = y.v GROUP BY x.v, y.v")
def confusion_matrix(spark, sf):
    """Counts of all pairs of ratings."""
    return metrics.confusion_matrix(_rated(spark, sf), "a", "b", 1, 5)


def _kappa_sql(cost: str) -> str:
    return f"""WITH {R2}, o AS (SELECT g, CAST(count(*) AS DOUBLE) AS n, CAST(sum({cost}) AS DOUBLE) AS o FROM rated GROUP BY g),
ha AS (SELECT g, a, count(*) AS na FROM rated GROUP BY ALL), hb AS (SELECT g, b, count(*) AS nb FROM rated GROUP BY ALL),
e AS (SELECT ha.g, sum(({cost}) * CAST(na AS DOUBLE) * nb) AS e FROM ha JOIN hb ON ha.g = hb.g GROUP BY ha.g)
SELECT o.g, round(1 - n * o / e, 6) AS kappa FROM o JOIN e ON o.g = e.g"""


def _kappa(spark, sf, kind):
    return metrics.kappa(_rated(spark, sf), "a", "b", kind=kind, keys=("g",)).withColumn("kappa", F.round("kappa", 6))


@query(_kappa_sql("(a - b) * (a - b)"))
def quadratic_kappa(spark, sf):
    """Quadratic weighted agreement by group."""
    return _kappa(spark, sf, "quadratic")


@query(_kappa_sql("abs(a - b)"))
def linear_kappa(spark, sf):
    """Linear weighted agreement by group."""
    return _kappa(spark, sf, "linear")


@query(_kappa_sql("CAST(a <> b AS INT)"))
def unweighted_kappa(spark, sf):
    """Plain agreement by group."""
    return _kappa(spark, sf, "unweighted")


@query(f"WITH k AS ({_kappa_sql('(a - b) * (a - b)')}), z AS (SELECT 0.5 * ln((1 + k) / (1 - k)) AS z, w FROM (SELECT least(greatest(kappa, -0.999), 0.999) AS k, CAST(ascii(g) AS DOUBLE) AS w FROM k)) SELECT round((exp(2 * sum(z * w) / sum(w)) - 1) / (exp(2 * sum(z * w) / sum(w)) + 1), 5) AS mean_kappa FROM z")
def mean_kappa(spark, sf):
    """Weighted mean by Fisher's z."""
    per = metrics.kappa(_rated(spark, sf), "a", "b", keys=("g",)).withColumn("kappa", F.round("kappa", 6))
    return per.agg(F.round(metrics.mean_kappa(F.col("kappa"), F.ascii("g").cast("double")), 5).alias("mean_kappa"))


GRADED = "rated AS (SELECT lang AS g, CAST(doc_id % 4 + 1 AS INT) AS a, CAST((doc_id * 3 + doc_id % 5) % 4 + 1 AS INT) AS b FROM documents)"
GROUPS = _kappa_sql("(a - b) * (a - b)").replace(R2, GRADED).replace("round(1 - n * o / e, 6)", "1 - n * o / e")


@query(f"WITH k AS ({GROUPS}), z AS (SELECT 0.5 * ln((1 + k) / (1 - k)) AS z, w FROM (SELECT least(greatest(kappa, -0.999), 0.999) AS k, CAST(1 + length(g) AS DOUBLE) AS w FROM k)), m AS (SELECT sum(z * w) / sum(w) AS z FROM z) SELECT round((exp(2 * z) - 1) / (exp(2 * z) + 1), 6) AS mean_kappa FROM m")
def grouped_mean_kappa(spark, sf):
    """Submission joined to solution, kappa of each group, weighted mean."""
    rows = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("set"), (F.col("doc_id") % 4 + 1).cast("int").alias("target"), (1 + F.length("lang")).cast("double").alias("weight"))
    submission = rows.select("id", ((F.col("id") * 3 + F.col("id") % 5) % 4 + 1).cast("int").alias("score"))
    return metrics.grouped_kappa(rows, submission, "set").withColumn("mean_kappa", F.round("mean_kappa", 6))


B = "b AS (SELECT l_quantity - 25 AS p, CASE WHEN l_linenumber % 3 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y FROM lineitem)"


def _binary(spark, sf):
    return read(spark, sf, "lineitem").select((F.col("l_quantity") - 25).alias("p"), F.when(F.col("l_linenumber") % 3 == 0, 1.0).otherwise(-1.0).alias("y"))


@query(f"""WITH {B}, c AS (SELECT sum(CAST(p > 0 AND y > 0 AS INT)) AS tp, sum(CAST(p > 0 AS INT)) AS pp, sum(CAST(y > 0 AS INT)) AS ap, avg(CAST((p > 0) = (y > 0) AS INT)) AS accuracy, sqrt(avg((p - y) * (p - y))) AS rmse FROM b)
SELECT round(tp / pp, 6) AS precision, round(tp / ap, 6) AS recall, round(2.0::DOUBLE * tp / (pp + ap), 6) AS f1, round(accuracy, 6) AS accuracy, round(rmse, 6) AS rmse FROM c""")
def binary_report(spark, sf):
    """Precision, recall, F1, accuracy and error."""
    out = metrics.binary_report(_binary(spark, sf), "p", "y")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(f"WITH {B} SELECT round(avg(CAST((p > 0) = (y > 0) AS INT)), 6) AS accuracy, round(avg(ln(1 + exp(-p * y / 10))), 6) AS loss FROM b")
def forest_report(spark, sf):
    """Accuracy and mean logistic loss."""
    out = metrics.binary_report(_binary(spark, sf).withColumn("p", F.col("p") / 10), "p", "y", "Log")
    return out.select(F.round("accuracy", 6).alias("accuracy"), F.round("loss", 6).alias("loss"))


@query(f"""WITH {B}, g AS (SELECT p, sum(CAST(y > 0 AS INT)) AS pos, count(*) AS n FROM b GROUP BY p),
c AS (SELECT sum(pos) OVER d AS tp, sum(n) OVER d AS k, sum(pos) OVER () AS t, sum(n) OVER () AS n FROM g WINDOW d AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING))
SELECT round(max(2.0::DOUBLE * tp / (k + t)), 6) AS best_f1, round(max(CAST(tp + (n - t) - (k - tp) AS DOUBLE) / n), 6) AS best_accuracy FROM c""")
def break_even(spark, sf):
    """Best F1 and accuracy over all thresholds."""
    out = metrics.break_even(_binary(spark, sf), "p", "y")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


MODEL_KAPPA = f"""{MODELS_SQL}, j AS (SELECT p.*, d.cdf FROM predictions p JOIN dist d USING (run, fold)), r AS (SELECT *, row_number() OVER (PARTITION BY model, run, fold ORDER BY prediction, id) - 1 AS rk, count(*) OVER (PARTITION BY model, run, fold) AS n FROM j),
s AS (SELECT model, run, fold, id, target, CASE WHEN rk < floor(n * cdf[1] - 1) THEN 1 WHEN rk >= floor(n * cdf[1]) AND rk < floor(n * cdf[2] - 1) THEN 2 WHEN rk >= floor(n * cdf[2]) AND rk < floor(n * cdf[3] - 1) THEN 3 ELSE 4 END AS score FROM r),
o AS (SELECT model, run, fold, CAST(count(*) AS DOUBLE) AS n, CAST(sum((score - target) * (score - target)) AS DOUBLE) AS o FROM s GROUP BY ALL),
ha AS (SELECT model, run, fold, score AS a, count(*) AS na FROM s GROUP BY ALL), hb AS (SELECT model, run, fold, target AS b, count(*) AS nb FROM s GROUP BY ALL),
e AS (SELECT model, run, fold, sum((a - b) * (a - b) * CAST(na AS DOUBLE) * nb) AS e FROM ha JOIN hb USING (model, run, fold) GROUP BY ALL),
kappas AS (SELECT model, run, fold, 1 - n * o / e AS kappa FROM o JOIN e USING (model, run, fold))"""


def _scored(spark, sf):
    split = split_samples(spark, sf)
    rows = model_predictions(split).join(distributions(split), ["run", "fold"])
    return decode.cdf_decode(rows, [F.col("cdf")[i] for i in range(3)], ("model", "run", "fold"))


@query(f"WITH {MODEL_KAPPA} SELECT model, round(avg(kappa), 6) AS kappa_mean, round(stddev_pop(kappa), 6) AS kappa_std FROM kappas GROUP BY model")
def cross_validation_report(spark, sf):
    """Mean and deviation of each model's kappa over runs and folds."""
    k = metrics.kappa(_scored(spark, sf), "score", "target", keys=("model", "run", "fold"))
    return k.groupBy("model").agg(F.round(F.avg("kappa"), 6).alias("kappa_mean"), F.round(F.stddev_pop("kappa"), 6).alias("kappa_std"))


@query(f"WITH {MODEL_KAPPA} SELECT model, round(-avg(kappa), 6) AS loss FROM kappas GROUP BY model")
def evaluation_loss(spark, sf):
    """Minus the mean kappa, as the searches minimize it."""
    k = metrics.kappa(_scored(spark, sf), "score", "target", keys=("model", "run", "fold"))
    return k.groupBy("model").agg(F.round(-F.avg("kappa"), 6).alias("loss"))


@query(f"""WITH {MODEL_KAPPA}, dec AS (SELECT 'cdf' AS decoder, model, run, fold, target, score FROM s UNION ALL SELECT 'round', model, run, fold, target, CAST(least(greatest(round_even(prediction, 0), 1), 4) AS INT) FROM predictions UNION ALL SELECT 'ceil', model, run, fold, target, CAST(least(greatest(ceil(prediction), 1), 4) AS INT) FROM predictions),
od AS (SELECT decoder, model, run, fold, CAST(count(*) AS DOUBLE) AS n, CAST(sum((score - target) * (score - target)) AS DOUBLE) AS o FROM dec GROUP BY ALL),
da AS (SELECT decoder, model, run, fold, score AS a, count(*) AS na FROM dec GROUP BY ALL), db AS (SELECT decoder, model, run, fold, target AS b, count(*) AS nb FROM dec GROUP BY ALL),
ed AS (SELECT decoder, model, run, fold, sum((a - b) * (a - b) * CAST(na AS DOUBLE) * nb) AS e FROM da JOIN db USING (decoder, model, run, fold) GROUP BY ALL),
kd AS (SELECT decoder, 1 - n * o / e AS kappa FROM od JOIN ed USING (decoder, model, run, fold))
SELECT decoder, round(avg(kappa), 6) AS kappa_mean, round(stddev_pop(kappa), 6) AS kappa_std FROM kd GROUP BY decoder""")
def decoder_comparison(spark, sf):
    """Mean and deviation of kappa for three decoders."""
    cdf = _scored(spark, sf).select("run", "fold", "model", "target", "score").withColumn("decoder", F.lit("cdf"))
    rows = model_predictions(split_samples(spark, sf))
    clip = lambda c: F.least(c, F.lit(4))
    simple = [rows.select("run", "fold", "model", "target", clip(f(F.col("prediction"))).alias("score")).withColumn("decoder", F.lit(n)) for n, f in (("round", decode.round_decode), ("ceil", decode.ceil_decode))]
    every = cdf.unionByName(simple[0]).unionByName(simple[1])
    k = metrics.kappa(every, "score", "target", keys=("decoder", "model", "run", "fold"))
    return k.groupBy("decoder").agg(F.round(F.avg("kappa"), 6).alias("kappa_mean"), F.round(F.stddev_pop("kappa"), 6).alias("kappa_std"))


@query(f"WITH {MODELS_SQL} SELECT run, fold, id, round(avg(prediction), 6) AS prediction FROM predictions GROUP BY ALL")
def bagged_mean(spark, sf):
    """Mean prediction of all models."""
    rows = model_predictions(split_samples(spark, sf))
    return ensemble.bag_mean(rows, ("run", "fold", "id")).withColumn("prediction", F.round("prediction", 6))


@query(f"WITH {MODELS_SQL} SELECT run, fold, id, round(quantile_cont(prediction, 0.5), 6) AS prediction FROM predictions GROUP BY ALL")
def median_ensemble(spark, sf):
    """Median prediction of all models."""
    rows = model_predictions(split_samples(spark, sf))
    return ensemble.median_ensemble(rows, ("run", "fold", "id")).withColumn("prediction", F.round("prediction", 6))


WEIGHTS = [("m1", 1.0), ("m3", 0.5), ("m7", -0.25)]
W_SQL = "w AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', {w}::DOUBLE)" for m, w in WEIGHTS) + ") t(model, weight))"


@query(f"WITH {MODELS_SQL}, {W_SQL} SELECT run, fold, id, round(sum(weight * prediction) / sum(weight), 6) AS prediction FROM predictions JOIN w USING (model) GROUP BY ALL")
def weighted_ensemble(spark, sf):
    """Weighted mean of three models."""
    rows = model_predictions(split_samples(spark, sf))
    weights = spark.createDataFrame(WEIGHTS, "model string, weight double")
    return ensemble.weighted_mean(rows, weights, ("run", "fold", "id")).withColumn("prediction", F.round("prediction", 6))


@query("WITH " + MODEL_KAPPA.replace("j AS (SELECT p.*, d.cdf FROM predictions p JOIN dist d USING (run, fold))", W_SQL + ", j AS (SELECT 'ens' AS model, p.run, p.fold, p.id, p.target, sum(weight * prediction) / sum(weight) AS prediction, any_value(d.cdf) AS cdf FROM predictions p JOIN w USING (model) JOIN dist d USING (run, fold) GROUP BY p.run, p.fold, p.id, p.target)") + " SELECT round(avg(kappa), 6) AS kappa_mean, round(stddev_pop(kappa), 6) AS kappa_std FROM kappas")
def ensemble_objective(spark, sf):
    """Mean kappa of a fixed ensemble."""
    split = split_samples(spark, sf)
    out = ensemble.objective(model_predictions(split), distributions(split), spark.createDataFrame(WEIGHTS, "model string, weight double"))
    return out.select(F.round("kappa_mean", 6).alias("kappa_mean"), F.round("kappa_std", 6).alias("kappa_std"))


TRIALS = "trials AS (SELECT 'model' || (p_partkey % 5) AS model, p_partkey AS trial, CAST((p_partkey * 7919) % 1000 AS DOUBLE) / 1000 AS kappa_mean FROM part)"


def _trials(spark, sf):
    k = F.col("p_partkey")
    return read(spark, sf, "part").select(F.concat(F.lit("model"), (k % 5).cast("string")).alias("model"), k.alias("trial"), (((k * 7919) % 1000).cast("double") / 1000).alias("kappa_mean"))


@query(f"WITH {TRIALS} SELECT model, trial, kappa_mean, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY kappa_mean DESC, trial) AS place FROM trials) WHERE place <= 10")
def top_trials(spark, sf):
    """The ten best trials of each model."""
    return ensemble.top_trials(_trials(spark, sf), 10)


@query(f"WITH {TRIALS} SELECT model, trial, kappa_mean FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY kappa_mean DESC, trial) AS place FROM trials) WHERE place = 1")
def best_trial(spark, sf):
    """The best trial of each model."""
    return ensemble.best_trial(_trials(spark, sf))


@query(f"WITH {TRIALS}, m AS (SELECT model, max(kappa_mean) AS kappa FROM trials GROUP BY model) SELECT model, kappa, CAST(row_number() OVER (ORDER BY kappa DESC, model) AS INT) AS place FROM m")
def model_order(spark, sf):
    """Models by their best kappa."""
    return ensemble.model_order(_trials(spark, sf))


PREDS = "preds AS (SELECT id, relevance, 1 + variance AS weight, [sin(CAST(id AS DOUBLE)), cos(CAST(id AS DOUBLE)), sin(2.0::DOUBLE * id), cos(3.0::DOUBLE * id)] AS p FROM labelled)"


def _preds(spark, sf):
    i = F.col("id").cast("double")
    return labelled(spark, sf).select("id", "relevance", (1 + F.col("variance")).alias("weight"), F.array(F.sin(i), F.cos(i), F.sin(2.0 * i), F.cos(3.0 * i)).alias("preds"))


@query(f"WITH {LABELLED}, {PREDS}, x AS (SELECT id, k, CASE WHEN relevance > k THEN 1.0 ELSE -1.0 END AS y, p[k] AS p, weight FROM preds, (SELECT unnest([1, 2, 3]) AS k)), g AS (SELECT *, abs(pow(y - k, 2) - pow(y - k - 1, 2)) * weight AS w, exp(y * p) AS s FROM x) SELECT id, CAST(k AS INT) AS k, round(-w * y / (1 + s), 6) AS grad, round(w * s / pow(1 + s, 2), 6) AS hess FROM g")
def ebc_objective(spark, sf):
    """Gradients of extended binary classification."""
    out = objectives.ebc_rows(_preds(spark, sf).withColumnRenamed("relevance", "label"))
    return out.select("id", "k", F.round("grad", 6).alias("grad"), F.round("hess", 6).alias("hess"))


@query(f"WITH {LABELLED}, {PREDS}, x AS (SELECT id, k, relevance - 1 AS y, p[k] AS p, weight FROM preds, (SELECT unnest([1, 2, 3, 4]) AS k)), g AS (SELECT *, abs(pow(y - k, 2) - pow(y - k + 1, 2)) * weight AS w FROM x) SELECT id, CAST(k AS INT) AS k, round(2 * w * (p - CAST(y >= k AS INT)), 6) AS grad, round(2 * w, 6) AS hess FROM g")
def cocr_objective(spark, sf):
    """Gradients of cost-sensitive regression."""
    out = objectives.cocr_rows(_preds(spark, sf).withColumn("label", F.col("relevance") - 1))
    return out.select("id", F.col("k").cast("int").alias("k"), F.round("grad", 6).alias("grad"), F.round("hess", 6).alias("hess"))


SOFT = f"""{LABELLED}, {PREDS}, e AS (SELECT id, relevance, weight, list_transform(p, lambda x: exp(x)) AS e FROM preds), s AS (SELECT id, relevance, weight, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e),
c AS (SELECT *, pow(relevance - 1, 2) * p[1] + pow(relevance - 2, 2) * p[2] + pow(relevance - 3, 2) * p[3] + pow(relevance - 4, 2) * p[4] AS seen FROM s),
h AS (SELECT relevance AS i, CAST(count(*) AS DOUBLE) AS h FROM labelled GROUP BY relevance), t AS (SELECT (SELECT sum(pow(a.i - b.i, 2) * a.h * b.h) FROM h a, h b) AS e, (SELECT count(*) FROM c) AS m),
x AS (SELECT id, weight, n, p[n] * (pow(relevance - n, 2) - seen) AS d, p[n] AS q FROM c, (SELECT unnest([1, 2, 3, 4]) AS n)), g AS (SELECT id, n, weight, m * d / e AS grad, m * d * (1 - 2 * q) / e AS hess FROM x, t)"""


@query(f"WITH {SOFT} SELECT id, CAST(n AS INT) AS n, round(grad * weight * 1000, 5) AS grad, round(abs(hess) * 0.000125 / (SELECT avg(abs(hess)) FROM g) * weight * 1000, 5) AS hess FROM g")
def softkappa_objective(spark, sf):
    """Gradients of the smooth kappa, in thousandths."""
    out = objectives.softkappa_rows(_preds(spark, sf).withColumnRenamed("relevance", "label"))
    return out.select("id", "n", F.round(F.col("grad") * 1000, 5).alias("grad"), F.round(F.col("hess") * 1000, 5).alias("hess"))


L = "rows AS (SELECT l_orderkey * 10 + l_linenumber AS id, sin(l_quantity) * 2 AS p, CASE WHEN l_tax > 0.04 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y, l_returnflag AS leaf FROM lineitem)"
LOSSES = {
    "LS": "(y - p) * (y - p) / 2",
    "Expo": "exp(-p * y)",
    "Log": "ln(1 + exp(-p * y))",
    "LogRe": "-y * ln(1 / (1 + exp(-p))) - (1 - y) * ln(1 - 1 / (1 + exp(-p)))",
    "LogRe2": "2 * ln(1 + exp(p - y)) - (p - y) - 2 * ln(2.0::DOUBLE)",
    "Logit": "ln(1 + exp(-2 * p * y))",
    "ModLS": "CASE WHEN p * y <= 1 THEN (y - p) * (y - p) / 2 ELSE 0.0 END",
    "ModHuber": "CASE WHEN p * y <= -1 THEN -2 * p * y WHEN p * y < 1 THEN (y - p) * (y - p) / 2 ELSE 0.0 END",
}


def _margins(spark, sf):
    return read(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.sin("l_quantity") * 2).alias("p"), F.when(F.col("l_tax") > 0.04, 1.0).otherwise(-1.0).alias("y"), F.col("l_returnflag").alias("leaf"))


@query(f"WITH {L} SELECT id, " + ", ".join(f"round({x}, 6) AS {k}" for k, x in LOSSES.items()) + " FROM rows")
def forest_losses(spark, sf):
    """The forest's eight losses."""
    return _margins(spark, sf).select("id", *[F.round(objectives.forest_loss(k, F.col("p"), F.col("y")), 6).alias(k) for k in LOSSES])


DERIVED = {"LS": ("y - p", "1.0"), "Expo": ("y * exp(-p * y)", "exp(-p * y)"), "Log": ("y * exp(-p * y) / (1 + exp(-p * y))", "exp(-p * y) / pow(1 + exp(-p * y), 2)"), "Logit": ("2 * y * exp(-2 * p * y) / (1 + exp(-2 * p * y))", "4 * exp(-2 * p * y) / pow(1 + exp(-2 * p * y), 2)")}


@query(f"WITH {L} " + " UNION ALL ".join(f"SELECT '{k}' AS loss, leaf, round(sum(CAST({a} AS DOUBLE)), 4) AS d1, round(sum(CAST({b} AS DOUBLE)), 4) AS d2 FROM rows GROUP BY leaf" for k, (a, b) in DERIVED.items()))
def leaf_derivatives(spark, sf):
    """Summed derivatives of each leaf."""
    out = None
    for k in DERIVED:
        part = objectives.summed_derivatives(_margins(spark, sf), k, "leaf").select(F.lit(k).alias("loss"), "leaf", F.round("d1", 4).alias("d1"), F.round("d2", 4).alias("d2"))
        out = part if out is None else out.unionByName(part)
    return out
