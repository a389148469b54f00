"""Queries that write given tables in each file format and read them back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import forest
from ..sources import formats
from ..sources.scratch import scratch
from .fixtures import MODELS_SQL, SAMPLES_SQL, model_predictions, numeric_rows, read, samples, split_samples
from .q_models import SMALL, SMALL_SQL

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Register a function by its name, with its SQL."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query(f"WITH {SAMPLES_SQL} SELECT id, query, title AS product_title, coalesce(description, '') AS product_description, relevance AS median_relevance, variance AS relevance_variance FROM samples")
def csv_samples(spark, sf):
    """Samples as CSV with a header, texts with line ends and quotes in them."""
    path = scratch(spark, "samples")
    rows = samples(spark, sf).select("id", "query", F.col("title").alias("product_title"), F.col("description").alias("product_description"), F.col("relevance").alias("median_relevance"), F.col("variance").alias("relevance_variance"))
    rows.write.option("header", True).option("escape", '"').option("lineSep", "\n").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return formats.read_samples(spark, path)


@query("SELECT n_name AS word, CAST(max(n_regionkey) AS VARCHAR) AS replacement FROM nation GROUP BY n_name")
def dictionary_file(spark, sf):
    """A word list with comments; of equal words the last counts."""
    path = scratch(spark, "dictionary")
    nation = read(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), "n_name", F.col("n_regionkey").cast("string").alias("r"))
    lines = nation.select(F.col("k") - 100, F.concat("n_name", F.lit(",first"))).union(nation.select(F.col("k"), F.concat("n_name", F.lit(","), "r")))
    lines = lines.union(nation.select(F.col("k") + 100, F.concat(F.lit("# "), "n_name", F.lit(",comment")))).toDF("k", "value")
    lines.orderBy("k").select("value").write.text(path)
    found = formats.read_dictionary(spark, path)
    return spark.createDataFrame(sorted(found.items()), "word string, replacement string")


@query(f"WITH {MODELS_SQL} SELECT run, fold, split, id, relevance FROM split")
def feature_store(spark, sf):
    """Rows of all folds in folders by run, fold and split."""
    path = scratch(spark, "features")
    formats.write_features(split_samples(spark, sf), path)
    return formats.read_features(spark, path, ["relevance"]).select("run", "fold", "split", "id", "relevance")


LINES = "SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS a, l_discount * 100 AS b, l_tax * 100 AS c, CAST(l_linenumber AS DOUBLE) AS d FROM lineitem"
PLACED = "SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS index, o_totalprice AS a, CAST(o_custkey AS DOUBLE) AS b, CAST(o_orderkey % 3 AS DOUBLE) AS c, CAST(o_custkey % 2 AS DOUBLE) AS d FROM orders"


def _columns(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, *[F.col("features")[i].alias(c) for i, c in enumerate("abcd")])


@query(LINES)
def libsvm_rows(spark, sf):
    """Lines as `label index:value`, the id as label."""
    from pyspark.ml.functions import vector_to_array

    path = scratch(spark, "libsvm")
    formats.write_libsvm(numeric_rows(spark, sf).select("id", "features"), path, label="id")
    rows = formats.read_libsvm(spark, path, 4).select(F.col("label").cast("bigint").alias("id"), vector_to_array("features").alias("features"))
    return _columns(rows, "id")


@query("SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS index, round(o_totalprice, 6) AS value FROM orders")
def vector_file(spark, sf):
    """Prices one a line, in the order of the keys."""
    path = scratch(spark, "vector")
    formats.write_vector(read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", path, "o_orderkey")
    return formats.read_vector(spark, path)


@query(f"WITH {MODELS_SQL} SELECT model, run, fold, id, target, round(prediction, 6) AS prediction FROM predictions")
def prediction_files(spark, sf):
    """Predictions as CSV in folders by model."""
    path = scratch(spark, "predictions")
    formats.write_predictions(model_predictions(split_samples(spark, sf)), path)
    return formats.read_predictions(spark, path).select("model", "run", "fold", "id", "target", F.round("prediction", 6).alias("prediction"))


def _orders(spark, sf) -> DataFrame:
    rows = read(spark, sf, "orders")
    features = [F.col("o_totalprice"), F.col("o_custkey"), F.col("o_orderkey") % 3, F.col("o_custkey") % 2]
    return rows.select(F.col("o_orderkey").alias("id"), F.array(*[f.cast("double") for f in features]).alias("features"))


def _dense(spark, sf, name: str) -> DataFrame:
    path = scratch(spark, name)
    rows = _orders(spark, sf).select("id", F.array_join(F.transform("features", lambda x: x.cast("string")), " ").alias("value"))
    rows.orderBy("id").select("value").write.text(path)
    return formats.read_dense(spark, path)


@query(PLACED)
def dense_rows(spark, sf):
    """Orders as numbers between white space, numbered over all files."""
    return _columns(_dense(spark, sf, "dense"), "index")


@query(PLACED)
def sparse_rows(spark, sf):
    """Orders as `place:value` behind a header; zeros left out, ones without a value."""
    path = scratch(spark, "sparse")
    cell = lambda x, i: F.when(x == 1, i.cast("string")).when(x != 0, F.concat(i.cast("string"), F.lit(":"), x.cast("string")))
    rows = _orders(spark, sf).select("id", F.array_join(F.filter(F.transform("features", cell), lambda t: t.isNotNull()), " ").alias("value"))
    head = spark.createDataFrame([(-1, "sparse 4")], "id bigint, value string")
    head.unionByName(rows).orderBy("id").select("value").write.text(path)
    return _columns(formats.read_sparse(spark, path), "index")


@query(f"SELECT index, a, round(a / 3, 6) AS w FROM ({PLACED})")
def weighted_rows(spark, sf):
    """Rows of one file with the weights of another, line by line."""
    path = scratch(spark, "weights")
    weights = _orders(spark, sf).select("id", (F.col("features")[0] / 3).alias("w"))
    formats.write_vector(weights, "w", path, "id")
    return formats.with_weights(_dense(spark, sf, "dense"), formats.read_vector(spark, path)).select("index", F.col("features")[0].alias("a"), "w")


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS place, n_name AS name FROM nation")
def feature_name_file(spark, sf):
    """One name a line, as many as there are features."""
    path = scratch(spark, "names")
    nation = read(spark, sf, "nation")
    nation.orderBy("n_nationkey").select("n_name").write.text(path)
    names = formats.read_feature_names(spark, path, nation.count())
    return spark.createDataFrame(list(enumerate(names)), "place bigint, name string")


@query(f"SELECT index, a, b, c, d, a AS e, b AS f FROM ({PLACED})")
def merged_features(spark, sf):
    """Features of two files side by side."""
    one = _dense(spark, sf, "dense")
    two = one.select("index", F.slice("features", 1, 2).alias("features"))
    out = formats.merge_features([one, two])
    return out.select("index", *[F.col("features")[i].alias(c) for i, c in enumerate("abcdef")])


@query(f"SELECT l_orderkey * 10 + l_linenumber AS id, {SMALL_SQL} AS prediction FROM lineitem")
def saved_forest(spark, sf):
    """Predictions of a forest that was written and read back."""
    name = formats.write_model(spark.createDataFrame(SMALL, forest.NODES), scratch(spark, "model"))
    return forest.predict(numeric_rows(spark, sf).select("id", "features"), formats.read_model(spark, name).toPandas()).select("id", "prediction")
