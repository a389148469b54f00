"""Readers and writers: samples, dictionaries, feature stores, vectors, predictions, trial logs, forest files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.counting import transform_of

SAMPLES = "id bigint, query string, product_title string, product_description string, median_relevance int, relevance_variance double"


def read_samples(spark: SparkSession, path: str, schema: str = SAMPLES) -> DataFrame:
    """A CSV table with a header; null strings become empty."""
    df = spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"')
    return df.na.fill("", [f.name for f in df.schema if f.dataType.simpleString() == "string"])


def read_dictionary(spark: SparkSession, path: str) -> dict[str, str]:
    """A word list `word,replacement` without header; lines that start with # are skipped, of equal words the last counts."""
    lines = _numbered(spark, path).where(~F.col("value").startswith("#"))
    cells = F.split("value", ",", 2)
    rows = lines.where(F.size(cells) == 2).select(F.col("index").alias("at"), cells[0].alias("word"), cells[1].alias("to"))
    return {r.word: r.to for r in rows.groupBy("word").agg(F.max_by("to", "at").alias("to")).collect()}  # a lookup table, small by definition


def write_features(df: DataFrame, path: str) -> None:
    """A feature table with hive partitions run, fold, split."""
    df.write.mode("overwrite").partitionBy("run", "fold", "split").parquet(path)


def read_features(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The feature table, or some of its columns."""
    df = spark.read.parquet(path)
    return df.select("run", "fold", "split", "id", *columns) if columns else df


def write_libsvm(df: DataFrame, path: str, features: str = "features", label: str = "label") -> None:
    """`label index:value ...` lines, 1-based, zeros left out, from an array column."""
    cells = F.filter(F.transform(features, lambda x, i: F.when(x != 0, F.concat((i + 1).cast("string"), F.lit(":"), x.cast("string")))), lambda s: s.isNotNull())
    df.select(F.concat_ws(" ", F.col(label).cast("string"), F.array_join(cells, " "))).write.mode("overwrite").text(path)


def read_libsvm(spark: SparkSession, path: str, width: int) -> DataFrame:
    """label, features of a fixed width: columns that are zero in all rows stay."""
    return spark.read.format("libsvm").option("numFeatures", str(width)).load(path)


def write_vector(df: DataFrame, column: str, path: str, order: str, digits: int = 6) -> None:
    """One number a line, in the order of a column."""
    df.orderBy(order).select(F.format_string(f"%.{digits}f", column)).write.mode("overwrite").text(path)


def read_vector(spark: SparkSession, path: str, kind: str = "double") -> DataFrame:
    """index, value of a file with one number a line."""
    return _numbered(spark, path).select("index", F.col("value").cast(kind).alias("value"))


def write_predictions(df: DataFrame, path: str) -> None:
    """Predictions as CSV with a header, in folders by model."""
    df.write.mode("overwrite").option("header", True).partitionBy("model").csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """model, run, fold, id, target, prediction."""
    return spark.read.csv(path, header=True, schema="run int, fold int, id bigint, target int, prediction double, model string")


def append_trials(df: DataFrame, path: str) -> None:
    """Add finished trials to the log; each write is atomic, so a stopped search keeps what it finished."""
    df.write.mode("append").parquet(path)


def read_trial_csv(spark: SparkSession, path: str) -> DataFrame:
    """trial, kappa_mean, kappa_std, params (map) of a log whose parameter columns vary; a log of only a header gives no rows."""
    df = spark.read.csv(path, header=True)
    known = ["trial_counter", "kappa_mean", "kappa_std"]
    params = [c for c in df.columns if c not in known]
    pairs = F.create_map(*[x for c in params for x in (F.lit(c), F.col(c))]) if params else F.create_map().cast("map<string,string>")
    return df.select(F.col("trial_counter").cast("int").alias("trial"), F.col("kappa_mean").cast("double").alias("kappa_mean"), F.col("kappa_std").cast("double").alias("kappa_std"), pairs.alias("params"))


def feature_manifest(spark: SparkSession, names: list[str]) -> DataFrame:
    """feature, transform of a feature list."""
    return spark.createDataFrame([(i, n, transform_of(n)) for i, n in enumerate(names)], "place int, feature string, transform string")


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """index, value of all lines, files by the numbers in their names and their names, lines in order.

    A block of a file is one task's, which numbers its lines in order; blocks
    are counted, and begin after those before them.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"))
    number = F.coalesce(F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).try_cast("long"), F.lit(0))
    before = W.orderBy(number, "file", "block").rowsBetween(W.unboundedPreceding, -1)  # one row a block
    blocks = blocks.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(W.partitionBy("file", "block").orderBy("at")) - 1
    return lines.withColumn("place", place).join(blocks, ["file", "block"]).select((F.col("base") + F.col("place")).alias("index"), "value")


def read_dense(spark: SparkSession, path: str) -> DataFrame:
    """index, features of white-space separated rows; a row with more or fewer values than the first is an error."""
    rows = _numbered(spark, path).select("index", F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("double")).alias("features"))
    width = rows.where("index = 0").select(F.size("features").alias("n")).first()
    wrong = rows.where(F.size("features") != (width.n if width else 0)).first()
    if wrong is not None:
        raise ValueError(f"row {wrong['index']}: too {'many' if len(wrong.features) > width.n else 'few'} values")
    return rows


def read_sparse(spark: SparkSession, path: str) -> DataFrame:
    """index, features of rows `i:v` or bare `i` (value 1), 0-based, after a header `sparse <width>`; a repeated or too large index is an error."""
    lines = _numbered(spark, path)
    head = lines.where("index = 0").first()
    width = int(head["value"].split()[1])
    cells = F.filter(F.split(F.trim("value"), r"\s+"), lambda t: t != "")
    pairs = F.transform(cells, lambda t: F.struct(F.split(t, ":")[0].try_cast("int").alias("i"), F.when(t.contains(":"), F.split(t, ":")[1].try_cast("double")).otherwise(1.0).alias("v")))
    rows = lines.where("index > 0").select((F.col("index") - 1).alias("index"), pairs.alias("p"))
    places = F.transform("p", lambda x: x["i"])
    wrong = rows.where((F.size(F.array_distinct(places)) != F.size(places)) | F.exists(places, lambda i: i.isNull() | (i >= width) | (i < 0))).first()
    if wrong is not None:
        raise ValueError(f"row {wrong['index']}: repeated or impossible place")
    table = F.map_from_entries("p")
    return rows.select("index", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(table[i], F.lit(0.0))).alias("features"))


def with_weights(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """rows with w, by index; as many weights as rows, or an error."""
    if rows.count() != weights.count():
        raise ValueError("there must be one weight for each row")
    return rows.join(weights.select("index", F.col("value").alias("w")), "index")


def read_feature_names(spark: SparkSession, path: str, width: int) -> list[str]:
    """One name a line; blank lines and another number of names are errors."""
    names = [r["value"] for r in _numbered(spark, path).orderBy("index").collect()]
    if any(not n.strip() for n in names) or len(names) != width:
        raise ValueError("there must be one name, not blank, for each feature")
    return names


def merge_features(parts: list[DataFrame]) -> DataFrame:
    """index, features: the rows' arrays side by side."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p.select("index", F.col("features").alias("more")), "index").select("index", F.concat("features", "more").alias("features"))
    return out


def write_model(nodes: DataFrame, path: str, number: int = 1) -> str:
    """A node table as <path>-NN; returns the name."""
    name = f"{path}-{number:02d}"
    nodes.write.mode("overwrite").parquet(name)
    return name


def read_model(spark: SparkSession, name: str) -> DataFrame:
    """A node table; children and parents must point at each other."""
    nodes = spark.read.parquet(name)
    child = nodes.where("le >= 0").select("tree", F.explode(F.array("le", "gt")).alias("node"), F.col("node").alias("up"))
    if not child.join(nodes, ["tree", "node"], "left").where("parent is null or parent <> up").isEmpty():
        raise ValueError("the node table is damaged")
    return nodes


def write_evaluation(report: DataFrame, path: str, trees: int, leaves: int) -> None:
    """One line `trees,leaves,accuracy,rmse,precision,recall,f1`."""
    out = report.select(F.lit(trees).alias("trees"), F.lit(leaves).alias("leaves"), "accuracy", "rmse", "precision", "recall", "f1")
    out.write.mode("append").option("header", True).csv(path)
