"""Views of the driver's tables in the shapes that the operators take, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens

#: DuckDB SQL of the same views.
SAMPLES_SQL = """samples AS (
SELECT l.doc_id AS id, CAST(1 + 2 * l.quality + l.toxic AS INT) AS relevance, CAST(l.doc_id % 7 AS DOUBLE) / 7 AS variance,
       array_to_string(list_slice(string_split(b.text, ' '), 1, 4), ' ') AS query, string_split(d.text, chr(10))[1] AS title, d.text AS description
FROM labels l JOIN documents d ON d.doc_id = l.doc_id JOIN benchmark b ON b.item_id = l.doc_id % (SELECT count(*) FROM benchmark))"""
PAIRS_SQL = """turn_pairs AS (
SELECT u.conv_id, u.turn, u.text AS query, s.text AS title FROM conversations u JOIN conversations s ON s.conv_id = u.conv_id AND s.turn = u.turn + 1
WHERE u.role = 'user' AND s.role = 'assistant')"""
MODELS_SQL = f"""{SAMPLES_SQL},
folded AS (SELECT r.run, s.id, s.relevance, s.variance, CAST((row_number() OVER (PARTITION BY r.run, s.relevance ORDER BY (s.id * 7919 + 2015 + 1000 * r.run) % 10007, s.id) - 1) % 3 + 1 AS INT) AS fold
  FROM samples s, (SELECT CAST(unnest([1, 2, 3]) AS INT) AS run) r),
split AS (SELECT f.run, h.fold, f.id, f.relevance, f.variance, CASE WHEN f.fold = h.fold THEN 'train' ELSE 'valid' END AS split FROM folded f JOIN (SELECT DISTINCT run, fold FROM folded) h ON h.run = f.run),
dist AS (SELECT run, fold, [avg(CASE WHEN relevance <= 1 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN relevance <= 2 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN relevance <= 3 THEN 1.0 ELSE 0.0 END)] AS cdf FROM split WHERE split = 'train' GROUP BY run, fold),
predictions AS (SELECT 'm' || k AS model, run, fold, id, relevance AS target, relevance + 1.5 * sin(CAST(id * k + run AS DOUBLE)) AS prediction FROM split, (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS k) WHERE split = 'valid')"""


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, relevance, variance, query, title, description of labelled documents, each with a benchmark item as its query."""
    items = read(spark, sf_dir, "benchmark")
    n = items.count()
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    rows = rows.withColumn("item_id", F.col("doc_id") % n).join(items.select("item_id", F.col("text").alias("item")), "item_id")
    return rows.select(
        F.col("doc_id").alias("id"),
        (1 + 2 * F.col("quality") + F.col("toxic")).cast("int").alias("relevance"),
        ((F.col("doc_id") % 7).cast("double") / 7).alias("variance"),
        F.array_join(F.slice(F.split("item", " "), 1, 4), " ").alias("query"),
        F.split("text", "\n")[0].alias("title"),
        F.col("text").alias("description"),
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, relevance, variance: the samples without their texts."""
    return read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (1 + 2 * F.col("quality") + F.col("toxic")).cast("int").alias("relevance"), ((F.col("doc_id") % 7).cast("double") / 7).alias("variance"))


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, query, title: each user turn with the assistant's next."""
    turns = read(spark, sf_dir, "conversations")
    user = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    reply = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("title"))
    return user.join(reply, ["conv_id", "turn"])


def tokenized(df: DataFrame, *fields: str) -> DataFrame:
    return df.withColumns({f"{f}_tokens": tokens(F.col(f)) for f in fields})


def split_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, fold, id, relevance, variance, split."""
    from ..operators.folds import splits, stratified_folds

    rows = labelled(spark, sf_dir)
    tasks = 9 * rows.count() // 100_000 + 1  # rows are few bytes each and are multiplied later: their tasks are cut by number
    return splits(stratified_folds(rows, "relevance")).repartition(tasks, "run", "id")


def distributions(split: DataFrame) -> DataFrame:
    """run, fold, cdf (three shares) of the training rows."""
    share = lambda k: F.avg((F.col("relevance") <= k).cast("double"))
    return split.where("split = 'train'").groupBy("run", "fold").agg(F.array(share(1), share(2), share(3)).alias("cdf"))


def model_predictions(split: DataFrame, models: int = 8) -> DataFrame:
    """model, run, fold, id, target, prediction: formulas that follow the label with noise."""
    rows = split.where("split = 'valid'").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(models))))
    noise = 1.5 * F.sin((F.col("id") * F.col("k") + F.col("run")).cast("double"))
    return rows.select(F.concat(F.lit("m"), "k").alias("model"), "run", "fold", "id", F.col("relevance").alias("target"), (F.col("relevance") + noise).alias("prediction"))


def numeric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, features, y from the orders' lines."""
    rows = read(spark, sf_dir, "lineitem")
    return rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.array(F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100, F.col("l_linenumber").cast("double")).alias("features"), (F.col("l_extendedprice") / 10000).alias("y"))
