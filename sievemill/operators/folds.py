"""Samples, dictionaries, folds, distributions and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranking import ranked


def row_index(df: DataFrame, order: str, name: str = "index") -> DataFrame:
    """Add the 0-based place in the order of a unique column."""
    return ranked(df, [order], name)


def one_hot_labels(df: DataFrame, column: str, classes: int = 4) -> DataFrame:
    """Add <column>_k, 1 where the label is k."""
    return df.withColumns({f"{column}_{k}": (F.col(column) == k).cast("int") for k in range(1, classes + 1)})


def dictionary(df: DataFrame, column: str, name: str = "qid") -> DataFrame:
    """column, name: distinct values with their 1-based place in order."""
    return ranked(df.select(column).distinct(), [column], name).withColumn(name, F.col(name) + 1)


def encode(df: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Left join with the dictionary; null for values it lacks."""
    return df.join(known, column, "left")


def stratified_folds(df: DataFrame, stratum: str, *, runs: int = 3, folds: int = 3, seed: int = 2015, key: Column | None = None) -> DataFrame:
    """run, fold, and df's rows: each stratum is dealt to the folds in the order of an arithmetic key that differs by run."""
    out = df.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))
    key = (F.col("id") * 7919 + F.lit(seed) + 1000 * F.col("run")) % 10007 if key is None else key
    out = ranked(out, [key, "id"], "__turn", ("run", stratum))
    return out.withColumn("fold", (F.col("__turn") % folds + 1).cast("int")).drop("__turn")


def splits(folded: DataFrame) -> DataFrame:
    """run, fold, split and rows: each fold trains on its own third and validates on the others."""
    held = folded.select("run", "fold").distinct().select("run", F.col("fold").alias("held"))
    out = folded.withColumnRenamed("fold", "own").join(held, "run")
    return out.withColumn("split", F.when(F.col("own") == F.col("held"), "train").otherwise("valid")).withColumnRenamed("held", "fold").drop("own")


def index_lists(df: DataFrame, keys: list[str], index: str = "id") -> DataFrame:
    """keys, members: the ordered ids of each group."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(index)).alias("members"))


def histogram(df: DataFrame, column: str, low: int = 1, high: int = 4, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, column, n for every value from low to high, 0 where there are none."""
    every = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    every = every.withColumn(column, F.explode(F.sequence(F.lit(low), F.lit(high))))
    held = df.groupBy(*keys, column).agg(F.count("*").alias("n"))
    return every.join(held, [*keys, column], "left").na.fill(0, ["n"])


def cdf(hist: DataFrame, column: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, column, cdf: running share of a zero-filled histogram."""
    whole = W.partitionBy(*keys, F.lit(1))
    upto = F.sum("n").over(whole.orderBy(column).rowsBetween(W.unboundedPreceding, 0))
    return hist.select(*keys, column, (upto / F.sum("n").over(whole)).alias("cdf"))


def pdf(cdfs: DataFrame, column: str) -> DataFrame:
    """column, pdf: differences of the mean distribution over all keys."""
    mean = cdfs.groupBy(column).agg(F.avg("cdf").alias("c"))
    return mean.select(column, (F.col("c") - F.lag("c", 1, 0.0).over(W.orderBy(column))).alias("pdf"))


def sample_weights(split: DataFrame, variance: str = "variance") -> DataFrame:
    """Add weight = (1 + (m - sqrt v) / m) / 2, m the largest sqrt v of the training rows of (run, fold); 1 where m is 0."""
    root = F.sqrt(variance)
    most = split.where("split = 'train'").groupBy("run", "fold").agg(F.max(root).alias("m"))
    rows = split.join(most, ["run", "fold"], "left")
    return rows.select(*split.columns, F.when(F.col("m") > 0, (1 + (F.col("m") - root) / F.col("m")) / 2).otherwise(1.0).alias("weight"))


def contiguous_folds(df: DataFrame, order: str, folds: int, seed: int | None = None) -> DataFrame:
    """Add fold 1..k: runs of rows in order, the first ones longer by one where rows are left over; with a seed the order is shuffled first, by an arithmetic draw on the order column, which is a number then."""
    turn = [order] if seed is None else [F.pmod(F.col(order) * 7919 + seed, F.lit(10007)), order]
    rows = ranked(df, turn, "__turn").crossJoin(df.agg(F.count("*").alias("__n")))  # one row
    size, more = F.expr(f"__n div {folds}"), F.expr(f"__n % {folds}")
    long = F.col("__turn") < more * (size + 1)
    fold = F.when(long, F.floor(F.col("__turn") / (size + 1))).otherwise(more + F.floor((F.col("__turn") - more * (size + 1)) / F.when(size > 0, size)))
    return rows.withColumn("fold", (fold + 1).cast("int")).drop("__turn", "__n")


def subset(df: DataFrame, ratio: float, seed: int, modulus: int = 10007) -> DataFrame:
    """Add chosen: a sample without replacement that depends on id and seed alone; the rest is out of bag."""
    return df.withColumn("chosen", (F.col("id") * 104729 + seed) % modulus < ratio * modulus)


#: Of the arithmetic draw: its modulus, and the running shares of 0 to 7 copies under Poisson(1).
MODULUS = 2_147_483_647
SHARES = [0.36787944117144233, 0.73575888234288467, 0.91969860292860584, 0.98101184312384626, 0.99634015317265637, 0.99940581518241840, 0.99991675885071204, 0.99998975080332538]


def bootstrap_copies(seed: int) -> Column:
    """How often a bootstrap takes the row: Poisson(1) from an arithmetic draw on id and seed."""
    x = (F.pmod(F.col("id"), F.lit(MODULUS)) * 48271 + seed) % MODULUS
    u = ((x * x) % MODULUS * 16807 + seed) % MODULUS
    return sum(((u / float(MODULUS)) >= s).cast("int") for s in SHARES)


def bootstrap(df: DataFrame, seed: int) -> DataFrame:
    """Rows drawn with replacement, as many as there are on average."""
    return df.withColumn("copy", F.explode(F.array_repeat(F.lit(1), bootstrap_copies(seed))))


def out_of_bag(df: DataFrame, seed: int) -> DataFrame:
    """The rows that the bootstrap of the same seed doesn't take."""
    return df.where(bootstrap_copies(seed) == 0)
