"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a token budget: its weight's share of the whole mix, at most
`cap` times its own size, the excess shared out again by weight.  A source gives
as many complete epochs as fit; the rest of its budget is a sample without
replacement, in order of exponential keys divided by the documents' quality
weights, up to the document whose running size reaches the rest.

The running size needs no sort of a whole source: keys fall into bins, bin
totals are summed in order, and only the bin in which a source's budget ends is
sorted: of the bins, whose number grows with the rows, it holds some `bin_rows`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import written

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> F.Column:
    """Number of words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, target for rows (source, size), one row a source.

    Sources by code point, null last, weigh `weights` in turn.  With sources in
    order of cap * size / weight, the first ones stop at their cap and all
    others get weight * (what is left) / (their weights): the first source that
    stays under its cap so tells where to stop.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    order = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    level = (F.sum("source_size").over(W.partitionBy(F.lit(1))) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level)
    under = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    level = F.first(under, True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return per.withColumn("level", level).select("source", "source_size", F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))


def sampling_key(doc_id: F.Column, weight: F.Column, seed: int) -> F.Column:
    """An exponential variate of rate `weight`, from the md5 of seed and id; null ids share one key."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 12)
    uniform = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))
    return -F.log(uniform) / weight


def mix(rows: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 6, bins: int = 512, bin_rows: int = 100_000) -> DataFrame:
    """doc_id, size, source_size, target, taken, source for every row of (doc_id, source, size, quality).

    taken is a multiple of size: complete epochs, and once more if the sample
    takes the document.  Of documents with equal keys (repeated ids) the smaller
    comes first.  A null or non-positive quality counts as 1; a document of
    size 0 is taken 0 times; an empty table gives no rows; other columns, of
    whatever names, are not read.
    """
    quality = F.when(F.col("quality") > 0, F.col("quality")).otherwise(1.0)
    rows = rows.select("doc_id", "source", F.col("size").cast("long").alias("size"), sampling_key(F.col("doc_id"), quality, seed).alias("key"))
    rows = written(rows, "mix-keys")
    bins += rows.count() // bin_rows
    rows = rows.withColumn("bin", F.floor((1 - F.exp(-F.col("key"))) * bins).cast("int"))
    targets = source_targets(rows, weights, share, cap)
    ratio = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0) + 1e-9)
    targets = targets.withColumn("epochs", ratio.cast("long")).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - ratio * F.col("source_size")))
    totals = rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    by_bin = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("base", F.coalesce(F.sum("bin_size").over(by_bin), F.lit(0)))
    key = lambda t: F.coalesce(F.concat(F.lit("s"), t), F.lit("n"))
    plan = totals.withColumn("k", key(F.col("source"))).join(targets.withColumn("k", key(F.col("source"))).drop("source"), "k").drop("k")
    plan = written(plan, "mix-plan")  # sources * bins rows at most
    last = (F.col("base") < F.col("rest")) & (F.col("base") + F.col("bin_size") > F.col("rest"))
    plan = plan.withColumn("side", F.when(last, 0).when(F.col("base") >= F.col("rest"), -1).otherwise(1))
    plan = plan.select(F.xxhash64(key(F.col("source")), "bin").alias("cell"), key(F.col("source")).alias("k"), F.col("bin").alias("b"), "source_size", "target", "epochs", "rest", "base", "side")
    rows = rows.join(plan, (key(F.col("source")) == F.col("k")) & (F.col("bin") == F.col("b")))
    # rows of bins that are wholly in or out are spread by their own id: only the last bin of each source is put in order
    spread = F.when(F.col("side") == 0, F.col("cell")).otherwise(F.xxhash64("doc_id", "size"))
    running = F.sum("size").over(W.partitionBy("spread").orderBy("key", "size", "doc_id").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("spread", spread).withColumn("before", F.col("base") + F.coalesce(running, F.lit(0)))
    within = (F.col("side") == 1) | ((F.col("side") == 0) & (F.col("before") + F.col("size") / 2 <= F.col("rest")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("epochs") + within.cast("long"))).alias("taken"), rows["source"])
