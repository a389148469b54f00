"""Agreement of two raters, and the forest's evaluation figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .objectives import forest_loss
from .ranking import running_sums


def confusion_matrix(df: DataFrame, a: str, b: str, low: int = 1, high: int = 4) -> DataFrame:
    """a, b, n for all pairs of ratings, 0 where there are none."""
    span = F.sequence(F.lit(low), F.lit(high))
    grid = df.sparkSession.range(1).select(F.explode(span).alias(a)).withColumn(b, F.explode(span))
    return grid.join(df.groupBy(a, b).agg(F.count("*").alias("n")), [a, b], "left").na.fill(0, ["n"])


PENALTIES = {
    "quadratic": lambda d: F.pow(d, F.lit(2.0)),
    "linear": lambda d: F.abs(d).cast("double"),
    "unweighted": lambda d: (d != 0).cast("double"),
}


def kappa(df: DataFrame, a: str, b: str, *, kind: str = "quadratic", keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, kappa = 1 - observed over expected disagreement.

    The rows are counted once by (keys, a, b); all else works on these few
    counts.  Both raters constant and equal: no expected disagreement, null.
    """
    cells = df.groupBy(*keys, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    ha = cells.groupBy(*keys, "a").agg(F.sum("n").alias("na"))
    hb = cells.groupBy(*keys, "b").agg(F.sum("n").alias("nb"))
    cost = PENALTIES[kind](F.col("a") - F.col("b"))
    seen = cells.groupBy(*keys).agg(F.sum(cost * F.col("n")).alias("o"), F.sum("n").alias("total"))
    both = ha.join(hb, list(keys)) if keys else ha.join(hb)  # ratings squared
    due = both.groupBy(*keys).agg(F.sum(cost * F.col("na").cast("double") * F.col("nb").cast("double")).alias("e"))
    out = seen.join(due, list(keys)) if keys else seen.join(due)
    return out.select(*keys, F.when(F.col("e") > 0, 1 - F.col("total") * F.col("o") / F.col("e")).alias("kappa"))


def mean_kappa(k: Column, weight: Column | None = None) -> Column:
    """Aggregate: mean by Fisher's z, values clipped to +-0.999, weights over their mean."""
    k = F.least(F.greatest(k, F.lit(-0.999)), F.lit(0.999))
    z = 0.5 * F.log((1 + k) / (1 - k))
    z = F.avg(z) if weight is None else F.sum(z * weight) / F.sum(weight)
    return (F.exp(2 * z) - 1) / (F.exp(2 * z) + 1)


def grouped_kappa(solution: DataFrame, submission: DataFrame, group: str) -> DataFrame:
    """Left join by id, kappa per group, mean weighted by each group's first weight."""
    rows = solution.join(submission, "id", "left")
    weight = rows.groupBy(group).agg(F.min_by("weight", "id").alias("weight"))
    return kappa(rows, "target", "score", keys=(group,)).join(weight, group).agg(mean_kappa(F.col("kappa"), F.col("weight")).alias("mean_kappa"))


def binary_report(df: DataFrame, p: str, y: str, loss: str | None = None) -> DataFrame:
    """precision, recall, f1, accuracy, rmse, and the mean of a loss if one is named, of predictions with threshold 0 against labels +1 / -1."""
    pos, true = F.col(p) > 0, F.col(y) > 0
    tp, fp, fn, ok = (F.sum(c.cast("double")) for c in (pos & true, pos & ~true, ~pos & true, pos == true))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = df.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), (ok / F.count("*")).alias("accuracy"), F.sqrt(F.avg(F.pow(F.col(p) - F.col(y), F.lit(2.0)))).alias("rmse"), *([F.avg(forest_loss(loss, F.col(p), F.col(y))).alias("loss")] if loss else []))
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.select("precision", "recall", f1.alias("f1"), "accuracy", "rmse", *(["loss"] if loss else []))


def break_even(df: DataFrame, p: str, y: str) -> DataFrame:
    """best_f1, best_accuracy over all thresholds: rows in falling order of prediction, ties together."""
    per = df.groupBy(p).agg(F.sum((F.col(y) > 0).cast("double")).alias("pos"), F.count("*").alias("all"))
    rows = running_sums(per, [-F.col(p)], {"tp": F.col("pos"), "k": F.col("all")}).crossJoin(per.agg(F.sum("pos").alias("t"), F.sum("all").alias("n")))  # one row
    f1 = 2 * F.col("tp") / (F.col("k") + F.col("t"))
    accuracy = (F.col("tp") + (F.col("n") - F.col("t")) - (F.col("k") - F.col("tp"))) / F.col("n")
    return rows.agg(F.max(f1).alias("best_f1"), F.max(accuracy).alias("best_accuracy"))
