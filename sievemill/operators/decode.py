"""From raw predictions to ratings 1..4."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import ranked


def ordinal_rank(df: DataFrame, by: str = "prediction", keys: tuple[str, ...] = (), order: str = "id") -> DataFrame:
    """Add rank: the unique 0-based place by prediction, then id."""
    return ranked(df, [by, order], "rank", keys)


def _edges(cdf: list[Column], n: Column, gapless: bool) -> tuple[list[Column], list[Column]]:
    starts = [F.lit(0).cast("long"), *[F.floor(n * c) for c in cdf[:2]]]
    stops = [F.floor(n * c) if gapless else F.greatest(F.lit(0).cast("long"), F.when(n * c >= 1, F.floor(n * c - 1)).otherwise(0)) for c in cdf]
    return starts, stops


def cdf_decode(df: DataFrame, cdf: list[Column], keys: tuple[str, ...] = (), *, gapless: bool = False) -> DataFrame:
    """Add score: ranks below n * cdf[0] - 1 are 1, and so on; all others 4.

    The published rule ends each class one rank early, so the rank at each
    boundary is a 4; `gapless` closes these gaps.
    """
    sizes = df.groupBy(F.struct(*[F.col(k) for k in keys], F.lit(1).alias("__all")).alias("__of")).agg(F.count("*").alias("n"))
    rows = ordinal_rank(df, keys=keys).join(sizes, F.struct(*[F.col(k) for k in keys], F.lit(1).alias("__all")).eqNullSafe(F.col("__of"))).drop("__of")
    starts, stops = _edges(cdf[:3], F.col("n"), gapless)
    score = F.lit(4)
    for k in (3, 2, 1):
        score = F.when((F.col("rank") >= starts[k - 1]) & (F.col("rank") < stops[k - 1]), k).otherwise(score)
    return rows.withColumn("score", score).drop("n")


def cutoffs(df: DataFrame, cdf: list[float], by: str = "prediction", keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, k, cutoff: the predictions at the ranks int(n * cdf - 1), a negative rank counting from the end."""
    name = F.struct(*[F.col(k) for k in keys], F.lit(1).alias("__all"))
    want = df.groupBy(name.alias("__of")).agg(F.count("*").alias("__n"))
    want = want.withColumn("__c", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(c)).alias("c")) for k, c in enumerate(cdf[:3], 1)])))
    want = want.select("__of", F.col("__c.k").alias("k"), F.pmod((F.col("__n") * F.col("__c.c") - 1).cast("long"), F.col("__n")).alias("__at"))
    return ordinal_rank(df, by, keys).join(want, name.eqNullSafe(F.col("__of")) & (F.col("rank") == F.col("__at"))).select(*keys, "k", F.col(by).alias("cutoff"))


def cutoff_decode(prediction: Column, cuts: list[float]) -> Column:
    """The first k whose cutoff isn't exceeded, else 4."""
    out = F.lit(4)
    for k, c in reversed(list(enumerate(cuts, 1))):
        out = F.when(prediction <= c, k).otherwise(out)
    return out


def round_decode(prediction: Column) -> Column:
    """Half to even, at least 1."""
    return F.greatest(F.rint(prediction), F.lit(1.0)).cast("int")


def ceil_decode(prediction: Column) -> Column:
    """Rounded up, at least 1."""
    return F.greatest(F.ceil(prediction), F.lit(1)).cast("int")


def expected_value(probabilities: Column) -> Column:
    """Sum of class times probability."""
    return F.aggregate(F.transform(probabilities, lambda p, i: p * (i + 1)), F.lit(0.0), lambda s, x: s + x)


def ebc_rule(margins: Column, *, hard: bool = False) -> Column:
    """1 plus the first three margins, or the number of those above 0."""
    first = F.slice(margins, 1, 3)
    part = F.transform(first, lambda m: (m > 0).cast("double")) if hard else first
    return F.aggregate(part, F.lit(1.0), lambda s, x: s + x)


def cocr_rule(values: Column) -> Column:
    """1 plus the sum."""
    return F.aggregate(values, F.lit(1.0), lambda s, x: s + x)
