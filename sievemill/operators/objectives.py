"""Gradients, Hessians and losses of the custom learners, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import softmax


def ebc_rows(df: DataFrame, classes: int = 4) -> DataFrame:
    """Extended binary rows of (id, label 1..K, preds array, weight): k, grad, hess for each threshold k < K."""
    rows = df.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(classes - 1))))
    y = F.when(F.col("label") > F.col("k"), 1.0).otherwise(-1.0)
    w = F.abs(F.pow(y - F.col("k"), F.lit(2.0)) - F.pow(y - (F.col("k") + 1), F.lit(2.0))) * F.col("weight")
    s = F.exp(y * F.element_at("preds", F.col("k")))
    return rows.select("id", "k", (-w * y / (1 + s)).alias("grad"), (w * s / F.pow(1 + s, F.lit(2.0))).alias("hess"))


def ebc_binary(df: DataFrame) -> DataFrame:
    """grad, hess of rows that are +1 / -1 already."""
    s = F.exp(F.col("label") * F.col("pred"))
    return df.select("id", (-F.col("weight") * F.col("label") / (1 + s)).alias("grad"), (F.col("weight") * F.pow(F.col("label"), F.lit(2.0)) * s / F.pow(1 + s, F.lit(2.0))).alias("hess"))


def cocr_rows(df: DataFrame) -> DataFrame:
    """id, k, grad, hess for (id, label 0..K-1, preds array, weight): one weighted square loss for each k."""
    rows = df.select("id", "label", "weight", F.posexplode("preds").alias("i", "p")).withColumn("k", F.col("i") + 1)
    w = F.abs(F.pow(F.col("label") - F.col("k"), F.lit(2.0)) - F.pow(F.col("label") - (F.col("k") - 1), F.lit(2.0)))
    b = (F.col("label") >= F.col("k")).cast("double")
    return rows.select("id", "k", (2 * w * (F.col("p") - b) * F.col("weight")).alias("grad"), (2 * w * F.col("weight")).alias("hess"))


def squared_rows(df: DataFrame) -> DataFrame:
    """id, k = 1, grad, hess of half the weighted squared error for (id, label, preds array, weight)."""
    return df.select("id", F.lit(1).alias("k"), ((F.col("preds")[0] - F.col("label")) * F.col("weight")).alias("grad"), F.col("weight").alias("hess"))


def softmax_rows(df: DataFrame) -> DataFrame:
    """id, k, grad, hess of the weighted log loss of a soft maximum for (id, label 1..K, preds array, weight); the Hessian is twice the diagonal, which bounds the whole."""
    rows = df.select("id", "label", "weight", F.posexplode(softmax(F.col("preds"))).alias("i", "p")).withColumn("k", F.col("i") + 1)
    hit = (F.col("label") == F.col("k")).cast("double")
    return rows.select("id", "k", ((F.col("p") - hit) * F.col("weight")).alias("grad"), (2 * F.col("p") * (1 - F.col("p")) * F.col("weight")).alias("hess"))


def softkappa_rows(df: DataFrame, scale: float = 0.000125, *, predicted_histogram: bool = False) -> DataFrame:
    """id, n, grad, hess of the smooth kappa for (id, label 1..K, preds array, weight).

    Two passes: one aggregates the observed and expected disagreement, the next
    derives each row's gradient; the Hessian is rescaled to mean `scale`, then
    its absolute value taken.  `predicted_histogram` takes the predicted class
    mass, and its derivative, in the expected part (the older form).
    """
    first = df.select("preds").first()
    if first is None:
        return df.select("id", F.lit(0).alias("n"), F.lit(0.0).alias("grad"), F.lit(0.0).alias("hess")).limit(0)
    k = len(first[0])
    rows = df.select("id", "label", "weight", softmax(F.col("preds")).alias("p"))
    cost = lambda n: F.pow(F.col("label") - F.lit(n), F.lit(2.0))
    seen = sum((cost(n) * F.col("p")[n - 1] for n in range(1, k + 1)), F.lit(0.0))
    sums = rows.agg(F.sum(seen).alias("o"), F.count("*").alias("m"), *[F.sum((F.col("label") == n).cast("double")).alias(f"h{n}") for n in range(1, k + 1)], *[F.sum(F.col("p")[n - 1]).alias(f"g{n}") for n in range(1, k + 1)]).first()
    h = [sums[f"h{n}"] for n in range(1, k + 1)]
    g = [sums[f"g{n}"] for n in range(1, k + 1)] if predicted_histogram else h
    e = sum((i - j) ** 2 * h[i] * g[j] for i in range(k) for j in range(k))
    o, m = sums["o"], sums["m"]
    parts = []
    for n in range(k):
        p = F.col("p")[n]
        spread = cost(n + 1) - seen
        d_o, d2_o = p * spread, p * (1 - 2 * p) * spread
        if predicted_histogram:
            pull = [sum((i - j) ** 2 * h[j] for j in range(k)) for i in range(k)]
            lean = F.lit(float(pull[n])) - sum((F.col("p")[i] * pull[i] for i in range(k)), F.lit(0.0))
            d_e, d2_e = p * lean, p * (1 - 2 * p) * lean
        else:
            d_e = d2_e = F.lit(0.0)
        first = d_o * e - o * d_e
        grad = m * first / e**2
        hess = m * ((d2_o * e - o * d2_e) * e**2 - first * 2 * e * d_e) / e**4
        parts.append(F.struct(F.lit(n + 1).alias("n"), grad.alias("grad"), hess.alias("hess")))
    rows = rows.select("id", "weight", F.explode(F.array(*parts)).alias("x")).select("id", "weight", "x.*")
    mean = rows.agg(F.avg(F.abs("hess"))).first()[0] or 1.0
    weight = F.lit(1.0) if predicted_histogram else F.col("weight")
    return rows.select("id", "n", (F.col("grad") * weight).alias("grad"), (F.abs(F.col("hess") * (scale / mean)) * weight).alias("hess"))


def _exp(x: Column) -> Column:
    return F.exp(F.greatest(F.lit(-500.0), F.least(F.lit(500.0), x)))


def forest_loss(kind: str, p: Column, y: Column, adjust: float = 0.0) -> Column:
    """Loss of prediction p at target y, exponents clipped to +-500."""
    py, square = p * y, (y - p) * (y - p) / 2
    q = 1 / (1 + _exp(-p))
    return {
        "LS": square,
        "Expo": _exp(-(py - adjust)),
        "Log": F.log(1 + _exp(-py)),
        "LogRe": -y * F.log(q) - (1 - y) * F.log(1 - q),
        "LogRe2": F.log(1 + _exp(p - y)) * 2 - (p - y) - F.lit(2.0) * F.log(F.lit(2.0)),
        "Logit": F.log(1 + _exp(-2 * py)),
        "ModLS": F.when(py <= 1, square).otherwise(0.0),
        "ModHuber": F.when(py <= -1, -2 * py).when(py < 1, square).otherwise(0.0),
    }[kind]


def forest_derivatives(kind: str, p: Column, y: Column, adjust: float = 0.0) -> tuple[Column, Column]:
    """(minus the first, the second) derivative in p."""
    if kind == "LS":
        return y - p, F.lit(1.0)
    if kind == "Expo":
        e = _exp(-(p * y - adjust))
        return y * e, y * y * e
    if kind == "LogRe":
        q = 1 / (1 + _exp(-p))
        return y - q, q * (1 - q)
    if kind == "LogRe2":
        q = 1 / (1 + _exp(-(p - y)))
        return 1 - 2 * q, 2 * q * (1 - q)
    if kind in ("Log", "Logit"):
        c = 1.0 if kind == "Log" else 2.0
        e = _exp(-c * p * y)
        return c * y * e / (1 + e), c * c * y * y * e / ((1 + e) * (1 + e))
    raise ValueError(f"no derivatives for {kind}")


def summed_derivatives(df: DataFrame, kind: str, leaf: str, *, weight: str | None = None) -> DataFrame:
    """leaf, d1, d2: sums over each leaf's rows (p, y), weighted if asked."""
    d1, d2 = forest_derivatives(kind, F.col("p"), F.col("y"))
    w = F.col(weight) if weight else F.lit(1.0)
    return df.groupBy(leaf).agg(F.sum(d1 * w).alias("d1"), F.sum(d2 * w).alias("d2"))


def expo_adjustment(df: DataFrame) -> float:
    """Mean of p * y clipped to +-500, which keeps exponential losses in range."""
    mean = df.agg(F.avg(F.col("p") * F.col("y"))).first()[0] or 0.0
    return max(-500.0, min(500.0, mean))
