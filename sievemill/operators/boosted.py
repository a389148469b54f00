"""Boosted linear models: rounds of coordinate descent on summed gradients and Hessians.

In a round each row's gradient and Hessian of every output follow from any of
the objectives; the tasks sum them up with the features, and with the features'
products, and the driver goes through the bias and the features in turn, each
step changing the gradients of those to come by the products' sums.  So a round
is one pass over the rows, and what comes to the driver is a square of the
number of features, MOST at most.  With squared loss the sums of the first
round serve all rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import sigmoid, softmax
from . import objectives

MOST = 2048


@dataclass
class Objective:
    """rows: (id, label 1..K, preds, weight) -> (id, k or n, grad, hess); outputs: by the number of classes; value: predictions as one rating."""

    rows: Callable[[DataFrame], DataFrame]
    outputs: Callable[[int], int]
    value: Callable[[Column], Column]
    quadratic: bool = False


def _expected(p: Column) -> Column:
    """Mean class of a soft maximum."""
    return F.aggregate(F.transform(softmax(p), lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)


def _summed(part: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda p: F.aggregate(F.transform(p, part), F.lit(0.0), lambda s, x: s + x)


OBJECTIVES: dict[str, Objective] = {
    "squared": Objective(objectives.squared_rows, lambda k: 1, lambda p: p[0], True),
    "softmax": Objective(objectives.softmax_rows, lambda k: k, _expected),
    "soft_kappa": Objective(objectives.softkappa_rows, lambda k: k, _expected),
    "ebc": Objective(objectives.ebc_rows, lambda k: k - 1, lambda p: 1 + _summed(sigmoid)(p)),
    "cocr": Objective(lambda df: objectives.cocr_rows(df.withColumn("label", F.col("label") - 1)), lambda k: k - 1, lambda p: 1 + _summed(lambda x: x)(p)),
}


@dataclass
class Linear:
    """A row of weights for each output, the bias first."""

    weights: np.ndarray
    base: float

    def preds(self, features: str = "features") -> Column:
        def one(w: np.ndarray) -> Column:
            at = F.array(*[F.lit(float(x)) for x in w[1:]]) if len(w) > 1 else F.array().cast("array<double>")
            return F.aggregate(F.zip_with(features, at, lambda x, y: x * y), F.lit(float(w[0]) + self.base), lambda s, x: s + x)

        return F.array(*[one(w) for w in self.weights])


def _sums(rows: DataFrame, width: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """k -> (summed gradients of bias and features, summed products with the Hessian) of rows (id: the features, k, grad, hess)."""
    size = width + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.ones((batch.num_rows, size))
            x[:, 1:] = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            k, g, h = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            for out in np.unique(k).tolist():
                own = k == out
                total = held.setdefault(out, np.zeros((size + 1, size)))
                total[0] += g[own] @ x[own]
                total[1:] += x[own].T @ (x[own] * h[own, None])
        for out, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(total.size, out, np.int32)), pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["k", "place", "v"])

    name = "k" if "k" in rows.columns else "n"
    parts = rows.select("id", F.col(name).cast("int").alias("k"), "grad", "hess").mapInArrow(run, "k int, place int, v double")
    found = parts.groupBy("k", "place").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for k, own in found.groupby("k"):
        total = np.zeros((size + 1) * size)
        total[own["place"].to_numpy()] = own["v"].to_numpy()
        out[int(k)] = total[:size], total[size:].reshape(size, size)
    return out


def descend(weights: np.ndarray, slope: np.ndarray, bend: np.ndarray, *, eta: float, l1: float, l2: float, l2_bias: float) -> np.ndarray:
    """One round: bias and features in turn to the least of their quadratic, `eta` of the way; the new weights, and slope for them in place."""
    out = weights.copy()
    for j in range(len(out)):
        if bend[j, j] < 1e-12:
            continue
        keep, pull = (l2_bias, 0.0) if j == 0 else (l2, l1)
        want = bend[j, j] * out[j] - slope[j]
        want = np.sign(want) * max(abs(want) - pull, 0.0) / (bend[j, j] + keep)
        step = eta * (want - out[j])
        out[j] += step
        slope += bend[:, j] * step
    return out


def fit(rows: DataFrame, objective: str, *, classes: int = 4, rounds: int = 20, eta: float = 0.5, l1: float = 0.0, l2: float = 1.0, l2_bias: float = 0.0, base: float = 0.5) -> Linear:
    """A model of rows (features array, label, weight); labels of all objectives but `squared` are 1..classes.

    Rows with a null or a non-finite number are left out; without rows all
    weights are 0.  Every row has as many features as the first.
    """
    goal = OBJECTIVES[objective]
    good = F.forall("features", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.select(F.col("features").cast("array<double>").alias("features"), F.col("label").cast("double").alias("label"), F.col("weight").cast("double").alias("weight"))
    rows = rows.where("features is not null and label is not null and weight is not null").where(good).persist()
    try:
        first = rows.select(F.size("features").alias("n")).first()
        width = first.n if first else 0
        if width > MOST:
            raise ValueError(f"{width} features; {MOST} at most")
        model = Linear(np.zeros((goal.outputs(classes), width + 1)), base if goal.quadratic else 0.0)
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for _ in range(rounds if first else 0):
            if not sums or not goal.quadratic:
                made = goal.rows(rows.select(F.col("features").alias("id"), "label", "weight", model.preds().alias("preds")))
                sums = _sums(made, width)
            for k, (slope, bend) in sums.items():
                model.weights[k - 1] = descend(model.weights[k - 1], slope, bend, eta=eta, l1=l1, l2=l2, l2_bias=l2_bias)
    finally:
        rows.unpersist()
    return model


def predict(rows: DataFrame, model: Linear, objective: str) -> DataFrame:
    """`rows` with prediction: a value, or a rating from the outputs of a class objective."""
    return rows.withColumn("prediction", OBJECTIVES[objective].value(model.preds()))
