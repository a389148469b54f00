"""Whitening of embeddings on a distributed row matrix.

Entries are quantised to whole numbers, so counts, sums and deviations are
exact.  Each distinct vector counts once: n vectors x with sums S.  The rows of
the matrix are (n * x - S) / n, one rounding from the exact difference, so
nothing is lost by subtracting large squares later.  The Gramian of the rows
over n is the covariance; its eigenvectors are found on the driver (a square of
the number of dimensions) and sent to the tasks that project all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written

#: An entry c is counted as floor(SCALE * c) + OFFSET; beyond WIDEST it counts as WIDEST.
SCALE, OFFSET, WIDEST = 64, 1_000_000, 1 << 61
#: Components of no more than this share of the total variance aren't divided by their deviation.
FLAT = 1e-12
#: Dimensions that a matrix may have: the driver holds its square.
MOST = 4096


@dataclass
class Whitening:
    """What is fitted: n vectors with sums S; eigenvalues, falling, and eigenvectors as columns; the error is taken over the fitted rows."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    def whole(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64-bit numbers if they fit, else Python's."""
        most = max([int(np.abs(x).max(initial=0)) * self.n, *map(abs, self.sums)])
        if most < 1 << 62:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def project(self, whole: np.ndarray) -> np.ndarray:
        """The whitened components of rows n * x - S; not a number where a component is flat."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.values > FLAT * self.trace, 1 / np.sqrt(self.values), np.nan)
        return (whole.astype(np.float64) / self.n) @ (self.vectors * scale)

    def deviations(self, whole: np.ndarray) -> list[int | None]:
        """The exact sum of squares of each row; null beyond 64 bits."""
        if int(np.abs(whole).max(initial=0)) ** 2 * whole.shape[1] < 1 << 63:
            return (whole.astype(np.int64) ** 2).sum(axis=1).tolist()
        return [s if s < 1 << 63 else None for s in (whole.astype(object) ** 2).sum(axis=1).tolist()]


def quantised(rows: DataFrame, vector: str) -> DataFrame:
    """`rows` whose vector is whole and finite, with x, its entries as long numbers."""
    c = lambda v: v.cast("double")
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(c(v)) | (F.abs(c(v)) == float("inf")))
    rows = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).where(~bad)
    edge = float(WIDEST)
    return rows.withColumn("x", F.transform(vector, lambda v: F.floor(F.greatest(F.lit(-edge), F.least(F.lit(edge), c(v) * SCALE))).cast("long") + OFFSET))


def _sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Vectors -> for each of their sizes and each place, the task's count and sum."""
    held: dict[int, tuple[int, np.ndarray]] = {}
    for frame in frames:
        for size, xs in frame["x"].groupby(frame["x"].map(len)):
            block = np.stack(xs.to_numpy())
            n, total = held.get(size, (0, np.zeros(size, object)))
            high, low = block >> 32, block & 0xFFFFFFFF  # halves can't overflow in a batch
            held[size] = n + len(xs), total + (high.sum(axis=0).astype(object) << 32) + low.sum(axis=0).astype(object)
    for size, (n, total) in held.items():
        yield pd.DataFrame({"size": size, "place": np.arange(size), "n": n, "total": [str(t) for t in total]})


def _gramian(rows: DataFrame, n: int, width: int) -> np.ndarray:
    """The Gramian of a column `row` of double arrays."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("row").alias("row")), "row")
    return RowMatrix(vectors, n, width).computeGramianMatrix().toArray()


def fit(x: DataFrame, count: int | None = None) -> Whitening | None:
    """The whitening of the distinct vectors of column x, its first `count` components or all; None if there is none.

    Vectors of several sizes have no common matrix: the size that most distinct
    vectors have is fitted, of equally many the largest.
    """
    spark = x.sparkSession
    distinct = written(x.select("x").distinct(), "fit-list")
    totals = distinct.mapInPandas(_sums, "size int, place int, n long, total string")
    totals = totals.groupBy("size", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    best = totals.where("place = 0").orderBy(F.desc("n"), F.desc("size")).limit(1).select("size", "n").first()
    if best is None:
        return None
    width, n = best["size"], best["n"]
    if width > MOST:
        raise ValueError(f"vectors of {width} entries; {MOST} at most")
    sums = [int(r["total"]) for r in totals.where(F.col("size") == width).orderBy("place").collect()]
    fitted = Whitening(n, sums, np.zeros(0), np.zeros((width, 0)), 0.0)
    held = spark.sparkContext.broadcast(fitted)

    def centred(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"row": list(held.value.whole(np.stack(frame["x"].to_numpy())).astype(np.float64) / n)})

    distinct = distinct.where(F.size("x") == width)
    covariance = _gramian(distinct.mapInPandas(centred, "row array<double>"), n, width) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(width)] < 0, -1, 1)
    keep = slice(0, min(width, count or width))
    fitted = Whitening(n, sums, values[keep], vectors[:, keep], float(np.trace(covariance)))
    fitted.identity_error = _identity_error(distinct, fitted)
    return fitted


def _identity_error(distinct: DataFrame, fitted: Whitening) -> float | None:
    """The largest entry of the covariance of the fit list's whitened rows, less the identity; components without variance stay out."""
    held = distinct.sparkSession.sparkContext.broadcast(fitted)
    live = np.flatnonzero(fitted.values > FLAT * fitted.trace)
    if not len(live):
        return None

    def projected(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            w = held.value
            yield pd.DataFrame({"row": list(w.project(w.whole(np.stack(frame["x"].to_numpy())))[:, live])})

    rows = written(distinct.mapInPandas(projected, "row array<double>"), "whitened")
    means = rows.select([F.avg(F.col("row")[i]) for i in range(len(live))]).first()
    middle = F.array([F.lit(float(m)) for m in means])
    rows = rows.select(F.zip_with("row", middle, lambda a, b: a - b).alias("row"))
    return float(np.abs(_gramian(rows, fitted.n, len(live)) / fitted.n - np.eye(len(live))).max())


def whiten(rows: DataFrame, count: int = 16, *, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each row and each of the first `count` components.

    Dropped are rows whose vector is null, empty, holds a null or non-finite
    entry, or has another size than most distinct vectors (of equally many the
    largest).  Equal vectors count once in the fit and have a row each in the
    result, as have null and repeated ids.  `deviation` is null beyond 64 bits,
    `whitened` where a component has no variance (all vectors equal: everywhere,
    as are `explained` and `identity_error`).  Other columns aren't read; an
    empty table gives no rows.
    """
    x = quantised(rows.select(F.col(id_col).alias("id"), F.col(vector).alias("v")), "v").select("id", "x")
    fitted = fit(x, count)
    if fitted is None:
        fitted = Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    held = rows.sparkSession.sparkContext.broadcast(fitted)

    def projected(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            w = held.value
            whole = w.whole(np.stack(frame["x"].to_numpy()))
            yield pd.DataFrame({"id": frame["id"], "deviation": pd.array(w.deviations(whole), dtype="Int64"), "w": list(w.project(whole))})

    # ids travel as text: pandas would make numbers beside nulls inexact
    out = x.where(F.size("x") == len(fitted.sums)).withColumn("id", F.col("id").cast("string"))
    out = out.mapInPandas(projected, "id string, deviation long, w array<double>").select("id", "deviation", F.posexplode("w").alias("at", "w"))
    share = F.array([F.lit(float(e / fitted.trace) if fitted.trace else None).cast("double") for e in fitted.values])
    return out.select(
        F.col("id").cast(rows.schema[id_col].dataType).alias(id_col),
        (F.col("at") + 1).alias("component"),
        F.lit(fitted.n).cast("long").alias("n"),
        "deviation",
        F.when(~F.isnan("w"), F.col("w")).alias("whitened"),
        share[F.col("at")].alias("explained"),
        F.lit(fitted.identity_error).cast("double").alias("identity_error"),
    )
