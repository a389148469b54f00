"""Greedy selection of models into a bagged, weighted ensemble."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import scratch
from .decode import cdf_decode, cutoff_decode
from .metrics import kappa


def bag_mean(predictions: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """keys, prediction: mean over bags."""
    return predictions.groupBy(*keys).agg(F.avg("prediction").alias("prediction"))


def weighted_mean(predictions: DataFrame, weights: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """keys, prediction: sum of weight times prediction over the sum of weights, of models in `weights` (model, weight)."""
    rows = predictions.join(weights, "model")
    total = F.sum("weight")
    return rows.groupBy(*keys).agg(F.when(F.abs(total) > 1e-9, F.sum(F.col("weight") * F.col("prediction")) / total).alias("prediction"))


def median_ensemble(predictions: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """keys, prediction: exact median over models."""
    return predictions.groupBy(*keys).agg(F.percentile("prediction", F.lit(0.5)).alias("prediction"))


def objective(predictions: DataFrame, cdfs: DataFrame, weights: DataFrame) -> DataFrame:
    """kappa_mean, kappa_std over (run, fold) of the weighted ensemble, decoded by each fold's distribution."""
    rows = weighted_mean(predictions, weights, ("run", "fold", "id", "target")).join(cdfs, ["run", "fold"])
    scored = cdf_decode(rows, [F.col("cdf")[i] for i in range(3)], ("run", "fold"))
    return kappa(scored, "score", "target", keys=("run", "fold")).agg(F.avg("kappa").alias("kappa_mean"), F.stddev_pop("kappa").alias("kappa_std"))


def apply_ensemble(test: DataFrame, chosen: DataFrame, cdf: list[float], *, cutoffs: list[float] | None = None) -> DataFrame:
    """id, prediction, score for test (model, id, prediction) and chosen (bag, model, weight): each bag's weighted mean, their mean, decoded by the shares of `cdf`, or by `cutoffs` of the prediction if they are given."""
    rows = test.join(chosen, "model").groupBy("bag", "id").agg((F.sum(F.col("weight") * F.col("prediction")) / F.sum("weight")).alias("prediction"))
    if cutoffs is not None:
        return bag_mean(rows).withColumn("score", cutoff_decode(F.col("prediction"), cutoffs))
    return cdf_decode(bag_mean(rows), [F.lit(c) for c in cdf]).select("id", "prediction", "score")


def rescaled_cutoffs(cuts: DataFrame, n_test: int, n_valid: int) -> DataFrame:
    """k, cutoff: mean over (run, fold), times the ratio of the test to the validation size."""
    return cuts.groupBy("k").agg((F.avg("cutoff") * (float(n_test) / n_valid)).alias("cutoff"))


def _decode(p: np.ndarray, cdf: np.ndarray) -> np.ndarray:
    out, n, order = np.full(len(p), 4), len(p), np.argsort(p, kind="stable")
    low = 0
    for k in range(3):
        out[order[low : max(0, int(n * cdf[k] - 1))]] = k + 1
        low = int(n * cdf[k])
    return out


def _kappa(a: np.ndarray, b: np.ndarray) -> float:
    d = np.subtract.outer(np.arange(5), np.arange(5)) ** 2
    due = (d * np.outer(np.bincount(a, minlength=5), np.bincount(b, minlength=5))).sum()
    return 1 - len(a) * ((a - b) ** 2).sum() / due if due else 0.0


def select_models(predictions: DataFrame, cdfs: DataFrame, *, bags: int = 10, fraction: float = 0.5, replacement: bool = False, top: int = 5, tries: int = 10, low: float = -1.0, high: float = 1.0, seed: int = 2015) -> DataFrame:
    """bag, step, model, weight, kappa: each bag starts from its `top` best models and adds the model and weight that raise the mean kappa most, until none does.

    The predictions are written once, a folder for each (run, fold).  A step of
    all bags is one job, whose tasks each score the candidates of a bag on one
    (run, fold): a task holds that fold's numbers, the driver what was chosen.
    """
    spark = predictions.sparkSession
    wide = predictions.groupBy("run", "fold", "id", "target").pivot("model").agg(F.first("prediction"))
    names = [c for c in wide.columns if c not in ("run", "fold", "id", "target")]
    path, cdf = scratch(spark, "folds"), {(r.run, r.fold): [float(c) for c in r.cdf] for r in cdfs.collect()}  # a row a fold
    wide = wide.select("run", "fold", "id", F.col("target").cast("int").alias("target"), *[F.col(f"`{m}`").cast("double").alias(f"p{j}") for j, m in enumerate(names)])
    wide.repartition("run", "fold").sortWithinPartitions("run", "fold", "id").write.partitionBy("run", "fold").parquet(path)
    parts = sorted((r.run, r.fold) for r in spark.read.parquet(path).select("run", "fold").distinct().collect() if (r.run, r.fold) in cdf)
    out_schema = "bag int, step int, model string, weight double, kappa double"
    if not parts:
        return spark.createDataFrame([], out_schema)

    def scores(work: list[tuple[list[tuple[int, float]], list[tuple[int, float]]]]) -> list[list[float]]:
        """The mean kappa of each candidate (model, weight) of each piece of work, after the models chosen before it."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in batch.column(0).to_pylist():
                    (r, f), (chosen, candidates) = parts[at % len(parts)], work[at // len(parts)]
                    x, y = _fold_of(f"{path}/run={r}/fold={f}", len(names))
                    now, total = np.zeros(len(y)), 0.0
                    for j, w in chosen:
                        now, total = (total * now + w * x[j]) / (total + w), total + w
                    found = [float(_kappa(_decode((total * now + w * x[j]) / (total + w), np.array(cdf[r, f])), y)) for j, w in candidates]
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([found], pa.list_(pa.float64()))], names=["at", "kappas"])

        n = len(parts) * len(work)
        rows = spark.range(0, n, 1, n).mapInArrow(run, "at bigint, kappas array<double>").collect()  # a number a candidate and fold
        found = {r["at"]: r["kappas"] for r in rows}
        return [np.mean([found[i * len(parts) + k] for k in range(len(parts))], axis=0).tolist() for i in range(len(work))]

    n = len(names)
    single = scores([([], [(j, 1.0) for j in range(n)])])[0]
    ranked = sorted(range(n), key=lambda j: (-single[j], names[j]))
    draws, models, chosen = [np.random.default_rng(seed + 100 * b) for b in range(bags)], [], []
    for rng in draws:
        taken = sorted(rng.integers(n, size=max(1, int(n * fraction)))) if replacement else [i for i in range(n) if rng.random() < fraction] or [0]
        models.append([ranked[i] for i in taken])
        chosen.append([(j, 1.0) for j in models[-1][:top]])
    first = [(b, k) for b in range(bags) for k in range(len(chosen[b]))]
    start = dict(zip(first, scores([(chosen[b][:k], [chosen[b][k]]) for b, k in first]), strict=True))
    kappas = [[start[b, k][0] for k in range(len(chosen[b]))] for b in range(bags)]
    going = list(range(bags))
    while going:  # the mean kappa of each bag rises with each step
        work = []
        for b in going:
            total = 0.0
            for _, w in chosen[b]:
                total += w
            tried = [(j, float(w)) for j in models[b] for w in draws[b].uniform(low, high, tries) * max(total, 1.0)]
            work.append((chosen[b], [(j, w) for j, w in tried if abs(total + w) >= 1e-6]))
        rising = []
        for b, (_, candidates), values in zip(going, work, scores(work), strict=True):
            best, found = kappas[b][-1] if kappas[b] else 0.0, None
            for c, value in zip(candidates, values, strict=True):
                if value > best:
                    best, found = value, c
            if found is not None:
                chosen[b].append(found)
                kappas[b].append(best)
                rising.append(b)
        going = rising
    out = [(b, k, names[j], w, kappas[b][k]) for b in range(bags) for k, (j, w) in enumerate(chosen[b])]
    return spark.createDataFrame(out, out_schema)


def _fold_of(path: str, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(each model's predictions, targets) of the files of one fold, by id."""
    store, top = fs.FileSystem.from_uri(path)
    files = sorted(f.path for f in store.get_file_info(fs.FileSelector(top)) if f.path.endswith(".parquet"))
    table = pa.concat_tables([pq.read_table(store.open_input_file(f)) for f in files])
    order = np.argsort(table["id"].to_numpy(), kind="stable")
    return [table[f"p{j}"].to_numpy()[order] for j in range(n)], table["target"].to_numpy()[order].astype(int)


def top_trials(trials: DataFrame, k: int = 10) -> DataFrame:
    """The k best trials of each model by kappa_mean, the first of equals."""
    place = F.row_number().over(W.partitionBy("model").orderBy(F.desc("kappa_mean"), "trial"))
    return trials.withColumn("place", place).where(F.col("place") <= k)


def best_trial(trials: DataFrame) -> DataFrame:
    """model, trial, kappa_mean of each model's best trial."""
    best = F.max_by(F.struct("trial", "kappa_mean"), F.struct("kappa_mean", -F.col("trial")))
    return trials.groupBy("model").agg(best.alias("b")).select("model", "b.*")


def model_order(trials: DataFrame) -> DataFrame:
    """model, kappa, place: models by their best kappa, falling."""
    per = trials.groupBy("model").agg(F.max("kappa_mean").alias("kappa"))
    return per.withColumn("place", F.row_number().over(W.orderBy(F.desc("kappa"), "model")))
