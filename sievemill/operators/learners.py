"""Regression and ordinal learners, cross-validation and seeded search.

Boosted linear learners are `boosted`'s, other linear and tree learners those of
pyspark.ml.  The rest are small numpy fits that run one per group of (run, fold,
trial) on the cluster.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Estimator
from pyspark.ml.classification import LogisticRegression, OneVsRest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import FMRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosted
from .decode import cdf_decode, ordinal_rank

#: Numbers of lifted rows that a fit holds at a time.
LIFTED = 1 << 22

Fit = Callable[[np.ndarray, np.ndarray, np.ndarray, dict, np.random.Generator], Callable[[np.ndarray], np.ndarray]]


def _linear(alpha: float):
    return lambda p: LinearRegression(labelCol="label", weightCol="weight", elasticNetParam=p.get("alpha", alpha), regParam=p.get("reg", 0.01))


#: Learners of pyspark.ml by name: parameters -> estimator.
BUILT_IN: dict[str, Callable[[dict], Estimator]] = {
    "ridge": _linear(0.0),
    "lasso": lambda p: LinearRegression(labelCol="label", elasticNetParam=1.0, regParam=p.get("reg", 0.01), standardization=True),
    "reg_tree": lambda p: GBTRegressor(labelCol="label", weightCol="weight", maxIter=int(p.get("rounds", 20)), maxDepth=int(p.get("depth", 4)), stepSize=p.get("eta", 0.1), subsamplingRate=p.get("subsample", 1.0), seed=2015),
    "gbm": lambda p: GBTRegressor(labelCol="label", weightCol="weight", maxIter=int(p.get("rounds", 20)), maxDepth=int(p.get("depth", 4)), stepSize=p.get("eta", 0.1), featureSubsetStrategy=p.get("features", "onethird"), seed=2015),
    "forest": lambda p: RandomForestRegressor(labelCol="label", weightCol="weight", numTrees=int(p.get("trees", 20)), maxDepth=int(p.get("depth", 6)), seed=2015),
    "factorization": lambda p: FMRegressor(labelCol="label", factorSize=int(p.get("k", 4)), maxIter=int(p.get("iterations", 50)), stepSize=p.get("eta", 0.05), seed=2015),
    "logistic": lambda p: OneVsRest(classifier=LogisticRegression(regParam=p.get("reg", 0.01)), labelCol="label", weightCol="weight"),
}


#: Boosted linear learners by name: their objective.
BOOSTED = {"reg_linear": "squared", "softmax": "softmax", "ebc": "ebc", "cocr": "cocr", "soft_kappa": "soft_kappa"}


def balanced_weights(train: DataFrame, label: str = "label") -> DataFrame:
    """Add weight: rows over classes times the class's rows."""
    sizes = train.groupBy(label).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("all"), F.count("*").alias("k"))
    return train.join(sizes.crossJoin(total), label).withColumn("weight", F.col("all") / (F.col("k") * F.col("n"))).drop("n", "all", "k")


def fit_predict(name: str, train: DataFrame, valid: DataFrame, params: dict) -> DataFrame:
    """valid (x array, features vector) with prediction: regressions as they are, classes as expected values; ordinal learners sum their thresholds."""
    if name in BOOSTED:
        model = boosted.fit(train.select(F.col("x").alias("features"), "label", "weight"), BOOSTED[name], **params)
        return boosted.predict(valid.withColumn("features", F.col("x")), model, BOOSTED[name]).select(*valid.columns, "prediction")
    model = BUILT_IN[name](params).fit(train)
    return model.transform(valid).select(*valid.columns, F.col("prediction").cast("double").alias("prediction"))


def refit(name: str, rows: DataFrame, test: DataFrame, params: dict, classes: int = 4) -> DataFrame:
    """id, prediction, rank (from 0, by prediction and id), score of `test` (id, x array) by the learner, fitted on all of `rows` (id, label 1..classes, weight, x array, features vector).

    Ratings follow the shares of the labels.  An empty `test` gives no rows.
    """
    share = [F.avg((F.col("label") <= k).cast("double")).alias(str(k)) for k in range(1, classes)]
    cdf = [float(c or 0.0) for c in rows.agg(*share).first()]
    blank = test.select("id", "x").withColumn("features", array_to_vector("x"))
    made = fit_predict(name, rows, blank, params).select("id", "prediction")
    scored = cdf_decode(made, [F.lit(c) for c in cdf])
    return ordinal_rank(scored).select("id", "prediction", F.col("rank").cast("long").alias("rank"), "score")


def _ordered_sums(high: np.ndarray, low: np.ndarray, w: np.ndarray, total: np.ndarray) -> None:
    """Add to `total` the number, slope and bend of the logistic loss of all pairs of a row of `high` above one of `low`."""
    width = len(w)
    up, down = np.clip(high @ w, -250, 250), np.clip(low @ w, -250, 250)
    up, down = np.exp(up), np.exp(down)
    for at in range(0, len(high), max(1, (1 << 18) // len(low))):  # a chunk stays in the cache
        a, some = high[at : at + max(1, (1 << 18) // len(low))], up[at : at + max(1, (1 << 18) // len(low))]
        p = down / np.add.outer(some, down)
        total[1 : 1 + width] -= p.sum(axis=1) @ a - p.sum(axis=0) @ low
        p -= p * p
        cross = a.T @ (p @ low)
        total[1 + width :] += ((a.T * p.sum(axis=1)) @ a + (low.T * p.sum(axis=0)) @ low - cross - cross.T).ravel()
    total[0] += len(high) * len(low)


def rank_fit(rows: DataFrame, group: str, *, reg: float = 0.01, block: int = 500, rounds: int = 12) -> list[float]:
    """Weights of a linear score that orders rows (id, label, features) of one group by label: the logistic loss of all pairs with different labels, by Newton's method.

    Rows are packed in blocks of about `block` by a hash of their id, and each
    two blocks of a group meet once: no pair is a row, a task holds two blocks,
    and of a round only sums come to the driver.  Meetings are dealt by both
    blocks, so that few groups don't make few tasks.  The work is all pairs.
    """
    width = rows.select(F.max(F.size("features")).alias("n")).first().n or 0
    scale = rows.agg(*[F.stddev_pop(F.col("features")[i]).alias(str(i)) for i in range(width)]).first() if width else ()
    scale = np.array([x or 1.0 for x in scale], float)
    number = rows.groupBy(group).agg((F.floor(F.count("*") / block) + 1).alias("blocks"))
    packed = rows.join(number, group).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    packed = packed.groupBy(group, "block").agg(F.first("blocks").alias("blocks"), F.collect_list("label").alias("y"), F.collect_list("features").alias("x"))
    side = lambda n, places: packed.select(group, F.explode(places).alias("other"), "block", F.col("y").alias(f"y{n}"), F.col("x").alias(f"x{n}"))
    one = side(1, F.sequence("block", F.col("blocks") - 1)).withColumnsRenamed({"block": "b1", "other": "b2"})
    two = side(2, F.sequence(F.lit(0).cast("long"), "block")).withColumnsRenamed({"block": "b2", "other": "b1"})
    pairs = number.agg(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2)).first()[0] or 0
    tasks = int(max(1, min(pairs // 8 + 1, 8 * rows.sparkSession.sparkContext.defaultParallelism)))
    met = one.join(two, [group, "b1", "b2"]).select("b1", "b2", "y1", "x1", "y2", "x2").repartition(tasks, "b1", "b2").persist()

    def sums(w: np.ndarray):
        def run(batches):
            total = np.zeros(1 + width + width * width)
            for batch in batches:
                for r in range(batch.num_rows):
                    (y1, a), (y2, b) = ((batch.column(f"y{k}")[r].values.to_numpy(zero_copy_only=False), batch.column(f"x{k}")[r].values.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) / scale) for k in (1, 2))
                    for v in np.unique(y1):
                        own, below, above = a[y1 == v], b[y2 < v], b[y2 > v]
                        if len(below):
                            _ordered_sums(own, below, w, total)
                        if len(above) and batch.column("b1")[r] != batch.column("b2")[r]:
                            _ordered_sums(above, own, w, total)
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["total"])

        return run

    w = np.zeros(width)
    for _ in range(rounds):
        parts = [r.total for r in met.mapInArrow(sums(w), "total array<double>").collect()]  # one row a task
        total = np.sum(parts, axis=0) if parts else np.zeros(1 + width + width * width)
        if not total[0]:
            break
        slope = total[1 : 1 + width] / total[0] + reg * w
        bend = total[1 + width :].reshape(width, width) / total[0] + reg * np.eye(width)
        step = np.linalg.solve(bend, slope)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    met.unpersist()
    return (w / scale).tolist()


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = x.std(axis=0)
    return x.mean(axis=0), np.where(s > 0, s, 1.0)


def extra_trees(x, y, w, p, rng):
    """Trees with random borders on all rows."""

    def grow(rows: np.ndarray, depth: int):
        value = float(np.average(y[rows], weights=w[rows]))
        if depth == 0 or len(rows) < p.get("min_rows", 5) or y[rows].std() == 0:
            return value
        best = None
        for j in rng.choice(x.shape[1], max(1, int(x.shape[1] * p.get("features", 0.7))), replace=False):
            low, high = x[rows, j].min(), x[rows, j].max()
            if low == high:
                continue
            cut = rng.uniform(low, high)
            left = x[rows, j] <= cut
            cost = sum(y[rows][s].var() * s.sum() for s in (left, ~left) if s.any())
            if left.any() and (~left).any() and (best is None or cost < best[0]):
                best = (cost, j, cut, left)
        if best is None:
            return value
        _, j, cut, left = best
        return j, cut, grow(rows[left], depth - 1), grow(rows[~left], depth - 1)

    trees = [grow(np.arange(len(y)), int(p.get("depth", 8))) for _ in range(int(p.get("trees", 20)))]

    def one(tree, z: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(z), tree)
        j, cut, a, b = tree
        left = z[:, j] <= cut
        out = np.empty(len(z))
        out[left], out[~left] = one(a, z[left]), one(b, z[~left])
        return out

    return lambda z: np.mean([one(t, z) for t in trees], axis=0)


def support_vectors(x, y, w, p, rng):
    """Epsilon-insensitive regression on random Fourier features of the RBF kernel, by averaged subgradient steps."""
    m, s = _scaled(x)
    dim, gamma = int(p.get("dim", 200)), p.get("gamma", 0.1)
    freq, phase = rng.normal(size=(x.shape[1], dim)) * np.sqrt(2 * gamma), rng.uniform(0, 2 * np.pi, dim)
    lift = lambda z: np.sqrt(2 / dim) * np.cos(((z - m) / s) @ freq + phase)
    a, b, c, eps = np.zeros(dim), float(np.average(y, weights=w)), p.get("C", 1.0), p.get("epsilon", 0.1)
    chunks = [slice(at, at + max(1, LIFTED // dim)) for at in range(0, len(x), max(1, LIFTED // dim))]
    held = [lift(x[c]) for c in chunks] if len(chunks) == 1 else None  # a larger table is lifted again for each step
    mean_a, mean_b = np.zeros(dim), 0.0
    for t in range(1, int(p.get("steps", 300)) + 1):
        slope, level = np.zeros(dim), 0.0
        for k, at in enumerate(chunks):
            f = held[k] if held else lift(x[at])
            r = y[at] - f @ a - b
            g = w[at] * np.sign(r) * (np.abs(r) > eps)
            slope += f.T @ g
            level += g.sum()
        rate = p.get("eta", 1.0) / np.sqrt(t)
        a += rate * (slope / len(y) - a / (c * len(y)))
        b += rate * level / len(y)
        mean_a += (a - mean_a) / t
        mean_b += (b - mean_b) / t
    cuts = lambda n: range(0, n, max(1, LIFTED // dim))
    return lambda z: np.concatenate([lift(z[at : at + max(1, LIFTED // dim)]) @ mean_a + mean_b for at in cuts(len(z))] or [np.zeros(0)])


def neural_net(x, y, w, p, rng):
    """Two hidden layers of rectified units with dropout, Adam, squared loss."""
    m, s = _scaled(x)
    z0, sizes = (x - m) / s, [x.shape[1], int(p.get("hidden", 32)), int(p.get("hidden", 32)), 1]
    ws = [rng.normal(size=(a, b)) * np.sqrt(2 / a) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
    bs = [np.zeros(b) for b in sizes[1:]]
    bs[-1][:] = np.average(y, weights=w)
    moments = [[np.zeros_like(t), np.zeros_like(t)] for t in (*ws, *bs)]
    keep = 1 - p.get("dropout", 0.1)
    for t in range(1, int(p.get("steps", 300)) + 1):
        acts, masks = [z0], []
        for i in range(3):
            h = acts[-1] @ ws[i] + bs[i]
            if i < 2:
                mask = (h > 0) * (rng.random(h.shape) < keep) / keep
                masks.append(mask)
                h = h * mask
            acts.append(h)
        d = (2 * w * (acts[-1][:, 0] - y) / len(y))[:, None]
        gw, gb = [], []
        for i in (2, 1, 0):
            gw.insert(0, acts[i].T @ d)
            gb.insert(0, d.sum(axis=0))
            if i:
                d = (d @ ws[i].T) * masks[i - 1]
        for value, grad, mo in zip((*ws, *bs), (*gw, *gb), moments, strict=True):
            mo[0] += 0.1 * (grad - mo[0])
            mo[1] += 0.001 * (grad * grad - mo[1])
            value -= p.get("eta", 0.01) * (mo[0] / (1 - 0.9**t)) / (np.sqrt(mo[1] / (1 - 0.999**t)) + 1e-8)

    def apply(q: np.ndarray) -> np.ndarray:
        h = (q - m) / s
        for i in range(3):
            h = h @ ws[i] + bs[i]
            h = np.maximum(h, 0) if i < 2 else h
        return h[:, 0]

    return apply


#: Learners of numpy by name.
CUSTOM: dict[str, Fit] = {"extra_trees": extra_trees, "svr": support_vectors, "neural_net": neural_net}


def cross_predict(samples: DataFrame, name: str, params: dict, seed: int = 2015, bag: float = 1.0) -> DataFrame:
    """run, fold, id, target, prediction of the validation rows of (run, fold, split, id, label, weight, features array), one numpy fit per (run, fold).

    bag < 1 fits on a sample of that share, drawn by 2015 + 1000 run + 10 fold.
    """
    fit = CUSTOM[name]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        run, fold = (k.as_py() for k in key)
        rng = np.random.default_rng(seed + 1000 * run + 10 * fold)
        ids, x, y, w, train = _fold(table)
        valid = ~train
        if bag < 1:
            train &= rng.random(len(train)) < bag
        model = fit(x[train], y[train], w[train], params, rng)
        return _predicted({"run": run, "fold": fold}, ids[valid], y[valid], model(x[valid]))

    return samples.select("run", "fold", "split", "id", "label", "weight", "features").groupBy("run", "fold").applyInArrow(run, "run int, fold int, id bigint, target int, prediction double")


def _fold(table: pa.Table) -> tuple[np.ndarray, ...]:
    """ids, features, labels, weights and whether it trains, of each row of a fold by id: flat arrays, not an object a row."""
    ids = table["id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    lists = table["features"].combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    if (sizes != sizes[0]).any():
        raise ValueError("rows must have as many features each")
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)[order]
    y, w = (table[c].to_numpy().astype(float)[order] for c in ("label", "weight"))
    return ids[order], x, y, w, pc.equal(table["split"], "train").to_numpy()[order]


def _predicted(keys: dict[str, int], ids: np.ndarray, y: np.ndarray, p: np.ndarray) -> pa.Table:
    named = {k: pa.array(np.full(len(ids), v), pa.int32()) for k, v in keys.items()}
    return pa.table({**named, "id": pa.array(ids, pa.int64()), "target": pa.array(y.astype(np.int32)), "prediction": pa.array(p, pa.float64())})


@dataclass(frozen=True)
class Space:
    """A distribution of a search parameter: uniform, loguniform (of logs), quniform (steps of q) or choice."""

    kind: str
    low: float = 0.0
    high: float = 1.0
    q: float = 1.0
    options: tuple = ()

    def draw(self, rng: np.random.Generator) -> Any:
        if self.kind == "choice":
            return self.options[int(rng.integers(len(self.options)))]
        u = float(rng.uniform(self.low, self.high))
        return {"uniform": u, "loguniform": float(np.exp(u)), "quniform": round(u / self.q) * self.q}[self.kind]


def draw_trials(space: dict[str, Space], n: int, seed: int = 2015, whole: tuple[str, ...] = ()) -> list[dict]:
    """n seeded draws; parameters in `whole` become integers."""
    rng = np.random.default_rng(seed)
    out = [{k: s.draw(rng) for k, s in sorted(space.items())} for _ in range(n)]
    return [{k: int(v) if k in whole else v for k, v in t.items()} for t in out]


def search(samples: DataFrame, name: str, trials: list[dict], seed: int = 2015) -> DataFrame:
    """trial, run, fold, id, target, prediction of every trial: fits are spread over (trial, run, fold)."""
    fit = CUSTOM[name]
    rows = samples.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(len(trials) - 1))))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        trial, run, fold = (k.as_py() for k in key)
        rng = np.random.default_rng(seed + 1000 * run + 10 * fold)
        ids, x, y, w, train = _fold(table)
        model = fit(x[train], y[train], w[train], trials[trial], rng)
        return _predicted({"trial": trial, "run": run, "fold": fold}, ids[~train], y[~train], model(x[~train]))

    return rows.groupBy("trial", "run", "fold").applyInArrow(run, "trial int, run int, fold int, id bigint, target int, prediction double")


def matching_models(names: list[str], parts: list[str]) -> list[str]:
    """Names that contain any of the parts."""
    return [n for n in names if any(p in n for p in parts)]
