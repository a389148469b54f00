"""Guided search for parameters, with a log that a stopped search goes on from.

Past trials are split into few good ones and the rest.  Of each parameter both
have a density, a mixture of a kernel at each trial and the parameter's own
distribution; candidates are drawn from the good trials' density, and the one
with the greatest ratio of the two densities is tried.  Trials are proposed and
evaluated in batches; a batch depends on the seed and on the batches before it
alone, and is logged in one write.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.formats import append_trials
from .learners import Space

#: Random trials at the start; candidates of a proposal; one of so many past trials is good.
STARTUP, CANDIDATES, GOOD = 8, 24, 5
LOG = "trial int, kappa_mean double, kappa_std double, params map<string,string>"


def _kernels(points: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """(centres, widths) of a mixture: the points, and the whole range as one more; a point is as wide as the farther of its neighbours is far."""
    wide = high - low
    at = np.sort(np.append(points, (low + high) / 2))
    gaps = np.diff(np.concatenate([[low], at, [high]]))
    width = np.clip(np.maximum(gaps[:-1], gaps[1:]), wide / min(100, len(at) + 1), wide)
    width[np.searchsorted(at, (low + high) / 2)] = wide
    return at, width


def _density(x: np.ndarray, centres: np.ndarray, widths: np.ndarray, low: float, high: float) -> np.ndarray:
    """Mixture of normal densities cut off at the range's ends."""
    cdf = np.vectorize(lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2))))
    inside = cdf((high - centres) / widths) - cdf((low - centres) / widths)
    z = (x[:, None] - centres) / widths
    return (np.exp(-z * z / 2) / (widths * math.sqrt(2 * math.pi) * np.maximum(inside, 1e-12))).mean(axis=1)


def _number(space: Space, good: list, bad: list, rng: np.random.Generator) -> float:
    scale = math.log if space.kind == "loguniform" else float
    x, y = (np.array([scale(v) for v in side], float) for side in (good, bad))
    centres, widths = _kernels(x, space.low, space.high)
    k = rng.integers(len(centres), size=CANDIDATES)
    drawn = centres[k] + widths[k] * rng.normal(size=CANDIDATES)
    drawn = np.where((drawn < space.low) | (drawn > space.high), rng.uniform(space.low, space.high, CANDIDATES), drawn)
    ratio = np.log(_density(drawn, centres, widths, space.low, space.high)) - np.log(_density(drawn, *_kernels(y, space.low, space.high), space.low, space.high))
    best = float(drawn[int(ratio.argmax())])
    if space.kind == "loguniform":
        return math.exp(best)
    return round(best / space.q) * space.q if space.kind == "quniform" else best


def _option(space: Space, good: list, bad: list, rng: np.random.Generator) -> Any:
    share = lambda side: np.array([1 + sum(v == o for v in side) for o in space.options], float) / (len(side) + len(space.options))
    l, g = share(good), share(bad)
    drawn = rng.choice(len(space.options), size=CANDIDATES, p=l)
    return space.options[int(drawn[(l / g)[drawn].argmax()])]


def propose(space: dict[str, Space], past: list[tuple[dict, float]], trial: int, seed: int, startup: int = STARTUP) -> dict:
    """Parameters of a trial, after `past` trials of (parameters, score to be raised; not a number for a failed one)."""
    rng = np.random.default_rng([seed, trial])
    past = [(p, s if s == s else -math.inf) for p, s in past]
    if len(past) < startup:
        return {k: s.draw(rng) for k, s in sorted(space.items())}
    order = sorted(range(len(past)), key=lambda i: (-past[i][1], i))
    n = max(2, len(past) // GOOD)
    good, bad = ([past[i][0] for i in side] for side in (order[:n], order[n:]))
    pick = lambda s: _option if s.kind == "choice" else _number
    return {k: pick(s)(s, [p[k] for p in good], [p[k] for p in bad], rng) for k, s in sorted(space.items())}


def _parsed(space: dict[str, Space], params: dict[str, str]) -> dict:
    read = lambda s, v: next(o for o in s.options if str(o) == v) if s.kind == "choice" else float(v)
    return {k: read(s, params[k]) for k, s in space.items()}


def read_log(spark: SparkSession, log: str) -> DataFrame:
    """The trials of a log, none where there is no log yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(log)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).parquet(log)


def search(spark: SparkSession, space: dict[str, Space], evaluate: Callable[[list[dict]], list[tuple[float, float]]], log: str, trials: int, *, batch: int = 4, seed: int = 2015, startup: int = STARTUP) -> DataFrame:
    """The log after `trials` trials: trial, kappa_mean, kappa_std, params.

    `evaluate` gets a batch of parameters and returns a mean and a deviation of
    each.  A search that was stopped goes on from what its log has; it must be
    called with the same space, batch and seed.
    """
    while True:
        rows = read_log(spark, log).orderBy("trial").collect()  # a row a trial
        if len(rows) >= trials:
            return read_log(spark, log)
        past = [(_parsed(space, r.params), r.kappa_mean if r.kappa_mean is not None else math.nan) for r in rows]
        numbers = range(len(rows), min(trials, len(rows) + batch))
        params = [propose(space, past, t, seed, startup) for t in numbers]
        made = evaluate(params)
        table = [(t, float(m), float(s), {k: str(v) for k, v in p.items()}) for t, p, (m, s) in zip(numbers, params, made, strict=True)]
        append_trials(spark.createDataFrame(table, LOG).coalesce(1), log)


def best(log: DataFrame) -> DataFrame:
    """The trial with the greatest mean, the first of equals."""
    return log.orderBy(F.desc("kappa_mean"), "trial").limit(1)
