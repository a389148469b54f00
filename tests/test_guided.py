"""Guided search: better than random draws, and resumable."""

import math

import numpy as np

from sievemill.operators import guided
from sievemill.operators.learners import Space

SPACE = {"x": Space("uniform", -5, 5), "rate": Space("loguniform", -6, 2), "depth": Space("quniform", 1, 12, 1), "kind": Space("choice", options=("a", "b", "c"))}


def surface(p):
    return -((p["x"] - 1.5) ** 2) - (math.log(p["rate"]) + 2) ** 2 - 0.2 * (p["depth"] - 7) ** 2 - 3 * (p["kind"] != "b")


def run(seed, guide):
    past = []
    for t in range(0, 48, 4):
        batch = [guided.propose(SPACE, past if guide else [], t + i, seed) for i in range(4)]
        past += [(p, surface(p)) for p in batch]
    return max(s for _, s in past)


def test_beats_random_draws_over_twenty_seeds():
    pairs = [(run(seed, True), run(seed, False)) for seed in range(20)]
    assert sum(a > b for a, b in pairs) >= 14 and np.mean([a for a, _ in pairs]) > np.mean([b for _, b in pairs]) + 0.3


def test_proposals_stay_in_their_space():
    past = [(p, surface(p)) for p in (guided.propose(SPACE, [], t, 1) for t in range(12))]
    past[3] = (past[3][0], math.nan)
    for t in range(12, 80):
        p = guided.propose(SPACE, past, t, 1)
        assert -5 <= p["x"] <= 5 and math.exp(-6) <= p["rate"] <= math.exp(2) and p["depth"] in range(1, 13) and p["kind"] in "abc"


def test_a_stopped_search_goes_on_to_the_same_log(spark, tmp_path):
    evaluate = lambda batch: [(surface(p), 0.0) for p in batch]
    whole = guided.search(spark, SPACE, evaluate, f"{tmp_path}/whole", 14)

    calls = []

    def breaks(batch):
        calls.append(len(batch))
        if len(calls) == 3:
            raise RuntimeError("stopped")
        return evaluate(batch)

    try:
        guided.search(spark, SPACE, breaks, f"{tmp_path}/parts", 14)
    except RuntimeError:
        pass
    assert guided.read_log(spark, f"{tmp_path}/parts").count() == 8
    parts = guided.search(spark, SPACE, evaluate, f"{tmp_path}/parts", 14)
    key = lambda df: [(r.trial, r.kappa_mean, r.params) for r in df.orderBy("trial").collect()]
    assert key(parts) == key(whole) and [r[0] for r in key(whole)] == list(range(14))
    assert guided.best(whole).first().kappa_mean == max(r[1] for r in key(whole))
