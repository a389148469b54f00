"""Forests grown over a table against the same growth on arrays."""

import numpy as np
import pyarrow as pa
import pytest

from sievemill.operators import forest, growth
from sievemill.operators.penalty import ALGORITHMS, Shape

R = np.random.default_rng(3)
X = np.round(R.normal(size=(240, 3)), 2)
X[:, 2] = R.integers(0, 4, 240)
Y = np.where(X[:, 0] > 0.2, 2.0, -1.0) + 0.5 * (X[:, 1] > 0) * X[:, 2] + 0.05 * R.normal(size=240)
W = 0.5 + R.random(240)
PART = growth.Part(pa.RecordBatch.from_arrays([pa.array(X.tolist()), pa.array(Y), pa.array(W)], names=["features", "y", "w"]))


def rows(spark, sparse=False, y=Y):
    if sparse:
        data = [({j: float(v) for j, v in enumerate(a) if v or j == 1}, float(b), float(w)) for a, b, w in zip(X, y, W, strict=True)]
        return spark.createDataFrame(data, "features map<int,double>, y double, w double").repartition(3)
    return spark.createDataFrame([(a.tolist(), float(b), float(w)) for a, b, w in zip(X, y, W, strict=True)], "features array<double>, y double, w double").repartition(3)


def same(got, want):
    got = got.sort_values(["tree", "node"]).reset_index(drop=True)
    want = want.sort_values(["tree", "node"]).reset_index(drop=True)
    for c in ("tree", "node", "feature", "le", "gt", "parent"):
        assert got[c].tolist() == want[c].tolist(), c
    assert np.allclose(got["border"], want["border"], atol=1e-12) and np.allclose(got["weight"], want["weight"], atol=1e-8)


@pytest.mark.parametrize("sparse", [False, True])
@pytest.mark.parametrize("few", [growth.FEW, 3])
def test_nodes_equal_those_of_arrays(spark, monkeypatch, sparse, few):
    monkeypatch.setattr(growth, "FEW", few)
    config = forest.ForestConfig(max_leaf_forest=9, opt_interval=4, normalize_target=True, min_pop=5, reg_L2=0.002, reg_sL2=0.001, reg_depth=1.2, num_tree_search=2)
    same(growth.grow_forest(rows(spark, sparse), config).toPandas(), forest.train_arrays(X, Y, config, W))


@pytest.mark.parametrize("loss", ["Log", "Expo"])
def test_other_losses_step_tree_by_tree(spark, loss):
    y = np.where(Y > 0, 1.0, -1.0)
    config = forest.ForestConfig(loss=loss, max_leaf_forest=5, opt_interval=3, min_pop=5, reg_L2=0.01, num_iteration_opt=2)
    same(growth.grow_forest(rows(spark, y=y), config).toPandas(), forest.train_arrays(X, y, config, W))


def test_squared_loss_by_shared_weights_equals_tree_by_tree(spark, monkeypatch):
    config = forest.ForestConfig(max_leaf_forest=6, opt_interval=3, min_pop=5, reg_L2=0.01, num_iteration_opt=3)
    one = growth.grow_forest(rows(spark), config).toPandas()
    monkeypatch.setattr(growth, "SHARED", 0)
    same(growth.grow_forest(rows(spark), config).toPandas(), one)


def test_warm_start_goes_on(spark):
    short = forest.ForestConfig(max_leaf_forest=4, opt_interval=4, min_pop=5, reg_L2=0.01)
    long = forest.ForestConfig(max_leaf_forest=7, opt_interval=4, min_pop=5, reg_L2=0.01)
    first = growth.grow_forest(rows(spark), short).toPandas()
    same(growth.grow_forest(rows(spark), long, first).toPandas(), forest.train_arrays(X, Y, long, W, start=first))


def test_odd_tables(spark):
    config = forest.ForestConfig(max_leaf_forest=4, opt_interval=4, min_pop=1, reg_L2=0.01)
    empty = growth.grow_forest(rows(spark).limit(0), config).collect()
    assert [tuple(r)[:4] for r in empty] == [(-1, 0, 0.0, 0.0)]
    flat = spark.createDataFrame([([1.0], 2.0), ([1.0], 3.0), (None, 1.0), ([2.0], None)], "features array<double>, y double")
    assert len(growth.grow_forest(flat, config).collect()) == 1  # one value: nothing to split
    half = forest.ForestConfig(max_leaf_forest=4, opt_interval=4, min_pop=5, reg_L2=0.01, f_ratio=0.5)
    again = [growth.grow_forest(rows(spark), half).toPandas() for _ in range(2)]
    same(*again)


def dense(shape, kind):
    """The penalty's matrix by a dense solve: shares on the way to each leaf add up to its weight."""
    n, at = len(shape.le), shape.leaves
    up = {int(c): v for v in range(n) if shape.le[v] >= 0 for c in (shape.le[v], shape.gt[v])}
    ways = np.zeros((len(at), n))
    for i, v in enumerate(at.tolist()):
        while v is not None:
            ways[i, v] = 1
            v = up.get(v)
    if kind == "RGF":
        return np.diag(shape.factor[at])
    if kind == "RGF_Opt":
        return np.linalg.inv(ways @ np.diag(1 / shape.factor) @ ways.T)
    inner = np.flatnonzero(shape.le >= 0)
    even = np.zeros((len(inner), n))
    for i, v in enumerate(inner):
        even[i, [shape.le[v], shape.gt[v]]] = 1
    both = np.vstack([ways, even])  # as many conditions as nodes
    shares = np.linalg.solve(both, np.vstack([np.eye(len(at)), np.zeros((len(inner), len(at)))]))
    return shares.T @ np.diag(shape.factor) @ shares


@pytest.mark.parametrize("kind", ALGORITHMS)
def test_penalties_equal_a_dense_solve(kind):
    r = np.random.default_rng(5)
    for _ in range(30):
        shape, rate = Shape(np.array([-1]), np.array([-1]), np.array([1.0])), float(r.choice([1.0, 1.5, 3.0]))
        for _ in range(int(r.integers(0, 9))):
            v = int(r.choice(shape.leaves))
            weight = r.normal(size=len(shape.le))
            before, after = shape.value(weight, kind), shape.split(v, rate)
            same, cross, slope, change = shape.split_terms(v, weight, kind, rate)
            x, y = r.normal(size=2)
            moved = np.append(np.where(shape.le < 0, weight, 0.0), [weight[v] + x, weight[v] + y])
            want = before + change + slope * (x + y) + same * (x * x + y * y) / 2 + cross * x * y
            assert np.isclose(after.value(moved, kind), want)
            shape = after
        if len(shape.le) > 1:
            assert np.allclose(shape.matrix(kind), dense(shape, kind))
            weight = r.normal(size=len(shape.le))
            own = weight[shape.leaves]
            assert np.isclose(shape.value(weight, kind), own @ dense(shape, kind) @ own / 2)


@pytest.mark.parametrize("kind", ["RGF_Opt", "RGF_Sib"])
def test_objective_falls_with_each_step(spark, kind):
    config = forest.ForestConfig.parse(f"algorithm={kind},max_leaf_forest=6,opt_interval=100,min_pop=5,reg_L2=0.01,reg_depth=1.3,NormalizeTarget")
    grower = growth.Grower(rows(spark), config)
    last = [grower.objective()]
    for _ in range(5):
        assert grower.grow()
        last.append(grower.objective())
    grower.optimize()
    last.append(grower.objective())
    assert all(b < a for a, b in zip(last, last[1:], strict=False))
    # at the end of many steps the weights solve the quadratic problem
    grower.c.num_iteration_opt = 20_000
    grower.optimize()
    leaves = grower.model.leaves()
    reached = [growth.Part.leaf(PART, t) for t in grower.model.packed()]
    a = np.array([reached[t] == k for t, k in leaves], float).T
    m = np.zeros((len(leaves), len(leaves)))
    for t, tree in enumerate(grower.model.trees):
        own = [i for i, (u, _) in enumerate(leaves) if u == t]
        m[np.ix_(own, own)] = dense(grower.shape(tree), kind)
    want = np.linalg.solve(a.T @ (a * W[:, None]) + 0.01 * len(Y) * m, a.T @ (W * (Y - np.average(Y, weights=W))))
    assert np.allclose([grower.model.trees[t][k].weight for t, k in leaves], want, atol=1e-6)
    with pytest.raises(ValueError):
        forest.train_arrays(X, Y, config)
    with pytest.raises(ValueError):
        forest.ForestConfig.parse("algorithm=other")


def test_tests_while_it_grows(spark):
    config = forest.ForestConfig(max_leaf_forest=8, opt_interval=2, test_interval=4, min_pop=5, reg_L2=0.002, normalize_target=True)
    nodes, tested = growth.train_test(rows(spark), rows(spark), config)
    nodes, tested = nodes.toPandas(), tested.toPandas()
    assert tested.n_leaves[0] in (4, 5) and tested.n_leaves.iloc[-1] in (8, 9) and set(tested.n) == {240}
    p = forest.predict(rows(spark), nodes).toPandas()
    assert np.isclose(tested.sqerr.iloc[-1], ((p.y - p.prediction) ** 2).mean()) and np.isclose(tested.rmse.iloc[-1] ** 2, tested.sqerr.iloc[-1]) and np.isclose(tested.loss.iloc[-1], tested.sqerr.iloc[-1] / 2)
    assert np.isclose(tested.accuracy.iloc[-1], ((p.y > 0) == (p.prediction > 0)).mean()) and tested.sqerr.iloc[-1] < tested.sqerr[0]
    both = forest.predict_models(rows(spark), {"whole": nodes, "constant": nodes[nodes.tree < 0]}).toPandas()
    assert len(both) == 480 and np.allclose(np.sort(both[both.model == "whole"].prediction), np.sort(p.prediction)) and both[both.model == "constant"].prediction.nunique() == 1


def test_rule_ids_survive_growth(spark):
    short = forest.ForestConfig(max_leaf_forest=4, opt_interval=4, min_pop=5, reg_L2=0.01)
    long = forest.ForestConfig(max_leaf_forest=9, opt_interval=4, min_pop=5, reg_L2=0.01)
    first = forest.train_arrays(X, Y, short)
    later = forest.train_arrays(X, Y, long, start=first)
    one = forest.registered(first)
    two = forest.registered(later, one)
    assert two.iloc[: len(one)][["id", "tree", "node"]].equals(one[["id", "tree", "node"]]) and two["id"].tolist() == list(range(len(two)))
    leaves = {(t, k) for t, k, le, w in zip(later["tree"], later["node"], later["le"], later["weight"], strict=True) if t >= 0 and le < 0 and w}
    assert {(r.tree, r.node) for r in two[two.active].itertuples()} == leaves and not two.active.all()
    out = forest.rule_features(rows(spark), later, two).toPandas()
    weight = {r.id: float(later[(later.tree == r.tree) & (later.node == r.node)].weight.iloc[0]) for r in two.itertuples()}
    p = forest.predict(rows(spark), later).toPandas()
    assert np.allclose([sum(weight[i] * x for i, x in dict(r).items()) for r in out.rules], p.prediction)
