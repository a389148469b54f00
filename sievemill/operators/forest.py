"""Regularized greedy forest: options, split scan in SQL, models as node tables.

A model is a table of nodes and is applied to any number of rows as one column
expression or by Arrow batches.  `growth` grows one on a table of any size; the
fits of this module take arrays, or groups of rows that fit a worker each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .penalty import ALGORITHMS

NODES = "tree int, node int, border double, weight double, feature int, le int, gt int, parent int"


@dataclass
class ForestConfig:
    """Training options and their defaults."""

    loss: str = "LS"
    algorithm: str = "RGF"
    reg_L2: float = 0.1
    reg_sL2: float | None = None
    reg_depth: float = 1.0
    max_leaf_forest: int = 10_000
    max_tree: int = 1_000_000
    opt_interval: int = 100
    test_interval: int = 500
    num_tree_search: int = 1
    min_pop: int = 10
    num_iteration_opt: int = 10
    opt_stepsize: float = 0.5
    normalize_target: bool = False
    f_ratio: float = 1.0
    seed: int = 1
    warnings: list[str] = field(default_factory=list, compare=False)

    @classmethod
    def parse(cls, text: str) -> ForestConfig:
        """Options `key=value` (or bare switches), separated by commas or lines; # starts a comment; a repeated key is an error, an unknown one a warning."""
        out, seen = cls(), set()
        kinds = {f.name: f.type for f in fields(cls) if f.name != "warnings"}
        for part in (p.strip() for line in text.splitlines() for p in line.split("#")[0].split(",")):
            if not part:
                continue
            key, _, value = (x.strip() for x in part.partition("="))
            if key in seen:
                raise ValueError(f"{key} is given twice")
            seen.add(key)
            name = {"NormalizeTarget": "normalize_target"}.get(key, key)
            if name not in kinds:
                out.warnings.append(f"unknown option {key}")
            elif "bool" in kinds[name]:
                setattr(out, name, value.lower() != "false")
            else:
                setattr(out, name, (int if kinds[name] == "int" else str if kinds[name] == "str" else float)(value))
        if out.algorithm not in ALGORITHMS or out.loss not in _LOSSES:
            raise ValueError(f"not built: algorithm {out.algorithm} with loss {out.loss}")
        out.test_interval = aligned_interval(out.test_interval, out.opt_interval)
        return out


def parse_runs(text: str) -> list[ForestConfig]:
    """One configuration for each line that starts with @, which adds to the common lines; without such lines a single one."""
    lines = text.splitlines()
    common = "\n".join(x for x in lines if not x.lstrip().startswith("@"))
    runs = [x.lstrip()[1:] for x in lines if x.lstrip().startswith("@")]
    return [ForestConfig.parse(f"{common}\n{x}") for x in runs] or [ForestConfig.parse(common)]


def aligned_interval(test: int, opt: int) -> int:
    """The test interval as a multiple or a divisor of the optimization interval."""
    if test <= 0 or opt <= 0:
        return test
    return max(1, round(test / opt)) * opt if test >= opt else next(d for d in range(test, 0, -1) if opt % d == 0)


def leaf_value(wsum: Column, wrsum: Column, lam: Column, parent: Column) -> Column:
    """Regularized value of a new leaf, the parent's weight included."""
    return (wrsum - lam * parent) / (wsum + lam) + parent


def split_gain(wsum: Column, wrsum: Column, lam: Column, parent: Column, parent_lam: Column | None = None) -> Column:
    """Gain of one child of a split under an L2 penalty."""
    q = (wrsum - lam * parent) / (wsum + lam)
    return q * q * (wsum + lam) + ((lam if parent_lam is None else parent_lam) - 2 * lam) * parent * parent / 2


def split_gain_l1(wsum: Column, wrsum: Column, lam: Column, sig: Column, parent: Column) -> Column:
    """Gain under an L1 and an L2 penalty: soft-thresholded leaf."""
    y = wrsum + wsum * parent
    q = F.when(y > sig, (y - sig) / (wsum + lam)).when(y < -sig, (y + sig) / (wsum + lam)).otherwise(0.0)
    return -2 * parent * y + parent * parent * (wsum + lam) + 2 * sig * F.abs(parent) + q * q * (wsum + lam)


def split_scan(rows: DataFrame, lam: float, *, min_pop: int = 10, keys: tuple[str, ...] = ("node", "feature")) -> DataFrame:
    """keys, border, gain of every split of (keys, value, w, r): rows are summed by value, then summed up in order.

    The border lies midway between two neighbouring values; both sides hold
    min_pop rows at least.
    """
    per = rows.groupBy(*keys, "value").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("r")).alias("wr"), F.count("*").alias("n"))
    order = W.partitionBy(*keys).orderBy("value")
    upto, whole = order.rowsBetween(W.unboundedPreceding, 0), W.partitionBy(*keys)
    per = per.withColumns({"wl": F.sum("w").over(upto), "rl": F.sum("wr").over(upto), "nl": F.sum("n").over(upto), "wt": F.sum("w").over(whole), "rt": F.sum("wr").over(whole), "nt": F.sum("n").over(whole), "next": F.lead("value").over(order)})
    zero, nlam = F.lit(0.0), F.lit(float(lam))
    gain = split_gain(F.col("wl"), F.col("rl"), nlam, zero) + split_gain(F.col("wt") - F.col("wl"), F.col("rt") - F.col("rl"), nlam, zero)
    kept = F.col("next").isNotNull() & (F.col("nl") >= min_pop) & (F.col("nt") - F.col("nl") >= min_pop)
    return per.where(kept).select(*keys, ((F.col("value") + F.col("next")) / 2).alias("border"), gain.alias("gain"))


def best_splits(scan: DataFrame, keys: tuple[str, ...] = ("node",)) -> DataFrame:
    """keys, feature, border, gain: the best split, the first of equals."""
    best = F.max_by(F.struct("feature", "border", "gain"), F.struct("gain", -F.col("feature"), -F.col("border")))
    return scan.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def apply_split(rows: DataFrame, split: DataFrame) -> DataFrame:
    """Rows (node, features array) moved to the child nodes le / gt of splits (node, feature, border, le, gt); others stay."""
    out = rows.join(split, "node", "left")
    moved = F.when(F.col("features")[F.col("feature")] <= F.col("border"), F.col("le")).otherwise(F.col("gt"))
    return out.withColumn("node", F.when(F.col("feature").isNull(), F.col("node")).otherwise(moved)).select(rows.columns)


_LOSSES = {
    "LS": lambda p, y: (y - p, np.ones_like(p)),
    "Expo": lambda p, y: (y * np.exp(np.clip(-p * y, -500, 500)), y * y * np.exp(np.clip(-p * y, -500, 500))),
    "Log": lambda p, y: (lambda e: (y * e / (1 + e), y * y * e / (1 + e) ** 2))(np.exp(np.clip(-p * y, -500, 500))),
}


class _Growth:
    """State of one forest while it grows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, config: ForestConfig, nodes: pd.DataFrame | None):
        self.x, self.w, self.c = x, w, config
        self.constant = float(np.average(y, weights=w)) if config.normalize_target else 0.0
        self.y = y - self.constant
        self.rng = np.random.default_rng(config.seed)
        self.p = np.zeros(len(y))
        self.trees: list[list[dict]] = []
        self.order = [np.argsort(x[:, j], kind="stable") for j in range(x.shape[1])]
        if nodes is not None:
            self._reload(nodes)

    def _node(self, rows: np.ndarray, parent: int, depth: int, weight: float = 0.0) -> dict:
        return {"rows": rows, "parent": parent, "depth": depth, "weight": weight, "feature": -1, "border": 0.0, "le": -1, "gt": -1, "best": None}

    def _reload(self, nodes: pd.DataFrame) -> None:
        for _, own in nodes.sort_values(["tree", "node"]).groupby("tree"):
            tree: list[dict] = []
            for r in own.itertuples():
                if r.parent < 0:
                    rows, depth = np.arange(len(self.y)), 0
                else:
                    up = tree[r.parent]
                    low = self.x[up["rows"], up["feature"]] <= up["border"]
                    rows, depth = up["rows"][low if up["le"] == r.node else ~low], up["depth"] + 1
                tree.append(self._node(rows, r.parent, depth, r.weight) | {"feature": r.feature, "border": r.border, "le": r.le, "gt": r.gt})
            self.trees.append(tree)
            for node in tree:
                if node["le"] < 0:
                    self.p[node["rows"]] += node["weight"]

    def _lam(self, depth: int, n: int, search: bool = False) -> float:
        """The penalty of a node; a search may have its own, the optimization of weights has not."""
        base = self.c.reg_sL2 if search and self.c.reg_sL2 is not None else self.c.reg_L2
        return base * self.c.reg_depth**depth * n

    def _search(self, node: dict) -> tuple | None:
        rows, n = node["rows"], len(self.y)
        if len(rows) < 2 * self.c.min_pop:
            return None
        d1, d2 = _LOSSES[self.c.loss](self.p[rows], self.y[rows])
        r = np.zeros(n)
        w = np.zeros(n)
        r[rows], w[rows] = self.w[rows] * d1, self.w[rows] * d2
        inside = np.zeros(n, bool)
        inside[rows] = True
        parent, lam = node["weight"], self._lam(node["depth"] + 1, n, True)
        best = None
        for j in range(self.x.shape[1]):
            if self.c.f_ratio < 1 and self.rng.random() >= self.c.f_ratio:
                continue
            own = self.order[j][inside[self.order[j]]]
            v = self.x[own, j]
            wl, rl = np.cumsum(w[own]), np.cumsum(r[own])
            cut = np.flatnonzero(v[1:] > v[:-1])
            cut = cut[(cut + 1 >= self.c.min_pop) & (len(own) - cut - 1 >= self.c.min_pop)]
            if not len(cut):
                continue
            gain = np.zeros(len(cut))
            for ws, rs in ((wl[cut], rl[cut]), (wl[-1] - wl[cut], rl[-1] - rl[cut])):
                q = (rs - lam * parent) / (ws + lam)
                gain += q * q * (ws + lam) - lam * parent * parent / 2
            k = int(np.argmax(gain))
            if best is None or gain[k] > best[0]:
                i = cut[k]
                pair = [(rs - lam * parent) / (ws + lam) + parent for ws, rs in ((wl[i], rl[i]), (wl[-1] - wl[i], rl[-1] - rl[i]))]
                best = (float(gain[k]), j, float((v[i] + v[i + 1]) / 2), *pair)
        return best

    def leaves(self) -> int:
        return sum(node["le"] < 0 and node["parent"] >= 0 for tree in self.trees for node in tree)

    def grow(self) -> bool:
        """Make the best split among the latest trees' leaves and a new root."""
        root = [self._node(np.arange(len(self.y)), -1, 0)]
        options = [*self.trees[-self.c.num_tree_search :], *([root] if len(self.trees) < self.c.max_tree else [])]
        best = None
        for tree in options:
            for k, node in enumerate(tree):
                if node["le"] >= 0:
                    continue
                if node["best"] is None:
                    node["best"] = self._search(node) or ()
                if node["best"] and (best is None or node["best"][0] > best[0][0]):
                    best = (node["best"], tree, k)
        if best is None or best[0][0] <= 1e-12:
            return False
        (_, feature, border, low, high), tree, k = best
        if tree is root:
            self.trees.append(tree)
        node = tree[k]
        side = self.x[node["rows"], feature] <= border
        node |= {"feature": feature, "border": border, "le": len(tree), "gt": len(tree) + 1}
        for rows, weight in ((node["rows"][side], low), (node["rows"][~side], high)):
            tree.append(self._node(rows, k, node["depth"] + 1, weight))
            self.p[rows] += weight - node["weight"]
        node["weight"] = 0.0
        for tree in self.trees:
            for other in tree:
                other["best"] = None
        return True

    def optimize(self) -> None:
        """Newton steps on every leaf weight, one after the other."""
        n = len(self.y)
        for _ in range(self.c.num_iteration_opt):
            for tree in self.trees:
                for node in tree:
                    if node["le"] >= 0 or node["parent"] < 0:
                        continue
                    rows, lam = node["rows"], self._lam(node["depth"], n)
                    d1, d2 = _LOSSES[self.c.loss](self.p[rows], self.y[rows])
                    step = self.c.opt_stepsize * ((self.w[rows] * d1).sum() - lam * node["weight"]) / ((self.w[rows] * d2).sum() + lam)
                    node["weight"] += step
                    self.p[rows] += step

    def table(self) -> pd.DataFrame:
        rows = [(t, k, v["border"], v["weight"], v["feature"], v["le"], v["gt"], v["parent"]) for t, tree in enumerate(self.trees) for k, v in enumerate(tree)]
        rows.append((-1, 0, 0.0, self.constant, -1, -1, -1, -1))
        return pd.DataFrame(rows, columns=["tree", "node", "border", "weight", "feature", "le", "gt", "parent"])


def train_arrays(x: np.ndarray, y: np.ndarray, config: ForestConfig, weights: np.ndarray | None = None, start: pd.DataFrame | None = None) -> pd.DataFrame:
    """The node table of a forest; tree -1 holds the constant.  `start` continues from a saved table."""
    if config.algorithm != "RGF":
        raise ValueError("only growth.grow_forest has the penalties on trees")
    if weights is not None and len(weights) != len(y):
        raise ValueError("there must be one weight for each row")
    if start is not None:
        start = start[start["tree"] >= 0]
    growth = _Growth(x, y, np.ones(len(y)) if weights is None else weights, config, start)
    while growth.leaves() < config.max_leaf_forest:
        before = growth.leaves()
        if not growth.grow():
            break
        if growth.leaves() // config.opt_interval > before // config.opt_interval:
            growth.optimize()
    growth.optimize()
    return growth.table()


def train(rows: DataFrame, config: ForestConfig, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys and nodes of one forest per group of (keys, features array, y[, w]); a group must fit a worker."""
    weighted = "w" in rows.columns

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf["features"].tolist(), float)
        out = train_arrays(x, pdf["y"].to_numpy(float), config, pdf["w"].to_numpy(float) if weighted else None)
        for name, value in zip(keys, key, strict=False):
            out.insert(0, name, value)
        return out

    grouped = rows.groupBy(*keys)
    schema = ", ".join([*(f"{k} {rows.schema[k].dataType.simpleString()}" for k in reversed(keys)), NODES])
    return grouped.applyInPandas(fit, schema)


def predict_expression(nodes: list, features: str = "features") -> Column:
    """The forest as one column: each tree a nest of comparisons, `x <= border` to the left."""
    trees: dict[int, dict[int, object]] = {}
    for n in nodes:
        trees.setdefault(n["tree"], {})[n["node"]] = n

    def walk(tree: dict, k: int) -> Column:
        n = tree[k]
        if n["le"] < 0:
            return F.lit(float(n["weight"]))
        return F.when(F.col(features)[n["feature"]] <= n["border"], walk(tree, n["le"])).otherwise(walk(tree, n["gt"])) + float(n["weight"])

    return sum((walk(t, 0) for _, t in sorted(trees.items())), F.lit(0.0))


def predict(rows: DataFrame, nodes: pd.DataFrame, *, features: str = "features", leaves: bool = False) -> DataFrame:
    """Add prediction, or with `leaves` the array of reached (tree, node) numbers, for forests of any size, by Arrow batches."""
    packed = _Packed(nodes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            total, reached = packed(np.array(pdf[features].tolist(), float).reshape(len(pdf), -1))
            yield pdf.assign(rules=list(np.array(reached).T)) if leaves else pdf.assign(prediction=total)

    extra = "rules array<bigint>" if leaves else "prediction double"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{schema}, {extra}")


def predict_models(rows: DataFrame, models: dict[str, pd.DataFrame], *, features: str = "features") -> DataFrame:
    """`rows` with prediction, once for each of the models by its name `model`: rows are read once for all."""
    packed = {name: _Packed(nodes) for name, nodes in sorted(models.items())}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array(pdf[features].tolist(), float).reshape(len(pdf), -1)
            for name, model in packed.items():
                yield pdf.assign(model=name, prediction=model(x)[0])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{schema}, model string, prediction double")


class _Packed:
    """A node table as arrays."""

    def __init__(self, nodes: pd.DataFrame):
        trees = [t.sort_values("node") for k, t in nodes.groupby("tree") if k >= 0]
        self.trees = [(t["feature"].to_numpy(), t["border"].to_numpy(), t["le"].to_numpy(), t["gt"].to_numpy(), t["weight"].to_numpy()) for t in trees]
        self.first = np.concatenate([[0], np.cumsum([len(t) for t in trees])]).astype(int)
        self.constant = float(nodes.loc[nodes["tree"] < 0, "weight"].sum())

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(predictions, the number of the node that each tree's rows reach) of dense rows."""
        total, reached = np.full(len(x), self.constant), []
        for i, (feature, border, le, gt, weight) in enumerate(self.trees):
            at = np.zeros(len(x), int)
            total += weight[0]
            while (inner := np.flatnonzero(le[at] >= 0)).size:
                k = at[inner]
                at[inner] = np.where(x[inner, feature[k]] <= border[k], le[k], gt[k])
                total[inner] += weight[at[inner]]
            reached.append(at + self.first[i])
        return total, reached


def rules(nodes: DataFrame) -> DataFrame:
    """tree, node, rule: the comparisons on the way to each leaf, in a fixed order."""
    flat = nodes.where("tree >= 0")
    step = flat.where("parent < 0").select("tree", "node", F.array().cast("array<string>").alias("path"), "feature", "border", "le", "gt")
    done = step.where("le < 0").select("tree", "node", "path")
    while not step.where("le >= 0").isEmpty():
        side = lambda child, sign: step.where("le >= 0").select("tree", F.col(child).alias("node"), F.concat("path", F.array(F.format_string(f"x%d{sign}%.6g", "feature", "border"))).alias("path"))  # noqa: B023, E731
        step = side("le", "<=").unionByName(side("gt", ">")).join(flat.select("tree", "node", "feature", "border", "le", "gt"), ["tree", "node"])
        done = done.unionByName(step.where("le < 0").select("tree", "node", "path"))
    return done.select("tree", "node", F.array_join(F.array_sort(F.array_distinct("path")), " & ").alias("rule"))


def rule_counts(nodes: DataFrame) -> DataFrame:
    """rule, n: how many leaves of the forest are the same rule."""
    return rules(nodes).groupBy("rule").agg(F.count("*").alias("n"))


def registered(nodes: pd.DataFrame, known: pd.DataFrame | None = None) -> pd.DataFrame:
    """id, tree, node, active: the registry of a forest's rules, every node of a tree with a weight.

    `known` is the registry of the forest as it was before it grew on: its ids
    stay, a rule whose node has been split again or has lost its weight is no
    longer active, and new rules get the next ids by (tree, node).
    """
    now = nodes[(nodes["tree"] >= 0) & (nodes["weight"] != 0)].sort_values(["tree", "node"])
    live = list(zip(now["tree"].astype(int), now["node"].astype(int), strict=True))
    old = [] if known is None else list(known.sort_values("id")[["id", "tree", "node"]].astype(int).itertuples(index=False, name=None))
    held, next_id = {(t, k) for _, t, k in old}, max((i for i, _, _ in old), default=-1) + 1
    new = [(next_id + i, t, k) for i, (t, k) in enumerate(x for x in live if x not in held)]
    active = set(live)
    return pd.DataFrame([(i, t, k, (t, k) in active) for i, t, k in [*old, *new]], columns=["id", "tree", "node", "active"])


def rule_features(rows: DataFrame, nodes: pd.DataFrame, registry: pd.DataFrame, *, features: str = "features") -> DataFrame:
    """`rows` with rules: a sparse vector as a map from rule id to 1.0, of the active rules that hold for the row, by id.

    The map is what `growth.grow_forest` takes as features.
    """
    packed = _Packed(nodes)
    own = nodes[nodes["tree"] >= 0].sort_values(["tree", "node"]).reset_index(drop=True)
    first = dict(zip(sorted(own["tree"].unique()), packed.first, strict=False))
    up = [first[r.tree] + r.parent if r.parent >= 0 else -1 for r in own.itertuples()]
    number = {(int(r.tree), int(r.node)): i for i, r in enumerate(own.itertuples())}
    rule = np.full(len(own), -1)
    for r in registry[registry["active"]].itertuples():
        rule[number[int(r.tree), int(r.node)]] = r.id
    ways: list[list[int]] = []  # the rules on the way to each node
    for i in range(len(own)):
        ways.append([*(ways[up[i]] if up[i] >= 0 else []), *([int(rule[i])] if rule[i] >= 0 else [])])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            reached = np.array(packed(np.array(pdf[features].tolist(), float).reshape(len(pdf), -1))[1]).T.reshape(len(pdf), -1)
            yield pdf.assign(rules=[sorted(x for k in r for x in ways[k]) for r in reached.tolist()])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    out = rows.mapInPandas(run, f"{schema}, rules array<int>")
    return out.withColumn("rules", F.map_from_arrays("rules", F.transform("rules", lambda _: F.lit(1.0))))
