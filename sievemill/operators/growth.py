"""Growth of a regularized greedy forest over a table of any size.

The driver holds the node table; rows stay where they are.  A row's leaves and
prediction follow from its features and the node table, so a round moves no
rows: each task sums up its rows' derivatives for every open node, feature and
value, the sums are added up and summed in order of the values, and only the
best split of each open node comes to the driver.  A feature of many values is
cut into ranges once, which are summed in order by themselves and start from
the total of the ranges before them.  Sparse rows (maps from feature to value)
send no zeros: the sum at zero is what the others leave of the node's.

The penalty of a tree (`penalty`) is the driver's: for an open node it is a
quadratic form of the two new leaves' weights, which goes to the search as four
numbers.  Leaf weights are optimized by Newton steps leaf by leaf.  With squared loss the
steps need the weights of rows that share two leaves, summed up once; with other
losses the leaves of one tree, which share no row, take a step at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .forest import _LOSSES, NODES, ForestConfig, predict
from .objectives import forest_loss
from .penalty import Shape

#: Values of a feature up to which it is one range; ranges of others; leaves whose shared weights the driver holds (a square).
FEW, RANGES, SHARED = 20_000, 64, 1000
_SUMS = "o int, f int, range int, v double, w double, r double, n bigint"


@dataclass
class Node:
    parent: int
    depth: int
    weight: float
    feature: int = -1
    border: float = 0.0
    le: int = -1
    gt: int = -1


@dataclass
class Trees:
    """The node table: a list of nodes for each tree."""

    constant: float = 0.0
    trees: list[list[Node]] = field(default_factory=list)

    def leaves(self) -> list[tuple[int, int]]:
        return [(t, k) for t, tree in enumerate(self.trees) for k, v in enumerate(tree) if v.le < 0 and v.parent >= 0]

    def packed(self) -> list[tuple[np.ndarray, ...]]:
        return [tuple(np.array([getattr(v, c) for v in tree]) for c in ("feature", "border", "le", "gt", "weight")) for tree in self.trees]

    def rows(self) -> list[tuple]:
        out = [(t, k, float(v.border), float(v.weight), v.feature, v.le, v.gt, v.parent) for t, tree in enumerate(self.trees) for k, v in enumerate(tree)]
        return [*out, (-1, 0, 0.0, float(self.constant), -1, -1, -1, -1)]

    @classmethod
    def of(cls, nodes: pd.DataFrame) -> Trees:
        """A saved table, whose constant isn't taken over."""
        out = cls()
        for _, own in nodes[nodes["tree"] >= 0].sort_values(["tree", "node"]).groupby("tree"):
            tree: list[Node] = []
            for r in own.itertuples():
                depth = tree[r.parent].depth + 1 if r.parent >= 0 else 0
                tree.append(Node(int(r.parent), depth, float(r.weight), int(r.feature), float(r.border), int(r.le), int(r.gt)))
            out.trees.append(tree)
        return out


class Part:
    """Rows of one Arrow batch; absent entries of sparse rows are zeros."""

    def __init__(self, batch: pa.RecordBatch):
        column, self.n = batch.column(0), batch.num_rows
        self.y, self.w = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (1, 2))
        at = column.offsets.to_numpy().astype(np.int64)
        row = np.repeat(np.arange(self.n), np.diff(at))
        if pa.types.is_map(column.type):
            f = column.keys.to_numpy()[at[0] : at[-1]].astype(np.int64)
            v = column.items.to_numpy(zero_copy_only=False)[at[0] : at[-1]].astype(float)
            some = v != 0
            row, f, v = row[some], f[some], v[some]
        else:
            f = np.arange(at[-1] - at[0]) - np.repeat(at[:-1] - at[0], np.diff(at))
            v = column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].astype(float)
        self.width = int(f.max(initial=-1)) + 1
        order = np.argsort(row * self.width + f, kind="stable")
        self.row, self.f, self.v = row[order], f[order], v[order]
        self.code = self.row * self.width + self.f

    def value(self, rows: np.ndarray, f: np.ndarray) -> np.ndarray:
        if not len(self.code):
            return np.zeros(len(rows))
        code = rows * self.width + f
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where((self.code[at] == code) & (f < self.width), self.v[at], 0.0)

    def leaf(self, tree: tuple[np.ndarray, ...]) -> np.ndarray:
        """The node of `tree` that each row reaches."""
        feature, border, le, gt, _ = tree
        at = np.zeros(self.n, np.int64)
        while (inner := np.flatnonzero(le[at] >= 0)).size:
            k = at[inner]
            at[inner] = np.where(self.value(inner, feature[k]) <= border[k], le[k], gt[k])
        return at


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
    return (Part(b) for b in batches if b.num_rows)


def _predicted(part: Part, trees: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, list[np.ndarray]]:
    reached = [part.leaf(t) for t in trees]
    return sum((t[4][k] for t, k in zip(trees, reached, strict=True)), np.zeros(part.n)), reached


def _batch(schema: str, **columns) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[k]) for c, k in (x.split() for x in schema.split(", "))], names=[x.split()[0] for x in schema.split(", ")])


class Grower:
    """A forest that grows on `rows` (features, y, w); features is an array of doubles, or a map from int to double of what isn't zero."""

    def __init__(self, rows: DataFrame, config: ForestConfig, start: pd.DataFrame | None = None):
        self.c, self.spark = config, rows.sparkSession
        self.sparse = isinstance(rows.schema["features"].dataType, T.MapType)
        kind = "map<int,double>" if self.sparse else "array<double>"
        w = F.col("w").cast("double") if "w" in rows.columns else F.lit(1.0)
        rows = rows.select(F.col("features").cast(kind).alias("features"), F.col("y").cast("double").alias("y"), w.alias("w"))
        rows = rows.where("features is not null and y is not null and w is not null and not isnan(y)")
        self.rows = rows.persist()
        size = self.rows.agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy")).first()
        self.n = size.n
        self.model = Trees.of(start) if start is not None else Trees()
        if config.normalize_target and size.w:
            self.model.constant = size.wy / size.w
        self.borders = self._borders() if self.n else {}
        self.round = 0

    def _borders(self) -> dict[int, list[float]]:
        """Ends of the ranges of each feature that has more than FEW values: a few numbers a feature."""
        if self.sparse:
            entries = self.rows.select(F.explode("features").alias("f", "v"))
        else:
            entries = self.rows.select(F.posexplode("features").alias("f", "v"))
        cuts = [i / RANGES for i in range(1, RANGES)]
        found = entries.groupBy("f").agg(F.approx_count_distinct("v").alias("n"), F.percentile_approx("v", cuts, 1000).alias("cuts")).where(F.col("n") > FEW)
        return {r.f: sorted(set(r.cuts)) for r in found.collect()}

    def lam(self, depth: int, search: bool) -> float:
        base = self.c.reg_sL2 if search and self.c.reg_sL2 is not None else self.c.reg_L2
        return base * self.c.reg_depth**depth * self.n

    def shape(self, tree: list[Node]) -> Shape:
        return Shape(np.array([v.le for v in tree]), np.array([v.gt for v in tree]), self.c.reg_depth ** np.array([v.depth for v in tree], float))

    def _terms(self, t: int, k: int, v: Node) -> tuple[float, float, float, float]:
        """The penalty after a split of an open node, as `Shape.split_terms`, times its factor."""
        if self.c.algorithm == "RGF":
            lam = self.lam(v.depth + 1, True)
            return lam, 0.0, lam * v.weight, lam * v.weight * v.weight / 2
        tree = self.model.trees[t] if t >= 0 else [v]
        found = self.shape(tree).split_terms(k, np.array([x.weight for x in tree]), self.c.algorithm, self.c.reg_depth)
        return tuple(self.lam(0, True) * x for x in found)

    def objective(self) -> float:
        """Mean loss and penalty of the forest as it stands."""
        trees, loss, constant = self.model.packed(), self.c.loss, self.model.constant

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _parts(batches):
                p = _predicted(part, trees)[0]
                y = part.y - constant
                each = {"LS": lambda: (p - y) ** 2 / 2, "Expo": lambda: np.exp(-p * y), "Log": lambda: np.logaddexp(0, -p * y)}[loss]()
                yield _batch("loss double", loss=[float(part.w @ each)])

        total = self.rows.mapInArrow(run, "loss double").agg(F.sum("loss")).first()[0] or 0.0
        kept = sum(self.shape(t).value(np.array([v.weight for v in t]), self.c.algorithm) for t in self.model.trees if len(t) > 1)
        return total / max(self.n, 1) + self.c.reg_L2 * kept

    def _options(self) -> list[tuple[int, int, Node]]:
        """(tree, node, the node) of all open leaves of the latest trees, and of a new root (tree -1)."""
        first = max(0, len(self.model.trees) - self.c.num_tree_search)
        out = [(t, k, v) for t in range(first, len(self.model.trees)) for k, v in enumerate(self.model.trees[t]) if v.le < 0]
        return [*out, (-1, 0, Node(-1, 0, 0.0))] if len(self.model.trees) < self.c.max_tree else out

    def _sums(self, options: list[tuple[int, int, Node]]) -> DataFrame:
        """Sums of weights, derivatives and rows for each open node, feature and value; feature -1 has the node's."""
        trees, loss, constant, borders, sparse = self.model.packed(), self.c.loss, self.model.constant, self.borders, self.sparse
        searched = sorted({t for t, _, _ in options})
        number = {t: np.full(max((k for u, k, _ in options if u == t), default=0) + 1, -1) for t in searched}
        for o, (t, k, _) in enumerate(options):
            number[t][k] = o
        drawn = None
        if self.c.f_ratio < 1:
            seed, turn, ratio = self.c.seed, self.round, self.c.f_ratio
            drawn = lambda o, f: np.array([np.random.default_rng([seed, turn, int(a), int(b)]).random() < ratio for a, b in zip(o, f, strict=True)], bool)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _parts(batches):
                p, reached = _predicted(part, trees)
                d1, d2 = _LOSSES[loss](p, part.y - constant)
                r, w = part.w * d1, part.w * d2
                for t in searched:
                    node = np.zeros(part.n, np.int64) if t < 0 else reached[t]
                    own = np.where(node < len(number[t]), number[t][np.minimum(node, len(number[t]) - 1)], -1)
                    some = np.flatnonzero(own >= 0)
                    o = np.unique(own[some])
                    total = [np.bincount(own[some], x[some], len(options))[o] for x in (w, r, np.ones(part.n))]
                    if sparse:
                        yield _batch(_SUMS, o=o, f=np.full(len(o), -1), range=np.zeros(len(o), int), v=np.zeros(len(o)), w=total[0], r=total[1], n=total[2].astype(int))
                    at = np.flatnonzero(own[part.row] >= 0)
                    order = at[np.lexsort((part.v[at], part.f[at], own[part.row[at]]))]
                    if not len(order):
                        continue
                    eo, ef, ev = own[part.row[order]], part.f[order], part.v[order]
                    cut = np.flatnonzero(np.append(True, (eo[1:] != eo[:-1]) | (ef[1:] != ef[:-1]) | (ev[1:] != ev[:-1])))
                    sums = [np.add.reduceat(x[part.row[order]], cut) for x in (w, r)]
                    eo, ef, ev = eo[cut], ef[cut], ev[cut]
                    place = np.zeros(len(cut), np.int64)
                    for f in np.unique(ef).tolist():
                        if f in borders:
                            place[ef == f] = np.searchsorted(borders[f], ev[ef == f])
                    count = np.diff(np.append(cut, len(order)))
                    keep = drawn(eo, ef) if drawn else slice(None)
                    yield _batch(_SUMS, o=eo[keep], f=ef[keep], range=place[keep], v=ev[keep], w=sums[0][keep], r=sums[1][keep], n=count[keep])

        return self.rows.mapInArrow(run, _SUMS).groupBy("o", "f", "range", "v").agg(F.sum("w").alias("w"), F.sum("r").alias("r"), F.sum("n").alias("n"))

    def _best(self, options: list[tuple[int, int, Node]]) -> dict[int, dict]:
        """The best split of each open node: feature, border, gain, and the sums of its two sides."""
        sums = self._sums(options)
        held = None
        if self.sparse:
            held = sums.persist()
            own = held.where("f >= 0")
            total = held.where("f < 0").select("o", F.col("w").alias("tw"), F.col("r").alias("tr"), F.col("n").alias("tn"))
            rest = own.groupBy("o", "f").agg(*[F.sum(c).alias(c) for c in ("w", "r", "n")]).join(F.broadcast(total), "o").where("tn > n")  # a row an open node
            zero = [(f, int(np.searchsorted(b, 0.0))) for f, b in self.borders.items()]
            place = F.create_map(*[F.lit(x) for z in zero for x in z])[F.col("f")] if zero else F.lit(0)
            rest = rest.select("o", "f", F.coalesce(place, F.lit(0)).alias("range"), F.lit(0.0).alias("v"), (F.col("tw") - F.col("w")).alias("w"), (F.col("tr") - F.col("r")).alias("r"), (F.col("tn") - F.col("n")).alias("n"))
            sums = own.unionByName(rest)
        elif self.borders:
            held = sums.persist()
            sums = held
        base = {c: F.lit(0) for c in ("w", "r", "n")}
        end = F.lead("v").over(W.partitionBy("o", "f", "range").orderBy("v"))
        if self.borders:
            ranges = sums.groupBy("o", "f", "range").agg(*[F.sum(c).alias(f"{c}0") for c in base], F.min("v").alias("first"))
            order = W.partitionBy("o", "f").orderBy("range")
            before = order.rowsBetween(W.unboundedPreceding, -1)
            ranges = ranges.select("o", "f", "range", F.lead("first").over(order).alias("after"), *[F.coalesce(F.sum(f"{c}0").over(before), F.lit(0)).alias(f"{c}b") for c in base])
            sums = sums.join(ranges, ["o", "f", "range"])
            base = {c: F.col(f"{c}b") for c in base}
            end = F.coalesce(end, F.col("after"))
        upto = W.partitionBy("o", "f", "range").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
        run = sums.withColumns({**{f"{c}l": b + F.sum(c).over(upto) for c, b in base.items()}, "end": end})
        # what a node has in all is what any feature of it has
        nodes = [(o, float(v.weight), *map(float, self._terms(t, k, v))) for o, (t, k, v) in enumerate(options)]
        nodes = self.spark.createDataFrame(nodes, "o int, parent double, same double, cross double, slope double, change double")
        whole = sums.groupBy("o", "f").agg(F.sum("w").alias("wt"), F.sum("r").alias("rt"), F.sum("n").alias("nt")) if self.borders else None
        if whole is None:
            every = W.partitionBy("o", "f", "range")
            run = run.withColumns({f"{c}t": F.sum(c).over(every) for c in ("w", "r", "n")})
        else:
            run = run.join(whole, ["o", "f"])
        run = run.join(F.broadcast(nodes), "o")  # a row an open node
        a, b = F.col("wl") + F.col("same"), F.col("wt") - F.col("wl") + F.col("same")
        x, y, cross = F.col("rl") - F.col("slope"), F.col("rt") - F.col("rl") - F.col("slope"), F.col("cross")
        whole = a * b - cross * cross
        low, high = (b * x - cross * y) / whole, (a * y - cross * x) / whole
        kept = run.where(F.col("end").isNotNull() & (F.col("nl") >= self.c.min_pop) & (F.col("nt") - F.col("nl") >= self.c.min_pop))
        kept = kept.select("o", F.col("f").alias("feature"), ((F.col("v") + F.col("end")) / 2).alias("border"), (x * low + y * high - 2 * F.col("change")).alias("gain"), (low + F.col("parent")).alias("low"), (high + F.col("parent")).alias("high"))
        kept = kept.where("gain is not null and not isnan(gain)")
        best = kept.groupBy("o").agg(F.max_by(F.struct("feature", "border", "gain", "low", "high"), F.struct("gain", -F.col("feature"), -F.col("border"))).alias("b"))
        out = {r.o: r.b.asDict() for r in best.collect()}  # a row an open node
        if held is not None:
            held.unpersist()
        return out

    def grow(self) -> bool:
        """Make the best split among the latest trees' leaves and a new root; of equal gains the first."""
        options = self._options()
        found, best = self._best(options), None
        self.round += 1
        for o in range(len(options)):
            if o in found and (best is None or found[o]["gain"] > found[best]["gain"]):
                best = o
        if best is None or found[best]["gain"] <= 1e-12:
            return False
        (t, k, _), b = options[best], found[best]
        if t < 0:
            t = len(self.model.trees)
            self.model.trees.append([Node(-1, 0, 0.0)])
        tree = self.model.trees[t]
        node = tree[k]
        node.feature, node.border, node.le, node.gt, node.weight = b["feature"], b["border"], len(tree), len(tree) + 1, 0.0
        tree += [Node(k, node.depth + 1, b["low"]), Node(k, node.depth + 1, b["high"])]
        return True

    def _tree_sums(self, tree: int) -> dict[int, tuple[float, float]]:
        """Sums of both derivatives over each leaf of one tree."""
        trees, loss, constant = self.model.packed(), self.c.loss, self.model.constant

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _parts(batches):
                p, reached = _predicted(part, trees)
                d1, d2 = _LOSSES[loss](p, part.y - constant)
                k = np.unique(reached[tree])
                yield _batch("k int, d1 double, d2 double", k=k, d1=np.bincount(reached[tree], part.w * d1)[k], d2=np.bincount(reached[tree], part.w * d2)[k])

        sums = self.rows.mapInArrow(run, "k int, d1 double, d2 double").groupBy("k").agg(F.sum("d1").alias("d1"), F.sum("d2").alias("d2"))
        return {r.k: (r.d1, r.d2) for r in sums.collect()}

    def _shared(self, leaves: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """(weights of rows that share each two leaves, weighted residuals of each leaf's rows)."""
        trees, constant, size = self.model.packed(), self.model.constant, len(leaves)
        number = [np.full(len(t[0]), -1) for t in trees]
        for i, (t, k) in enumerate(leaves):
            number[t][k] = i

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, right = np.zeros(size * size), np.zeros(size)
            for part in _parts(batches):
                p, reached = _predicted(part, trees)
                own = [x[k] for x, k in zip(number, reached, strict=True)]
                for a in own:
                    right += np.bincount(a, part.w * (part.y - constant - p), size)
                    for b in own:
                        total += np.bincount(a * size + b, part.w, size * size)
            some = np.flatnonzero(total)
            yield _batch("i int, j int, v double", i=some // size, j=some % size, v=total[some])
            yield _batch("i int, j int, v double", i=np.arange(size), j=np.full(size, -1), v=right)

        sums = self.rows.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
        shared, right = np.zeros((size, size)), np.zeros(size)
        own = sums["j"] < 0
        right[sums["i"][own]] = sums["v"][own]
        shared[sums["i"][~own], sums["j"][~own]] = sums["v"][~own]
        return shared, right

    def optimize(self) -> None:
        """Newton steps on every leaf weight, one after the other."""
        leaves = self.model.leaves()
        if not leaves:
            return
        shared, right = self._shared(leaves) if self.c.loss == "LS" and len(leaves) <= SHARED else (None, None)
        size = self.lam(0, False)
        bend = [size * self.shape(tree).matrix(self.c.algorithm) for tree in self.model.trees]
        for _ in range(self.c.num_iteration_opt):
            i = 0
            for t, tree in enumerate(self.model.trees):
                own = [v for v in tree if v.le < 0 and v.parent >= 0]
                known = self._tree_sums(t) if shared is None else {}
                sums = [known.get(k, (0.0, 0.0)) for k, v in enumerate(tree) if v.le < 0 and v.parent >= 0]
                weight = np.array([v.weight for v in own])
                for k in range(len(own)):
                    d1, d2 = sums[k] if shared is None else (right[i], shared[i, i])
                    step = self.c.opt_stepsize * (d1 - bend[t][k] @ weight) / (d2 + bend[t][k, k])
                    weight[k] += step
                    if shared is not None:
                        right -= shared[:, i] * step
                    i += 1
                for v, x in zip(own, weight.tolist(), strict=True):
                    v.weight = x

    def run(self, tested: Callable[[Trees], None] | None = None) -> Trees:
        """Grow to the wanted number of leaves, with all weights optimized every `opt_interval` leaves and at the end; `tested` gets the forest every `test_interval` leaves, optimized, and at the end."""
        passed = lambda before, after, every: every > 0 and after // every > before // every
        try:
            while self.n and len(self.model.leaves()) < self.c.max_leaf_forest:
                before = len(self.model.leaves())
                if not self.grow():
                    break
                after = len(self.model.leaves())
                if passed(before, after, self.c.opt_interval):
                    self.optimize()
                if tested and after < self.c.max_leaf_forest and passed(before, after, self.c.test_interval):
                    tested(self.model)
            if self.n:
                self.optimize()
            if tested:
                tested(self.model)
        finally:
            self.rows.unpersist()
        return self.model


def grow_forest(rows: DataFrame, config: ForestConfig, start: pd.DataFrame | None = None) -> DataFrame:
    """The node table (NODES) of one forest on all of `rows` (features, y[, w]); tree -1 holds the constant.

    Rows with a null in features, y or w, or a y that isn't a number, are left
    out; features that are absent, null in an array's place excepted, count as
    zeros; an empty table gives the constant 0 alone.  `start` continues from a
    saved table.  With f_ratio below 1 each round draws features for each open
    node by the seed.
    """
    model = Grower(rows, config, start).run()
    return rows.sparkSession.createDataFrame([tuple(x) for x in model.rows()], NODES)


_TESTED = "n_trees int, n_leaves int, n bigint, accuracy double, rmse double, sqerr double, loss double"


def train_test(train: DataFrame, test: DataFrame, config: ForestConfig, start: pd.DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(node table, a row for each test: trees, leaves, rows, share of right signs, root of the mean squared error, mean squared error, mean loss).

    The forest is tested on `test` (features array, y) every `test_interval`
    leaves and at the end; an empty test table gives null figures.
    """
    found: list[tuple] = []
    test = test.where("features is not null and y is not null")

    def tested(model: Trees) -> None:
        rows = predict(test, _frame(model)).select("y", F.col("prediction").alias("p"))
        right = F.avg(((F.col("y") > 0) == (F.col("p") > 0)).cast("double"))
        r = rows.agg(F.count("*"), right, F.sqrt(F.avg((F.col("y") - F.col("p")) ** 2)), F.avg((F.col("y") - F.col("p")) ** 2), F.avg(forest_loss(config.loss, F.col("p"), F.col("y")))).first()
        found.append((len(model.trees), len(model.leaves()), *r))

    model = Grower(train, config, start).run(tested)
    spark = train.sparkSession
    return spark.createDataFrame([tuple(x) for x in model.rows()], NODES), spark.createDataFrame(found, _TESTED)


def _frame(model: Trees) -> pd.DataFrame:
    return pd.DataFrame(model.rows(), columns=[x.split()[0] for x in NODES.split(", ")])
