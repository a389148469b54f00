"""Penalties on the leaf weights of a tree.

RGF takes half the squares of the leaf weights, each times rate^depth.  The two
others give every node v a share b_v such that the shares on the way to a leaf
add up to its weight, and take half the squares of the shares times
rate^depth: RGF_Opt the shares that make this least, RGF_Sib those in which two
siblings' shares add up to zero.  Both are quadratic in the leaf weights; their
slopes come from one pass up the tree and one down.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ALGORITHMS = ("RGF", "RGF_Opt", "RGF_Sib")


@dataclass
class Shape:
    """A binary tree: children of each node (-1: none), parents before children, and each node's factor."""

    le: np.ndarray
    gt: np.ndarray
    factor: np.ndarray

    @property
    def leaves(self) -> np.ndarray:
        return np.flatnonzero(self.le < 0)

    def slope(self, weight: np.ndarray, kind: str) -> np.ndarray:
        """Derivative of the penalty by each leaf's weight (zero at inner nodes); `weight` counts at leaves."""
        if kind == "RGF":
            return np.where(self.le < 0, self.factor * weight, 0.0)
        return self._least(weight) if kind == "RGF_Opt" else self._balanced(weight)

    def _least(self, weight: np.ndarray) -> np.ndarray:
        # up: seen from above, a subtree costs a / 2 * (s - b)^2, s being the shares' sum above it
        n = len(self.le)
        a, b = self.factor.astype(float).copy(), np.asarray(weight, float).copy()
        total = np.zeros(n)
        for v in range(n - 1, -1, -1):
            if self.le[v] >= 0:
                x, y = self.le[v], self.gt[v]
                total[v] = a[x] + a[y]
                b[v] = (a[x] * b[x] + a[y] * b[y]) / total[v]
                a[v] = self.factor[v] * total[v] / (self.factor[v] + total[v])
        # down: each inner node takes its share of what its leaves want
        above, out = np.zeros(n), np.zeros(n)
        for v in range(n):
            if self.le[v] >= 0:
                share = total[v] * (b[v] - above[v]) / (self.factor[v] + total[v])
                above[self.le[v]] = above[self.gt[v]] = above[v] + share
            else:
                out[v] = self.factor[v] * (weight[v] - above[v])
        return out

    def _balanced(self, weight: np.ndarray) -> np.ndarray:
        # up: a node's sum of shares is the mean of its children's
        n = len(self.le)
        mean = np.asarray(weight, float).copy()
        for v in range(n - 1, -1, -1):
            if self.le[v] >= 0:
                mean[v] = (mean[self.le[v]] + mean[self.gt[v]]) / 2
        parent = np.zeros(n, np.int64)
        inner = np.flatnonzero(self.le >= 0)
        parent[self.le[inner]] = parent[self.gt[inner]] = inner
        share = mean - np.where(np.arange(n) > 0, mean[parent], 0.0)
        pull = self.factor * share
        own = pull.copy()
        own[inner] -= pull[self.le[inner]] + pull[self.gt[inner]]
        # down: a change of a leaf is half a change of its parent's mean
        for v in range(1, n):
            own[v] += own[parent[v]] / 2
        return np.where(self.le < 0, own, 0.0)

    def value(self, weight: np.ndarray, kind: str) -> float:
        weight = np.where(self.le < 0, weight, 0.0)
        return float(weight @ self.slope(weight, kind)) / 2

    def matrix(self, kind: str) -> np.ndarray:
        """The penalty's second derivatives by the leaves' weights, leaves in order."""
        at = self.leaves
        return np.array([self.slope(np.eye(len(self.le))[v], kind)[at] for v in at]).reshape(len(at), len(at))

    def split(self, v: int, rate: float) -> Shape:
        """The tree with two new nodes, the last ones, below leaf v."""
        n = len(self.le)
        le, gt = np.append(self.le, [-1, -1]), np.append(self.gt, [-1, -1])
        le[v], gt[v] = n, n + 1
        return Shape(le, gt, np.append(self.factor, [self.factor[v] * rate] * 2))

    def split_terms(self, v: int, weight: np.ndarray, kind: str, rate: float) -> tuple[float, float, float, float]:
        """What the penalty is after leaf v has got two children of its weight plus x and y:
        before + change + slope * (x + y) + same * (x^2 + y^2) / 2 + cross * x * y, as (same, cross, slope, change)."""
        after, n = self.split(v, rate), len(self.le)
        grown = np.append(np.where(self.le < 0, weight, 0.0), [weight[v], weight[v]])
        grown[v] = 0.0
        unit = np.zeros(n + 2)
        unit[n] = 1.0
        second = after.slope(unit, kind)
        change = after.value(grown, kind) - self.value(weight, kind)
        return float(second[n]), float(second[n + 1]), float(after.slope(grown, kind)[n]), change
