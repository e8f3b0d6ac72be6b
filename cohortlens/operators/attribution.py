"""Path-dependent Shapley values of tree ensembles.

A leaf is reached if every feature on its path lies in that feature's interval.
With a set of features known, an unknown feature lets the leaf through by the
share of training rows that went its way. The Shapley values of a leaf depend on
which of its features lie in their intervals only, so each leaf has a table of
values by that pattern (2 ^ features on the path); a row's values are the sum of
the table rows it selects.
"""
from __future__ import annotations

from dataclasses import dataclass
from math import factorial

import numpy as np

from cohortlens.operators.histogram_trees import Trees

CELLS = 1 << 21            # table cells and row cells worked on at a time


@dataclass
class LeafPaths:
    """Leaves whose paths hold the same number of features: (leaves, features) each."""
    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray       # of the training rows that go the leaf's way at the feature's splits
    value: np.ndarray       # (leaves,)


def leaf_paths(trees: Trees) -> list[LeafPaths]:
    """Leaves of all trees, grouped by the number of features on the path."""
    groups: dict[int, list] = {}
    for root in trees.roots.tolist():
        todo = [(root, {})]
        while todo:
            node, path = todo.pop()
            f = int(trees.feature[node])
            if f < 0:
                groups.setdefault(len(path), []).append((path, float(trees.value[node])))
                continue
            at, cover = float(trees.threshold[node]), float(trees.cover[node])
            low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
            for child, lo, hi in ((int(trees.left[node]), low, min(high, at)), (int(trees.left[node]) + 1, max(low, at), high)):
                went = float(trees.cover[child]) / cover if cover > 0 else 0.0
                todo.append((child, {**path, f: (lo, hi, share * went)}))
    out = []
    for d, leaves in sorted(groups.items()):
        if d:
            features = np.array([list(p) for p, _ in leaves], np.int64)
            bounds = np.array([list(p.values()) for p, _ in leaves])
            out.append(LeafPaths(features, bounds[..., 0], bounds[..., 1], bounds[..., 2], np.array([v for _, v in leaves])))
        else:
            out.append(LeafPaths(*(np.empty((len(leaves), 0)) for _ in range(4)), np.array([v for _, v in leaves])))
    return out


def expected(trees: Trees) -> float:
    """The sum over leaves of value times share of training rows."""
    return float(sum((g.value * g.share.prod(axis=1)).sum() for g in leaf_paths(trees)))


def pattern_tables(share: np.ndarray, value: np.ndarray) -> np.ndarray:
    """(leaves, patterns, features): Shapley values by the set of features that lie in their intervals.

    For feature j the weight of a set of size s among the other d - 1 is
    s! (d - 1 - s)! / d!; sets by size are the coefficients of the product over the
    others of (share + y) where the feature lies inside and (share) where not.
    """
    leaves, d = share.shape
    inside = (np.arange(1 << d)[:, None] >> np.arange(d)) & 1                    # (patterns, d)
    weight = np.array([factorial(s) * factorial(d - 1 - s) / factorial(d) for s in range(d)])
    out = np.empty((leaves, 1 << d, d))
    for j in range(d):
        sets = np.zeros((leaves, 1 << d, d))
        sets[..., 0] = 1
        for k in (k for k in range(d) if k != j):
            grown = sets * share[:, None, k, None]
            grown[..., 1:] += sets[..., :-1] * inside[None, :, k, None]
            sets = grown
        out[..., j] = value[:, None] * (inside[None, :, j] - share[:, None, j]) * (sets @ weight)
    return out


def shapley(groups: list[LeafPaths], x: np.ndarray) -> np.ndarray:
    """(rows, features): the values of every row of ``x``."""
    n, width = x.shape
    total, unknown = np.zeros((n, width)), np.isnan(x)
    for g in groups:
        leaves, d = g.feature.shape
        if not d:
            continue
        step = max(1, CELLS // max(n * d, (1 << d) * d * d))
        for lo in range(0, leaves, step):
            part = slice(lo, lo + step)
            f = g.feature[part]
            inside = (x[:, f] >= g.low[part]) & (x[:, f] < g.high[part])         # (rows, leaves, d)
            inside |= unknown[:, f] & np.isneginf(g.low[part])                    # an unknown value goes left
            pattern = inside @ (1 << np.arange(d))
            table = pattern_tables(g.share[part], g.value[part])
            values = table[np.arange(len(f)), pattern].reshape(n, -1)
            spread = np.zeros((f.size, width))
            spread[np.arange(f.size), f.ravel()] = 1
            total += values @ spread
    return total
