"""Decision trees from gradient and hessian histograms over binned features.

Every row has one small integer code a feature. A level of a tree needs, per open
node, feature and code, the sums of gradients and hessians; splits are chosen
from these sums alone. Gradients are rounded to multiples of 2^-20, so sums are
whole numbers: they do not depend on the order of addition, and a tree grown from
histograms that many tasks add up equals one grown in a single task.

The same histograms grow second-order boosted trees (leaf ``-G / (H + l2)``) and
classification trees (gradient ``-w y``, hessian ``w``: the leaf is the weighted
share of class 1 and the gain the weighted Gini gain).
"""
from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

UNIT = 1 << 20            # gradients are whole multiples of 1 / UNIT
SUM_ROWS = 1 << 12        # rows that meet all trees together


@dataclass(frozen=True)
class Growth:
    """How a tree grows."""
    depth: int
    bins: int
    l2: float = 0.0
    least_hessian: float = 0.0       # smallest hessian sum of a child
    least_gain: float = 0.0          # a split must gain more
    leaf_rows: int = 1               # smallest number of rows of a child (forests)
    split_rows: int = 2              # smallest number of rows of a node that splits (forests)
    node_features: int | None = None  # features drawn for every node (forests)
    symmetric: bool = False          # one split for all nodes of a level


@dataclass
class Trees:
    """Nodes of all trees in flat arrays; ``feature`` -1 marks a leaf, the right child follows the left."""
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray     # values below it go left
    left: np.ndarray
    value: np.ndarray
    cover: np.ndarray         # hessian sum of the node's training rows
    gain: np.ndarray

    @property
    def nbytes(self) -> int:
        return sum(getattr(self, f).nbytes for f in self.__dataclass_fields__)

    @staticmethod
    def joined(parts: list[Trees]) -> Trees:
        """All trees of several ensembles in one."""
        sizes = np.cumsum([0] + [len(p.feature) for p in parts])
        shifted = [replace(p, roots=p.roots + s, left=np.where(p.left >= 0, p.left + s, -1)) for p, s in zip(parts, sizes)]
        return Trees(*(np.concatenate([getattr(p, f) for p in shifted]) if shifted else np.empty(0) for f in Trees.__dataclass_fields__))

    def scaled(self, rate: float) -> Trees:
        return replace(self, value=self.value * rate)

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaf values of every row of ``x``; NaN goes left."""
        total, inner = np.zeros(len(x)), self.feature >= 0
        # a leaf leads to itself: nothing reaches its threshold
        feature = np.where(inner, self.feature, 0).astype(np.int64)
        threshold = np.where(inner, self.threshold, np.nan)
        low = np.where(inner, self.left, np.arange(len(inner)))
        for first in range(0, len(x), SUM_ROWS):
            part = x[first:first + SUM_ROWS]
            flat, row = part.ravel(), np.arange(len(part)) * x.shape[1]
            for root in self.roots:
                at = np.full(len(part), root)
                while inner[at].any():
                    at = low[at] + (flat[row + feature[at]] >= threshold[at])
                total[first:first + SUM_ROWS] += self.value[at]
        return total


def split_scores(hist: np.ndarray, s: Growth) -> tuple[np.ndarray, np.ndarray]:
    """Gain of every (node, feature, code) split, -inf where it is not allowed, and the sums on its left.

    ``hist`` is (nodes, features, codes, 2 or 3): sums of gradients, hessians and rows.
    """
    total = hist[:, 0].sum(axis=1)[:, None, None]
    left = np.cumsum(hist, axis=2)
    right = total - left

    def score(part):
        g, h = part[..., 0] / UNIT, part[..., 1] / UNIT + s.l2
        return np.divide(g * g, h, out=np.zeros_like(g), where=h > 0)
    gain = 0.5 * (score(left) + score(right) - score(total)) - s.least_gain
    least = max(1, round(s.least_hessian * UNIT))
    allowed = (left[..., 1] >= least) & (right[..., 1] >= least)
    if hist.shape[-1] > 2:
        allowed &= (left[..., 2] >= s.leaf_rows) & (right[..., 2] >= s.leaf_rows) & (total[..., 2] >= s.split_rows)
    return np.where(allowed, gain, -np.inf), left


class Grower:
    """A tree that grows level by level from histograms that the caller supplies.

    ``open`` lists the nodes that the next level may split. A forest's nodes that
    cannot split (too few rows, or one class only) do not open.
    """

    def __init__(self, s: Growth, total: np.ndarray):
        self.s = s
        self.feature, self.code = np.array([-1], np.int32), np.zeros(1, np.int64)
        self.left, self.gain = np.array([-1]), np.zeros(1)
        self.totals = np.asarray(total, np.int64)[None]
        self.open = np.array([0])

    def split(self, hist: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Split open nodes by their best gain; tells which were split.

        ``columns`` (nodes, features) names the features of ``hist``. Codes up to
        a split's code go left.
        """
        gain, below = split_scores(hist, self.s)
        nodes, _, codes = gain.shape
        flat = gain.reshape(nodes, -1)
        if self.s.symmetric:
            joint = np.where(np.isfinite(flat), np.maximum(flat, 0), 0).sum(axis=0)
            at, splits = np.full(nodes, joint.argmax()), np.full(nodes, joint.max(initial=0) > 1e-9)
        else:
            at = flat.argmax(axis=1)
            splits = flat[np.arange(nodes), at] > 1e-9
        who, at = np.flatnonzero(splits), at[splits]
        place, code, split = at // codes, at % codes, self.open[who]
        first = len(self.feature) + 2 * np.arange(len(who))
        best = flat[who, at]
        self.feature[split], self.code[split], self.left[split] = columns[who, place], code, first
        self.gain[split] = np.where(np.isfinite(best), np.maximum(best, 0), 0)
        low = below[who, place, code]
        child = np.stack([low, self.totals[split] - low], axis=1).reshape(-1, hist.shape[-1])
        self.totals = np.concatenate([self.totals, child])
        more = 2 * len(who)
        self.feature = np.concatenate([self.feature, np.full(more, -1, np.int32)])
        self.code = np.concatenate([self.code, np.zeros(more, np.int64)])
        self.left = np.concatenate([self.left, np.full(more, -1)])
        self.gain = np.concatenate([self.gain, np.zeros(more)])
        able = np.ones(more, bool)
        if hist.shape[-1] > 2:
            able = ((child[:, 2] >= max(self.s.split_rows, 2 * self.s.leaf_rows)) & (child[:, 0] < 0)
                    & (child[:, 0] + child[:, 1] > 0))
        self.open = (len(self.feature) - more + np.arange(more))[able]
        return splits

    def trees(self, borders: list[np.ndarray]) -> Trees:
        g, h = self.totals[:, 0] / UNIT, self.totals[:, 1] / UNIT + self.s.l2
        value = np.divide(-g, h, out=np.zeros_like(g), where=h > 0)
        threshold = np.array([borders[f][c] if f >= 0 else 0.0 for f, c in zip(self.feature.tolist(), self.code.tolist())])
        return Trees(np.array([0]), self.feature, threshold, self.left, value, self.totals[:, 1] / UNIT, self.gain)


def histogram(codes: np.ndarray, rows: np.ndarray, node: np.ndarray, columns: np.ndarray, sums: list[np.ndarray], bins: int) -> np.ndarray:
    """(nodes, features, bins, len(sums)) sums of ``rows`` in open nodes; ``columns`` (nodes, features).

    ``node`` and ``sums`` have one entry a row of ``rows``. Features are counted one
    after the other, so a feature's codes and cells stay in the processor's cache.
    """
    nodes, width = columns.shape
    same = nodes == 1 or (columns == columns[0]).all()
    flat, first = codes.T.ravel(), node * bins
    out = np.empty((nodes, width, bins, len(sums)), np.int64)
    for j in range(width):
        code = codes[:, columns[0, j]][rows] if same else flat[columns[node, j] * len(codes) + rows]
        cell = first + code
        for i, x in enumerate(sums):
            out[:, j, :, i] = np.bincount(cell, weights=x, minlength=nodes * bins).reshape(nodes, bins)
    return out


def node_of(codes: np.ndarray, grower: Grower, rows: np.ndarray | None = None) -> np.ndarray:
    """The node of an open or finished tree that every row (of ``rows``) is in."""
    flat, row = codes.T.ravel(), np.arange(len(codes)) if rows is None else rows
    inner = grower.feature >= 0
    # a leaf leads to itself: no code exceeds its own
    start = np.where(inner, grower.feature, 0).astype(np.int64) * len(codes)
    most = np.where(inner, grower.code, 1 << 30)
    low = np.where(inner, grower.left, np.arange(len(inner)))
    at = np.zeros(len(row), np.int64)
    for _ in range(grower.s.depth if inner.any() else 0):
        there = low[at] + (flat[start[at] + row] > most[at])
        if (there == at).all():
            break
        at = there
    return at


def smaller_children(grower: Grower) -> np.ndarray:
    """For every pair of open siblings, which (0 or 1) has the smaller hessian sum."""
    return grower.totals[grower.open, 1].reshape(-1, 2).argmin(axis=1)


def with_siblings(small: np.ndarray, parents: np.ndarray, smaller: np.ndarray) -> np.ndarray:
    """Histograms of all open nodes from those of the smaller siblings: the other is the rest of its parent."""
    both, pairs = np.empty((2 * len(small), *small.shape[1:]), np.int64), np.arange(len(small))
    both[2 * pairs + smaller], both[2 * pairs + 1 - smaller] = small, parents - small
    return both


def grow_here(codes: np.ndarray, sums: list[np.ndarray], s: Growth, columns: np.ndarray,
              rng: np.random.Generator | None = None) -> tuple[Grower, np.ndarray]:
    """A tree over rows held in memory, and the node that every row ends in.

    ``sums`` are gradient, hessian and, for forests, row counts, as whole
    numbers; rows with zeros take no part but are led to a leaf. Of two sibling
    nodes only the smaller is summed.
    """
    grower = Grower(s, np.array([x.sum() for x in sums]))
    draws = s.node_features is not None and s.node_features < len(columns)
    flat, idle = codes.T.ravel(), np.logical_and.reduce([x == 0 for x in sums])
    at, rows = np.zeros(len(codes), np.int64), np.flatnonzero(~idle)
    node, hist = np.zeros(len(rows), np.int64), None
    for _ in range(s.depth):
        n = len(grower.open)
        if not n:
            break
        wide = np.tile(columns, (n, 1))
        if draws:
            wide = rng.permuted(wide, axis=1)[:, :s.node_features]
        if draws or hist is None:
            hist = histogram(codes, rows, node, wide, [x[rows] for x in sums], s.bins)
        else:
            smaller = smaller_children(grower)
            part = (node & 1) == smaller[node >> 1]
            some = rows[part]
            small = histogram(codes, some, node[part] >> 1, wide[::2], [x[some] for x in sums], s.bins)
            hist = with_siblings(small, hist, smaller)
        opened = grower.open
        splits = grower.split(hist, wide)
        hist = hist[splits]
        stays = splits[node]
        rows, parent = rows[stays], opened[node[stays]]
        at[rows] = grower.left[parent] + (flat[grower.feature[parent].astype(np.int64) * len(codes) + rows] > grower.code[parent])
        place = np.full(len(grower.feature), -1)
        place[grower.open] = np.arange(len(grower.open))
        node = place[at[rows]]
        rows, node = rows[node >= 0], node[node >= 0]
    rest = np.flatnonzero(idle)
    at[rest] = node_of(codes, grower, rest)
    return grower, at


# ---------------------------------------------------------------------------
# Boosted trees: rows kept node by node
# ---------------------------------------------------------------------------
JOINT_CELLS = 1 << 12     # cells of a joint column, about what a core's nearest cache holds


class Cells:
    """The codes of rows, and columns of joint codes of several features.

    One pass over a joint column sums up all of its features: their histograms are
    margins of the joint one. Sums are whole numbers, so this changes no bit.
    """

    def __init__(self, codes: np.ndarray, sizes: list[int]):
        self.codes, self.sizes, self.bins = codes, sizes, max(sizes, default=1)
        groups: list[list[int]] = []
        for f in sorted(range(len(sizes)), key=lambda f: -sizes[f]):
            fits = (g for g in groups if np.prod([sizes[k] for k in g]) * sizes[f] <= JOINT_CELLS)
            group = next(fits, None)
            groups.append([f]) if group is None else group.append(f)
        self.groups = []
        for group in groups:
            shape = [sizes[f] for f in group]
            joint = np.zeros(len(codes), np.uint16 if np.prod(shape) <= 1 << 16 else np.int64)
            for f, size in zip(group, shape):
                joint *= joint.dtype.type(size)
                joint += codes[:, f].astype(joint.dtype)
            self.groups.append((group, shape, joint))

    def sums(self, rows: np.ndarray, parts: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
        """(features of ``columns``, codes, parts): the sums of ``parts`` over ``rows``."""
        place = {f: i for i, f in enumerate(columns.tolist())}
        out = np.zeros((len(columns), self.bins, len(parts)), np.int64)
        parts = [x.take(rows) for x in parts]
        for group, shape, joint in self.groups:
            wanted = [(k, place[f]) for k, f in enumerate(group) if f in place]
            if not wanted:
                continue
            cell = joint.take(rows).astype(np.intp)
            for i, x in enumerate(parts):
                found = np.bincount(cell, weights=x, minlength=int(np.prod(shape))).reshape(shape)
                for k, at in wanted:
                    out[at, :shape[k], i] = found.sum(axis=tuple(a for a in range(len(shape)) if a != k))
        return out


def parted(codes: np.ndarray, rows: np.ndarray, feature: int, code: int) -> list[np.ndarray]:
    """Those of ``rows`` that go left and those that go right."""
    right = codes[:, feature].take(rows) > code
    return [rows.take(np.flatnonzero(~right)), rows.take(np.flatnonzero(right))]


def grow_by_rows(cells: Cells, rows: np.ndarray, parts: list[np.ndarray], s: Growth, columns: np.ndarray,
                 total=lambda found: found) -> tuple[Grower, list[tuple[int, np.ndarray]]]:
    """A boosted tree over ``rows``, and the rows of every leaf: the tree of :func:`grow_here`.

    ``parts`` are the gradients and hessians of all rows. ``total`` adds up the
    histograms of all who grow the tree together.
    """
    hist = total(cells.sums(rows, parts, columns)[None])
    grower, held, leaves = Grower(s, hist[0, 0].sum(axis=0)), [rows], []
    for depth in range(s.depth):
        if depth:
            smaller = smaller_children(grower)
            small = total(np.stack([cells.sums(held[2 * i + k], parts, columns) for i, k in enumerate(smaller.tolist())]))
            hist = with_siblings(small, hist, smaller)
        opened, below = grower.open.tolist(), []
        splits = grower.split(hist, np.tile(columns, (len(hist), 1)))
        hist = hist[splits]
        for node, splitting, rows in zip(opened, splits.tolist(), held):
            if splitting:
                below += parted(cells.codes, rows, grower.feature[node], grower.code[node])
            else:
                leaves.append((node, rows))
        held = below
        if not held:
            break
    return grower, leaves + list(zip(grower.open.tolist(), held))


def leaves_of(grower: Grower, codes: np.ndarray, rows: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The rows of every leaf of a grown tree that some of ``rows`` reach."""
    todo, out = [(0, rows)], []
    while todo:
        node, rows = todo.pop()
        if grower.feature[node] < 0:
            out.append((node, rows))
        elif len(rows):
            low, high = parted(codes, rows, grower.feature[node], grower.code[node])
            todo += [(int(grower.left[node]), low), (int(grower.left[node]) + 1, high)]
    return out


def uniform(ids: np.ndarray, stream: int) -> np.ndarray:
    """A number in (0, 1) for every row id, the same wherever the row is."""
    x = ids.astype(np.uint64) + np.uint64((stream * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
