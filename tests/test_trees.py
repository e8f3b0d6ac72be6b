"""Histogram trees, searches and attributions against plain versions."""
from itertools import combinations
from math import factorial

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortlens import schemas as S
from cohortlens.operators import attribution, boosting as B, histogram_trees as H, train as tr
from cohortlens.operators.histogram_trees import UNIT, Growth, Trees, grow_here
from cohortlens.operators.tree_model import load_model
from cohortlens.plans import queries
from cohortlens.session import scratch_path

A = {"n_estimators": 6, "max_depth": 3, "learning_rate": 0.3, "subsample": 0.8, "colsample_bytree": 0.7, "min_child_weight": 1, "gamma": 0}
C = {"iterations": 6, "depth": 3, "learning_rate": 0.3, "l2_leaf_reg": 3, "bagging_temperature": 0.5, "border_count": 32}
FOREST = {"n_estimators": 9, "max_depth": 6, "min_samples_split": 6, "min_samples_leaf": 2, "bootstrap": True, "class_weight": "balanced"}


def data(n=700, width=5, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, width)), 1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(scale=0.5, size=n) > 0).astype(float)
    return x, y


def held(x, y):
    ids = np.arange(len(y))
    table = pa.table({"id": ids, "y": y, "fold": ids % 3, "w_pos": np.where(y == 1, 2.0, 1.0), "w_balanced": np.ones(len(y)),
                      "x": pa.array(x.tolist())})
    return B.Held(table, x.shape[1])


def borders_of(x):
    return [np.unique(c)[1:] for c in x.T]


def plain_best(x, g, h, l2, least):
    """Best second-order split of one node by trying every feature and value."""
    score = lambda a, b: a * a / (b + l2)
    best = (1e-9, None)
    for f in range(x.shape[1]):
        for t in np.unique(x[:, f])[1:]:
            left = x[:, f] < t
            hl, hr = h[left].sum(), h[~left].sum()
            if hl >= least and hr >= least:
                gain = 0.5 * (score(g[left].sum(), hl) + score(g[~left].sum(), hr) - score(g.sum(), h.sum()))
                if gain > best[0] + 1e-9:
                    best = (gain, (f, t))
    return best


def test_splits_and_leaves_are_the_best_ones():
    x, y = data()
    g, h = 0.5 - y, np.full(len(y), 0.25)
    sums = [np.rint(g * UNIT), np.rint(h * UNIT)]
    borders = borders_of(x)
    grower, leaf = grow_here(B.coded(x, borders), sums, Growth(depth=3, bins=256, l2=1.0, least_hessian=2.0), np.arange(5))
    tree = grower.trees(borders)
    todo = [(0, np.ones(len(y), bool), 0)]
    while todo:
        node, rows, depth = todo.pop()
        assert tree.value[node] == pytest.approx(-g[rows].sum() / (h[rows].sum() + 1.0))
        assert tree.cover[node] == pytest.approx(h[rows].sum())
        gain, split = plain_best(x[rows], g[rows], h[rows], 1.0, 2.0)
        if tree.feature[node] < 0:
            assert depth == 3 or split is None
            assert (leaf[rows] == node).all()
            continue
        assert tree.gain[node] == pytest.approx(gain)
        right = x[:, tree.feature[node]] >= tree.threshold[node]
        todo += [(tree.left[node], rows & ~right, depth + 1), (tree.left[node] + 1, rows & right, depth + 1)]
    assert np.allclose(tree.sums(x), tree.value[leaf])


def test_symmetric_levels_and_forest_limits():
    x, y = data()
    trees, _ = B.boost_here("boosted_b", C, held(x, y), borders_of(x))
    at = trees.roots[1]
    level = [trees.left[at], trees.left[at] + 1]
    assert len({(int(trees.feature[n]), float(trees.threshold[n])) for n in level}) == 1
    forest, total = B.forest_here({**FOREST, "bootstrap": False, "min_samples_leaf": 9}, held(x, y), borders_of(x), range(3))
    leaves = forest.feature < 0
    assert (forest.cover[leaves] >= 9).all() and (forest.value >= 0).all() and (forest.value <= 1 + 1e-9).all()
    assert np.allclose(forest.sums(x), total)


def test_boosting_learns_and_prefixes_equal_shorter_runs():
    x, y = data(900)
    rows = held(x, y)
    _, margins = B.boost_here("boosted_a", {**A, "n_estimators": 40}, rows, borders_of(x), rows.fold != 0, [10, 40])
    short, _ = B.boost_here("boosted_a", {**A, "n_estimators": 10}, rows, borders_of(x), rows.fold != 0)
    assert np.allclose(short.sums(x), margins[10])
    out = rows.fold == 0
    assert B.f1_of(y[out], (margins[40][out] >= 0).astype(float)) > 0.8
    assert B.runs_of("boosted_a", [{**A, "n_estimators": 5}, {**A, "n_estimators": 9}, {**A, "gamma": 1}])[0][1] == {0: 5, 1: 9}


@pytest.mark.parametrize("kind,p", [("boosted_a", A), ("boosted_b", C)])
def test_levels_over_spark_grow_the_same_trees(spark, kind, p):
    x, y = data(400)
    x[::17, 3] = np.nan
    rows = held(x, y)
    df = spark.createDataFrame([(i, float(y[i]), 2.0 if y[i] else 1.0, 1.0, 0, [float(v) for v in x[i]]) for i in range(len(y))],
                               "id long, y double, w_pos double, w_balanced double, fold int, x array<double>").repartition(3)
    borders = B.feature_borders(df, x.shape[1], 64)
    here, _ = B.boost_here(kind, p, rows, borders)
    one = B.fit_boosted(spark, kind, df, borders, p)
    many = B.boost_levels(spark, kind, df, borders, p, refresh=2)
    for other in (one, many):
        for f in Trees.__dataclass_fields__:
            assert np.array_equal(getattr(here, f), getattr(other, f)), f


def exact_shapley(tree, x):
    """Shapley values over all subsets of features, of one row."""
    def known(s, node=0):
        f = tree.feature[node]
        if f < 0:
            return tree.value[node]
        low = tree.left[node]
        if f in s:
            return known(s, low + (1 if x[f] >= tree.threshold[node] else 0))
        return sum(tree.cover[c] * known(s, c) for c in (low, low + 1)) / tree.cover[node]
    width = len(x)
    out = np.zeros(width)
    for j in range(width):
        for size in range(width):
            for s in combinations([k for k in range(width) if k != j], size):
                w = factorial(size) * factorial(width - 1 - size) / factorial(width)
                out[j] += w * (known({*s, j}) - known(set(s)))
    return out


def test_attributions_equal_all_subsets():
    x, y = data(300)
    x[5, 0] = np.nan
    trees, _ = B.boost_here("boosted_a", {**A, "max_depth": 4, "subsample": 1.0, "colsample_bytree": 1.0}, held(x, y), borders_of(np.nan_to_num(x)))
    groups = attribution.leaf_paths(trees)
    values = attribution.shapley(groups, x[:12])
    ends = [*trees.roots[1:], len(trees.feature)]
    for r in range(12):
        want = np.zeros(5)
        for a, b in zip(trees.roots, ends):
            one = Trees(np.array([0]), trees.feature[a:b], trees.threshold[a:b], np.where(trees.left[a:b] >= 0, trees.left[a:b] - a, -1),
                        trees.value[a:b], trees.cover[a:b], trees.gain[a:b])
            want += exact_shapley(one, x[r])
        assert np.allclose(values[r], want, atol=1e-12)
    assert np.allclose(values.sum(axis=1) + attribution.expected(trees), trees.sums(x[:12]), atol=1e-12)


def test_forest_groups_sample_beyond_the_bound(spark):
    x, y = data(600)
    df = spark.createDataFrame([(i, float(y[i]), 1.0, 1.0, 0, [float(v) for v in x[i]]) for i in range(len(y))],
                               "id long, y double, w_pos double, w_balanced double, fold int, x array<double>")
    borders = B.feature_borders(df, 5, 32)
    whole = B.fit_forest(spark, df, borders, FOREST)
    again, _ = B.forest_here(FOREST, held(x, y), borders, range(9))
    assert len(whole.roots) == 9 and np.allclose(whole.sums(x), again.sums(x) / 9)
    part = B.fit_forest(spark, df, borders, FOREST, task_rows=200)
    assert len(part.roots) == 9 and ((part.sums(x) > 0.5) == y).mean() > 0.8


def test_saved_models_score_alike(spark, tables):
    r = tr.train_model("boosted_b", tables.students.transform(lambda s: queries.feat.early_frame(s, tables.student_vle)), params=C)
    path = scratch_path(spark, "t-model")
    r["model"].write().overwrite().save(path)
    r["model"].write().overwrite().save(path)
    test = r["test_scored"].drop("probability", "predicted")
    a, b = (m.margins(test).select("enrol_key", "margin").collect() for m in (r["model"], load_model(spark, path)))
    assert sorted(a) == sorted(b)
    assert abs(sum(v for _, v in r["model"].importances()) - 1) < 1e-9 or not (r["model"].trees.feature >= 0).any()
    assert r["test_scored"].where(~F.col("probability").between(0, 1)).count() == 0


def test_registered_searches_have_the_reference_sizes(spark, sf_dir, monkeypatch):
    seen = []

    def scores(spark, kind, rows, borders, candidates, folds):
        seen.append((kind, candidates, folds))
        return [0.0] * len(candidates)

    monkeypatch.setattr(B, "search_scores", scores)
    monkeypatch.setattr(B, "fit_forest", lambda spark, rows, borders, p: B.Trees.joined([]))
    monkeypatch.setattr(B, "fit_boosted", lambda spark, kind, rows, borders, p: B.Trees.joined([]))
    monkeypatch.setattr(queries, "search_scores", scores)
    for q in (queries.q_train_random_forest, queries.q_train_boosted_a, queries.q_train_boosted_b, queries.q_random_search):
        q(spark, sf_dir)
    assert [(k, len(c), f) for k, c, f in seen] == [("random_forest", 10, 5), ("boosted_a", 20, 3), ("boosted_b", 20, 3), ("random_forest", 10, 5)]
    assert {c["n_estimators"] for c in seen[1][1]} <= {500, 700, 1000} and all(100 <= c["n_estimators"] <= 300 for c in seen[0][1])
    assert S.RANDOM_STATE == 42


def test_codes_take_a_byte_and_rows_without_weight_are_led_but_not_counted(monkeypatch):
    x, y = data(500)
    borders, counted = borders_of(x), []
    codes = B.coded(x, borders)
    assert codes.dtype == np.uint8 and codes.flags.f_contiguous
    plain = H.histogram
    monkeypatch.setattr(H, "histogram", lambda codes, rows, *rest: (counted.append(rows), plain(codes, rows, *rest))[1])
    taught = np.arange(500) % 5 > 0
    sums = [np.rint(v * taught * UNIT) for v in (0.5 - y, np.full(500, 0.25))]
    grower, leaf = grow_here(codes, sums, Growth(depth=3, bins=256, l2=1.0), np.arange(5))
    assert all(taught[rows].all() for rows in counted) and len(counted[0]) == taught.sum()
    assert np.array_equal(grower.trees(borders).sums(x), grower.trees(borders).value[leaf])


def test_levels_run_over_cached_blocks(spark, monkeypatch):
    x, y = data(300)
    df = spark.createDataFrame([(i, float(y[i]), 1.0, 1.0, 0, [float(v) for v in x[i]]) for i in range(len(y))],
                               "id long, y double, w_pos double, w_balanced double, fold int, x array<double>")
    monkeypatch.setattr(B, "BLOCK_ROWS", 20)
    monkeypatch.setattr(B, "MOST_PARTS", 1)
    blocks = B.row_blocks(df, "w_pos", borders_of(x)).collect()
    assert len(blocks) > 1 and sorted(i for b in blocks for i in b[0]) == list(range(300))
    many = B.boost_levels(spark, "boosted_a", df, borders_of(x), A)
    here, _ = B.boost_here("boosted_a", A, B.Held(df.select("*").toArrow(), 5), borders_of(x))
    assert all(np.array_equal(getattr(here, f), getattr(many, f)) for f in Trees.__dataclass_fields__)
