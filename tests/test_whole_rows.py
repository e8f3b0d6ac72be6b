"""Searches, forests and boosted models learn from all rows, however many tasks hold them (M2-M5)."""
import numpy as np
import pyarrow as pa
import pytest

from cohortlens.operators import boosting as B
from cohortlens.operators.histogram_trees import Trees

A = {"n_estimators": 6, "max_depth": 3, "learning_rate": 0.3, "subsample": 0.8, "colsample_bytree": 0.7, "min_child_weight": 1, "gamma": 0}
C = {"iterations": 6, "depth": 3, "learning_rate": 0.3, "l2_leaf_reg": 3, "bagging_temperature": 0.5, "border_count": 32}
FOREST = {"n_estimators": 5, "max_depth": 5, "min_samples_split": 6, "min_samples_leaf": 2, "bootstrap": False, "class_weight": "balanced"}


def rows(spark, n, width=5, seed=3):
    """A frame of training rows, and the same rows held here."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, width)), 1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(scale=0.5, size=n) > 0).astype(float)
    x[::17, 3] = np.nan
    ids = np.arange(n)
    table = pa.table({"id": ids, "y": y, "w_pos": np.where(y == 1, 2.0, 1.0), "w_balanced": np.where(y == 1, 0.7, 1.3),
                      "fold": pa.array(ids % 3, pa.int32()), "x": pa.array(list(x), pa.list_(pa.float64()))})
    return spark.createDataFrame(table).repartition(3), B.Held(table, width)


def same(a, b):
    return all(np.array_equal(getattr(a, f), getattr(b, f)) for f in Trees.__dataclass_fields__)


def f1_here(kind, p, held, borders, fold, at):
    if kind == "random_forest":
        _, total = B.forest_here(p, held, borders, range(p["n_estimators"]), held.fold != fold)
        sure = total / p["n_estimators"] > 0.5
    else:
        _, margins = B.boost_here(kind, p, held, borders, held.fold != fold, [at])
        sure = margins[at] >= 0
    out = held.fold == fold
    return B.f1_of(held.y[out], sure[out].astype(float))


def test_a_search_reads_every_row(spark):
    df, held = rows(spark, 70_000)
    borders = B.feature_borders(df, 5, 32)
    p = {**A, "n_estimators": 2}
    assert B.search_scores(spark, "boosted_a", df, borders, [p], 3) == [pytest.approx(np.mean([f1_here("boosted_a", p, held, borders, f, 2) for f in range(3)]), abs=1e-12)]


@pytest.mark.parametrize("kind,sets", [("boosted_a", [A, {**A, "n_estimators": 3}]), ("boosted_b", [C]), ("random_forest", [FOREST])])
def test_a_search_over_more_rows_than_a_task_holds_has_the_same_scores(spark, kind, sets, monkeypatch):
    df, _ = rows(spark, 900)
    borders = B.feature_borders(df, 5, 64)
    held = B.search_scores(spark, kind, df, borders, sets, 3)
    many, forest = B.fit_boosted, B.fit_forest
    monkeypatch.setattr(B, "fit_boosted", lambda *a: many(*a, task_rows=100))
    monkeypatch.setattr(B, "fit_forest", lambda *a: forest(*a, task_rows=100))
    assert B.search_scores(spark, kind, df, borders, sets, 3, held_rows=200) == pytest.approx(held, abs=1e-12)


def test_a_forest_beyond_a_task_learns_from_all_rows(spark, monkeypatch):
    df, held = rows(spark, 600)
    borders = B.feature_borders(df, 5, 32)
    here, _ = B.forest_here(FOREST, held, borders, range(5))
    assert same(B.fit_forest(spark, df, borders, FOREST, task_rows=200), here.scaled(1 / 5))
    monkeypatch.setattr(B, "LEVEL_NODES", 3)
    monkeypatch.setattr(B, "BLOCK_ROWS", 50)
    assert same(B.fit_forest(spark, df, borders, FOREST, task_rows=200), here.scaled(1 / 5))
    drawn = {**FOREST, "bootstrap": True, "class_weight": None}
    forest = B.fit_forest(spark, df, borders, drawn, task_rows=200)
    assert (forest.cover[forest.roots] == 600).all() and len(set(forest.value[forest.roots])) > 1
    assert same(forest, B.fit_forest(spark, df.repartition(5), borders, drawn, task_rows=200))


def test_a_boosted_fit_within_a_task_needs_no_job_a_level(spark, monkeypatch):
    df, held = rows(spark, 300_000)
    borders, p = B.feature_borders(df, 5, 32), {**C, "iterations": 2}
    here, _ = B.boost_here("boosted_b", p, held, borders)
    assert same(B.fit_boosted(spark, "boosted_b", df, borders, p, task_rows=100_000), here)
    monkeypatch.setattr(B, "boost_levels", None)
    assert same(B.fit_boosted(spark, "boosted_b", df, borders, p), here)


def test_codes_of_fewer_borders_come_from_the_codes_of_all(spark):
    df, held = rows(spark, 400)
    borders = B.feature_borders(df, 5, 64)
    few = B.fewer_borders(borders, 7)
    assert np.array_equal(B.Coded(df, borders).codes(few), held.codes(few))
