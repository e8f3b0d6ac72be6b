"""The logistic model's optimum, certified in SQL, and its storage."""
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import linear_model as L
from cohortlens.operators import train as tr
from cohortlens.operators.tree_model import load_model
from cohortlens.session import scratch_path


def certified(rows, coefficients, c):
    """Gradient of the objective at the coefficients, computed by DuckDB from (row, position, value), label and weight."""
    con = duckdb.connect()
    con.execute("CREATE TABLE cells(r BIGINT, p INTEGER, v DOUBLE)")
    con.execute("CREATE TABLE w(p INTEGER, c DOUBLE)")
    con.execute("CREATE TABLE y(r BIGINT, y DOUBLE, s DOUBLE)")
    width = len(coefficients)
    cells = [(i, p, float(v)) for i, (x, _, _) in enumerate(rows) for p, v in enumerate([*x, 1.0]) if v]
    con.executemany("INSERT INTO cells VALUES (?, ?, ?)", cells)
    con.executemany("INSERT INTO w VALUES (?, ?)", list(enumerate(map(float, coefficients))))
    con.executemany("INSERT INTO y VALUES (?, ?, ?)", [(i, float(y), float(s)) for i, (_, y, s) in enumerate(rows)])
    sql = f"""WITH m AS (SELECT r, sum(v * c) AS m FROM cells JOIN w USING (p) GROUP BY r),
      d AS (SELECT y.r, s * (1 / (1 + exp(-m)) - y) AS d FROM y JOIN m USING (r))
      SELECT w.p, w.c + {c} * coalesce(sum(d.d * cells.v), 0) FROM w LEFT JOIN cells USING (p) LEFT JOIN d USING (r) GROUP BY w.p, w.c"""
    found = dict(con.sql(sql).fetchall())
    assert len(found) == width
    return found


def test_gradient_is_zero_and_the_intercept_is_penalised(spark, tables):
    r = tr.train_model("logistic", tables.students)
    model = r["model"]
    d = tr.with_weights(tables.students)
    train, _ = tr.split(d)
    rows = [(x.x, x.label, x.w_balanced) for x in model.prep.transform(train).select(
        tr.vector_to_array("features").alias("x"), "label", "w_balanced").collect()]
    gradient = certified(rows, [*model.coefficients, model.intercept], tr.LOGISTIC_C)
    assert max(map(abs, gradient.values())) < 1e-6
    table = model.table(spark).collect()
    assert table[-1].feature == "intercept" and len({x.feature for x in table}) == len(table) == len(model.coefficients) + 1
    path = scratch_path(spark, "linear")
    model.write().overwrite().save(path)
    again = load_model(spark, path)
    assert (again.coefficients, again.intercept) == (model.coefficients, model.intercept)
    scored = r["test_scored"]
    assert scored.where(~F.col("probability").between(0, 1)).count() == 0 and scored.count() > 0


def test_derivatives_against_differences(spark):
    rng = np.random.default_rng(3)
    rows = [([float(v) for v in rng.normal(size=3)], float(rng.integers(0, 2)), float(rng.random() + 0.5)) for _ in range(120)]
    df = spark.createDataFrame(rows, "x array<double>, y double, weight double").repartition(3)
    w = rng.normal(size=4)

    def plain(w):
        total = float(w @ w) / 2
        for x, y, s in rows:
            m = float(np.dot([*x, 1.0], w))
            total += 0.7 * s * (math.log1p(math.exp(-abs(m))) + max(m, 0) - y * m)
        return total
    value, gradient, hessian = L.derivatives(df, w, 0.7)
    assert value == pytest.approx(plain(w))
    for i in range(4):
        e = np.eye(4)[i] * 1e-5
        assert gradient[i] == pytest.approx((plain(w + e) - plain(w - e)) / 2e-5, rel=1e-5)
    assert np.allclose(hessian, hessian.T) and (np.linalg.eigvalsh(hessian) >= 1 - 1e-9).all()
    best, left = L.fit(df, 3, 0.7)
    assert np.abs(left).max() < 1e-6 and plain(best) <= plain(best + 1e-3) and plain(best) <= plain(best - 1e-3)


def test_the_network_stops_early_and_keeps_its_best_epoch(spark, monkeypatch):
    from pyspark.ml.linalg import Vectors
    rng = np.random.default_rng(1)
    rows = [(i, float(i % 2), Vectors.dense(rng.random(3) + [0.8 * (i % 2), 0, 0])) for i in range(300)]
    df = spark.createDataFrame(rows, ["enrol_key", "label", "features_sc"])
    seen = []

    class Judge(tr.BinaryClassificationEvaluator):
        def evaluate(self, scored, params=None):
            seen.append(super().evaluate(scored))
            return [0.6, 0.7, 0.65, 0.7][len(seen) - 1] if len(seen) <= 4 else 0.5
    monkeypatch.setattr(tr, "BinaryClassificationEvaluator", Judge)
    model, epochs = tr.fit_neural(df, [3, 4, 2], epochs=100, step=5, patience=10)
    assert epochs == 10 and len(seen) == 4      # best after the second step, two more without a better one
    assert seen[-1] > 0.5 and model.transform(df).count() == 300
    seen.clear()
    assert tr.fit_neural(df, [3, 4, 2], epochs=5, step=5, patience=10)[1] == 5 and len(seen) == 1
