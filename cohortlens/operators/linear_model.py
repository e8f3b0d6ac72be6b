"""Logistic regression with a penalised intercept (M1), fitted by Newton steps over Spark.

The objective is ``|w|^2 / 2 + C * sum(weight * log(1 + exp(-margin)))`` with a
constant column as one of the features, so the intercept is penalised like any
other coefficient. It is strictly convex: the one point where its gradient is zero
is the model, whatever found it. ``gradient`` gives that certificate.

Each step is one job: tasks multiply their rows into sums of gradient and Hessian
cells, which are added up by cell; the driver solves a system of the features'
number.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.session import path_exists, remove_path, ship_package

STEPS, TOLERANCE = 50, 1e-9


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width - 1)
    return np.column_stack([x, np.ones(len(x))])


def derivatives(rows: DataFrame, w: np.ndarray, c: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Objective, gradient and Hessian at ``w`` over ``rows(x, y, weight)``; the last coefficient is the intercept."""
    width, spark = len(w), rows.sparkSession
    upper = np.triu_indices(width)
    sent = spark.sparkContext.broadcast(w)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + width + len(upper[0]))
        for batch in batches:
            x = _matrix(batch, width)
            y, weight = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("y", "weight"))
            margin = x @ sent.value
            p = 1 / (1 + np.exp(-margin))
            total[0] += (weight * (np.logaddexp(0, margin) - y * margin)).sum()
            total[1:1 + width] += x.T @ (weight * (p - y))
            total[1 + width:] += (x.T @ (x * (weight * p * (1 - p))[:, None]))[upper]
        yield pa.record_batch([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["cell", "v"])

    found = rows.mapInArrow(cells, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    sent.destroy()
    total = np.zeros(1 + width + len(upper[0]))
    for r in found:
        total[r["cell"]] = r["v"]
    hessian = np.zeros((width, width))
    hessian[upper] = total[1 + width:]
    hessian = hessian + hessian.T - np.diag(hessian.diagonal())
    return (float(w @ w) / 2 + c * total[0], w + c * total[1:1 + width], np.eye(width) + c * hessian)


def fit(rows: DataFrame, width: int, c: float, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients with the intercept last, gradient there) by Newton steps, halved until the objective falls."""
    ship_package(rows.sparkSession)
    w = np.zeros(width + 1)
    value, gradient, hessian = derivatives(rows, w, c)
    for _ in range(steps):
        if np.abs(gradient).max() < TOLERANCE:
            break
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while True:
            there = derivatives(rows, w - size * step, c)
            if there[0] <= value or size < 1e-6:
                break
            size /= 2
        if there[0] > value or (there[0] == value and np.abs(there[1]).max() >= np.abs(gradient).max()):
            break      # the objective's last digits
        w, (value, gradient, hessian) = w - size * step, there
    return w, gradient


class LinearModel:
    """Feature stages and coefficients; the margin is a sum of products on the JVM."""

    def __init__(self, prep: PipelineModel, names: list[str], coefficients: list[float], intercept: float):
        self.prep, self.names, self.coefficients, self.intercept = prep, list(names), [float(x) for x in coefficients], float(intercept)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probability``, the vector of both classes' probabilities."""
        keep = [c for c in df.columns if c not in ("features", "probability")]
        rows = self.prep.transform(df.select(*keep)).select(*keep, vector_to_array("features").alias("__x"))
        margin = F.lit(self.intercept)
        for i, w in enumerate(self.coefficients):
            margin = margin + F.col("__x")[i] * F.lit(w)
        rows = rows.withColumn("__p", 1 / (1 + F.exp(-margin)))
        return rows.withColumn("probability", array_to_vector(F.array(1 - F.col("__p"), F.col("__p")))).drop("__x", "__p")

    def table(self, spark: SparkSession) -> DataFrame:
        """(feature, coefficient), the intercept last."""
        return spark.createDataFrame([*zip(self.names, self.coefficients), ("intercept", self.intercept)], "feature string, coefficient double")

    def write(self) -> "LinearModel":
        return self

    def overwrite(self) -> "LinearModel":
        self._replace = True
        return self

    def save(self, path: str) -> None:
        """Stages under ``prep``, then the coefficients in ``metadata``, which marks the model as whole."""
        spark = SparkSession.getActiveSession()
        if getattr(self, "_replace", False) and path_exists(spark, path):
            remove_path(spark, path)
        self.prep.write().save(f"{path}/prep")
        row = (self.names, self.coefficients, self.intercept)
        spark.createDataFrame([row], "names array<string>, coefficients array<double>, intercept double").write.parquet(f"{path}/metadata")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "LinearModel":
        r = spark.read.parquet(f"{path}/metadata").first()
        return LinearModel(PipelineModel.load(f"{path}/prep"), r["names"], r["coefficients"], r["intercept"])


def vector_names(rows: DataFrame, column: str = "features") -> list[str]:
    """Names of a vector column's positions, from its metadata."""
    groups = rows.schema[column].metadata["ml_attr"]["attrs"]
    return [a["name"] for a in sorted((a for g in groups.values() for a in g), key=lambda a: a["idx"])]
