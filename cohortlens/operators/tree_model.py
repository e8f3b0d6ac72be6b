"""A fitted tree ensemble with its feature stages: scores, importances and per-row attributions.

The trees are flat arrays, broadcast after a check of their size; rows are scored
in Arrow batches.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators import attribution
from cohortlens.operators.histogram_trees import Trees
from cohortlens.operators.linear_model import LinearModel
from cohortlens.session import path_exists, remove_path, ship_package

MOST_BYTES = 256 << 20      # larger ensembles are refused rather than broadcast


def matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The feature arrays of a batch; NULL values are NaN."""
    return batch.column("__x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


class TreeModel:
    """Feature stages and trees; ``link`` is "logistic" (margins) or "share" (class shares)."""

    def __init__(self, prep: PipelineModel, trees: Trees, features: list[str], link: str):
        if trees.nbytes > MOST_BYTES:
            raise ValueError(f"{trees.nbytes} bytes of trees exceed {MOST_BYTES}")
        self.prep, self.trees, self.features, self.link = prep, trees, list(features), link

    def margins(self, df: DataFrame) -> DataFrame:
        """``df`` with ``margin``, the sum of all leaves that a row meets; columns named features or probability go."""
        ship_package(df.sparkSession)
        keep = [c for c in df.columns if c not in ("features", "probability", "margin")]
        rows = self.prep.transform(df.select(*keep)).select(*keep, vector_to_array("features").alias("__x"))
        width, sent = len(self.features), df.sparkSession.sparkContext.broadcast(self.trees)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.select(keep).append_column("margin", pa.array(sent.value.sums(matrix(batch, width))))

        kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
        return rows.mapInArrow(run, ", ".join([*kinds, "margin double"]))

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probability``, the vector of both classes' probabilities."""
        p = F.col("margin") if self.link == "share" else 1 / (1 + F.exp(-F.col("margin")))
        return self.margins(df).withColumn("probability", array_to_vector(F.array(1 - p, p))).drop("margin")

    def attributions(self, df: DataFrame, key: str) -> DataFrame:
        """(key, feature, value): what each feature adds to a row's margin, over :meth:`base` (path-dependent Shapley values)."""
        names, kind = pa.array(self.features, pa.string()), df.schema[key].dataType.simpleString()
        leaves = df.sparkSession.sparkContext.broadcast(attribution.leaf_paths(self.trees))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch, len(names))
                for lo in range(0, len(x), 2_048):
                    values = attribution.shapley(leaves.value, x[lo:lo + 2_048])
                    row, feature = np.divmod(np.arange(values.size), len(names))
                    yield pa.record_batch([batch.column(key).slice(lo, len(values)).take(pa.array(row)),
                                           names.take(pa.array(feature)), pa.array(values.ravel())], [key, "feature", "value"])

        ship_package(df.sparkSession)
        rows = self.prep.transform(df).select(key, vector_to_array("features").alias("__x"))
        return rows.mapInArrow(run, f"`{key}` {kind}, feature string, value double")

    def base(self) -> float:
        """The margin expected of a training row: leaves weighted by their cover."""
        return attribution.expected(self.trees)

    def importances(self) -> list[tuple[str, float]]:
        """Share of the summed gains of each feature's splits, largest first."""
        inner = self.trees.feature >= 0
        gain = np.bincount(self.trees.feature[inner], weights=self.trees.gain[inner], minlength=len(self.features))
        return sorted(zip(self.features, (gain / max(gain.sum(), 1e-300)).tolist()), key=lambda t: -t[1])

    def write(self) -> "TreeModel":
        return self

    def overwrite(self) -> "TreeModel":
        self._replace = True
        return self

    def save(self, path: str) -> None:
        """The stages under ``prep``, the trees as a Parquet table, then ``metadata``, which marks the model as whole."""
        from cohortlens.operators.boosting import tree_batch
        spark = SparkSession.getActiveSession()
        if getattr(self, "_replace", False) and path_exists(spark, path):
            remove_path(spark, path)
        self.prep.write().save(f"{path}/prep")
        spark.createDataFrame(pa.Table.from_batches([tree_batch(self.trees, 0)])).write.parquet(f"{path}/trees")
        spark.createDataFrame([(self.link, self.features)], "link string, features array<string>").write.parquet(f"{path}/metadata")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "TreeModel":
        from cohortlens.operators.boosting import trees_of_rows
        about = spark.read.parquet(f"{path}/metadata").first()
        return TreeModel(PipelineModel.load(f"{path}/prep"), trees_of_rows(spark.read.parquet(f"{path}/trees").toArrow()),
                         about.features, about.link)


def load_model(spark: SparkSession, path: str):
    """A saved model of any kind."""
    if path_exists(spark, f"{path}/trees"):
        return TreeModel.load(spark, path)
    return LinearModel.load(spark, path) if path_exists(spark, f"{path}/prep") else PipelineModel.load(path)
