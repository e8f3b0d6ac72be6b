"""Training runs end to end, and scoring with the newest usable model."""
from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens import schemas as S
from cohortlens.operators import store as st
from cohortlens.operators import train as tr
from cohortlens.operators.score import score
from cohortlens.operators.tree_model import load_model
from cohortlens.session import path_exists

RULES = {"logistic": ">", "random_forest": ">", "boosted_a": ">=", "boosted_b": ">=", "neural": ">="}


def train(spark: SparkSession, kind: str, df: DataFrame, runs_path: str, models_path: str, predictions_path: str,
          search: tuple[int, int] | None = None, params: dict | None = None) -> str:
    """Fit, evaluate, save the model, replace the model's predictions, record the run; returns the run id.

    The run is recorded last, so a run that is listed has its artifact and its predictions."""
    start, run_id = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None), uuid.uuid4().hex
    result = tr.train_model(kind, df, search=search, params=params)
    artifact = f"{models_path.rstrip('/')}/{run_id}"
    result["model"].write().overwrite().save(artifact)
    name = tr.MODEL_NAMES[kind]
    st.sink_replace_model(tr.emit_predictions(result["test_scored"], name, run_id), predictions_path, [name])
    metrics = {k: v for k, v in result["metrics"].items() if isinstance(v, (int, float)) and v is not None}
    st.record_run(spark, runs_path, tr.EXPERIMENTS[kind], {**result["params"], "cutoff_day": S.CUTOFF_DAY}, metrics,
                  artifact_uri=artifact, start_time=start, run_id=run_id)
    return run_id


def latest_run_with_artifact(spark: SparkSession, runs_path: str, kind: str, top: int = 20) -> str | None:
    """Newest finished run of a model slot whose artifact is there, among its ``top`` newest; None if there is none."""
    runs = (spark.read.parquet(runs_path).where((F.col("experiment") == tr.EXPERIMENTS[kind]) & (F.col("status") == "FINISHED"))
            .orderBy(F.desc("start_time"), F.desc("run_id")).select("run_id", "artifact_uri").limit(top).collect())
    for r in runs:
        if r.artifact_uri and not r.artifact_uri.startswith(st.SERVER_ARTIFACTS) and path_exists(spark, f"{r.artifact_uri}/metadata"):
            return r.run_id
    return None


def model_of_run(spark: SparkSession, runs_path: str, run_id: str):
    """The saved model of a recorded run."""
    return load_model(spark, spark.read.parquet(runs_path).where(F.col("run_id") == run_id).first()["artifact_uri"])


def latest_model(spark: SparkSession, runs_path: str, kind: str, top: int = 20) -> tuple | None:
    """(run id, model) of the newest usable run of a model slot; None if there is none."""
    run = latest_run_with_artifact(spark, runs_path, kind, top)
    return None if run is None else (run, model_of_run(spark, runs_path, run))


def score_latest(spark: SparkSession, runs_path: str, kind: str, completed: DataFrame) -> DataFrame:
    """Accepted requests scored with the newest usable model, with its run id and model name."""
    found = latest_model(spark, runs_path, kind)
    if found is None:
        raise LookupError(f"no usable run of {tr.EXPERIMENTS[kind]}")
    run_id, model = found
    return score(model, completed.where(F.col("accepted")), RULES[kind]).withColumns(
        {"run_id": F.lit(run_id), "model_name": F.lit(tr.MODEL_NAMES[kind])})
