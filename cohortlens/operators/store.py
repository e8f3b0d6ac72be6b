"""Result stores on parquet (K1-K7) and the run table (M9, O2).

Per-model results live in one table partitioned by ``model_name``; replacing
a model's rows is a dynamic partition overwrite, which leaves every other
model's partition untouched and is idempotent on re-run. The live table is
partitioned by batch; every writer names its batch, so a replay replaces it."""
from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens import schemas as S
from cohortlens.functions.collation import same_name
from cohortlens.operators.claims import LEASE_SECONDS, Claim, claimed
from cohortlens.session import path_exists

SERVER_ARTIFACTS = "server-artifacts:"


# ---------------------------------------------------------------- K1, K2, K4
def sink_recreate(df: DataFrame, path: str, schema=None) -> DataFrame:
    """K1 / K4: replace a table (data and schema) and return the stored table."""
    out = df if schema is None else df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    out.write.mode("overwrite").parquet(path)
    return out.sparkSession.read.parquet(path)


def sink_create_if_absent(spark: SparkSession, path: str, schema) -> DataFrame:
    """K2: create an empty table with the declared schema unless it exists."""
    if not path_exists(spark, path):
        spark.createDataFrame([], schema).write.mode("errorifexists").parquet(path)
    return spark.read.schema(schema).parquet(path)


# ---------------------------------------------------------------------- K3
def sink_replace_model(preds: DataFrame, path: str, model_names: list[str] | None = None) -> DataFrame:
    """K3: replace the rows of ``model_names`` (default: the models present in
    ``preds``); other models' partitions are not touched.

    Rows are rebalanced, not gathered by model, so one large model is written
    by many tasks. A named model without rows in ``preds`` is emptied. The table
    is claimed meanwhile, so that two writers replace one after the other."""
    spark = preds.sparkSession
    with claimed(spark, path) as claim:
        return _replace_model(preds, path, model_names, claim)


def _replace_model(preds: DataFrame, path: str, model_names: list[str] | None, claim: Claim) -> DataFrame:
    spark = preds.sparkSession
    rows = preds.select(*[F.col(f.name).cast(f.dataType) for f in S.PREDICTIONS_SCHEMA.fields])
    if model_names is not None:
        rows = rows.where(F.col("model_name").isin(list(model_names)))
    _overwrite_partitions(rows.hint("rebalance"), path, ["model_name"])
    if model_names is not None and path_exists(spark, path):
        present = {r.model_name for r in rows.groupBy("model_name").count().collect()}  # <= len(model_names)
        claim.check()
        drop_partitions(spark, path, "model_name", [m for m in model_names if m not in present])
    return read_predictions(spark, path)


def _overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Dynamic partition overwrite by a write option; the session's setting stays as it is."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """The predictions table, with its declared schema (also when it holds no files)."""
    cols = [f.name for f in S.PREDICTIONS_SCHEMA.fields]
    if not path_exists(spark, path):
        return spark.createDataFrame([], S.PREDICTIONS_SCHEMA)
    return spark.read.schema(S.PREDICTIONS_SCHEMA).parquet(path).select(*cols)


# ---------------------------------------------------------------------- K5
def sink_append_live(scored: DataFrame, path: str, batch_id: str | None = None) -> DataFrame:
    """K5: write scored rows as one batch of the live table.

    The live table has one layout for saved, moved and streamed rows: a
    partition per batch. A batch that is written again replaces its earlier
    attempt. Row ids are the batch id and a row index, so concurrent batches
    need no common counter. ``request_id`` is carried if the rows have one."""
    write_live(scored, path, batch_id or uuid.uuid4().hex)
    return read_live(scored.sparkSession, path)


def write_live(scored: DataFrame, path: str, batch_id: str) -> None:
    request = F.col("request_id").cast("string") if "request_id" in scored.columns else F.lit(None).cast("string")
    out = scored.select(
        F.concat_ws("-", F.lit(batch_id), F.monotonically_increasing_id().cast("string")).alias("id"),
        F.col("id_student").cast("long"), F.col("model_name").cast("string"),
        F.col("predicted").cast("int"), F.col("probability").cast("double"),
        F.col("run_id").cast("string"), F.current_timestamp().alias("created_at"),
        request.alias("request_id"), F.lit(batch_id).alias("batch_id"))
    _overwrite_partitions(out, path, ["batch_id"])


def write_rejected(completed: DataFrame, path: str, batch_id: str) -> None:
    """The requests of a batch that were not accepted, with the reason."""
    out = completed.where(~F.col("accepted")).select(
        F.col("request_id").cast("string"), F.col("student_id_text").cast("string"), "reject_reason",
        F.current_timestamp().alias("created_at"), F.lit(batch_id).alias("batch_id"))
    _overwrite_partitions(out, path, ["batch_id"])


# ---------------------------------------------------------------------- K6
def move_live(spark: SparkSession, pred_path: str, live_path: str, names=S.LIVE_MODEL_NAMES,
              marker: str | None = None, lease_seconds: float = LEASE_SECONDS, without_case: bool = False) -> DataFrame:
    """K6: move the rows of the given display-model names from the predictions
    table to the live table; returns candidate / inserted / deleted counts.

    Parquet has no cross-table transaction, so each move is a batch recorded
    in a marker table together with the exact files it moves:
      (1) 'planned': the batch id and its input files,
      (2) the files' rows are written as the batch's partition of the live table,
      (3) 'appended': from here readers count the batch,
      (4) those files, and no others, are deleted,
      (5) 'done'.
    A re-run first finishes the batches that are not done: a planned one from
    (2), which replaces its partial partition, an appended one from (4). Files
    that arrive in the meantime belong to the next batch, so no row is lost,
    doubled or deleted unmoved at any crash point.

    One mover works at a time: it claims the live table, and asks before every
    step whether it still holds it. A mover that finds another at work moves
    nothing; one that finds an expired claim finishes what the dead one began.
    ``without_case`` compares names as the reference's database does."""
    claim = Claim(spark, live_path, lease_seconds)
    if not claim.take():
        return _move_counts(spark, pred_path, names, 0, without_case)
    try:
        return _move_claimed(spark, pred_path, live_path, names, marker or batches_path(live_path), claim, without_case)
    finally:
        claim.release()


def _move_counts(spark, pred_path, names, moved, without_case) -> DataFrame:
    left = read_predictions(spark, pred_path).where(same_name(F.col("model_name"), names, without_case)).count()
    return spark.createDataFrame([(moved + left, moved, moved)], "candidates long, inserted long, deleted long")


def _move_claimed(spark, pred_path, live_path, names, marker, claim: Claim, without_case: bool) -> DataFrame:
    todo = _open_batches(spark, marker)
    fresh = partition_files(spark, pred_path, "model_name", names, without_case)
    claimed = {f for _, _, files in todo for f in files}
    fresh = [f for f in fresh if f not in claimed]
    if fresh:
        batch = uuid.uuid4().hex
        _mark(spark, marker, batch, "planned", fresh)
        todo.append((batch, "planned", fresh))
    moved = 0
    for batch, state, files in todo:
        if state == "planned":
            claim.check()
            rows = (spark.read.schema(S.PREDICTIONS_SCHEMA).option("basePath", pred_path).parquet(*files))
            write_live(rows, live_path, batch)
            claim.check()
            _mark(spark, marker, batch, "appended", files)
        moved += _live_table(spark, live_path).where(F.col("batch_id") == batch).count()
        claim.check()
        delete_files(spark, files)
        _mark(spark, marker, batch, "done", files)
    return _move_counts(spark, pred_path, names, moved, without_case)


def batches_path(live_path: str) -> str:
    return live_path.rstrip("/") + "_batches"


def _live_table(spark: SparkSession, live_path: str) -> DataFrame:
    if not path_exists(spark, live_path):
        return spark.createDataFrame([], S.LIVE_PREDICTIONS_SCHEMA)
    return spark.read.schema(S.LIVE_PREDICTIONS_SCHEMA).parquet(live_path)


def read_live(spark: SparkSession, live_path: str, marker: str | None = None) -> DataFrame:
    """The live table as committed: a batch of a move counts once it is
    marked 'appended'; batches written outside a move always count."""
    live, marker = _live_table(spark, live_path), marker or batches_path(live_path)
    if not path_exists(spark, marker):
        return live
    state = spark.read.parquet(marker).groupBy("batch_id").agg(
        F.max(F.when(F.col("state") == "planned", 0).otherwise(1)).alias("committed"))
    return live.join(F.broadcast(state.where("committed = 0").select("batch_id")), "batch_id", "left_anti").select(
        *[f.name for f in S.LIVE_PREDICTIONS_SCHEMA.fields])


def _mark(spark, marker, batch, state, files):
    now = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    spark.createDataFrame([(batch, state, files, now)], "batch_id string, state string, files array<string>, at timestamp") \
         .write.mode("append").parquet(marker)


def _open_batches(spark, marker) -> list[tuple[str, str, list[str]]]:
    """(batch id, last state, files) of every batch that is not done, oldest first."""
    if not path_exists(spark, marker):
        return []
    last = (spark.read.parquet(marker).groupBy("batch_id")
            .agg(F.min("at").alias("at"), F.collect_set("state").alias("states"), F.first("files").alias("files")))
    open_ = last.where(~F.array_contains("states", "done")).orderBy("at").collect()
    return [(r.batch_id, "appended" if "appended" in r.states else "planned", list(r.files)) for r in open_]


def _folder(spark: SparkSession, path: str):
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root


def _partition_folders(spark: SparkSession, path: str, column: str, values, without_case: bool = False):
    """Folders ``column=value`` of a table, names compared after undoing Spark's %XX escaping."""
    from urllib.parse import unquote
    fs, root = _folder(spark, path)
    written = str.lower if without_case else str
    wanted = {written(v) for v in values}
    if fs.exists(root):
        for st in fs.listStatus(root):
            name = st.getPath().getName()
            if st.isDirectory() and name.startswith(column + "=") and written(unquote(name[len(column) + 1:])) in wanted:
                yield fs, st.getPath()


def partition_files(spark: SparkSession, path: str, column: str, values, without_case: bool = False) -> list[str]:
    """Data files of the partitions ``column=value`` of a parquet table, sorted."""
    return sorted(f.getPath().toString() for fs, folder in _partition_folders(spark, path, column, values, without_case)
                  for f in fs.listStatus(folder) if f.isFile() and f.getPath().getName().endswith(".parquet"))


def delete_files(spark: SparkSession, files: list[str]) -> int:
    """Delete files; those already gone are skipped."""
    n = 0
    for f in files:
        fs, at = _folder(spark, f)
        n += bool(fs.exists(at) and fs.delete(at, False))
    return n


def drop_partitions(spark: SparkSession, path: str, column: str, values) -> int:
    """Delete the partition folders ``column=value`` of a parquet table."""
    return sum(bool(fs.delete(folder, True)) for fs, folder in _partition_folders(spark, path, column, values))


# ---------------------------------------------------------------------- K7
def ingest_checks(students: DataFrame, vle: DataFrame, clicks: DataFrame) -> DataFrame:
    """K7: row counts of the three base tables and the number of dropouts."""
    a = students.agg(F.lit("students").alias("table_name"), F.count(F.lit(1)).alias("n_rows"),
                     F.coalesce(F.sum("dropout"), F.lit(0)).cast("long").alias("n_dropout"))
    b = vle.agg(F.lit("vle").alias("table_name"), F.count(F.lit(1)).alias("n_rows"),
                F.lit(None).cast("long").alias("n_dropout"))
    c = clicks.agg(F.lit("studentVle").alias("table_name"), F.count(F.lit(1)).alias("n_rows"),
                   F.lit(None).cast("long").alias("n_dropout"))
    return a.unionByName(b).unionByName(c)


# ------------------------------------------------------------------ M9, O2
def record_run(spark: SparkSession, path: str, experiment: str, params: dict, metrics: dict,
               status: str = "FINISHED", artifact_uri: str | None = None,
               start_time: _dt.datetime | None = None, run_id: str | None = None) -> str:
    """M9: append one run row (params, metrics, artifact location); ``start_time``
    is when training began (UTC, default: now)."""
    run_id = run_id or uuid.uuid4().hex
    row = (run_id, experiment, status, start_time or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None), artifact_uri or f"{SERVER_ARTIFACTS}/{run_id}",
           {str(k): str(v) for k, v in params.items()}, {str(k): float(v) for k, v in metrics.items()})
    spark.createDataFrame([row], S.RUNS_SCHEMA).write.mode("append").parquet(path)
    return run_id


def latest_run(runs: DataFrame, top: int = 20, artifact_prefix: str = SERVER_ARTIFACTS) -> DataFrame:
    """O2: per experiment, among its ``top`` newest FINISHED runs, the newest
    whose artifacts are server-stored; experiments without one are absent.

    No window spans an experiment: the candidate is the max of
    (start_time, run_id) over usable runs (a partial aggregate), and it
    qualifies when fewer than ``top`` finished runs are newer (a filtered
    count against the one-row-per-experiment candidate table)."""
    key = F.struct("start_time", "run_id")
    fin = runs.where(F.col("status") == "FINISHED").select("experiment", "run_id", "start_time", "artifact_uri")
    best = (fin.where(F.col("artifact_uri").startswith(artifact_prefix))
               .groupBy("experiment")
               .agg(F.max_by(F.struct("run_id", "start_time", "artifact_uri"), key).alias("b")))
    best = best.select("experiment", "b.run_id", "b.start_time", "b.artifact_uri")
    cand_key = best.select("experiment", F.struct("start_time", "run_id").alias("_bk"))
    newer = (fin.join(F.broadcast(cand_key), "experiment")  # one row an experiment
                .where(key > F.col("_bk"))
                .groupBy("experiment").agg(F.count(F.lit(1)).alias("_newer")))
    return (best.join(newer, "experiment", "left")
                .where(F.coalesce(F.col("_newer"), F.lit(0)) < top)
                .select("experiment", "run_id", "start_time", "artifact_uri"))
