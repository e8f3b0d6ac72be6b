"""Score request files as they land, with Structured Streaming.

Stateless (each request is scored on its own), so no watermark or state
store is involved; ``foreachBatch`` applies the batch pipeline (complete ->
score -> write) to every micro-batch. The checkpoint replays a batch whose
commit was not recorded; every micro-batch is one batch of the live table,
named by the stream's persistent query id and the epoch, so a replay replaces
its earlier attempt and two streams, or one restarted on a new checkpoint,
never share a batch. Rejected requests go to a table of their own with the
reason, under the same batch names.

``stream_latest`` looks up the newest usable run of a model slot at every epoch
(O2). The epoch's run is written next to the checkpoint before anything is
scored, by a file that is created only if it is not there, so a replay of the
epoch scores with the run it began with, whatever was recorded since."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators.score import complete_requests, score
from cohortlens.operators.store import write_live, write_rejected


def stream_requests(spark: SparkSession, source_dir: str, schema, defaults: DataFrame, model,
                    feature_cols, live_path: str, checkpoint: str, model_name: str, run_id: str,
                    bounds: dict | None = None, rule: str = ">=", available_now: bool = True,
                    rejected_path: str | None = None, options: dict[str, list[str]] | None = None):
    """Start the scoring stream with one model; returns the StreamingQuery."""
    return _start(spark, source_dir, schema, defaults, lambda epoch: (run_id, model, rule, model_name), feature_cols,
                  live_path, checkpoint, bounds, available_now, rejected_path, options)


def stream_latest(spark: SparkSession, source_dir: str, schema, defaults: DataFrame, runs_path: str, kind: str,
                  feature_cols, live_path: str, checkpoint: str, bounds: dict | None = None, available_now: bool = True,
                  rejected_path: str | None = None, options: dict[str, list[str]] | None = None):
    """Start the scoring stream with the newest usable run of each epoch; returns the StreamingQuery.

    An epoch for which no run is usable fails, and is tried again when the stream is started again."""
    from cohortlens.operators import lifecycle as lc
    from cohortlens.operators.train import MODEL_NAMES
    loaded: dict[str, object] = {}

    def chosen(epoch: int):
        version = _version_file(spark, checkpoint, epoch)
        run = version.read()
        if run is None:
            found = lc.latest_run_with_artifact(spark, runs_path, kind)
            if found is None:
                raise LookupError(f"no usable run of {kind}")
            run = version.create(found)
        if run not in loaded:
            loaded.clear()          # one model at a time
            loaded[run] = lc.model_of_run(spark, runs_path, run)
        return run, loaded[run], lc.RULES[kind], MODEL_NAMES[kind]

    return _start(spark, source_dir, schema, defaults, chosen, feature_cols, live_path, checkpoint, bounds, available_now,
                  rejected_path, options)


class _version_file:
    """The run id of an epoch, created once beside the checkpoint."""

    def __init__(self, spark: SparkSession, checkpoint: str, epoch: int):
        self.jvm = spark.sparkContext._jvm
        self.at = self.jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}_versions/{epoch}")
        self.fs = self.at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def read(self) -> str | None:
        if not self.fs.exists(self.at):
            return None
        stream = self.fs.open(self.at)
        try:
            return bytes(b & 0xFF for b in iter(stream.read, -1)).decode()
        finally:
            stream.close()

    def create(self, run: str) -> str:
        out = self.fs.create(self.at, False)
        out.write(bytearray(run.encode()))
        out.close()
        return run


def _start(spark: SparkSession, source_dir: str, schema, defaults: DataFrame, chosen: Callable, feature_cols, live_path: str,
           checkpoint: str, bounds, available_now: bool, rejected_path: str | None, options):
    defaults = defaults.cache()  # one row, reused by every micro-batch

    def handle(batch: DataFrame, epoch_id: int) -> None:
        # the query id that the checkpoint keeps for the life of the stream
        stream = spark.read.json(f"{checkpoint.rstrip('/')}/metadata").first()["id"]
        batch_id = f"{stream}-{epoch_id}"
        run_id, model, rule, name = chosen(epoch_id)
        done = complete_requests(batch, defaults, list(feature_cols), bounds, options)
        scored = score(model, done.where(F.col("accepted")), rule)
        write_live(scored.withColumns({"model_name": F.lit(name), "run_id": F.lit(run_id)}), live_path, batch_id)
        write_rejected(done, rejected_path or live_path.rstrip("/") + "_rejected", batch_id)

    stream = spark.readStream.schema(schema).parquet(source_dir)
    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
