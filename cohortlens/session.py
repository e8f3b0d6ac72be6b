"""Spark session and shared-storage helpers."""
from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


# Settings for a large cluster (100 TB inputs). Shuffles start with many
# partitions and AQE coalesces them to ~256 MB each; skewed join partitions
# are split; broadcasts happen only after AQE has measured a side at runtime
# below the threshold; input splits are 256 MB.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "16384",
    "spark.sql.shuffle.partitions": "16384",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    # estimates from compressed files decide nothing; sizes measured at run time do
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "true",
}


def get_spark(app: str = "cohortlens", master: str | None = None,
              shuffle_partitions: int | None = None, scale: bool = False) -> SparkSession:
    """Build (or reuse) a session with adaptive execution on.

    On a cluster the master comes from spark-submit; ``scale=True`` applies
    ``SCALE_CONF`` for keys spark-submit did not set. ``master`` and
    ``shuffle_partitions`` are for local runs and tests.
    """
    b = (SparkSession.builder.appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
         .config("spark.sql.session.timeZone", "UTC"))
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if scale:  # runtime SQL settings; anything given to spark-submit (--conf) wins
        given = spark.sparkContext.getConf()
        for k, v in SCALE_CONF.items():
            if not given.contains(k):
                spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster configured.

    ``spark.checkpoint.dir`` is read from the session; only when it is unset in
    a local test session is a private folder created and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="cohortlens-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint directory.

    Used for written tables (sinks, lineage cuts); never a machine-local
    temporary folder, so every executor and a restarted driver can see it.
    """
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/cohortlens/{name}-{uuid.uuid4().hex[:12]}"


def landed(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once under the shared checkpoint folder and read back, for frames that several passes read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop FileSystem of the path (any scheme)."""
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath))


def remove_path(spark: SparkSession, path: str) -> bool:
    """Delete a scratch copy that its job no longer reads."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package's code to the executors' Python workers, once an application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="cohortlens-lib-")) / "cohortlens_lib.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(target))
        _SHIPPED.add(app)
