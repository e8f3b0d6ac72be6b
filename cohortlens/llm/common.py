"""Helpers shared by the training-data operators: tables, scratch copies, Arrow views of text."""
from __future__ import annotations

import gc
import tempfile
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.session import scratch_path

# fixed by the contracts: ASCII white space that separates words
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 1 << 20


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package's code to the executors' Python workers, once an application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="cohortlens-code-")) / "cohortlens_code.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables, read through Spark only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*cols: str) -> Column:
    """A 64-bit key of a whole row: equal rows share it, NULLs count as values."""
    return F.xxhash64(*[F.col(c) for c in cols])


class Scratch:
    """Tables written under the shared checkpoint folder to cut lineage.

    A written table survives lost executors and keeps later plans short.
    ``drop`` deletes tables that are no longer read and lets Spark's context
    cleaner remove the shuffle files of the finished jobs.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship_package(spark)
        self.spark, self.root, self.live = spark, scratch_path(spark, name), set()

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        self.release()  # what the jobs before this one shuffled
        df.write.parquet(path)
        self.live.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete these tables; no names, nothing deleted."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)
            self.live.discard(name)
        self.release()

    def drop_all(self) -> None:
        self.drop(*tuple(self.live))

    def release(self) -> None:
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its row offsets (NULL as empty), without copying rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data, offsets


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges of rows of at most ``limit`` bytes together (a longer row stands alone)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def list_column(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column over concatenated values."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
