"""Readers for the learner tables.

CSV columns are taken by header name, in any order and with others beside them.
Values are read as text, the pandas-style missing-value tokens become NULL in
columns of every type, and the rest is cast; what does not cast is NULL too and
counted by ``csv_rejects``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens import schemas as S


KEY = "enrol_key"
ENROLMENT = ["code_module", "code_presentation", "id_student"]


def _text(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The schema's columns as text, by header name, missing tokens as NULL (``enrol_key`` may be absent)."""
    raw = spark.read.option("header", True).option("nullValue", "").csv(path)
    by_name = {c.strip().lstrip("\ufeff"): c for c in raw.columns}
    absent = [f.name for f in schema.fields if f.name not in by_name and f.name != KEY]
    if absent:
        raise ValueError(f"{path}: no column named {', '.join(absent)}")
    cols = [F.col(f"`{by_name[f.name]}`").alias(f.name) for f in schema.fields if f.name in by_name]
    text = raw.select(*cols)
    return text.select(*[F.when(~F.trim(F.col(c)).isin(S.CSV_NA_TOKENS), F.col(c)).alias(c) for c in text.columns])


def _cast(f: T.StructField):
    value = F.col(f.name)
    return value if isinstance(f.dataType, T.StringType) else F.trim(value).try_cast(f.dataType)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    text = _text(spark, path, schema)
    out = text.select(*[_cast(f).alias(f.name) for f in schema.fields if f.name in text.columns])
    if KEY in schema.names and KEY not in text.columns:  # the sources have no key of their own
        out = out.withColumn(KEY, F.xxhash64(*ENROLMENT)).select(*schema.names)
    return out


def csv_rejects(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Per column, the values that are not missing and do not cast to the declared type."""
    text = _text(spark, path, schema)
    bad = [F.count_if(F.col(f.name).isNotNull() & _cast(f).isNull()).alias(f.name)
           for f in schema.fields if f.name in text.columns]
    counts = text.agg(*bad)
    return counts.unpivot([], counts.columns, "column_name", "rejected")


def scan_enrolments(spark: SparkSession, path: str,
                    schema: T.StructType = S.RAW_STUDENTS_SCHEMA) -> DataFrame:
    """The whole enrolment file (raw, before cleaning)."""
    return read_csv(spark, path, schema)


def scan_sites(spark: SparkSession, path: str) -> DataFrame:
    """The site dimension."""
    return read_csv(spark, path, S.VLE_SCHEMA)


def scan_clicks(spark: SparkSession, path: str) -> DataFrame:
    """S3: the click log. File splits replace the reference's 50,000-row chunks."""
    return read_csv(spark, path, S.STUDENT_VLE_SCHEMA)


DAY_BAND = 30


def ingest_clicks(clicks: DataFrame, out_path: str) -> None:
    """S3 sink: click log to parquet, partitioned by a band of days, so that the
    cutoff (``date <= 60``) can skip whole folders by ``day_band``; rebalanced, so a
    hot enrolment or band is written by many tasks."""
    (clicks.withColumn("day_band", F.floor(F.col("date") / DAY_BAND).cast("int")).hint("rebalance")
           .sortWithinPartitions("day_band", "date")
           .write.mode("overwrite").partitionBy("day_band").parquet(out_path))


def scan_early_clicks(spark: SparkSession, path: str, cutoff_day: int = S.CUTOFF_DAY) -> DataFrame:
    """The stored click log up to a day: folders of later bands are not read."""
    return (spark.read.parquet(path).where(F.col("day_band") <= cutoff_day // DAY_BAND)
            .where(F.col("date") <= cutoff_day).drop("day_band"))


def ingest_tables(spark: SparkSession, enrolments: str, sites: str, clicks: str, out: str) -> DataFrame:
    """The three CSV inputs to cleaned tables under ``out`` in one call (S1-S3, F1-F3, K1); returns the checks (K7)."""
    from cohortlens.operators import store
    from cohortlens.operators.cleaning import clean_students
    students = store.sink_recreate(clean_students(scan_enrolments(spark, enrolments), keep=(KEY,)), f"{out}/students")
    vle = store.sink_recreate(scan_sites(spark, sites), f"{out}/vle")
    ingest_clicks(scan_clicks(spark, clicks), f"{out}/studentVle")
    return store.ingest_checks(students, vle, spark.read.parquet(f"{out}/studentVle"))


def scan_table(spark: SparkSession, path: str) -> DataFrame:
    """Full table scan of a stored parquet table."""
    return spark.read.parquet(path)


def scan_pruned(students: DataFrame) -> DataFrame:
    """The 5 columns the clustering job reads; Catalyst prunes the scan."""
    return students.select("id_student", "avg_score", "active_days", "total_clicks", "dropout")
