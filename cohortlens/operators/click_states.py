"""Click features at any cutoff from mergeable states by day band.

A state sums up the clicks of one enrolment in one band of 30 days: counts, sums
and the sum of squares as whole numbers, the largest value, the days as the bits
of one number, the sites as a set. States of different bands merge: sums add up,
days of disjoint bands count separately, site sets unite. A cutoff needs the
states of the bands before it and the log's rows of at most one band, so a log
that is stored by band is not read again.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens import schemas as S
from cohortlens.operators.features import KEYS, join_features
from cohortlens.session import scratch_path

BAND_DAYS = 30


def band_of(day: Column) -> Column:
    return F.floor(day / BAND_DAYS).cast("int")


def click_states(clicks: DataFrame) -> DataFrame:
    """(enrolment, band, n, clicks, squares, largest, days, sites) of the log; rows without a day are left out.

    One partial aggregate: a hot enrolment leaves one row a band and map task.
    """
    day, c = F.col("date"), F.col("sum_click").cast("long")
    return (clicks.where(day.isNotNull()).withColumn("band", band_of(day)).groupBy(*KEYS, "band")
            .agg(F.count(c).alias("n"), F.sum(c).alias("clicks"), F.sum((c * c).cast("decimal(20,0)")).alias("squares"),
                 F.max(c).alias("largest"), F.bit_or(F.expr(f"shiftleft(1L, date - band * {BAND_DAYS})")).alias("days"),
                 F.collect_set("id_site").alias("sites")))


def write_states(clicks: DataFrame, path: str | None = None) -> DataFrame:
    """The states of a log, stored by band so that a cutoff reads the folders before it."""
    spark, path = clicks.sparkSession, path or scratch_path(clicks.sparkSession, "click-states")
    states = click_states(clicks)
    states.write.partitionBy("band").parquet(path)
    return spark.read.schema(states.schema).parquet(path)


def features_at(states: DataFrame, clicks: DataFrame, cutoff_day: int) -> DataFrame:
    """The six click features up to ``cutoff_day``, as ``features.click_features`` gives them from the log."""
    first_open = (cutoff_day + 1) // BAND_DAYS          # the first band that the cutoff cuts or does not reach
    parts = states.where(F.col("band") < first_open)
    if (cutoff_day + 1) % BAND_DAYS:
        parts = parts.unionByName(click_states(clicks.where(F.col("date").between(first_open * BAND_DAYS, cutoff_day))))
    merged = parts.groupBy(*KEYS).agg(
        F.sum("n").alias("n"), F.sum("clicks").alias("clicks"), F.sum("squares").alias("squares"), F.max("largest").alias("largest"),
        F.sum(F.bit_count("days")).alias("days"), F.size(F.array_distinct(F.flatten(F.collect_list("sites")))).alias("sites"))
    n, total = F.col("n").cast("double"), F.col("clicks").cast("decimal(19,0)")
    spread = (F.col("n").cast("decimal(12,0)") * F.col("squares").cast("decimal(24,0)") - total * total).cast("double")
    return merged.select(
        *KEYS, F.col("clicks").cast("double").alias("vle_total_clicks"), F.col("days").cast("double").alias("vle_active_days"),
        F.col("sites").cast("double").alias("vle_unique_resources"), F.try_divide(F.col("clicks").cast("double"), n).alias("vle_avg_clicks_per_day"),
        F.col("largest").cast("double").alias("vle_max_clicks"),
        F.coalesce(F.try_divide(F.sqrt(spread), n), F.lit(0.0)).alias("vle_std_clicks"))


def early_frame_at(students: DataFrame, states: DataFrame, clicks: DataFrame, cutoff_day: int = S.CUTOFF_DAY) -> DataFrame:
    """I4 at any cutoff, from stored states."""
    return join_features(students, features_at(states, clicks, cutoff_day))
