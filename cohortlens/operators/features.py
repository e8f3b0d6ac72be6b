"""Early-course click features (A2, F4) and their join onto enrolments."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens import schemas as S

KEYS = ["id_student", "code_module", "code_presentation"]


def filter_cutoff(clicks: DataFrame, cutoff_day: int = S.CUTOFF_DAY) -> DataFrame:
    """keep click rows up to and including ``cutoff_day`` (negative days kept,
    NULL days dropped). Pushed into the parquet scan as a data filter."""
    return clicks.where(F.col("date") <= F.lit(int(cutoff_day)))


def click_features(clicks: DataFrame, cutoff_day: int = S.CUTOFF_DAY, distinct: str = "sets") -> DataFrame:
    """A2: per enrolment, six activity features over the first ``cutoff_day`` days.

    One hash aggregation on the three enrolment keys, run as a partial
    (map-side) aggregate before the shuffle, so the exchange carries one row
    per enrolment per map task, never the raw log -- also when one enrolment
    holds a third of all rows.

    The two exact distinct counts:
      distinct="sets"   (default) ``size(collect_set(...))``: one exchange. The
                        sets hold distinct days (bounded by the course length)
                        and distinct sites (bounded by the course's site list),
                        never rows; merged map-side, spilling to sort-based
                        aggregation under memory pressure.
      distinct="expand" ``countDistinct``: Catalyst's Expand (3 copies of each
                        row) and two exchanges; same result.
    Measured on the sf0.1 click log (warm, local[8]): 1.8 s vs 2.0 s.
    """
    c = F.col("sum_click")
    if distinct == "sets":
        days = F.size(F.collect_set("date"))
        sites = F.size(F.collect_set("id_site"))
    else:
        days, sites = F.countDistinct("date"), F.countDistinct("id_site")
    return (filter_cutoff(clicks, cutoff_day)
            .groupBy(*KEYS)
            .agg(F.sum(c).cast("double").alias("vle_total_clicks"),
                 days.cast("double").alias("vle_active_days"),
                 sites.cast("double").alias("vle_unique_resources"),
                 F.avg(c).alias("vle_avg_clicks_per_day"),
                 F.max(c).cast("double").alias("vle_max_clicks"),
                 F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias("vle_std_clicks")))


def drop_leakage(students: DataFrame) -> DataFrame:
    """drop the eight full-course activity columns (absent ones are ignored)."""
    return students.drop(*S.LEAKAGE_COLS)


def fill_zero(df: DataFrame) -> DataFrame:
    """enrolments without early clicks get 0 for the six click features."""
    return df.fillna(0, subset=[c for c in S.VLE_COLS if c in df.columns])


def join_features(students: DataFrame, features: DataFrame) -> DataFrame:
    """Left join of click features onto enrolments on the three keys, then F6.

    Both sides are keyed on the same three columns, so the aggregation's
    hash partitioning on those keys is reused by the join (one exchange on
    the click side, one on the enrolment side)."""
    return fill_zero(drop_leakage(students).join(features, KEYS, "left"))


def early_frame(students: DataFrame, clicks: DataFrame, cutoff_day: int = S.CUTOFF_DAY) -> DataFrame:
    """I4: enrolments with early-click features, the input of the boosted models."""
    return join_features(students, click_features(clicks, cutoff_day))
