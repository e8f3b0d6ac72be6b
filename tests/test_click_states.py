"""States by day band against the features of the log, at every kind of cutoff."""
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import click_states as C
from cohortlens.operators.features import click_features

SCHEMA = "code_module string, code_presentation string, id_student long, id_site long, date int, sum_click int"


def rows_of(df):
    return sorted(tuple(float(f"{x:.12g}") if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.mark.parametrize("cutoff", [-31, -1, 0, 29, 30, 59, 60, 89, 400])
def test_equals_the_log(spark, cutoff):
    rows = [("A", "2014B", i % 7, i * 31 % 11, (i * 13) % 150 - 40, i % 23) for i in range(900)]
    rows += [("A", "2014B", 1, 5, 10, None), ("B", "2014J", 99, None, 5, 4), ("B", "2014J", 98, 3, None, 4), ("C", "x", 97, 1, 2, None)]
    rows += [("A", "2014B", 3, 1, 59, 1_000_000_000)] * 3
    clicks = spark.createDataFrame(rows, SCHEMA).repartition(4)
    states = C.write_states(clicks)
    assert rows_of(C.features_at(states, clicks, cutoff)) == rows_of(click_features(clicks, cutoff))


def test_only_one_band_of_the_log_is_read(spark):
    clicks = spark.createDataFrame([("A", "p", 1, i, i, 1) for i in range(120)], SCHEMA)
    states = C.write_states(clicks)
    seen = clicks.withColumn("sum_click", F.when(F.col("date") < 60, F.raise_error(F.lit("read"))).otherwise(F.col("sum_click")).cast("int"))
    assert C.features_at(states, seen, 70).first().vle_total_clicks == 71
    assert C.features_at(states, seen, 89).first().vle_total_clicks == 90
    assert "PartitionFilters: [isnotnull(band" in C.features_at(states, clicks, 59)._jdf.queryExecution().executedPlan().toString()


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.features_at(C.write_states(none), none, 60).count() == 0
