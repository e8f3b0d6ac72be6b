"""Plan checks: pushed filters, pruned scans, no Python UDFs, no cartesian products."""
import pytest

import __spark_entry__ as E
from cohortlens.operators.features import click_features
from cohortlens.session import scratch_path
from cohortlens.sources import readers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cutoff_filter_is_pushed_into_scan(spark, tables):
    path = scratch_path(spark, "t-clicks")
    tables.student_vle.write.parquet(path)
    p = plan(click_features(spark.read.parquet(path), 60))
    assert "LessThanOrEqual(date,60)" in p
    assert "PushedFilters" in p


def test_pruned_scan_reads_five_columns(spark, tables):
    path = scratch_path(spark, "t-students")
    tables.students.write.parquet(path)
    p = plan(readers.scan_pruned(spark.read.parquet(path)))
    schema_line = [l for l in p.splitlines() if "ReadSchema" in l][0]
    assert "region" not in schema_line and "avg_score" in schema_line


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_no_python_udf_or_cartesian(frame_of, name):
    p = plan(frame_of(name))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in p, f"{name} plan contains {bad}"


@pytest.mark.parametrize("name", ["click_features", "dedup_students", "model_kpis", "group_rates",
                                  "exact_auc", "cluster_summary", "cardinalities"])
def test_aggregations_are_partial_before_the_shuffle(spark, sf_dir, name):
    p = plan(E.queries()[name](spark, sf_dir))
    assert "partial_" in p, f"{name}: no map-side partial aggregate"


def test_bucketed_ingest_removes_the_click_shuffle(spark, sf_dir):
    from cohortlens.operators.features import early_frame
    from cohortlens.sources import Tables
    t = Tables(spark, sf_dir).materialize(("student_vle", "students"), buckets=4)
    p = plan(early_frame(t.students, t.student_vle))
    assert "Exchange hashpartitioning" not in p, p          # no shuffle (a small side may be broadcast)
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:                                                    # large-table case: co-located sort-merge join
        p2 = plan(early_frame(t.students, t.student_vle))
        assert "SortMergeJoin" in p2 and "Exchange" not in p2, p2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
    bucketed = early_frame(t.students, t.student_vle).count()
    plain = early_frame(Tables(spark, sf_dir).students, Tables(spark, sf_dir).student_vle).count()
    assert bucketed == plain


def test_hot_key_falls_back_to_unbucketed_read(spark):
    """One enrolment with a third of all rows: the bucketed copy is detected
    as skewed and read unbucketed (partial aggregation spreads the hot key)."""
    from cohortlens.operators.features import click_features
    from cohortlens.sources import Tables
    rows = [("AAA", "2014B", 1, i % 40, i % 70 - 5, 2) for i in range(3000)]
    rows += [("BBB", "2014J", k, k % 40, k % 70 - 5, 1) for k in range(2, 6002)]
    df = spark.createDataFrame(rows, "code_module string, code_presentation string, id_student long, "
                                     "id_site long, date int, sum_click int")
    t = Tables(spark, "/nonexistent").use("student_vle", df)
    t.materialize(("student_vle",), buckets=8)
    p = plan(click_features(t.student_vle))
    assert "Bucketed: true" not in p
    expected = sum(r[5] for r in rows if r[2] == 1 and r[4] <= 60)
    assert click_features(t.student_vle).where("id_student = 1").first().vle_total_clicks == expected


def test_bucket_skew_of_balanced_table_is_small(spark, tables):
    from cohortlens.sources import Tables
    from cohortlens.sources.fixtures import bucket_skew  # noqa: F401
    t = Tables(spark, tables.sf_dir).materialize(("student_vle",), buckets=4)
    assert "Bucketed: true" in plan(t.student_vle.groupBy("id_student", "code_module", "code_presentation").count())
