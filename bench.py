"""Benchmark: ingest + headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries", "sf"}.
Ingest materialises the learner tables (the reference's load step) as
parquet in the shared checkpoint folder; every query then runs over those
whole tables and is forced with the no-op sink (full execution, no collect).
"""
from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from cohortlens import schemas as S  # noqa: E402
from cohortlens.operators import evaluate as ev  # noqa: E402
from cohortlens.operators import features as feat  # noqa: E402
from cohortlens.operators import report as rep  # noqa: E402
from cohortlens.operators import score as sc  # noqa: E402
from cohortlens.operators import split as sp  # noqa: E402
from cohortlens.operators import store as st  # noqa: E402
from cohortlens.session import get_spark, scratch_path  # noqa: E402
from cohortlens.sources import Tables  # noqa: E402


def run(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark("cohortlens-bench", master=f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus))
    t = Tables(spark, sf_dir)
    times = {}

    def timed(name, fn):
        t0 = time.perf_counter()
        fn()
        times[name] = round(time.perf_counter() - t0, 3)

    # warm-up: JVM, parquet footers (not timed)
    run(t.base("nation"))

    timed("ingest", lambda: t.materialize(buckets=max(8, 2 * cpus)))

    pj = lambda: rep.predictions_view(t.predictions, t.students)
    cj = lambda: rep.clusters_view(t.clusters, t.students)
    queries = {
        "click_features": lambda: run(feat.click_features(t.student_vle, 60)),
        "early_frame": lambda: run(feat.early_frame(t.students, t.student_vle)),
        "dedup_students": lambda: run(rep.dedup_students(t.students)),
        "join_predictions_students": lambda: run(pj()),
        "model_kpis": lambda: run(rep.model_kpis(pj())),
        "model_scores": lambda: run(ev.model_scores(pj())),
        "exact_auc": lambda: run(ev.exact_auc(pj(), ["model_name"], "probability", "dropout")),
        "group_rates": lambda: run(rep.group_rates(pj())),
        "prob_histogram": lambda: run(rep.prob_histogram(pj())),
        "cluster_summary": lambda: run(rep.cluster_summary(cj())),
        "stratified_split": lambda: run(sp.stratified_split(t.students.select("enrol_key", "dropout"),
                                                            "enrol_key", "dropout", 0.2, 42, exact=True)),
        "defaults_profile": lambda: run(sc.defaults_profile(t.students, S.FEATURE_COLS)),
        "complete_requests": lambda: run(sc.complete_requests(
            t.requests, sc.defaults_profile(t.students, S.FEATURE_COLS), S.FEATURE_COLS, S.REQUEST_BOUNDS_FULL)),
    }
    for name, fn in queries.items():
        timed(name, fn)

    def dashboard():  # J1 once, then every prediction report from it
        for df in rep.prediction_reports(t.predictions, t.students).values():
            run(df)
    timed("prediction_dashboard", dashboard)

    # model work (MLlib): k-means on the pruned scan, logistic fit + hold-out scoring
    from cohortlens.operators import cluster as clu
    from cohortlens.operators import train as tr
    from cohortlens.sources.readers import scan_pruned
    timed("kmeans_fit", lambda: run(clu.fit_clusters(scan_pruned(t.students))[0]))
    timed("train_logistic", lambda: run(tr.emit_predictions(
        tr.train_model("logistic", t.students)["test_scored"], "logistic_dropout", "bench")))

    # heavier work: forest with stated parameters, elbow curve, sinks
    forest = {"n_estimators": 100, "max_depth": 8, "min_samples_leaf": 2, "bootstrap": True, "class_weight": "balanced"}
    timed("train_forest", lambda: run(tr.emit_predictions(
        tr.train_model("random_forest", t.students, params=forest)["test_scored"], "random_forest", "bench")))
    timed("kmeans_elbow", lambda: run(clu.elbow(spark, scan_pruned(t.students))))
    pred_path, live_path = scratch_path(spark, "bench-predictions"), scratch_path(spark, "bench-live")
    timed("sink_replace_model", lambda: st.sink_replace_model(t.predictions, pred_path))
    timed("move_live", lambda: st.move_live(spark, pred_path, live_path))

    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_sec", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
