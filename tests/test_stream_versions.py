"""The stream's model by epoch: a run recorded later scores later epochs only, also when an epoch is replayed."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortlens import schemas as S
from cohortlens.operators import score as sc
from cohortlens.operators import store as st
from cohortlens.operators import train as tr
from cohortlens.session import remove_path, scratch_path
from cohortlens.streaming import stream_latest

SMALL = {"n_estimators": 3, "max_depth": 3, "min_samples_split": 2, "min_samples_leaf": 1, "bootstrap": True, "class_weight": None}


def test_versions_by_epoch_and_replay(spark, tables):
    runs, src, live, ckpt, artifact = (scratch_path(spark, n) for n in ("v-runs", "v-req", "v-live", "v-ckpt", "v-model"))
    model = tr.train_model("random_forest", tables.students, params=SMALL)["model"]
    model.write().overwrite().save(artifact)
    d = sc.defaults_profile(tables.students, S.FEATURE_COLS)
    began = dt.datetime(2024, 1, 1)

    def record(name, day):
        st.record_run(spark, runs, tr.EXPERIMENTS["random_forest"], {}, {}, artifact_uri=artifact,
                      start_time=began + dt.timedelta(days=day), run_id=name)

    def run():
        stream_latest(spark, src, tables.requests.schema, d, runs, "random_forest", S.FEATURE_COLS, live, ckpt,
                      S.REQUEST_BOUNDS_FULL).awaitTermination()

    def scored():
        return {(r.run_id, r.n) for r in st.read_live(spark, live).groupBy("run_id").agg(F.count("*").alias("n")).collect()}

    st.record_run(spark, runs, tr.EXPERIMENTS["random_forest"], {}, {}, start_time=began, run_id="no-artifact")
    tables.requests.where("request_id % 2 = 0").coalesce(1).write.mode("append").parquet(src)
    with pytest.raises(Exception, match="no usable run"):
        run()
    record("one", 1)
    run()
    record("two", 2)
    tables.requests.where("request_id % 2 = 1").coalesce(1).write.mode("append").parquet(src)
    run()
    before = scored()
    assert {x for x, _ in before} == {"one", "two"}
    record("three", 3)
    assert remove_path(spark, f"{ckpt}/commits/1")       # the last epoch is replayed
    run()
    assert scored() == before
