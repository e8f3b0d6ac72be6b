"""Invariants for the write paths, split and model outputs."""
import pytest
from pyspark.sql import functions as F

from cohortlens import schemas as S
from cohortlens.operators import split as sp
from cohortlens.operators import store as st
from cohortlens.session import scratch_path

SMALL_FOREST = {"n_estimators": 6, "max_depth": 5, "min_samples_leaf": 1, "bootstrap": True, "class_weight": None}


def test_exact_split_per_class(spark, tables):
    s = tables.students.select("enrol_key", "dropout")
    out = sp.stratified_split(s, "enrol_key", "dropout", 0.2, 42, exact=True)
    rows = out.collect()
    assert len(rows) == s.count()
    assert len({r.enrol_key for r in rows}) == len(rows)           # disjoint + complete
    import math
    for y in (0, 1):
        n = sum(1 for r in rows if r.dropout == y)
        k = sum(1 for r in rows if r.dropout == y and r.is_test)
        assert k == math.ceil(0.2 * n)


def test_split_handles_null_labels(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else i % 2) for i in range(60)], "k long, y int")
    out = sp.stratified_split(df, "k", "y", 0.2, 1, exact=True)
    assert out.count() == 60
    assert out.where(F.col("y").isNull() & F.col("is_test")).count() == 4   # ceil(0.2 * 20)


def test_replace_model_leaves_others_and_is_idempotent(spark, tables):
    p = tables.predictions
    path = scratch_path(spark, "t-preds")
    st.sink_replace_model(p, path)
    before = {r.model_name: r["count"] for r in st.read_predictions(spark, path).groupBy("model_name").count().collect()}
    new = p.where(F.col("model_name") == "tabnet").withColumn("run_id", F.lit("again"))
    st.sink_replace_model(new, path)
    st.sink_replace_model(new, path)
    after = st.read_predictions(spark, path)
    counts = {r.model_name: r["count"] for r in after.groupBy("model_name").count().collect()}
    assert counts == before
    assert after.where((F.col("model_name") == "tabnet") & (F.col("run_id") != "again")).count() == 0
    assert after.where((F.col("model_name") != "tabnet") & (F.col("run_id") == "again")).count() == 0


def test_move_conserves_rows_and_empty_move(spark, tables):
    p = tables.predictions
    pred_path, live_path = scratch_path(spark, "t-preds"), scratch_path(spark, "t-live")
    st.sink_replace_model(p, pred_path)
    total = p.count()
    c = st.move_live(spark, pred_path, live_path, S.LIVE_MODEL_NAMES).first()
    left = st.read_predictions(spark, pred_path).count()
    live = st.read_live(spark, live_path).count()
    assert c.candidates == c.inserted == c.deleted == live
    assert left + live == total
    again = st.move_live(spark, pred_path, live_path, S.LIVE_MODEL_NAMES).first()
    assert (again.candidates, again.inserted, again.deleted) == (0, 0, 0)
    ids = spark.read.parquet(live_path).select("id")
    assert ids.distinct().count() == live


def test_model_probabilities_and_reload(spark, tables):
    from pyspark.ml.functions import vector_to_array

    from cohortlens.operators import train as tr
    from cohortlens.operators.tree_model import load_model
    r = tr.train_model("random_forest", tables.students, params=SMALL_FOREST)
    sc = r["test_scored"]
    assert sc.where((F.col("probability") < 0) | (F.col("probability") > 1)).count() == 0
    path = scratch_path(spark, "t-model")
    r["model"].write().overwrite().save(path)
    again = load_model(spark, path).transform(sc.drop("probability", "predicted", "features", "rawPrediction",
                                                       "prediction", *[c for c in sc.columns if c.endswith(("_idx", "_bin", "_ord", "_str"))]))
    a = {x.enrol_key: x.p for x in again.select("enrol_key", vector_to_array("probability")[1].alias("p")).collect()}
    b = {x.enrol_key: x.probability for x in sc.select("enrol_key", "probability").collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_kmeans_inertia_decreases(spark, tables):
    from cohortlens.operators.cluster import elbow
    from cohortlens.sources.readers import scan_pruned
    rows = sorted(elbow(spark, scan_pruned(tables.students), ks=range(1, 4)).collect())
    inertia = [r.inertia for r in rows]
    assert [r.k for r in rows] == [1, 2, 3]
    assert inertia[0] >= inertia[1] * 0.999 and inertia[1] >= inertia[2] * 0.999


def test_stream_scoring_is_replay_safe(spark, tables):
    """Re-running the stream on the same checkpoint scores nothing twice."""
    from cohortlens.operators import score as sc
    from cohortlens.operators import train as tr
    from cohortlens.streaming import stream_requests
    src = scratch_path(spark, "t-req")
    tables.requests.repartition(3).write.parquet(src)
    r = tr.train_model("random_forest", tables.students, params=SMALL_FOREST)
    d = sc.defaults_profile(tables.students, S.FEATURE_COLS)
    live, ckpt = scratch_path(spark, "t-live"), scratch_path(spark, "t-ckpt")
    args = (spark, src, tables.requests.schema, d, r["model"], S.FEATURE_COLS, live, ckpt, "rf", "run-x",
            S.REQUEST_BOUNDS_FULL, r["rule"])
    stream_requests(*args).awaitTermination()
    n1 = spark.read.parquet(live).count()
    stream_requests(*args).awaitTermination()
    n2 = spark.read.parquet(live).count()
    accepted = sc.complete_requests(tables.requests, d, S.FEATURE_COLS, S.REQUEST_BOUNDS_FULL) \
                 .where(F.col("accepted")).count()
    assert n1 == n2 == accepted


def _small_store(spark, n=24):
    rows = [(i, "XGBoost" if i % 2 else "tabnet", i % 2, i / n, "r") for i in range(n)]
    df = spark.createDataFrame(rows, S.PREDICTIONS_SCHEMA)
    pred_path, live_path = scratch_path(spark, "t-preds"), scratch_path(spark, "t-live")
    st.sink_replace_model(df, pred_path)
    return df, pred_path, live_path


def _both(spark, pred_path, live_path):
    ids = lambda d: sorted(r.id_student for r in d.select("id_student").collect())
    return ids(st.read_predictions(spark, pred_path)), ids(st.read_live(spark, live_path))


@pytest.mark.parametrize("crash", ["write_live", "append_mark", "delete_files", "done_mark"])
def test_move_recovers_from_every_crash_point(spark, monkeypatch, crash):
    """A crash anywhere, rows that arrive before the re-run, and a second move: no row lost or doubled."""
    _, pred_path, live_path = _small_store(spark)
    real = {k: getattr(st, k) for k in ("write_live", "delete_files", "_mark")}

    def fail(name):
        def run(*args, **kw):
            if name in ("write_live", "delete_files"):
                if name == "delete_files":
                    real[name](args[0], args[1][:1])          # some files are gone already
                else:
                    real[name](args[0].limit(3), *args[1:])   # part of the rows are there already
                raise RuntimeError("crash")
            if args[3] == name:
                raise RuntimeError("crash")
            return real["_mark"](*args, **kw)
        return run
    if crash.endswith("_mark"):
        monkeypatch.setattr(st, "_mark", fail("appended" if crash == "append_mark" else "done"))
    else:
        monkeypatch.setattr(st, crash, fail(crash))
    with pytest.raises(RuntimeError):
        st.move_live(spark, pred_path, live_path, S.LIVE_MODEL_NAMES)
    for k, f in real.items():
        monkeypatch.setattr(st, k, f)
    late = spark.createDataFrame([(100 + i, "XGBoost", 1, 0.5, "late") for i in range(5)], S.PREDICTIONS_SCHEMA)
    late.write.mode("append").partitionBy("model_name").parquet(pred_path)
    st.move_live(spark, pred_path, live_path, S.LIVE_MODEL_NAMES)
    want = (list(range(0, 24, 2)), [*range(1, 24, 2), *range(100, 105)])
    assert _both(spark, pred_path, live_path) == want
    again = st.move_live(spark, pred_path, live_path, S.LIVE_MODEL_NAMES).first()
    assert (again.candidates, again.inserted, again.deleted) == (0, 0, 0)
    assert _both(spark, pred_path, live_path) == want


def test_moving_everything_leaves_an_empty_table(spark):
    df, pred_path, live_path = _small_store(spark)
    st.move_live(spark, pred_path, live_path, ["XGBoost", "tabnet"])
    assert _both(spark, pred_path, live_path) == ([], list(range(24)))
    assert st.move_live(spark, pred_path, live_path, ["XGBoost", "tabnet"]).first().candidates == 0


def test_replacing_a_model_by_nothing_empties_it(spark):
    df, pred_path, _ = _small_store(spark)
    left = st.sink_replace_model(df.where("false"), pred_path, ["XGBoost"])
    assert {r.model_name for r in left.collect()} == {"tabnet"} and left.count() == 12


def test_one_model_is_written_by_many_tasks(spark):
    rows = spark.range(400_000).selectExpr("id as id_student", "'tabnet' as model_name", "1 as predicted",
                                           "rand(3) as probability", "uuid() as run_id")
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2m")
    try:
        path = scratch_path(spark, "t-preds")
        st.sink_replace_model(rows, path)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    assert len(st.partition_files(spark, path, "model_name", ["tabnet"])) > 1


def test_live_batches_share_one_layout(spark):
    """Saved and moved rows, many partitions, and a batch that is written again."""
    df, pred_path, live_path = _small_store(spark)
    st.sink_append_live(df.repartition(150), live_path, "saved")
    st.sink_append_live(df.repartition(150), live_path, "saved")
    st.sink_append_live(df, live_path)
    st.move_live(spark, pred_path, live_path, S.LIVE_MODEL_NAMES)
    live = st.read_live(spark, live_path)
    assert live.count() == live.select("id").distinct().count() == 24 + 24 + 12


def test_streams_with_equal_checkpoint_names_keep_their_rows(spark, tables):
    from cohortlens.operators import score as sc
    from cohortlens.streaming import stream_requests
    d = sc.defaults_profile(tables.students, S.FEATURE_COLS)
    model = _constant_model(spark)
    live, src = scratch_path(spark, "t-live"), scratch_path(spark, "t-req")
    tables.requests.repartition(2).write.parquet(src)
    done = sc.complete_requests(tables.requests, d, S.FEATURE_COLS, S.REQUEST_BOUNDS_FULL)
    n = {a: done.where(F.col("accepted") == a).count() for a in (True, False)}
    for k in (1, 2):
        stream_requests(spark, src, tables.requests.schema, d, model, S.FEATURE_COLS, live,
                        scratch_path(spark, "x") + "/ckpt", "rf", "run", S.REQUEST_BOUNDS_FULL).awaitTermination()
        rows = st.read_live(spark, live)
        assert rows.count() == rows.select("id").distinct().count() == k * n[True]
        assert spark.read.parquet(live + "_rejected").count() == k * n[False]


def _constant_model(spark):
    """A fitted model that gives every row the same probability vector."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import SQLTransformer, VectorAssembler
    stages = [SQLTransformer(statement="SELECT *, 0.25D AS p0, 0.75D AS p1 FROM __THIS__"),
              VectorAssembler(inputCols=["p0", "p1"], outputCol="probability")]
    return Pipeline(stages=stages).fit(spark.range(1))


def test_split_count_is_exact_on_multiples(spark):
    df = spark.createDataFrame([(i, 1) for i in range(35)], "k long, y int")
    assert sp.stratified_split(df, "k", "y", 0.2, 42).where("is_test").count() == 7


def test_shared_lloyd_passes_equal_plain_loops(spark):
    """All k together against one plain fit a k; copies, a constant feature, a NULL row, more centres than points."""
    import random

    from cohortlens.operators import cluster as clu
    rng = random.Random(8)
    rows = [(i, rng.choice([10.0, 50.0, 90.0]) + rng.random() * 9, float(rng.randint(0, 30)), 7.0, i % 2) for i in range(240)]
    rows += [rows[3]] * 20 + [(500, None, 1.0, 7.0, 1)]
    df = spark.createDataFrame(rows, "id_student long, avg_score double, active_days double, total_clicks double, dropout int").repartition(4)
    points = [tuple(r) for r in clu.grid_points(df).dropna().select("__p0", "__p1", "__p2", "__u").collect()]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    import math
    seeds = [min((p[3], p[:3]) for p in points)[1]]
    while len(seeds) < 6:
        spread = [(p, min(gap(p[:3], s) for s in seeds)) for p in points]
        seeds.append(min((-math.log(p[3]) / d, p[:3]) for p, d in spread if d)[1])
    got = clu.lloyd(clu.grid_points(df).dropna(), [1, 3, 6], 3)
    for k in (1, 3, 6):
        centres = [list(s) for s in seeds[:k]]
        for _ in range(clu.PASSES):
            near = [min(range(k), key=lambda j: (gap(p[:3], centres[j]), j)) for p in points]
            moved = []
            for j in range(k):
                own = [p for p, n in zip(points, near) if n == j]
                moved.append([sum(p[i] for p in own) // len(own) for i in range(3)] if own else centres[j])
            if moved == centres:
                break
            centres = moved
        assert got[k][0] == centres
        assert got[k][1] == [near.count(j) for j in range(k)]
        assert got[k][2] == pytest.approx(sum(gap(p[:3], centres[n]) for p, n in zip(points, near)) / clu.GRID ** 2)
    out, centres, _ = clu.fit_clusters(df, 3)
    placed = out.collect()
    assert len(placed) == len(rows) and [r.id_student for r in placed if r.cluster_id is None] == [500]
    means = {}
    for r in placed:
        means.setdefault(r.cluster_id, []).append(r.avg_score)
    order = [sum(means[c]) / len(means[c]) for c in sorted(c for c in means if c is not None)]
    assert order == sorted(order) and len(centres) == 3
    same = spark.createDataFrame([(1, 2.0, 2.0, 2.0, 0)] * 5, df.schema)
    assert [len(c) for c, _, _ in clu.lloyd(clu.grid_points(same), [2, 4], 3).values()] == [1, 1]
    assert clu.fit_clusters(df.limit(0), 3)[0].count() == 0
