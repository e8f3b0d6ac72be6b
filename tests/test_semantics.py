"""Unit cases for the semantics the survey lists (§5.2) on tiny inputs."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortlens import functions as X
from cohortlens import schemas as S
from cohortlens.operators import evaluate as ev
from cohortlens.operators import report as rep
from cohortlens.operators.encode import minmax_features, ordinal_encode, scale_numeric


def one(df, col):
    return [r[col] for r in df.collect()]


def test_null_label_is_zero(spark):
    df = spark.createDataFrame([("Withdrawn",), (None,), ("Pass",)], "final_result string")
    assert one(df.select(X.derive_label().alias("y")), "y") == [1, 0, 0]


def test_band_cleaning(spark):
    df = spark.createDataFrame([("0",), ("10-20",), ("20-30%",), (None,)], "imd_band string")
    assert one(df.select(X.clean_imd_band().alias("b")), "b") == [None, "10-20%", "20-30%", None]
    e = spark.createDataFrame([("No Formal quals",), ("HE Qualification",)], "highest_education string")
    assert one(e.select(X.clean_education().alias("e")), "e") == ["No Formal Quals", "HE Qualification"]


def test_unknown_and_null_category_is_minus_one(spark):
    df = spark.createDataFrame([("0-10%", "0-35", "x"), (None, "55<=", "HE Qualification")],
                               "imd_band string, age_band string, highest_education string")
    r = ordinal_encode(df).collect()
    assert (r[0].imd_band, r[0].age_band, r[0].highest_education) == (0, 0, -1)
    assert (r[1].imd_band, r[1].age_band, r[1].highest_education) == (-1, 2, 3)


def test_constant_feature_minmax_is_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (3.0, 5.0, 4.0)], "avg_score double, active_days double, total_clicks double")
    r = minmax_features(df).collect()
    assert [x.active_days for x in r] == [0.0, 0.0]
    assert [x.avg_score for x in r] == [0.0, 1.0]


def test_scale_zero_std_unchanged(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "a double, b double")
    r = scale_numeric(df, ["a", "b"]).collect()
    assert [x.a for x in r] == [2.0, 2.0]
    assert [x.b for x in r] == [1.0, 3.0]  # population std of (1, 3) is 1


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(0.25,), (0.35,), (2.5,)], "x double")
    assert one(df.select(X.round1("x").alias("r")), "r") == [0.2, 0.4, 2.5]


def test_one_class_auc_is_null(spark):
    df = spark.createDataFrame([("m", 0.2, 1), ("m", 0.7, 1), ("n", 0.1, 0), ("n", 0.9, 1)],
                               "g string, probability double, label int")
    r = {x.g: x.auc for x in ev.exact_auc(df, ["g"]).collect()}
    assert r["m"] is None and r["n"] == 1.0


def test_auc_equals_brute_force(spark):
    import random
    rnd = random.Random(7)
    rows = [(rnd.choice([0.1, 0.2, 0.2, 0.5, 0.75, 0.9, rnd.random()]), rnd.randint(0, 1)) for _ in range(400)]
    df = spark.createDataFrame([("m", p, y) for p, y in rows], "g string, probability double, label int")
    pos = [p for p, y in rows if y == 1]
    neg = [p for p, y in rows if y == 0]
    brute = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg) / (len(pos) * len(neg))
    got = ev.exact_auc(df, ["g"]).first().auc
    assert got == pytest.approx(brute, abs=1e-12)
    got2 = ev.exact_auc(df, ["g"]).first().auc
    assert got2 == pytest.approx(brute, abs=1e-12)


def test_cluster_ids_above_four_merge(spark):
    df = spark.createDataFrame([(1, 0), (2, 5), (3, 7), (4, 4)], "id_student long, cluster_id int")
    labels = one(df.select(X.cluster_label().alias("l")), "l")
    assert labels == ["Cluster A", S.CLUSTER_OTHER, S.CLUSTER_OTHER, "Cluster E"]


def test_model_name_normalisation(spark):
    names = ["Random Forest", " XGBoost ", "logistic_dropout", "my_random_forest_v2", "CatBoost-1", None, "other"]
    df = spark.createDataFrame([(n,) for n in names], "model_name string")
    got = one(df.select(X.normalize_model_name().alias("d")), "d")
    assert got == ["Random Forest", "XGBoost", "Logistic Regression", "Random Forest", "CatBoost", "None", "other"]


def test_unmatched_prediction_keeps_nulls(spark):
    s = spark.createDataFrame([(1, "AAA", "2014B", "M", "0-35", "R", "HE Qualification", "0-10%", 60, 1),
                               (1, "BBB", "2014B", "F", "35-55", "R", "HE Qualification", "0-10%", 60, 0)],
                              "id_student long, code_module string, code_presentation string, gender string, "
                              "age_band string, region string, highest_education string, imd_band string, "
                              "studied_credits int, dropout int")
    p = spark.createDataFrame([(1, "tabnet", 1, 0.9, "r"), (2, "tabnet", 0, 0.1, "r")],
                              "id_student long, model_name string, predicted int, probability double, run_id string")
    j = {r.id_student: r for r in rep.predictions_view(p, s).collect()}
    assert j[1].gender == "M" and j[1].dropout == 1      # first enrolment's attributes, MAX label
    assert j[2].gender is None and j[2].dropout is None
    assert len(j) == 2


def test_tie_at_half(spark):
    from cohortlens.operators.score import decision
    df = spark.createDataFrame([(0.5,), (0.49,), (0.51,)], "probability double")
    assert one(df.select(decision("probability", ">=").alias("p")), "p") == [1, 0, 1]
    assert one(df.select(decision("probability", ">").alias("p")), "p") == [0, 0, 1]


def test_student_id_validation(spark):
    df = spark.createDataFrame([("",), (" 123 ",), ("12a",), (None,)], "student_id_text string")
    r = df.select(X.parse_student_id().alias("i"), X.student_id_valid().alias("v")).collect()
    assert [(x.i, x.v) for x in r] == [(None, True), (123, True), (None, False), (None, True)]


def test_group_rates_drop_null_groups(spark):
    j = spark.createDataFrame(
        [("tabnet", 1, "M", None, "R", "HE Qualification", None, 60, 1),
         ("tabnet", 0, "F", None, "R", "HE Qualification", "0-10%", 60, 0)],
        "model_name string, predicted int, gender string, age_band string, region string, "
        "highest_education string, imd_band string, studied_credits int, dropout int")
    j = j.withColumn("probability", F.lit(0.5))
    g = rep.group_rates(j).collect()
    assert not [r for r in g if r.value is None]
    assert {(r.attribute, r.value) for r in g} >= {("gender", "M"), ("imd_band", "0-10%")}
    assert [r for r in g if r.attribute == "age_band"] == []


def test_latest_run_respects_top_window(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"r{i}", "e", "FINISHED", t0 + dt.timedelta(hours=i), "file:///x") for i in range(30)]
    rows.append(("old", "e", "FINISHED", t0 - dt.timedelta(days=1), "server-artifacts:/old"))
    rows.append(("ok", "f", "FINISHED", t0, "server-artifacts:/ok"))
    rows.append(("newer-failed", "f", "FAILED", t0 + dt.timedelta(days=1), "server-artifacts:/n"))
    df = spark.createDataFrame(rows, "run_id string, experiment string, status string, start_time timestamp, artifact_uri string")
    from cohortlens.operators.store import latest_run
    got = {r.experiment: r.run_id for r in latest_run(df).collect()}
    assert got == {"f": "ok"}  # 'e' has 30 newer finished runs without server artifacts


def test_one_hot_keeps_all_seen_categories(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    from cohortlens.operators.encode import one_hot_stages
    fit = spark.createDataFrame([("a",), ("b",), ("c",)], "region string")
    m = Pipeline(stages=one_hot_stages(["region"])).fit(fit)
    new = spark.createDataFrame([("b",), ("zzz",), (None,)], "region string")
    got = [r.v for r in m.transform(new).select(vector_to_array("region_ohe").alias("v")).collect()]
    assert got == [[0.0, 1.0, 0.0], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]]


def test_click_feature_variants_agree(spark, tables):
    from cohortlens.operators.features import KEYS, click_features
    a = {tuple(r[k] for k in KEYS): r for r in click_features(tables.student_vle, 60, distinct="sets").collect()}
    b = {tuple(r[k] for k in KEYS): r for r in click_features(tables.student_vle, 60, distinct="expand").collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k].vle_active_days == b[k].vle_active_days
        assert a[k].vle_unique_resources == b[k].vle_unique_resources
        assert a[k].vle_total_clicks == b[k].vle_total_clicks
        assert abs(a[k].vle_std_clicks - b[k].vle_std_clicks) < 1e-9


def test_click_features_handle_a_hot_enrolment(spark):
    """One enrolment with a third of all rows: exact features, no row dropped."""
    from cohortlens.operators.features import click_features
    rows = [("AAA", "2014B", 1, i % 50, i % 90 - 10, i % 7) for i in range(600)]
    rows += [("BBB", "2014J", k, k, k % 60, 3) for k in range(2, 1202)]
    df = spark.createDataFrame(rows, "code_module string, code_presentation string, id_student long, "
                                     "id_site long, date int, sum_click int")
    hot = click_features(df).where("id_student = 1").first()
    kept = [r for r in rows[:600] if r[4] <= 60]
    assert hot.vle_total_clicks == sum(r[5] for r in kept)
    assert hot.vle_active_days == len({r[4] for r in kept})
    assert hot.vle_unique_resources == len({r[3] for r in kept})


def test_exact_medians_match_builtin(spark):
    """Radix selection against the built-in median: crowded, signed, tiny, huge, missing and few values."""
    import random

    from cohortlens.operators.score import medians, modes
    rng = random.Random(5)
    cols = {"a": lambda i: rng.gauss(0, 1), "b": lambda i: None if i % 3 else rng.choice([-1.5, -0.0, 0.0, 2.0]),
            "c": lambda i: rng.choice([-1, 1]) * 10.0 ** rng.uniform(-308, 308), "d": lambda i: float(i) if i < 2 else None,
            "e": lambda i: None, "f": lambda i: 5e-324 * rng.randint(0, 9), "g": lambda i: float("nan") if i % 2 else i / 7}
    rows = [tuple(f(i) for f in cols.values()) for i in range(501)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).withColumn("n", F.col("a").cast("int")).repartition(3)
    got = medians(df, [*cols, "n"])
    for j, c in enumerate(cols):
        want = sorted(r[j] for r in rows if r[j] is not None and r[j] == r[j])
        if want:
            low, high = want[(len(want) - 1) // 2], want[len(want) // 2]
            assert got[c] == (low if low == high else low + (high - low) * 0.5), c
        else:
            assert got[c] is None
    assert got["n"] == df.agg(F.median("n")).first()[0]
    assert medians(df.limit(0), ["a", "n"]) == {"a": None, "n": None} and medians(df, []) == {}
    texts = spark.createDataFrame([("x", None), ("y", "b"), ("x", "a"), (None, "b"), ("y", "a")], "s string, t string")
    assert modes(texts, ["s", "t"]) == {"s": "x", "t": "a"} and modes(texts.limit(0), ["s"]) == {"s": None}


def test_order_codes_keep_the_order_and_the_value(spark):
    import math

    from cohortlens.operators.score import coded_value, with_order_code
    values = sorted({s * v for e in range(-1074, 1024) for s in (1.0, -1.0)
                     for v in (math.ldexp(1.0, e), math.nextafter(math.ldexp(1.0, e), 0), math.nextafter(math.ldexp(1.0, e), math.inf))})
    df = spark.createDataFrame([(v,) for v in [*values, math.inf, -math.inf]], "x double")
    got = {r.x: r.c for r in with_order_code(df, "x", "c").collect()}
    codes = [got[v] for v in [-math.inf, *values, math.inf]]
    assert all(a < b for a, b in zip(codes, codes[1:]))
    assert all(coded_value(got[v]) == v for v in got)



def _csv(tmp_path, name, text):
    (tmp_path / name).mkdir()
    (tmp_path / name / "part-0.csv").write_text(text)
    return str(tmp_path / name)


def test_csv_reader_takes_columns_by_name_and_maps_missing_tokens(spark, tmp_path):
    from cohortlens import schemas as S
    from cohortlens.sources.readers import csv_rejects, scan_sites
    path = _csv(tmp_path, "sites", "week_to,extra,code_presentation,id_site,activity_type,code_module,week_from\n"
                                   "3,x,NA,1,resource,AAA,\n2,y,2014J,2,n/a,NULL,NA\n5,z,2014B,3,quiz,BBB, 4\nsix,,2014B,4,quiz,BBB,nan\n")
    rows = sorted(scan_sites(spark, path).collect())
    assert [r.id_site for r in rows] == [1, 2, 3, 4] and rows[0].code_module == "AAA" and rows[2].code_presentation == "2014B"
    assert rows[0].code_presentation is None and rows[0].week_from is None and rows[0].week_to == 3
    assert rows[1].code_module is None and rows[1].activity_type is None and rows[1].week_from is None
    assert rows[2].week_from == 4 and rows[3].week_to is None and rows[3].week_from is None
    rejects = {r.column_name: r.rejected for r in csv_rejects(spark, path, S.VLE_SCHEMA).collect()}
    assert rejects["week_to"] == 1 and sum(rejects.values()) == 1
    with pytest.raises(ValueError, match="no column named"):
        scan_sites(spark, _csv(tmp_path, "short", "id_site\n1\n"))


def test_ingest_of_the_three_files(spark, tables, tmp_path):
    from cohortlens.sources.readers import ingest_tables, scan_early_clicks
    raw = tables.raw_students.drop("enrol_key")
    raw.select(*reversed(raw.columns)).write.option("header", True).csv(str(tmp_path / "e"))
    tables.vle.write.option("header", True).csv(str(tmp_path / "s"))
    tables.student_vle.write.option("header", True).csv(str(tmp_path / "c"))
    out = str(tmp_path / "out")
    checks = {r.table_name: r for r in ingest_tables(spark, *(str(tmp_path / x) for x in "esc"), out).collect()}
    assert checks["students"].n_rows == tables.students.count() and checks["studentVle"].n_rows == tables.student_vle.count()
    assert checks["students"].n_dropout == tables.students.where("dropout = 1").count()
    keys = spark.read.parquet(f"{out}/students").select("enrol_key", "id_student", "code_module", "code_presentation").distinct()
    assert keys.select("enrol_key").distinct().count() == keys.count()
    early = scan_early_clicks(spark, f"{out}/studentVle")
    assert early.count() == tables.student_vle.where("date <= 60").count()
    text = early._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day_band" in text and "day_band#" in text


def test_student_ids(spark):
    from cohortlens.functions import expressions as X
    rows = [("12\t", 12, True), (" 7 ", 7, True), ("", None, True), (" \n ", None, True), (None, None, True),
            ("12a", None, False), ("9" * 20, None, False), ("-3", None, False), (str(2**63 - 1), 2**63 - 1, True)]
    df = spark.createDataFrame(rows, "student_id_text string, want long, ok boolean")
    got = df.select("want", "ok", X.parse_student_id().alias("id"), X.student_id_valid().alias("valid")).collect()
    assert all(r.id == r.want and r.valid == r.ok for r in got)


def test_requests_with_unknown_categories_are_rejected(spark):
    from cohortlens.operators.score import complete_requests
    req = spark.createDataFrame([(1, "5", "R1"), (2, "6", "Atlantis"), (3, "x", None)], "request_id long, student_id_text string, region string")
    d = spark.createDataFrame([("R2",)], "region string")
    got = {r.request_id: r for r in complete_requests(req, d, ["region"], None, {"region": ["R1", "R2"]}).collect()}
    assert (got[1].accepted, got[1].reject_reason) == (True, None)
    assert (got[2].accepted, got[2].reject_reason) == (False, "unknown category")
    assert (got[3].accepted, got[3].reject_reason, got[3].region) == (False, "student id", "R2")


def test_folds_are_stratified_by_label(spark):
    from cohortlens.operators.split import assign_folds
    df = spark.createDataFrame([(i, None if i % 11 == 0 else int(i % 5 == 0)) for i in range(1000)], "k long, y int")
    for r in assign_folds(df, "k", "y", 4).groupBy("y").pivot("fold", [0, 1, 2, 3]).count().collect():
        sizes = [r[str(j)] for j in range(4)]
        assert max(sizes) - min(sizes) <= 1


def test_null_student_ids_bypass_the_join(spark):
    s = spark.createDataFrame([(1, "AAA", "2014B", "M", "0-35", "R", "HE Qualification", "0-10%", 60, 1)],
                              "id_student long, code_module string, code_presentation string, gender string, "
                              "age_band string, region string, highest_education string, imd_band string, "
                              "studied_credits int, dropout int")
    p = spark.createDataFrame([(None, "tabnet", 1, 0.9, "r")] * 5 + [(1, "tabnet", 0, 0.1, "r")],
                              "id_student long, model_name string, predicted int, probability double, run_id string")
    rows = rep.predictions_view(p, s).collect()
    assert len(rows) == 6
    assert sum(1 for r in rows if r.id_student is None and r.gender is None) == 5
    assert [r.gender for r in rows if r.id_student == 1] == ["M"]


def test_registered_views_answer_sql(spark, tables):
    tables.register_views()
    n = spark.sql("SELECT count(*) AS n FROM predictions p JOIN students s ON p.id_student = s.id_student").first().n
    assert n > 0
    assert spark.sql("SELECT count(*) AS n FROM studentVle WHERE date <= 60").first().n == \
        tables.student_vle.where("date <= 60").count()


def test_auc_with_crowded_and_extreme_scores(spark):
    import random
    rnd = random.Random(11)
    pool = [0.0, 1.0, 1e-12, 2e-12, 0.5, 1 - 1e-12] + [rnd.random() * 1e-9 for _ in range(50)]
    rows = [(rnd.choice(pool), rnd.randint(0, 1)) for _ in range(600)]
    df = spark.createDataFrame([("m", p, y) for p, y in rows], "g string, probability double, label int")
    pos = [p for p, y in rows if y == 1]
    neg = [p for p, y in rows if y == 0]
    brute = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg) / (len(pos) * len(neg))
    assert ev.exact_auc(df, ["g"]).first().auc == pytest.approx(brute, abs=1e-12)


def test_auc_where_all_scores_crowd_at_an_end(spark):
    """All scores beyond a logit of 40, over many ranges, with groups that lie in one range or have one class."""
    import random
    rnd = random.Random(2)
    rows = [("a", 1e-20 * rnd.randint(1, 300), rnd.randint(0, 1)) for _ in range(900)]
    rows += [("b", 1 - 2.0 ** -53 * rnd.randint(0, 3), rnd.randint(0, 1)) for _ in range(80)] + [("c", 0.5, 1), (None, 0.1, 0), (None, 0.2, 1)]
    df = spark.createDataFrame(rows, "g string, probability double, label int").repartition(5)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.g: r.auc for r in ev.exact_auc(df, ["g"]).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    for g in ("a", "b", None):
        pos, neg = ([p for k, p, y in rows if k == g and y == c] for c in (1, 0))
        brute = sum((1.0 if x > z else 0.5 if x == z else 0.0) for x in pos for z in neg) / (len(pos) * len(neg))
        assert got[g] == pytest.approx(brute, abs=1e-12)
    assert got["c"] is None
    assert ev.exact_auc(df.where("false"), ["g"]).count() == 0


def test_prediction_reports_equal_the_single_reports(spark, tables):
    bundle = rep.prediction_reports(tables.predictions, tables.students)
    j = rep.predictions_view(tables.predictions, tables.students)
    single = {"model_kpis": rep.model_kpis(j), "group_rates": rep.group_rates(j),
              "prob_histogram": rep.prob_histogram(j), "model_scores": ev.model_scores(j)}
    for k, df in single.items():
        a, b = bundle[k], df
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0, k


def test_names_and_codes_without_case(spark):
    from cohortlens.functions.collation import ignore_case, same_name
    from cohortlens.operators import store as st
    from cohortlens.operators.features import KEYS, click_features, join_features
    from cohortlens.session import scratch_path
    clicks = spark.createDataFrame([("AAA", "2014B", 1, 5, 3, 2), ("aaa", "2014b", 1, 6, 4, 3), ("BBB", "2014B", 1, 6, 4, 9)],
                                   "code_module string, code_presentation string, id_student long, id_site long, date int, sum_click int")
    assert click_features(clicks).count() == 3
    folded = click_features(ignore_case(clicks))
    assert sorted(r.vle_total_clicks for r in folded.collect()) == [5.0, 9.0]
    enrolled = spark.createDataFrame([("Aaa", "2014B", 1, 0), ("ÄÄÄ", "2014B", 1, 0)], "code_module string, code_presentation string, id_student long, dropout int")
    got = {r.code_module: r.vle_total_clicks for r in join_features(ignore_case(enrolled), folded.select(*KEYS, *S.VLE_COLS)).collect()}
    assert got == {"Aaa": 5.0, "ÄÄÄ": 0.0}
    names = spark.createDataFrame([("xgboost",), ("XGBoost",), ("other",), (None,)], "model_name string")
    assert names.where(same_name(names.model_name, ["XGBoost"], True)).count() == 2
    assert names.where(same_name(names.model_name, ["XGBoost"], False)).count() == 1
    pred, live = scratch_path(spark, "nc-pred"), scratch_path(spark, "nc-live")
    st.sink_replace_model(spark.createDataFrame([(i, n, 1, 0.5, "r") for i, n in enumerate(["XGBOOST", "xgboost", "tabnet"])], S.PREDICTIONS_SCHEMA), pred)
    assert tuple(st.move_live(spark, pred, live, ["XGBoost"]).first()) == (0, 0, 0)
    assert tuple(st.move_live(spark, pred, live, ["XGBoost"], without_case=True).first()) == (2, 2, 2)
    assert sorted(r.model_name for r in st.read_live(spark, live).collect()) == ["XGBOOST", "xgboost"]
    assert [r.model_name for r in st.read_predictions(spark, pred).collect()] == ["tabnet"]


def test_a_profile_reads_its_frame_once(spark, monkeypatch):
    """Medians and modes come from one table of counts by value, whatever the frame is derived from."""
    from cohortlens.operators import score as sc
    df = spark.createDataFrame([(float(i % 5), i, "b" if i % 3 else "a") for i in range(30)], "a double, n int, s string")
    seen, plain = [], sc.value_counts
    monkeypatch.setattr(sc, "value_counts", lambda d, num, other: (seen.append((num, other)), plain(d, num, other))[1])
    row = sc.defaults_profile(df, ["s", "a", "n"]).first()
    assert seen == [(["a", "n"], ["s"])] and (row.s, row.a, row.n) == ("b", 2.0, 14.5)
    assert sc.value_counts(df, ["a"], []).count() == 5


def test_a_frame_that_many_passes_read_is_derived_once(spark, tables):
    """Fits and request queries read a written copy, so the join behind it runs once."""
    from cohortlens.operators import cluster as clu
    from cohortlens.plans.queries import _landed
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    rows = tables.students.select("id_student", "avg_score", "active_days", "total_clicks", "dropout").limit(200).repartition(2)
    clu.clusters_table(rows.mapInArrow(counted, rows.schema)).count()
    assert runs.value == 200
    t = _landed(spark, tables.sf_dir, "students")
    for df in (t.students, t.requests):
        assert "lineitem" not in " ".join(df.inputFiles()) and "students" in df.inputFiles()[0]


def test_distances_on_the_grid_are_exact():
    import numpy as np
    from cohortlens.operators.cluster import GRID, squared
    rng = np.random.default_rng(3)
    p, c = rng.integers(0, GRID + 1, (300, 3)), rng.integers(0, GRID + 1, (40, 3))
    p[0], c[0] = GRID, 0
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in c] for x in p]
    assert squared(p, c).astype(np.int64).tolist() == want
