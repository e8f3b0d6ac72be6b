"""The registered queries, one per operator of the survey inventory (§2).

Every query reads the given tables (or tables Spark derives from them) in
full. Where an operator has an exact SQL equivalent, its DuckDB oracle is
registered next to it; model-fitting operators have none (rows-only check).
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlens import functions as X
from cohortlens import schemas as S
from cohortlens.operators import cleaning, click_states as cst, cluster as clu, encode as enc, evaluate as ev
from cohortlens.operators import features as feat
from cohortlens.operators import report as rep, score as sc, split as sp, store as st, train as tr
from cohortlens.functions.collation import ignore_case
from cohortlens.operators.boosting import prepared_rows, search_scores
from cohortlens.operators.tree_model import load_model
from cohortlens.plans import sqlgen as G
from cohortlens.plans.registry import query
from cohortlens.session import scratch_path
from cohortlens.sources import Tables
from cohortlens.sources import readers

STUDENT_COLS_SQL = ", ".join(S.STUDENT_COLS)
VLE_AGG_SQL = """
SELECT id_student, code_module, code_presentation,
 CAST(SUM(sum_click) AS DOUBLE) AS vle_total_clicks,
 CAST(COUNT(DISTINCT date) AS DOUBLE) AS vle_active_days,
 CAST(COUNT(DISTINCT id_site) AS DOUBLE) AS vle_unique_resources,
 AVG(sum_click) AS vle_avg_clicks_per_day,
 CAST(MAX(sum_click) AS DOUBLE) AS vle_max_clicks,
 COALESCE(STDDEV_POP(sum_click), 0) AS vle_std_clicks
FROM studentVle WHERE date <= 60
GROUP BY id_student, code_module, code_presentation"""
STATIC_COLS = [c for c in S.STUDENT_COLS if c not in S.LEAKAGE_COLS]
JOIN_FEATURES_SQL = "SELECT {s}, {v} FROM students s LEFT JOIN vf USING (id_student, code_module, code_presentation)".format(
    s=", ".join(f"s.{c}" for c in STATIC_COLS) + ", s.enrol_key",
    v=", ".join(f"coalesce(vf.{c}, 0) AS {c}" for c in S.VLE_COLS))


# --------------------------------------------------------------- 2.1 sources
@query("scan_table", "S4", f"SELECT {STUDENT_COLS_SQL} FROM students", ("students",))
def q_scan_table(spark, sf_dir):
    return Tables(spark, sf_dir).students.select(*S.STUDENT_COLS)


@query("scan_pruned", "S5",
       "SELECT id_student, avg_score, active_days, total_clicks, dropout FROM students", ("students",))
def q_scan_pruned(spark, sf_dir):
    return readers.scan_pruned(Tables(spark, sf_dir).students)


# --------------------------------------------------------------- 2.2 filters
@query("filter_cutoff", "F4", "SELECT * FROM studentVle WHERE date <= 60", ("studentVle",))
def q_filter_cutoff(spark, sf_dir):
    return feat.filter_cutoff(Tables(spark, sf_dir).student_vle, 60)


# --------------------------------------------------------- 2.4 click features
@query("click_features", "A2", VLE_AGG_SQL, ("studentVle",))
def q_click_features(spark, sf_dir):
    return feat.click_features(Tables(spark, sf_dir).student_vle, 60)


_CUTOFFS = [-5, 14, 29, 60, 200]


@query("click_states", "A2", " UNION ALL ".join(
    f"SELECT {c} AS cutoff_day, x.* FROM ({VLE_AGG_SQL.replace('date <= 60', f'date <= {c}')}) x" for c in _CUTOFFS), ("studentVle",))
def q_click_states(spark, sf_dir):
    """Click features at five cutoffs from one table of states by day band."""
    clicks = _landed(spark, sf_dir, "student_vle").student_vle
    states = cst.write_states(clicks)
    out = [cst.features_at(states, clicks, c).select(F.lit(c).alias("cutoff_day"), "*") for c in _CUTOFFS]
    return reduce(lambda a, b: a.unionByName(b), out)


@query("early_frame_states", "I4", JOIN_FEATURES_SQL, ("students", "studentVle"), extra={"vf": VLE_AGG_SQL})
def q_early_frame_states(spark, sf_dir):
    """The early frame at the reference's cutoff, from states by day band."""
    t = Tables(spark, sf_dir)
    return cst.early_frame_at(t.students, cst.write_states(t.student_vle), t.student_vle)


@query("join_features", "J3", JOIN_FEATURES_SQL, ("students", "studentVle"), extra={"vf": VLE_AGG_SQL})
def q_join_features(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return feat.join_features(t.students, feat.click_features(t.student_vle, 60))


# ----------------------------------------------------------------------------
# 2.2 projection / filter / scalar expressions
# ----------------------------------------------------------------------------


def _t(spark, sf_dir):
    return Tables(spark, sf_dir)


def _landed(spark, sf_dir, *names):
    """Tables of which the named ones are written once, for queries that read them in several passes."""
    return _t(spark, sf_dir).materialize(names)


@query("derive_label", "F1",
       "SELECT enrol_key, final_result, CASE WHEN final_result = 'Withdrawn' THEN 1 ELSE 0 END AS dropout "
       "FROM raw_students", ("raw_students",))
def q_derive_label(spark, sf_dir):
    r = _t(spark, sf_dir).raw_students
    return r.select("enrol_key", "final_result", X.derive_label().alias("dropout"))


@query("project_students", "F2",
       "SELECT {c}, CASE WHEN final_result = 'Withdrawn' THEN 1 ELSE 0 END AS dropout FROM raw_students".format(
           c=", ".join(c for c in S.STUDENT_COLS if c != "dropout")), ("raw_students",))
def q_project_students(spark, sf_dir):
    return cleaning.project_students(_t(spark, sf_dir).raw_students)


@query("clean_bands", "F3",
       "SELECT enrol_key, imd_band AS raw_imd_band, "
       "CASE imd_band WHEN '10-20' THEN '10-20%' WHEN '0' THEN NULL ELSE imd_band END AS imd_band, "
       "CASE highest_education WHEN 'No Formal quals' THEN 'No Formal Quals' ELSE highest_education END "
       "AS highest_education FROM raw_students", ("raw_students",))
def q_clean_bands(spark, sf_dir):
    r = _t(spark, sf_dir).raw_students
    return r.select("enrol_key", F.col("imd_band").alias("raw_imd_band"),
                    X.clean_imd_band().alias("imd_band"), X.clean_education().alias("highest_education"))


@query("drop_leakage", "F5",
       "SELECT {c}, enrol_key FROM students".format(c=", ".join(STATIC_COLS)), ("students",))
def q_drop_leakage(spark, sf_dir):
    return feat.drop_leakage(_t(spark, sf_dir).students)


@query("fill_zero", "F6",
       "SELECT s.enrol_key, {v} FROM students s LEFT JOIN vf USING (id_student, code_module, code_presentation)".format(
           v=", ".join(f"coalesce(vf.{c}, 0) AS {c}" for c in S.VLE_COLS)),
       ("students", "studentVle"), extra={"vf": VLE_AGG_SQL})
def q_fill_zero(spark, sf_dir):
    t = _t(spark, sf_dir)
    j = t.students.select("enrol_key", *feat.KEYS).join(feat.click_features(t.student_vle), feat.KEYS, "left")
    return feat.fill_zero(j).select("enrol_key", *S.VLE_COLS)


@query("map_binary", "F7",
       "SELECT enrol_key, CASE gender WHEN 'M' THEN 1 WHEN 'F' THEN 0 END AS gender, "
       "CASE disability WHEN 'Y' THEN 1 WHEN 'N' THEN 0 END AS disability FROM students", ("students",))
def q_map_binary(spark, sf_dir):
    return enc.map_binaries(_t(spark, sf_dir).students).select("enrol_key", "gender", "disability")


@query("fill_imd_default", "F8",
       f"SELECT enrol_key, coalesce(imd_band, '{S.DEFAULT_IMD}') AS imd_band FROM students", ("students",))
def q_fill_imd_default(spark, sf_dir):
    return _t(spark, sf_dir).students.select("enrol_key", X.fill_imd_default().alias("imd_band"))


@query("normalize_model_name", "F9",
       f"SELECT DISTINCT model_name, {G.normalize_model_sql()} AS display_model FROM predictions", ("predictions",))
def q_normalize_model_name(spark, sf_dir):
    p = _t(spark, sf_dir).predictions
    return p.select("model_name").distinct().select("model_name", X.normalize_model_name().alias("display_model"))


@query("filter_model", "F10", "SELECT * EXCLUDE (display_model) FROM dj WHERE display_model = 'XGBoost'", ("dj",))
def q_filter_model(spark, sf_dir):
    t = _t(spark, sf_dir)
    j = rep.predictions_view(t.predictions, t.students)
    return rep.with_display_model(j).where(F.col("display_model") == "XGBoost").drop("display_model")


@query("display_values", "F11",
       "SELECT enrol_key, {c} FROM students".format(c=", ".join(
           f"{G.display_sql(a, a)} AS {a}" for a in S.GROUP_ATTRIBUTES)), ("students",))
def q_display_values(spark, sf_dir):
    s = _t(spark, sf_dir).students
    return s.select("enrol_key", *[X.display_value(a).alias(a) for a in S.GROUP_ATTRIBUTES])


@query("label_clusters", "F12",
       f"SELECT id_student, cluster_id, {G.cluster_label_sql()} AS cluster FROM clusters", ("clusters",))
def q_label_clusters(spark, sf_dir):
    c = _t(spark, sf_dir).clusters
    return c.select("id_student", "cluster_id", X.cluster_label().alias("cluster"))


@query("risk_badge", "F13", f"SELECT cluster, dropout_rate, {G.risk_sql('dropout_rate')} AS risk FROM csum",
       ("csum",))
def q_risk_badge(spark, sf_dir):
    t = _t(spark, sf_dir)
    s = rep.cluster_summary(rep.clusters_view(t.clusters, t.students))
    return s.select("cluster", "dropout_rate", X.risk_badge("dropout_rate").alias("risk"))


def _profile_sql():
    hi, mid, lo = S.LEVEL_LABELS
    return f"""
SELECT cluster, n_students, dropout_rate,
 CASE WHEN active_days < q_active * {S.ENGAGEMENT_LOW_FACTOR} OR total_clicks < q_clicks * {S.ENGAGEMENT_LOW_FACTOR} THEN '{lo}'
      WHEN active_days >= q_active AND total_clicks >= q_clicks THEN '{hi}' ELSE '{mid}' END AS engagement,
 CASE WHEN avg_score < q_score * {S.ACHIEVEMENT_LOW_FACTOR} THEN '{lo}' WHEN avg_score >= q_score THEN '{hi}'
      ELSE '{mid}' END AS achievement,
 {G.risk_sql('dropout_rate')} AS risk
FROM csum, (SELECT quantile_cont(avg_score, 0.5) AS q_score, quantile_cont(active_days, 0.5) AS q_active,
                   quantile_cont(total_clicks, 0.5) AS q_clicks FROM csum) q"""


@query("profile_text", "F14", _profile_sql(), ("csum",))
def q_profile_text(spark, sf_dir):
    t = _t(spark, sf_dir)
    return rep.cluster_profiles(rep.cluster_summary(rep.clusters_view(t.clusters, t.students)))


@query("validate_student_id", "F15",
       "SELECT request_id, student_id_text, "
       "CASE WHEN regexp_full_match(trim(student_id_text), '[0-9]+') THEN TRY_CAST(trim(student_id_text) AS BIGINT) END "
       "AS id_student, coalesce(trim(student_id_text) = '' OR (regexp_full_match(trim(student_id_text), '[0-9]+') "
       "AND TRY_CAST(trim(student_id_text) AS BIGINT) IS NOT NULL), true) AS id_valid FROM requests", ("requests",))
def q_validate_student_id(spark, sf_dir):
    r = _t(spark, sf_dir).requests
    return r.select("request_id", "student_id_text", X.parse_student_id().alias("id_student"),
                    X.student_id_valid().alias("id_valid"))


def _bounds_sql(bounds):
    checks = " + ".join(f"CASE WHEN {c} IS NOT NULL AND NOT ({c} BETWEEN {lo} AND {hi}) THEN 1 ELSE 0 END"
                        for c, (lo, hi) in bounds.items())
    return f"SELECT request_id, CAST({checks} AS INTEGER) AS n_out_of_range, ({checks}) = 0 AS in_range FROM requests"


@query("validate_ranges", "F16", _bounds_sql(S.REQUEST_BOUNDS_FULL), ("requests",))
def q_validate_ranges(spark, sf_dir):
    from cohortlens.operators.score import validate_ranges
    return validate_ranges(_t(spark, sf_dir).requests, S.REQUEST_BOUNDS_FULL).select(
        "request_id", "n_out_of_range", "in_range")


@query("rounding", "F17",
       "SELECT enrol_key, round_even(avg_score, 1) AS avg_score, round_even(total_weight / 7e0, 1) AS weight_7 "
       "FROM students", ("students",))
def q_rounding(spark, sf_dir):
    s = _t(spark, sf_dir).students
    return s.select("enrol_key", X.round1("avg_score").alias("avg_score"),
                    X.round1(F.col("total_weight") / F.lit(7.0)).alias("weight_7"))


# ----------------------------------------------------------------------------
# 2.3 joins, 2.4 aggregations, 2.5 sorts / top-k
# ----------------------------------------------------------------------------


def _pj(spark, sf_dir):
    t = _t(spark, sf_dir)
    return rep.predictions_view(t.predictions, t.students)


def _cj(spark, sf_dir):
    t = _t(spark, sf_dir)
    return rep.clusters_view(t.clusters, t.students)


@query("join_predictions_students", "J1", "SELECT * FROM pj", ("pj",))
def q_join_predictions_students(spark, sf_dir):
    return _pj(spark, sf_dir)


@query("join_clusters_students", "J2", "SELECT * FROM cj", ("cj",))
def q_join_clusters_students(spark, sf_dir):
    return _cj(spark, sf_dir)


@query("map_back_cluster_rate", "J4", "SELECT id_student, cluster_id, dropout_rate FROM clusters", ("clusters",))
def q_map_back_cluster_rate(spark, sf_dir):
    return _t(spark, sf_dir).clusters


@query("lookup_first", "J5", """
SELECT r.request_id, s.id_student, s.code_module, s.code_presentation, s.dropout FROM
 (SELECT request_id, CAST(trim(student_id_text) AS BIGINT) AS id_student FROM requests
  WHERE regexp_full_match(trim(student_id_text), '[0-9]+')) r
 JOIN (SELECT * FROM (SELECT id_student, code_module, code_presentation, dropout, row_number() OVER
   (PARTITION BY id_student ORDER BY code_module, code_presentation) AS rn FROM students) x WHERE rn = 1) s
 ON r.id_student = s.id_student""", ("requests", "students"))
def q_lookup_first(spark, sf_dir):
    from cohortlens.operators.report import lookup_first
    t = _t(spark, sf_dir)
    ids = t.requests.select("request_id", X.parse_student_id().alias("id_student")).where(
        F.col("id_student").isNotNull())
    return lookup_first(t.students, ids)


@query("dedup_students", "A1", "SELECT * FROM dedup_pred", ("dedup_pred",))
def q_dedup_students(spark, sf_dir):
    return rep.dedup_students(_t(spark, sf_dir).students)


@query("model_kpis", "A3", """
SELECT display_model, n_rows, predicted_dropout, CAST(predicted_dropout AS DOUBLE) / n_rows * 100 AS predicted_pct,
 actual_dropout, CAST(actual_dropout AS DOUBLE) / n_rows * 100 AS actual_pct, avg_probability FROM (
 SELECT display_model, count(*) AS n_rows, CAST(coalesce(sum(predicted), 0) AS BIGINT) AS predicted_dropout,
  CAST(coalesce(sum(dropout), 0) AS BIGINT) AS actual_dropout, avg(probability) AS avg_probability
 FROM dj GROUP BY display_model) x""", ("dj",))
def q_model_kpis(spark, sf_dir):
    return rep.model_kpis(_pj(spark, sf_dir))


AUC_SQL = """
SELECT {g}, sum(np * (below + nn / 2e0)) / nullif(CAST(sum(np) AS DOUBLE) * sum(nn), 0) AS auc FROM (
 SELECT *, coalesce(sum(nn) OVER (PARTITION BY {g} ORDER BY {s} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
 FROM (SELECT {g}, {s}, sum(CAST({y} AS BIGINT)) AS np, sum(1 - CAST({y} AS BIGINT)) AS nn FROM {src}
       WHERE {y} IS NOT NULL AND {s} IS NOT NULL GROUP BY {g}, {s}) a) b GROUP BY {g}"""

COUNTS_SQL = """
SELECT {g}, CAST(sum(CASE WHEN {y} = 1 AND {p} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
 CAST(sum(CASE WHEN {y} = 0 AND {p} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
 CAST(sum(CASE WHEN {y} = 1 AND {p} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
 CAST(sum(CASE WHEN {y} = 0 AND {p} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn
FROM {src} WHERE {y} IS NOT NULL AND {p} IS NOT NULL GROUP BY {g}"""


def _f1_sql(tp, fp, fn):
    return f"coalesce(CAST(2 * {tp} AS DOUBLE) / nullif(2 * {tp} + {fp} + {fn}, 0), 0e0)"


@query("model_scores", "A4", """
SELECT c.display_model, round_even({f1}, 4) AS f1, round_even(a.auc, 4) AS auc,
 round_even(CAST(tp + tn AS DOUBLE) / nullif(tp + fp + fn + tn, 0), 4) AS accuracy
FROM c LEFT JOIN a USING (display_model)""".format(f1=_f1_sql("tp", "fp", "fn")), ("dj",),
       extra={"c": COUNTS_SQL.format(g="display_model", y="dropout", p="predicted", src="dj"),
              "a": AUC_SQL.format(g="display_model", s="probability", y="dropout",
                                  src="(SELECT * FROM dj WHERE predicted IS NOT NULL)")})
def q_model_scores(spark, sf_dir):
    return ev.model_scores(_pj(spark, sf_dir))


@query("exact_auc", "A5", AUC_SQL.format(g="model_name", s="probability", y="dropout", src="pj"), ("pj",))
def q_exact_auc(spark, sf_dir):
    return ev.exact_auc(_pj(spark, sf_dir), ["model_name"], "probability", "dropout")


@query("holdout_metrics", "A6", """
SELECT c.model_name, CAST(tp + tn AS DOUBLE) / nullif(tp + fp + fn + tn, 0) AS accuracy, {f1} AS f1,
 coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0e0) AS precision,
 coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0e0) AS recall, tp + fp + fn + tn AS n_rows, a.auc
FROM c LEFT JOIN a USING (model_name)""".format(f1=_f1_sql("tp", "fp", "fn")), ("pj",),
       extra={"c": COUNTS_SQL.format(g="model_name", y="dropout", p="predicted", src="pj"),
              "a": AUC_SQL.format(g="model_name", s="probability", y="dropout",
                                  src="(SELECT * FROM pj WHERE predicted IS NOT NULL)")})
def q_holdout_metrics(spark, sf_dir):
    return ev.holdout_metrics(_pj(spark, sf_dir), ["model_name"], label="dropout")


@query("confusion_matrix", "A7", """
SELECT model_name, actual, predicted, n_rows FROM (
 SELECT model_name, 0 AS actual, 0 AS predicted, tn AS n_rows FROM c UNION ALL
 SELECT model_name, 0, 1, fp FROM c UNION ALL SELECT model_name, 1, 0, fn FROM c UNION ALL
 SELECT model_name, 1, 1, tp FROM c) x""", ("pj",),
       extra={"c": COUNTS_SQL.format(g="model_name", y="dropout", p="predicted", src="pj")})
def q_confusion_matrix(spark, sf_dir):
    return ev.confusion_matrix(_pj(spark, sf_dir), ["model_name"], label="dropout")


def _report_sql():
    z = lambda e: f"coalesce({e}, 0e0)"
    d = lambda a, b: f"CAST({a} AS DOUBLE) / nullif({b}, 0)"
    p1, r1, p0, r0 = z(d("tp", "tp + fp")), z(d("tp", "tp + fn")), z(d("tn", "tn + fn")), z(d("tn", "tn + fp"))
    f1, f0 = _f1_sql("tp", "fp", "fn"), _f1_sql("tn", "fn", "fp")
    s0, s1, n = "(tn + fp)", "(tp + fn)", "(tn + fp + tp + fn)"
    w = lambda a, b: z(f"({a} * {s0} + {b} * {s1}) / nullif({n}, 0)")
    acc = z(d("tp + tn", n))
    rows = [("'0'", p0, r0, f0, s0), ("'1'", p1, r1, f1, s1), ("'accuracy'", acc, acc, acc, n),
            ("'macro avg'", f"({p0} + {p1}) / 2", f"({r0} + {r1}) / 2", f"({f0} + {f1}) / 2", n),
            ("'weighted avg'", w(p0, p1), w(r0, r1), w(f0, f1), n)]
    return " UNION ALL ".join(
        f"SELECT model_name, {c} AS class, {p} AS precision, {r} AS recall, {f} AS f1, CAST({s} AS BIGINT) AS support FROM c"
        for c, p, r, f, s in rows)


@query("classification_report", "A8", _report_sql(), ("pj",),
       extra={"c": COUNTS_SQL.format(g="model_name", y="dropout", p="predicted", src="pj")})
def q_classification_report(spark, sf_dir):
    return ev.classification_report(_pj(spark, sf_dir), ["model_name"], label="dropout")


def _group_rates_sql():
    u = " UNION ALL ".join(f"SELECT display_model, predicted, '{a}' AS attribute, CAST({a} AS VARCHAR) AS value FROM dj"
                           for a in S.GROUP_ATTRIBUTES)
    return f"""
SELECT display_model, attribute, value, {G.display_dynamic_sql('attribute', 'value')} AS display_value,
 predicted_dropout, n_students, round_even(CAST(predicted_dropout AS DOUBLE) / n_students * 100, 1) AS rate_pct
FROM (SELECT display_model, attribute, value, CAST(coalesce(sum(predicted), 0) AS BIGINT) AS predicted_dropout,
       count(predicted) AS n_students FROM ({u}) x WHERE value IS NOT NULL GROUP BY 1, 2, 3) g"""


@query("group_rates", "A9", _group_rates_sql(), ("dj",))
def q_group_rates(spark, sf_dir):
    return rep.group_rates(_pj(spark, sf_dir))


@query("cluster_summary", "A10", "SELECT * FROM csum", ("csum",))
def q_cluster_summary(spark, sf_dir):
    return rep.cluster_summary(_cj(spark, sf_dir))


@query("cluster_kpis", "A11", """
SELECT CAST(sum(n_students) AS BIGINT) AS total_students, count(*) AS n_clusters, avg(dropout_rate) AS avg_dropout_rate,
 first(cluster ORDER BY n_students DESC, cluster) AS largest_cluster,
 first(cluster ORDER BY dropout_rate DESC, cluster) AS riskiest_cluster,
 quantile_cont(avg_score, 0.5) AS median_avg_score, quantile_cont(active_days, 0.5) AS median_active_days,
 quantile_cont(total_clicks, 0.5) AS median_total_clicks FROM csum""", ("csum",))
def q_cluster_kpis(spark, sf_dir):
    return rep.cluster_kpis(rep.cluster_summary(_cj(spark, sf_dir)))


@query("cluster_profile_minmax", "A12", """
SELECT cluster, {c} FROM (SELECT {l} AS cluster, avg(avg_score) AS avg_score, avg(active_days) AS active_days,
 avg(total_clicks) AS total_clicks FROM cj GROUP BY 1) m""".format(
    l=G.cluster_label_sql(),
    c=", ".join(f"coalesce(({f} - min({f}) OVER ()) / nullif(max({f}) OVER () - min({f}) OVER (), 0), 0e0) AS {f}"
                for f in rep.CLUSTER_ATTRS)), ("cj",))
def q_cluster_profile_minmax(spark, sf_dir):
    return rep.profile_minmax(_cj(spark, sf_dir))


@query("cluster_share", "A13", """
SELECT cluster, n_students, n_students / sum(n_students) OVER () AS share FROM (
 SELECT {l} AS cluster, count(id_student) AS n_students FROM cj GROUP BY 1) g""".format(l=G.cluster_label_sql()),
       ("cj",))
def q_cluster_share(spark, sf_dir):
    return rep.cluster_share(_cj(spark, sf_dir))


@query("prob_histogram", "A14", """
SELECT display_model, bin, bin / 20e0 AS bin_start, (bin + 1) / 20e0 AS bin_end, count(*) AS n_rows FROM (
 SELECT display_model, CAST(least(floor(probability * 20), 19) AS INTEGER) AS bin FROM dj
 WHERE probability IS NOT NULL) x GROUP BY 1, 2""", ("dj",))
def q_prob_histogram(spark, sf_dir):
    return rep.prob_histogram(_pj(spark, sf_dir), 20)


@query("predicted_counts", "A15", """
SELECT display_model, predicted, CASE predicted WHEN 0 THEN '{a}' WHEN 1 THEN '{b}' ELSE CAST(predicted AS VARCHAR) END
 AS label, count(*) AS n_students FROM dj WHERE predicted IS NOT NULL GROUP BY 1, 2""".format(
    a=S.PREDICTED_LABELS[0], b=S.PREDICTED_LABELS[1]), ("dj",))
def q_predicted_counts(spark, sf_dir):
    return rep.predicted_counts(_pj(spark, sf_dir))


def _defaults_sql(src_cols, numeric, src="students"):
    parts = []
    for c in src_cols:
        if c in numeric:
            parts.append(f"(SELECT CAST(quantile_cont(CAST({c} AS DOUBLE), 0.5) AS DOUBLE) FROM {src}) AS {c}")
        else:
            parts.append(f"(SELECT {c} FROM {src} WHERE {c} IS NOT NULL GROUP BY {c} "
                         f"ORDER BY count(*) DESC, {c} LIMIT 1) AS {c}")
    return "SELECT " + ", ".join(parts)


_NUMERIC_FULL = {"num_of_prev_attempts", "studied_credits", "module_presentation_length", *S.LEAKAGE_COLS}


@query("defaults_profile", "A16", _defaults_sql(S.FEATURE_COLS, _NUMERIC_FULL), ("students",))
def q_defaults_profile(spark, sf_dir):
    return sc.defaults_profile(_t(spark, sf_dir).students, S.FEATURE_COLS)


_CATEGORICAL = ["code_module", "code_presentation", "gender", "region", "highest_education", "imd_band",
                "age_band", "disability"]


@query("distinct_values", "A17", " UNION ".join(
    f"SELECT DISTINCT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM students WHERE {c} IS NOT NULL"
    for c in _CATEGORICAL), ("students",))
def q_distinct_values(spark, sf_dir):
    return sc.distinct_values(_t(spark, sf_dir).students, _CATEGORICAL)


@query("class_balance", "A18", """
SELECT n_pos, n_neg, CAST(n_neg AS DOUBLE) / greatest(n_pos, 1) AS scale_pos_weight,
 CAST(n_pos + n_neg AS DOUBLE) / nullif(2 * n_neg, 0) AS weight_neg, CAST(n_pos + n_neg AS DOUBLE) / nullif(2 * n_pos, 0) AS weight_pos
FROM (SELECT CAST(sum(CASE WHEN dropout = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_pos,
             CAST(sum(CASE WHEN dropout = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_neg FROM students) c""", ("students",))
def q_class_balance(spark, sf_dir):
    return ev.class_balance(_t(spark, sf_dir).students)


@query("dropout_by_cluster", "A19", """
SELECT cluster_id, avg(CAST(dropout AS DOUBLE)) AS dropout_rate, count(*) AS n_rows FROM cluster_assign GROUP BY 1""",
       ("cluster_assign",))
def q_dropout_by_cluster(spark, sf_dir):
    return rep.dropout_by_cluster(_t(spark, sf_dir).cluster_assign)


_TABNET_CAT = ["region", "code_module", "code_presentation", "highest_education", "imd_band", "age_band"]


@query("cardinalities", "A20", "SELECT {c} FROM (SELECT * REPLACE (coalesce(imd_band, '{d}') AS imd_band) FROM students) s".format(
    c=", ".join(f"CAST(count(DISTINCT {c}) + 1 AS INTEGER) AS {c}" for c in _TABNET_CAT), d=S.DEFAULT_IMD),
       ("students",))
def q_cardinalities(spark, sf_dir):
    s = _t(spark, sf_dir).students.withColumn("imd_band", X.fill_imd_default())
    return sc.cardinalities(s, _TABNET_CAT)


@query("sort_rates", "O1", """
SELECT *, row_number() OVER (PARTITION BY display_model, attribute ORDER BY rate_pct DESC, value) AS rank FROM g""",
       ("dj",), extra={"g": _group_rates_sql()})
def q_sort_rates(spark, sf_dir):
    from cohortlens.operators.report import rank_rates
    return rank_rates(rep.group_rates(_pj(spark, sf_dir)))


@query("latest_run", "O2", """
SELECT experiment, run_id, start_time, artifact_uri FROM (
 SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY rn) AS pick FROM (
  SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY start_time DESC, run_id DESC) AS rn
  FROM runs WHERE status = 'FINISHED') f
 WHERE rn <= 20 AND starts_with(artifact_uri, 'server-artifacts:')) x WHERE pick = 1""", ("runs",))
def q_latest_run(spark, sf_dir):
    from cohortlens.operators.store import latest_run
    return latest_run(_t(spark, sf_dir).runs)


# ----------------------------------------------------------------------------
# 2.1 sources and sinks that write (into the shared checkpoint folder)
# ----------------------------------------------------------------------------

RAW_COLS_SQL = ", ".join(f.name for f in S.RAW_STUDENTS_SCHEMA.fields)
LIVE = list(S.LIVE_MODEL_NAMES)


def _csv_roundtrip(spark, df, name, reader):
    path = scratch_path(spark, name)
    df.write.option("header", True).csv(path)
    return reader(spark, path)


@query("scan_enrolments", "S1", f"SELECT {RAW_COLS_SQL} FROM raw_students", ("raw_students",))
def q_scan_enrolments(spark, sf_dir):
    raw = _t(spark, sf_dir).raw_students.select(*[f.name for f in S.RAW_STUDENTS_SCHEMA.fields])
    return _csv_roundtrip(spark, raw, "enrolments-csv", readers.scan_enrolments)


@query("scan_sites", "S2", "SELECT * FROM vle", ("vle",))
def q_scan_sites(spark, sf_dir):
    return _csv_roundtrip(spark, _t(spark, sf_dir).vle, "sites-csv", readers.scan_sites)


@query("scan_clicks", "S3", "SELECT * FROM studentVle", ("studentVle",))
def q_scan_clicks(spark, sf_dir):
    clicks = _csv_roundtrip(spark, _t(spark, sf_dir).student_vle, "clicks-csv", readers.scan_clicks)
    out = scratch_path(spark, "clicks-parquet")
    readers.ingest_clicks(clicks, out)
    return readers.scan_table(spark, out).select(*S.STUDENT_VLE_SCHEMA.names)


@query("sink_recreate", "K1", f"SELECT {STUDENT_COLS_SQL} FROM students", ("students",))
def q_sink_recreate(spark, sf_dir):
    s = _t(spark, sf_dir).students
    path = scratch_path(spark, "students")
    st.sink_recreate(s.where(F.lit(False)), path, S.STUDENTS_SCHEMA)  # an existing empty table ...
    return st.sink_recreate(s, path, S.STUDENTS_SCHEMA)              # ... is dropped and re-created


@query("sink_create_if_absent", "K2", "SELECT * FROM clusters", ("clusters",))
def q_sink_create_if_absent(spark, sf_dir):
    path = scratch_path(spark, "clusters")
    st.sink_create_if_absent(spark, path, S.CLUSTERS_SCHEMA)
    _t(spark, sf_dir).clusters.write.mode("append").parquet(path)
    return st.sink_create_if_absent(spark, path, S.CLUSTERS_SCHEMA)  # second call keeps the rows


def _rescored(p):
    """The xgboost rows re-scored: same rows, decision rule '>' instead of '>='."""
    return p.where(F.col("model_name") == "xgboost_dropout").withColumn(
        "predicted", F.when(F.col("probability") > 0.5, 1).otherwise(0).cast("int")).withColumn(
        "run_id", F.lit("run-xgboost_dropout-2"))


@query("sink_replace_model", "K3", """
SELECT * FROM predictions WHERE model_name <> 'xgboost_dropout' UNION ALL
SELECT id_student, model_name, CASE WHEN probability > 0.5 THEN 1 ELSE 0 END AS predicted, probability,
 'run-xgboost_dropout-2' AS run_id FROM predictions WHERE model_name = 'xgboost_dropout'""", ("predictions",))
def q_sink_replace_model(spark, sf_dir):
    p = _t(spark, sf_dir).predictions
    path = scratch_path(spark, "predictions")
    st.sink_replace_model(p, path)
    st.sink_replace_model(_rescored(p), path)
    return st.sink_replace_model(_rescored(p), path)                 # idempotent re-run


@query("sink_replace_table", "K4", "SELECT id_student, cluster_id, dropout_rate FROM clusters", ("clusters",))
def q_sink_replace_table(spark, sf_dir):
    t = _t(spark, sf_dir)
    path = scratch_path(spark, "clusters-replace")
    st.sink_recreate(t.cluster_assign, path)                         # older layout, other columns
    return st.sink_recreate(t.clusters, path)


_LIVE_ROWS = f"SELECT id_student, model_name, predicted, probability, run_id FROM predictions WHERE model_name IN {G.list_sql(LIVE)}"


@query("sink_append_live", "K5", f"SELECT *, 2 AS n_batches FROM ({_LIVE_ROWS} UNION ALL {_LIVE_ROWS}) x", ("predictions",))
def q_sink_append_live(spark, sf_dir):
    p = _t(spark, sf_dir).predictions.where(F.col("model_name").isin(list(LIVE)))
    path = scratch_path(spark, "live")
    st.sink_append_live(p, path, "first")
    st.sink_append_live(p, path, "first")                            # written again: replaces its attempt
    live = st.sink_append_live(p, path, "second")
    n = live.select("batch_id").distinct().count()
    return live.dropDuplicates(["id"]).select("id_student", "model_name", "predicted", "probability", "run_id",
                                              F.lit(n).alias("n_batches"))


@query("move_live_rows", "K6", f"""
SELECT CASE WHEN model_name IN {G.list_sql(LIVE)} THEN 'live' ELSE 'predictions' END AS stored_in,
 id_student, model_name, predicted, probability, run_id FROM predictions""", ("predictions",))
def q_move_live_rows(spark, sf_dir):
    pred_path, live_path = scratch_path(spark, "predictions"), scratch_path(spark, "live")
    st.sink_replace_model(_t(spark, sf_dir).predictions, pred_path)
    st.move_live(spark, pred_path, live_path, LIVE)
    st.move_live(spark, pred_path, live_path, LIVE)                  # nothing left to move
    cols = ["id_student", "model_name", "predicted", "probability", "run_id"]
    return (st.read_live(spark, live_path).select(F.lit("live").alias("stored_in"), *cols)
            .unionByName(st.read_predictions(spark, pred_path).select(F.lit("predictions").alias("stored_in"), *cols)))


_MIXED = "CASE id_student % 3 WHEN 0 THEN lower(model_name) WHEN 1 THEN upper(model_name) ELSE model_name END"


@query("move_live_nocase", "K6", f"""
SELECT CASE WHEN lower(model_name) IN {G.list_sql([x.lower() for x in LIVE])} THEN 'live' ELSE 'predictions' END AS stored_in,
 id_student, model_name, predicted, probability, run_id FROM (SELECT * REPLACE ({_MIXED} AS model_name) FROM predictions) p""", ("predictions",))
def q_move_live_nocase(spark, sf_dir):
    """The move over names in mixed case, compared without case."""
    pred_path, live_path = scratch_path(spark, "predictions"), scratch_path(spark, "live")
    st.sink_replace_model(_t(spark, sf_dir).predictions.withColumn("model_name", F.expr(_MIXED)), pred_path)
    st.move_live(spark, pred_path, live_path, LIVE, without_case=True)
    cols = ["id_student", "model_name", "predicted", "probability", "run_id"]
    return (st.read_live(spark, live_path).select(F.lit("live").alias("stored_in"), *cols)
            .unionByName(st.read_predictions(spark, pred_path).select(F.lit("predictions").alias("stored_in"), *cols)))


_MIXED_CODE = "CASE {key} % 3 WHEN 0 THEN lower(code_{c}) ELSE code_{c} END"


@query("early_frame_nocase", "A2", """SELECT s.enrol_key, {v} FROM students s LEFT JOIN vf USING (id_student, code_module, code_presentation)""".format(
    v=", ".join(f"coalesce(vf.{c}, 0) AS {c}" for c in S.VLE_COLS)), ("students", "studentVle"), extra={"vf": VLE_AGG_SQL})
def q_early_frame_nocase(spark, sf_dir):
    """Click features and their join over codes in mixed case, compared without case: as if all were written alike."""
    t = Tables(spark, sf_dir)
    mixed = lambda df, key: ignore_case(df.withColumns(
        {f"code_{c}": F.expr(_MIXED_CODE.format(key=key, c=c)) for c in ("module", "presentation")}))
    frame = feat.early_frame(mixed(t.students, "enrol_key"), mixed(t.student_vle, "id_site"))
    return frame.select("enrol_key", *S.VLE_COLS)


@query("ingest_checks", "K7", """
SELECT 'students' AS table_name, count(*) AS n_rows, CAST(coalesce(sum(dropout), 0) AS BIGINT) AS n_dropout FROM students
UNION ALL SELECT 'vle', count(*), NULL FROM vle UNION ALL SELECT 'studentVle', count(*), NULL FROM studentVle""",
       ("students", "vle", "studentVle"))
def q_ingest_checks(spark, sf_dir):
    t = _t(spark, sf_dir)
    return st.ingest_checks(t.students, t.vle, t.student_vle)


# ----------------------------------------------------------------------------
# 2.6 encoding and splitting
# ----------------------------------------------------------------------------
def _enc_sql(c):
    """SQL of one tree-model feature (F7 / E1 / E2 encodings as in ``tree_stages``)."""
    if c == "gender":
        return "CAST(coalesce(CASE WHEN gender = 'M' THEN 1 WHEN gender = 'F' THEN 0 END, -1) AS DOUBLE)"
    if c == "disability":
        return "CAST(coalesce(CASE WHEN disability = 'Y' THEN 1 WHEN disability = 'N' THEN 0 END, -1) AS DOUBLE)"
    if c in S.ORDINAL_FEATURES:
        return f"CAST({G.ordinal_sql(c, enc.ORDERS[c])} AS DOUBLE)"
    if c in S.NOMINAL_FEATURES:
        return f"CAST(dense_rank() OVER (ORDER BY coalesce(CAST({c} AS VARCHAR), 'None')) - 1 AS DOUBLE)"
    return f"CAST({c} AS DOUBLE)"


def _onehot_sql(c):
    code = f"(dense_rank() OVER (ORDER BY {c}) - 1)"
    return (f"[CASE WHEN {c} IS NOT NULL AND x = {code} THEN 1e0 ELSE 0e0 END "
            f"FOR x IN range((SELECT count(DISTINCT {c}) FROM students))]")


@query("ordinal_encode", "E1", "SELECT enrol_key, {c} FROM students".format(
    c=", ".join(f"{G.ordinal_sql(c, enc.ORDERS[c])} AS {c}" for c in S.ORDINAL_FEATURES)), ("students",))
def q_ordinal_encode(spark, sf_dir):
    return enc.ordinal_encode(_t(spark, sf_dir).students).select("enrol_key", *S.ORDINAL_FEATURES)


@query("label_encode", "E2", "SELECT enrol_key, {c} FROM students".format(
    c=", ".join(f"CAST(dense_rank() OVER (ORDER BY coalesce({c}, 'None')) - 1 AS INTEGER) AS {c}"
                for c in S.NOMINAL_FEATURES)), ("students",))
def q_label_encode(spark, sf_dir):
    return enc.label_encode(_t(spark, sf_dir).students).select("enrol_key", *S.NOMINAL_FEATURES)


@query("one_hot", "E3", "SELECT enrol_key, {c} FROM students".format(
    c=", ".join(f"{_onehot_sql(c)} AS {c}" for c in S.NOMINAL_FEATURES)), ("students",))
def q_one_hot(spark, sf_dir):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    s = _t(spark, sf_dir).students
    m = Pipeline(stages=enc.one_hot_stages()).fit(s)
    return m.transform(s).select("enrol_key", *[vector_to_array(c + "_ohe").alias(c) for c in S.NOMINAL_FEATURES])


def _md5_hash_sql(key, seed):
    return f"CAST(('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{seed}'), 1, 8)) AS BIGINT)"


@query("stratified_split", "E4", f"""
SELECT enrol_key, dropout, rn <= ceil(cnt * 0.2) AS is_test FROM (
 SELECT enrol_key, dropout, row_number() OVER (PARTITION BY dropout ORDER BY {_md5_hash_sql('enrol_key', 42)}, enrol_key) AS rn,
  count(*) OVER (PARTITION BY dropout) AS cnt FROM students) x""", ("students",))
def q_stratified_split(spark, sf_dir):
    s = _t(spark, sf_dir).students.select("enrol_key", "dropout")
    return sp.stratified_split(s, "enrol_key", "dropout", 0.2, 42, exact=True)


@query("stratified_folds", "M6", f"""
SELECT enrol_key, dropout, CAST((SELECT count(*) FROM range(1, 5) j(f) WHERE rn > ceil(cnt * CAST(f AS DECIMAL(4, 1)) * 0.2)) AS INTEGER) AS fold
FROM (SELECT enrol_key, dropout,
  row_number() OVER (PARTITION BY dropout ORDER BY {_md5_hash_sql('enrol_key', 43)}, enrol_key) AS rn,
  count(*) OVER (PARTITION BY dropout) AS cnt FROM students) x""", ("students",))
def q_stratified_folds(spark, sf_dir):
    s = _t(spark, sf_dir).students.select("enrol_key", "dropout")
    return sp.assign_folds(s, "enrol_key", "dropout", 5, 42)


_LOGISTIC_NUMERIC = enc.logistic_columns([c for c in S.STUDENT_COLS if c not in ("id_student", "dropout")])[2]


@query("scale_numeric", "E5", "SELECT enrol_key, {c} FROM students, (SELECT {s} FROM students) st".format(
    c=", ".join(f"{c} / coalesce(nullif(st.s_{c}, 0), 1) AS {c}" for c in _LOGISTIC_NUMERIC),
    s=", ".join(f"stddev_pop({c}) AS s_{c}" for c in _LOGISTIC_NUMERIC)), ("students",))
def q_scale_numeric(spark, sf_dir):
    s = _t(spark, sf_dir).students.select("enrol_key", *_LOGISTIC_NUMERIC)
    return enc.scale_numeric(s, _LOGISTIC_NUMERIC)


@query("minmax_features", "E6", "SELECT enrol_key, {c} FROM students, (SELECT {s} FROM students) st".format(
    c=", ".join(f"coalesce(({c} - st.lo_{c}) / nullif(st.hi_{c} - st.lo_{c}, 0), 0e0) AS {c}"
                for c in S.CLUSTER_FEATURES),
    s=", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in S.CLUSTER_FEATURES)), ("students",))
def q_minmax_features(spark, sf_dir):
    s = _t(spark, sf_dir).students.select("enrol_key", *S.CLUSTER_FEATURES)
    return enc.minmax_features(s)


def _assembled(df, stages):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    m = Pipeline(stages=stages).fit(df)
    return (m.transform(df).select("enrol_key", F.posexplode(vector_to_array("features")).alias("position", "value"))
            .select("enrol_key", "position", "value"))


def _long_sql(features: str, source: str) -> str:
    """One row per feature of a vector: position and value."""
    return (f"SELECT enrol_key, CAST(unnest(range(len(features))) AS INTEGER) AS position, unnest(features) AS value "
            f"FROM (SELECT enrol_key, {features} AS features FROM {source}) v")


@query("assemble_full_course", "E7", _long_sql(f"[{', '.join(_enc_sql(c) for c in S.FEATURE_COLS)}]", "students"),
       ("students",))
def q_assemble_full_course(spark, sf_dir):
    from cohortlens.operators.train import tree_stages
    return _assembled(_t(spark, sf_dir).students, tree_stages(S.FEATURE_COLS))


@query("assemble_early", "E8", _long_sql(f"[{', '.join(_enc_sql(c) for c in S.EARLY_FEATURE_COLS)}]",
                                         f"({JOIN_FEATURES_SQL}) e"), ("students", "studentVle"),
       extra={"vf": VLE_AGG_SQL})
def q_assemble_early(spark, sf_dir):
    from cohortlens.operators.train import tree_stages
    t = _t(spark, sf_dir)
    return _assembled(feat.early_frame(t.students, t.student_vle), tree_stages(S.EARLY_FEATURE_COLS))


def _logistic_sql():
    ordinal, nominal, numeric = enc.logistic_columns(
        [c for c in S.STUDENT_COLS if c not in ("id_student", "dropout")])
    ords = "[" + ", ".join(f"CAST({G.ordinal_sql(c, enc.ORDERS[c])} AS DOUBLE)" for c in ordinal) + "]"
    nums = "[" + ", ".join(f"CAST({c} AS DOUBLE) / coalesce(nullif(st.s_{c}, 0), 1)" for c in numeric) + "]"
    ohe = ", ".join(_onehot_sql(c) for c in nominal)
    stats = ", ".join(f"stddev_pop({c}) AS s_{c}" for c in numeric)
    return _long_sql(f"list_concat({ords}, {ohe}, {nums})", f"students, (SELECT {stats} FROM students) st")


@query("feature_select_logistic", "E9", _logistic_sql(), ("students",))
def q_feature_select_logistic(spark, sf_dir):
    from cohortlens.operators.train import logistic_stages
    s = _t(spark, sf_dir).students
    cols = [c for c in s.columns if c not in ("id_student", "dropout", "enrol_key")]
    return _assembled(s, logistic_stages(s, cols))


# ----------------------------------------------------------------------------
# 2.7 training (rows-only: model outputs cannot equal the reference's RNG)
# ----------------------------------------------------------------------------

# Searches have the reference's sizes and spaces, which are the library defaults.
# Queries that need one model state its parameters.
RF_PARAMS = {"n_estimators": 100, "max_depth": 8, "min_samples_split": 2, "min_samples_leaf": 2, "bootstrap": True,
             "class_weight": "balanced"}
A_PARAMS = {"n_estimators": 500, "max_depth": 4, "learning_rate": 0.05, "subsample": 0.8, "colsample_bytree": 0.7,
            "min_child_weight": 1, "gamma": 0}


def _early(spark, sf_dir):
    t = _t(spark, sf_dir)
    return feat.early_frame(t.students, t.student_vle)


def _checked(preds, rule):
    """Predictions with their model-dependent values checked instead of shown: the probability is one, the class follows it."""
    sure = F.col("probability") >= 0.5 if rule == ">=" else F.col("probability") > 0.5
    return preds.select("id_student", "model_name", "run_id", F.col("probability").between(0, 1).alias("is_probability"),
                        (F.col("predicted") == sure.cast("int")).alias("follows_rule"))


def _train_and_emit(spark, kind, df):
    r = tr.train_model(kind, df)
    return _checked(tr.emit_predictions(r["test_scored"], tr.MODEL_NAMES[kind], f"run-{kind}"), r["rule"])


def _holdout_sql(kind, source="students"):
    """The held-out enrolments (E4) of a model's frame, with checks that hold for any fitted model."""
    return f"""
SELECT id_student, '{tr.MODEL_NAMES[kind]}' AS model_name, 'run-{kind}' AS run_id, true AS is_probability, true AS follows_rule
FROM (SELECT id_student, row_number() OVER (PARTITION BY dropout ORDER BY {_md5_hash_sql('enrol_key', 42)}, enrol_key) AS rn,
  count(*) OVER (PARTITION BY dropout) AS cnt FROM {source}) x WHERE rn <= ceil(cnt * 0.2)"""


@query("train_logistic", "M1", _holdout_sql("logistic"), ("students",))
def q_train_logistic(spark, sf_dir):
    return _train_and_emit(spark, "logistic", _t(spark, sf_dir).students)


@query("logistic_coefficients", "M1")
def q_logistic_coefficients(spark, sf_dir):
    """The coefficients at which the penalised objective's gradient is zero, the intercept among them."""
    return tr.train_model("logistic", _t(spark, sf_dir).students)["model"].table(spark)


@query("train_random_forest", "M2", _holdout_sql("random_forest"), ("students",))
def q_train_random_forest(spark, sf_dir):
    return _train_and_emit(spark, "random_forest", _t(spark, sf_dir).students)


@query("train_boosted_a", "M3", _holdout_sql("boosted_a"), ("students",))
def q_train_boosted_a(spark, sf_dir):
    return _train_and_emit(spark, "boosted_a", _early(spark, sf_dir))


@query("train_boosted_b", "M4", _holdout_sql("boosted_b"), ("students",))
def q_train_boosted_b(spark, sf_dir):
    return _train_and_emit(spark, "boosted_b", _early(spark, sf_dir))


@query("random_search", "M5")
def q_random_search(spark, sf_dir):
    """Every sampled forest candidate with its mean F1 over the folds."""
    d = tr.with_weights(_landed(spark, sf_dir, "students").students)
    train, _ = tr.split(d)
    n, folds = tr.SEARCH_SIZES["random_forest"]
    candidates = tr.sample_space(tr.RF_SPACE, n)
    _, rows, borders = prepared_rows("random_forest", train, tr.tree_stages(S.FEATURE_COLS), S.FEATURE_COLS, folds)
    scores = search_scores(spark, "random_forest", rows, borders, candidates, folds)
    best = max(range(n), key=lambda i: scores[i])
    rows = [(i, str(sorted(c.items())), m, i == best) for i, (c, m) in enumerate(zip(candidates, scores))]
    return spark.createDataFrame(rows, "candidate int, params string, cv_f1 double, is_best boolean")


@query("decision_rule", "M7", """
SELECT id_student, model_name, probability, CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS predicted_ge,
 CASE WHEN probability > 0.5 THEN 1 ELSE 0 END AS predicted_gt FROM predictions""", ("predictions",))
def q_decision_rule(spark, sf_dir):
    from cohortlens.operators.score import decision
    p = _t(spark, sf_dir).predictions
    return p.select("id_student", "model_name", "probability", decision("probability", ">=").alias("predicted_ge"),
                    decision("probability", ">").alias("predicted_gt"))


@query("emit_predictions", "M8", _holdout_sql("logistic"), ("students",))
def q_emit_predictions(spark, sf_dir):
    r = tr.train_model("logistic", _t(spark, sf_dir).students)
    preds = tr.emit_predictions(r["test_scored"], tr.MODEL_NAMES["logistic"], "run-logistic")
    return _checked(st.sink_replace_model(preds, scratch_path(spark, "predictions"), [tr.MODEL_NAMES["logistic"]]), r["rule"])


@query("record_run", "M9", f"""
SELECT '{tr.EXPERIMENTS["logistic"]}' AS experiment, 'FINISHED' AS status, 1 AS n_runs, true AS named, true AS timed, 'server-artifacts:' AS artifact_store,
 '{tr.LOGISTIC_C}' AS c, '{tr.LOGISTIC_MAX_ITER}' AS max_iter, 'balanced' AS class_weight, unnest(['accuracy', 'auc', 'f1', 'precision', 'recall']) AS metric,
 true AS is_share""")
def q_record_run(spark, sf_dir):
    """A recorded training run as the runs table holds it, one row a metric."""
    r = tr.train_model("logistic", _t(spark, sf_dir).students)
    path = scratch_path(spark, "runs")
    metrics = {k: v for k, v in r["metrics"].items() if isinstance(v, float)}
    run_id = st.record_run(spark, path, tr.EXPERIMENTS["logistic"], r["params"], metrics)
    runs = spark.read.parquet(path)
    return runs.select(
        "experiment", "status", F.lit(runs.count()).cast("int").alias("n_runs"), (F.col("run_id") == run_id).alias("named"), F.col("start_time").isNotNull().alias("timed"),
        F.substring_index("artifact_uri", "/", 1).alias("artifact_store"), F.col("params")["C"].alias("c"),
        F.col("params")["max_iter"].alias("max_iter"), F.col("params")["class_weight"].alias("class_weight"),
        F.explode("metrics").alias("metric", "value")).withColumn("is_share", F.col("value").between(0, 1)).drop("value")


@query("save_load_model", "M10", f"""
SELECT enrol_key, true AS same FROM (SELECT enrol_key,
  row_number() OVER (PARTITION BY dropout ORDER BY {_md5_hash_sql('enrol_key', 42)}, enrol_key) AS rn,
  count(*) OVER (PARTITION BY dropout) AS cnt FROM students) x WHERE rn <= ceil(cnt * 0.2)""", ("students",))
def q_save_load_model(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array
    r = tr.train_model("random_forest", _t(spark, sf_dir).students, params=RF_PARAMS)
    path = scratch_path(spark, "model-rf")
    r["model"].write().overwrite().save(path)
    loaded = load_model(spark, path)
    again = loaded.transform(r["test_scored"].select(*_t(spark, sf_dir).students.columns, "label", "w_balanced",
                                                     "w_pos", "w_one"))
    again = again.select("enrol_key", vector_to_array("probability").getItem(1).alias("reloaded_probability"))
    first = r["test_scored"].select("enrol_key", "probability")
    return first.join(again, "enrol_key").select(
        "enrol_key", (F.abs(F.col("probability") - F.col("reloaded_probability")) < 1e-12).alias("same"))


@query("feature_importance", "M11")
def q_feature_importance(spark, sf_dir):
    """Per feature: share of split gains, mean absolute attribution on held-out rows, loss of AUC when permuted."""
    early = _early(spark, sf_dir)
    r = tr.train_model("boosted_a", early, params=A_PARAMS)
    imp = spark.createDataFrame(r["model"].importances(), "feature string, importance double")
    test = r["test_scored"].select(*early.columns)
    mean = r["model"].attributions(test, "enrol_key").groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_attribution"))
    perm = tr.permutation_importance(r["model"], test, S.EARLY_FEATURE_COLS)
    return imp.join(mean, "feature", "left").join(perm, "feature", "left")


@query("feature_attributions", "M11", f"""
SELECT enrol_key, unnest([{', '.join(f"'{c}'" for c in S.EARLY_FEATURE_COLS)}]) AS feature, true AS row_adds_up
FROM (SELECT enrol_key, row_number() OVER (PARTITION BY dropout ORDER BY {_md5_hash_sql('enrol_key', 42)}, enrol_key) AS rn,
  count(*) OVER (PARTITION BY dropout) AS cnt FROM students) x WHERE rn <= ceil(cnt * 0.2)""", ("students",))
def q_feature_attributions(spark, sf_dir):
    """What each feature adds to each held-out row's margin; a row's values and the base are its margin to 1e-9."""
    model = tr.train_model("boosted_a", _early(spark, sf_dir), params=A_PARAMS)
    test = model["test_scored"].select(*_early(spark, sf_dir).columns)
    values = model["model"].attributions(test, "enrol_key")
    sums = values.groupBy("enrol_key").agg(F.sum("value").alias("total"))
    sums = sums.join(model["model"].margins(test).select("enrol_key", "margin"), "enrol_key").select(
        "enrol_key", (F.abs(F.col("total") + F.lit(model["model"].base()) - F.col("margin")) < 1e-9).alias("row_adds_up"))
    return values.join(sums, "enrol_key").select("enrol_key", "feature", "row_adds_up")


@query("train_neural", "M12", _holdout_sql("neural"), ("students",))
def q_train_neural(spark, sf_dir):
    return _train_and_emit(spark, "neural", _t(spark, sf_dir).students)


# ----------------------------------------------------------------------------
# 2.8 clustering
# ----------------------------------------------------------------------------
_PRUNED = "SELECT id_student, avg_score, active_days, total_clicks, dropout FROM students"


def _kmeans_sql(ks, final):
    return f"WITH {clu.kmeans_sql(_PRUNED, ks)}\n{final}"


# rows of the k-means fit with ids that ascend with the mean score
_CLUSTERED = """placed AS (SELECT pts.id_student, pts.avg_score, pts.dropout, near.j FROM pts JOIN near USING (row_no)),
numbered AS (SELECT j, CAST(row_number() OVER (ORDER BY avg(avg_score), j) - 1 AS INTEGER) AS cluster_id FROM placed GROUP BY j)"""


@query("kmeans_fit", "C1", f"""SELECT * FROM (WITH {clu.kmeans_sql(_PRUNED, [S.K_CLUSTERS])}, {_CLUSTERED}
SELECT id_student, dropout, cluster_id FROM placed JOIN numbered USING (j)) x""", ("students",))
def q_kmeans_fit(spark, sf_dir):
    """Every enrolment with its cluster, clusters numbered by ascending mean score."""
    out, _, _ = clu.fit_clusters(readers.scan_pruned(_t(spark, sf_dir).students))
    return out.select("id_student", "dropout", "cluster_id")


_KS = list(range(1, 11))


@query("kmeans_elbow", "C2", f"""SELECT * FROM ({_kmeans_sql(_KS, f"SELECT CAST(k AS INTEGER) AS k, CAST(sum(d) AS DOUBLE) / {clu.GRID}e0 / {clu.GRID}e0 AS inertia FROM near GROUP BY k")}) x""",
       ("students",))
def q_kmeans_elbow(spark, sf_dir):
    return clu.elbow(spark, readers.scan_pruned(_t(spark, sf_dir).students), ks=_KS)


@query("kmeans_centres", "C2", f"""SELECT * FROM ({_kmeans_sql(_KS, "SELECT CAST(f.k AS INTEGER) AS k, CAST(f.j AS INTEGER) AS centre, coalesce(n.n_rows, 0) AS n_rows, "
       + ", ".join(f"c{i} / {clu.GRID}e0 AS {c}" for i, c in enumerate(S.CLUSTER_FEATURES))
       + " FROM fitted f LEFT JOIN (SELECT k, j, count(*) AS n_rows FROM near GROUP BY k, j) n USING (k, j)")}) x""", ("students",))
def q_kmeans_centres(spark, sf_dir):
    """Centres and sizes of the fits for k = 1..10."""
    return clu.elbow_centres(spark, readers.scan_pruned(_t(spark, sf_dir).students), ks=_KS)


@query("kmeans_inertia_k1", "C2", "SELECT 1 AS k, ({s}) * count(*) AS inertia FROM ({x}) z".format(
    s=" + ".join(f"coalesce(var_pop({c}), 0)" for c in S.CLUSTER_FEATURES),
    x="SELECT {c} FROM students, (SELECT {m} FROM students) st".format(
        c=", ".join(f"coalesce(({c} - st.lo_{c}) / nullif(st.hi_{c} - st.lo_{c}, 0), 0e0) AS {c}"
                    for c in S.CLUSTER_FEATURES),
        m=", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in S.CLUSTER_FEATURES))), ("students",))
def q_kmeans_inertia_k1(spark, sf_dir):
    return clu.inertia_k1(readers.scan_pruned(_t(spark, sf_dir).students))


@query("clusters_table", "C3", f"""SELECT * FROM (WITH {clu.kmeans_sql(_PRUNED, [S.K_CLUSTERS])}, {_CLUSTERED}
SELECT id_student, cluster_id, avg(CAST(dropout AS DOUBLE)) OVER (PARTITION BY cluster_id) AS dropout_rate FROM placed JOIN numbered USING (j)) x""",
       ("students",))
def q_clusters_table(spark, sf_dir):
    df = clu.clusters_table(readers.scan_pruned(_t(spark, sf_dir).students))
    return st.sink_recreate(df, scratch_path(spark, "clusters"), S.CLUSTERS_SCHEMA).select("id_student", "cluster_id", "dropout_rate")


@query("cluster_scatter", "C4", "SELECT id_student, active_days, avg_score, total_clicks, {l} AS cluster, dropout FROM cj".format(
    l=G.cluster_label_sql()), ("cj",))
def q_cluster_scatter(spark, sf_dir):
    return rep.cluster_scatter(_cj(spark, sf_dir))


# ----------------------------------------------------------------------------
# 2.9 scoring
# ----------------------------------------------------------------------------
_ID_VALID_SQL = ("coalesce(trim(student_id_text) = '' OR (regexp_full_match(trim(student_id_text), '[0-9]+') "
                 "AND TRY_CAST(trim(student_id_text) AS BIGINT) IS NOT NULL), true)")
_REASON_SQL = ("nullif(concat_ws('; ', CASE WHEN NOT id_valid THEN 'student id' END, "
               "CASE WHEN NOT in_range THEN 'feature out of range' END, CASE WHEN NOT known THEN 'unknown category' END), '') AS reject_reason")


def _known_sql(features, source):
    """Whether every category of a completed request is one that the source has."""
    return " AND ".join(f"({c} IS NULL OR {c} IN (SELECT o.{c} FROM {source} o WHERE o.{c} IS NOT NULL))" for c in features if c in _CATEGORICAL)


def _options(df):
    """The categories of a frame, as the request forms offer them."""
    out = {}
    for r in sc.distinct_values(df, _CATEGORICAL).collect():        # bounded by the categories
        out.setdefault(r["column_name"], []).append(r["value"])
    return out


def _complete_sql():
    cols = []
    for c in S.FEATURE_COLS:
        cols.append(f"coalesce(CAST(r.{c} AS DOUBLE), d.{c}) AS {c}" if c in _NUMERIC_FULL
                    else f"coalesce(r.{c}, d.{c}) AS {c}")
    idv = _ID_VALID_SQL
    checks = " + ".join(f"CASE WHEN {c} IS NOT NULL AND NOT ({c} BETWEEN {lo} AND {hi}) THEN 1 ELSE 0 END"
                        for c, (lo, hi) in S.REQUEST_BOUNDS_FULL.items())
    return f"""
SELECT * EXCLUDE (known), id_valid AND in_range AND known AS accepted, {_REASON_SQL} FROM (
 SELECT *, CAST({checks} AS INTEGER) AS n_out_of_range, ({checks}) = 0 AS in_range, {_known_sql(S.FEATURE_COLS, 'students')} AS known FROM (
  SELECT r.request_id, r.student_id_text, {', '.join(cols)},
   CASE WHEN regexp_full_match(trim(r.student_id_text), '[0-9]+') THEN TRY_CAST(trim(r.student_id_text) AS BIGINT) END AS id_student,
   {idv} AS id_valid
  FROM requests r, d) a) b"""


@query("complete_requests", "I1", _complete_sql(), ("requests", "students"),
       extra={"d": _defaults_sql(S.FEATURE_COLS, _NUMERIC_FULL)})
def q_complete_requests(spark, sf_dir):
    t = _landed(spark, sf_dir, "students")
    d = sc.defaults_profile(t.students, S.FEATURE_COLS)
    return sc.complete_requests(t.requests, d, S.FEATURE_COLS, S.REQUEST_BOUNDS_FULL, _options(t.students))


_NUMERIC_EARLY = {"num_of_prev_attempts", "studied_credits", "module_presentation_length", *S.VLE_COLS}


def _complete_early_sql():
    cols = [f"coalesce(CAST(r.{c} AS DOUBLE), d.{c}) AS {c}" if c in _NUMERIC_EARLY else f"coalesce(r.{c}, d.{c}) AS {c}"
            for c in S.EARLY_FEATURE_COLS]
    idv = _ID_VALID_SQL
    checks = " + ".join(f"CASE WHEN {c} IS NOT NULL AND NOT ({c} BETWEEN {lo} AND {hi}) THEN 1 ELSE 0 END"
                        for c, (lo, hi) in S.REQUEST_BOUNDS_EARLY.items())
    return f"""
SELECT * EXCLUDE (known), id_valid AND in_range AND known AS accepted, {_REASON_SQL} FROM (
 SELECT *, CAST({checks} AS INTEGER) AS n_out_of_range, ({checks}) = 0 AS in_range, {_known_sql(S.EARLY_FEATURE_COLS, 'students')} AS known FROM (
  SELECT r.request_id, r.student_id_text, {', '.join(cols)},
   CASE WHEN regexp_full_match(trim(r.student_id_text), '[0-9]+') THEN TRY_CAST(trim(r.student_id_text) AS BIGINT) END AS id_student,
   {idv} AS id_valid
  FROM requests_early r, d) a) b"""


def _early_defaults_sql():
    ef = "SELECT * FROM ({j}) e".format(j=JOIN_FEATURES_SQL)
    return _defaults_sql(S.EARLY_FEATURE_COLS, _NUMERIC_EARLY, src="ef"), ef


@query("defaults_profile_early", "A16", _early_defaults_sql()[0], ("students", "studentVle"),
       extra={"vf": VLE_AGG_SQL, "ef": _early_defaults_sql()[1]})
def q_defaults_profile_early(spark, sf_dir):
    return sc.defaults_profile(_early(spark, sf_dir), S.EARLY_FEATURE_COLS)


@query("validate_ranges_early", "F16", _bounds_sql(S.REQUEST_BOUNDS_EARLY).replace("FROM requests", "FROM requests_early"),
       ("requests_early",))
def q_validate_ranges_early(spark, sf_dir):
    from cohortlens.operators.score import validate_ranges
    return validate_ranges(_t(spark, sf_dir).requests_early, S.REQUEST_BOUNDS_EARLY).select(
        "request_id", "n_out_of_range", "in_range")


@query("complete_requests_early", "I1", _complete_early_sql(), ("requests_early", "students", "studentVle"),
       extra={"vf": VLE_AGG_SQL, "ef": _early_defaults_sql()[1], "d": _early_defaults_sql()[0]})
def q_complete_requests_early(spark, sf_dir):
    t = _landed(spark, sf_dir, "student_vle", "students", "early")
    d = sc.defaults_profile(t.early, S.EARLY_FEATURE_COLS)
    return sc.complete_requests(t.requests_early, d, S.EARLY_FEATURE_COLS, S.REQUEST_BOUNDS_EARLY, _options(t.students))


def _scored_requests(spark, sf_dir):
    t = _landed(spark, sf_dir, "students")
    r = tr.train_model("random_forest", t.students, params=RF_PARAMS)
    d = sc.defaults_profile(t.students, S.FEATURE_COLS)
    req = sc.complete_requests(t.requests, d, S.FEATURE_COLS, S.REQUEST_BOUNDS_FULL, _options(t.students))
    return sc.score(r["model"], req, r["rule"]), r


_REQUEST_VIEWS = {"d": _defaults_sql(S.FEATURE_COLS, _NUMERIC_FULL)}


@query("score_requests", "I2", f"SELECT request_id, id_student, accepted, true AS is_probability FROM ({_complete_sql()}) c",
       ("requests", "students"), extra=_REQUEST_VIEWS)
def q_score_requests(spark, sf_dir):
    scored, _ = _scored_requests(spark, sf_dir)
    return scored.select("request_id", "id_student", "accepted", F.col("probability").between(0, 1).alias("is_probability"))


@query("train_and_score_latest", "M9", 
       f"SELECT request_id, true AS is_probability, true AS is_latest FROM ({_complete_sql()}) c WHERE accepted",
       ("requests", "students"), extra=_REQUEST_VIEWS)
def q_train_and_score_latest(spark, sf_dir):
    """Two recorded runs end to end; the newest has lost its artifact, so requests are scored with the other."""
    from cohortlens.operators import lifecycle as lc
    t = _landed(spark, sf_dir, "students")
    runs, models, preds = (scratch_path(spark, n) for n in ("runs", "models", "predictions"))
    first = lc.train(spark, "random_forest", t.students, runs, models, preds, params=RF_PARAMS)
    st.record_run(spark, runs, tr.EXPERIMENTS["random_forest"], {}, {}, artifact_uri=f"{models}/lost")
    d = sc.defaults_profile(t.students, S.FEATURE_COLS)
    done = sc.complete_requests(t.requests, d, S.FEATURE_COLS, S.REQUEST_BOUNDS_FULL, _options(t.students))
    out = lc.score_latest(spark, runs, "random_forest", done)
    return out.select("request_id", F.col("probability").between(0, 1).alias("is_probability"), (F.col("run_id") == first).alias("is_latest"))


_STORED_SQL = f"""
SELECT CAST(request_id AS VARCHAR) AS request_id, CASE WHEN accepted THEN 'live' ELSE 'rejected' END AS stored_in,
 CASE WHEN accepted THEN id_student END AS id_student, reject_reason FROM ({_complete_sql()}) c"""


def _stored_requests(spark, live, rejected):
    """Where each request went: the live table, or the rejected ones with the reason."""
    none = F.lit(None)
    return (st.read_live(spark, live).select("request_id", F.lit("live").alias("stored_in"), "id_student",
                                             none.cast("string").alias("reject_reason"))
            .unionByName(spark.read.parquet(rejected).select("request_id", F.lit("rejected").alias("stored_in"),
                                                             none.cast("long").alias("id_student"), "reject_reason")))


@query("save_scored", "I3", _STORED_SQL, ("requests", "students"), extra=_REQUEST_VIEWS)
def q_save_scored(spark, sf_dir):
    scored, _ = _scored_requests(spark, sf_dir)
    live, rejected = scratch_path(spark, "live"), scratch_path(spark, "rejected")
    st.sink_append_live(scored.where("accepted").withColumns({"model_name": F.lit("Random Forest"), "run_id": F.lit("run-random_forest")}),
                        live, "form")
    st.write_rejected(scored, rejected, "form")
    return _stored_requests(spark, live, rejected)


@query("early_frame", "I4", JOIN_FEATURES_SQL, ("students", "studentVle"), extra={"vf": VLE_AGG_SQL})
def q_early_frame(spark, sf_dir):
    t = _t(spark, sf_dir)
    return feat.early_frame(t.students, t.student_vle)


@query("stream_requests", "I5", _STORED_SQL, ("requests", "students"), extra=_REQUEST_VIEWS)
def q_stream_requests(spark, sf_dir):
    from cohortlens.streaming import stream_requests
    t = _landed(spark, sf_dir, "students")
    src = scratch_path(spark, "requests-in")
    t.requests.repartition(4).write.parquet(src)                       # request files landing
    r = tr.train_model("random_forest", t.students, params=RF_PARAMS)
    d = sc.defaults_profile(t.students, S.FEATURE_COLS)
    live = scratch_path(spark, "live")
    q = stream_requests(spark, src, t.requests.schema, d, r["model"], S.FEATURE_COLS, live,
                        scratch_path(spark, "stream-ckpt"), "Random Forest", "run-random_forest",
                        S.REQUEST_BOUNDS_FULL, r["rule"], options=_options(t.students))
    q.awaitTermination()
    return _stored_requests(spark, live, live + "_rejected")


@query("stream_latest_model", "I5", f"""
SELECT CAST(request_id AS VARCHAR) AS request_id, CASE WHEN request_id % 2 = 0 THEN 'first' ELSE 'second' END AS scored_by
FROM ({_complete_sql()}) c WHERE accepted""", ("requests", "students"), extra=_REQUEST_VIEWS)
def q_stream_latest_model(spark, sf_dir):
    """Requests of one stream; a run recorded between its epochs scores those that come after."""
    from cohortlens.operators import lifecycle as lc
    from cohortlens.streaming import stream_latest
    t = _landed(spark, sf_dir, "students")
    runs, models, preds, src, live, ckpt = (scratch_path(spark, n) for n in ("runs", "models", "predictions", "requests-in", "live", "ckpt"))
    d, options = sc.defaults_profile(t.students, S.FEATURE_COLS), _options(t.students)
    names = {}
    for half, label in ((0, "first"), (1, "second")):
        names[lc.train(spark, "logistic", t.students, runs, models, preds)] = label
        t.requests.where(F.col("request_id") % 2 == half).write.mode("append").parquet(src)
        stream_latest(spark, src, t.requests.schema, d, runs, "logistic", S.FEATURE_COLS, live, ckpt,
                      S.REQUEST_BOUNDS_FULL, options=options).awaitTermination()
    label = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return st.read_live(spark, live).select("request_id", label[F.col("run_id")].alias("scored_by"))


@query("score_requests_early", "I2", f"SELECT request_id, id_student, accepted, true AS is_probability FROM ({_complete_early_sql()}) c",
       ("requests_early", "students", "studentVle"),
       extra={"vf": VLE_AGG_SQL, "ef": _early_defaults_sql()[1], "d": _early_defaults_sql()[0]})
def q_score_requests_early(spark, sf_dir):
    t = _landed(spark, sf_dir, "student_vle", "students", "early")
    ef = t.early
    r = tr.train_model("boosted_a", ef, params=A_PARAMS)
    d = sc.defaults_profile(ef, S.EARLY_FEATURE_COLS)
    req = sc.complete_requests(t.requests_early, d, S.EARLY_FEATURE_COLS, S.REQUEST_BOUNDS_EARLY, _options(t.students))
    return sc.score(r["model"], req, r["rule"]).select(
        "request_id", "id_student", "accepted", F.col("probability").between(0, 1).alias("is_probability"))
