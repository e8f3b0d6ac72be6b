"""DuckDB SQL for the fixture views (FIXTURES.md), composed as CTEs.

The driver's DuckDB has only the base tables registered, so each oracle
statement carries the views it needs as a WITH prefix.
"""
from __future__ import annotations

VIEWS: dict[str, tuple[list[str], str]] = {}


def _view(name, deps, sql):
    VIEWS[name] = (deps, sql.strip())


_view("enrol", [], """
SELECT o_custkey AS id_student,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'AAA' WHEN '2-HIGH' THEN 'BBB' WHEN '3-MEDIUM' THEN 'CCC'
   WHEN '4-NOT SPECIFIED' THEN 'DDD' ELSE 'EEE' END AS code_module,
 concat(CAST(year(o_orderdate) AS VARCHAR), CASE WHEN month(o_orderdate) <= 6 THEN 'B' ELSE 'J' END) AS code_presentation,
 o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders""")

_view("studentVle", ["enrol"], """
SELECT e.code_module, e.code_presentation, e.id_student, l_partkey AS id_site,
 CAST(((date_diff('day', e.o_orderdate, l_shipdate) % 270) + 270) % 270 - 25 AS INTEGER) AS date,
 CAST(l_quantity AS INTEGER) AS sum_click
FROM lineitem JOIN enrol e ON l_orderkey = e.o_orderkey""")

_view("raw_students", ["enrol"], """
WITH en AS (SELECT id_student, code_module, code_presentation, min(o_orderkey) AS enrol_key,
   max(CASE WHEN o_orderstatus = 'F' AND o_totalprice < 120000 THEN 2 WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS st,
   count(*) AS n_ord FROM enrol GROUP BY 1,2,3),
 cl AS (SELECT e.id_student, e.code_module, e.code_presentation, sum(l_quantity) AS total_clicks,
   count(DISTINCT l_shipdate) AS active_days, count(DISTINCT l_partkey) AS unique_resources,
   sum(CASE WHEN l_returnflag='A' THEN 1 ELSE 0 END) AS num_forum,
   sum(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS num_quiz, avg(l_quantity)*2 AS avg_score,
   sum(CASE WHEN l_linestatus='F' THEN 1 ELSE 0 END) AS num_assess_attempted, count(*)*12.5 AS total_weight
   FROM lineitem JOIN enrol e ON l_orderkey=e.o_orderkey GROUP BY 1,2,3)
SELECT en.id_student, en.code_module, en.code_presentation,
 CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender, n_name AS region,
 CASE c_mktsegment WHEN 'MACHINERY' THEN 'No Formal quals' WHEN 'BUILDING' THEN 'Lower Than A Level'
   WHEN 'AUTOMOBILE' THEN 'A Level or Equivalent' WHEN 'FURNITURE' THEN 'HE Qualification'
   ELSE 'Post Graduate Qualification' END AS highest_education,
 CASE CAST(floor((c_acctbal + 1000) / 1000) AS INT) WHEN 0 THEN '0' WHEN 1 THEN '10-20' WHEN 2 THEN '20-30%'
   WHEN 3 THEN '30-40%' WHEN 4 THEN '40-50%' WHEN 5 THEN '50-60%' WHEN 6 THEN '60-70%' WHEN 7 THEN '70-80%'
   WHEN 8 THEN '80-90%' WHEN 9 THEN '90-100%' ELSE '0-10%' END AS imd_band,
 CASE c_custkey % 3 WHEN 0 THEN '0-35' WHEN 1 THEN '35-55' ELSE '55<=' END AS age_band,
 CAST(en.n_ord - 1 AS INT) AS num_of_prev_attempts, CAST(30 * (1 + c_custkey % 8) AS INT) AS studied_credits,
 CASE WHEN c_custkey % 10 = 0 THEN 'Y' ELSE 'N' END AS disability,
 CAST(coalesce(cl.total_clicks,0) AS DOUBLE) AS total_clicks, CAST(coalesce(cl.active_days,0) AS DOUBLE) AS active_days,
 CAST(coalesce(cl.unique_resources,0) AS DOUBLE) AS unique_resources, CAST(coalesce(cl.num_forum,0) AS DOUBLE) AS num_forum,
 CAST(coalesce(cl.num_quiz,0) AS DOUBLE) AS num_quiz, CAST(coalesce(cl.avg_score,0) AS DOUBLE) AS avg_score,
 CAST(coalesce(cl.num_assess_attempted,0) AS DOUBLE) AS num_assess_attempted,
 CAST(coalesce(cl.total_weight,0) AS DOUBLE) AS total_weight,
 CAST(234 + c_custkey % 36 AS INT) AS module_presentation_length, en.enrol_key,
 CASE WHEN en.enrol_key % 101 = 0 THEN NULL WHEN en.st = 2 THEN 'Withdrawn' WHEN en.st = 1 THEN 'Fail' ELSE 'Pass' END AS final_result
FROM en JOIN customer ON c_custkey = en.id_student JOIN nation ON n_nationkey = c_nationkey
LEFT JOIN cl ON cl.id_student=en.id_student AND cl.code_module=en.code_module AND cl.code_presentation=en.code_presentation""")

_view("students", ["raw_students"], """
SELECT id_student, code_module, code_presentation, gender, region,
 CASE highest_education WHEN 'No Formal quals' THEN 'No Formal Quals' ELSE highest_education END AS highest_education,
 CASE imd_band WHEN '10-20' THEN '10-20%' WHEN '0' THEN NULL ELSE imd_band END AS imd_band, age_band,
 num_of_prev_attempts, studied_credits, disability,
 total_clicks, active_days, unique_resources, num_forum, num_quiz, avg_score, num_assess_attempted, total_weight,
 module_presentation_length, CASE WHEN final_result = 'Withdrawn' THEN 1 ELSE 0 END AS dropout, enrol_key
FROM raw_students""")

_view("predictions", ["students"], """
SELECT CASE WHEN enrol_key % 97 = 0 THEN id_student + 1000000 ELSE id_student END AS id_student, model_name,
 CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS predicted, probability, concat('run-', model_name) AS run_id FROM (
 SELECT s.id_student, s.enrol_key, m.model_name,
   (3000 * dropout + 7 * CAST(((CAST(enrol_key AS HUGEINT) + 1) * (2654435761 + m.k)) % 1000 AS BIGINT)) / 10000e0 AS probability
 FROM students s CROSS JOIN (SELECT * FROM (VALUES ('logistic_dropout',1),('random_forest',2),('xgboost_dropout',3),
   ('catboost_dropout',4),('tabnet',5),('Random Forest',6),('XGBoost',7)) AS t(model_name,k)) m
 WHERE CAST((CAST(enrol_key AS HUGEINT) * 2654435761) % 4294967296 AS BIGINT) / 4294967296e0 < 0.2) x""")

_view("cluster_assign", ["students"], """
SELECT id_student, enrol_key, dropout,
 CAST(CASE WHEN enrol_key % 50 = 0 THEN 7 WHEN active_days < 3 THEN 0 WHEN active_days < 6 THEN 1 ELSE 2 END AS INT) AS cluster_id
FROM students""")

_view("clusters", ["cluster_assign"], """
SELECT id_student, cluster_id, avg(CAST(dropout AS DOUBLE)) OVER (PARTITION BY cluster_id) AS dropout_rate
FROM cluster_assign""")

_view("vle", [], """
SELECT p_partkey AS id_site,
 (['AAA','BBB','CCC','DDD','EEE'])[CAST(p_partkey % 5 AS INT) + 1] AS code_module,
 concat(CAST(1992 + p_size % 7 AS VARCHAR), CASE WHEN p_partkey % 2 = 0 THEN 'B' ELSE 'J' END) AS code_presentation,
 p_type AS activity_type, CAST(p_size % 40 AS INT) AS week_from, CAST(p_size % 40 + 1 AS INT) AS week_to
FROM part""")

_view("runs", [], """
SELECT concat('run-', CAST(o_orderkey AS VARCHAR)) AS run_id,
 (['student_dropout_logistic_v2','random-forest-prediction-v2','xgboost_stu_vle_v2','catboost_stu_vle_v2',
   'tabnet-dropout-prediction'])[CAST(o_orderkey % 5 AS INT) + 1] AS experiment,
 CASE WHEN o_orderstatus = 'F' THEN 'FINISHED' WHEN o_orderstatus = 'O' THEN 'RUNNING' ELSE 'FAILED' END AS status,
 o_orderdate + to_seconds(CAST(o_orderkey % 86400 AS BIGINT)) AS start_time,
 CASE WHEN o_orderkey % 3 = 0 THEN concat('file:///runs/', CAST(o_orderkey AS VARCHAR))
   ELSE concat('server-artifacts:/', CAST(o_orderkey AS VARCHAR)) END AS artifact_uri
FROM orders""")


def _requests_sql() -> str:
    from cohortlens.schemas import FEATURE_COLS
    cols = ",\n ".join(f"CASE WHEN (enrol_key + {i}) % 3 <> 0 THEN {c} END AS {c}"
                       for i, c in enumerate(FEATURE_COLS))
    return f"""
SELECT enrol_key AS request_id,
 CASE WHEN enrol_key % 7 = 0 THEN '' WHEN enrol_key % 7 = 1 THEN concat('id-', CAST(id_student AS VARCHAR))
   ELSE CAST(id_student AS VARCHAR) END AS student_id_text,
 {cols}
FROM students"""


_view("requests", ["students"], _requests_sql())


def _requests_early_sql() -> str:
    from cohortlens.schemas import EARLY_FEATURE_COLS, LEAKAGE_COLS, STUDENT_COLS, VLE_COLS
    static = [c for c in STUDENT_COLS if c not in LEAKAGE_COLS]
    vf = """SELECT id_student, code_module, code_presentation, CAST(SUM(sum_click) AS DOUBLE) AS vle_total_clicks,
 CAST(COUNT(DISTINCT date) AS DOUBLE) AS vle_active_days, CAST(COUNT(DISTINCT id_site) AS DOUBLE) AS vle_unique_resources,
 AVG(sum_click) AS vle_avg_clicks_per_day, CAST(MAX(sum_click) AS DOUBLE) AS vle_max_clicks,
 COALESCE(STDDEV_POP(sum_click), 0) AS vle_std_clicks FROM studentVle WHERE date <= 60 GROUP BY 1, 2, 3"""
    ef = "SELECT {s}, s.enrol_key, {v} FROM students s LEFT JOIN ({vf}) vf USING (id_student, code_module, code_presentation)".format(
        s=", ".join(f"s.{c}" for c in static), v=", ".join(f"coalesce(vf.{c}, 0) AS {c}" for c in VLE_COLS), vf=vf)
    cols = ",\n ".join(f"CASE WHEN (enrol_key + {2 * i}) % 4 <> 0 THEN {c} END AS {c}"
                       for i, c in enumerate(EARLY_FEATURE_COLS))
    return f"""
SELECT enrol_key AS request_id,
 CASE WHEN enrol_key % 5 = 0 THEN ' ' WHEN enrol_key % 5 = 1 THEN 'x' ELSE CAST(id_student AS VARCHAR) END AS student_id_text,
 {cols}
FROM ({ef}) e"""


_view("requests_early", ["students", "studentVle"], _requests_early_sql())


def _order(names):
    seen, out = set(), []

    def visit(n):
        if n in seen:
            return
        seen.add(n)
        for d in VIEWS[n][0]:
            visit(d)
        out.append(n)
    for n in names:
        visit(n)
    return out


def with_views(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the named fixture views (and ``extra`` CTEs, in order)."""
    parts = [f"{n} AS (\n{VIEWS[n][1]}\n)" for n in _order(names)]
    for n, sql in (extra or {}).items():
        parts.append(f"{n} AS (\n{sql.strip()}\n)")
    if not parts:
        return body.strip()
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()


def _register_report_views():
    from cohortlens.plans.sqlgen import cluster_label_sql, normalize_model_sql, list_sql
    from cohortlens.schemas import OFFICIAL_MODELS
    pred_attrs = ["gender", "age_band", "region", "highest_education", "imd_band", "studied_credits"]
    _view("dedup_pred", ["students"], """
SELECT id_student, {a}, dropout FROM (
 SELECT id_student, {a}, max(dropout) OVER (PARTITION BY id_student) AS dropout,
  row_number() OVER (PARTITION BY id_student ORDER BY code_module, code_presentation) AS rn
 FROM students) x WHERE rn = 1""".format(a=", ".join(pred_attrs)))
    _view("pj", ["predictions", "dedup_pred"], """
SELECT p.id_student, p.model_name, p.predicted, p.probability, p.run_id, s.gender, s.age_band, s.region,
 s.highest_education, s.imd_band, s.studied_credits, s.dropout
FROM predictions p LEFT JOIN dedup_pred s ON p.id_student = s.id_student""")
    _view("dj", ["pj"], """
SELECT * FROM (SELECT *, {n} AS display_model FROM pj) x WHERE display_model IN {m}""".format(
        n=normalize_model_sql(), m=list_sql(OFFICIAL_MODELS)))
    _view("dedup_cl", ["students"], """
SELECT id_student, avg_score, active_days, total_clicks, dropout FROM (
 SELECT id_student, avg_score, active_days, total_clicks, max(dropout) OVER (PARTITION BY id_student) AS dropout,
  row_number() OVER (PARTITION BY id_student ORDER BY code_module, code_presentation) AS rn
 FROM students) x WHERE rn = 1""")
    _view("cj", ["clusters", "dedup_cl"], """
SELECT c.id_student, c.cluster_id, s.avg_score, s.active_days, s.total_clicks, s.dropout
FROM clusters c JOIN dedup_cl s ON c.id_student = s.id_student""")
    _view("csum", ["cj"], """
SELECT cluster, count(id_student) AS n_students, round_even(avg(avg_score), 1) AS avg_score,
 round_even(avg(active_days), 1) AS active_days, round_even(avg(total_clicks), 1) AS total_clicks,
 round_even(avg(CAST(dropout AS DOUBLE)) * 100, 1) AS dropout_rate
FROM (SELECT *, {l} AS cluster FROM cj) x GROUP BY cluster""".format(l=cluster_label_sql()))


_register_report_views()
