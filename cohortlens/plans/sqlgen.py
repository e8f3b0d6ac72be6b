"""Small builders for the DuckDB oracle SQL (CASE chains from the fixed lists)."""
from __future__ import annotations

from cohortlens import schemas as S


def q(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v)


def case_map(col: str, mapping: dict, default: str) -> str:
    whens = " ".join(f"WHEN {col} = {q(k)} THEN {q(v)}" for k, v in mapping.items())
    return f"CASE {whens} ELSE {default} END"


def normalize_model_sql(col: str = "model_name") -> str:
    n = f"lower(trim({col}))"
    return (f"CASE WHEN contains({n}, 'logistic') THEN 'Logistic Regression' "
            f"WHEN contains({n}, 'random_forest') THEN 'Random Forest' "
            f"WHEN contains({n}, 'catboost') THEN 'CatBoost' "
            f"WHEN contains({n}, 'tabnet') THEN 'TabNet' "
            f"WHEN contains({n}, 'xgboost') THEN 'XGBoost' ELSE coalesce({col}, 'None') END")


def ordinal_sql(col: str, order: list[str]) -> str:
    return case_map(col, {v: i for i, v in enumerate(order)}, "-1")


def display_sql(attr: str, col: str) -> str:
    m = S.VALUE_DISPLAY_MAPS.get(attr)
    return case_map(col, m, col) if m else col


def display_dynamic_sql(attr_col: str, col: str) -> str:
    whens = " ".join(f"WHEN {attr_col} = {q(a)} THEN {display_sql(a, col)}" for a in S.VALUE_DISPLAY_MAPS)
    return f"CASE {whens} ELSE {col} END"


def cluster_label_sql(col: str = "cluster_id") -> str:
    return case_map(col, S.CLUSTER_LABELS, q(S.CLUSTER_OTHER))


def risk_sql(col: str) -> str:
    hi, watch, stable = S.RISK_LABELS
    return (f"CASE WHEN {col} >= {S.RISK_HIGH} THEN {q(hi)} WHEN {col} >= {S.RISK_WATCH} THEN {q(watch)} "
            f"ELSE {q(stable)} END")


def list_sql(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"
