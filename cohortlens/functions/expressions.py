"""Column expressions. All are built-in Spark functions (JVM-side, codegen'd);
no Python UDF is used anywhere in the library."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlens import schemas as S

__all__ = [
    "derive_label", "clean_imd_band", "clean_education", "map_binary",
    "fill_imd_default", "normalize_model_name", "display_value", "cluster_label",
    "risk_badge", "parse_student_id", "student_id_valid", "round1", "round_to",
    "ordinal_code", "within_bounds", "safe_ratio", "col_or_lit",
]


def col_or_lit(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def derive_label(final_result="final_result") -> Column:
    """1 when the outcome is 'Withdrawn', else 0; a NULL outcome is 0."""
    return col_or_lit(final_result).eqNullSafe("Withdrawn").cast("int")


def clean_imd_band(c="imd_band") -> Column:
    """'10-20' -> '10-20%', '0' -> NULL, everything else unchanged."""
    c = col_or_lit(c)
    return (F.when(c == "10-20", F.lit("10-20%"))
             .when(c == "0", F.lit(None).cast("string"))
             .otherwise(c))


def clean_education(c="highest_education") -> Column:
    """'No Formal quals' -> 'No Formal Quals'."""
    c = col_or_lit(c)
    return F.when(c == "No Formal quals", F.lit("No Formal Quals")).otherwise(c)


def map_binary(c, positive: str, negative: str) -> Column:
    """positive -> 1, negative -> 0, anything else (and NULL) -> NULL."""
    c = col_or_lit(c)
    return F.when(c == positive, F.lit(1)).when(c == negative, F.lit(0))


def fill_imd_default(c="imd_band", default: str = S.DEFAULT_IMD) -> Column:
    """F8: NULL deprivation band -> a fixed default band."""
    return F.coalesce(col_or_lit(c), F.lit(default))


def normalize_model_name(c="model_name") -> Column:
    """map a stored model name to its display name by ordered substring
    tests on the trimmed, lower-cased name; unmatched names pass through and
    a NULL name becomes the string 'None'."""
    raw = col_or_lit(c)
    n = F.lower(F.trim(raw))
    return (F.when(n.contains("logistic"), F.lit("Logistic Regression"))
             .when(n.contains("random_forest"), F.lit("Random Forest"))
             .when(n.contains("catboost"), F.lit("CatBoost"))
             .when(n.contains("tabnet"), F.lit("TabNet"))
             .when(n.contains("xgboost"), F.lit("XGBoost"))
             .otherwise(F.coalesce(raw, F.lit("None"))))


def _map_literal(mapping: dict) -> Column:
    items = []
    for k, v in mapping.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def display_value(name: str, c=None) -> Column:
    """display label for a code of attribute ``name``; unknown codes pass through."""
    c = col_or_lit(c if c is not None else name)
    mapping = S.VALUE_DISPLAY_MAPS.get(name)
    if not mapping:
        return c
    return F.coalesce(F.try_element_at(_map_literal(mapping), c), c)


def display_value_dynamic(attr_col, value_col) -> Column:
    """F11 where the attribute name is itself a column (unpivoted data)."""
    attr_col, value_col = col_or_lit(attr_col), col_or_lit(value_col)
    expr = value_col
    for name in reversed(list(S.VALUE_DISPLAY_MAPS)):
        expr = F.when(attr_col == name, display_value(name, value_col)).otherwise(expr)
    return expr


def cluster_label(c="cluster_id") -> Column:
    """0..4 -> 'Cluster A'..'Cluster E'; any other id (and NULL) -> one 'other' label."""
    c = col_or_lit(c)
    return F.coalesce(F.try_element_at(_map_literal(S.CLUSTER_LABELS), c), F.lit(S.CLUSTER_OTHER))


def risk_badge(rate_pct) -> Column:
    """>= 40 high, >= 25 watch, else stable (rate in percent)."""
    r = col_or_lit(rate_pct)
    high, watch, stable = S.RISK_LABELS
    return (F.when(r >= S.RISK_HIGH, F.lit(high))
             .when(r >= S.RISK_WATCH, F.lit(watch))
             .otherwise(F.lit(stable)))


def _stripped(c) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(col_or_lit(c), r"(?U)^\s+|\s+$", "")


def parse_student_id(c="student_id_text") -> Column:
    """blank -> NULL, digits -> bigint, anything else -> NULL (see student_id_valid)."""
    t = _stripped(c)
    return F.when(t.rlike("^[0-9]+$"), t.try_cast("bigint"))


def student_id_valid(c="student_id_text") -> Column:
    """True for blank/NULL or an all-digit id that fits a bigint; False means the request is rejected."""
    t = _stripped(c)
    return F.coalesce((t == "") | (t.rlike("^[0-9]+$") & t.try_cast("bigint").isNotNull()), F.lit(True))


def round1(c) -> Column:
    """round half to even at one decimal (pandas/numpy ``round``)."""
    return F.bround(col_or_lit(c), 1)


def round_to(c, scale: int) -> Column:
    return F.bround(col_or_lit(c), scale)


def ordinal_code(c, order: list[str]) -> Column:
    """0-based position in a fixed category order; unknown and NULL -> -1."""
    arr = F.array(*[F.lit(v) for v in order])
    return F.coalesce(F.array_position(arr, col_or_lit(c)).cast("int") - 1, F.lit(-1))


def within_bounds(c, lo, hi) -> Column:
    """F16: NULL-tolerant range check (NULL means 'use the default' and passes)."""
    c = col_or_lit(c)
    return F.coalesce(c.between(lo, hi), F.lit(True))


def safe_ratio(num, den) -> Column:
    """num / den as double, NULL when the denominator is 0 or NULL."""
    return F.try_divide(col_or_lit(num).cast("double"), col_or_lit(den).cast("double"))
