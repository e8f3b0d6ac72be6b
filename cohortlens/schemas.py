"""Declared schemas, ordered category lists and feature-column lists."""
from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference application's (do not reorder).
# ---------------------------------------------------------------------------
IMD_ORDER = ["0-10%", "10-20%", "20-30%", "30-40%", "40-50%",
             "50-60%", "60-70%", "70-80%", "80-90%", "90-100%"]
AGE_ORDER = ["0-35", "35-55", "55<="]
EDU_ORDER = ["No Formal Quals", "Lower Than A Level", "A Level or Equivalent",
             "HE Qualification", "Post Graduate Qualification"]

LEAKAGE_COLS = ["total_clicks", "active_days", "unique_resources", "num_forum",
                "num_quiz", "avg_score", "num_assess_attempted", "total_weight"]

VLE_COLS = ["vle_total_clicks", "vle_active_days", "vle_unique_resources",
            "vle_avg_clicks_per_day", "vle_max_clicks", "vle_std_clicks"]

STUDENT_COLS = ["id_student", "code_module", "code_presentation",
                "gender", "region", "highest_education", "imd_band",
                "age_band", "num_of_prev_attempts", "studied_credits", "disability",
                "total_clicks", "active_days", "unique_resources", "num_forum",
                "num_quiz", "avg_score", "num_assess_attempted", "total_weight",
                "module_presentation_length", "dropout"]

# full-course feature set (19) and early-click feature set (17), in order
FEATURE_COLS = ["code_module", "code_presentation", "gender", "region",
                "highest_education", "imd_band", "age_band", "num_of_prev_attempts",
                "studied_credits", "disability", "total_clicks", "active_days",
                "unique_resources", "num_forum", "num_quiz", "avg_score",
                "num_assess_attempted", "total_weight", "module_presentation_length"]
EARLY_FEATURE_COLS = ["code_module", "code_presentation", "gender", "region",
                      "highest_education", "imd_band", "age_band", "num_of_prev_attempts",
                      "studied_credits", "disability", "module_presentation_length",
                      "vle_total_clicks", "vle_active_days", "vle_unique_resources",
                      "vle_avg_clicks_per_day", "vle_max_clicks", "vle_std_clicks"]

ORDINAL_FEATURES = ["imd_band", "age_band", "highest_education"]
NOMINAL_FEATURES = ["region", "code_module", "code_presentation"]
BINARY_FEATURES = ["gender", "disability"]

OFFICIAL_MODELS = ["Logistic Regression", "Random Forest", "XGBoost", "CatBoost", "TabNet"]
LIVE_MODEL_NAMES = ["Random Forest", "Logistic Regression", "XGBoost", "CatBoost"]

CUTOFF_DAY = 60
TEST_SIZE = 0.2
RANDOM_STATE = 42
DEFAULT_IMD = "40-50%"
K_CLUSTERS = 3
CLUSTER_FEATURES = ["avg_score", "active_days", "total_clicks"]

# risk badge thresholds (percent) and profile factors
RISK_HIGH, RISK_WATCH = 40.0, 25.0
ENGAGEMENT_LOW_FACTOR, ACHIEVEMENT_LOW_FACTOR = 0.7, 0.75

# request bounds: (min, max) per feature input; full-course form, then early-click form
REQUEST_BOUNDS_FULL = {
    "num_of_prev_attempts": (0, 10), "studied_credits": (0, 600),
    "total_clicks": (0, 50000), "active_days": (0, 365), "unique_resources": (0, 1000),
    "num_forum": (0, 500), "num_quiz": (0, 100), "avg_score": (0, 100),
    "num_assess_attempted": (0, 50), "total_weight": (0, 500),
    "module_presentation_length": (0, 400),
}
REQUEST_BOUNDS_EARLY = {
    "num_of_prev_attempts": (0, 10), "studied_credits": (0, 600),
    "module_presentation_length": (0, 400),
    "vle_total_clicks": (0, 200000), "vle_active_days": (0, 100),
    "vle_unique_resources": (0, 1000), "vle_avg_clicks_per_day": (0, 10000),
    "vle_max_clicks": (0, 10000), "vle_std_clicks": (0, 5000),
}

# display labels (English renderings of the dashboard's labels)
CLUSTER_LABELS = {0: "Cluster A", 1: "Cluster B", 2: "Cluster C", 3: "Cluster D", 4: "Cluster E"}
CLUSTER_OTHER = "Other cluster"
PREDICTED_LABELS = {0: "predicted stay", 1: "predicted dropout"}
RISK_LABELS = ("high dropout risk", "dropout watch", "dropout stable")
LEVEL_LABELS = ("high", "medium", "low")
VALUE_DISPLAY_MAPS = {
    "gender": {"M": "Male", "F": "Female"},
    "age_band": {"0-35": "35 or under", "35-55": "36 to 55", "55<=": "56 or over"},
    "highest_education": {
        "No Formal Quals": "No formal qualification",
        "Lower Than A Level": "Below A-Level",
        "A Level or Equivalent": "A-Level or equivalent",
        "HE Qualification": "Higher-education degree",
        "Post Graduate Qualification": "Postgraduate degree",
    },
    "imd_band": {b: f"Bottom {b.replace('%', '')}%" for b in IMD_ORDER},
    "region": {
        "East Anglian Region": "East Anglia", "Scotland": "Scotland",
        "South Region": "South", "London Region": "London",
        "North Western Region": "North West", "South West Region": "South West",
        "West Midlands Region": "West Midlands", "East Midlands Region": "East Midlands",
        "South East Region": "South East", "Wales": "Wales",
        "Yorkshire Region": "Yorkshire", "North Region": "North", "Ireland": "Ireland",
    },
}
GROUP_ATTRIBUTES = ["age_band", "gender", "highest_education", "imd_band", "region"]

# pandas read_csv default missing-value tokens (beyond the empty string)
CSV_NA_TOKENS = ["#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                 "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
                 "n/a", "nan", "null"]

# ---------------------------------------------------------------------------
# Table schemas
# ---------------------------------------------------------------------------
_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _struct(cols):
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


STUDENTS_SCHEMA = _struct([
    ("id_student", _L), ("code_module", _S), ("code_presentation", _S),
    ("gender", _S), ("region", _S), ("highest_education", _S), ("imd_band", _S),
    ("age_band", _S), ("num_of_prev_attempts", _I), ("studied_credits", _I),
    ("disability", _S), ("total_clicks", _D), ("active_days", _D),
    ("unique_resources", _D), ("num_forum", _D), ("num_quiz", _D), ("avg_score", _D),
    ("num_assess_attempted", _D), ("total_weight", _D),
    ("module_presentation_length", _I), ("dropout", _I),
])
RAW_STUDENTS_SCHEMA = _struct(
    [(f.name, f.dataType) for f in STUDENTS_SCHEMA.fields if f.name != "dropout"]
    + [("enrol_key", _L), ("final_result", _S)])
STUDENT_VLE_SCHEMA = _struct([
    ("code_module", _S), ("code_presentation", _S), ("id_student", _L),
    ("id_site", _L), ("date", _I), ("sum_click", _I)])
VLE_SCHEMA = _struct([
    ("id_site", _L), ("code_module", _S), ("code_presentation", _S),
    ("activity_type", _S), ("week_from", _I), ("week_to", _I)])
PREDICTIONS_SCHEMA = _struct([
    ("id_student", _L), ("model_name", _S), ("predicted", _I),
    ("probability", _D), ("run_id", _S)])
LIVE_PREDICTIONS_SCHEMA = _struct([
    ("id", _S), ("id_student", _L), ("model_name", _S), ("predicted", _I),
    ("probability", _D), ("run_id", _S), ("created_at", T.TimestampType()),
    ("request_id", _S), ("batch_id", _S)])
CLUSTERS_SCHEMA = _struct([("id_student", _L), ("cluster_id", _I), ("dropout_rate", _D)])
KMEANS_METRICS_SCHEMA = _struct([("k", _I), ("inertia", _D)])
RUNS_SCHEMA = T.StructType([
    T.StructField("run_id", _S), T.StructField("experiment", _S),
    T.StructField("status", _S), T.StructField("start_time", T.TimestampType()),
    T.StructField("artifact_uri", _S),
    T.StructField("params", T.MapType(_S, _S)),
    T.StructField("metrics", T.MapType(_S, _D)),
])
