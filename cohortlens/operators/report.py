"""Reporting: de-duplicated students (A1), the joined prediction and cluster
frames (J1, J2) and the dashboard aggregates (A3, A9-A15, A19)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens import schemas as S
from cohortlens.functions import (cluster_label, normalize_model_name, risk_badge,
                                  round1)
from cohortlens.functions.expressions import display_value_dynamic, safe_ratio

PRED_ATTRS = ["gender", "age_band", "region", "highest_education", "imd_band", "studied_credits"]
CLUSTER_ATTRS = ["avg_score", "active_days", "total_clicks"]


def dedup_students(students: DataFrame, attrs: list[str] = PRED_ATTRS) -> DataFrame:
    """A1: one row per student. Attributes come from the student's first
    enrolment by (code_module, code_presentation) -- a deterministic choice
    among the rows an ANY_VALUE could return -- and ``dropout`` is the MAX,
    i.e. 'ever dropped out'.

    ``min_by`` and ``max`` are both partial aggregates, so a student with a
    third of all enrolments still contributes one row per map task to the
    shuffle, never the whole group to one task.
    """
    order = F.struct("code_module", "code_presentation")
    picked = F.min_by(F.struct(*attrs), order).alias("_a")
    return (students.groupBy("id_student")
            .agg(picked, F.max("dropout").alias("dropout"))
            .select("id_student", *[F.col(f"_a.{a}").alias(a) for a in attrs], "dropout"))


def predictions_view(predictions: DataFrame, students: DataFrame) -> DataFrame:
    """Predictions LEFT JOIN one-row-per-student attributes (no fan-out;
    unmatched predictions keep NULL attributes)."""
    s = dedup_students(students, PRED_ATTRS)
    p = predictions.select("id_student", "model_name", "predicted", "probability", "run_id")
    out = ["id_student", "model_name", "predicted", "probability", "run_id",
           "gender", "age_band", "region", "highest_education", "imd_band", "studied_credits", "dropout"]
    # Rows without a student id (allowed by the live-prediction schema) can
    # never match; they bypass the join instead of all hashing to one
    # shuffle partition as a hot NULL key.
    matched = p.where(F.col("id_student").isNotNull()).join(s, "id_student", "left").select(*out)
    nulls = p.where(F.col("id_student").isNull()).select(
        *[F.col(c) if c in p.columns else F.lit(None).cast(s.schema[c].dataType).alias(c) for c in out])
    return matched.unionByName(nulls)


def clusters_view(clusters: DataFrame, students: DataFrame) -> DataFrame:
    """Clusters INNER JOIN one-row-per-student activity attributes."""
    s = dedup_students(students, CLUSTER_ATTRS)
    c = clusters.select("id_student", "cluster_id")
    return c.join(s, "id_student", "inner").select(
        "id_student", "cluster_id", "avg_score", "active_days", "total_clicks", "dropout")


def with_display_model(j: DataFrame) -> DataFrame:
    """F9 + F10 input: add ``display_model`` and keep the five official models."""
    return (j.withColumn("display_model", normalize_model_name("model_name"))
             .where(F.col("display_model").isin(S.OFFICIAL_MODELS)))


def model_kpis(j: DataFrame) -> DataFrame:
    """A3: per display model, all models in one aggregation pass."""
    d = with_display_model(j)
    n = F.count(F.lit(1))
    pred = F.coalesce(F.sum("predicted"), F.lit(0)).cast("long")
    act = F.coalesce(F.sum("dropout"), F.lit(0)).cast("long")
    return (d.groupBy("display_model")
             .agg(n.alias("n_rows"), pred.alias("predicted_dropout"), act.alias("actual_dropout"),
                  F.avg("probability").alias("avg_probability"))
             .select("display_model", "n_rows", "predicted_dropout",
                     (safe_ratio("predicted_dropout", "n_rows") * 100).alias("predicted_pct"),
                     "actual_dropout",
                     (safe_ratio("actual_dropout", "n_rows") * 100).alias("actual_pct"),
                     "avg_probability"))


def group_rates(j: DataFrame, attributes: list[str] = S.GROUP_ATTRIBUTES) -> DataFrame:
    """Predicted-dropout rate per (model, attribute, value) for all five
    attributes in one pass: unpivot with ``stack`` then one aggregation.
    NULL groups are dropped; rate is percent rounded half-even to 1 decimal."""
    d = with_display_model(j)
    stack = "stack({n}, {args}) AS (attribute, value)".format(
        n=len(attributes), args=", ".join(f"'{a}', CAST({a} AS STRING)" for a in attributes))
    u = d.select("display_model", "predicted", F.expr(stack)).where(F.col("value").isNotNull())
    g = (u.groupBy("display_model", "attribute", "value")
          .agg(F.coalesce(F.sum("predicted"), F.lit(0)).cast("long").alias("predicted_dropout"),
               F.count("predicted").alias("n_students")))
    return (g.select("display_model", "attribute", "value",
                     display_value_dynamic("attribute", "value").alias("display_value"),
                     "predicted_dropout", "n_students",
                     round1(safe_ratio("predicted_dropout", "n_students") * 100).alias("rate_pct"))
             .orderBy("display_model", "attribute", F.desc("rate_pct"), "value"))


def prob_histogram(j: DataFrame, bins: int = 20) -> DataFrame:
    """Equal-width histogram of probability on [0, 1]; 1.0 falls in the last bin."""
    d = with_display_model(j).where(F.col("probability").isNotNull())
    b = F.least(F.floor(F.col("probability") * bins), F.lit(bins - 1)).cast("int")
    return (d.groupBy("display_model", b.alias("bin")).agg(F.count(F.lit(1)).alias("n_rows"))
             .select("display_model", "bin",
                     (F.col("bin") / F.lit(float(bins))).alias("bin_start"),
                     ((F.col("bin") + 1) / F.lit(float(bins))).alias("bin_end"), "n_rows"))


def predicted_counts(j: DataFrame) -> DataFrame:
    """Counts of each predicted value per model, with labels, NULL dropped."""
    d = with_display_model(j).where(F.col("predicted").isNotNull())
    lab = F.when(F.col("predicted") == 0, F.lit(S.PREDICTED_LABELS[0])) \
           .when(F.col("predicted") == 1, F.lit(S.PREDICTED_LABELS[1])) \
           .otherwise(F.col("predicted").cast("string"))
    return (d.groupBy("display_model", "predicted").agg(F.count(F.lit(1)).alias("n_students"))
             .select("display_model", "predicted", lab.alias("label"), "n_students")
             .orderBy("display_model", F.desc("n_students")))


# ---------------------------------------------------------------- clusters

def cluster_summary(c: DataFrame) -> DataFrame:
    """A10 (+F12): per cluster label, enrolment count and rounded means.

    Ids >= 5 share one 'other' label, so they merge here."""
    x = c.withColumn("cluster", cluster_label("cluster_id"))
    return (x.groupBy("cluster")
             .agg(F.count("id_student").alias("n_students"),
                  round1(F.avg("avg_score")).alias("avg_score"),
                  round1(F.avg("active_days")).alias("active_days"),
                  round1(F.avg("total_clicks")).alias("total_clicks"),
                  round1(F.avg(F.col("dropout").cast("double")) * 100).alias("dropout_rate")))


def cluster_kpis(summary: DataFrame) -> DataFrame:
    """One row over the (small) cluster summary: totals, unweighted mean
    of the rounded rates, largest and riskiest cluster (ties -> first label),
    medians of the rounded means."""
    return summary.agg(
        F.sum("n_students").cast("long").alias("total_students"),
        F.count(F.lit(1)).alias("n_clusters"),
        F.avg("dropout_rate").alias("avg_dropout_rate"),
        F.min_by("cluster", F.struct(-F.col("n_students"), F.col("cluster"))).alias("largest_cluster"),
        F.min_by("cluster", F.struct(-F.col("dropout_rate"), F.col("cluster"))).alias("riskiest_cluster"),
        F.median("avg_score").alias("median_avg_score"),
        F.median("active_days").alias("median_active_days"),
        F.median("total_clicks").alias("median_total_clicks"))


def cluster_profiles(summary: DataFrame) -> DataFrame:
    """F13 + F14: risk badge and engagement / achievement levels per cluster,
    against the medians of the (rounded) cluster means. The summary holds one
    row per label (at most six), so the medians come from a window over it."""
    from pyspark.sql import Window
    w = Window.partitionBy()
    q_s = F.percentile(F.col("avg_score"), 0.5).over(w)
    q_a = F.percentile(F.col("active_days"), 0.5).over(w)
    q_c = F.percentile(F.col("total_clicks"), 0.5).over(w)
    hi, mid, lo = S.LEVEL_LABELS
    x = summary.select("*", q_s.alias("q_score"), q_a.alias("q_active"), q_c.alias("q_clicks"))
    engagement = (F.when((F.col("active_days") < F.col("q_active") * S.ENGAGEMENT_LOW_FACTOR)
                         | (F.col("total_clicks") < F.col("q_clicks") * S.ENGAGEMENT_LOW_FACTOR), F.lit(lo))
                   .when((F.col("active_days") >= F.col("q_active"))
                         & (F.col("total_clicks") >= F.col("q_clicks")), F.lit(hi))
                   .otherwise(F.lit(mid)))
    achievement = (F.when(F.col("avg_score") < F.col("q_score") * S.ACHIEVEMENT_LOW_FACTOR, F.lit(lo))
                    .when(F.col("avg_score") >= F.col("q_score"), F.lit(hi))
                    .otherwise(F.lit(mid)))
    return x.select("cluster", "n_students", "dropout_rate",
                    engagement.alias("engagement"), achievement.alias("achievement"),
                    risk_badge("dropout_rate").alias("risk"))


def profile_minmax(c: DataFrame) -> DataFrame:
    """Unrounded cluster means, min-max scaled across clusters per
    feature; a constant feature scales to 0."""
    from pyspark.sql import Window
    x = c.withColumn("cluster", cluster_label("cluster_id"))
    m = x.groupBy("cluster").agg(*[F.avg(f).alias(f) for f in CLUSTER_ATTRS])
    w = Window.partitionBy()
    cols = []
    for f in CLUSTER_ATTRS:
        lo, hi = F.min(f).over(w), F.max(f).over(w)
        cols.append(F.coalesce(F.try_divide(F.col(f) - lo, hi - lo), F.lit(0.0)).alias(f))
    return m.select("cluster", *cols)


def cluster_share(c: DataFrame) -> DataFrame:
    """Share of enrolment rows per cluster label."""
    from pyspark.sql import Window
    x = c.withColumn("cluster", cluster_label("cluster_id"))
    g = x.groupBy("cluster").agg(F.count("id_student").alias("n_students"))
    total = F.sum("n_students").over(Window.partitionBy())
    return g.select("cluster", "n_students", (F.col("n_students") / total).alias("share"))


def cluster_scatter(c: DataFrame) -> DataFrame:
    """C4: row-level points for the activity-vs-score scatter."""
    return c.select("id_student", "active_days", "avg_score", "total_clicks",
                    cluster_label("cluster_id").alias("cluster"), "dropout")


def dropout_by_cluster(assign: DataFrame) -> DataFrame:
    """Mean dropout per cluster id at enrolment grain."""
    return (assign.groupBy("cluster_id")
                  .agg(F.avg(F.col("dropout").cast("double")).alias("dropout_rate"),
                       F.count(F.lit(1)).alias("n_rows")))


def lookup_first(students: DataFrame, ids: DataFrame) -> DataFrame:
    """For each requested id, the student's first enrolment (by module,
    presentation) with its actual label. Semi-join first, then one min_by per
    student, so only requested students are aggregated."""
    wanted = ids.select("id_student").distinct()
    s = students.join(wanted, "id_student", "left_semi")
    first = (s.groupBy("id_student")
              .agg(F.min_by(F.struct("code_module", "code_presentation", "dropout"),
                            F.struct("code_module", "code_presentation")).alias("_f"))
              .select("id_student", "_f.code_module", "_f.code_presentation", "_f.dropout"))
    return ids.join(first, "id_student").select("request_id", "id_student", "code_module",
                                                "code_presentation", "dropout")


def rank_rates(rates: DataFrame) -> DataFrame:
    """O1: rank of each group within (model, attribute) by rate desc, value asc.
    The input is already aggregated (one row per attribute value)."""
    from pyspark.sql import Window
    w = Window.partitionBy("display_model", "attribute").orderBy(F.desc("rate_pct"), "value")
    return rates.withColumn("rank", F.row_number().over(w))


def prediction_reports(predictions: DataFrame, students: DataFrame, materialize: bool = True) -> dict:
    """The prediction page in one go: J1 is built once (written as parquet in
    the shared checkpoint folder, cutting its lineage) and the KPIs, scores,
    group rates, histogram and predicted counts are computed from it for all
    models at once, instead of re-joining per report."""
    from cohortlens.operators.evaluate import model_scores
    j = predictions_view(predictions, students)
    if materialize:
        from cohortlens.session import scratch_path
        spark = j.sparkSession
        path = scratch_path(spark, "prediction-view")
        j.write.parquet(path)
        j = spark.read.parquet(path)
    return {"model_kpis": model_kpis(j), "model_scores": model_scores(j), "group_rates": group_rates(j),
            "prob_histogram": prob_histogram(j), "predicted_counts": predicted_counts(j)}
