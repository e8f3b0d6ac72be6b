"""Classifier evaluation as aggregations: exact ROC-AUC (A5), hold-out
metrics (A4, A6), confusion matrix (A7) and classification report (A8)."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions import round_to
from cohortlens.functions.expressions import safe_ratio
from cohortlens.session import scratch_path


def exact_auc(df: DataFrame, group_cols: list[str], score: str = "probability", label: str = "label") -> DataFrame:
    """A5: exact rank AUC (ties count 1/2) per group, fully distributed.

    AUC = sum(pos * (neg_below + neg_tied / 2)) / (P * N), NULL when a group
    has only one class.

    1. Rows collapse to distinct (group, score) with positive and negative counts
       (partial aggregation: raw rows never reach one task).
    2. These are range-partitioned by (group, score) and written; a row keeps the
       number of its range. Each score is there once, so ranges are of like size
       however the scores crowd, and no score lies on both sides of an edge.
    3. ``neg_below`` is the negatives of the group's earlier ranges, from one row a
       range and group, and a running sum within the range.
    """
    if not group_cols:
        return exact_auc(df.withColumn("_all", F.lit(1)), ["_all"], score, label).drop("_all")
    distinct = (df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
                .groupBy(*group_cols, score)
                .agg(F.sum(F.col(label).cast("long")).alias("_np"), F.sum(1 - F.col(label).cast("long")).alias("_nn")))
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "auc-ranges")
    ranged = distinct.repartitionByRange(*group_cols, score).withColumn("_range", F.spark_partition_id())
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    earlier = Window.partitionBy(*group_cols).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranged.groupBy(*group_cols, "_range").agg(F.sum("_nn").alias("_total"))
               .withColumn("_before", F.coalesce(F.sum("_total").over(earlier), F.lit(0))))
    inside = Window.partitionBy(*group_cols, "_range").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    within = (ranged.withColumn("_below", F.coalesce(F.sum("_nn").over(inside), F.lit(0)))
              .groupBy(*group_cols, "_range")
              .agg(F.sum(F.col("_np") * (F.col("_below") + F.col("_nn") / 2.0)).alias("_pairs"), F.sum("_np").alias("_p")))
    same = [within[c].eqNullSafe(offsets[c]) for c in (*group_cols, "_range")]
    joined = within.join(offsets, same).select(*[within[c] for c in group_cols], "_pairs", "_p", "_before", "_total")
    # products in double: P * N overflows a long beyond ~3e9 rows per class
    sums = joined.groupBy(*group_cols).agg(
        F.sum(F.col("_pairs") + F.col("_p").cast("double") * F.col("_before")).alias("_won"),
        F.sum("_p").alias("_p"), F.sum("_total").alias("_n"))
    return sums.select(*group_cols, safe_ratio(F.col("_won"), F.col("_p").cast("double") * F.col("_n")).alias("auc"))


def _counts(df: DataFrame, group_cols, label, pred):
    y, p = F.col(label), F.col(pred)
    c = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    return (df.where(y.isNotNull() & p.isNotNull())
              .groupBy(*group_cols)
              .agg(c((y == 1) & (p == 1)).alias("tp"), c((y == 0) & (p == 1)).alias("fp"),
                   c((y == 1) & (p == 0)).alias("fn"), c((y == 0) & (p == 0)).alias("tn")))


def _f1(tp, fp, fn):
    return F.coalesce(safe_ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0))


def holdout_metrics(df: DataFrame, group_cols: list[str], label: str = "label",
                    pred: str = "predicted", score: str = "probability") -> DataFrame:
    """Accuracy, F1, precision, recall (undefined -> 0) and exact AUC per group."""
    if not group_cols:
        return holdout_metrics(df.withColumn("_all", F.lit(1)), ["_all"], label, pred, score).drop("_all")
    c = _counts(df, group_cols, label, pred)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    m = c.select(*group_cols,
                 safe_ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
                 _f1(tp, fp, fn).alias("f1"),
                 F.coalesce(safe_ratio(tp, tp + fp), F.lit(0.0)).alias("precision"),
                 F.coalesce(safe_ratio(tp, tp + fn), F.lit(0.0)).alias("recall"),
                 (tp + fp + fn + tn).alias("n_rows"))
    return m.join(exact_auc(df.where(F.col(pred).isNotNull()), group_cols, score, label),
                  group_cols, "left")


def model_scores(j: DataFrame) -> DataFrame:
    """A4: per display model over rows with a known label: F1, AUC, accuracy,
    4 decimals, sorted by AUC descending. Models without labels are absent."""
    from cohortlens.operators.report import with_display_model
    d = with_display_model(j).where(F.col("dropout").isNotNull())
    m = holdout_metrics(d, ["display_model"], label="dropout")
    return (m.select("display_model", round_to("f1", 4).alias("f1"), round_to("auc", 4).alias("auc"),
                     round_to("accuracy", 4).alias("accuracy"))
             .orderBy(F.desc_nulls_last("auc"), "display_model"))


def confusion_matrix(df: DataFrame, group_cols: list[str], label: str = "label",
                     pred: str = "predicted") -> DataFrame:
    """The four cells per group, zeros kept (conditional sums + stack)."""
    c = _counts(df, group_cols, label, pred)
    cells = "stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) AS (actual, predicted, n_rows)"
    return c.select(*group_cols, F.expr(cells)).select(
        *group_cols, F.col("actual").cast("int").alias("actual"),
        F.col("predicted").cast("int").alias("predicted"), F.col("n_rows").cast("long").alias("n_rows"))


def classification_report(df: DataFrame, group_cols: list[str], label: str = "label",
                          pred: str = "predicted") -> DataFrame:
    """Per-class precision / recall / F1 / support plus accuracy, macro and
    weighted averages (undefined ratios -> 0), one pass over the data."""
    c = _counts(df, group_cols, label, pred)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    z = lambda e: F.coalesce(e, F.lit(0.0))
    p1, r1 = z(safe_ratio(tp, tp + fp)), z(safe_ratio(tp, tp + fn))
    p0, r0 = z(safe_ratio(tn, tn + fn)), z(safe_ratio(tn, tn + fp))
    f1_1, f1_0 = _f1(tp, fp, fn), _f1(tn, fn, fp)
    s1, s0 = tp + fn, tn + fp
    n = s0 + s1
    w = lambda a, b: z(safe_ratio(a * s0 + b * s1, n))
    acc = z(safe_ratio(tp + tn, n))
    x = c.select(*group_cols,
                 p0.alias("p0"), r0.alias("r0"), f1_0.alias("f0"), s0.alias("s0"),
                 p1.alias("p1"), r1.alias("r1"), f1_1.alias("f1"), s1.alias("s1"),
                 acc.alias("acc"), n.alias("n"),
                 ((p0 + p1) / 2).alias("pm"), ((r0 + r1) / 2).alias("rm"), ((f1_0 + f1_1) / 2).alias("fm"),
                 w(p0, p1).alias("pw"), w(r0, r1).alias("rw"), w(f1_0, f1_1).alias("fw"))
    rows = ("stack(5, '0', p0, r0, f0, s0, '1', p1, r1, f1, s1, 'accuracy', acc, acc, acc, n, "
            "'macro avg', pm, rm, fm, n, 'weighted avg', pw, rw, fw, n) "
            "AS (class, precision, recall, f1, support)")
    return x.select(*group_cols, F.expr(rows)).select(
        *group_cols, "class", "precision", "recall", "f1", F.col("support").cast("long").alias("support"))


def class_balance(df: DataFrame, label: str = "dropout") -> DataFrame:
    """Boosted-model positive weight neg / max(pos, 1) and 'balanced'
    class weights n / (2 * n_c), from one aggregation over the whole set."""
    y = F.col(label)
    c = df.agg(F.sum(F.when(y == 1, 1).otherwise(0)).cast("long").alias("n_pos"),
               F.sum(F.when(y == 0, 1).otherwise(0)).cast("long").alias("n_neg"))
    n = F.col("n_pos") + F.col("n_neg")
    return c.select("n_pos", "n_neg",
                    (F.col("n_neg") / F.greatest(F.col("n_pos"), F.lit(1))).alias("scale_pos_weight"),
                    safe_ratio(n, 2 * F.col("n_neg")).alias("weight_neg"),
                    safe_ratio(n, 2 * F.col("n_pos")).alias("weight_pos"))
