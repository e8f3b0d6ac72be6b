"""Distributed model training and tuning.

Tree ensembles are grown by ``boosting``, the logistic model is fitted by
``linear_model`` and the neural one by MLlib. Every model's
features come from a ``Pipeline``: stateless encodings as a ``SQLTransformer``
(binary maps, ordinal codes, fixed scaling), fitted encoders
(``StringIndexer`` / ``OneHotEncoder``), ``VectorAssembler`` and the
classifier. The fitted ``PipelineModel`` therefore scores raw request rows
with the encoders learned at fit time (no re-encoding of the whole table).
"""
from __future__ import annotations

import random

from pyspark.ml import Pipeline
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens import schemas as S
from cohortlens.operators.boosting import fit_trees
from cohortlens.operators.encode import assembler, logistic_columns, one_hot_stages
from cohortlens.operators.evaluate import holdout_metrics
from cohortlens.operators.linear_model import LinearModel, fit as fit_logistic, vector_names
from cohortlens.operators.score import decision
from cohortlens.operators.split import assign_folds, stratified_split
from cohortlens.plans.sqlgen import ordinal_sql
from cohortlens.session import landed

# ---------------------------------------------------------------------------
# Model names and the reference's search spaces.
# ---------------------------------------------------------------------------
MODEL_NAMES = {"logistic": "logistic_dropout", "random_forest": "random_forest",
               "boosted_a": "xgboost_dropout", "boosted_b": "catboost_dropout", "neural": "tabnet"}
EXPERIMENTS = {"logistic": "student_dropout_logistic_v2", "random_forest": "random-forest-prediction-v2",
               "boosted_a": "xgboost_stu_vle_v2", "boosted_b": "catboost_stu_vle_v2",
               "neural": "tabnet-dropout-prediction", "clustering": "student-clustering-analysis"}
LOGISTIC_C, LOGISTIC_MAX_ITER = 0.5, 1000
# random forest: ("int", lo, hi) is a uniform integer range, a list is a choice
RF_SPACE = {"n_estimators": ("int", 100, 300), "max_depth": [5, 8, 10, 12, 15],
            "min_samples_split": ("int", 2, 20), "min_samples_leaf": ("int", 1, 10),
            "bootstrap": [True, False], "class_weight": [None, "balanced"]}
BOOSTED_A_SPACE = {"n_estimators": [500, 700, 1000], "max_depth": [4, 5, 6], "learning_rate": [0.01, 0.05],
                   "subsample": [0.7, 0.8, 0.9], "colsample_bytree": [0.6, 0.7, 0.8],
                   "min_child_weight": [1, 3, 5], "gamma": [0, 0.1, 0.3]}
BOOSTED_B_SPACE = {"iterations": [500, 700, 1000], "depth": [4, 5, 6, 8], "learning_rate": [0.01, 0.05, 0.1],
                   "l2_leaf_reg": [1, 3, 5, 10], "bagging_temperature": [0, 0.5, 1.0],
                   "border_count": [32, 64, 128]}
NEURAL_EPOCHS, NEURAL_STEP, NEURAL_PATIENCE = 200, 10, 30   # ours: the reference's epochs are minibatch passes
ROWS_PER_BUCKET = 50_000  # rows that permutation importance ranks in one task, about
SEARCH_SIZES = {"random_forest": (10, 5), "boosted_a": (20, 3), "boosted_b": (20, 3)}  # (candidates, folds)

# ---------------------------------------------------------------------------
# Feature pipelines
# ---------------------------------------------------------------------------
_BIN = ("CASE WHEN gender = 'M' THEN 1 WHEN gender = 'F' THEN 0 END",
        "CASE WHEN disability = 'Y' THEN 1 WHEN disability = 'N' THEN 0 END")
_ORDERS = {"imd_band": S.IMD_ORDER, "age_band": S.AGE_ORDER, "highest_education": S.EDU_ORDER}


def _tree_prep(imd_default: str | None = None) -> SQLTransformer:
    """F7 + F8 + E1 as one stateless stage (all NULL-safe; unknown -> -1)."""
    imd = f"coalesce(imd_band, '{imd_default}')" if imd_default else "imd_band"
    ords = ", ".join(f"CAST({ordinal_sql(src if c != 'imd_band' else imd, _ORDERS[c])} AS DOUBLE) AS {c}_ord"
                     for c, src in [(c, c) for c in S.ORDINAL_FEATURES])
    noms = ", ".join(f"coalesce(CAST({c} AS STRING), 'None') AS {c}_str" for c in S.NOMINAL_FEATURES)
    return SQLTransformer(statement=(
        f"SELECT *, CAST(coalesce({_BIN[0]}, -1) AS DOUBLE) AS gender_bin, "
        f"CAST(coalesce({_BIN[1]}, -1) AS DOUBLE) AS disability_bin, {ords}, {noms} FROM __THIS__"))


def _encoded_name(c: str) -> str:
    if c in S.BINARY_FEATURES:
        return c + "_bin"
    if c in S.ORDINAL_FEATURES:
        return c + "_ord"
    if c in S.NOMINAL_FEATURES:
        return c + "_idx"
    return c


def tree_stages(feature_cols: list[str], imd_default: str | None = None) -> list:
    """E7 / E8 for the tree models: every feature numeric, fixed column order."""
    from pyspark.ml.feature import StringIndexer
    idx = [StringIndexer(inputCol=c + "_str", outputCol=c + "_idx", stringOrderType="alphabetAsc",
                         handleInvalid="keep") for c in S.NOMINAL_FEATURES if c in feature_cols]
    return [_tree_prep(imd_default), *idx, assembler([_encoded_name(c) for c in feature_cols])]


def logistic_stages(train: DataFrame, columns: list[str]) -> list:
    """E3 + E5 + E9: ordinal codes, one-hot nominal, numeric / population std."""
    ordinal, nominal, numeric = logistic_columns(columns)
    st = train.agg(*[F.stddev_pop(c).alias(c) for c in numeric]).first().asDict() if numeric else {}
    scale = ", ".join(f"CAST({c} AS DOUBLE) / {float(st[c]) if st.get(c) not in (None, 0.0) else 1.0} AS {c}_sc"
                      for c in numeric)
    ords = ", ".join(f"CAST({ordinal_sql(c, _ORDERS[c])} AS DOUBLE) AS {c}_ord" for c in ordinal)
    sel = ", ".join(x for x in [ords, scale] if x)
    prep = SQLTransformer(statement=f"SELECT *{', ' + sel if sel else ''} FROM __THIS__")
    ohe = one_hot_stages(nominal)
    cols = [c + "_ord" for c in ordinal] + [c + "_ohe" for c in nominal] + [c + "_sc" for c in numeric]
    return [prep, *ohe, assembler(cols)]


# ---------------------------------------------------------------------------
# Search
# ---------------------------------------------------------------------------
def sample_space(space: dict, n: int, seed: int = S.RANDOM_STATE) -> list[dict]:
    """M5: n parameter sets sampled with a seed (driver side, tiny)."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        d = {}
        for k, v in space.items():
            d[k] = rng.randint(v[1], v[2]) if isinstance(v, tuple) else rng.choice(v)
        out.append(d)
    return out


# ---------------------------------------------------------------------------
# Training entry points
# ---------------------------------------------------------------------------
def with_weights(df: DataFrame, label: str = "dropout") -> DataFrame:
    """A18 applied: label as double, a balanced weight, the boosted positive
    weight and a unit weight (one aggregation, one row to the driver)."""
    c = df.agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"),
               F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("n")).first()
    p, n = int(c["p"] or 0), int(c["n"] or 0)
    tot = p + n
    wb1, wb0 = (tot / (2.0 * p) if p else 1.0), (tot / (2.0 * n) if n else 1.0)
    spw = n / max(p, 1)
    y = F.col(label)
    return df.withColumns({
        "label": y.cast("double"),
        "w_balanced": F.when(y == 1, F.lit(wb1)).otherwise(F.lit(wb0)),
        "w_pos": F.when(y == 1, F.lit(float(spw))).otherwise(F.lit(1.0)),
        "w_one": F.lit(1.0)})


def split(df: DataFrame, key: str = "enrol_key", label: str = "dropout", materialize: bool = True):
    """Exact 20% test per class, deterministic.

    With ``materialize`` the labelled frame is written once as parquet in the
    shared checkpoint folder and read back: every later fit, CV fold and
    evaluation reads those files instead of recomputing the feature lineage,
    and a lost executor only re-reads a file split."""
    s = stratified_split(df, key, label, S.TEST_SIZE, S.RANDOM_STATE, exact=True)
    if materialize:
        from cohortlens.session import scratch_path
        spark = df.sparkSession
        path = scratch_path(spark, "split")
        s.write.parquet(path)
        s = spark.read.parquet(path)
    return s.where(~F.col("is_test")).drop("is_test"), s.where(F.col("is_test")).drop("is_test")


def fit_neural(rows: DataFrame, layers: list[int], epochs: int = NEURAL_EPOCHS, step: int = NEURAL_STEP,
               patience: int = NEURAL_PATIENCE):
    """(the network of the best validation AUC, its epochs), with early stopping.

    A fifth of the training rows, by class, validates. Training goes on from the
    last weights ``step`` epochs at a time and ends when ``patience`` epochs have
    brought no better AUC, or after ``epochs``."""
    split_rows = stratified_split(rows.where("label is not null"), "enrol_key", "label", S.TEST_SIZE, S.RANDOM_STATE + 5).persist()
    teaching, checking = split_rows.where(~F.col("is_test")), split_rows.where(F.col("is_test"))
    judge = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction", metricName="areaUnderROC", numBins=0)
    best, best_auc, best_at, weights = None, -1.0, 0, None
    try:
        for done in range(step, epochs + step, step):
            net = MultilayerPerceptronClassifier(layers=layers, maxIter=step, seed=S.RANDOM_STATE, featuresCol="features_sc")
            model = (net.setInitialWeights(weights) if weights is not None else net).fit(teaching)
            weights = model.weights
            auc = judge.evaluate(model.transform(checking))
            if auc > best_auc:
                best, best_auc, best_at = model, auc, done
            elif done - best_at >= patience:
                break
    finally:
        split_rows.unpersist()
    return best, best_at


def train_model(kind: str, df: DataFrame, search: tuple[int, int] | None = None,
                space: dict | None = None, params: dict | None = None):
    """Train one of the five model slots and score its test split.

    ``params`` states the hyperparameters of a forest or boosted model; without
    them they are searched for.

    ``df`` is the students frame (full-course models) or the early frame
    (boosted models). Returns dict(model, test_scored, metrics, params).
    """
    d = with_weights(landed(df, "training-frame"))      # the weights, the cutoffs and the split each read it
    train, test = split(d)
    train = train.persist()
    try:
        if kind == "logistic":
            cols = [c for c in df.columns if c not in ("id_student", "dropout", "enrol_key")]
            prep = Pipeline(stages=logistic_stages(train, cols)).fit(train)
            rows = prep.transform(train)
            names = vector_names(rows)
            rows = rows.where("label is not null").select(vector_to_array("features").alias("x"), F.col("label").alias("y"),
                                                          F.col("w_balanced").alias("weight"))
            w, _ = fit_logistic(rows, len(names), LOGISTIC_C)
            model = LinearModel(prep, names, w[:-1], w[-1])
            params, rule = {"C": LOGISTIC_C, "max_iter": LOGISTIC_MAX_ITER, "class_weight": "balanced"}, ">"
        elif kind in SEARCH_SIZES:
            n_iter, folds = search or SEARCH_SIZES[kind]
            features = S.FEATURE_COLS if kind == "random_forest" else S.EARLY_FEATURE_COLS
            space = space or {"random_forest": RF_SPACE, "boosted_a": BOOSTED_A_SPACE, "boosted_b": BOOSTED_B_SPACE}[kind]
            candidates = None if params else sample_space(space, n_iter)
            model, params, _ = fit_trees(kind, train, tree_stages(features), features, params, candidates, folds)
            rule = ">" if kind == "random_forest" else ">="
        elif kind == "neural":
            # nominal columns enter one-hot, the others as codes and numbers
            from pyspark.ml import PipelineModel
            from pyspark.ml.feature import MinMaxScaler, VectorAssembler
            nominal = [c for c in S.NOMINAL_FEATURES if c in S.FEATURE_COLS]
            rest = tree_stages([c for c in S.FEATURE_COLS if c not in nominal], imd_default=S.DEFAULT_IMD)
            rest[-1] = rest[-1].copy().setOutputCol("plain")
            stages = [*rest, *one_hot_stages(nominal),
                      VectorAssembler(inputCols=["plain", *[f"{c}_ohe" for c in nominal]], outputCol="features"),
                      MinMaxScaler(inputCol="features", outputCol="features_sc")]
            prep = Pipeline(stages=stages).fit(train)
            width = len(prep.stages[-1].originalMin)
            fitted, epochs = fit_neural(prep.transform(train).select("enrol_key", "label", "features_sc"), [width, 16, 16, 2])
            model = PipelineModel(stages=[*prep.stages, fitted])
            params, rule = {"layers": "16x16", "max_epochs": NEURAL_EPOCHS, "patience": NEURAL_PATIENCE, "epochs": epochs}, ">="
        else:
            raise ValueError(kind)
    finally:
        train.unpersist()
    scored = model.transform(test).withColumn("probability", vector_to_array("probability").getItem(1))
    scored = scored.withColumn("predicted", decision("probability", rule))
    scored = landed(scored.select(*test.columns, "probability", "predicted"), "scored")     # scored once
    m = holdout_metrics(scored, [], label="dropout").first().asDict()
    return {"model": model, "test_scored": scored, "metrics": m, "params": params, "rule": rule}


def emit_predictions(scored: DataFrame, model_name: str, run_id: str) -> DataFrame:
    """M8: held-out rows in the predictions layout."""
    return scored.select(F.col("id_student").cast("long"), F.lit(model_name).alias("model_name"),
                         F.col("predicted").cast("int"), F.col("probability").cast("double"),
                         F.lit(run_id).alias("run_id"))


def permutation_importance(model, df: DataFrame, feature_cols: list[str], key: str = "enrol_key",
                           seed: int = S.RANDOM_STATE, buckets: int | None = None) -> DataFrame:
    """Distributed permutation importance: per feature, the column is
    permuted and the drop in exact AUC reported.

    The permutation never ranks the whole frame in one task: rows are spread
    over ``buckets`` hash buckets of the key, and inside each bucket the row
    with the i-th smallest key receives the value of the row with the i-th
    smallest seeded hash -- a bijection within every bucket."""
    from pyspark.sql import Window

    from cohortlens.operators.evaluate import exact_auc
    from cohortlens.operators.split import key_hash

    def auc_of(frame):
        s = model.transform(frame).withColumn("probability", vector_to_array("probability").getItem(1))
        return exact_auc(s, [], "probability", "dropout").first()["auc"]

    base = auc_of(df)
    if buckets is None:  # a bounded number of rows is ranked in one task
        buckets = max(16, -(-df.count() // ROWS_PER_BUCKET))
    b = F.pmod(key_hash(key, seed), F.lit(buckets))
    x = df.withColumn("_bk", b)
    x = (x.withColumn("_r", F.row_number().over(Window.partitionBy("_bk").orderBy(key)))
          .withColumn("_r2", F.row_number().over(Window.partitionBy("_bk").orderBy(key_hash(key, seed + 7), key))))
    # every row meets its donor once; the permuted copies, tagged by feature, are made after the join
    donor = x.select("_bk", F.col("_r2").alias("_r"), F.struct(*feature_cols).alias("_v"))
    copies = x.join(donor, ["_bk", "_r"]).withColumn("feature", F.explode(F.array(*[F.lit(c) for c in feature_cols])))
    copies = copies.withColumns({c: F.when(F.col("feature") == c, F.col(f"_v.{c}")).otherwise(F.col(c)) for c in feature_cols})
    copies = copies.drop("_v", "_r", "_r2", "_bk")
    s = model.transform(copies).withColumn("probability", vector_to_array("probability").getItem(1))
    aucs = exact_auc(s, ["feature"], "probability", "dropout")
    return aucs.select("feature", (F.lit(float(base or 0.0)) - F.col("auc")).alias("auc_drop"))
