"""Feature encoding.

Encoders whose fit is a global statistic (std, min/max, vocabulary) compute
it with one aggregation; only that one-row result (or, for a vocabulary, the
distinct categories) reaches the driver, as in any MLlib estimator fit."""
from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens import schemas as S
from cohortlens.functions import fill_imd_default, map_binary, ordinal_code

ORDERS = {"imd_band": S.IMD_ORDER, "age_band": S.AGE_ORDER, "highest_education": S.EDU_ORDER}


def map_binaries(df: DataFrame) -> DataFrame:
    """gender M/F -> 1/0, disability Y/N -> 1/0 (others -> NULL)."""
    return df.withColumns({"gender": map_binary("gender", "M", "F"),
                           "disability": map_binary("disability", "Y", "N")})


def ordinal_encode(df: DataFrame, cols=S.ORDINAL_FEATURES) -> DataFrame:
    """Fixed-order ordinal codes; unknown and NULL -> -1."""
    return df.withColumns({c: ordinal_code(c, ORDERS[c]) for c in cols})


def label_indexers(cols=S.NOMINAL_FEATURES, suffix="_idx") -> list:
    """E2 estimators: alphabetical (code-point) codes 0..n-1; NULL is indexed
    as the string 'None' (the caller coalesces first); unseen -> n."""
    return [StringIndexer(inputCol=c, outputCol=c + suffix, stringOrderType="alphabetAsc",
                          handleInvalid="keep") for c in cols]


def none_as_string(df: DataFrame, cols=S.NOMINAL_FEATURES) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in cols})


def label_encode(df: DataFrame, cols=S.NOMINAL_FEATURES) -> DataFrame:
    """Fit + apply the label encoders, replacing each column by its int code."""
    x = none_as_string(df, cols)
    model = Pipeline(stages=label_indexers(cols)).fit(x)
    y = model.transform(x)
    return y.withColumns({c: F.col(c + "_idx").cast("int") for c in cols}).drop(*[c + "_idx" for c in cols])


def one_hot_stages(cols=S.NOMINAL_FEATURES) -> list:
    """Index + one-hot; all seen categories kept, unknown / NULL -> all zeros.

    The indexer (handleInvalid='keep') appends an '__unknown' label, so its
    metadata has n + 1 values; dropLast then removes exactly that slot and the
    vectors have one position per seen category."""
    idx = [StringIndexer(inputCol=c, outputCol=c + "_idx", stringOrderType="alphabetAsc",
                         handleInvalid="keep") for c in cols]
    ohe = OneHotEncoder(inputCols=[c + "_idx" for c in cols], outputCols=[c + "_ohe" for c in cols],
                        dropLast=True)
    return idx + [ohe]


def _one_row(df: DataFrame, exprs) -> dict:
    row = df.agg(*exprs).first()
    return row.asDict() if row is not None else {}


def scale_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """E5: divide by the population std without centring; a zero (or undefined)
    std leaves the column unchanged."""
    st = _one_row(df, [F.stddev_pop(c).alias(c) for c in cols])
    out = {}
    for c in cols:
        s = st.get(c)
        out[c] = F.col(c) / F.lit(float(s) if s not in (None, 0.0) else 1.0)
    return df.withColumns(out)


def minmax_features(df: DataFrame, cols=S.CLUSTER_FEATURES) -> DataFrame:
    """Min-max scale over all rows; a constant column scales to 0."""
    st = _one_row(df, [F.min(c).alias("min_" + c) for c in cols] + [F.max(c).alias("max_" + c) for c in cols])
    out = {}
    for c in cols:
        lo, hi = st.get("min_" + c), st.get("max_" + c)
        if lo is None or hi is None or hi == lo:
            out[c] = F.when(F.col(c).isNotNull(), F.lit(0.0))
        else:
            out[c] = (F.col(c) - F.lit(float(lo))) / F.lit(float(hi) - float(lo))
    return df.withColumns(out)


def encode(df: DataFrame, imd_default: str | None = None) -> DataFrame:
    """F7 + F8 + E1 + E2 as used by the tree models: every feature numeric."""
    x = map_binaries(df)
    if imd_default is not None:
        x = x.withColumn("imd_band", fill_imd_default("imd_band", imd_default))
    x = ordinal_encode(x)
    return label_encode(x)


def assembler(feature_cols: list[str], output: str = "features") -> VectorAssembler:
    """Fixed-order vector assembly; NULL fails loudly (validate first)."""
    return VectorAssembler(inputCols=list(feature_cols), outputCol=output, handleInvalid="error")


def logistic_columns(columns: list[str]) -> tuple[list[str], list[str], list[str]]:
    """Ordinal, nominal and numeric inputs of the logistic model.

    Every column that is not an ordinal, nominal or binary feature is numeric;
    the two binary features are mapped but belong to no transformer, so they
    are excluded (the reference's remainder='drop')."""
    used = set(S.ORDINAL_FEATURES + S.NOMINAL_FEATURES + S.BINARY_FEATURES)
    numeric = [c for c in columns if c not in used]
    return ([c for c in S.ORDINAL_FEATURES if c in columns],
            [c for c in S.NOMINAL_FEATURES if c in columns], numeric)
