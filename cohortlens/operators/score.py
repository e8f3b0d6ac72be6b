"""Batch scoring of requests: defaults profile (A16), category options (A17),
request validation and completion (F15, F16, I1), scoring (I2, M7) and
saving scored rows (I3)."""
from __future__ import annotations

import struct
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens import schemas as S
from cohortlens.functions import parse_student_id, student_id_valid, within_bounds

NUMERIC = (T.IntegerType, T.LongType, T.DoubleType, T.FloatType, T.ShortType, T.DecimalType)


def _is_numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, NUMERIC)


DIGIT = 16                 # bits that one pass of a selection settles


def with_order_code(rows: DataFrame, x: str, code: str) -> DataFrame:
    """``rows`` with a 64-bit integer that orders the doubles of column ``x``: equal for equal values, larger for larger ones.

    Exponent and fraction of the magnitude side by side, with its sign: the
    exponent from a logarithm, put right by comparison with the powers of two
    around it; values below the normal range are multiples of 2^-1074. NULL and
    NaN have no code.
    """
    size, power, near = (F.col(f"__{n}") for n in ("size", "power", "near"))
    rows = (rows.withColumn("__size", F.abs(x)).withColumn("__near", F.least(F.greatest(F.floor(F.log2(size)), F.lit(-1022)), F.lit(1023)).cast("int"))
            .withColumn("__power", F.when(size < F.pow(F.lit(2.0), near), near - 1)
                        .when(size >= F.pow(F.lit(2.0), near + 1), near + 1).otherwise(near)))
    fraction = ((size / F.pow(F.lit(2.0), power) - 1) * float(1 << 52)).cast("long")
    tiny = (size * float(2 ** 537) * float(2 ** 537)).cast("long")
    rows = rows.withColumn("__size", F.when(size == 0, F.lit(0).cast("long")).when(size < 2.0 ** -1022, tiny)
                           .when(size == float("inf"), F.lit(2047 << 52)).otherwise((power + 1023).cast("long") * (1 << 52) + fraction))
    rows = rows.withColumn(code, F.when(~F.isnan(x), F.when(F.col(x) < 0, -size).otherwise(size)))
    return rows.drop("__size", "__power", "__near")


def coded_value(code: int) -> float:
    """The double of an :func:`order_code`."""
    size = struct.unpack("<d", struct.pack("<q", abs(code)))[0]
    return -size if code < 0 else size


def value_counts(df: DataFrame, numeric: list[str], other: list[str]) -> DataFrame:
    """(i, x, v, n): how often each value of each column is there, from one pass; numeric columns first, in ``x``; NULL left out.

    Counts combine before the shuffle, so it carries a row a value and map task."""
    none_x, none_v = F.lit(None).cast("double"), F.lit(None).cast("string")
    cells = [F.when(F.col(c).isNotNull(), F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("x"), none_v.alias("v")))
             for i, c in enumerate(numeric)]
    cells += [F.when(F.col(c).isNotNull(), F.struct(F.lit(i).alias("i"), none_x.alias("x"), F.col(c).cast("string").alias("v")))
              for i, c in enumerate(other, len(numeric))]
    each = df.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).select("c.*")
    return each.groupBy("i", "x", "v").agg(F.count(F.lit(1)).alias("n"))


def medians(df: DataFrame, cols: list[str]) -> dict:
    """Exact interpolated medians of numeric columns; NULL and NaN are no values."""
    return medians_of(value_counts(df, cols, []), cols) if cols else {}


def medians_of(values: DataFrame, cols: list[str]) -> dict:
    """Medians of the numeric columns of :func:`value_counts` by radix selection, whatever the number of values.

    Distinct values become 64-bit codes in their order. A pass sums up, for all
    columns together, the counts by the next 16 bits of the codes that share the bits
    settled so far with a middle rank, and settles them; four passes give the whole
    code. No value is sorted; a pass leaves at most 65,536 sums a column and rank.
    """
    if not cols:
        return {}
    codes = with_order_code(values.where(F.col("x").isNotNull()).select("i", "x", "n"), "x", "code")
    codes = codes.where("code is not null").select("i", "code", "n").persist()
    try:
        return _radix_medians(codes, cols)
    finally:
        codes.unpersist()


def _radix_medians(codes: DataFrame, cols: list[str]) -> dict:
    # (column, which middle rank) -> (bits settled, rank left among the codes that share them)
    ranks: dict[tuple[int, int], tuple[int, int | None]] = {(i, m): (0, None) for i in range(len(cols)) for m in (0, 1)}
    for step in range(64 // DIGIT):
        shift = 64 - DIGIT * (step + 1)
        rows = codes
        if step:
            settled = [(F.col("i") == i) & (F.shiftright("code", shift + DIGIT) == p) for i, p in sorted({(i, p) for (i, _), (p, _) in ranks.items()})]
            rows = codes.where(reduce(or_, settled))
        counts = rows.groupBy("i", F.shiftright("code", shift).alias("digits")).agg(F.sum("n").alias("n"))
        group = Window.partitionBy("i", F.shiftright("digits", DIGIT) if step else F.lit(0))
        upto = group.orderBy("digits").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counts = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(group))
        wanted = F.lit(False)
        if step == 0:    # the number of values gives the middle ranks
            for rank in (F.expr("(all - 1) div 2"), F.expr("all div 2")):
                wanted = wanted | ((rank >= F.col("upto") - F.col("n")) & (rank < F.col("upto")))
        else:
            for (i, _), (prefix, rank) in ranks.items():
                wanted = wanted | ((F.col("i") == i) & (F.shiftright("digits", DIGIT) == prefix)
                                   & (F.lit(rank) >= F.col("upto") - F.col("n")) & (F.lit(rank) < F.col("upto")))
        found = counts.where(wanted).collect()          # at most two rows a column
        settled_now = {}
        for (i, m), (prefix, rank) in ranks.items():
            for r in found:
                left = ((r["all"] - 1) // 2 if m == 0 else r["all"] // 2) if step == 0 else rank
                if r["i"] == i and (step == 0 or r["digits"] >> DIGIT == prefix) and r["upto"] - r["n"] <= left < r["upto"]:
                    settled_now[i, m] = (r["digits"], left - (r["upto"] - r["n"]))
        ranks = settled_now
        if not ranks:
            break
    out = {}
    for i, c in enumerate(cols):
        if (i, 0) in ranks:
            low, high = (coded_value(ranks[i, m][0]) for m in (0, 1))
            out[c] = low if low == high else low + (high - low) * 0.5
        else:
            out[c] = None
    return out


def modes(df: DataFrame, cols: list[str]) -> dict:
    """The most frequent value of each column (ties: the smallest; NULL skipped)."""
    return modes_of(value_counts(df, [], cols), cols, 0) if cols else {}


def modes_of(values: DataFrame, cols: list[str], first: int) -> dict:
    """Modes of the columns of :func:`value_counts` from number ``first``."""
    best = values.where(F.col("i") >= first).groupBy("i").agg(F.min_by("v", F.struct(-F.col("n"), "v")).alias("v")).collect()   # a row a column
    found = {cols[r["i"] - first]: r["v"] for r in best}
    return {c: found.get(c) for c in cols}


def defaults_profile(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """One row; numeric column -> median (interpolated), other -> mode
    (smallest value on ties), NULLs skipped.

    Medians are exact (``medians``); ``approx=True`` uses ``percentile_approx``.
    """
    num = [c for c in cols if _is_numeric(df, c)]
    cat = [c for c in cols if c not in num]
    if approx and num:
        med = df.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, 100000).alias(c) for c in num]).first().asDict()
        most = modes(df, cat)
    else:
        counts = value_counts(df, num, cat).persist()      # the only pass over the frame, which may be a join
        try:
            med, most = medians_of(counts, num), modes_of(counts, cat, len(num))
        finally:
            counts.unpersist()
    values = [float(med[c]) if med.get(c) is not None else None for c in num] + [most[c] for c in cat]
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in num] + [T.StructField(c, T.StringType()) for c in cat])
    out = df.sparkSession.createDataFrame([tuple(values)], schema)
    return out.select(*[F.col(c).cast(df.schema[c].dataType) if c in cat else F.col(c) for c in cols])


def distinct_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """Sorted distinct non-NULL options of several categorical columns,
    from one unpivot + one distinct aggregation."""
    stack = "stack({n}, {a}) AS (column_name, value)".format(
        n=len(cols), a=", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in cols))
    return (df.select(F.expr(stack)).where(F.col("value").isNotNull()).distinct()
              .orderBy("column_name", "value"))


def cardinalities(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct count + 1 per categorical column, one aggregation.

    ``size(collect_set)`` per column: the sets hold the categories (bounded),
    merged map-side -- instead of one Expand copy of every row per column
    that several ``countDistinct`` would need."""
    return df.agg(*[(F.size(F.collect_set(c)) + 1).cast("int").alias(c) for c in cols])


def validate_ranges(req: DataFrame, bounds: dict) -> DataFrame:
    """F16: count of supplied features outside their input bounds; a NULL
    feature means 'use the default' and is not checked."""
    bad = [F.when(within_bounds(c, lo, hi), 0).otherwise(1) for c, (lo, hi) in bounds.items() if c in req.columns]
    n = bad[0]
    for b in bad[1:]:
        n = n + b
    return req.withColumns({"n_out_of_range": n.cast("int"), "in_range": n == 0})


def complete_requests(req: DataFrame, defaults: DataFrame, feature_cols: list[str],
                      bounds: dict | None = None, options: dict[str, list[str]] | None = None) -> DataFrame:
    """I1 (+F15, F16): fill each missing feature of a request from the
    one-row defaults profile and flag invalid requests (``accepted``, and
    ``reject_reason`` for those that are not). ``options`` are the categories
    allowed for a column.

    The profile is a fitted one-row statistic (like an imputer's surrogate
    values): it is read once and applied as literals, so the request side is
    a narrow projection with no join at all."""
    row = defaults.first()
    d = row.asDict() if row is not None else {}
    filled = {}
    for c in feature_cols:
        dt = defaults.schema[c].dataType
        filled[c] = F.coalesce(F.col(c).cast(dt), F.lit(d.get(c)).cast(dt))
    x = req.withColumns(filled)
    x = x.withColumns({"id_student": parse_student_id("student_id_text"),
                       "id_valid": student_id_valid("student_id_text")})
    if bounds:
        x = validate_ranges(x, bounds)
    else:
        x = x.withColumns({"n_out_of_range": F.lit(0), "in_range": F.lit(True)})
    reason = F.concat_ws("; ", F.when(~F.col("id_valid"), "student id"), F.when(~F.col("in_range"), "feature out of range"),
                         *([F.when(~known_values(x, options), "unknown category")] if options else []))
    return x.withColumns({"accepted": reason == "", "reject_reason": F.when(reason != "", reason)})


def known_values(req: DataFrame, options: dict[str, list[str]]):
    """Whether every category of a request is NULL or one of the listed options."""
    ok = F.lit(True)
    for c, values in options.items():
        if c in req.columns:
            ok = ok & F.coalesce(F.col(c).cast("string").isin(list(values)), F.lit(True))
    return ok


def decision(prob_col: str = "probability", rule: str = ">=", threshold: float = 0.5):
    """M7: predicted class from the class-1 probability: boosted models use
    ``>=``, library ``predict`` (forest, logistic) sends ties to class 0 (``>``)."""
    p = F.col(prob_col)
    return F.when(p >= threshold if rule == ">=" else p > threshold, 1).otherwise(0).cast("int")


def score(model, df: DataFrame, rule: str = ">=") -> DataFrame:
    """Class-1 probability and predicted flag from a fitted PipelineModel."""
    from pyspark.ml.functions import vector_to_array
    out = model.transform(df)
    out = out.withColumn("probability", vector_to_array("probability").getItem(1))
    return out.withColumn("predicted", decision("probability", rule))
