"""Deterministic splitting (E4) and fold assignment (M6) without any window
over a whole class: a hash of the row key replaces the random shuffle."""
from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_SPACE = 1 << 32
HIST_SHIFT = 12  # 2^20 histogram buckets per class


def key_hash(key: str, seed: int) -> Column:
    """Unsigned 32-bit hash in [0, 2^32): first 8 hex digits of md5('<key>:<seed>').

    Chosen because DuckDB computes the identical integer, so splits are
    reproducible outside Spark."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long")


def class_cutoffs(df: DataFrame, key: str, label: str, fractions: list[Decimal], seed: int) -> list[tuple]:
    """(class, fraction number, hash, key) of the last row of each class's first ceil(f * n_c) rows in (hash, key) order.

    From a per-class histogram of the hash's top 20 bits, then the rows of the
    boundary buckets alone; both passes read the key and label columns only. The
    result has one row per class and fraction, and classes are few."""
    x = df.select(F.coalesce(F.col(label).cast("string"), F.lit("<null>")).alias("c"),
                  F.col(key).cast("long").alias("k"), key_hash(key, seed).alias("h"))
    hist = x.groupBy("c", F.shiftright("h", HIST_SHIFT).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("c")
    upto = whole.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # exact decimal product: 35 * 0.2 is 7, not 7.000000000000001
    wanted = F.array(*[F.ceil(F.sum("n").over(whole) * F.lit(f)).cast("long") for f in fractions])
    edges = (hist.withColumn("upto", F.sum("n").over(upto)).withColumn("wanted", wanted)
             .select("c", "b", F.posexplode("wanted").alias("f", "rank"), "upto", "n")
             .where("rank > upto - n and rank <= upto")
             .select("c", "b", "f", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("place")))
    boundary = x.withColumn("b", F.shiftright("h", HIST_SHIFT)).join(
        F.broadcast(edges.select("c", "b").distinct()), ["c", "b"])  # a bucket per class and fraction
    ranked = boundary.withColumn("place", F.row_number().over(Window.partitionBy("c", "b").orderBy("h", "k")))
    return [tuple(r) for r in ranked.join(F.broadcast(edges), ["c", "b", "place"]).select("c", "f", "h", "k").collect()]


def _upto_cutoff(key: str, label: str, seed: int, cutoffs: list[tuple]) -> Column:
    """Whether a row lies at or before its class's cutoff (literals, so no shuffle)."""
    h, c = key_hash(key, seed), F.coalesce(F.col(label).cast("string"), F.lit("<null>"))
    out = F.lit(False)
    for name, _, ch, ck in cutoffs:
        out = out | ((c == F.lit(name)) & ((h < ch) | ((h == ch) & (F.col(key).cast("long") <= ck))))
    return out


def stratified_split(df: DataFrame, key: str, label: str, frac: float = 0.2,
                     seed: int = 42, exact: bool = True) -> DataFrame:
    """Add ``is_test``.

    exact=False: ``hash < frac * 2^32`` -- each class gets frac in expectation.
    exact=True : exactly ceil(frac * n_c) test rows per class: the rows with the
    smallest (hash, key), compared with one cutoff per class. A NULL label is
    its own class.
    """
    if not exact:
        return df.withColumn("is_test", key_hash(key, seed) < F.lit(int(frac * HASH_SPACE)))
    cutoffs = class_cutoffs(df, key, label, [Decimal(str(frac))], seed)
    return df.withColumn("is_test", _upto_cutoff(key, label, seed, cutoffs))


def assign_folds(df: DataFrame, key: str, label: str, k: int, seed: int = 42, col: str = "fold") -> DataFrame:
    """M6: stratified folds: each class, in (hash, key) order, is cut at every k-th part."""
    cutoffs = class_cutoffs(df, key, label, [Decimal(j) / Decimal(k) for j in range(1, k)], seed + 1)
    fold = F.lit(0)
    for j in range(k - 1):
        fold = fold + F.when(_upto_cutoff(key, label, seed + 1, [x for x in cutoffs if x[1] == j]), 0).otherwise(1)
    return df.withColumn(col, fold.cast("int"))
