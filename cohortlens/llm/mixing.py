"""Mixing sources to target weights by weighted sampling without replacement.

Sources share a budget of words by weight, none above a multiple of its own
size. Each source first gives complete epochs; the rest of its target is drawn
by exponential keys: a document of weight w gets ``-ln(u) / w`` with u hashed
from the document, and the smallest keys go first until the budget is spent.

The budget is a prefix sum within a source. Keys are cut into ranges, range sums
are added up per source first, and only rows of one range are summed one by one,
so a source that holds most rows is spread over all its ranges.

DataFrame functions only: no Python runs on the executors.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import WORD_PATTERN, Scratch

SHARE = 1.5                 # budget as a share of all words
MOST = 2                    # a source gives at most this many times its size
CYCLE = (5.0, 2.0, 1.0)     # weights of the sources in order, repeating
RANGES = 4096
SIGNS = "*#$%&|!<>{}[]_^~@+=\\"


def word_count(text: Column) -> Column:
    """Number of words of a text (NULL: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Document weight from 0.1 to 1: the share of characters that are not signs of markup or noise."""
    plain = F.try_divide(F.length(F.translate(text, SIGNS, "")).cast("double"), F.length(text).cast("double"))
    return F.lit(0.1) + F.lit(0.9) * F.coalesce(plain, F.lit(1.0))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source_no, source, source_size, target) from per-source word totals ``sizes(source, source_size)``.

    Sources in code-point order, NULL last, weigh 5, 2, 1, repeating. What a
    capped source leaves is shared again by weight: with sources in order of
    cap per weight, the first whose cap exceeds its share of what is left sets
    the level of all after it.
    """
    cycle = F.array(*[F.lit(w) for w in CYCLE])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = (sizes.withColumn("source_no", F.row_number().over(by_name))
              .withColumn("weight", F.element_at(cycle, ((F.col("source_no") - 1) % len(CYCLE) + 1).cast("int")))
              .withColumn("cap", F.col("source_size") * MOST)
              .withColumn("fill", F.col("cap") / F.col("weight")))
    order = Window.orderBy("fill", "source_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(whole) * SHARE - F.coalesce(F.sum("cap").over(before), F.lit(0)))
             / F.sum("weight").over(onward))
    ranked = (ranked.withColumn("level", level)
              .withColumn("at", F.row_number().over(order))
              .withColumn("first", F.min(F.when(F.col("fill") > F.col("level"), F.col("at"))).over(whole))
              .withColumn("common", F.max(F.when(F.col("at") == F.col("first"), F.col("level"))).over(whole)))
    return ranked.select("source_no", "source", "source_size",
                         F.when(F.col("at") < F.coalesce(F.col("first"), F.lit(1 << 30)), F.col("cap").cast("double"))
                         .otherwise(F.col("common") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, scratch: Scratch, weight: Column | None = None) -> DataFrame:
    """Every row of ``docs(doc_id, text, source, ...)`` with size, source_size, target and taken.

    ``taken`` is the words the mix takes of the row: its size times the source's
    complete epochs, plus its part of the rest. The last document drawn may be
    taken in part. NULL and empty texts have size 0 and give nothing; NULL is a
    source of its own; a draw depends on doc_id and text, so only rows equal in
    both tie, and it does not matter which of them goes first; columns that carry
    one of the new names are replaced.
    """
    new = ["size", "source_size", "target", "taken"]
    carried = [c for c in docs.columns if c not in new]
    inner = {c: f"in_{i}" for i, c in enumerate(carried)}
    uniform = (F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col(inner["doc_id"]).cast("string"), F.lit("null")),
                                                    F.col("mark"))), 1, 12), 16, 10)
               .cast("double") + 0.5) / float(1 << 48)
    rows = docs.select(*[F.col(c).alias(x) for c, x in inner.items()], word_count(F.col("text")).alias("size"),
                       F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("mark"),
                       (quality_weight(F.col("text")) if weight is None else weight).alias("w"))
    rows = rows.withColumn("key", -F.log(uniform) / F.col("w"))
    rows = rows.withColumn("range", F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * RANGES).cast("int"))
    rows = rows.drop("w")
    rows = scratch.save(rows, "sized")
    by, doc_id = inner["source"], inner["doc_id"]

    totals = rows.groupBy(F.col(by).alias("source"), "range").agg(F.sum("size").alias("words"))
    totals = scratch.save(totals, "ranges")
    targets = scratch.save(source_targets(totals.groupBy("source").agg(F.sum("words").alias("source_size"))), "targets")
    within = Window.partitionBy("source_no").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    plan = (totals.join(targets.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named")))
            .withColumn("lead", F.coalesce(F.sum("words").over(within), F.lit(0)))
            .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                        .otherwise(F.lit(0)).cast("long"))
            .withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
            .select("named", F.col("range").alias("of_range"), "source_no", "source_size", "target", "epochs", "rest", "lead"))
    joined = rows.join(plan, F.col(by).eqNullSafe(F.col("named")) & (F.col("range") == F.col("of_range")))
    drawn = Window.partitionBy("source_no", "range").orderBy("key", doc_id, "mark").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("lead") + F.coalesce(F.sum("size").over(drawn), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - ahead))
    return joined.withColumn("taken", (F.col("epochs") * F.col("size") + part).cast("long")).select(
        *[F.col(inner[c]).alias(c) for c in carried], *new)


MIX_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
keyed AS (
  SELECT doc_id, source, size, md5(coalesce(text, '')) AS mark,
    -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT::DOUBLE + 0.5)
        / 281474976710656.0)
      / (0.1 + 0.9 * coalesce(length(translate(text, '{SIGNS}', ''))::DOUBLE / nullif(length(text), 0), 1.0)) AS key
  FROM sized),
ranged AS (SELECT *, floor((1.0 - exp(-key)) * {RANGES})::INT AS range FROM keyed),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM ranged GROUP BY source),
numbered AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS source_no FROM totals),
weighted AS (
  SELECT *, [5.0, 2.0, 1.0][((source_no - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2 AS cap FROM numbered),
filled AS (SELECT *, cap / weight AS fill FROM weighted),
levels AS (
  SELECT *, row_number() OVER (ORDER BY fill, source_no) AS place,
    ((sum(source_size) OVER ())::DOUBLE * 1.5
     - coalesce(sum(cap) OVER (ORDER BY fill, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(weight) OVER (ORDER BY fill, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM filled),
cut AS (SELECT place, level FROM levels WHERE fill > level ORDER BY place LIMIT 1),
targets AS (
  SELECT source, source_no, source_size,
    CASE WHEN place < coalesce((SELECT place FROM cut), 1073741824) THEN cap::DOUBLE
         ELSE (SELECT level FROM cut) * weight END AS target
  FROM levels),
drawn AS (
  SELECT r.doc_id, r.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS epochs,
    coalesce(sum(r.size) OVER (PARTITION BY t.source_no ORDER BY r.range, r.key, r.doc_id, r.mark
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM ranged r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target - epochs * source_size)::BIGINT - ahead)))::BIGINT AS taken
FROM drawn
"""
