"""Corpus pipeline: the documents of a training corpus, stage by stage.

``run`` applies ``STAGES`` to the whole table of documents. Every stage reads
what the stage before it kept, written as Parquet under the shared checkpoint
folder, and returns the columns of documents (the last adds the mix's columns).
Rows of a NULL doc_id, NULL or empty texts and repeated rows go through every
stage by the rules of its operator; extra columns are carried.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import decontaminate, jaccard_join, mixing, quality, suffix_dedup
from cohortlens.llm.common import Scratch, row_key, ship_package, table

#: No SQL expresses the classifier, so the pipeline is tested against brute force instead.
ORACLE_SQL = None
_ROW = "__row"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; all labels of the corpus teach it."""
    ship_package(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    columns = docs.columns
    # the classifier's columns must not clash with carried ones
    inner = docs.select(*[F.col(c).alias(f"in_{i}") for i, c in enumerate(columns)], F.col("text").alias("text"))
    scored = quality.score(inner, quality.fit(docs, labels), inner.columns[:-1])
    return scored.where("predicted = 1").select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(columns)])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: that of its smallest doc_id.

    Documents without words stay. Of equal rows one stays; of different texts
    under one id, or without an id, the first by a hash of the text stays.
    """
    rows = docs.withColumn(_ROW, row_key("doc_id", "text"))
    found = jaccard_join.jaccard_components(docs.select("doc_id", "text"), Scratch(spark, "near"), with_row=True)
    # exact rows of the winner: the smallest (doc_id, row) of each component
    best = (found.where("n_shingles > 0").groupBy("center")
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")).alias("w"))
            .select(F.col("w.node").alias(_ROW)))
    lone = found.where("n_shingles = 0").select(F.col("node").alias(_ROW)).distinct()
    kept = rows.join(best.unionByName(lone).distinct(), _ROW, "left_semi")
    return kept.dropDuplicates([_ROW]).select(*docs.columns)


def repeated_text_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the text that repeats over 200 bytes; what is emptied by that leaves."""
    columns = docs.columns
    carried = [c for c in columns if c not in ("text", "n_chars")]
    out = suffix_dedup.remove_repeats(docs, Scratch(spark, "repeats"), carry=carried)
    kept = out.where("size(runs) = 0 or length(trim(kept)) > 0").withColumnRenamed("kept", "text")
    if "n_chars" in columns:
        kept = kept.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType))
    return kept.select(*columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark passage is found."""
    ship_package(spark)
    rows = docs.withColumn(_ROW, row_key("doc_id", "text"))
    found = decontaminate.matches(rows.select(_ROW, "text"), table(spark, sf_dir, "benchmark"), [_ROW])
    return rows.join(found.select(_ROW).distinct(), _ROW, "left_anti").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents it takes words of, with size, source_size, target and taken."""
    return mixing.mix(docs, Scratch(spark, "mix")).where("taken > 0")


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("suffix-array dedup", repeated_text_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage_{i}")
        scratch.drop(*(scratch.live - {f"stage_{i}"}))
    return docs
