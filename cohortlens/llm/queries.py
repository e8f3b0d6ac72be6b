"""Registered queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import (
    decontaminate,
    hamming,
    html_extract,
    jaccard_join,
    langid,
    license_scan,
    mixing,
    quality,
    suffix_dedup,
    token_align,
    token_counts,
    vector_codes,
    warc,
)
from cohortlens.llm.common import Scratch, ship_package, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def id_checksum(modulus: int):
    """crc32 of the document id written as text, modulo a number (NULL ids: NULL)."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents outside the held-out fold."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(id_checksum(5) == 0, F.lit(False)))
    model = langid.fit(docs.where("not held_out").select(F.col("doc_id").alias("key"), "text", "lang"))
    return langid.predict(docs, model, ["doc_id", "held_out"])


@query
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents (five-word shingles, Jaccard 0.8)."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), Scratch(spark, "op2"))


@query
def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that lie in a 200-byte string found elsewhere."""
    scratch = Scratch(spark, "op3")
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), scratch)
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda total, run: total + run["n"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"),
                      F.size("runs").cast("long").alias("n_spans"), "kept_sha256")


@query
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, with place and edits."""
    ship_package(spark)
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


@query
def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest sign codes of every vector whose id is divisible by 20."""
    ship_package(spark)
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    codes = hamming.binary_codes(vectors)
    return hamming.top_k(codes, codes.where("id % 20 = 0"), k=10).withColumnRenamed("id", "vec_id")


ORACLES["op5_exact_top_k"] = """
WITH pairs AS (
  SELECT q.vec_id AS query_id, e.vec_id,
    list_sum(list_transform(range(1, len(q.embedding) + 1),
      lambda i: (coalesce(q.embedding[i] > 0, false) <> coalesce(e.embedding[i] > 0, false))::INT))::INT AS distance
  FROM embeddings q JOIN embeddings e ON len(q.embedding) = len(e.embedding) AND q.vec_id <> e.vec_id
  WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM pairs)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
"""


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact byte-level BPE token counts of all documents."""
    import public_tokenizers

    ship_package(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.token_counts(table(spark, sf_dir, "documents"), path, ["doc_id"], budget=1024)


@query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels outside the held-out fold."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(id_checksum(3) == 1, F.lit(False)))
    labels = table(spark, sf_dir, "labels").where(id_checksum(3) != 1).select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(docs, labels)
    return quality.score(docs, model, ["doc_id", "held_out"])


@query
def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document, sources drawn to their targets."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = mixing.mix(docs, Scratch(spark, "op8"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op8_source_mixing"] = mixing.MIX_SQL


@query
def op9_warc_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the page archive in which a decayed copy differs, located by Merkle trees."""
    return warc.audit_pages(table(spark, sf_dir, "pages"), Scratch(spark, "op9"))


ORACLES["op9_warc_merkle_audit"] = warc.AUDIT_SQL


@query
def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by the style tree of its host."""
    return html_extract.main_text(table(spark, sf_dir, "pages"), Scratch(spark, "op10"), ["page_id", "url"])


@query
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License and rights notices of every document, by ordered signature rules."""
    found = license_scan.detect(table(spark, sf_dir, "documents"), ["doc_id"])
    return license_scan.digest(found, ["doc_id"])


ORACLES["op11_license_scan"] = license_scan.scan_sql()


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token groups, links and pair counts between a byte-level and a piece tokenizer over all documents."""
    import public_tokenizers

    paths = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return token_align.align(table(spark, sf_dir, "documents"), Scratch(spark, "op12"), *paths, ["doc_id"])


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product code of every vector from exact integer codebooks, with its error and its label's."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    codes, books = vector_codes.compress(vectors, Scratch(spark, "op13"))
    return codes.select(F.col("id").alias("vec_id"), "code", "error", "label_error",
                        F.lit(vector_codes.books_sha256(books)).alias("codebooks_sha256"))


ORACLES["op13_vector_codes"] = vector_codes.CODES_SQL
