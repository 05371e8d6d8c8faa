"""The corpus pipeline: each stage works on what its predecessor kept, and its decisions take effect."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.llm.bpe import encode
from shoal.llm.decontaminate import decontaminate
from shoal.llm.lang_id import fit_languages, held_out, identify
from shoal.llm.near_dedup import near_duplicates
from shoal.llm.secrets import scan_secrets
from shoal.llm.words import small_batches
from shoal.session import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are rejected: without a letter (null texts too), or far from every learned language. Every row is
    judged by its own text, so repeated and null doc_ids pass through. Further columns are left out."""
    small_batches(spark)
    model = fit_languages(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model, keep=tuple(COLUMNS)).where(~F.col("rejected")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies; of repeated rows one stays. Rows without doc_id
    stay only if no near copy has one; texts without words are nobody's copies. Further columns are left out."""
    small_batches(spark)
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("id"), "text_hash").distinct()
    same = docs["doc_id"].eqNullSafe(kept["id"]) & (F.xxhash64(docs["text"]) == kept["text_hash"])
    one = docs.join(kept, same, "left_semi").select(*COLUMNS)
    return (one.groupBy("doc_id", F.xxhash64("text").alias("h"))
            .agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("r")).select("doc_id", "r.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage. Rows that share a doc_id, or have none, are judged each by its own
    text; null and empty texts stay, and so does every clean document. Further columns are left out."""
    small_batches(spark)
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), with_hash=True).where("contaminated")
    found = found.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("h")).distinct()
    same = docs["doc_id"].eqNullSafe(found["id"]) & (F.xxhash64(docs["text"]) == found["h"])
    return docs.join(found, same, "left_anti").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts and counts the characters anew; all documents stay."""
    small_batches(spark)
    scanned = scan_secrets(docs, keep=tuple(COLUMNS))
    text = F.coalesce("redacted", "text")
    chars = F.when(F.col("redacted").isNull(), F.col("n_chars")).otherwise(F.length("redacted").cast("long"))
    return scanned.select("doc_id", text.alias("text"), "lang", "source", chars.alias("n_chars"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the text decoded from them. A null text has no tokens; null
    and repeated doc_ids pass through."""
    small_batches(spark)
    return encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language ID", language_id), ("near-duplicate removal", near_dedup), ("benchmark decontamination", decontamination),
          ("secret scan", secret_scan), ("BPE", bpe)]

#: Nearest centroids, guess costs and byte-pair merges have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what each earlier one returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
