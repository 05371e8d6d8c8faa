"""One query per operator, over whole tables, with the digests that identify its results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.llm import oracles
from shoal.llm.bpe import encode
from shoal.llm.chat import format_chat, read_chat
from shoal.llm.decontaminate import decontaminate
from shoal.llm.lang_id import fit_languages, held_out, identify
from shoal.llm.licenses import scan_licenses
from shoal.llm.lm_score import lm_scores
from shoal.llm.merkle import tamper_check
from shoal.llm.near_dedup import near_duplicates
from shoal.llm.pieces import encode_pieces
from shoal.llm.quality import quality
from shoal.llm.secrets import scan_secrets
from shoal.llm.spelling import spelling_variants, word_counts
from shoal.llm.substring import remove_repeats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op3_chat_format": oracles.CHAT_FORMAT, "op4_quality_rules": oracles.QUALITY_RULES, "op5_near_dedup": oracles.NEAR_DEDUP,
    "op6_decontaminate": oracles.DECONTAMINATE, "op9_substring_dedup": oracles.SUBSTRING_DEDUP, "op10_lm_score": oracles.LM_SCORE,
    "op11_spelling_variants": oracles.SPELLING_VARIANTS, "op12_merkle_manifest": oracles.MERKLE_MANIFEST,
}
VOCABULARY_FILE = "byte_bpe_50k.json"
PIECES_FILE = "piece_bpe_32k.model"


def query(run):
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_lang_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = fit_languages(docs.where(~F.col("held_out")))
    return identify(docs, model, keep=("held_out",)).select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query
def op2_bpe(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY_FILE), with_ids=False)


@query
def op3_chat_format(spark, sf_dir):
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    made = format_chat(given.unionByName(extra))
    read = read_chat(made)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                       F.col("formatted_chars"))


@query
def op4_quality_rules(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"))


@query
def op5_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85).drop("text_hash")


@query
def op6_decontaminate(spark, sf_dir):
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_license_scan(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))


@query
def op8_secret_scan(spark, sf_dir):
    return scan_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_cost", "guess_bits")


@query
def op9_substring_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), "n_factors")


@query
def op10_lm_score(spark, sf_dir):
    return lm_scores(table(spark, sf_dir, "documents"))


@query
def op11_spelling_variants(spark, sf_dir):
    return spelling_variants(word_counts(table(spark, sf_dir, "documents")))


@query
def op12_merkle_manifest(spark, sf_dir):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return tamper_check(table(spark, sf_dir, "documents"), tampered, F.replace("text", F.lit("\n"), F.lit("")))


@query
def op13_sentencepiece(spark, sf_dir):
    return encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES_FILE), with_pieces=False)
