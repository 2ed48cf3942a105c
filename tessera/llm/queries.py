"""The registered queries of the operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, exact_dedup, licenses, oracle, packing, quality, sharding, simhash, suffix_dedup, token_counts, warc


def word_bpe_path() -> str:
    """The vocabulary file; a parameter of the environment, else where the public package has it."""
    import public_tokenizers

    return os.environ.get("TESSERA_WORD_BPE") or public_tokenizers.path("word_bpe_49k.json")


def pieces_path() -> str:
    import public_tokenizers

    return os.environ.get("TESSERA_PIECES") or public_tokenizers.path("piece_bpe_32k.model")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_read(spark, sf_dir, "documents"), word_bpe_path())


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_read(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(_read(spark, sf_dir, "documents"), keep="largest")
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_read(spark, sf_dir, "documents")).drop("n_bad_lines")


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_read(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), pieces_path())


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), word_bpe_path())


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(_read(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_bpe_round_trip, op2_license_scan, op3_exact_dedup, op4_quality_rules, op5_warc_round_trip, op6_sharding, op7_token_counts, op8_best_fit_packing, op9_suffix_array_dedup, op10_simhash_near_dedup)}
#: The others can't be expressed in SQL (or not within reason over whole tables); tests/llm has brute-force versions.
ORACLE_SQL = {"op3_exact_dedup": oracle.OP3, "op4_quality_rules": oracle.OP4, "op5_warc_round_trip": oracle.OP5}
