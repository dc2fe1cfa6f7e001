"""The registered queries of the corpus operators and the SQL that DuckDB can check them with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import byte_bpe, exact_topk, hmm_lm, lang_id, line_dedup, minhash_dedup, mixing, pii, secrets, vector_dedup
from gridloom.llm.common import table

#: The vocabulary of the byte-level BPE query; any .tiktoken file of ranks will do.
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digests(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents"))


def op5_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.digests(table(spark, sf_dir, "documents"))


def op6_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.digests(table(spark, sf_dir, "documents"))


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.digests(table(spark, sf_dir, "embeddings"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.digests(table(spark, sf_dir, "embeddings"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.digests(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.digests(byte_bpe.encode(docs, VOCABULARY, PATTERN, decoded_col="decoded"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_secrets": op2_secrets,
    "op3_pii": op3_pii,
    "op4_line_dedup": op4_line_dedup,
    "op5_lang_id": op5_lang_id,
    "op6_hmm_lm": op6_hmm_lm,
    "op7_vector_dedup": op7_vector_dedup,
    "op8_exact_topk": op8_exact_topk,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_byte_bpe": op10_byte_bpe,
}

ORACLES: dict[str, str] = {
    "op1_mixing": mixing.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op7_vector_dedup": vector_dedup.ORACLE,
    "op8_exact_topk": exact_topk.ORACLE,
}
