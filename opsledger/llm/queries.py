"""Registered queries of the operators: each reads its whole table and returns its operator's full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (byte_bpe, chat_snapshots, chosen_path, conversation_repair, decontaminate, language_mixture, line_dedup,
               quality_rules, secret_forest, suffix_family, warc_index, whitening, word_bpe)
from .common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
WORD_VOCABULARY = "word_bpe_49k.json"


def pattern() -> str:
    """The split pattern of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_index.captures(table(spark, sf_dir, "pages"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_decode(table(spark, sf_dir, "documents"), ["doc_id"], VOCABULARY, pattern(), digests=True)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_columns(table(spark, sf_dir, "documents"), ["doc_id"])


def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    third = F.coalesce(language_mixture.fold(F.col("doc_id")), F.lit(0))  # a null id is learned from, not held out
    model = language_mixture.learn(docs.where(third != 1))
    out = language_mixture.predict(docs.select("doc_id", "text"), ["doc_id"], model)
    return out.select("doc_id", (third == 1).alias("held_out"), "lang_pred", "score", "languages", "proportions")


def op6_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_forest.scan(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.decisions(table(spark, sf_dir, "documents"))


def op8_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_family.removal(table(spark, sf_dir, "documents"))


def op9_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"))


def op10_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_snapshots.collapse(table(spark, sf_dir, "conversations"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.encode_decode(table(spark, sf_dir, "documents"), ["doc_id"], WORD_VOCABULARY, digests=True)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc_index, op2_byte_bpe, op3_decontamination, op4_quality_rules, op5_language_mixture,
                            op6_secret_forest, op7_line_dedup, op8_suffix_family, op9_chosen_path, op10_chat_snapshots, op11_whitening, op12_word_bpe,
                            op13_conversation_repair)}

ORACLE: dict[str, str] = {"op1_warc_index": warc_index.ORACLE, "op10_chat_snapshots": chat_snapshots.ORACLE}
