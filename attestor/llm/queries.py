"""The registered queries of the training-data operators: each runs its operator over its whole table."""

from __future__ import annotations

import secrets
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from attestor.llm import alignment, decontamination, langid, line_dedup, mixing, pii, quality_classifier, quality_rules, simhash, substring_dedup, suffix_dedup, token_files, whitening
from attestor.llm.sql import ORACLES
from attestor.session import ship_package, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.line_dedup(table(spark, sf_dir, "documents")))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.substring_dedup(table(spark, sf_dir, "documents")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.simhash_components(table(spark, sf_dir, "documents")))


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the key of ``spark.attestor.pii.key``; where that is unset, with a new random one, so that pseudonyms link within this run only."""
    key = spark.conf.get("spark.attestor.pii.key", None) or secrets.token_hex(32)
    return pii.protected(table(spark, sf_dir, "documents"), key)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[0]


def vocabulary(name: str) -> bytes:
    """A public tokenizer's file, read on the driver; tasks get its content."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_bytes()


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(table(spark, sf_dir, "embeddings"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json").decode(), end_id=0)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(table(spark, sf_dir, "documents"), alignment.Vocabularies(vocabulary("byte_bpe_50k.json").decode(), vocabulary("piece_bpe_32k.model")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    ship_package(spark)
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_substring_dedup, op3_language_id, op4_quality_rules, op5_quality_classifier, op6_decontamination, op7_simhash_near_dedup, op8_pii_pseudonyms, op9_suffix_dedup, op10_mixing, op11_embedding_whitening, op12_token_files, op13_tokenizer_alignment, pipeline)
}
