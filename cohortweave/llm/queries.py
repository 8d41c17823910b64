"""The registered queries of this subpackage: one for each corpus operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortweave.llm.tokens import tokenizer_path

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortweave.llm.token_files import token_files

    return token_files(_documents(spark, sf_dir), tokenizer_path(), end_id=2).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortweave.llm.quality_classifier import quality_scores

    return quality_scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortweave.llm.jaccard_join import jaccard_components

    return jaccard_components(_documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortweave.llm.quality_rules import quality_rules

    ledger = quality_rules(_documents(spark, sf_dir))
    return ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy costs: documents that it fails, that only it fails, and that the policy would keep without it."""
    from cohortweave.llm.quality_rules import ablation, rule_ledger

    return ablation(rule_ledger(_documents(spark, sf_dir)))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortweave.llm.language_id import language_id

    return language_id(_documents(spark, sf_dir))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortweave.llm.bpe import bpe_round_trip

    return bpe_round_trip(_documents(spark, sf_dir), tokenizer_path())


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortweave.llm.warc import warc_round_trip

    return warc_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortweave.llm.mixing import cube_mix

    return cube_mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortweave.llm.pii import pii_spans

    return pii_spans(_documents(spark, sf_dir))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortweave.llm.embedding_dedup import embedding_links

    return embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortweave.llm.spelling import spelling_variants

    return spelling_variants(_documents(spark, sf_dir))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortweave.llm.token_counts import token_counts

    return token_counts(_documents(spark, sf_dir), tokenizer_path())


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortweave.llm.merkle import checked_manifest

    return checked_manifest(_documents(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {
        "op1_token_files": op1_token_files,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_quality_rules": op4_quality_rules,
        "quality_ablation": quality_ablation,
        "op7_language_id": op7_language_id,
        "op6_warc": op6_warc,
        "op8_mixing": op8_mixing,
        "op9_pii": op9_pii,
        "op10_embedding_dedup": op10_embedding_dedup,
        "op5_bpe_round_trip": op5_bpe_round_trip,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_token_counts": op12_token_counts,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    from cohortweave.llm.oracles import SQL

    return dict(SQL)
