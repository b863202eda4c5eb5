"""The ``opN_<name>`` queries: each operator on its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, collocations, decontamination, hilbert_shards, language_id, license_scan, mixing, quality_rules, simhash, source_divergence, substring_dedup, token_shards, toxicity
from .common import read_table, output_path


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxic_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.training_order(read_table(spark, sf_dir, "documents"), output_path(spark, "shards"))


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert_shards.assign_shards(read_table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.languages(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicate_groups(read_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.clean_lines(read_table(spark, sf_dir, "documents"), with_text=False)
    return judged.drop("reasons")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(byte_bpe.encode(read_table(spark, sf_dir, "documents")))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(read_table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_license_scan, op2_decontamination, op3_toxicity, op4_mixing, op5_token_shards,
        op6_hilbert_shards, op7_language_id, op8_substring_dedup, op9_simhash, op10_quality_rules,
        op11_byte_bpe, op12_source_divergence, op13_collocations,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_mixing": mixing.ORACLE_SQL, "op8_substring_dedup": substring_dedup.ORACLE_SQL, "op10_quality_rules": quality_rules.ORACLE_SQL,
        "op12_source_divergence": source_divergence.ORACLE_SQL, "op13_collocations": collocations.ORACLE_SQL,
    }
