"""The operators applied to the driver's tables, and the SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terralog.llm import (
    decontamination,
    license_scans,
    main_text,
    ngram_join,
    packed_ids,
    piece_tokens,
    quality_gam,
    quality_rules,
    secret_scans,
    shards,
    spelling_groups,
    substring_dedup,
    turn_repair,
)
from terralog.llm.common import table


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_gam.scored(docs, quality_gam.learned(docs, table(spark, sf_dir, "labels")))


def op2_piece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_tokens.digests(table(spark, sf_dir, "documents"), piece_tokens.default_path())


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(table(spark, sf_dir, "documents")).drop("text_hash", "component")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scans.scanned(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.marked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return main_text.extracted(pages, main_text.learned(pages))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents")).drop("votes", "p_good")


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.dealt(table(spark, sf_dir, "documents"), 16)


def op9_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_ids.round_trip(table(spark, sf_dir, "documents"), packed_ids.default_path())


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scans.scanned(table(spark, sf_dir, "documents"))


def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups.grouped(table(spark, sf_dir, "documents"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repaired(table(spark, sf_dir, "conversations"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicated(table(spark, sf_dir, "documents")).drop("spans")


QUERIES = {
    "op1_quality_gam": op1_quality_gam,
    "op2_piece_tokens": op2_piece_tokens,
    "op3_ngram_join": op3_ngram_join,
    "op4_secret_scans": op4_secret_scans,
    "op5_decontamination": op5_decontamination,
    "op6_main_text": op6_main_text,
    "op7_quality_rules": op7_quality_rules,
    "op8_shards": op8_shards,
    "op9_packed_ids": op9_packed_ids,
    "op10_license_scans": op10_license_scans,
    "op11_spelling_groups": op11_spelling_groups,
    "op12_turn_repair": op12_turn_repair,
    "op13_substring_dedup": op13_substring_dedup,
}

SQL = {
    "op3_ngram_join": ngram_join.SQL,
    "op5_decontamination": decontamination.SQL,
    "op7_quality_rules": quality_rules.sql(),
    "op10_license_scans": license_scans.sql(),
    "op13_substring_dedup": substring_dedup.SQL,
}
