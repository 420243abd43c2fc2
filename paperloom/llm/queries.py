"""The queries of the thirteen operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import archives, copies, divergence, licenses, middle, packing, passages, pii, quality, secrets, simhash, suffixes, templates
from .common import table

QUERIES = {}
ORACLE_SQL = {}


def op10_line_first_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.clean_lines(docs).select("doc_id", "quality.*").drop("cleaned_text")


QUERIES["op10_line_first_quality"] = op10_line_first_quality
ORACLE_SQL["op10_line_first_quality"] = quality.ORACLE_SQL


def op5_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


QUERIES["op5_secret_ownership"] = op5_secret_ownership
ORACLE_SQL["op5_secret_ownership"] = secrets.ORACLE_SQL


def op7_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


QUERIES["op7_simhash_tiles"] = op7_simhash_tiles


def op8_linear_grouping_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


QUERIES["op8_linear_grouping_packing"] = op8_linear_grouping_packing


def op3_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archives.convert_pages(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES["op3_arc_to_warc"] = op3_arc_to_warc
ORACLE_SQL["op3_arc_to_warc"] = archives.ORACLE_SQL


def op4_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


QUERIES["op4_template_decontamination"] = op4_template_decontamination


def op9_suffix_interval_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicate(table(spark, sf_dir, "documents"), kept=False)


QUERIES["op9_suffix_interval_dedup"] = op9_suffix_interval_dedup


def op2_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_passages(table(spark, sf_dir, "documents"))


QUERIES["op2_compact_windows"] = op2_compact_windows


def op1_pii_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


QUERIES["op1_pii_field"] = op1_pii_field


def op6_license_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents"))


QUERIES["op6_license_paragraphs"] = op6_license_paragraphs


def op11_chunked_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.digest(middle.fill_in_middle(table(spark, sf_dir, "documents")))


QUERIES["op11_chunked_middle"] = op11_chunked_middle
ORACLE_SQL["op11_chunked_middle"] = middle.ORACLE_SQL


def op12_count_level_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES["op12_count_level_divergence"] = op12_count_level_divergence
ORACLE_SQL["op12_count_level_divergence"] = divergence.ORACLE_SQL


def op13_quotient_filter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.exact_duplicates(table(spark, sf_dir, "documents"))


QUERIES["op13_quotient_filter_dedup"] = op13_quotient_filter_dedup
ORACLE_SQL["op13_quotient_filter_dedup"] = copies.ORACLE_SQL
