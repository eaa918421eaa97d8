"""Queries of the training-data problems that belong to this subpackage, with SQL where SQL can tell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltloom.llm.format_duplicates import distinct_records, format_duplicates
from siltloom.llm.main_content import main_body_lines
from siltloom.llm.packing import document_items, fill_containers, fill_report, prompted_items
from siltloom.llm.repeated_lines import repeated_lines, strip_repeated
from siltloom.llm.residue import clean_teasers, residue_cases
from siltloom.llm.text_quality import not_prose, text_statistics
from siltloom.llm.tokenizer import encode
from siltloom.llm.truncation import truncated, truncation_rates
from siltloom.session import read_table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return format_duplicates(read_table(spark, d, "teasers_raw"), read_table(spark, d, "index_raw"))


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    return distinct_records(read_table(spark, d, "teasers_raw"), read_table(spark, d, "index_raw"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return residue_cases(read_table(spark, d, "pages_in"), read_table(spark, d, "teasers_raw"), read_table(spark, d, "sites"))


def p2_clean_teasers(spark: SparkSession, d: str) -> DataFrame:
    return clean_teasers(read_table(spark, d, "teasers_raw"), read_table(spark, d, "sites")).select("teaser_id", "url", "title")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines(read_table(spark, d, "pages_in")).select("sp_source", "line_text")


def p4_stripped(spark: SparkSession, d: str) -> DataFrame:
    return strip_repeated(read_table(spark, d, "pages_in"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return main_body_lines(read_table(spark, d, "pages_in"), read_table(spark, d, "sites"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return truncated(read_table(spark, d, "teasers_raw"), read_table(spark, d, "sites"))


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation_rates(read_table(spark, d, "teasers_raw"), read_table(spark, d, "sites"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(read_table(spark, d, "documents"))


def p9_assigned(spark: SparkSession, d: str) -> DataFrame:
    return fill_containers(document_items(read_table(spark, d, "documents")), read_table(spark, d, "container_sizes"))


def p9_limits(spark: SparkSession, d: str) -> DataFrame:
    """All three limits at once: tokens, segments and loss-bearing tokens."""
    return fill_containers(prompted_items(read_table(spark, d, "documents")), read_table(spark, d, "container_sizes"), max_segments=8, max_loss_share=1.0)


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(p9_assigned(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return not_prose(read_table(spark, d, "documents"))


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return text_statistics(read_table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_records": p1_records,
        "p2_found": p2_found,
        "p2_clean_teasers": p2_clean_teasers,
        "p4_found": p4_found,
        "p4_stripped": p4_stripped,
        "p5_found": p5_found,
        "p6_found": p6_found,
        "p6_rates": p6_rates,
        "p8_ids": p8_ids,
        "p9_assigned": p9_assigned,
        "p9_limits": p9_limits,
        "p9_fill": p9_fill,
        "p10_found": p10_found,
        "p10_statistics": p10_statistics,
    }


def oracle_sql() -> dict[str, str]:
    return {}
