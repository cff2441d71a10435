"""The registered queries of this subpackage, and their SQL where SQL can say the same.

Each query applies its operator, with production parameters, to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import html_blocks, language_id, line_dedup, near_dup, oracles, packing, quality_rules, quotes, secrets, tiling, toxicity
from tidemark.llm.common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"), native=True)


def op4_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_ordered(table(spark, sf_dir, "conversations"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op6_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))).drop("passages")


def op8_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_blocks.extract(pages, html_blocks.fit(pages))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_best_fit_packing,
        op2_quality_rules,
        op3_line_dedup,
        op4_quotation_linking,
        op5_secret_scan,
        op6_string_tiling,
        op7_toxic_segments,
        op8_html_blocks,
        op9_minhash_near_dedup,
        op10_byte_cnn_language,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Queries without an entry are held against brute force, exact round trips or held-out labels in tests."""
    return {
        "op2_quality_rules": oracles.QUALITY,
        "op3_line_dedup": oracles.LINES,
        "op5_secret_scan": oracles.SECRETS,
        "op9_minhash_near_dedup": oracles.NEAR,
    }
