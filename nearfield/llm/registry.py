"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nearfield.llm import (
    exact_dedup, fill_in_middle, importance_resampling, line_dedup, mixing, near_dedup, packing, quality_classifier, quality_rules, secret_scan, token_files, toxicity, url_filter,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name of each query and the function that makes it of (spark, sf_dir)."""
    return {
        "op1_near_dedup": near_dedup.op1_near_dedup,
        "op2_packing": packing.op2_packing,
        "op3_token_files": token_files.op3_token_files,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_secret_scan": secret_scan.op5_secret_scan,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_url_filter": url_filter.op7_url_filter,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_quality_rules": quality_rules.op9_quality_rules,
        "op10_mixing": mixing.op10_mixing,
        "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
        "op12_quality_classifier": quality_classifier.op12_quality_classifier,
        "op13_importance_resampling": importance_resampling.op13_importance_resampling,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the rows of those queries that SQL can express."""
    return {
        "op4_exact_dedup": exact_dedup.OP4_SQL,
        "op7_url_filter": url_filter.OP7_SQL,
        "op11_fill_in_middle": fill_in_middle.OP11_SQL,
        "op13_importance_resampling": importance_resampling.OP13_SQL,
    }
