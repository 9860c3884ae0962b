"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    exact_topk,
    language_id,
    license_scan,
    piece_codec,
    quality_classifier,
    quality_rules,
    secret_scan,
    simhash_dedup,
    source_mix,
    token_counts,
)
from ._common import scratch

_OPERATORS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mix": source_mix.query,
    "op2_secret_scan": secret_scan.query,
    "op3_simhash_dedup": simhash_dedup.query,
    "op4_exact_topk": exact_topk.query,
    "op5_piece_codec": piece_codec.query,
    "op6_token_counts": token_counts.query,
    "op7_license_scan": license_scan.query,
    "op8_quality_classifier": quality_classifier.query,
    "op9_quality_rules": quality_rules.query,
    "op10_language_id": language_id.query,
}


def _ended(name: str, query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``query``, whose tables on the way are deleted when it ends."""
    return lambda spark, sf_dir: scratch(spark, lambda: query(spark, sf_dir), name, lazy=True)


QUERIES = {name: _ended(name, query) for name, query in _OPERATORS.items()}

ORACLE_SQL: dict[str, str] = {"op1_source_mix": source_mix.sql(), "op4_exact_topk": exact_topk.SQL}
