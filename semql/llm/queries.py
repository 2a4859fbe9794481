"""The queries of this subpackage, by the names under which they are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from semql.llm import decontaminate, language_id, license_scan, line_dedup, quality_classifier, quality_rules, sentencepiece_codec, sharding, simhash, token_store


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": simhash.query,
        "op2_language_id": language_id.query,
        "op3_decontaminate": decontaminate.query,
        "op4_sharding": sharding.query,
        "op5_line_dedup": line_dedup.query,
        "op6_sentencepiece": sentencepiece_codec.query,
        "op7_quality_classifier": quality_classifier.query,
        "op8_quality_rules": quality_rules.query,
        "op9_license_scan": license_scan.query,
        "op10_token_store": token_store.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_decontaminate": decontaminate.SQL,
        "op5_line_dedup": line_dedup.SQL,
        "op8_quality_rules": quality_rules.SQL,
    }
