"""Registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

from . import q_chat_format, q_decontaminate, q_html_extract, q_line_dedup, q_merkle, q_ngram_join, q_packing, q_pii, q_quality_rules, q_secrets, q_toxicity, q_vector_codes, q_warc  # noqa: E402

for _m in (q_chat_format, q_decontaminate, q_html_extract, q_line_dedup, q_merkle, q_ngram_join, q_packing, q_pii, q_quality_rules, q_secrets, q_toxicity, q_vector_codes, q_warc):
    QUERIES[_m.NAME] = _m.query
    if getattr(_m, "SQL", None):
        ORACLE[_m.NAME] = _m.SQL
