"""op2: benchmark passages in every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .decontaminate import find_leaks

NAME = "op2_decontaminate"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, test item) pair within the item's error budget."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
