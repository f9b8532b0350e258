"""op1: personal data in every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .pii import find_pii

NAME = "op1_pii"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans and the spans that the boosted trees add, for every document."""
    return find_pii(table(spark, sf_dir, "documents"))
