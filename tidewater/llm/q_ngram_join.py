"""op5: near copies of every document by word 4-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .ngram_join import ngram_join

NAME = "op5_ngram_join"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return ngram_join(table(spark, sf_dir, "documents"))
