"""op6: toxicity of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .toxicity import toxicity

NAME = "op6_toxicity"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict for every document; a fifth of the labels is held out."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
