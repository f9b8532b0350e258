"""op9: secrets in every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .secret_scan import scan_secrets

NAME = "op9_secrets"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document with the forest's score and verdict."""
    return scan_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "chars", F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")
