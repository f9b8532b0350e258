"""op8: packing of every document into token windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .packing import pack_documents

NAME = "op8_packing"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))
