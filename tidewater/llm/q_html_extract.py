"""op13: main text of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .html_extract import extract

NAME = "op13_html_extract"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text and its length for every page."""
    return extract(table(spark, sf_dir, "pages"))
