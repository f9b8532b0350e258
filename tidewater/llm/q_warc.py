"""op4: archives of all pages, written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .warc import archive_path, read_archives, write_archives

NAME = "op4_warc"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record facts of every page, as the archives hold them."""
    path = archive_path(spark)
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
