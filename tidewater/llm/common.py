"""Helpers shared by the operators: table readers, word splitting, staged tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.session import ensure_checkpoint_dir

# White space as the contracts define it: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of non-space characters, in order."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


# Spark's own switch: shuffle files go when the job that made them ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files of the write are deleted with its end; nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/staged/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the folders of staged tables whose last reader has been written."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(rows: DataFrame, group: str, *by: str) -> DataFrame:
    """``rows`` with i, the place in its ``group`` ordered ``by`` columns (from 0), and n, the size of the group.

    Rows are dealt by range of (group, by), so that a group which holds most rows is spread over all tasks; a row's
    place is its place in the partition plus what earlier partitions hold of its group.  Written to the shared folder.
    """
    order = [F.col(c).asc_nulls_first() for c in (group, *by)]
    at = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ordered")
    at = at.withColumn("__part", F.shiftright("__at", 33))
    # One row for each partition of a group.
    parts = at.groupBy(group, "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__held"))
    whole = Window.partitionBy(group)
    parts = parts.select(group, "__part", "__first", F.sum("__held").over(whole).alias("n"),
                         (F.sum("__held").over(whole.orderBy("__part")) - F.col("__held")).alias("__before"))
    return at.join(parts, [group, "__part"]).select(*rows.columns, (F.col("__at") - F.col("__first") + F.col("__before")).alias("i"), "n")
