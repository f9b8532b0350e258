"""Table and metadata writers.

Tables are written partitioned (by study area for panels and voyages, by date
for event-like tables) and sorted within partitions, so readers get partition
pruning and min/max skipping; CSV with a header is available on demand.
Metadata is a one-row nested aggregate written as JSON: all inputs to it are
per-area / per-split / per-class aggregates, bounded by those small domains.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                sort_within: list[str] | None = None, fmt: str = "parquet", mode: str = "overwrite",
                options: dict | None = None, buckets: int = 16, spread: bool = True) -> None:
    """Write a table; ``fmt='csv'`` writes a header line.

    Rows are spread by (partition columns, deterministic hash bucket): one output
    partition that holds a third of all rows is written by ``buckets`` tasks, and
    a retried task sends every row to the same bucket again.  Without ``spread``
    (for few output partitions) each task writes what it holds: more files, no exchange.
    """
    out = df
    if partition_by and spread:
        bucket = F.pmod(F.xxhash64(*df.columns), F.lit(buckets))
        out = out.repartition(*partition_by, bucket)
    if sort_within:
        out = out.sortWithinPartitions(*(partition_by or []), *sort_within)
    w = out.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    for k, v in (options or {}).items():
        w = w.option(k, v)
    if fmt == "csv":
        w.option("header", "true").csv(path)
    else:
        w.format(fmt).save(path)


def written_values(spark: SparkSession, path: str, column: str) -> list[str]:
    """Values of ``column`` under which a table that is partitioned by it alone was written, without reading a row."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(top)]
    return sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{column}="))


def write_sorted(df: DataFrame, path: str, order: list[Column], files: int | None = None, fmt: str = "parquet",
                 mode: str = "overwrite") -> None:
    """Files that follow one another: in name order, their rows are in ``order`` from the first to the last.

    Rows are dealt by range over sampled bounds, so no task sorts more than its part; ``files`` fixes the number of
    parts.  Rows equal in ``order`` stay in one file.
    """
    spread = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    out = spread.sortWithinPartitions(*order).write.mode(mode)
    (out.option("header", "true").csv(path) if fmt == "csv" else out.format(fmt).save(path))


def with_position(df: DataFrame, groups: list[Column], within: list[Column], out: str = "position") -> DataFrame:
    """``out``: a row's place (from 1) in the order of ``groups``, then ``within``; nulls last, rows equal in both in any order.

    ``groups`` are coarse leading keys (an area, a year, a day).  Their counts, one row a group, give how many rows
    come before a group; rows are only sorted inside their group, never all in one task.  Needs no written table and
    gives a retried task the same places again.
    """
    names = [f"__g{i}" for i in range(len(groups))]
    keyed = df.withColumns(dict(zip(names, groups)))
    before = Window.orderBy(*[F.asc_nulls_last(n) for n in names]).rowsBetween(Window.unboundedPreceding, -1)
    counts = (keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))
              .select(*[F.col(n).alias(f"{n}k") for n in names], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")))
    place = keyed.withColumn("__place", F.row_number().over(Window.partitionBy(*names).orderBy(*within)))
    same = functools.reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"{n}k")) for n in names])
    return place.join(counts, same).select(*df.columns, (F.col("__before") + F.col("__place")).cast("bigint").alias(out))


def metadata_frame(model_table: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Thresholds, feature lists, split ranges, class counts as one nested row."""
    thr = thresholds.agg(F.map_from_entries(F.collect_list(F.struct(
        "study_area", F.struct("q90_raw", "high_threshold")))).alias("thresholds"))
    splits = (model_table.groupBy("dataset_split")
              .agg(F.min("timestamp_utc").alias("start"), F.max("timestamp_utc").alias("end"),
                   F.count(F.lit(1)).alias("rows"))
              .agg(F.map_from_entries(F.collect_list(F.struct(
                  "dataset_split", F.struct(F.col("start").cast("string").alias("start"),
                                            F.col("end").cast("string").alias("end"), "rows"))))
                   .alias("splits")))
    classes = (model_table.groupBy("dataset_split", "traffic_level").agg(F.count(F.lit(1)).alias("n"))
               .groupBy("dataset_split").agg(F.map_from_entries(F.collect_list(F.struct("traffic_level", "n")))
                                             .alias("m"))
               .agg(F.map_from_entries(F.collect_list(F.struct("dataset_split", "m"))).alias("class_counts")))
    return (thr.select("thresholds", splits.select("splits").scalar().alias("splits"),
                       classes.select("class_counts").scalar().alias("class_counts"))
            .withColumn("numeric_features", F.array(*[F.lit(c) for c in C.NUMERIC_FEATURES]))
            .withColumn("categorical_features", F.array(*[F.lit(c) for c in C.CATEGORICAL_FEATURES]))
            .withColumn("target", F.lit(C.TARGET_COLUMN))
            .withColumn("class_mapping", F.create_map(*[x for i, n in enumerate(C.CLASS_NAMES)
                                                       for x in (F.lit(n), F.lit(i))])))


def write_metadata(model_table: DataFrame, thresholds: DataFrame, path: str) -> None:
    metadata_frame(model_table, thresholds).coalesce(1).write.mode("overwrite").json(path)
