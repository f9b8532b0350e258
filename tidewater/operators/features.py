"""Model-table features on the dense hourly panel.

All window features share one spec, ``partitionBy(study_area).orderBy(timestamp_utc)``,
so Spark plans a single exchange + sort for lags, rolling means and targets.
The panel is areas x hours (independent of event volume), so per-area window
partitions stay small; thresholds are aggregates joined back by area (a
5-row dimension, broadcast) instead of driver-side dictionaries.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.timefeat import calendar_columns, cyclical_columns


def panel_window() -> Window:
    return Window.partitionBy("study_area").orderBy("timestamp_utc")


def _ts(v) -> Column:
    if isinstance(v, dt.datetime):
        v = v.strftime("%Y-%m-%d %H:%M:%S")
    return F.lit(v).cast("timestamp_ntz")


# ---------------------------------------------------------------------------
# Row-local features
# ---------------------------------------------------------------------------

def centroids_frame(spark: SparkSession) -> DataFrame:
    rows = [(a, lat, lon) for a, (lat, lon) in C.AREA_CENTROIDS.items()]
    return spark.createDataFrame(rows, "study_area string, centroid_lat double, centroid_lon double")


def add_centroids(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Broadcast lookup join to the fixed 5-row centroid table."""
    return df.join(F.broadcast(centroids_frame(spark)), "study_area", "left")


def add_calendar(df: DataFrame, ts: str = "timestamp_utc") -> DataFrame:
    return df.select("*", *calendar_columns(ts))


def add_cyclical(df: DataFrame, digits: int | None = None) -> DataFrame:
    return df.select("*", *cyclical_columns(digits=digits))


# ---------------------------------------------------------------------------
# Window features
# ---------------------------------------------------------------------------

def lag_columns(w: Window | None = None) -> list[Column]:
    w = w or panel_window()
    return [F.lag(c, k).over(w).alias(f"{c}_lag_{k}h") for c, ks in C.LAGS.items() for k in ks]


def rolling_columns(w: Window | None = None) -> list[Column]:
    """Mean of the previous k hours (current hour excluded, partial windows allowed)."""
    w = w or panel_window()
    return [F.avg(c).over(w.rowsBetween(-k, -1)).alias(f"{c}_rolling_mean_{k}h")
            for c, ks in C.ROLLING.items() for k in ks]


def future_columns(w: Window | None = None) -> list[Column]:
    w = w or panel_window()
    return [F.lead(c, 1).over(w).alias(f"future_{c}_1h") for c in C.FUTURE_TARGETS]


def add_lags(df: DataFrame) -> DataFrame:
    return df.select("*", *lag_columns())


def add_rolling(df: DataFrame) -> DataFrame:
    return df.select("*", *rolling_columns())


def add_future_targets(df: DataFrame) -> DataFrame:
    return df.select("*", *future_columns())


def add_window_features(df: DataFrame) -> DataFrame:
    """W1 + W2 + W3 in one projection over one window spec (one sort)."""
    return df.select("*", *lag_columns(), *rolling_columns(), *future_columns())


# ---------------------------------------------------------------------------
# Splits, leakage purge, completeness
# ---------------------------------------------------------------------------

def split_label(ts: Column, boundaries: dict, drop_after: bool = True) -> Column:
    """P25: ``train`` before the first boundary, then validation, then test.

    ``boundaries`` maps split -> exclusive end (final form) when it has a
    ``train`` key, or split -> inclusive start (build-time forms) otherwise.
    """
    if "train" in boundaries:
        expr = F.when(ts < _ts(boundaries["train"]), F.lit("train"))
        expr = expr.when(ts < _ts(boundaries["validation"]), F.lit("validation"))
        expr = expr.when(ts < _ts(boundaries["test"]), F.lit("test"))
        return expr if drop_after else expr.otherwise(F.lit("test"))
    return (F.when(ts >= _ts(boundaries["test"]), F.lit("test"))
             .when(ts >= _ts(boundaries["validation"]), F.lit("validation"))
             .otherwise(F.lit("train")))


def add_split(df: DataFrame, boundaries: dict | None = None, ts: str = "timestamp_utc") -> DataFrame:
    boundaries = boundaries or C.FINAL_SPLIT
    out = df.withColumn("dataset_split", split_label(F.col(ts), boundaries))
    return out.filter(F.col("dataset_split").isNotNull())


def purge_leakage(df: DataFrame, boundaries: dict, ts: str = "timestamp_utc") -> DataFrame:
    """Keep rows whose target hour (t + 1 h) falls in the same split."""
    target = F.col(ts) + F.expr(f"INTERVAL {C.PREDICTION_HORIZON_HOURS} HOUR")
    return (df.withColumn("target_timestamp", target.cast("timestamp_ntz"))
              .filter(split_label(F.col(ts), boundaries) ==
                      split_label(F.col("target_timestamp"), boundaries)))


def drop_incomplete(df: DataFrame, required: list[str]) -> DataFrame:
    """Drop rows with null (or NaN) in any required column."""
    return df.na.drop(subset=required)


# ---------------------------------------------------------------------------
# Thresholds and labels (train split only)
# ---------------------------------------------------------------------------

def area_thresholds(df: DataFrame, target: str = C.TARGET_COLUMN,
                    split_col: str = "dataset_split") -> DataFrame:
    """Per area q90 of the target on train rows (exact, linear interpolation);
    HIGH threshold = max(2, ceil(q90))."""
    train = df.filter(F.col(split_col) == "train").filter(F.col(target).isNotNull())
    q = (train.groupBy("study_area")
              .agg(F.percentile(F.col(target).cast("double"), C.HIGH_QUANTILE).alias("q90_raw")))
    return q.select("study_area", "q90_raw",
                    F.greatest(F.lit(C.MIN_HIGH_THRESHOLD).cast("bigint"),
                               F.ceil("q90_raw").cast("bigint")).alias("high_threshold"))


def global_thresholds(df: DataFrame, target: str = C.TARGET_COLUMN,
                      split_col: str = "dataset_split") -> DataFrame:
    """A10: train-only q33 / q67 of the target as a one-row frame."""
    train = df.filter(F.col(split_col) == "train").filter(F.col(target).isNotNull())
    lo, hi = C.GLOBAL_QUANTILES
    return train.agg(F.percentile(F.col(target).cast("double"), lo).alias("q33"),
                     F.percentile(F.col(target).cast("double"), hi).alias("q67"))


def class_numeric(label: Column) -> Column:
    return (F.when(label == "LOW", F.lit(0)).when(label == "MEDIUM", F.lit(1))
             .when(label == "HIGH", F.lit(2)))


def classify_by_area(df: DataFrame, thresholds: DataFrame, value: str = C.TARGET_COLUMN,
                     out: str = "traffic_level") -> DataFrame:
    """0 -> LOW; >= area HIGH threshold -> HIGH; else MEDIUM.

    ``thresholds`` has one row per area (bounded by the area list) -> broadcast.
    """
    t = thresholds.select("study_area", F.col("high_threshold").alias("__high"))
    v = F.col(value).cast("bigint")
    label = (F.when(v == 0, F.lit("LOW")).when(v >= F.col("__high"), F.lit("HIGH"))
              .otherwise(F.lit("MEDIUM")))
    return (df.join(F.broadcast(t), "study_area", "left")
              .withColumn(out, F.when(v.isNotNull(), label))
              .withColumn(f"{out}_numeric", class_numeric(F.col(out)))
              .drop("__high"))


def classify_by_quantiles(df: DataFrame, thresholds: DataFrame, value: str = C.TARGET_COLUMN,
                          out: str = "traffic_class") -> DataFrame:
    """<= q33 LOW, <= q67 MEDIUM, else HIGH.

    ``thresholds`` is a one-row aggregate; each bound enters as a scalar
    subquery (computed once), not as a join.
    """
    v = F.col(value)
    q33, q67 = thresholds.select("q33").scalar(), thresholds.select("q67").scalar()
    label = (F.when(v <= q33, F.lit("LOW")).when(v <= q67, F.lit("MEDIUM"))
              .otherwise(F.lit("HIGH")))
    return (df.withColumn(out, F.when(v.isNotNull(), label))
              .withColumn(f"{out}_numeric", class_numeric(F.col(out))))


def regression_to_class(pred: Column, high_threshold: Column) -> Column:
    """Clip at 0; < 0.5 LOW(0); >= threshold - 0.5 HIGH(2); else MEDIUM(1)."""
    p = F.greatest(F.lit(0.0), pred.cast("double"))
    return (F.when(p < 0.5, F.lit(0)).when(p >= high_threshold - F.lit(0.5), F.lit(2))
             .otherwise(F.lit(1)))


# ---------------------------------------------------------------------------
# Sequences (train-only scaling)
# ---------------------------------------------------------------------------

def scale_features(df: DataFrame, stats: DataFrame, features: list[str], out: str = "scaled") -> DataFrame:
    """``out``: array<float> of (x - mean) / std in the order of ``features``; a std of 0 counts as 1.

    ``stats`` is M14's long form (position, feature, mean, std), one row a feature; it enters as one scalar
    subquery, so no row of ``df`` moves.  A null value, or no train rows to take statistics from, gives null there.
    """
    one = stats.agg(F.array_sort(F.collect_list(F.struct("position", "mean", "std"))).alias("s")).scalar()

    def scaled(i: int, c: str) -> Column:
        mean, std = F.get(F.col("__stats"), F.lit(i))["mean"], F.get(F.col("__stats"), F.lit(i))["std"]
        return ((F.col(c).cast("double") - mean) / F.when(std == 0, F.lit(1.0)).otherwise(std)).cast("float")

    return (df.withColumn("__stats", one)
              .withColumn(out, F.array(*[scaled(i, c) for i, c in enumerate(features)])).drop("__stats"))


def sequence_windows(df: DataFrame, label: str, length: int = C.SEQUENCE_LENGTH, features: str = "scaled") -> DataFrame:
    """For each labelled hour t, the ``length`` consecutive hours ending at t as array<array<float>> ``sequence``.

    ``df`` holds one row an area and hour.  Hours without a label end no window but take part in later ones; so do
    hours whose other features are incomplete.  A window that a missing hour interrupts is left out: its oldest
    row must lie exactly ``length`` - 1 hours before t.
    """
    w = panel_window().rowsBetween(-(length - 1), 0)
    held = df.select("*", F.collect_list(features).over(w).alias("sequence"), F.min("timestamp_utc").over(w).alias("__oldest"))
    whole = F.col("__oldest") == F.col("timestamp_utc") - F.expr(f"INTERVAL {length - 1} HOURS")
    return held.where((F.size("sequence") == length) & whole & F.col(label).isNotNull()).drop("__oldest")


# ---------------------------------------------------------------------------
# Whole model table
# ---------------------------------------------------------------------------

def model_features(spark: SparkSession, panel: DataFrame, digits: int | None = None) -> DataFrame:
    """Dense panel -> 44 numeric features + area + targets (no split yet)."""
    df = add_centroids(spark, panel)
    df = add_calendar(df)
    df = add_cyclical(df, digits)
    return add_window_features(df)


def model_table(spark: SparkSession, panel: DataFrame, boundaries: dict | None = None,
                digits: int | None = None) -> DataFrame:
    """P25 -> P27 -> A9 -> P29: labelled rows in the fixed feature order."""
    feats = add_split(model_features(spark, panel, digits), boundaries)
    complete = drop_incomplete(feats, C.NUMERIC_FEATURES + [C.TARGET_COLUMN])
    labelled = classify_by_area(complete, area_thresholds(complete))
    targets = ["future_total_events_1h", "future_arrivals_1h", "future_unique_vessels_1h"]
    return labelled.select("timestamp_utc", "study_area", "dataset_split", *C.NUMERIC_FEATURES,
                           *targets, "traffic_level", "traffic_level_numeric")
