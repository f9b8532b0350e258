"""Live feature rows and history readiness over many reference hours at once.

The live service asks 25 single-hour lookups per request.  Here a request is a
row: for every reference hour we need the 25 hours ending at it.  Instead of a
self-join per lag, each observed hour is fanned out to the 25 reference hours
it serves (``explode(sequence(h, h + 24h))``) and regrouped by reference hour:
a plain shuffle keyed by hour, with no global ordering and no pair
enumeration beyond the fixed fan-out of 25.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.timefeat import calendar_columns, cyclical_columns, floor_hour

LIVE_COUNTERS = C.COUNTER_COLUMNS


def _ts(v) -> Column:
    if isinstance(v, Column):
        return v.cast("timestamp_ntz")
    if isinstance(v, dt.datetime):
        v = v.strftime("%Y-%m-%d %H:%M:%S")
    return F.lit(v).cast("timestamp_ntz")


def reference_hour(ts) -> Column:
    """Last fully completed UTC hour before ``ts``."""
    return (floor_hour(ts).cast("timestamp") - F.expr("INTERVAL 1 HOUR")).cast("timestamp_ntz")


def reference_hours(spark: SparkSession, start, end) -> DataFrame:
    """Reference hours ``start <= r < end`` as rows (bounded by the time span)."""
    seq = F.sequence(_ts(start), _ts(end) - F.expr("INTERVAL 1 HOUR"), F.expr("INTERVAL 1 HOUR"))
    return spark.range(1).select(F.explode(seq).alias("reference_hour"))


def history_window(hourly: DataFrame, ref, hours: int = C.REQUIRED_HISTORY_HOURS) -> DataFrame:
    """The reference hour and its predecessors as (lag, hour, counters);
    a missing hour gives zeros and ``available = false``."""
    r = _ts(ref)
    spark = hourly.sparkSession
    lags = spark.range(hours).select(F.col("id").cast("int").alias("lag"))
    want = lags.select("lag", (r.cast("timestamp") - F.make_dt_interval(hours=F.col("lag")))
                       .cast("timestamp_ntz").alias("timestamp_utc"))
    h = hourly.filter((F.col("timestamp_utc") <= r) &
                      (F.col("timestamp_utc") > (r.cast("timestamp") - F.make_dt_interval(hours=F.lit(hours)))
                       .cast("timestamp_ntz")))
    j = want.join(h, "timestamp_utc", "left")
    return j.select("lag", "timestamp_utc", F.col("total_events").isNotNull().alias("available"),
                    *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in LIVE_COUNTERS])


def history_readiness(hourly: DataFrame, refs: DataFrame,
                      hours: int = C.REQUIRED_HISTORY_HOURS) -> DataFrame:
    """A14 for many reference hours: available count, missing lags, ready flag."""
    fan = (hourly.select("timestamp_utc")
           .select(F.explode(F.sequence(F.lit(0), F.lit(hours - 1))).alias("lag"), "timestamp_utc")
           .select("lag", (F.col("timestamp_utc").cast("timestamp") + F.make_dt_interval(hours=F.col("lag")))
                   .cast("timestamp_ntz").alias("reference_hour")))
    have = fan.groupBy("reference_hour").agg(F.count(F.lit(1)).alias("available_required_hours"),
                                             F.collect_set("lag").alias("__lags"))
    j = refs.join(have, "reference_hour", "left")
    all_lags = F.sequence(F.lit(0), F.lit(hours - 1))
    avail = F.coalesce(F.col("available_required_hours"), F.lit(0).cast("bigint"))
    missing = F.array_sort(F.array_except(all_lags, F.coalesce(F.col("__lags"), F.array().cast("array<int>"))))
    return j.select("reference_hour", avail.alias("available_required_hours"),
                    F.lit(hours).alias("required_hours"), missing.alias("missing_lags"),
                    (avail == hours).alias("ready"))


def live_feature_rows(spark: SparkSession, hourly: DataFrame, refs: DataFrame,
                      area: str = C.GEOFENCE_NAME, digits: int | None = 9) -> DataFrame:
    """W7 for many reference hours: counters of the reference hour, lags and
    rolling means over the previous hours with a missing hour read as 0,
    calendar and cyclical features, the area centroid; 45 ordered columns.
    """
    fan = (hourly.select(F.explode(F.sequence(F.lit(0), F.lit(24))).alias("lag"), "timestamp_utc",
                         *LIVE_COUNTERS)
           .select("lag", (F.col("timestamp_utc").cast("timestamp") + F.make_dt_interval(hours=F.col("lag")))
                   .cast("timestamp_ntz").alias("reference_hour"), *LIVE_COUNTERS))
    aggs = []
    for c in LIVE_COUNTERS:
        aggs.append(F.sum(F.when(F.col("lag") == 0, F.col(c))).alias(c))
    for c, ks in C.LAGS.items():
        for k in ks:
            aggs.append(F.sum(F.when(F.col("lag") == k, F.col(c))).alias(f"{c}_lag_{k}h"))
    for c, ks in C.ROLLING.items():
        for k in ks:
            aggs.append(F.sum(F.when((F.col("lag") >= 1) & (F.col("lag") <= k), F.col(c)))
                        .alias(f"__sum_{c}_{k}"))
    g = fan.groupBy("reference_hour").agg(*aggs)
    j = refs.join(g, "reference_hour", "left")
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("bigint")
    cols = [zero(F.col(c)).alias(c) for c in LIVE_COUNTERS]
    cols += [zero(F.col(f"{c}_lag_{k}h")).alias(f"{c}_lag_{k}h") for c, ks in C.LAGS.items() for k in ks]
    cols += [(zero(F.col(f"__sum_{c}_{k}")) / F.lit(float(k))).alias(f"{c}_rolling_mean_{k}h")
             for c, ks in C.ROLLING.items() for k in ks]
    base = j.select(F.col("reference_hour").alias("timestamp_utc"), *cols)
    cal = base.select("*", *calendar_columns("timestamp_utc"))
    cyc = cal.select("*", *cyclical_columns(digits=digits))
    lat, lon = C.AREA_CENTROIDS[area]
    out = cyc.select("*", F.lit(lat).alias("centroid_lat"), F.lit(lon).alias("centroid_lon"),
                     F.lit(area).alias("study_area"))
    return out.select("timestamp_utc", *C.FEATURE_COLUMNS)
