"""Hourly traffic counters per study area (A1, A2, J1, X4 batch form).

Plan shape: one partial/final hash aggregate keyed by (area, hour) — Spark
pre-aggregates per map task, so a hot area or hour is reduced before the
shuffle — then a left join of the dense (area x hour) calendar.  The calendar
is ``explode(sequence(...))`` over the small area list: its size is areas x
hours and does not grow with the event volume.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.shiptype import ship_group
from ..functions.timefeat import floor_hour


def _ts(v) -> Column:
    if isinstance(v, Column):
        return v.cast("timestamp_ntz")
    if isinstance(v, dt.datetime):
        v = v.strftime("%Y-%m-%d %H:%M:%S")
    return F.lit(v).cast("timestamp_ntz")


def areas_frame(spark: SparkSession, areas=None) -> DataFrame:
    """Small fixed dimension of study areas (bounded by the configured list)."""
    areas = list(areas or C.STUDY_AREAS)
    return spark.createDataFrame([(a,) for a in areas], "study_area string")


def hour_calendar(spark: SparkSession, start, end, areas=None) -> DataFrame:
    """Dense (study_area, timestamp_utc) rows for ``start <= hour < end``."""
    hours = F.sequence(_ts(start), _ts(end) - F.expr("INTERVAL 1 HOUR"), F.expr("INTERVAL 1 HOUR"))
    return areas_frame(spark, areas).select("study_area", F.explode(hours).alias("timestamp_utc"))


def _count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def group_counters(group: Column) -> list[Column]:
    """Six per-group event counts from the historical ship-group text."""
    g = F.trim(group)
    return [_count_if(g == F.lit(text)).alias(name) for text, name in C.SKIPSGRUPPE_COUNTERS.items()]


def hourly_counts(events: DataFrame, time_col: str = "event_time") -> DataFrame:
    """A1 core: sparse counters per (study_area, hour) from batch events."""
    return (events
            .groupBy("study_area", floor_hour(time_col).alias("timestamp_utc"))
            .agg(F.count(F.lit(1)).alias("total_events"),
                 _count_if(F.col("event_type") == "arrival").alias("arrivals"),
                 _count_if(F.col("event_type") == "departure").alias("departures"),
                 F.countDistinct("vessel_key").alias("unique_vessels"),
                 *group_counters(F.col("skipsgruppe"))))


def densify(spark: SparkSession, sparse: DataFrame, start, end, areas=None,
            counters=None) -> DataFrame:
    """Left join the full hour calendar; missing counters -> 0."""
    counters = counters or C.COUNTER_COLUMNS
    cal = hour_calendar(spark, start, end, areas)
    joined = cal.join(sparse, ["study_area", "timestamp_utc"], "left")
    return joined.select("study_area", "timestamp_utc",
                         *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in counters])


def hourly_traffic(spark: SparkSession, events: DataFrame, start, end, areas=None) -> DataFrame:
    """A1 + J1: dense hourly panel of the 10 counters per study area."""
    inside = events.filter((F.col("event_time") >= _ts(start)) & (F.col("event_time") < _ts(end)))
    return densify(spark, hourly_counts(inside), start, end, areas)


def hourly_traffic_span(events: DataFrame, areas=None) -> DataFrame:
    """A1 + J1 over the whole span of the data: from the first to the last hour that holds an event.

    The bounds come from the aggregated counters, whose exchange the join reads again.
    """
    sparse = hourly_counts(events)
    bounds = sparse.agg(F.min("timestamp_utc").alias("first"), F.max("timestamp_utc").alias("last"))
    hours = bounds.select(F.explode(F.sequence("first", "last", F.expr("INTERVAL 1 HOUR"))).alias("timestamp_utc"))
    areas = F.array(*[F.lit(a) for a in areas or C.STUDY_AREAS])
    joined = hours.select(F.explode(areas).alias("study_area"), "timestamp_utc").join(sparse, ["study_area", "timestamp_utc"], "left")
    return joined.select("study_area", "timestamp_utc", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in C.COUNTER_COLUMNS])


def live_hourly_counts(traffic_events: DataFrame) -> DataFrame:
    """A2: counters per UTC hour from live ENTRY / EXIT events.

    ENTRY counts as arrival, EXIT as departure; the AIS ship type maps to a
    group, and an unmapped type counts only in the total.
    """
    grp = ship_group(F.col("ship_type"))
    return (traffic_events
            .groupBy(floor_hour("timestamp").alias("timestamp_utc"))
            .agg(F.count(F.lit(1)).alias("total_events"),
                 _count_if(F.col("event_type") == "ENTRY").alias("arrivals"),
                 _count_if(F.col("event_type") == "EXIT").alias("departures"),
                 F.countDistinct("mmsi").alias("unique_vessels"),
                 *[_count_if(grp == F.lit(g)).alias(f"{g}_events") for g in C.SHIP_GROUPS]))


def zero_hour_snapshot(positions: DataFrame, traffic_events: DataFrame) -> DataFrame:
    """X4 batch form: every hour in which any position arrived gets a row, with
    zero counters where no event happened (known zero, not missing)."""
    observed = positions.select(floor_hour("timestamp").alias("timestamp_utc")).distinct()
    counts = live_hourly_counts(traffic_events)
    joined = observed.join(counts, "timestamp_utc", "full")
    return joined.select("timestamp_utc",
                         *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
                           for c in C.COUNTER_COLUMNS])
