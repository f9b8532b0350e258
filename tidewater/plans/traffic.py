"""Registered queries: batch voyage events -> dense hourly panel -> window features."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..functions.timefeat import floor_hour, hour_key
from ..operators import features as FT
from ..operators import hourly as H
from ..sources import adapters as A
from . import sqlparts as Q
from .registry import register

START, END = A.EVENTS_START, A.EVENTS_END
TE = A.TRAFFIC_EVENTS_SQL
PANEL_SQL = Q.panel_sql(TE, START, END)
DIGITS = 9


def panel(spark, sf):
    return H.hourly_traffic(spark, A.traffic_events(spark, sf), START, END)


@register("hourly_traffic", f"SELECT * FROM ({PANEL_SQL}) p")
def hourly_traffic(spark, sf):
    """A1 + J1 (flagship core): dense 10-counter panel per area and hour."""
    return panel(spark, sf)


@register("densify_hours", f"""
SELECT c.study_area, c.timestamp_utc, (s.study_area IS NOT NULL) AS observed,
       CAST(COALESCE(s.total_events, 0) AS BIGINT) AS total_events
FROM ({Q.calendar_sql(START, END)}) c
LEFT JOIN ({Q.hourly_counts_sql(TE, START, END)}) s
  ON c.study_area = s.study_area AND c.timestamp_utc = s.timestamp_utc""")
def densify_hours(spark, sf):
    """Calendar left join, with a flag telling observed from filled hours."""
    ev = A.traffic_events(spark, sf)
    sparse = H.hourly_counts(ev.filter((F.col("event_time") >= H._ts(START)) &
                                       (F.col("event_time") < H._ts(END))))
    cal = H.hour_calendar(spark, START, END)
    j = cal.join(sparse.select("study_area", "timestamp_utc", "total_events"),
                 ["study_area", "timestamp_utc"], "left")
    return j.select("study_area", "timestamp_utc",
                    F.col("total_events").isNotNull().alias("observed"),
                    F.coalesce("total_events", F.lit(0)).cast("bigint").alias("total_events"))


@register("flagship", f"""
SELECT study_area, timestamp_utc, total_events, arrivals, departures, unique_vessels,
       {Q.lag_sql()},
       {Q.rolling_sql()}
FROM ({PANEL_SQL}) p
{Q.WINDOW}""")
def flagship(spark, sf):
    """events -> area/hour -> A1 -> J1 -> W1 + W2: hourly traffic with history."""
    p = panel(spark, sf).select("study_area", "timestamp_utc", "total_events", "arrivals",
                                "departures", "unique_vessels")
    return p.select("*", *FT.lag_columns(), *FT.rolling_columns())


@register("lag_features", f"""
SELECT study_area, timestamp_utc, {", ".join(C.LAGS)},
       {Q.lag_sql()}
FROM ({PANEL_SQL}) p
{Q.WINDOW}""")
def lag_features(spark, sf):
    """Per-area lags 1/2/3/6/24 h on the dense panel."""
    p = panel(spark, sf).select("study_area", "timestamp_utc", *C.LAGS)
    return FT.add_lags(p)


@register("rolling_means", f"""
SELECT study_area, timestamp_utc, total_events, arrivals,
       {Q.rolling_sql()}
FROM ({PANEL_SQL}) p
{Q.WINDOW}""")
def rolling_means(spark, sf):
    """Mean of the previous 3/6/24 hours (current hour excluded)."""
    p = panel(spark, sf).select("study_area", "timestamp_utc", "total_events", "arrivals")
    return FT.add_rolling(p)


@register("future_targets", f"""
SELECT study_area, timestamp_utc, total_events, arrivals, unique_vessels,
       {Q.future_sql()}
FROM ({PANEL_SQL}) p
{Q.WINDOW}""")
def future_targets(spark, sf):
    """Next hour's total, arrivals and unique vessels per area."""
    p = panel(spark, sf).select("study_area", "timestamp_utc", "total_events", "arrivals",
                                "unique_vessels")
    return FT.add_future_targets(p)


@register("calendar_features", f"""
SELECT study_area, timestamp_utc, {Q.calendar_cols_sql()}
FROM ({Q.calendar_sql(START, END)}) c""")
def calendar_features(spark, sf):
    """Oslo-local hour, weekday (Monday = 0), month, day of year, weekend flag."""
    return FT.add_calendar(panel(spark, sf).select("study_area", "timestamp_utc"))


@register("cyclical_features", f"""
SELECT study_area, timestamp_utc, hour_local, day_of_week, month, {Q.cyclical_cols_sql(DIGITS)}
FROM (SELECT study_area, timestamp_utc, {Q.calendar_cols_sql()}
      FROM ({Q.calendar_sql(START, END)}) c) x""")
def cyclical_features(spark, sf):
    """sin/cos of hour/24, weekday/7, (month-1)/12 (rounded to 9 digits)."""
    cal = FT.add_calendar(panel(spark, sf).select("study_area", "timestamp_utc"))
    return FT.add_cyclical(cal.select("study_area", "timestamp_utc", "hour_local", "day_of_week",
                                      "month"), DIGITS)


@register("centroid_features", f"""
SELECT p.study_area, p.timestamp_utc, p.total_events, c.centroid_lat, c.centroid_lon
FROM ({PANEL_SQL}) p LEFT JOIN {Q.centroids_values()} c ON p.study_area = c.study_area""")
def centroid_features(spark, sf):
    """Broadcast lookup of the area centroid."""
    p = panel(spark, sf).select("study_area", "timestamp_utc", "total_events")
    return FT.add_centroids(spark, p)


@register("time_range_filter", f"""
SELECT study_area, seilas_id, event_type, event_time FROM ({TE}) e
WHERE event_time >= TIMESTAMP '2024-01-10 00:00:00' AND event_time < TIMESTAMP '2024-01-20 00:00:00'""")
def time_range_filter(spark, sf):
    """Keep start <= t < end (the bounds reach the Parquet scan)."""
    ev = A.traffic_events(spark, sf)
    return ev.filter((F.col("event_time") >= H._ts("2024-01-10 00:00:00")) &
                     (F.col("event_time") < H._ts("2024-01-20 00:00:00"))) \
             .select("study_area", "seilas_id", "event_type", "event_time")


@register("floor_hour", f"""
SELECT seilas_id, date_trunc('hour', event_time) AS hour_utc,
       strftime(event_time, '%Y%m%d%H') AS hour_key
FROM ({TE}) e""")
def floor_hour_q(spark, sf):
    """UTC hour start and its ``yyyyMMddHH`` key."""
    ev = A.traffic_events(spark, sf)
    return ev.select("seilas_id", floor_hour("event_time").alias("hour_utc"),
                     hour_key("event_time").alias("hour_key"))


_IND_SQL = ",\n".join(
    f"CAST(COALESCE(trim(skipsgruppe) = {Q.lit(t)}, false) AS INTEGER) AS is_{n.replace('_events', '')}"
    for t, n in C.SKIPSGRUPPE_COUNTERS.items())


@register("event_indicators", f"""
SELECT seilas_id, study_area, {_IND_SQL},
       CAST(event_type = 'arrival' AS INTEGER) AS is_arrival,
       CAST(event_type = 'departure' AS INTEGER) AS is_departure
FROM ({TE}) e""")
def event_indicators(spark, sf):
    """0/1 flags from ship group and event type (null group -> 0)."""
    ev = A.traffic_events(spark, sf)
    g = F.trim("skipsgruppe")
    flags = [F.coalesce(g == F.lit(t), F.lit(False)).cast("int").alias(f"is_{n.replace('_events', '')}")
             for t, n in C.SKIPSGRUPPE_COUNTERS.items()]
    return ev.select("seilas_id", "study_area", *flags,
                     (F.col("event_type") == "arrival").cast("int").alias("is_arrival"),
                     (F.col("event_type") == "departure").cast("int").alias("is_departure"))
