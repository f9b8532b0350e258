"""Read-side queries over vessel state, history, search documents and events.

Lists are ``orderBy(...).limit(n)`` — planned as TakeOrderedAndProject, a
per-partition top-n merged on the driver, so only n rows per partition move.
Every ordering ends in a unique tie-breaker so a limited list is deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.display import speed_category, vessel_name_default
from ..functions.shiptype import ship_group

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def _ts(v):
    return F.lit(v).cast("timestamp_ntz")


def active_vessels(current: DataFrame, now, minutes: int = C.ACTIVE_WINDOW_MINUTES,
                   limit: int | None = None) -> DataFrame:
    """K1: current rows with timestamp >= now - minutes, newest first."""
    cut = _ts(now) - F.make_dt_interval(mins=F.lit(minutes))
    out = current.filter(F.col("timestamp") >= cut).orderBy(F.desc("timestamp"), "mmsi")
    return out.limit(limit) if limit else out


def vessel_history(history: DataFrame, mmsi: str, start=None, end=None, limit: int = 500) -> DataFrame:
    """K3: one vessel, optional closed range, oldest first."""
    h = history.filter(F.col("mmsi") == mmsi)
    if start is not None:
        h = h.filter(F.col("timestamp") >= _ts(start))
    if end is not None:
        h = h.filter(F.col("timestamp") <= _ts(end))
    return h.orderBy("timestamp", "offset").limit(min(limit, 5000))


def event_query(events: DataFrame, start=None, end=None, event_type=None, limit: int = 100) -> DataFrame:
    """K4: optional closed time range and type, newest first."""
    e = events
    if start is not None:
        e = e.filter(F.col("timestamp") >= _ts(start))
    if end is not None:
        e = e.filter(F.col("timestamp") <= _ts(end))
    if event_type is not None:
        e = e.filter(F.col("event_type") == event_type)
    return e.orderBy(F.desc("timestamp"), "mmsi", "offset").limit(min(limit, 1000))


def _tokens(col):
    arr = F.split(F.lower(F.coalesce(F.col(col), F.lit(""))), TOKEN_SPLIT)
    return F.filter(arr, lambda t: t != "")


def search_vessels(docs: DataFrame, query: str | None, limit: int = 50) -> DataFrame:
    """K5: a document matches when any query token equals any token of mmsi, imo or name."""
    d = docs
    if query and query.strip():
        q = F.filter(F.split(F.lower(F.lit(query)), TOKEN_SPLIT), lambda t: t != "")
        fields = F.concat(_tokens("mmsi"), _tokens("imo"), _tokens("vessel_name"))
        d = d.filter(F.size(F.array_intersect(fields, q)) > 0)
    return d.orderBy(F.desc("timestamp"), "mmsi").limit(min(limit, 500))


def search_positions(docs: DataFrame, mmsi: str, limit: int = 500) -> DataFrame:
    """K6: exact mmsi, oldest first."""
    return docs.filter(F.col("mmsi") == mmsi).orderBy("timestamp", "offset").limit(limit)


def fleet_filter_sort(current: DataFrame, query: str = "", speed: str = "all",
                      sort_by: str = "newest") -> DataFrame:
    """K7: substring on display name or mmsi, speed-category filter, sort."""
    name = vessel_name_default()
    out = current.select("mmsi", name.alias("display_name"), "sog", "timestamp")
    q = (query or "").strip().lower()
    if q:
        out = out.filter(F.lower("display_name").contains(q) | F.lower("mmsi").contains(q))
    if speed != "all":
        out = out.filter(speed_category("sog") == speed)
    if sort_by == "name":
        return out.orderBy("display_name", "mmsi")
    if sort_by == "speed":
        s = F.when(F.isnan("sog"), None).otherwise(F.col("sog"))
        return out.orderBy(F.coalesce(s, F.lit(-1.0)).desc(), "mmsi")
    return out.orderBy(F.desc("timestamp"), "mmsi")


def vessel_composition(spark: SparkSession, current: DataFrame) -> DataFrame:
    """Current vessels per group (unmapped -> other); all 7 groups listed."""
    groups = spark.createDataFrame([(g,) for g in C.SHIP_GROUPS + ["other"]], "ship_group string")
    counts = (current.groupBy(F.coalesce(ship_group("ship_type"), F.lit("other")).alias("ship_group"))
              .agg(F.count(F.lit(1)).alias("vessels")))
    return (F.broadcast(groups).join(counts, "ship_group", "left")
            .select("ship_group", F.coalesce("vessels", F.lit(0).cast("bigint")).alias("vessels")))


def average_speed(current: DataFrame) -> DataFrame:
    """Mean sog, one decimal; null sog is skipped (SQL semantics)."""
    return current.agg(F.round(F.avg("sog"), 1).alias("average_speed"),
                       F.count("sog").alias("vessels_with_speed"))


def track_duration(history: DataFrame) -> DataFrame:
    """Minutes between first and last point, rounded half up; fewer than 2 points -> null."""
    mins = F.floor((F.unix_micros(F.max("timestamp").cast("timestamp")) -
                    F.unix_micros(F.min("timestamp").cast("timestamp"))) / F.lit(60_000_000) + 0.5).cast("bigint")
    return history.groupBy("mmsi").agg(F.count(F.lit(1)).alias("points"),
                                       F.when(F.count(F.lit(1)) >= 2, mins).alias("duration_minutes"))


def speed_counts(current: DataFrame) -> DataFrame:
    """Total, moving (5 <= sog < 15), fast (sog >= 15): each vessel is in one category."""
    return current.agg(F.count(F.lit(1)).alias("total"),
                       F.count(F.when((F.col("sog") >= 5) & (F.col("sog") < 15), 1)).alias("moving"),
                       F.count(F.when(F.col("sog") >= 15, 1)).alias("fast"))


def active_counts(current: DataFrame, now, minutes: int = C.ACTIVE_WINDOW_MINUTES) -> DataFrame:
    """Vessels seen within the window, and all stored current vessels."""
    cut = _ts(now) - F.make_dt_interval(mins=F.lit(minutes))
    return current.agg(F.count(F.when(F.col("timestamp") >= cut, 1)).alias("active_total"),
                       F.count(F.lit(1)).alias("stored_total"))


def geofence_status(state: DataFrame, events: DataFrame) -> DataFrame:
    """Tracked vessels and inside-now from the final state; entry / exit totals."""
    s = state.agg(F.count(F.lit(1)).alias("tracked_vessels"),
                  F.count(F.when(F.col("inside"), 1)).alias("inside_now"))
    e = events.agg(F.count(F.when(F.col("event_type") == "ENTRY", 1)).alias("entries"),
                   F.count(F.when(F.col("event_type") == "EXIT", 1)).alias("exits"))
    return s.select("tracked_vessels", "inside_now",
                    e.select("entries").scalar().alias("entries"),
                    e.select("exits").scalar().alias("exits"))
