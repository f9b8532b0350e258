"""Registered queries: live AIS positions -> geofence events, vessel state, read API."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..functions import display as D
from ..functions import geo as G
from ..functions import shiptype as S
from ..functions.timefeat import age_seconds, freshness_label
from ..operators import hourly as H
from ..operators import ingest as I
from ..operators import live as L
from ..operators import serve as V
from ..sources import adapters as A
from ..streaming import geofence as GS
from . import sqlparts as Q
from .registry import register

POS = A.AIS_POSITIONS_SQL
POS2 = A.AIS_POSITIONS_REDELIVERED_SQL
BOX = (f"COALESCE(latitude BETWEEN {C.GEOFENCE_MIN_LAT}::DOUBLE AND {C.GEOFENCE_MAX_LAT}::DOUBLE "
       f"AND longitude BETWEEN {C.GEOFENCE_MIN_LON}::DOUBLE AND {C.GEOFENCE_MAX_LON}::DOUBLE, false)")
SPLIT_TS = "2024-01-15 00:00:00"      # rows before: already stored; after: new batch
NOW = "2024-01-31 00:00:00"            # reference "now" for live read queries
ACTIVE_MINUTES = 600
EV_COLS = 'mmsi, event_type, "timestamp", latitude, longitude, vessel_name, ship_type, sog, source, "offset"'


def positions(spark, sf):
    return A.ais_positions(spark, sf)


def events_of(spark, sf):
    return L.geofence_transitions(positions(spark, sf))


def _sql_transitions(src: str) -> str:
    """Oracle form of W4: (1) drop rows older than the max of earlier arrivals,
    (2) lag(inside) over accepted rows, (3) emit where it changes."""
    return f"""
WITH p AS (SELECT *, {BOX} AS inside FROM ({src}) x
           WHERE mmsi IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL),
m AS (SELECT *, max("timestamp") OVER (PARTITION BY mmsi ORDER BY "offset"
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_max FROM p),
acc AS (SELECT *, LAG(inside) OVER (PARTITION BY mmsi ORDER BY "offset") AS prev_inside
        FROM m WHERE prev_max IS NULL OR "timestamp" >= prev_max)
SELECT mmsi, CASE WHEN inside THEN 'ENTRY' ELSE 'EXIT' END AS event_type, "timestamp", latitude,
       longitude, vessel_name, ship_type, sog, source, "offset"
FROM acc WHERE prev_inside IS NOT NULL AND prev_inside <> inside"""


EVENTS_SQL = _sql_transitions(POS)

# ---------------------------------------------------------------------------
# Scalars on positions
# ---------------------------------------------------------------------------


@register("geofence_filter", f'SELECT mmsi, "offset", latitude, longitude, {BOX} AS inside FROM ({POS}) p')
def geofence_filter(spark, sf):
    """Closed-box membership of every position."""
    return positions(spark, sf).select("mmsi", "offset", "latitude", "longitude",
                                       F.coalesce(G.inside_box(), F.lit(False)).alias("inside"))


_CODE_SPARK = lambda: (F.when(F.col("event_id") % 17 == 0, F.lit("invalid"))
                       .otherwise(((F.col("event_id") * 7) % 121 - 10).cast("string")))
_CODE_SQL = "CASE WHEN event_id % 17 = 0 THEN 'invalid' ELSE CAST((event_id * 7) % 121 - 10 AS VARCHAR) END"


def _sql_norm_code(x: str) -> str:
    return f"CASE WHEN TRY_CAST(trim({x}) AS INTEGER) BETWEEN 0 AND 99 THEN TRY_CAST(trim({x}) AS INTEGER) END"


def _sql_group(x: str) -> str:
    v = _sql_norm_code(x)
    return f"""CASE WHEN {v} IN {Q.in_list(C.FISHING_CODES)} THEN 'fishing'
     WHEN {v} IN {Q.in_list(C.TUG_CODES)} THEN 'tug'
     WHEN {v} BETWEEN {C.PASSENGER_RANGE[0]} AND {C.PASSENGER_RANGE[1]} THEN 'passenger'
     WHEN {v} BETWEEN {C.CARGO_RANGE[0]} AND {C.CARGO_RANGE[1]} THEN 'cargo'
     WHEN {v} BETWEEN {C.TANKER_RANGE[0]} AND {C.TANKER_RANGE[1]} THEN 'tanker'
     WHEN {v} IN {Q.in_list(C.AUXILIARY_CODES)} THEN 'auxiliary' END"""


@register("ship_type_group", f"""
SELECT event_id, code, {_sql_norm_code('code')} AS ship_type, {_sql_group('code')} AS ship_group
FROM (SELECT event_id, {_CODE_SQL} AS code FROM events) e""")
def ship_type_group(spark, sf):
    """AIS code text -> normalised code (0..99) and group."""
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", _CODE_SPARK().alias("code"))
    return ev.select("event_id", "code", S.normalize_ship_type("code").alias("ship_type"),
                     S.ship_group("code").alias("ship_group"))


@register("ship_type_label", f"""
SELECT event_id, code,
       CASE WHEN TRY_CAST(trim(code) AS INTEGER) IS NULL THEN 'Unknown'
            WHEN {_sql_group('code')} IS NOT NULL THEN upper(substr({_sql_group('code')}, 1, 1)) || substr({_sql_group('code')}, 2)
            ELSE 'AIS ' || CAST(TRY_CAST(trim(code) AS INTEGER) AS VARCHAR) END AS label
FROM (SELECT event_id, {_CODE_SQL} AS code FROM events) e""")
def ship_type_label(spark, sf):
    """P20: display label of an AIS code."""
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", _CODE_SPARK().alias("code"))
    return ev.select("event_id", "code", S.ship_type_label("code").alias("label"))


_RULES_SQL = "(SELECT * FROM (VALUES " + ", ".join(
    f"({Q.lit(g)}, {Q.lit(C.SHIP_GROUP_RULES[g])})" for g in C.SHIP_GROUPS) + ") t(ship_group, ais_codes))"


@register("ship_type_mapping_info", f"""
SELECT r.ship_group, r.ais_codes, COALESCE(c.positions, 0) AS positions
FROM {_RULES_SQL} r LEFT JOIN (
  SELECT {_sql_group('CAST(ship_type AS VARCHAR)')} AS ship_group, COUNT(*) AS positions
  FROM ({POS}) p GROUP BY 1) c ON r.ship_group = c.ship_group""")
def ship_type_mapping_info(spark, sf):
    """The mapping table, with how many positions fall in each group."""
    counts = (positions(spark, sf).groupBy(S.ship_group("ship_type").alias("ship_group"))
              .agg(F.count(F.lit(1)).alias("positions")))
    return (F.broadcast(S.mapping_table(spark)).join(counts, "ship_group", "left")
            .select("ship_group", "ais_codes",
                    F.coalesce("positions", F.lit(0).cast("bigint")).alias("positions")))


@register("speed_category", f"""
SELECT mmsi, "offset", sog, CASE WHEN sog IS NULL OR isnan(sog) THEN 'unknown' WHEN sog >= 15 THEN 'fast'
       WHEN sog >= 5 THEN 'moving' ELSE 'slow' END AS speed_category
FROM ({POS}) p""")
def speed_category(spark, sf):
    """Speed bucket of each position."""
    return positions(spark, sf).select("mmsi", "offset", "sog",
                                       D.speed_category("sog").alias("speed_category"))


@register("heading_direction", f"""
SELECT mmsi, "offset", COALESCE(CASE WHEN heading BETWEEN 0 AND 360 THEN heading END,
                                CASE WHEN cog BETWEEN 0 AND 360 THEN cog END, 0.0::DOUBLE) AS direction
FROM ({POS}) p""")
def heading_direction(spark, sf):
    """Heading, else course, else 0."""
    return positions(spark, sf).select("mmsi", "offset", G.heading_direction().alias("direction"))


def _sql_projection() -> str:
    course = ("COALESCE(CASE WHEN cog BETWEEN 0 AND 360 THEN cog END, "
              "CASE WHEN heading BETWEEN 0 AND 360 THEN heading END)")
    ok = ("(latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT isnan(latitude) "
          f"AND NOT isnan(longitude) AND sog > 0 AND {course} IS NOT NULL)")
    d = f"(sog * {C.PROJECTION_HOURS}::DOUBLE / {C.EARTH_RADIUS_NM}::DOUBLE)"
    phi1, lam1, th = "radians(latitude)", "radians(longitude)", f"radians({course})"
    phi2 = f"asin(sin({phi1}) * cos({d}) + cos({phi1}) * sin({d}) * cos({th}))"
    lam2 = f"({lam1} + atan2(sin({th}) * sin({d}) * cos({phi1}), cos({d}) - sin({phi1}) * sin({phi2})))"
    return (f"CASE WHEN {ok} THEN round(degrees({phi2}), 9) END AS projected_lat, "
            f"CASE WHEN {ok} THEN round(degrees({lam2}), 9) END AS projected_lon")


@register("project_position", f'SELECT mmsi, "offset", {_sql_projection()} FROM ({POS}) p')
def project_position(spark, sf):
    """30-minute great-circle dead reckoning (rounded to 9 digits)."""
    lat, lon = G.project_position()
    return positions(spark, sf).select("mmsi", "offset", F.round(lat, 9).alias("projected_lat"),
                                       F.round(lon, 9).alias("projected_lon"))


@register("valid_coordinates", f"""
SELECT mmsi, "offset", COALESCE(NOT isnan(latitude) AND NOT isnan(longitude)
       AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180, false) AS valid
FROM ({POS}) p""")
def valid_coordinates(spark, sf):
    """Finite coordinates within the world ranges."""
    return positions(spark, sf).select("mmsi", "offset", G.valid_coordinates().alias("valid"))


@register("vessel_name_default", f"""
SELECT mmsi, "offset", COALESCE(NULLIF(vessel_name, ''), 'Unknown vessel') AS display_name FROM ({POS}) p""")
def vessel_name_default(spark, sf):
    """Empty or missing name -> ``Unknown vessel``."""
    return positions(spark, sf).select("mmsi", "offset",
                                       D.vessel_name_default().alias("display_name"))


_LATEST_SQL = f"""(SELECT * FROM ({POS}) p
 QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY "timestamp" DESC, "offset" ASC) = 1)"""


def _sql_fresh(ts: str, now: str) -> str:
    a = f"greatest((epoch_us({now}) - epoch_us({ts})) // 1000000, 0)"
    return f"""CASE WHEN {ts} IS NULL THEN 'Unknown'
  WHEN {a} < 60 THEN CAST({a} AS VARCHAR) || 's ago'
  WHEN {a} < 3600 THEN CAST({a} // 60 AS VARCHAR) || 'm ago'
  WHEN {a} < 86400 THEN CAST({a} // 3600 AS VARCHAR) || 'h ago'
  ELSE strftime({ts}, '%Y-%m-%d %H:%M') END"""


@register("freshness_age", f"""
SELECT mmsi, "timestamp",
  greatest((epoch_us(TIMESTAMP '{NOW}') - epoch_us("timestamp")) // 1000000, 0) AS age_seconds,
  {_sql_fresh('"timestamp"', f"TIMESTAMP '{NOW}'")} AS freshness
FROM {_LATEST_SQL} l""")
def freshness_age(spark, sf):
    """Age of each vessel's newest position against a reference time."""
    latest = L.latest_per_vessel(positions(spark, sf))
    now = F.lit(NOW).cast("timestamp")
    return latest.select("mmsi", "timestamp", age_seconds("timestamp", now).alias("age_seconds"),
                         freshness_label("timestamp", now).alias("freshness"))


# ---------------------------------------------------------------------------
# Ingest: decode, validate, normalise
# ---------------------------------------------------------------------------

def _sql_reason() -> str:
    return """CASE WHEN event_id % 89 = 0 THEN 'decode' WHEN event_id % 83 = 0 THEN 'decode'
  WHEN event_id % 79 = 0 THEN 'blank' WHEN event_id % 97 = 0 THEN 'missing_field'
  WHEN event_id % 50 = 0 THEN 'bad_timestamp' END"""


_DECODED_SQL = f"""
SELECT CASE WHEN r IS NULL THEN mmsi END AS mmsi, CASE WHEN r IS NULL THEN vessel_name END AS vessel_name,
  CASE WHEN r IS NULL THEN latitude END AS latitude, CASE WHEN r IS NULL THEN longitude END AS longitude,
  CASE WHEN r IS NULL THEN sog END AS sog, CASE WHEN r IS NULL THEN cog END AS cog,
  CASE WHEN r IS NULL THEN heading END AS heading, CASE WHEN r IS NULL THEN nav_status END AS nav_status,
  CASE WHEN r IS NULL THEN ship_type END AS ship_type, CASE WHEN r IS NULL THEN rate_of_turn END AS rate_of_turn,
  CASE WHEN r IS NULL THEN "timestamp" END AS "timestamp", source, "offset", r AS reject_reason
FROM (SELECT *, {_sql_reason()} AS r FROM ({POS}) p) x"""


@register("validate_positions", f"SELECT * FROM ({_DECODED_SQL}) d")
def validate_positions(spark, sf):
    """Decode + validate each line; bad records keep a reject reason."""
    return I.decode_messages(A.raw_ais_messages(spark, sf))


@register("normalize_ais", f"""
SELECT {', '.join('"timestamp"' if c == 'timestamp' else ('"offset"' if c == 'offset' else c) for c in I.POSITION_COLUMNS)}
FROM ({_DECODED_SQL}) d WHERE reject_reason IS NULL""")
def normalize_ais(spark, sf):
    """Raw camelCase messages -> positions (time in UTC, mmsi as text)."""
    return I.normalize_positions(A.raw_ais_messages(spark, sf))


@register("to_utc", f"""
SELECT "offset", "timestamp" AS utc_time FROM ({_DECODED_SQL}) d WHERE reject_reason IS NULL""")
def to_utc_q(spark, sf):
    """``Z``, ``+01:00`` and zone-less message times all land on the same UTC instant."""
    raw = A.raw_ais_messages(spark, sf)
    d = I.decode_messages(raw).filter(F.col("reject_reason").isNull())
    return d.select("offset", F.col("timestamp").alias("utc_time"))


@register("pipeline_counters", f"""
SELECT COUNT(*) AS received, {Q.count_if("reject_reason = 'blank'")} AS skipped_blank,
  {Q.count_if("reject_reason = 'decode'")} AS failed_decode,
  {Q.count_if("reject_reason IN ('missing_field', 'bad_timestamp')")} AS failed_validation,
  {Q.count_if("reject_reason IS NULL")} AS processed
FROM ({_DECODED_SQL}) d""")
def pipeline_counters(spark, sf):
    """Received / skipped / failed by stage / processed."""
    return I.pipeline_counters(I.decode_messages(A.raw_ais_messages(spark, sf)))


# ---------------------------------------------------------------------------
# Geofence events and vessel state stores
# ---------------------------------------------------------------------------

@register("geofence_transitions", f"SELECT * FROM ({EVENTS_SQL}) e")
def geofence_transitions(spark, sf):
    """ENTRY / EXIT per vessel in arrival order; stale rows ignored."""
    return events_of(spark, sf)


@register("late_data_rule", f"""
WITH m AS (SELECT *, max("timestamp") OVER (PARTITION BY mmsi ORDER BY "offset"
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM ({POS}) p)
SELECT COUNT(*) AS "rows", {Q.count_if('"timestamp" < pm')} AS geofence_ignored,
       {Q.count_if('"timestamp" <= pm')} AS latest_state_ignored,
       COUNT(*) AS history_kept, COUNT(*) AS last_arrival_accepted FROM m""")
def late_data_rule(spark, sf):
    """How many rows each store's late-data rule drops or keeps."""
    return L.late_rows(positions(spark, sf))


@register("latest_per_vessel", f"SELECT * FROM {_LATEST_SQL} l")
def latest_per_vessel(spark, sf):
    """Newest row per mmsi, ties -> first arrival."""
    return L.latest_per_vessel(positions(spark, sf))


@register("last_arrival_cache", f"""
SELECT * FROM ({POS}) p QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY "offset" DESC) = 1""")
def last_arrival_cache(spark, sf):
    """Last-arrived row per mmsi (may go back in event time)."""
    return L.last_arrival_per_vessel(positions(spark, sf))


@register("search_sink", f"""
SELECT *, mmsi || '-' || strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%f') AS doc_id FROM ({POS2}) p
QUALIFY row_number() OVER (PARTITION BY mmsi, "timestamp" ORDER BY "offset" DESC) = 1""")
def search_sink(spark, sf):
    """Documents keyed ``mmsi-time`` after redelivery (last write wins)."""
    return L.search_documents(A.ais_positions(spark, sf, redeliver=True))


_HIST_SQL = f"""(SELECT * FROM ({POS2}) p
 QUALIFY row_number() OVER (PARTITION BY mmsi, "timestamp" ORDER BY "offset") = 1)"""


@register("history_sink", f"SELECT * FROM {_HIST_SQL} h")
def history_sink(spark, sf):
    """History after redelivery; the first write per (mmsi, time) wins."""
    return L.history_rows(A.ais_positions(spark, sf, redeliver=True))


@register("anti_join_insert", f"""
SELECT * FROM {_HIST_SQL} h
WHERE NOT EXISTS (SELECT 1 FROM ({POS}) s WHERE s."timestamp" < TIMESTAMP '{SPLIT_TS}'
                  AND s.mmsi = h.mmsi AND s."timestamp" = h."timestamp")""")
def anti_join_insert(spark, sf):
    """Insert only (mmsi, time) keys not already stored (stored = before the split)."""
    stored = positions(spark, sf).filter(F.col("timestamp") < F.lit(SPLIT_TS).cast("timestamp_ntz"))
    return L.history_insert(A.ais_positions(spark, sf, redeliver=True), stored)


@register("semi_join_lookup", f"""
SELECT s.mmsi, s."timestamp" FROM ({POS}) s
WHERE s."timestamp" < TIMESTAMP '{SPLIT_TS}'
  AND s.mmsi IN (SELECT mmsi FROM ({POS}) b WHERE b."timestamp" >= TIMESTAMP '{SPLIT_TS}')""")
def semi_join_lookup(spark, sf):
    """Stored (mmsi, time) pairs of the vessels present in the new batch
    (stored = before the split time, batch = from it on)."""
    p = positions(spark, sf)
    split = F.lit(SPLIT_TS).cast("timestamp_ntz")
    stored = p.filter(F.col("timestamp") < split).select("mmsi", "timestamp")
    batch = p.filter(F.col("timestamp") >= split)
    return stored.join(batch.select("mmsi"), "mmsi", "left_semi")


_SNAP_COLS = 'mmsi, vessel_name, latitude, longitude, sog, "timestamp", "offset"'


def _sql_merge() -> str:
    snap = f"""(SELECT {_SNAP_COLS} FROM ({POS}) p WHERE "timestamp" < TIMESTAMP '{SPLIT_TS}'
      QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY "timestamp" DESC, "offset") = 1)"""
    new = f"""(SELECT {_SNAP_COLS} FROM ({POS}) p WHERE "timestamp" >= TIMESTAMP '{SPLIT_TS}'
      QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY "timestamp" DESC, "offset") = 1)"""
    cols = ["mmsi", "vessel_name", "latitude", "longitude", "sog", "timestamp", "offset"]
    take = 'o.mmsi IS NULL OR (n.mmsi IS NOT NULL AND n."timestamp" > o."timestamp")'
    sel = ", ".join(f'CASE WHEN {take} THEN n."{c}" ELSE o."{c}" END AS "{c}"' for c in cols)
    return f"SELECT {sel} FROM {snap} o FULL OUTER JOIN {new} n ON o.mmsi = n.mmsi"


def _merge(spark, sf):
    p = positions(spark, sf).select("mmsi", "vessel_name", "latitude", "longitude", "sog",
                                    "timestamp", "offset")
    split = F.lit(SPLIT_TS).cast("timestamp_ntz")
    snapshot = L.latest_per_vessel(p.filter(F.col("timestamp") < split))
    return L.merge_latest(snapshot, p.filter(F.col("timestamp") >= split))


@register("newest_wins_merge", _sql_merge())
def newest_wins_merge(spark, sf):
    """Full outer merge of the batch's newest rows into the stored snapshot."""
    return _merge(spark, sf)


@register("latest_state_sink", f"""
SELECT {_SNAP_COLS} FROM ({POS}) p
QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY "timestamp" DESC, "offset") = 1""")
def latest_state_sink(spark, sf):
    """Snapshot after merging two batches equals the newest row per vessel overall."""
    return _merge(spark, sf)


_EVENTS2_SQL = _sql_transitions(POS2)


@register("event_sink", f"""
SELECT {EV_COLS} FROM ({_EVENTS2_SQL}) e
QUALIFY row_number() OVER (PARTITION BY mmsi, event_type, "timestamp" ORDER BY "offset") = 1""")
def event_sink(spark, sf):
    """Events from a redelivered stream, stored once per (mmsi, type, time)."""
    return L.event_insert(L.geofence_transitions(A.ais_positions(spark, sf, redeliver=True)))


@register("stream_dedupe", f"""
SELECT {EV_COLS} FROM ({_EVENTS2_SQL}) e
QUALIFY row_number() OVER (PARTITION BY mmsi, event_type, "timestamp" ORDER BY "offset") = 1""")
def stream_dedupe(spark, sf):
    """The stateful operator over redelivered positions; its own state keeps every event to one row."""
    GS.use_rocksdb(spark)
    return _plain_times(GS.geofence_stream(A.ais_positions(spark, sf, redeliver=True)))


def _plain_times(events):
    return events.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@register("geofence_stream", f"""
SELECT {EV_COLS} FROM ({EVENTS_SQL}) e WHERE "offset" >= (SELECT (max("offset") + 1) // 2 FROM ({POS}) p)
QUALIFY row_number() OVER (PARTITION BY mmsi, event_type, "timestamp" ORDER BY "offset") = 1""")
def geofence_stream(spark, sf):
    """X2 on batch input: the first half of the arrivals comes in as saved state, the second as rows."""
    GS.use_rocksdb(spark)
    p = positions(spark, sf)
    cut = p.agg(F.floor((F.max("offset") + 1) / 2)).scalar()
    before, after = p.where(F.col("offset") < cut), p.where(F.col("offset") >= cut)
    return _plain_times(GS.geofence_stream(after, initial=GS.saved_state(L.final_geofence_state(before))))


# ---------------------------------------------------------------------------
# Live hourly counters
# ---------------------------------------------------------------------------

def _sql_live_counts(ev: str) -> str:
    grp = _sql_group("CAST(ship_type AS VARCHAR)")
    groups = ",\n".join(f"{Q.count_if(f'({grp}) = {Q.lit(g)}')} AS {g}_events" for g in C.SHIP_GROUPS)
    return f"""SELECT date_trunc('hour', "timestamp") AS timestamp_utc, COUNT(*) AS total_events,
  {Q.count_if("event_type = 'ENTRY'")} AS arrivals, {Q.count_if("event_type = 'EXIT'")} AS departures,
  COUNT(DISTINCT mmsi) AS unique_vessels, {groups}
FROM ({ev}) e GROUP BY 1"""


@register("live_hourly_traffic", f"SELECT * FROM ({_sql_live_counts(EVENTS_SQL)}) c")
def live_hourly_traffic(spark, sf):
    """A2: hour counters from ENTRY / EXIT events with AIS groups."""
    return H.live_hourly_counts(events_of(spark, sf))


@register("zero_hour_snapshot", f"""
SELECT COALESCE(o.timestamp_utc, c.timestamp_utc) AS timestamp_utc,
  {', '.join(f'CAST(COALESCE(c.{x}, 0) AS BIGINT) AS {x}' for x in C.COUNTER_COLUMNS)}
FROM (SELECT DISTINCT date_trunc('hour', "timestamp") AS timestamp_utc FROM ({POS}) p) o
FULL OUTER JOIN ({_sql_live_counts(EVENTS_SQL)}) c ON o.timestamp_utc = c.timestamp_utc""")
def zero_hour_snapshot(spark, sf):
    """Every observed hour has a row; no events -> zero counters."""
    p = positions(spark, sf)
    return H.zero_hour_snapshot(p, L.geofence_transitions(p))


# ---------------------------------------------------------------------------
# Read API: lists, lookups, searches, dashboard aggregates
# ---------------------------------------------------------------------------

_CUT = f"TIMESTAMP '{NOW}' - INTERVAL {ACTIVE_MINUTES} MINUTE"


@register("active_vessels", f"""
SELECT * FROM {_LATEST_SQL} l WHERE "timestamp" >= {_CUT}
ORDER BY "timestamp" DESC, mmsi""")
def active_vessels(spark, sf):
    """K1: all current rows seen in the last N minutes, newest first."""
    return V.active_vessels(L.latest_per_vessel(positions(spark, sf)), NOW, ACTIVE_MINUTES)


@register("vessel_by_id", f"SELECT * FROM {_LATEST_SQL} l WHERE mmsi = '257000007'")
def vessel_by_id(spark, sf):
    """K2: current row of one mmsi (empty = not found)."""
    return L.latest_per_vessel(positions(spark, sf)).filter(F.col("mmsi") == "257000007")


@register("vessel_history", f"""
SELECT * FROM {_HIST_SQL} h WHERE mmsi = '257000007'
  AND "timestamp" BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-25 00:00:00'
ORDER BY "timestamp", "offset" LIMIT 500""")
def vessel_history(spark, sf):
    """K3: one vessel's stored track in a closed range, oldest first, limit 500."""
    hist = L.history_rows(A.ais_positions(spark, sf, redeliver=True))
    return V.vessel_history(hist, "257000007", "2024-01-05 00:00:00", "2024-01-25 00:00:00", 500)


@register("event_query", f"""
SELECT * FROM ({EVENTS_SQL}) e WHERE event_type = 'ENTRY'
  AND "timestamp" BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'
ORDER BY "timestamp" DESC, mmsi, "offset" LIMIT 100""")
def event_query(spark, sf):
    """K4: events in a closed range of one type, newest first, limit 100."""
    return V.event_query(events_of(spark, sf), "2024-01-10 00:00:00", "2024-01-20 00:00:00",
                         "ENTRY", 100)


_SEARCH_Q = "vessel 12 257000040"


def _sql_tokens(x: str) -> str:
    pattern = "'[^\\p{L}\\p{N}]+'"
    return f"list_filter(regexp_split_to_array(lower(COALESCE({x}, '')), {pattern}), lambda t: t <> '')"


@register("search_vessels", f"""
SELECT * FROM (SELECT *, mmsi || '-' || strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%f') AS doc_id FROM ({POS2}) p
  QUALIFY row_number() OVER (PARTITION BY mmsi, "timestamp" ORDER BY "offset" DESC) = 1) d
WHERE len(list_intersect({_sql_tokens('mmsi')} || {_sql_tokens('imo')} || {_sql_tokens('vessel_name')},
                         {_sql_tokens(Q.lit(_SEARCH_Q))})) > 0
ORDER BY "timestamp" DESC, mmsi LIMIT 50""")
def search_vessels(spark, sf):
    """K5: any query token matching any token of mmsi / imo / name; newest first, top 50."""
    docs = L.search_documents(A.ais_positions(spark, sf, redeliver=True))
    return V.search_vessels(docs, _SEARCH_Q, 50)


@register("search_positions", f"""
SELECT * FROM (SELECT *, mmsi || '-' || strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%f') AS doc_id FROM ({POS2}) p
  QUALIFY row_number() OVER (PARTITION BY mmsi, "timestamp" ORDER BY "offset" DESC) = 1) d
WHERE mmsi = '257000011' ORDER BY "timestamp", "offset" LIMIT 500""")
def search_positions(spark, sf):
    """K6: exact-mmsi documents, oldest first, limit 500."""
    docs = L.search_documents(A.ais_positions(spark, sf, redeliver=True))
    return V.search_positions(docs, "257000011", 500)


@register("fleet_filter_sort", f"""
SELECT mmsi, COALESCE(NULLIF(vessel_name, ''), 'Unknown vessel') AS display_name, sog, "timestamp"
FROM {_LATEST_SQL} l
WHERE (contains(lower(COALESCE(NULLIF(vessel_name, ''), 'Unknown vessel')), '1')
       OR contains(lower(mmsi), '1'))
  AND (CASE WHEN sog IS NULL OR isnan(sog) THEN 'unknown' WHEN sog >= 15 THEN 'fast'
            WHEN sog >= 5 THEN 'moving' ELSE 'slow' END) = 'moving'""")
def fleet_filter_sort(spark, sf):
    """K7: substring filter on name / mmsi plus a speed-category filter (sorted by speed)."""
    latest = L.latest_per_vessel(positions(spark, sf))
    return V.fleet_filter_sort(latest, " 1 ", "moving", "speed")


_GROUPS_ALL = C.SHIP_GROUPS + ["other"]


@register("vessel_composition", f"""
SELECT g.ship_group, COALESCE(c.vessels, 0) AS vessels
FROM (SELECT * FROM (VALUES {', '.join(f'({Q.lit(g)})' for g in _GROUPS_ALL)}) t(ship_group)) g
LEFT JOIN (SELECT COALESCE({_sql_group('CAST(ship_type AS VARCHAR)')}, 'other') AS ship_group,
                  COUNT(*) AS vessels FROM {_LATEST_SQL} l GROUP BY 1) c ON g.ship_group = c.ship_group""")
def vessel_composition(spark, sf):
    """Current vessels per group including ``other``."""
    return V.vessel_composition(spark, L.latest_per_vessel(positions(spark, sf)))


@register("average_speed", f"""
SELECT round(avg(sog), 1) AS average_speed, COUNT(sog) AS vessels_with_speed FROM {_LATEST_SQL} l""")
def average_speed(spark, sf):
    """Mean sog over current vessels, 1 decimal (null sog skipped)."""
    return V.average_speed(L.latest_per_vessel(positions(spark, sf)))


@register("track_duration", f"""
SELECT mmsi, COUNT(*) AS points,
  CASE WHEN COUNT(*) >= 2 THEN CAST(floor((epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 60000000.0::DOUBLE + 0.5) AS BIGINT) END
    AS duration_minutes
FROM {_HIST_SQL} h GROUP BY mmsi""")
def track_duration(spark, sf):
    """Minutes between first and last point per vessel, rounded (< 2 points -> null)."""
    return V.track_duration(L.history_rows(A.ais_positions(spark, sf, redeliver=True)))


@register("speed_counts", f"""
SELECT COUNT(*) AS total, {Q.count_if('sog >= 5 AND sog < 15')} AS moving, {Q.count_if('sog >= 15')} AS fast
FROM {_LATEST_SQL} l""")
def speed_counts(spark, sf):
    """Current vessels in total, moving (5 to under 15 kn) and fast (>= 15 kn)."""
    return V.speed_counts(L.latest_per_vessel(positions(spark, sf)))


@register("active_counts", f"""
SELECT {Q.count_if(f'"timestamp" >= {_CUT}')} AS active_total, COUNT(*) AS stored_total
FROM {_LATEST_SQL} l""")
def active_counts(spark, sf):
    """Active and stored totals beside the limited list."""
    return V.active_counts(L.latest_per_vessel(positions(spark, sf)), NOW, ACTIVE_MINUTES)


@register("geofence_status", f"""
SELECT (SELECT COUNT(*) FROM (SELECT mmsi FROM ({POS}) p GROUP BY mmsi) t) AS tracked_vessels,
  (SELECT COUNT(*) FROM (SELECT * FROM ({POS}) p QUALIFY row_number() OVER
      (PARTITION BY mmsi ORDER BY "timestamp" DESC, "offset" DESC) = 1) s WHERE {BOX}) AS inside_now,
  (SELECT {Q.count_if("event_type = 'ENTRY'")} FROM ({EVENTS_SQL}) e) AS entries,
  (SELECT {Q.count_if("event_type = 'EXIT'")} FROM ({EVENTS_SQL}) e) AS exits""")
def geofence_status(spark, sf):
    """Tracked vessels, vessels inside now, entries and exits."""
    p = positions(spark, sf)
    return V.geofence_status(L.final_geofence_state(p), L.geofence_transitions(p))


@register("hourly_stream", f"SELECT * FROM ({_sql_live_counts(EVENTS_SQL)}) c")
def hourly_stream(spark, sf):
    """X3 in batch form: the increments that the stream's sink writes, for two batches of events,
    merged as on read; equals A2."""
    from ..streaming.pipeline import hour_increments, merge_hours
    ev = events_of(spark, sf)
    first = F.pmod(F.xxhash64("mmsi", "timestamp"), F.lit(2)) == 0
    (c1, p1), (c2, p2) = hour_increments(ev.where(first)), hour_increments(ev.where(~first))
    return merge_hours(c1.unionAll(c2), p1.unionAll(p2))
