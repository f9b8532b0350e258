"""Registered queries: raw voyages -> cleaned voyages -> study areas -> events, and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..functions import clean as CL
from ..operators import hourly as H
from ..operators import profile as PR
from ..operators import voyage as VY
from ..operators.sinks import with_position
from ..sources import adapters as A
from . import sqlparts as Q
from .registry import register

RAW = A.VOYAGES_RAW_SQL
TOKENS = Q.in_list(C.NULL_TOKENS)


# ---------------------------------------------------------------------------
# SQL mirrors of the cleaning expressions
# ---------------------------------------------------------------------------

def s_ident(x: str) -> str:
    t = f"regexp_replace(trim({x}), '[,.]0$', '')"
    return f"CASE WHEN {t} IN {TOKENS} THEN NULL ELSE {t} END"


def s_text(x: str) -> str:
    return f"CASE WHEN trim({x}) IN {TOKENS} THEN NULL ELSE trim({x}) END"


def s_num(x: str) -> str:
    return f"TRY_CAST(replace(trim({x}), ',', '.') AS DOUBLE)"


def s_digits(e: str, n: int) -> str:
    return f"CASE WHEN regexp_full_match({e}, '[0-9]{{{n}}}') THEN {e} END"


def s_time(x: str) -> str:
    return f"TRY_CAST(trim({x}) AS TIMESTAMP)"


def clean_sql(src: str = RAW) -> str:
    cols = []
    for c in C.RAW_VOYAGE_COLUMNS:
        if c in VY.IDENTIFIER_COLUMNS:
            e = s_ident(c)
            if c == "mmsi_nummer":
                e = s_digits(e, 9)
            elif c == "imo_nummer":
                e = s_digits(e, 7)
        elif c in VY.NUMERIC_COLUMNS:
            e = s_num(c)
            if c == "lengde":
                e = f"CASE WHEN {e} > 0 AND {e} <= 500 THEN {e} END"
            elif c == "bredde":
                e = f"CASE WHEN {e} > 0 AND {e} <= 100 THEN {e} END"
            elif c == "dypgaaende":
                e = f"CASE WHEN {e} >= 0 AND {e} <= 30 THEN {e} END"
            elif c == "byggeaar":
                e = f"CASE WHEN {e} >= {C.MIN_BUILD_YEAR} AND {e} <= source_year THEN {e} END"
        elif c in VY.TEXT_COLUMNS:
            e = s_text(c)
        else:
            e = c
        cols.append(f"{e} AS {c}")
    dep, arr = s_time("etd_estimert_avgangstidspunkt"), s_time("ankomsttidspunkt")
    dur = f"(epoch_us({arr}) - epoch_us({dep})) / 3600000000.0::DOUBLE"
    return f"""SELECT {', '.join(cols)}, {dep} AS departure_time, {arr} AS arrival_time, source_year,
       CASE WHEN {dur} >= 0 THEN {dur} END AS voyage_duration_hours,
       order_1, order_2, order_3, order_4
FROM ({src}) r"""


CLEAN = clean_sql()


def s_flag(m: str, cc: str) -> str:
    return f"COALESCE({m} = study_area AND {cc} = '{C.HOME_COUNTRY_CODE}', false)"


EXPANDED = f"""
SELECT * FROM (
  SELECT *, {s_flag('kommunenavn_avgang', 'landkode_avgang_totegn')} AS departure_in_study_area,
         {s_flag('kommunenavn_ankomst', 'landkode_ankomst_totegn')} AS arrival_in_study_area
  FROM (SELECT c.*, a.study_area FROM ({CLEAN}) c
        JOIN {Q.areas_values()} a ON a.study_area = c.kommunenavn_avgang OR a.study_area = c.kommunenavn_ankomst) x
) y WHERE departure_in_study_area OR arrival_in_study_area"""

VOYAGES = f"""
SELECT * FROM ({EXPANDED}) e
QUALIFY row_number() OVER (PARTITION BY source_year, study_area, seilas_id
                           ORDER BY order_1, order_2, order_3, order_4) = 1"""

EVENT_SQL_START, EVENT_SQL_END = "1995-01-01 00:00:00", "2002-01-01 00:00:00"


def events_sql(start=EVENT_SQL_START, end=EVENT_SQL_END) -> str:
    vk = "COALESCE(mmsi_nummer, 'SHIP_' || COALESCE(skips_id, 'UNKNOWN'))"
    base = "study_area, seilas_id, " + vk + " AS vessel_key, mmsi_nummer, skipstype, skipsgruppe"
    return f"""
SELECT study_area, seilas_id, vessel_key, mmsi_nummer, skipstype, skipsgruppe, event_time, event_type,
       date_trunc('hour', event_time) AS hour_utc
FROM (
  SELECT {base}, departure_time AS event_time, 'departure' AS event_type, source_year,
         order_1, order_2, order_3, order_4
  FROM ({VOYAGES}) v WHERE departure_in_study_area AND departure_time IS NOT NULL
  UNION ALL
  SELECT {base}, arrival_time AS event_time, 'arrival' AS event_type, source_year,
         order_1, order_2, order_3, order_4
  FROM ({VOYAGES}) v WHERE arrival_in_study_area AND arrival_time IS NOT NULL) u
WHERE event_time >= TIMESTAMP '{start}' AND event_time < TIMESTAMP '{end}'
QUALIFY row_number() OVER (PARTITION BY study_area, seilas_id, event_type, event_time
                           ORDER BY source_year, order_1, order_2, order_3, order_4) = 1"""


def raw(spark, sf):
    return A.voyages_raw(spark, sf)


def clean(spark, sf):
    return VY.clean_voyages(raw(spark, sf))


def voyages(spark, sf, columns=None):
    return VY.prepare_voyages(raw(spark, sf), columns=columns)


def events(spark, sf):
    return VY.prepare_events(raw(spark, sf), EVENT_SQL_START, EVENT_SQL_END)


# ---------------------------------------------------------------------------
# Scans
# ---------------------------------------------------------------------------

@register("row_count", f"SELECT source_year, COUNT(*) AS rows FROM ({RAW}) r GROUP BY source_year")
def row_count(spark, sf):
    """S3: data rows per yearly file (header excluded)."""
    return raw(spark, sf).groupBy("source_year").agg(F.count(F.lit(1)).alias("rows"))


@register("sample_scan", f"SELECT * FROM ({RAW}) r ORDER BY source_year, order_1, order_2, order_3, order_4, seilas_id LIMIT 10000")
def sample_scan(spark, sf):
    """First 10,000 rows in file order for inspection (the limit is the feature)."""
    return raw(spark, sf).orderBy("source_year", *VY.ORDER_COLUMNS, "seilas_id").limit(10000)


@register("scan_typed", f"""
SELECT study_area, seilas_id, skips_id, mmsi_nummer, skipstype, skipsgruppe, departure_time, arrival_time,
       departure_in_study_area, arrival_in_study_area FROM ({VOYAGES}) v""")
def scan_typed(spark, sf):
    """The typed voyage table, column subset (Parquet between stages, no CSV round trip)."""
    cols = ["skips_id", "mmsi_nummer", "skipstype", "skipsgruppe", "departure_time", "arrival_time",
            "departure_in_study_area", "arrival_in_study_area"]
    return voyages(spark, sf, cols).select("study_area", "seilas_id", *cols)


# ---------------------------------------------------------------------------
# Cleaning scalars
# ---------------------------------------------------------------------------

@register("clean_identifier", f"""
SELECT seilas_id AS raw_id, mmsi_nummer AS raw_mmsi, {s_ident('seilas_id')} AS seilas_id_clean,
       {s_ident('mmsi_nummer')} AS mmsi_clean, {s_ident('imo_nummer')} AS imo_clean FROM ({RAW}) r""")
def clean_identifier(spark, sf):
    """Trim, strip ``,0`` / ``.0``, null tokens -> null."""
    r = raw(spark, sf)
    return r.select(F.col("seilas_id").alias("raw_id"), F.col("mmsi_nummer").alias("raw_mmsi"),
                    CL.clean_identifier("seilas_id").alias("seilas_id_clean"),
                    CL.clean_identifier("mmsi_nummer").alias("mmsi_clean"),
                    CL.clean_identifier("imo_nummer").alias("imo_clean"))


@register("clean_numeric", f"""
SELECT seilas_id, lengde AS raw_lengde, {s_num('lengde')} AS lengde, {s_num('bredde')} AS bredde,
       {s_num('byggeaar')} AS byggeaar FROM ({RAW}) r""")
def clean_numeric(spark, sf):
    """Decimal comma -> point; unparsable -> null."""
    r = raw(spark, sf)
    return r.select("seilas_id", F.col("lengde").alias("raw_lengde"),
                    CL.clean_numeric("lengde").alias("lengde"), CL.clean_numeric("bredde").alias("bredde"),
                    CL.clean_numeric("byggeaar").alias("byggeaar"))


@register("clean_text", f"""
SELECT seilas_id, {s_text('skipsgruppe')} AS skipsgruppe, {s_text('landkode_avgang_totegn')} AS dep_code,
       {s_text('farlig_last_hazmat')} AS hazmat FROM ({RAW}) r""")
def clean_text(spark, sf):
    """P5: trim; null tokens -> null."""
    r = raw(spark, sf)
    return r.select("seilas_id", CL.clean_text("skipsgruppe").alias("skipsgruppe"),
                    CL.clean_text("landkode_avgang_totegn").alias("dep_code"),
                    CL.clean_text("farlig_last_hazmat").alias("hazmat"))


@register("valid_ids", f"""
SELECT seilas_id, mmsi_nummer, imo_nummer, order_1, order_2, order_3, order_4 FROM ({CLEAN}) c""")
def valid_ids(spark, sf):
    """MMSI must be exactly 9 digits and IMO exactly 7, else null."""
    return clean(spark, sf).select("seilas_id", "mmsi_nummer", "imo_nummer", *VY.ORDER_COLUMNS)


@register("range_nulls", f"""
SELECT seilas_id, source_year, lengde, bredde, dypgaaende, byggeaar, order_1, order_2, order_3, order_4
FROM ({CLEAN}) c""")
def range_nulls(spark, sf):
    """Out-of-range length / beam / draught / build year -> null (row kept)."""
    return clean(spark, sf).select("seilas_id", "source_year", "lengde", "bredde", "dypgaaende",
                                   "byggeaar", *VY.ORDER_COLUMNS)


@register("voyage_duration", f"""
SELECT seilas_id, departure_time, arrival_time, round(voyage_duration_hours, 9) AS voyage_duration_hours,
       order_1, order_2, order_3, order_4 FROM ({CLEAN}) c""")
def voyage_duration(spark, sf):
    """(arrival - departure) in hours; negative -> null."""
    return clean(spark, sf).select("seilas_id", "departure_time", "arrival_time",
                                   F.round("voyage_duration_hours", 9).alias("voyage_duration_hours"),
                                   *VY.ORDER_COLUMNS)


@register("parse_times", f"""
SELECT seilas_id, etd_estimert_avgangstidspunkt AS departure_text, departure_time, arrival_time,
       order_1, order_2, order_3, order_4 FROM ({CLEAN}) c""")
def parse_times(spark, sf):
    """Text -> UTC timestamp, bad -> null."""
    return clean(spark, sf).select("seilas_id", F.col("etd_estimert_avgangstidspunkt").alias("departure_text"),
                                   "departure_time", "arrival_time", *VY.ORDER_COLUMNS)


@register("source_year", f"""
SELECT source_year, source_year >= 1998 AS primary_ml_period, COUNT(*) AS rows
FROM ({CLEAN}) c GROUP BY ALL""")
def source_year(spark, sf):
    """P10: file year and the primary-period flag (first year as a parameter)."""
    c = VY.primary_period(clean(spark, sf), first_year=1998)
    return c.groupBy("source_year", "primary_ml_period").agg(F.count(F.lit(1)).alias("rows"))


@register("area_flags", f"""
SELECT seilas_id, study_area, departure_in_study_area, arrival_in_study_area, order_1, order_2, order_3, order_4
FROM ({EXPANDED}) e""")
def area_flags(spark, sf):
    """Departure / arrival flag = municipality equals the area and country is NO."""
    e = VY.expand_study_areas(clean(spark, sf))
    return e.select("seilas_id", "study_area", "departure_in_study_area", "arrival_in_study_area",
                    *VY.ORDER_COLUMNS)


@register("expand_study_areas", f"SELECT study_area, COUNT(*) AS rows, {Q.count_if('departure_in_study_area')} AS departures, {Q.count_if('arrival_in_study_area')} AS arrivals FROM ({EXPANDED}) e GROUP BY study_area")
def expand_study_areas(spark, sf):
    """One row per (voyage, relevant area); a voyage between two areas yields two."""
    e = VY.expand_study_areas(clean(spark, sf))
    return e.groupBy("study_area").agg(F.count(F.lit(1)).alias("rows"),
                                       F.count(F.when(F.col("departure_in_study_area"), 1)).alias("departures"),
                                       F.count(F.when(F.col("arrival_in_study_area"), 1)).alias("arrivals"))


@register("parse_bool", f"""
SELECT seilas_id, farlig_last_hazmat AS raw,
       COALESCE(lower(trim(farlig_last_hazmat)) IN {Q.in_list(C.TRUE_TOKENS)}, false) AS hazmat
FROM ({RAW}) r""")
def parse_bool(spark, sf):
    """lower(trim) in {true, 1, t, yes, y}, else false."""
    r = raw(spark, sf)
    return r.select("seilas_id", F.col("farlig_last_hazmat").alias("raw"),
                    CL.parse_bool("farlig_last_hazmat").alias("hazmat"))


@register("vessel_key", f"""
SELECT seilas_id, COALESCE(mmsi_nummer, 'SHIP_' || COALESCE(skips_id, 'UNKNOWN')) AS vessel_key,
       order_1, order_2, order_3, order_4 FROM ({CLEAN}) c""")
def vessel_key(spark, sf):
    """MMSI, else SHIP_<ship id>, else SHIP_UNKNOWN."""
    return clean(spark, sf).select("seilas_id", CL.vessel_key("mmsi_nummer", "skips_id").alias("vessel_key"),
                                   *VY.ORDER_COLUMNS)


# ---------------------------------------------------------------------------
# De-duplication, unions, events
# ---------------------------------------------------------------------------

@register("dedupe_voyages", f"SELECT * FROM ({VOYAGES}) v")
def dedupe_voyages(spark, sf):
    """First row (file order) per (year, area, voyage)."""
    return voyages(spark, sf)


@register("internal_voyages", f"SELECT * FROM ({VOYAGES}) v WHERE departure_in_study_area AND arrival_in_study_area")
def internal_voyages(spark, sf):
    """Voyages with both ends in the area."""
    return VY.internal_voyages(voyages(spark, sf))


@register("union_years", f"SELECT source_year, COUNT(*) AS rows FROM ({CLEAN}) c GROUP BY source_year")
def union_years(spark, sf):
    """Yearly tables concatenated by name (each year read as its own frame)."""
    c = clean(spark, sf)
    years = list(range(1995, 2002))
    frames = [c.filter(F.col("source_year") == y) for y in years]
    rest = c.filter(~F.col("source_year").isin(*years) | F.col("source_year").isNull())
    u = VY.union_years(frames + [rest])
    return u.groupBy("source_year").agg(F.count(F.lit(1)).alias("rows"))


@register("voyage_events", f"SELECT * FROM ({events_sql()}) e")
def voyage_events(spark, sf):
    """Departures and arrivals per area in range, de-duplicated."""
    return events(spark, sf)


_COUNTERS = ", ".join(f"CAST(COALESCE(s.{c}, 0) AS BIGINT) AS {c}" for c in C.COUNTER_COLUMNS)


@register("voyage_hourly", f"""
WITH e AS ({events_sql()}), h AS (
  SELECT unnest(generate_series(min(hour_utc), max(hour_utc), INTERVAL 1 HOUR)) AS timestamp_utc FROM e)
SELECT a.study_area, h.timestamp_utc, {_COUNTERS}
FROM h CROSS JOIN {Q.areas_values()} a
LEFT JOIN ({Q.hourly_counts_sql('SELECT * FROM e', EVENT_SQL_START, EVENT_SQL_END)}) s
  ON s.study_area = a.study_area AND s.timestamp_utc = h.timestamp_utc""")
def voyage_hourly(spark, sf):
    """A1 on voyage events: dense hourly panel from the first to the last hour of the data."""
    return H.hourly_traffic_span(events(spark, sf))


# ---------------------------------------------------------------------------
# Profiles
# ---------------------------------------------------------------------------

def s_pid(x: str) -> str:
    t = f"regexp_replace(trim({x}), '\\.0$', '')"
    return f"CASE WHEN {t} IN {TOKENS} THEN NULL ELSE {t} END"


@register("voyage_profile", f"""
SELECT source_year, COUNT(*) AS rows, COUNT(DISTINCT {s_pid('skips_id')}) AS unique_ships,
       COUNT(DISTINCT {s_pid('mmsi_nummer')}) AS unique_mmsi, COUNT(DISTINCT {s_pid('imo_nummer')}) AS unique_imo
FROM ({RAW}) r GROUP BY source_year""")
def voyage_profile(spark, sf):
    """A3: per year rows and distinct ship id / MMSI / IMO."""
    return PR.voyage_profile(raw(spark, sf))


@register("flow_class_counts", f"""
SELECT source_year,
  {Q.count_if("trim(landkode_avgang_totegn) = 'NO' AND trim(landkode_ankomst_totegn) = 'NO'")} AS domestic,
  {Q.count_if("NOT (trim(landkode_avgang_totegn) = 'NO') AND trim(landkode_ankomst_totegn) = 'NO'")} AS international_to_norway,
  {Q.count_if("trim(landkode_avgang_totegn) = 'NO' AND NOT (trim(landkode_ankomst_totegn) = 'NO')")} AS norway_to_international,
  {Q.count_if("NOT (trim(landkode_avgang_totegn) = 'NO') AND NOT (trim(landkode_ankomst_totegn) = 'NO')")} AS international_other
FROM ({RAW}) r GROUP BY source_year""")
def flow_class_counts(spark, sf):
    """A4: domestic / inbound / outbound / other by country code."""
    return PR.flow_class_counts(raw(spark, sf))


def _top_sql(n: int = 20) -> str:
    unions = " UNION ALL ".join(
        f"SELECT source_year, '{c}' AS \"column\", {c} AS value FROM ({RAW}) r WHERE {c} IS NOT NULL"
        for c in PR.PROFILE_VALUE_COLUMNS)
    return f"""
SELECT * FROM (
  SELECT source_year, "column", value, COUNT(*) AS count FROM ({unions}) u GROUP BY ALL) c
QUALIFY row_number() OVER (PARTITION BY source_year, "column" ORDER BY count DESC, value) <= {n}"""


@register("top_values", f"""
SELECT source_year, "column", value, count,
       CAST(row_number() OVER (PARTITION BY source_year, "column" ORDER BY count DESC, value) AS INTEGER) AS rank
FROM ({_top_sql()}) t""")
def top_values(spark, sf):
    """A5: top 20 values per year of ports, types, groups, countries."""
    return PR.top_values(raw(spark, sf))


@register("monthly_counts", f"""
SELECT month, {Q.count_if("side = 'departures'")} AS departures, {Q.count_if("side = 'arrivals'")} AS arrivals
FROM (SELECT strftime(departure_time, '%Y-%m') AS month, 'departures' AS side FROM ({CLEAN}) c WHERE departure_time IS NOT NULL
      UNION ALL
      SELECT strftime(arrival_time, '%Y-%m') AS month, 'arrivals' AS side FROM ({CLEAN}) c WHERE arrival_time IS NOT NULL) m
GROUP BY month""")
def monthly_counts(spark, sf):
    """Departures and arrivals per month."""
    return PR.monthly_counts(clean(spark, sf))


def _sides_sql() -> str:
    mm = "regexp_replace(mmsi_nummer, '\\.0$', '')"
    return f"""
SELECT source_year, 'departure' AS side, trim(kommunenavn_avgang) AS place, {mm} AS mmsi,
       etd_estimert_avgangstidspunkt AS time_text
FROM ({RAW}) r WHERE trim(landkode_avgang_totegn) = 'NO' AND kommunenavn_avgang IS NOT NULL
UNION ALL
SELECT source_year, 'arrival' AS side, trim(kommunenavn_ankomst) AS place, {mm} AS mmsi,
       ankomsttidspunkt AS time_text
FROM ({RAW}) r WHERE trim(landkode_ankomst_totegn) = 'NO' AND kommunenavn_ankomst IS NOT NULL"""


def _activity_sql(by_year: bool = True) -> str:
    k = "source_year, " if by_year else ""
    return f"""SELECT {k}place AS municipality, {Q.count_if("side = 'departure'")} AS departures,
  {Q.count_if("side = 'arrival'")} AS arrivals, COUNT(*) AS activity, COUNT(DISTINCT mmsi) AS unique_mmsi
FROM ({_sides_sql()}) s GROUP BY ALL"""


@register("municipality_activity", f"SELECT * FROM ({_activity_sql()}) a")
def municipality_activity(spark, sf):
    """Norwegian departures + arrivals per municipality, distinct MMSI over both sides."""
    return PR.municipality_activity(raw(spark, sf))


@register("municipality_ranking", f"""
SELECT 'year' AS scope, source_year, CAST(row_number() OVER (PARTITION BY source_year ORDER BY activity DESC, municipality) AS INTEGER) AS rank,
       municipality, activity, unique_mmsi FROM ({_activity_sql()}) a
QUALIFY rank <= 30
UNION ALL
SELECT 'overall', CAST(NULL AS INTEGER), CAST(row_number() OVER (ORDER BY activity DESC, municipality) AS INTEGER),
       municipality, activity, unique_mmsi FROM ({_activity_sql(False)}) b
QUALIFY row_number() OVER (ORDER BY activity DESC, municipality) <= 40""")
def municipality_ranking(spark, sf):
    """Top 30 per year and top 40 overall by activity."""
    return PR.municipality_ranking(raw(spark, sf))


_MISSING_COLS = ["seilas_id", "skips_id", "imo_nummer", "mmsi_nummer", "skipstype", "skipsgruppe",
                 "avgangshavn_kode", "ankomsthavn_kode", "land_avgang", "land_ankomst",
                 "landkode_avgang_totegn", "etd_estimert_avgangstidspunkt"]


@register("missing_profile", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {Q.count_if(f'{c} IS NULL')} AS missing,
       round({Q.count_if(f'{c} IS NULL')} * 100.0::DOUBLE / COUNT(*), 2) AS missing_pct,
       COUNT(DISTINCT {c}) AS distinct_values FROM ({CLEAN}) c""" for c in _MISSING_COLS))
def missing_profile(spark, sf):
    """Null count, null % and distinct count per key column (one pass)."""
    return PR.missing_profile(clean(spark, sf), _MISSING_COLS)


@register("area_year_pivot", f"""
WITH c AS (SELECT study_area, source_year, COUNT(*) AS rows FROM ({VOYAGES}) v GROUP BY ALL)
SELECT a.study_area, y.source_year, COALESCE(c.rows, 0) AS rows
FROM (SELECT DISTINCT study_area FROM c) a CROSS JOIN (SELECT DISTINCT source_year FROM c) y
LEFT JOIN c ON c.study_area = a.study_area AND c.source_year = y.source_year""")
def area_year_pivot(spark, sf):
    """Voyage-area rows by area x year as long rows, zero filled."""
    return PR.area_year_counts(voyages(spark, sf, []))


@register("voyage_summary", f"""
SELECT study_area, COUNT(*) AS rows, COUNT(DISTINCT seilas_id) AS unique_voyages,
  COUNT(DISTINCT skips_id) AS unique_ships, COUNT(DISTINCT mmsi_nummer) AS unique_mmsi,
  COUNT(DISTINCT imo_nummer) AS unique_imo, {Q.count_if('arrival_in_study_area')} AS arrivals,
  {Q.count_if('departure_in_study_area')} AS departures,
  {Q.count_if('arrival_in_study_area AND departure_in_study_area')} AS internal,
  {', '.join(f"{Q.count_if(f'skipsgruppe = {Q.lit(g)}')} AS group_{g.lower()}" for g in C.SKIPSGRUPPE_COUNTERS)},
  {Q.count_if('skipsgruppe IS NULL')} AS group_null,
  min(departure_time) AS first_departure, max(arrival_time) AS last_arrival,
  round(quantile_cont(voyage_duration_hours, 0.5), 6) AS duration_median,
  round(avg(voyage_duration_hours), 6) AS duration_mean,
  round(quantile_cont(voyage_duration_hours, 0.95), 6) AS duration_p95
FROM ({VOYAGES}) v GROUP BY study_area""")
def voyage_summary(spark, sf):
    """Per-area summary of the voyage table."""
    cols = ["skips_id", "mmsi_nummer", "imo_nummer", "skipsgruppe", "departure_time", "arrival_time",
            "departure_in_study_area", "arrival_in_study_area", "voyage_duration_hours"]
    return PR.voyage_summary(voyages(spark, sf, cols))


@register("final_sort", f"""
SELECT study_area, source_year, seilas_id, arrival_time, departure_time,
  row_number() OVER (ORDER BY study_area NULLS LAST, source_year NULLS LAST, arrival_time NULLS LAST, departure_time NULLS LAST,
                     seilas_id NULLS LAST) AS position
FROM ({VOYAGES}) v""")
def final_sort(spark, sf):
    """Voyages by area, year, arrival, departure (nulls last) with their place in that order; S13's
    ``write_sorted`` writes files in the same order."""
    v = voyages(spark, sf, ["arrival_time", "departure_time"]).select(
        "study_area", "source_year", "seilas_id", "arrival_time", "departure_time")
    # A group is one arrival day of an area.
    return with_position(v, [F.col("study_area"), F.col("source_year"), F.to_date("arrival_time")],
                         [F.asc_nulls_last(c) for c in ("arrival_time", "departure_time", "seilas_id")])


def _county_sides_sql() -> str:
    return _sides_sql().replace("trim(kommunenavn_avgang) AS place", "trim(fylkesnavn_avgang) AS place") \
        .replace("AND kommunenavn_avgang IS NOT NULL", "AND fylkesnavn_avgang IS NOT NULL") \
        .replace("trim(kommunenavn_ankomst) AS place", "trim(fylkesnavn_ankomst) AS place") \
        .replace("AND kommunenavn_ankomst IS NOT NULL", "AND fylkesnavn_ankomst IS NOT NULL")


@register("county_activity", f"""
SELECT source_year, place AS county, {Q.count_if("side = 'departure'")} AS departures,
  {Q.count_if("side = 'arrival'")} AS arrivals, COUNT(*) AS activity, COUNT(DISTINCT mmsi) AS unique_mmsi
FROM ({_county_sides_sql()}) s GROUP BY ALL""")
def county_activity(spark, sf):
    """A7 at county level: Norwegian departures / arrivals per county."""
    return PR.municipality_activity(raw(spark, sf), level="county")


@register("municipality_monthly", f"""
SELECT place AS municipality, strftime(t, '%Y-%m') AS month, COUNT(*) AS activity
FROM (SELECT place, TRY_CAST(trim(time_text) AS TIMESTAMP) AS t FROM ({_sides_sql()}) s) x
WHERE t IS NOT NULL GROUP BY ALL""")
def municipality_monthly(spark, sf):
    """A6 per municipality: Norwegian departures + arrivals by month."""
    return PR.municipality_monthly(raw(spark, sf))


@register("scan_voyages", f"SELECT source_year, {', '.join(C.RAW_VOYAGE_COLUMNS)} FROM ({RAW}) r")
def scan_voyages(spark, sf):
    """Yearly delimited files (latin-1, ';', header, all text) read back with the
    voyage reader.  The files are written by Spark from the raw view into a fresh
    folder under the shared checkpoint directory, one folder per year."""
    import uuid

    from ..operators.sinks import write_table, written_values
    from ..session import scratch_table_path
    base = scratch_table_path(spark, f"voyage_csv_{uuid.uuid4().hex}")
    # Written where the rows are made: a task holds a file for each of its few years, no row is moved for it.
    write_table(raw(spark, sf).select("source_year", *C.RAW_VOYAGE_COLUMNS), base, ["source_year"], fmt="csv", spread=False,
                options={"sep": ";", "encoding": "ISO-8859-1", "compression": "gzip",
                         "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    years = {y: None if y == "__HIVE_DEFAULT_PARTITION__" else int(y) for y in written_values(spark, base, "source_year")}  # a handful
    scanned = VY.scan_voyage_files(spark, {year: f"{base}/source_year={y}" for y, year in years.items()})
    return scanned.select("source_year", *C.RAW_VOYAGE_COLUMNS)
