"""DuckDB SQL fragments shared by the oracle queries (mirrors of the Spark plans)."""

from __future__ import annotations

from .. import config as C
from ..sources import adapters as A


def lit(v) -> str:
    return A._sql_lit(v)


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def areas_values(areas=None) -> str:
    areas = list(areas or C.STUDY_AREAS)
    return "(SELECT * FROM (VALUES " + ", ".join(f"({lit(a)})" for a in areas) + ") t(study_area))"


def centroids_values() -> str:
    rows = ", ".join(f"({lit(a)}, {lat}::DOUBLE, {lon}::DOUBLE)"
                     for a, (lat, lon) in C.AREA_CENTROIDS.items())
    return f"(SELECT * FROM (VALUES {rows}) t(study_area, centroid_lat, centroid_lon))"


def count_if(cond: str) -> str:
    return f"COUNT(CASE WHEN {cond} THEN 1 END)"


def group_counts(col: str = "skipsgruppe") -> str:
    return ",\n".join(f"{count_if(f'trim({col}) = {lit(t)}')} AS {name}"
                      for t, name in C.SKIPSGRUPPE_COUNTERS.items())


def hourly_counts_sql(events_sql: str, start: str, end: str) -> str:
    return f"""
SELECT study_area, date_trunc('hour', event_time) AS timestamp_utc,
       COUNT(*) AS total_events,
       {count_if("event_type = 'arrival'")} AS arrivals,
       {count_if("event_type = 'departure'")} AS departures,
       COUNT(DISTINCT vessel_key) AS unique_vessels,
       {group_counts()}
FROM ({events_sql}) e
WHERE event_time >= TIMESTAMP '{start}' AND event_time < TIMESTAMP '{end}'
GROUP BY 1, 2"""


def calendar_sql(start: str, end: str, areas=None) -> str:
    return f"""
SELECT a.study_area, h.timestamp_utc
FROM {areas_values(areas)} a,
     (SELECT unnest(generate_series(TIMESTAMP '{start}', TIMESTAMP '{end}' - INTERVAL 1 HOUR,
                                    INTERVAL 1 HOUR)) AS timestamp_utc) h"""


def panel_sql(events_sql: str, start: str, end: str, areas=None) -> str:
    counters = ",\n".join(f"CAST(COALESCE(s.{c}, 0) AS BIGINT) AS {c}" for c in C.COUNTER_COLUMNS)
    return f"""
SELECT c.study_area, c.timestamp_utc,
       {counters}
FROM ({calendar_sql(start, end, areas)}) c
LEFT JOIN ({hourly_counts_sql(events_sql, start, end)}) s
  ON c.study_area = s.study_area AND c.timestamp_utc = s.timestamp_utc"""


def lag_sql() -> str:
    return ",\n".join(f"LAG({c}, {k}) OVER w AS {c}_lag_{k}h" for c, ks in C.LAGS.items() for k in ks)


def rolling_sql() -> str:
    return ",\n".join(
        f"AVG({c}) OVER (w ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AS {c}_rolling_mean_{k}h"
        for c, ks in C.ROLLING.items() for k in ks)


def future_sql() -> str:
    return ",\n".join(f"LEAD({c}, 1) OVER w AS future_{c}_1h" for c in C.FUTURE_TARGETS)


WINDOW = "WINDOW w AS (PARTITION BY study_area ORDER BY timestamp_utc)"


def local_ts(col: str) -> str:
    return f"(({col}) AT TIME ZONE 'UTC' AT TIME ZONE '{C.LOCAL_TIMEZONE}')"


def calendar_cols_sql(col: str = "timestamp_utc") -> str:
    lt = local_ts(col)
    return f"""CAST(hour({lt}) AS INTEGER) AS hour_local,
       CAST(isodow({lt}) - 1 AS INTEGER) AS day_of_week,
       CAST(month({lt}) AS INTEGER) AS month,
       CAST(dayofyear({lt}) AS INTEGER) AS day_of_year,
       CAST(CASE WHEN isodow({lt}) - 1 IN (5, 6) THEN 1 ELSE 0 END AS INTEGER) AS is_weekend"""


def cyclical_cols_sql(digits: int) -> str:
    two_pi = "(2 * pi())"
    parts = [("hour_sin", f"sin({two_pi} * hour_local / 24)"),
             ("hour_cos", f"cos({two_pi} * hour_local / 24)"),
             ("day_of_week_sin", f"sin({two_pi} * day_of_week / 7)"),
             ("day_of_week_cos", f"cos({two_pi} * day_of_week / 7)"),
             ("month_sin", f"sin({two_pi} * (month - 1) / 12)"),
             ("month_cos", f"cos({two_pi} * (month - 1) / 12)")]
    return ",\n".join(f"(round({e}, {digits}) + 0.0::DOUBLE) AS {n}" for n, e in parts)


def model_features_sql(panel: str, digits: int = 9) -> str:
    """Panel -> centroids, calendar, cyclical, lags, rolling means, future targets."""
    return f"""
SELECT y.*, {lag_sql()}, {rolling_sql()}, {future_sql()}
FROM (
  SELECT x0.*, {cyclical_cols_sql(digits)}
  FROM (SELECT p.*, c.centroid_lat, c.centroid_lon, {calendar_cols_sql('p.timestamp_utc')}
        FROM ({panel}) p LEFT JOIN {centroids_values()} c ON p.study_area = c.study_area) x0) y
{WINDOW}"""


def split_sql(boundaries: dict, col: str = "timestamp_utc") -> str:
    if "train" in boundaries:
        return (f"CASE WHEN {col} < TIMESTAMP '{boundaries['train']}' THEN 'train' "
                f"WHEN {col} < TIMESTAMP '{boundaries['validation']}' THEN 'validation' "
                f"WHEN {col} < TIMESTAMP '{boundaries['test']}' THEN 'test' END")
    return (f"CASE WHEN {col} >= TIMESTAMP '{boundaries['test']}' THEN 'test' "
            f"WHEN {col} >= TIMESTAMP '{boundaries['validation']}' THEN 'validation' ELSE 'train' END")
