"""Fixed values that must equal the reference application's for equal results.

Everything here is plain data (names, boxes, codes, boundaries).  Operators
take these as defaults and accept overrides as parameters.
"""

from __future__ import annotations

import datetime as _dt

# ---------------------------------------------------------------------------
# Study areas and their centroids (lat, lon).
# ---------------------------------------------------------------------------
STUDY_AREAS = ["Ålesund", "Bergen", "Tromsø", "Stavanger", "Kristiansund"]

AREA_CENTROIDS = {
    "Ålesund": (62.4722, 6.1495),
    "Bergen": (60.3913, 5.3221),
    "Tromsø": (69.6492, 18.9553),
    "Stavanger": (58.9700, 5.7331),
    "Kristiansund": (63.1103, 7.7281),
}

LOCAL_TIMEZONE = "Europe/Oslo"
HOME_COUNTRY_CODE = "NO"

# ---------------------------------------------------------------------------
# Live geofence (closed box) for the operational study area.
# ---------------------------------------------------------------------------
GEOFENCE_NAME = "Ålesund"
GEOFENCE_MIN_LAT = 62.43
GEOFENCE_MAX_LAT = 62.52
GEOFENCE_MIN_LON = 6.05
GEOFENCE_MAX_LON = 6.27

DEFAULT_SOURCE = "BarentsWatch"

# ---------------------------------------------------------------------------
# AIS ship-type code -> live traffic group.
# ---------------------------------------------------------------------------
SHIP_GROUPS = ["passenger", "cargo", "fishing", "tanker", "auxiliary", "tug"]
FISHING_CODES = [30]
TUG_CODES = [31, 32, 52]
PASSENGER_RANGE = (60, 69)
CARGO_RANGE = (70, 79)
TANKER_RANGE = (80, 89)
AUXILIARY_CODES = [33, 34, 35, 50, 51, 53, 54, 55, 58, 59]
SHIP_GROUP_RULES = {
    "passenger": "AIS 60-69",
    "cargo": "AIS 70-79",
    "fishing": "AIS 30",
    "tanker": "AIS 80-89",
    "tug": "AIS 31, 32, 52",
    "auxiliary": "AIS 33, 34, 35, 50, 51, 53, 54, 55, 58, 59",
}

# Historical ship group (skipsgruppe) text -> counter column.
SKIPSGRUPPE_COUNTERS = {
    "Passasjer": "passenger_events",
    "Last": "cargo_events",
    "Fisk": "fishing_events",
    "Tank": "tanker_events",
    "Auxiliary": "auxiliary_events",
    "Slep": "tug_events",
}

# ---------------------------------------------------------------------------
# Cleaning tokens and bounds for raw voyage files.
# ---------------------------------------------------------------------------
NULL_TOKENS = ["", "nan", "NaN", "<NA>", "None"]
TRUE_TOKENS = ["true", "1", "t", "yes", "y"]
LENGTH_BOUNDS = (0.0, 500.0)      # (exclusive, inclusive]
BEAM_BOUNDS = (0.0, 100.0)        # (exclusive, inclusive]
DRAUGHT_BOUNDS = (0.0, 30.0)      # [inclusive, inclusive]
MIN_BUILD_YEAR = 1800

RAW_VOYAGE_COLUMNS = [
    "seilas_id", "skips_id", "imo_nummer", "mmsi_nummer", "kallesignal",
    "fartoynavn", "byggeaar", "bruttotonnasje_bt", "doedvekttonn_dwt", "lengde",
    "bredde", "dypgaaende", "skipstype", "skipsgruppe", "flaggkode", "flaggstat",
    "farlig_last_hazmat", "avgangshavn_id", "avgangshavn_kode", "avgangshavn_navn",
    "etd_estimert_avgangstidspunkt", "land_avgang", "landkode_avgang_totegn",
    "fylkesnavn_avgang", "kommunenavn_avgang", "ankomsthavn_id", "ankomsthavn_kode",
    "ankomsthavn_navn", "ankomsttidspunkt", "land_ankomst", "landkode_ankomst_totegn",
    "fylkesnavn_ankomst", "kommunenavn_ankomst",
]

# ---------------------------------------------------------------------------
# Hourly counters and the 44 + 1 model features, in order.
# ---------------------------------------------------------------------------
COUNTER_COLUMNS = [
    "total_events", "arrivals", "departures", "unique_vessels",
    "passenger_events", "cargo_events", "fishing_events", "tanker_events",
    "auxiliary_events", "tug_events",
]

LAGS = {
    "total_events": [1, 2, 3, 6, 24],
    "arrivals": [1, 2, 3, 24],
    "departures": [1, 2, 3, 24],
    "unique_vessels": [1, 24],
}
ROLLING = {"total_events": [3, 6, 24], "arrivals": [3, 6, 24]}
FUTURE_TARGETS = ["total_events", "arrivals", "unique_vessels"]

CALENDAR_COLUMNS = ["hour_local", "day_of_week", "month", "day_of_year", "is_weekend"]
CYCLICAL_COLUMNS = ["hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos",
                    "month_sin", "month_cos"]

NUMERIC_FEATURES = (
    COUNTER_COLUMNS
    + CALENDAR_COLUMNS
    + [f"{c}_lag_{k}h" for c, ks in LAGS.items() for k in ks]
    + [f"{c}_rolling_mean_{k}h" for c, ks in ROLLING.items() for k in ks]
    + CYCLICAL_COLUMNS
    + ["centroid_lat", "centroid_lon"]
)
CATEGORICAL_FEATURES = ["study_area"]
FEATURE_COLUMNS = NUMERIC_FEATURES + CATEGORICAL_FEATURES

TARGET_COLUMN = "future_total_events_1h"
CLASS_NAMES = ["LOW", "MEDIUM", "HIGH"]          # numeric 0, 1, 2
REQUIRED_HISTORY_HOURS = 25
PREDICTION_HORIZON_HOURS = 1
MIN_HIGH_THRESHOLD = 2
HIGH_QUANTILE = 0.90
GLOBAL_QUANTILES = (0.33, 0.67)
SEQUENCE_LENGTH = 48

# ---------------------------------------------------------------------------
# Dataset period and split boundaries (UTC, end exclusive).
# ---------------------------------------------------------------------------
DATA_START = _dt.datetime(2020, 1, 1)
DATA_END = _dt.datetime(2026, 1, 1)
FINAL_SPLIT = {"train": _dt.datetime(2025, 1, 1), "validation": _dt.datetime(2025, 10, 1),
               "test": _dt.datetime(2026, 1, 1)}
BUILD_SPLIT_MULTI = {"validation": _dt.datetime(2024, 1, 1), "test": _dt.datetime(2025, 1, 1)}
BUILD_SPLIT_SINGLE = {"validation": _dt.datetime(2025, 1, 1), "test": _dt.datetime(2025, 10, 1)}

# Service settings (defaults, not measurements).
INGEST_MAX_WAIT_MS = 1000
GEOFENCE_STATE_TTL_HOURS = 24
ACTIVE_WINDOW_MINUTES = 15
EARTH_RADIUS_NM = 3440.065
PROJECTION_HOURS = 0.5
