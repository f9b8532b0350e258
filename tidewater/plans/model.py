"""Registered queries: labelled model table, thresholds, readiness and live features."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..functions import display as D
from ..operators import features as FT
from ..operators import hourly as H
from ..operators import live as L
from ..operators import livefeatures as LF
from ..operators import metrics as MT
from ..operators import profile as PR
from ..sources import adapters as A
from . import sqlparts as Q
from .registry import register
from .traffic import PANEL_SQL, panel

SPLIT = A.EVENTS_SPLIT
DIGITS = 9
TARGET = C.TARGET_COLUMN
REQUIRED = C.NUMERIC_FEATURES + [TARGET]


def features(spark, sf):
    return FT.model_features(spark, panel(spark, sf), DIGITS)


def split_rows(spark, sf):
    return FT.add_split(features(spark, sf), SPLIT)


def complete_rows(spark, sf):
    return FT.drop_incomplete(split_rows(spark, sf), REQUIRED)


def model_rows(spark, sf):
    return FT.model_table(spark, panel(spark, sf), SPLIT, DIGITS)


FEAT_SQL = Q.model_features_sql(PANEL_SQL, DIGITS)
SPLIT_SQL = f"SELECT * FROM (SELECT *, {Q.split_sql(SPLIT)} AS dataset_split FROM ({FEAT_SQL}) f) s WHERE dataset_split IS NOT NULL"
COMPLETE_SQL = f"SELECT * FROM ({SPLIT_SQL}) s WHERE " + " AND ".join(
    f"{c} IS NOT NULL AND NOT isnan({c})" for c in REQUIRED)
THR_SQL = f"""SELECT study_area, quantile_cont({TARGET}, {C.HIGH_QUANTILE}) AS q90_raw,
  CAST(greatest({C.MIN_HIGH_THRESHOLD}, ceil(quantile_cont({TARGET}, {C.HIGH_QUANTILE}))) AS BIGINT) AS high_threshold
FROM ({COMPLETE_SQL}) c WHERE dataset_split = 'train' AND {TARGET} IS NOT NULL GROUP BY study_area"""


def _sql_level(v: str, high: str) -> str:
    return f"CASE WHEN {v} IS NULL THEN NULL WHEN {v} = 0 THEN 'LOW' WHEN {v} >= {high} THEN 'HIGH' ELSE 'MEDIUM' END"


def _sql_num(label: str) -> str:
    return f"CASE {label} WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2 END"


LABELLED_SQL = f"""
SELECT c.*, {_sql_level(f'c.{TARGET}', 't.high_threshold')} AS traffic_level,
       CAST({_sql_num(_sql_level(f'c.{TARGET}', 't.high_threshold'))} AS INTEGER) AS traffic_level_numeric,
       t.high_threshold
FROM ({COMPLETE_SQL}) c LEFT JOIN ({THR_SQL}) t ON c.study_area = t.study_area"""

TARGETS = ["future_total_events_1h", "future_arrivals_1h", "future_unique_vessels_1h"]
MODEL_COLS = ["timestamp_utc", "study_area", "dataset_split", *C.NUMERIC_FEATURES, *TARGETS,
              "traffic_level", "traffic_level_numeric"]


@register("model_table", f"SELECT {', '.join(MODEL_COLS)} FROM ({LABELLED_SQL}) l")
def model_table(spark, sf):
    """P25 -> P27 -> A9 -> P29: the labelled 44-feature model table."""
    return model_rows(spark, sf)


@register("temporal_split", f"""
SELECT study_area, timestamp_utc, total_events, dataset_split FROM ({SPLIT_SQL}) s""")
def temporal_split(spark, sf):
    """P25 (final form): train / validation / test by exclusive end bounds; later rows dropped."""
    return split_rows(spark, sf).select("study_area", "timestamp_utc", "total_events", "dataset_split")


@register("leakage_purge", f"""
SELECT study_area, timestamp_utc, dataset_split, timestamp_utc + INTERVAL 1 HOUR AS target_timestamp
FROM ({SPLIT_SQL}) s
WHERE {Q.split_sql(SPLIT)} = {Q.split_sql(SPLIT, 'timestamp_utc + INTERVAL 1 HOUR')}""")
def leakage_purge(spark, sf):
    """Keep rows whose target hour falls in the same split (single-area rule)."""
    return FT.purge_leakage(split_rows(spark, sf), SPLIT).select(
        "study_area", "timestamp_utc", "dataset_split", "target_timestamp")


@register("drop_incomplete", f"""
SELECT study_area, dataset_split, COUNT(*) AS rows FROM ({COMPLETE_SQL}) c GROUP BY ALL""")
def drop_incomplete(spark, sf):
    """Rows left per area and split after dropping incomplete feature / target rows."""
    return complete_rows(spark, sf).groupBy("study_area", "dataset_split").agg(
        F.count(F.lit(1)).alias("rows"))


@register("area_thresholds", f"SELECT * FROM ({THR_SQL}) t")
def area_thresholds(spark, sf):
    """Train-only q90 per area and HIGH = max(2, ceil(q90))."""
    return FT.area_thresholds(complete_rows(spark, sf))


@register("classify_area", f"""
SELECT study_area, timestamp_utc, {TARGET}, traffic_level, traffic_level_numeric FROM ({LABELLED_SQL}) l""")
def classify_area(spark, sf):
    """LOW (0 events) / HIGH (>= area threshold) / MEDIUM."""
    return model_rows(spark, sf).select("study_area", "timestamp_utc", TARGET, "traffic_level",
                                        "traffic_level_numeric")


_GQ_SQL = f"""SELECT quantile_cont({TARGET}, 0.33) AS q33, quantile_cont({TARGET}, 0.67) AS q67
FROM ({COMPLETE_SQL}) c WHERE dataset_split = 'train' AND {TARGET} IS NOT NULL"""


@register("global_thresholds", f"SELECT * FROM ({_GQ_SQL}) q")
def global_thresholds(spark, sf):
    """A10: train-only q33 / q67 of the target."""
    return FT.global_thresholds(complete_rows(spark, sf))


@register("classify_quantile", f"""
SELECT c.study_area, c.timestamp_utc, c.{TARGET},
  CASE WHEN c.{TARGET} <= q.q33 THEN 'LOW' WHEN c.{TARGET} <= q.q67 THEN 'MEDIUM' ELSE 'HIGH' END AS traffic_class,
  CAST(CASE WHEN c.{TARGET} <= q.q33 THEN 0 WHEN c.{TARGET} <= q.q67 THEN 1 ELSE 2 END AS INTEGER) AS traffic_class_numeric
FROM ({COMPLETE_SQL}) c, ({_GQ_SQL}) q""")
def classify_quantile(spark, sf):
    """<= q33 LOW, <= q67 MEDIUM, else HIGH (single-area rule)."""
    rows = complete_rows(spark, sf)
    out = FT.classify_by_quantiles(rows, FT.global_thresholds(rows))
    return out.select("study_area", "timestamp_utc", TARGET, "traffic_class", "traffic_class_numeric")


@register("regression_to_class", f"""
SELECT study_area, timestamp_utc, total_events_rolling_mean_3h AS predicted_value, high_threshold,
  CAST(CASE WHEN greatest(0.0::DOUBLE, total_events_rolling_mean_3h) < 0.5 THEN 0
       WHEN greatest(0.0::DOUBLE, total_events_rolling_mean_3h) >= high_threshold - 0.5 THEN 2 ELSE 1 END AS INTEGER)
    AS predicted_class
FROM ({LABELLED_SQL}) l""")
def regression_to_class(spark, sf):
    """A count prediction (here the 3-hour rolling mean) -> class with half-event bounds."""
    rows = model_rows(spark, sf)
    thr = FT.area_thresholds(complete_rows(spark, sf)).select("study_area", "high_threshold")
    j = rows.join(F.broadcast(thr), "study_area")
    return j.select("study_area", "timestamp_utc",
                    F.col("total_events_rolling_mean_3h").alias("predicted_value"), "high_threshold",
                    FT.regression_to_class(F.col("total_events_rolling_mean_3h"), F.col("high_threshold"))
                    .alias("predicted_class"))


def _contract_sql() -> str:
    parts = []
    for i, c in enumerate(C.NUMERIC_FEATURES):
        parts.append(f"""SELECT {i} AS position, '{c}' AS feature, {Q.count_if(f'{c} IS NULL')} AS nulls,
  {Q.count_if(f'isnan({c})')} AS nans, {Q.count_if(f'isinf({c})')} AS infinities FROM ({SPLIT_SQL}) s""")
    return " UNION ALL ".join(parts)


@register("feature_contract", _contract_sql())
def feature_contract(spark, sf):
    """Per feature (fixed order) null / NaN / infinity counts in one aggregate."""
    rows = split_rows(spark, sf)
    missing = [c for c in C.FEATURE_COLUMNS if c not in rows.columns]
    if missing:
        raise ValueError(f"feature contract: missing columns {missing}")
    aggs = []
    for c in C.NUMERIC_FEATURES:
        v = F.col(c).cast("double")
        aggs += [F.count(F.when(F.col(c).isNull(), 1)).alias(f"n__{c}"),
                 F.count(F.when(F.isnan(v), 1)).alias(f"a__{c}"),
                 F.count(F.when(F.abs(v) == float("inf"), 1)).alias(f"i__{c}")]
    wide = rows.agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"),
                               F.col(f"n__{c}").alias("nulls"), F.col(f"a__{c}").alias("nans"),
                               F.col(f"i__{c}").alias("infinities"))
                      for i, c in enumerate(C.NUMERIC_FEATURES)])
    return wide.select(F.inline(pairs))


# Request bounds as rules (name, condition that must hold).
def _bound_rules():
    rules = [(f"{c}_non_negative", f"{c} >= 0") for c in
             C.COUNTER_COLUMNS + [f"{c}_lag_{k}h" for c, ks in C.LAGS.items() for k in ks]
             + [f"{c}_rolling_mean_{k}h" for c, ks in C.ROLLING.items() for k in ks]]
    rules += [("hour_local_range", "hour_local BETWEEN 0 AND 23"),
              ("day_of_week_range", "day_of_week BETWEEN 0 AND 6"),
              ("month_range", "month BETWEEN 1 AND 12"),
              ("day_of_year_range", "day_of_year BETWEEN 1 AND 366"),
              ("is_weekend_binary", "is_weekend IN (0, 1)")]
    rules += [(f"{c}_unit", f"{c} BETWEEN -1 AND 1") for c in C.CYCLICAL_COLUMNS]
    rules += [("centroid_lat_range", "centroid_lat BETWEEN -90 AND 90"),
              ("centroid_lon_range", "centroid_lon BETWEEN -180 AND 180")]
    return rules


@register("request_bounds", " UNION ALL ".join(
    f"SELECT '{n}' AS rule, {Q.count_if(f'NOT ({cond})')} AS violations FROM ({LABELLED_SQL}) l"
    for n, cond in _bound_rules()))
def request_bounds(spark, sf):
    """Violations of the request range rules over the model rows (one pass)."""
    rows = model_rows(spark, sf)
    rules = _bound_rules()
    wide = rows.agg(*[F.count(F.when(~F.expr(cond), 1)).alias(f"r{i}") for i, (_, cond) in enumerate(rules)])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("violations"))
                      for i, (n, _) in enumerate(rules)])
    return wide.select(F.inline(pairs))


_DIST = ", ".join(f"round(quantile_cont(v, {q}), 6) AS q{int(round(q * 100)):02d}" for q in PR.DIST_QUANTILES)


@register("distribution", f"""
SELECT COUNT(v) AS count, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median,
       round(stddev_samp(v), 6) AS std, min(v) AS min, max(v) AS max, {_DIST}
FROM (SELECT CAST({TARGET} AS DOUBLE) AS v FROM ({COMPLETE_SQL}) c WHERE dataset_split = 'train') t""")
def distribution(spark, sf):
    """Target distribution on the train split (exact quantiles)."""
    return PR.distribution(complete_rows(spark, sf).filter(F.col("dataset_split") == "train"), TARGET)


@register("value_histogram", f"""
SELECT {TARGET} AS value, COUNT(*) AS count FROM ({COMPLETE_SQL}) c WHERE {TARGET} IS NOT NULL
GROUP BY 1 ORDER BY 1 LIMIT 30""")
def value_histogram(spark, sf):
    """Counts of the 30 smallest target values."""
    return PR.value_histogram(complete_rows(spark, sf), TARGET)


def _crosstab_sql(by: str) -> str:
    cnt = ", ".join(f"CAST({Q.count_if(f'traffic_level = {Q.lit(c)}')} AS BIGINT) AS {c}" for c in C.CLASS_NAMES)
    tot = "COUNT(*)"
    pct = ", ".join(f"round({Q.count_if(f'traffic_level = {Q.lit(c)}')} * 100.0::DOUBLE / {tot}, 2) AS {c.lower()}_pct"
                    for c in C.CLASS_NAMES)
    return f"SELECT {by}, {cnt}, {tot} AS total, {pct} FROM ({LABELLED_SQL}) l GROUP BY {by}"


@register("class_crosstab", _crosstab_sql("study_area, dataset_split"))
def class_crosstab(spark, sf):
    """LOW / MEDIUM / HIGH counts and % by (area, split)."""
    return PR.class_crosstab(model_rows(spark, sf), ["study_area", "dataset_split"])


@register("area_hour_summary", f"""
SELECT study_area, COUNT(*) AS rows, {Q.count_if('total_events = 0')} AS zero_hours,
  round({Q.count_if('total_events = 0')} * 100.0::DOUBLE / COUNT(*), 6) AS zero_pct,
  round(avg(total_events), 6) AS mean_events, max(total_events) AS max_events,
  round(quantile_cont(y, 0.33), 6) AS train_target_q33, round(quantile_cont(y, 0.67), 6) AS train_target_q67,
  round(quantile_cont(y, 0.90), 6) AS train_target_q90, round(avg(y), 6) AS train_target_mean,
  max(y) AS train_target_max
FROM (SELECT *, CASE WHEN dataset_split = 'train' THEN CAST({TARGET} AS DOUBLE) END AS y FROM ({SPLIT_SQL}) s) t
GROUP BY study_area""")
def area_hour_summary(spark, sf):
    """Per-area zero hours, means, maxima and train-target quantiles."""
    return PR.area_hour_summary(split_rows(spark, sf))


@register("class_weights", f"""
SELECT traffic_level_numeric, COUNT(*) AS count,
  round((SELECT COUNT(*) FROM ({LABELLED_SQL}) a) / ((SELECT COUNT(DISTINCT traffic_level_numeric) FROM ({LABELLED_SQL}) b) * COUNT(*)), 9) AS weight
FROM ({LABELLED_SQL}) l GROUP BY traffic_level_numeric""")
def class_weights(spark, sf):
    """Balanced class weight = total / (classes * count)."""
    return PR.class_weights(model_rows(spark, sf))


SEQ_FEATURES = ["total_events", "arrivals", "departures", "unique_vessels", "passenger_events",
                "cargo_events", "fishing_events", "tanker_events", "auxiliary_events", "tug_events",
                "hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos",
                "is_weekend"]


# All hours, also those that P27 drops for missing lags: the sequences hold only features that every hour has.
STATS_SQL = "SELECT " + ", ".join(
    f"round(avg(CAST({c} AS DOUBLE)), 9) + 0.0::DOUBLE AS mean_{c}, round(stddev_pop(CAST({c} AS DOUBLE)), 9) + 0.0::DOUBLE AS std_{c}"
    for c in SEQ_FEATURES) + f" FROM ({SPLIT_SQL}) s WHERE dataset_split = 'train'"
SCALED_SQL = f"""
SELECT r.study_area, r.timestamp_utc, r.dataset_split,
  CAST({_sql_num(_sql_level(f'r.{TARGET}', 't.high_threshold'))} AS INTEGER) AS label,
  {', '.join(f'CAST(CAST((CAST(r.{c} AS DOUBLE) - m.mean_{c}) / CASE WHEN m.std_{c} = 0 THEN 1.0::DOUBLE ELSE m.std_{c} END AS FLOAT) AS DOUBLE) AS {c}'
             for c in SEQ_FEATURES)}
FROM ({SPLIT_SQL}) r LEFT JOIN ({THR_SQL}) t ON r.study_area = t.study_area CROSS JOIN ({STATS_SQL}) m"""


@register("sequence_windows", f"""
SELECT study_area, area_index, timestamp_utc, dataset_split, label, seq_len,
  {', '.join(f'round(sum_{c}, 6) + 0.0::DOUBLE AS sum_{c}, first_{c}, last_{c}' for c in SEQ_FEATURES)}
FROM (
  SELECT study_area, timestamp_utc, dataset_split, label, COUNT(*) OVER s AS seq_len, MIN(timestamp_utc) OVER s AS oldest,
    CAST(dense_rank() OVER (ORDER BY study_area) - 1 AS INTEGER) AS area_index,
    {', '.join(f'SUM({c}) OVER s AS sum_{c}, FIRST_VALUE({c}) OVER s AS first_{c}, {c} AS last_{c}' for c in SEQ_FEATURES)}
  FROM ({SCALED_SQL}) l
  WINDOW s AS (PARTITION BY study_area ORDER BY timestamp_utc ROWS BETWEEN {C.SEQUENCE_LENGTH - 1} PRECEDING AND CURRENT ROW)
) x WHERE seq_len = {C.SEQUENCE_LENGTH} AND oldest = timestamp_utc - INTERVAL {C.SEQUENCE_LENGTH - 1} HOUR AND label IS NOT NULL""")
def sequence_windows(spark, sf):
    """48 consecutive hours x 17 scaled features ending at t, labelled by t + 1.

    Built from every hour of the panel, scaled by M14's statistics; the windows of a split may begin in the one
    before.  Returned per window: its length, and per feature the sum over the window, its oldest and newest value.
    """
    hours = split_rows(spark, sf)
    rows = FT.scale_features(hours, MT.scaler_stats(hours, SEQ_FEATURES), SEQ_FEATURES)
    rows = FT.classify_by_area(rows, FT.area_thresholds(complete_rows(spark, sf)))
    s = FT.sequence_windows(rows.select("study_area", "timestamp_utc", "dataset_split", "scaled",
                                        F.col("traffic_level_numeric").alias("label")), "label")
    zeros = F.array(*[F.lit(0.0)] * len(SEQ_FEATURES))
    s = s.withColumn("sums", F.aggregate("sequence", zeros, lambda acc, r: F.zip_with(acc, r, lambda a, x: a + x.cast("double"))))
    areas = sorted(C.STUDY_AREAS)
    index = F.array_position(F.array(*[F.lit(a) for a in areas]), F.col("study_area")) - 1
    columns = []
    for i, c in enumerate(SEQ_FEATURES):
        columns += [(F.round(F.col("sums")[i], 6) + F.lit(0.0)).alias(f"sum_{c}"), F.col("sequence")[0][i].cast("double").alias(f"first_{c}"),
                    F.element_at("sequence", -1)[i].cast("double").alias(f"last_{c}")]
    return s.select("study_area", index.cast("int").alias("area_index"), "timestamp_utc", "dataset_split", "label",
                    F.size("sequence").cast("bigint").alias("seq_len"), *columns)


# ---------------------------------------------------------------------------
# Live: readiness, history windows, feature rows
# ---------------------------------------------------------------------------

from .live import EVENTS_SQL as LIVE_EVENTS_SQL  # noqa: E402
from .live import POS, _sql_live_counts  # noqa: E402

LIVE_HOURLY_SQL = f"""
SELECT COALESCE(o.timestamp_utc, c.timestamp_utc) AS timestamp_utc,
  {', '.join(f'CAST(COALESCE(c.{x}, 0) AS BIGINT) AS {x}' for x in C.COUNTER_COLUMNS)}
FROM (SELECT DISTINCT date_trunc('hour', "timestamp") AS timestamp_utc FROM ({POS}) p) o
FULL OUTER JOIN ({_sql_live_counts(LIVE_EVENTS_SQL)}) c ON o.timestamp_utc = c.timestamp_utc"""
REF_START, REF_END = "2024-01-01 00:00:00", "2024-01-31 00:00:00"
REF_HOUR = "2024-01-20 12:00:00"


def live_hourly(spark, sf):
    p = A.ais_positions(spark, sf)
    return H.zero_hour_snapshot(p, L.geofence_transitions(p))


def refs(spark):
    return LF.reference_hours(spark, REF_START, REF_END)


_REFS_SQL = f"""SELECT unnest(generate_series(TIMESTAMP '{REF_START}', TIMESTAMP '{REF_END}' - INTERVAL 1 HOUR,
  INTERVAL 1 HOUR)) AS reference_hour"""


@register("history_window_join", f"""
SELECT g.lag, g.timestamp_utc, h.timestamp_utc IS NOT NULL AS available,
  {', '.join(f'CAST(COALESCE(h.{x}, 0) AS BIGINT) AS {x}' for x in C.COUNTER_COLUMNS)}
FROM (SELECT CAST(l AS INTEGER) AS lag, TIMESTAMP '{REF_HOUR}' - to_hours(l) AS timestamp_utc
      FROM range({C.REQUIRED_HISTORY_HOURS}) t(l)) g
LEFT JOIN ({LIVE_HOURLY_SQL}) h ON g.timestamp_utc = h.timestamp_utc""")
def history_window_join(spark, sf):
    """The reference hour and its 24 predecessors, missing hour -> zeros."""
    return LF.history_window(live_hourly(spark, sf), REF_HOUR)


_READY_SQL = f"""
SELECT reference_hour, available_required_hours, required_hours,
  list_sort(list_filter(range(0, {C.REQUIRED_HISTORY_HOURS}), lambda x: NOT list_contains(lags, x))) AS missing_lags,
  available_required_hours = {C.REQUIRED_HISTORY_HOURS} AS ready
FROM (
  SELECT r.reference_hour, COUNT(h.timestamp_utc) AS available_required_hours,
    {C.REQUIRED_HISTORY_HOURS} AS required_hours,
    list(CAST((epoch(r.reference_hour) - epoch(h.timestamp_utc)) // 3600 AS BIGINT)) AS lags
  FROM ({_REFS_SQL}) r LEFT JOIN ({LIVE_HOURLY_SQL}) h
    ON h.timestamp_utc <= r.reference_hour AND h.timestamp_utc > r.reference_hour - INTERVAL {C.REQUIRED_HISTORY_HOURS} HOUR
  GROUP BY r.reference_hour) a"""


@register("history_readiness", f"""
SELECT reference_hour, available_required_hours, CAST(required_hours AS INTEGER) AS required_hours,
       CAST(missing_lags AS INTEGER[]) AS missing_lags, ready FROM ({_READY_SQL}) x""")
def history_readiness(spark, sf):
    """For every reference hour, which of the 25 required hours exist."""
    return LF.history_readiness(live_hourly(spark, sf), refs(spark))


@register("history_progress", f"""
SELECT reference_hour, available_required_hours,
  CAST(CASE WHEN {C.REQUIRED_HISTORY_HOURS} <= 0 THEN 0
       ELSE least(100, round(available_required_hours * 1.0::DOUBLE / {C.REQUIRED_HISTORY_HOURS} * 100)) END AS BIGINT) AS progress_pct
FROM ({_READY_SQL}) x""")
def history_progress(spark, sf):
    """min(100, round(available / required * 100))."""
    r = LF.history_readiness(live_hourly(spark, sf), refs(spark))
    return r.select("reference_hour", "available_required_hours",
                    D.history_progress(F.col("available_required_hours"), F.col("required_hours"))
                    .alias("progress_pct"))


def _live_features_sql() -> str:
    fan = f"""SELECT h.*, l AS lag, h.timestamp_utc + to_hours(l) AS reference_hour
FROM ({LIVE_HOURLY_SQL}) h, range(0, 25) t(l)"""
    aggs = [f"SUM(CASE WHEN lag = 0 THEN {c} END) AS {c}" for c in C.COUNTER_COLUMNS]
    aggs += [f"SUM(CASE WHEN lag = {k} THEN {c} END) AS {c}_lag_{k}h" for c, ks in C.LAGS.items() for k in ks]
    aggs += [f"SUM(CASE WHEN lag BETWEEN 1 AND {k} THEN {c} END) AS s_{c}_{k}" for c, ks in C.ROLLING.items() for k in ks]
    g = f"SELECT reference_hour, {', '.join(aggs)} FROM ({fan}) f GROUP BY reference_hour"
    cols = [f"CAST(COALESCE(g.{c}, 0) AS BIGINT) AS {c}" for c in C.COUNTER_COLUMNS]
    cols += [f"CAST(COALESCE(g.{c}_lag_{k}h, 0) AS BIGINT) AS {c}_lag_{k}h" for c, ks in C.LAGS.items() for k in ks]
    cols += [f"CAST(COALESCE(g.s_{c}_{k}, 0) AS BIGINT) / {float(k)}::DOUBLE AS {c}_rolling_mean_{k}h"
             for c, ks in C.ROLLING.items() for k in ks]
    base = f"SELECT r.reference_hour AS timestamp_utc, {', '.join(cols)} FROM ({_REFS_SQL}) r LEFT JOIN ({g}) g ON r.reference_hour = g.reference_hour"
    lat, lon = C.AREA_CENTROIDS[C.GEOFENCE_NAME]
    cal = f"SELECT b.*, {Q.calendar_cols_sql('b.timestamp_utc')} FROM ({base}) b"
    cyc = f"SELECT c.*, {Q.cyclical_cols_sql(DIGITS)}, {lat}::DOUBLE AS centroid_lat, {lon}::DOUBLE AS centroid_lon, {Q.lit(C.GEOFENCE_NAME)} AS study_area FROM ({cal}) c"
    return f"SELECT timestamp_utc, {', '.join(C.FEATURE_COLUMNS)} FROM ({cyc}) z"


@register("live_features", _live_features_sql())
def live_features(spark, sf):
    """The 45 ordered live features for every reference hour (missing hour = 0)."""
    return LF.live_feature_rows(spark, live_hourly(spark, sf), refs(spark))


@register("area_slug", f"""
SELECT study_area, replace(replace(translate(lower(study_area), 'åø', 'ao'), 'æ', 'ae'), ' ', '_') AS slug,
       COUNT(*) AS rows FROM ({PANEL_SQL}) p GROUP BY study_area""")
def area_slug(spark, sf):
    """File-safe area names (å->a, ø->o, æ->ae, space->_)."""
    p = panel(spark, sf)
    return p.groupBy("study_area").agg(F.count(F.lit(1)).alias("rows")).select(
        "study_area", D.area_slug("study_area").alias("slug"), "rows")


@register("scaler_stats", " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS feature, round(avg(CAST({c} AS DOUBLE)), 9) + 0.0::DOUBLE AS mean, "
    f"round(stddev_pop(CAST({c} AS DOUBLE)), 9) + 0.0::DOUBLE AS std FROM ({SPLIT_SQL}) l WHERE dataset_split = 'train'"
    for i, c in enumerate(SEQ_FEATURES)))
def scaler_stats(spark, sf):
    """Mean and population std of the 17 sequence features over all train hours."""
    return MT.scaler_stats(split_rows(spark, sf), SEQ_FEATURES)


@register("lookup_join", f"""
SELECT l.study_area, l.timestamp_utc, c.centroid_lat AS area_lat, c.centroid_lon AS area_lon, t.high_threshold
FROM ({LABELLED_SQL}) l
JOIN {Q.centroids_values()} c ON l.study_area = c.study_area
JOIN ({THR_SQL}) t ON l.study_area = t.study_area""")
def lookup_join(spark, sf):
    """Dictionary lookups by area (centroid, HIGH threshold) as broadcast equi-joins
    against dimensions bounded by the area list."""
    rows = model_rows(spark, sf).select("study_area", "timestamp_utc")
    cen = FT.centroids_frame(spark).select("study_area", F.col("centroid_lat").alias("area_lat"),
                                           F.col("centroid_lon").alias("area_lon"))
    thr = FT.area_thresholds(complete_rows(spark, sf)).select("study_area", "high_threshold")
    return rows.join(F.broadcast(cen), "study_area").join(F.broadcast(thr), "study_area")


_BUILD_SPLIT = {"validation": "2024-01-15 00:00:00", "test": "2024-01-25 00:00:00"}


@register("temporal_split_build", f"""
SELECT study_area, timestamp_utc, {Q.split_sql(_BUILD_SPLIT)} AS dataset_split FROM ({PANEL_SQL}) p""")
def temporal_split_build(spark, sf):
    """P25 (build-time form): validation and test from inclusive start bounds, nothing dropped."""
    p = panel(spark, sf).select("study_area", "timestamp_utc")
    return p.withColumn("dataset_split", FT.split_label(F.col("timestamp_utc"), _BUILD_SPLIT))


@register("write_metadata")
def write_metadata(spark, sf):
    """Thresholds, feature lists, split ranges and class counts as one nested row
    (``operators.sinks.write_metadata`` writes it as JSON)."""
    from ..operators.sinks import metadata_frame
    return metadata_frame(model_rows(spark, sf), FT.area_thresholds(complete_rows(spark, sf)))
