"""Hour keys, calendar and cyclical encodings, freshness."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def floor_hour(ts) -> Column:
    """UTC hour start, kept zone-less (timestamp_ntz)."""
    return F.date_trunc("hour", _c(ts).cast("timestamp")).cast("timestamp_ntz")


def hour_key(ts) -> Column:
    """Text key ``yyyyMMddHH`` of the UTC hour."""
    return F.date_format(_c(ts).cast("timestamp"), "yyyyMMddHH")


def local_time(ts, zone: str = C.LOCAL_TIMEZONE) -> Column:
    """Wall-clock time in ``zone`` for a UTC instant (features only; never a join key)."""
    return F.from_utc_timestamp(_c(ts).cast("timestamp"), zone)


def calendar_columns(ts="timestamp_utc", zone: str = C.LOCAL_TIMEZONE) -> list[Column]:
    lt = local_time(ts, zone)
    dow = F.weekday(lt)  # Monday = 0
    return [F.hour(lt).cast("int").alias("hour_local"),
            dow.cast("int").alias("day_of_week"),
            F.month(lt).cast("int").alias("month"),
            F.dayofyear(lt).cast("int").alias("day_of_year"),
            dow.isin(5, 6).cast("int").alias("is_weekend")]


def cyclical_columns(hour="hour_local", dow="day_of_week", month="month",
                     digits: int | None = None) -> list[Column]:
    two_pi = F.lit(2 * math.pi)

    def r(x):
        return (F.round(x, digits) + F.lit(0.0)) if digits is not None else x

    h, d, m = _c(hour), _c(dow), _c(month)
    return [r(F.sin(two_pi * h / 24)).alias("hour_sin"),
            r(F.cos(two_pi * h / 24)).alias("hour_cos"),
            r(F.sin(two_pi * d / 7)).alias("day_of_week_sin"),
            r(F.cos(two_pi * d / 7)).alias("day_of_week_cos"),
            r(F.sin(two_pi * (m - 1) / 12)).alias("month_sin"),
            r(F.cos(two_pi * (m - 1) / 12)).alias("month_cos")]


def age_seconds(ts, now) -> Column:
    """Whole seconds between ``ts`` and the reference time (the difference is floored), negative clamped to 0."""
    diff = F.unix_micros(_c(now).cast("timestamp")) - F.unix_micros(_c(ts).cast("timestamp"))
    return F.greatest(F.floor(diff / 1_000_000), F.lit(0).cast("bigint"))


def freshness_label(ts, now) -> Column:
    """``<n>s ago`` under a minute, ``<n>m ago`` under an hour, ``<n>h ago`` under
    a day, else the time itself; no time -> ``Unknown``."""
    a = age_seconds(ts, now)
    return (F.when(_c(ts).isNull(), F.lit("Unknown"))
             .when(a < 60, F.concat(a.cast("string"), F.lit("s ago")))
             .when(a < 3600, F.concat(F.floor(a / 60).cast("string"), F.lit("m ago")))
             .when(a < 86400, F.concat(F.floor(a / 3600).cast("string"), F.lit("h ago")))
             .otherwise(F.date_format(_c(ts).cast("timestamp"), "yyyy-MM-dd HH:mm")))
