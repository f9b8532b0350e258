"""Display-side calculations of the fleet views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def speed_category(sog="sog", null_as_zero: bool = False) -> Column:
    """not finite -> unknown; >= 15 fast; >= 5 moving; else slow."""
    s = _c(sog)
    if null_as_zero:
        s = F.coalesce(s, F.lit(0.0))
    return (F.when(s.isNull() | F.isnan(s), F.lit("unknown"))
             .when(s >= 15, F.lit("fast")).when(s >= 5, F.lit("moving")).otherwise(F.lit("slow")))


def area_slug(area="study_area") -> Column:
    """lower; å->a, ø->o, æ->ae; space->_."""
    low = F.lower(_c(area))
    return F.replace(F.replace(F.translate(low, "åø", "ao"), F.lit("æ"), F.lit("ae")),
                     F.lit(" "), F.lit("_"))


def vessel_name_default(name="vessel_name") -> Column:
    return F.coalesce(F.nullif(_c(name), F.lit("")), F.lit("Unknown vessel"))


def history_progress(available, required) -> Column:
    """min(100, round(available / required * 100)); 0 when required <= 0."""
    a, r = _c(available), _c(required)
    pct = F.round(a.cast("double") / r * 100).cast("bigint")
    return F.when(r <= 0, F.lit(0).cast("bigint")).otherwise(F.least(F.lit(100).cast("bigint"), pct))
