"""Cleaning expressions for raw text columns.

All coercions use ``try_*`` forms: under ANSI mode a plain cast raises on
bad input, while the reference turns bad input into null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


# The characters with the Unicode property White_Space.
WHITE_SPACE = ("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
               "\u2028\u2029\u202f\u205f\u3000")


def strip(col) -> Column:
    """Without white space of any kind (tabs, newlines, no-break spaces) at both ends."""
    return F.btrim(_c(col), F.lit(WHITE_SPACE))


def clean_text(col) -> Column:
    """trim; null tokens -> null."""
    t = strip(col)
    return F.when(~t.isin(*C.NULL_TOKENS), t)


def clean_identifier(col) -> Column:
    """trim; strip one trailing ``,0`` or ``.0``; null tokens -> null."""
    t = strip(col)
    t = F.when(t.endswith(",0") | t.endswith(".0"), F.left(t, F.length(t) - 2)).otherwise(t)
    return F.when(~t.isin(*C.NULL_TOKENS), t)


def clean_numeric(col) -> Column:
    """trim; decimal comma -> point; unparsable -> null."""
    return F.replace(strip(col), F.lit(","), F.lit(".")).try_cast("double")


def valid_digits(col, n: int) -> Column:
    """Keep a cleaned identifier only when it is exactly ``n`` digits."""
    c = _c(col)
    return F.when(c.rlike(f"^[0-9]{{{n}}}\\z"), c)


def parse_time(col) -> Column:
    """Text -> timestamp (UTC session), bad -> null; result has no zone."""
    return F.try_to_timestamp(strip(col)).cast("timestamp_ntz")


def parse_bool(col) -> Column:
    """lower(trim) in the true tokens, else false (null -> false)."""
    return F.coalesce(F.lower(strip(col)).isin(*C.TRUE_TOKENS), F.lit(False))


def in_range(col, low, high, low_inclusive: bool, high_inclusive: bool = True) -> Column:
    c = _c(col)
    lo = (c >= low) if low_inclusive else (c > low)
    hi = (c <= high) if high_inclusive else (c < high)
    return F.when(lo & hi, c)


def duration_hours(departure, arrival) -> Column:
    """(arrival - departure) in hours; negative -> null."""
    d = (F.unix_micros(_c(arrival).cast("timestamp")) -
         F.unix_micros(_c(departure).cast("timestamp"))) / F.lit(3.6e9)
    return F.when(d >= 0, d)


def vessel_key(mmsi="mmsi_nummer", ship_id="skips_id") -> Column:
    """MMSI, else ``SHIP_<id>``, else ``SHIP_UNKNOWN``."""
    return F.coalesce(_c(mmsi), F.concat(F.lit("SHIP_"), F.coalesce(_c(ship_id), F.lit("UNKNOWN"))))


def area_flag(municipality, country_code, area) -> Column:
    """Municipality equals the area and the country code is the home country; null -> false."""
    return F.coalesce((_c(municipality) == _c(area)) &
                      (_c(country_code) == F.lit(C.HOME_COUNTRY_CODE)), F.lit(False))
