"""Geofence, coordinate and heading / dead-reckoning expressions."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def inside_box(lat="latitude", lon="longitude", min_lat=C.GEOFENCE_MIN_LAT,
               max_lat=C.GEOFENCE_MAX_LAT, min_lon=C.GEOFENCE_MIN_LON,
               max_lon=C.GEOFENCE_MAX_LON) -> Column:
    """Closed bounding box test; null coordinates give null (treated as outside)."""
    return _c(lat).between(min_lat, max_lat) & _c(lon).between(min_lon, max_lon)


def valid_coordinates(lat="latitude", lon="longitude") -> Column:
    """Finite, lat in [-90, 90], lon in [-180, 180]."""
    la, lo = _c(lat), _c(lon)
    finite = ~F.isnan(la) & ~F.isnan(lo)
    return F.coalesce(finite & la.between(-90.0, 90.0) & lo.between(-180.0, 180.0), F.lit(False))


def heading_direction(heading="heading", cog="cog", null_as_zero: bool = False) -> Column:
    """heading in [0, 360], else cog in [0, 360], else 0."""
    h, c = _c(heading), _c(cog)
    if null_as_zero:
        h, c = F.coalesce(h, F.lit(0.0)), F.coalesce(c, F.lit(0.0))
    return F.coalesce(F.when(h.between(0.0, 360.0), h), F.when(c.between(0.0, 360.0), c),
                      F.lit(0.0))


def projection_course(cog="cog", heading="heading") -> Column:
    """Course for dead reckoning: cog when in [0, 360], else heading when in [0, 360]."""
    c, h = _c(cog), _c(heading)
    return F.coalesce(F.when(c.between(0.0, 360.0), c), F.when(h.between(0.0, 360.0), h))


def project_position(lat="latitude", lon="longitude", sog="sog", cog="cog", heading="heading",
                     hours: float = C.PROJECTION_HOURS, radius_nm: float = C.EARTH_RADIUS_NM):
    """Great-circle destination after ``sog * hours`` nautical miles on the course.

    Returns (projected_lat, projected_lon); null when coordinates are invalid,
    sog <= 0 or the course is unknown.
    """
    la, lo, s = _c(lat), _c(lon), _c(sog)
    course = projection_course(cog, heading)
    ok = valid_coordinates(la, lo) & (s > 0) & course.isNotNull()
    d = s * F.lit(hours) / F.lit(radius_nm)
    phi1, lam1, th = F.radians(la), F.radians(lo), F.radians(course)
    phi2 = F.asin(F.sin(phi1) * F.cos(d) + F.cos(phi1) * F.sin(d) * F.cos(th))
    lam2 = lam1 + F.atan2(F.sin(th) * F.sin(d) * F.cos(phi1), F.cos(d) - F.sin(phi1) * F.sin(phi2))
    return F.when(ok, F.degrees(phi2)), F.when(ok, F.degrees(lam2))


