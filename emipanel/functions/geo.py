"""Coordinates, grids and location provenance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emipanel.functions.core import as_col
from emipanel.functions.numeric import cyclic

# How far from its city centre a point may lie, and the climate grid step.
SANITY_RADIUS_DEG = 2.0
GRID_DEG = 0.5


def valid_coord(lat, lon, centre_lat, centre_lon, radius: float = SANITY_RADIUS_DEG) -> Column:
    lat, lon = as_col(lat), as_col(lon)
    near = (F.abs(lat - as_col(centre_lat)) <= radius) & (F.abs(lon - as_col(centre_lon)) <= radius)
    known = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    return F.coalesce(known & (lat != 0) & (lon != 0) & near, F.lit(False))


def in_radius(lat, lon, centre_lat, centre_lon, radius: float = SANITY_RADIUS_DEG) -> Column:
    """As above for side tables: a city without a known centre passes."""
    near = ((F.abs(as_col(lat) - as_col(centre_lat)) <= radius)
            & (F.abs(as_col(lon) - as_col(centre_lon)) <= radius))
    return as_col(centre_lat).isNull() | F.coalesce(near, F.lit(False))


def snap(c, step: float = GRID_DEG) -> Column:
    """Nearest grid line, exact halves to the even one."""
    return F.bround(F.bround(as_col(c) / F.lit(step), 0) * F.lit(step), 4)


def grid_key(lat, lon, year) -> Column:
    return F.format_string("%.4f|%.4f|%d", as_col(lat), as_col(lon), as_col(year).cast("long"))


def utm_epsg(lat, lon) -> Column:
    zone = ((as_col(lon) + 180.0) / 6.0).cast("int") + 1
    return F.when(as_col(lat) >= 0, F.lit(32600) + zone).otherwise(F.lit(32700) + zone)


def position_features(lat, lon, week=26.0, hour=12.0) -> dict[str, Column]:
    """sin/cos of latitude, longitude, week of year and hour of day."""
    la, lo = F.radians(as_col(lat)), F.radians(as_col(lon))
    week_sin, week_cos = cyclic(F.lit(week) if not isinstance(week, (str, Column)) else week, 52.0)
    hour_sin, hour_cos = cyclic(F.lit(hour) if not isinstance(hour, (str, Column)) else hour, 24.0)
    return {"lat_sin": F.sin(la), "lat_cos": F.cos(la), "lon_sin": F.sin(lo), "lon_cos": F.cos(lo),
            "week_sin": week_sin, "week_cos": week_cos, "hour_sin": hour_sin, "hour_cos": hour_cos}


__all__ = ["SANITY_RADIUS_DEG", "GRID_DEG", "valid_coord", "in_radius", "snap", "grid_key", "utm_epsg",
           "position_features"]
