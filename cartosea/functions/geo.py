"""Scalar map maths as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

MERCATOR_RADIUS, EARTH_KM, KM_PER_DEGREE, MERCATOR_LIMIT = 6378137.0, 6371.0, 111.0, 85.0511


def grid_px(feature_m, px_m):
    """Feature size in pixels: half-even rounding, 2 at least."""
    return F.greatest(F.lit(2), F.bround(feature_m / px_m).cast("int"))


def slippy_x(lon, zoom: int):
    """Tile column of a longitude."""
    return F.floor((lon + 180.0) / 360.0 * 2**zoom).cast("bigint")


def slippy_y(lat, zoom: int):
    """Tile row of a latitude."""
    return F.floor((1.0 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2.0 * 2**zoom).cast("bigint")


def slippy_lon(x, zoom: int):
    """West edge of a tile column."""
    return x / float(2**zoom) * 360.0 - 180.0


def slippy_lat(y, zoom: int):
    """North edge of a tile row."""
    return F.degrees(F.atan(F.sinh(math.pi * (1.0 - 2.0 * y / float(2**zoom)))))


def mercator_x(lon):
    """Spherical Mercator easting in metres."""
    return MERCATOR_RADIUS * F.radians(lon)


def mercator_y(lat):
    """Spherical Mercator northing in metres."""
    return MERCATOR_RADIUS * F.log(F.tan(math.pi / 4 + F.radians(lat) / 2))


def utm_zone(lon):
    """UTM zone number."""
    return (((lon + 180.0) / 6.0).cast("int") + 1).cast("int")


def utm_epsg(lon, lat):
    """EPSG name of the UTM zone of a place."""
    return F.concat(F.lit("EPSG:"), (F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)).cast("string"))


def metric_crs(lon, lat, min_lon, max_lon):
    """The place's UTM zone unless the extent crosses zones."""
    return F.when(utm_zone(min_lon) != utm_zone(max_lon), "EPSG:3857").otherwise(utm_epsg(lon, lat))


def utm_easting_northing(lon, lat):
    """UTM coordinates of a place in its own zone by the Krueger series to third order (WGS84), in metres."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    big_a = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3, 13 / 48 * n**2 - 3 / 5 * n**3, 61 / 240 * n**3)
    s = F.sin(F.radians(lat))
    c = 2 * math.sqrt(n) / (1 + n)
    t = F.sinh(F.atanh(s) - c * F.atanh(c * s))
    dl = F.radians(lon - (utm_zone(lon) * 6 - 183))
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    e, no = eta, xi
    for j, a in enumerate(alpha, 1):
        e = e + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        no = no + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    k = 0.9996 * big_a
    return 500000.0 + k * e, F.when(lat < 0, 10000000.0).otherwise(0.0) + k * no


def km_to_deg(km, lat):
    """Mean of a distance in degrees of latitude and of longitude."""
    return (km / KM_PER_DEGREE + km / (KM_PER_DEGREE * F.cos(F.radians(lat)))) / 2.0


def haversine_km(lon1, lat1, lon2, lat2):
    """Great-circle distance in kilometres."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def planar(lon1, lat1, lon2, lat2):
    """Planar distance in degrees."""
    return F.sqrt(F.pow(lon2 - lon1, 2) + F.pow(lat2 - lat1, 2))


def smoothstep(t):
    """Cubic ease from 0 to 1."""
    return t * t * (3.0 - 2.0 * t)


def area_bbox(lat, lon, area_km):
    """(min_lat, max_lat, min_lon, max_lon) of a square area around a place."""
    half, wide = area_km / 111.0 / 2.0, area_km / (111.0 * 0.8) / 2.0
    return lat - half, lat + half, lon - wide, lon + wide


#: Cells of a grid's side, and of a grid, at most.
MOST_CELLS = 12_000


def grid_cells(width_m, height_m, gsd):
    """(columns, rows, error): cells of an extent in metres; error says why a grid is too large, else it is null."""
    cols, rows = F.ceil(width_m / gsd).cast("bigint"), F.ceil(height_m / gsd).cast("bigint")
    large = (cols > MOST_CELLS) | (rows > MOST_CELLS) | (cols * rows > MOST_CELLS * MOST_CELLS)
    return cols, rows, F.when(large, F.concat(cols.cast("string"), F.lit(" x "), rows.cast("string"), F.lit(f" cells, over {MOST_CELLS} x {MOST_CELLS}")))
