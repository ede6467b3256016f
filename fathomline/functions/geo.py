"""Geodesy as column expressions on the WGS84 ellipsoid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371008.8
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
METRES_PER_DEGREE = 111320.0


def circle(degrees: Column) -> Column:
    """An angle from 0 to below 360; one between them keeps all its digits."""
    return degrees - 360.0 * F.floor(degrees / 360.0)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def lerp_heading(h0: Column, h1: Column, f: Column) -> Column:
    """Between two headings along the shorter arc, 0 to 360."""
    turn = circle(h1 - h0 + 180) - 180
    return circle(h0 + f * turn)


def lerp_known(a0: Column, a1: Column, f: Column) -> Column:
    """Between two values; the first alone where the second is missing, null where the first is."""
    return F.when(a1.isNull(), a0).otherwise(a0 * (1 - f) + a1 * f)


def ground_range(slant: Column, altitude: Column) -> Column:
    """Range along the bottom; the slant range itself where the altitude is unknown."""
    return F.when(altitude.isNull(), slant).otherwise(F.sqrt(F.greatest(slant * slant - altitude * altitude, F.lit(0.0))))


def bearing(heading: Column, starboard: Column) -> Column:
    return circle(heading + F.when(starboard, 90.0).otherwise(-90.0))


def uncertainty_band(metres: Column) -> Column:
    return F.when(metres <= 10, "HIGH").when(metres <= 40, "MEDIUM").otherwise("LOW")


def error_budget(ground: Column, altitude: Column, max_range: float, half_columns: float, gps: float = 5.0, heading_deg: float = 2.0, layback: float = 0.0, altitude_m: float = 0.5) -> dict[str, Column]:
    """The five error terms in metres and their root sum of squares."""
    off = F.least(F.abs(altitude) / F.greatest(ground, F.lit(1e-3)) * altitude_m, F.lit(max_range))
    terms = {
        "gps_m": F.lit(gps),
        "heading_m": ground * F.sin(F.radians(F.lit(heading_deg))),
        "layback_m": F.lit(layback),
        "altitude_m": F.when(altitude.isNull(), F.lit(max_range * 0.05)).otherwise(off),
        "range_resolution_m": F.lit(max_range / max(half_columns, 1.0)),
    }
    total = F.lit(0.0)
    for term in terms.values():
        total = total + term * term
    return {**terms, "uncertainty_m": F.sqrt(total)}


def utm_zone(lon: Column) -> Column:
    return F.floor((lon + 180) / 6).cast("int") + 1


def utm_epsg(lat: Column, lon: Column) -> Column:
    return F.when(lat >= 0, 32600 + utm_zone(lon)).otherwise(32700 + utm_zone(lon))


def utm_project(lat: Column, lon: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """(easting, northing) by the transverse Mercator series to the third order in n."""
    n = FLATTENING / (2 - FLATTENING)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * n**0.5 / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, start=1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.lit(500000.0) + 0.9996 * radius * east, F.when(south, 10000000.0).otherwise(0.0) + 0.9996 * radius * north


def utm_unproject(east: Column, north: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """(latitude, longitude) by the inverse of the transverse Mercator series, to the fourth order in n: far below a millimetre."""
    n = FLATTENING / (2 - FLATTENING)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
    xi = (north - F.when(south, 10000000.0).otherwise(0.0)) / (0.9996 * radius)
    eta = (east - 500000.0) / (0.9996 * radius)
    up, side = xi, eta
    for j, b in enumerate(beta, start=1):
        up = up - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        side = side - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(up) / F.cosh(side))
    phi = chi
    for j, d in enumerate(delta, start=1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.degrees(phi), (zone * 6 - 183) + F.degrees(F.atan2(F.sinh(side), F.cos(up)))


def crs_kind(epsg: Column) -> Column:
    """"geographic" for degrees on WGS84, "utm" for its zones, null for systems that are not known here."""
    zone = epsg % 100
    return F.when(epsg == 4326, "geographic").when((F.floor(epsg / 100).isin(326, 327)) & zone.between(1, 60), "utm")


def to_wgs84(x: Column, y: Column, epsg: Column) -> tuple[Column, Column]:
    """(latitude, longitude) of map coordinates; null where the system is not known here."""
    lat, lon = utm_unproject(x, y, epsg % 100, F.floor(epsg / 100) == 327)
    kind = crs_kind(epsg)
    return F.when(kind == "geographic", y).when(kind == "utm", lat), F.when(kind == "geographic", x).when(kind == "utm", lon)


def locate(x: Column, y: Column, georef: Column, height: Column, width: Column, pixels: float = 1.0) -> Column:
    """Where a pixel of a georeferenced raster lies: struct(latitude, longitude, uncertainty_m, method, confidence, pixel_size_m).

    Null where ``georef`` (struct of affine and epsg) is null or its system is
    not known here: no place is made up. The uncertainty is the size of a
    pixel, or of ``pixels`` of them; the error of the rectification is not in it.
    """
    a = [F.get(georef["affine"], F.lit(k)) for k in range(6)]
    epsg = georef["epsg"]
    at = lambda u, v: (a[0] * u + a[1] * v + a[2], a[3] * u + a[4] * v + a[5])
    lat, lon = to_wgs84(*at(x, y), epsg)
    middle = at(width / 2, height / 2)[1]
    size = F.when(crs_kind(epsg) == "utm", F.sqrt(a[0] * a[0] + a[3] * a[3])).otherwise(F.abs(a[0]) * METRES_PER_DEGREE * F.greatest(F.cos(F.radians(middle)), F.lit(1e-6)))
    uncertainty = size * max(pixels, 1.0)
    fix = F.struct(
        lat.alias("latitude"), lon.alias("longitude"), uncertainty.alias("uncertainty_m"), F.lit("geotiff_affine").alias("method"), uncertainty_band(uncertainty).alias("confidence"), size.alias("pixel_size_m")
    )
    return F.when(lat.isNotNull(), fix)


def describe_georeference(georef: Column) -> Column:
    """What a report says of a raster's georeference: struct(available, method, epsg, note)."""
    known = crs_kind(georef["epsg"]).isNotNull()
    note = F.when(georef.isNull(), "no georeferencing in the file").when(~known, "coordinate system not supported").otherwise("uncertainty is that of the raster's resolution only")
    return F.struct((georef.isNotNull() & known).alias("available"), F.when(georef.isNotNull() & known, "geotiff_affine").otherwise("none").alias("method"), georef["epsg"].alias("epsg"), note.alias("note"))


def affine(x: Column, y: Column, a: tuple[float, ...]) -> tuple[Column, Column]:
    """Pixel to map coordinates by the six affine terms of a raster."""
    return a[0] * x + a[1] * y + a[2], a[3] * x + a[4] * y + a[5]


def affine_from_tiepoint(scale: tuple[float, float], tie: tuple[float, ...]) -> tuple[float, ...]:
    """The six terms from pixel scale and one tie point (i, j, k, X, Y, Z)."""
    i, j, _, x, y, _ = tie
    return scale[0], 0.0, x - i * scale[0], 0.0, -scale[1], y + j * scale[1]


def epsg_from_geokeys(keys: list[int]) -> int | None:
    """The EPSG code in a GeoKey directory: projected (3072) or geographic (2048) CRS entries held in place, from 1024 to 32767."""
    entries = [keys[at : at + 4] for at in range(4, 4 + 4 * (keys[3] if len(keys) > 3 else 0), 4)]
    return next((e[3] for e in entries if len(e) == 4 and e[0] in (3072, 2048) and e[1] == 0 and 1024 <= e[3] <= 32767), None)


def pixel_size_m(a: tuple[float, ...], lat: Column | None) -> Column:
    """Metres a pixel: from the affine terms, which are degrees where ``lat`` is given."""
    if lat is None:
        return F.lit((a[0] ** 2 + a[3] ** 2) ** 0.5)
    return F.abs(F.lit(a[0])) * METRES_PER_DEGREE * F.greatest(F.cos(F.radians(lat)), F.lit(1e-6))
