"""Queries on navigation and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import geo as G
from fathomline.functions.numbers import micro
from fathomline.operators import navigation as N
from fathomline.plans.registry import query
from fathomline.plans.views import NAV, micro_sql, nav, read

#: Image rows of a track.
HEIGHT = 400
_PMOD = "({0}) - 360.0::DOUBLE * floor(({0}) / 360.0::DOUBLE)"


@query(
    f"""WITH {NAV} SELECT track, count(*) AS pings, {micro_sql("min(lat)")} AS lat_min, {micro_sql("max(lat)")} AS lat_max, {micro_sql("min(lon)")} AS lon_min,
    {micro_sql("max(lon)")} AS lon_max, count(altitude) > 0 AS has_altitude FROM nav GROUP BY track"""
)
def nav_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG23: extent and content of each track."""
    return N.describe(nav(spark, sf_dir)).withColumns({c: micro(F.col(c)) for c in ("lat_min", "lat_max", "lon_min", "lon_max")})


_COURSE = f"""{NAV}, around AS (
    SELECT track, nav_idx, coalesce(lead(lat) OVER w, lat) AS lat1, coalesce(lag(lat) OVER w, lat) AS lat0, coalesce(lead(lon) OVER w, lon) AS lon1, coalesce(lag(lon) OVER w, lon) AS lon0
    FROM nav WINDOW w AS (PARTITION BY track ORDER BY nav_idx)
), course AS (SELECT track, nav_idx, degrees(atan2(radians(lon1 - lon0) * cos(radians((lat1 + lat0) / 2)), radians(lat1 - lat0))) + 360 AS c FROM around)"""


@query(f"WITH {_COURSE} SELECT track, nav_idx, {micro_sql(_PMOD.format('c'))} AS heading, true AS heading_derived FROM course")
def nav_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN2: course over ground where no heading was logged."""
    blank = nav(spark, sf_dir).withColumn("heading", F.lit(None).cast("double"))
    return N.with_heading(blank).select("track", "nav_idx", micro(F.col("heading")).alias("heading"), "heading_derived")


_AT = f"""{NAV}, counted AS (SELECT track, count(*) AS n FROM nav GROUP BY track), placed AS (
    SELECT track, r.row, n, least(greatest(r.row / 399.0::DOUBLE, 0), 1) * (n - 1) AS t FROM counted CROSS JOIN (SELECT CAST(unnest(range(400)) AS INTEGER) AS row) r
), bracket AS (SELECT *, floor(t)::BIGINT AS i0, least(floor(t)::BIGINT + 1, n - 1) AS i1, t - floor(t) AS f FROM placed
), fixes AS (
    SELECT b.track, b.row, a.lat * (1 - f) + z.lat * f AS lat, a.lon * (1 - f) + z.lon * f AS lon,
           a.heading + f * ({_PMOD.format("z.heading - a.heading + 180")} - 180) AS turn, CASE WHEN z.altitude IS NULL THEN a.altitude ELSE a.altitude * (1 - f) + z.altitude * f END AS altitude
    FROM bracket b JOIN nav a ON a.track = b.track AND a.nav_idx = b.i0 JOIN nav z ON z.track = b.track AND z.nav_idx = b.i1
), at_rows AS (SELECT track, row, lat, lon, {_PMOD.format("turn")} AS heading, altitude FROM fixes)"""


def _at_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fix for each of the HEIGHT image rows of every track."""
    n = nav(spark, sf_dir)
    rows = n.select("track").distinct().select("track", F.explode(F.sequence(F.lit(0), F.lit(HEIGHT - 1))).alias("row"))
    return N.at_rows(rows, n, HEIGHT)


@query(f"WITH {_AT} SELECT track, row, {micro_sql('lat')} AS lat, {micro_sql('lon')} AS lon, {micro_sql('heading')} AS heading, {micro_sql('altitude')} AS altitude FROM at_rows")
def nav_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN6, SC2, SC3: position, heading and altitude at image rows."""
    return _at_rows(spark, sf_dir).withColumns({c: micro(F.col(c)) for c in ("lat", "lon", "heading", "altitude")})


_SLANT = "abs((track * 37 + row) % 640 - 320) / 320.0::DOUBLE * 60"
_BUDGET = f"""{_AT}, slanted AS (SELECT *, {_SLANT} AS slant, (track * 37 + row) % 640 > 320 AS starboard FROM at_rows
), ranged AS (SELECT *, CASE WHEN altitude IS NULL THEN slant ELSE sqrt(greatest(slant * slant - altitude * altitude, 0.0)) END AS ground FROM slanted
), budget AS (
    SELECT *, ground * sin(radians(2.0::DOUBLE)) AS heading_m, CASE WHEN altitude IS NULL THEN 3.0 ELSE least(abs(altitude) / greatest(ground, 1e-3) * 0.5, 60.0) END AS altitude_m FROM ranged
), total AS (SELECT *, sqrt(25.0::DOUBLE + heading_m * heading_m + altitude_m * altitude_m + 0.1875::DOUBLE * 0.1875::DOUBLE) AS uncertainty_m FROM budget)"""


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes with a pixel column each, its slant and ground range."""
    x = (F.col("track") * 37 + F.col("row")) % 640
    slanted = _at_rows(spark, sf_dir).withColumn("slant", F.abs(x - 320) / 320 * 60).withColumn("starboard", x > 320)
    return slanted.withColumn("ground", G.ground_range(F.col("slant"), F.col("altitude")))


@query(
    f"""WITH {_BUDGET} SELECT track, row, {micro_sql("ground")} AS ground, {micro_sql("heading_m")} AS heading_m, {micro_sql("altitude_m")} AS altitude_m, {micro_sql("uncertainty_m")} AS uncertainty_m,
    CASE WHEN uncertainty_m <= 10 THEN 'HIGH' WHEN uncertainty_m <= 40 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM total"""
)
def geo_error_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC4, SC7, SC8: ground range, error terms in quadrature and the band."""
    terms = G.error_budget(F.col("ground"), F.col("altitude"), 60.0, 320.0)
    out = _located(spark, sf_dir).withColumns({c: terms[c] for c in ("heading_m", "altitude_m", "uncertainty_m")})
    # The altitude of the fix was replaced by nothing: the term has a name of its own.
    return out.select("track", "row", micro(F.col("ground")).alias("ground"), micro(F.col("heading_m")).alias("heading_m"), micro(F.col("altitude_m")).alias("altitude_m"), micro(F.col("uncertainty_m")).alias("uncertainty_m"), G.uncertainty_band(F.col("uncertainty_m")).alias("band"))


def _forward_sql() -> str:
    """The direct series with its iteration unrolled, one common table a round."""
    b = 6378137.0 * (1 - 1 / 298.257223563)
    f = 1 / 298.257223563
    out = f"""start AS (SELECT *, radians({_PMOD.format("heading + CASE WHEN starboard THEN 90.0 ELSE -90.0 END")}) AS a1, atan({1 - f!r}::DOUBLE * tan(radians(lat))) AS u1 FROM ranged
), base AS (SELECT *, atan2(tan(u1), cos(a1)) AS sigma1, cos(u1) * sin(a1) AS sin_a FROM start
), wide AS (SELECT *, 1 - sin_a * sin_a AS cos2_a, (1 - sin_a * sin_a) * {(6378137.0**2 - b**2) / b**2!r}::DOUBLE AS u2 FROM base
), series AS (SELECT *, 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2))) AS big_a, u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2))) AS big_b FROM wide
), round0 AS (SELECT *, ground / ({b!r}::DOUBLE * big_a) AS first, ground / ({b!r}::DOUBLE * big_a) AS sigma FROM series"""
    for k in range(5):
        out += f"""), mid{k} AS (SELECT * EXCLUDE (sigma), sigma AS s, cos(2 * sigma1 + sigma) AS c FROM round{k}
), round{k + 1} AS (SELECT * EXCLUDE (s, c), first + big_b * sin(s) * (c + big_b / 4 * (cos(s) * (c * c * 2 - 1) - big_b / 6 * c * (power(sin(s), 2) * 4 - 3) * (c * c * 4 - 3))) AS sigma FROM mid{k}"""
    return (
        out
        + f"""), last AS (SELECT *, cos(2 * sigma1 + sigma) AS c, sin(u1) * sin(sigma) - cos(u1) * cos(sigma) * cos(a1) AS across, {f / 16!r}::DOUBLE * cos2_a * (4 + {f!r}::DOUBLE * (4 - 3 * cos2_a)) AS k FROM round5
), ended AS (SELECT track, row, lat, lon, degrees(atan2(sin(u1) * cos(sigma) + cos(u1) * sin(sigma) * cos(a1), {1 - f!r}::DOUBLE * sqrt(sin_a * sin_a + across * across))) AS lat2,
    lon + degrees(atan2(sin(sigma) * sin(a1), cos(u1) * cos(sigma) - sin(u1) * sin(sigma) * cos(a1))
        - (1 - k) * {f!r}::DOUBLE * sin_a * (sigma + k * sin(sigma) * (c + k * cos(sigma) * (c * c * 2 - 1)))) AS lon2 FROM last)"""
    )


_PLACED = "SELECT track, row, {0} AS lat, {1} AS lon, floor(({2}) * 1e7 + 0.5) / 1e7 AS north, floor(({3}) * 1e7 + 0.5) / 1e7 AS east FROM ended".format(
    *[f"floor({c} * 1e5 + 0.5) / 1e5" for c in ("lat2", "lon2")], "lat2 - lat", "lon2 - lon"
)


@query(f"WITH {_BUDGET}, {_forward_sql()} {_PLACED}")
def geodesic_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC5, SC6: the point on the bottom, along the bearing across the track, and how far it is from the fix, in degrees to a centimetre."""
    reached = N.geodesic_forward(_located(spark, sf_dir), F.col("lat"), F.col("lon"), G.bearing(F.col("heading"), F.col("starboard")), F.col("ground"))
    cut = lambda x, digits: F.floor(x * 10**digits + 0.5) / 10**digits
    return reached.select("track", "row", cut(F.col("lat2"), 5).alias("lat"), cut(F.col("lon2"), 5).alias("lon"), cut(F.col("lat2") - F.col("lat"), 7).alias("north"), cut(F.col("lon2") - F.col("lon"), 7).alias("east"))


@query(
    f"""WITH {NAV}, mean AS (SELECT track, avg(lat) AS lat, avg(lon) AS lon FROM nav GROUP BY track), zoned AS (SELECT *, floor((lon + 180) / 6)::INTEGER + 1 AS zone FROM mean)
    SELECT track, zone, CASE WHEN lat >= 0 THEN 32600 + zone ELSE 32700 + zone END AS epsg FROM zoned"""
)
def utm_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC12: one projected zone for each track, from its mean position."""
    mean = nav(spark, sf_dir).groupBy("track").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    return mean.select("track", G.utm_zone(F.col("lon")).alias("zone"), G.utm_epsg(F.col("lat"), F.col("lon")).alias("epsg"))


def _utm_sql() -> str:
    n = G.FLATTENING / (2 - G.FLATTENING)
    scale = 0.9996 * (G.SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64))
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * n**0.5 / (1 + n)
    east = " + ".join(f"{a!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(alpha, start=1))
    north = " + ".join(f"{a!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(alpha, start=1))
    milli = "floor(({}) * 1e3 + 0.5) / 1e3"
    return f"""WITH {NAV}, angles AS (SELECT track, nav_idx, sinh(atanh(sin(radians(lat))) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * sin(radians(lat)))) AS t, radians(lon - 81) AS lam FROM nav
    ), grid AS (SELECT track, nav_idx, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM angles)
    SELECT track, nav_idx, {milli.format(f"500000.0 + {scale!r}::DOUBLE * (eta + {east})")} AS easting, {milli.format(f"{scale!r}::DOUBLE * (xi + {north})")} AS northing FROM grid"""


@query(_utm_sql())
def utm_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC10, SC12: projected coordinates to a millimetre, in zone 44 north."""
    east, north = G.utm_project(F.col("lat"), F.col("lon"), F.lit(44), F.lit(False))
    milli = lambda x: F.floor(x * 1e3 + 0.5) / 1e3
    return nav(spark, sf_dir).select("track", "nav_idx", milli(east).alias("easting"), milli(north).alias("northing"))


@query(f"WITH {NAV} SELECT track, nav_idx, true AS exact FROM nav")
def utm_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC10: fixes projected and back again are less than a tenth of a millimetre off."""
    n = nav(spark, sf_dir)
    zone, south = F.col("track") % 60 + 1, F.col("track") % 2 == 0
    lat, lon = F.when(south, -F.col("lat")).otherwise(F.col("lat") * 6.2), zone * 6 - 183 + (F.col("lon") - 80.3) * 3000
    moved = n.select("track", "nav_idx", lat.alias("lat"), lon.alias("lon"), zone.alias("zone"), south.alias("south"))
    east, north = G.utm_project(F.col("lat"), F.col("lon"), F.col("zone"), F.col("south"))
    back = moved.withColumns({"east": east, "north": north})
    lat2, lon2 = G.utm_unproject(F.col("east"), F.col("north"), F.col("zone"), F.col("south"))
    return back.select("track", "nav_idx", (G.haversine_m(F.col("lat"), F.col("lon"), lat2, lon2) < 1e-4).alias("exact"))


def _unproject_sql() -> str:
    """Pixels of a raster in zone 44 north, turned a little, to degrees by the inverse series."""
    n = G.FLATTENING / (2 - G.FLATTENING)
    scale = 0.9996 * (G.SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64))
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
    up = " - ".join(["xi", *(f"{b!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, b in enumerate(beta, start=1))])
    side = " - ".join(["eta", *(f"{b!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, b in enumerate(beta, start=1))])
    phi = " + ".join(["chi", *(f"{d!r}::DOUBLE * sin({2 * j} * chi)" for j, d in enumerate(delta, start=1))])
    nano = "floor(({}) * 1e8 + 0.5) / 1e8"
    return f"""WITH grid AS (SELECT p_partkey AS id, 0.25::DOUBLE * (p_partkey % 4000) + 0.01::DOUBLE * p_size + 423000.5::DOUBLE AS x, 0.01::DOUBLE * (p_partkey % 4000) - 0.25::DOUBLE * p_size + 1426000.25::DOUBLE AS y FROM part
    ), s AS (SELECT id, y / {scale!r}::DOUBLE AS xi, (x - 500000.0) / {scale!r}::DOUBLE AS eta FROM grid), t AS (SELECT id, {up} AS up, {side} AS side FROM s), c AS (SELECT *, asin(sin(up) / cosh(side)) AS chi FROM t)
    SELECT id, {nano.format(f"degrees({phi})")} AS latitude, {nano.format("81 + degrees(atan2(sinh(side), cos(up)))")} AS longitude, {micro_sql("sqrt(0.25::DOUBLE * 0.25 + 0.01::DOUBLE * 0.01)")} AS pixel_m, 'HIGH' AS confidence FROM c"""


@query(_unproject_sql())
def crs_to_wgs84(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC9, SC10, SC11: pixels of a georeferenced raster in a projected system to degrees on WGS84, with the uncertainty of its resolution."""
    georef = F.struct(F.array(*map(F.lit, (0.25, 0.01, 423000.5, 0.01, -0.25, 1426000.25))).alias("affine"), F.lit(32644).alias("epsg"))
    pixels = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 4000).alias("x"), F.col("p_size").alias("y"))
    fix = pixels.select("id", G.locate(F.col("x"), F.col("y"), georef, F.lit(64), F.lit(4000)).alias("fix"))
    nano = lambda c: F.floor(F.col(c) * 1e8 + 0.5) / 1e8
    return fix.select("id", nano("fix.latitude").alias("latitude"), nano("fix.longitude").alias("longitude"), micro(F.col("fix.pixel_size_m")).alias("pixel_m"), "fix.confidence")


@query(
    f"""SELECT p_partkey AS id, {micro_sql("0.001::DOUBLE * p_size + 80.0 - 10 * 0.001::DOUBLE")} AS lon, {micro_sql("-0.0005::DOUBLE * (p_partkey % 100) + (13.0 + 20 * 0.0005::DOUBLE)")} AS lat,
    {micro_sql("0.001::DOUBLE * 111320.0 * cos(radians(-0.0005::DOUBLE * (p_partkey % 100) + (13.0 + 20 * 0.0005::DOUBLE)))")} AS pixel_m FROM part"""
)
def affine_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC9, SC11: pixels of a georeferenced raster to degrees, and its pixel size there."""
    a = G.affine_from_tiepoint((0.001, 0.0005), (10.0, 20.0, 0.0, 80.0, 13.0, 0.0))
    lon, lat = G.affine(F.col("p_size"), F.col("p_partkey") % 100, a)
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), micro(lon).alias("lon"), micro(lat).alias("lat"), micro(G.pixel_size_m(a, lat)).alias("pixel_m"))


@query(
    f"""SELECT c_custkey AS ping, {micro_sql("12.9 + c_custkey * 0.15::DOUBLE * cos(radians(22.0::DOUBLE)) / 111320")} AS lat,
    {micro_sql("80.3 + c_custkey * 0.15::DOUBLE * sin(radians(22.0::DOUBLE)) / (111320 * cos(radians(12.9::DOUBLE)))")} AS lon, 22.0::DOUBLE AS heading FROM customer"""
)
def straight_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEN1: a straight synthetic track of 0.15 m a ping, one ping for each customer."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ping"))
    away = F.col("ping") * 0.15
    course = F.radians(F.lit(22.0))
    return c.select("ping", micro(12.9 + away * F.cos(course) / 111320).alias("lat"), micro(80.3 + away * F.sin(course) / (F.lit(111320) * F.cos(F.radians(F.lit(12.9))))).alias("lon"), F.lit(22.0).alias("heading"))
