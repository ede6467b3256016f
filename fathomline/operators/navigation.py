"""Navigation tracks: cleaning, derived headings and interpolation at image rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.geo import FLATTENING, SEMI_MAJOR, circle, lerp_heading, lerp_known


def with_heading(nav: DataFrame) -> DataFrame:
    """Fills ``heading`` of tracks that have none at all with the course between the neighbouring fixes.

    At the ends the fix itself stands in for the missing neighbour; a single
    fix has course 0. ``heading_derived`` tells such tracks.
    """
    w = Window.partitionBy("track").orderBy("nav_idx")
    whole = Window.partitionBy("track")

    def around(c: str) -> tuple:
        return F.coalesce(F.lead(c).over(w), F.col(c)), F.coalesce(F.lag(c).over(w), F.col(c))

    (lat1, lat0), (lon1, lon0) = around("lat"), around("lon")
    moved = nav.withColumns({"_lat1": lat1, "_lat0": lat0, "_lon1": lon1, "_lon0": lon0, "heading_derived": F.max(F.col("heading").isNotNull()).over(whole) == False})  # noqa: E712
    east = F.radians(F.col("_lon1") - F.col("_lon0")) * F.cos(F.radians((F.col("_lat1") + F.col("_lat0")) / 2))
    course = circle(F.degrees(F.atan2(east, F.radians(F.col("_lat1") - F.col("_lat0")))) + 360)
    return moved.withColumn("heading", F.when(F.col("heading_derived"), course).otherwise(F.col("heading"))).drop("_lat1", "_lat0", "_lon1", "_lon0")


def at_rows(rows: DataFrame, nav: DataFrame, height: int) -> DataFrame:
    """``track, row`` with the interpolated ``lat, lon, heading, altitude``: image rows are spread over the whole track.

    Each fix brings the one after it along, the last itself, so rows meet fixes
    once. Rows are often made by ``explode``, which Spark's estimates of size
    don't see; the joins merge, so neither side is taken for small and sent
    through the driver.
    """
    n = nav.groupBy("track").agg(F.count(F.lit(1)).alias("_n"))
    spread = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("row") / max(height - 1, 1))) * (F.col("_n") - 1)
    placed = rows.join(n.hint("merge"), "track").withColumn("_t", spread).withColumn("_i0", F.floor("_t")).withColumn("_f", F.col("_t") - F.col("_i0"))
    w = Window.partitionBy("track").orderBy("nav_idx")
    last = F.lead("nav_idx").over(w).isNull()
    both = {f"_{c}0": F.col(c) for c in ("lat", "lon", "heading", "altitude")} | {f"_{c}1": F.when(last, F.col(c)).otherwise(F.lead(c).over(w)) for c in ("lat", "lon", "heading", "altitude")}
    fixes = nav.select("track", F.col("nav_idx").cast("long").alias("_i0"), *[v.alias(k) for k, v in both.items()])
    met = placed.join(fixes.hint("merge"), ["track", "_i0"])
    f = F.col("_f")
    line = lambda c: F.col(f"_{c}0") * (1 - f) + F.col(f"_{c}1") * f
    return met.select("track", "row", line("lat").alias("lat"), line("lon").alias("lon"), lerp_heading(F.col("_heading0"), F.col("_heading1"), f).alias("heading"), lerp_known(F.col("_altitude0"), F.col("_altitude1"), f).alias("altitude"))


def describe(nav: DataFrame) -> DataFrame:
    """Fixes of each track, their extent and whether any has an altitude."""
    return nav.groupBy("track").agg(
        F.count(F.lit(1)).alias("pings"), F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"),
        (F.count("altitude") > 0).alias("has_altitude"),
    )


def geodesic_forward(points: DataFrame, lat: Column, lon: Column, azimuth: Column, distance: Column, rounds: int = 5) -> DataFrame:
    """Adds ``lat2, lon2``: where ``distance`` metres from a point along ``azimuth`` lead, by the direct geodesic series.

    Every step is a plain column of a projection of its own, so that it is
    worked out once and the whole is compiled. The iteration for the arc length
    is unrolled; five rounds are exact to far below a millimetre at survey
    distances.
    """
    f, b = FLATTENING, SEMI_MAJOR * (1 - FLATTENING)
    c = lambda name: F.col(f"_g_{name}")
    out = points.withColumns({"_g_u1": F.atan((1 - f) * F.tan(F.radians(lat))), "_g_a1": F.radians(azimuth), "_g_lon": lon, "_g_s": distance})
    out = out.withColumns({"_g_sin_a": F.cos(c("u1")) * F.sin(c("a1")), "_g_sigma1": F.atan2(F.tan(c("u1")), F.cos(c("a1")))})
    out = out.withColumn("_g_cos2", 1 - c("sin_a") * c("sin_a"))
    out = out.withColumn("_g_u2", c("cos2") * ((SEMI_MAJOR**2 - b**2) / b**2))
    u2 = c("u2")
    out = out.withColumns({"_g_big_a": 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2))), "_g_big_b": u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))})
    out = out.withColumn("_g_first", c("s") / (b * c("big_a"))).withColumn("_g_sigma", c("first"))
    for _ in range(rounds):
        out = out.withColumns({"_g_c": F.cos(2 * c("sigma1") + c("sigma")), "_g_sin": F.sin(c("sigma")), "_g_cos": F.cos(c("sigma"))})
        k = c("c")
        last = c("big_b") / 6 * k * (F.pow(c("sin"), F.lit(2)) * 4 - 3) * (k * k * 4 - 3)
        out = out.withColumn("_g_sigma", c("first") + c("big_b") * c("sin") * (k + c("big_b") / 4 * (c("cos") * (k * k * 2 - 1) - last)))
    out = out.withColumns({"_g_c": F.cos(2 * c("sigma1") + c("sigma")), "_g_sin": F.sin(c("sigma")), "_g_cos": F.cos(c("sigma")), "_g_su": F.sin(c("u1")), "_g_cu": F.cos(c("u1")), "_g_ca": F.cos(c("a1"))})
    out = out.withColumns({"_g_across": c("su") * c("sin") - c("cu") * c("cos") * c("ca"), "_g_k": f / 16 * c("cos2") * (4 + f * (4 - 3 * c("cos2")))})
    lat2 = F.atan2(c("su") * c("cos") + c("cu") * c("sin") * c("ca"), (1 - f) * F.sqrt(c("sin_a") * c("sin_a") + c("across") * c("across")))
    swung = F.atan2(c("sin") * F.sin(c("a1")), c("cu") * c("cos") - c("su") * c("sin") * c("ca"))
    swing = swung - (1 - c("k")) * f * c("sin_a") * (c("sigma") + c("k") * c("sin") * (c("c") + c("k") * c("cos") * (c("c") * c("c") * 2 - 1)))
    out = out.withColumns({"lat2": F.degrees(lat2), "lon2": c("lon") + F.degrees(swing)})
    return out.drop(*[n for n in out.columns if n.startswith("_g_")])
