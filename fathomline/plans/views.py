"""The survey views that the registered queries work on, derived from the relational test tables.

Each view is a DataFrame function and the same definition as SQL text, for the
twins. Formulas are the same, operation by operation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.functions.geo import circle
from fathomline.operators.images import from_pings


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One box per order line; the price, unique within an order, is index and score."""
    line = read(spark, sf_dir, "lineitem")
    y0 = (F.col("l_partkey") % 20).cast("double")
    return line.select(
        F.col("l_orderkey").alias("frame"), F.col("l_extendedprice").alias("idx"), F.col("l_quantity").alias("x0"), y0.alias("y0"),
        (F.col("l_quantity") + (F.col("l_tax") * 250 + 30)).alias("x1"), (y0 + (F.col("l_discount") * 100 + 20)).alias("y1"),
        (F.col("l_extendedprice") / 105000).alias("score"), F.col("l_returnflag").alias("cls"), (F.col("l_linestatus") == "F").alias("is_det"),
    )


BOXES = """boxes AS (
    SELECT l_orderkey AS frame, l_extendedprice AS idx, l_quantity AS x0, CAST(l_partkey % 20 AS DOUBLE) AS y0,
           l_quantity + (l_tax * 250 + 30) AS x1, CAST(l_partkey % 20 AS DOUBLE) + (l_discount * 100 + 20) AS y1,
           l_extendedprice / 105000 AS score, l_returnflag AS cls, l_linestatus = 'F' AS is_det
    FROM lineitem)"""

INTER = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0.0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0.0)"
AREA = "greatest({0}.x1 - {0}.x0, 0.0) * greatest({0}.y1 - {0}.y0, 0.0)"
AREA_A, AREA_B = AREA.format("a"), AREA.format("b")
IOU = f"({INTER}) / greatest({AREA_A} + {AREA_B} - ({INTER}), 1e-9)"
IOS = f"({INTER}) / greatest(least({AREA_A}, {AREA_B}), 1e-9)"


def micro_sql(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


def nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One track per user, a fix per event; altitude and heading are missing where the data say so."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").withColumn("nav_idx", F.row_number().over(w) - 1)
    return e.select(
        F.col("user_id").alias("track"), "nav_idx", (F.lit(12.9) + F.col("nav_idx") * 1e-5 + F.col("value") * 1e-6).alias("lat"),
        (F.lit(80.3) + (F.col("event_id") % 97) * 1e-5).alias("lon"),
        circle(F.col("value") * 3.6).alias("heading"), F.when(F.col("event_id") % 7 != 0, 8 + F.col("event_id") % 5).cast("double").alias("altitude"),
    )


NAV = """nav AS (
    SELECT user_id AS track, nav_idx, 12.9::DOUBLE + nav_idx * 1e-5::DOUBLE + value * 1e-6::DOUBLE AS lat, 80.3::DOUBLE + (event_id % 97) * 1e-5::DOUBLE AS lon,
           (value * 3.6::DOUBLE) - 360.0::DOUBLE * floor((value * 3.6::DOUBLE) / 360.0::DOUBLE) AS heading,
           CASE WHEN event_id % 7 <> 0 THEN CAST(8 + event_id % 5 AS DOUBLE) END AS altitude
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS nav_idx FROM events))"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One detection for every order line of status F; the order is its frame."""
    line = read(spark, sf_dir, "lineitem").filter("l_linestatus = 'F'")
    return line.select(
        (F.col("l_orderkey") * 200000 + F.col("l_extendedprice")).alias("obs"), F.col("l_returnflag").alias("cls"),
        F.col("l_orderkey").cast("long").alias("frame_index"), (F.lit(12.9) + (F.col("l_partkey") % 100) * 1e-3).alias("lat"),
        (F.lit(80.3) + (F.col("l_suppkey") % 100) * 1e-3 + F.col("l_quantity") * 1e-6).alias("lon"), (F.col("l_tax") * 50 + 5).alias("unc"),
        (F.col("l_extendedprice") / 105000).alias("confidence"), F.col("l_quantity").alias("x0"), (F.col("l_partkey") % 20).cast("double").alias("y0"),
        (F.col("l_quantity") + (F.col("l_tax") * 250 + 30)).alias("x1"), ((F.col("l_partkey") % 20).cast("double") + (F.col("l_discount") * 100 + 20)).alias("y1"),
    )


OBSERVATIONS = """observations AS (
    SELECT l_orderkey * 200000 + l_extendedprice AS obs, l_returnflag AS cls, CAST(l_orderkey AS BIGINT) AS frame_index,
           12.9::DOUBLE + (l_partkey % 100) * 1e-3::DOUBLE AS lat, 80.3::DOUBLE + (l_suppkey % 100) * 1e-3::DOUBLE + l_quantity * 1e-6::DOUBLE AS lon,
           l_tax * 50 + 5 AS unc, l_extendedprice / 105000 AS confidence, l_quantity AS x0, CAST(l_partkey % 20 AS DOUBLE) AS y0,
           l_quantity + (l_tax * 250 + 30) AS x1, CAST(l_partkey % 20 AS DOUBLE) + (l_discount * 100 + 20) AS y1
    FROM lineitem WHERE l_linestatus = 'F')"""

HAVERSINE = """2 * 6371008.8::DOUBLE * asin(least(1.0::DOUBLE, sqrt(power(sin((radians(b.lat) - radians(a.lat)) / 2), 2)
    + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2))))"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten features and a raw score for each order line; the line status is the label."""
    line = read(spark, sf_dir, "lineitem")
    return line.select(
        (F.col("l_orderkey") * 200000 + F.col("l_extendedprice")).alias("id"), (F.col("l_extendedprice") / 105000).alias("raw"),
        (F.col("l_discount") * 10).alias("contrast"), (F.col("l_tax") * 2).alias("shadow"), (F.col("l_quantity") / 10).alias("snr"),
        (F.col("l_partkey") % 15).cast("double").alias("aspect"), ((F.col("l_suppkey") % 10) / 10).alias("compactness"), (F.col("l_linenumber") / 7).alias("size_rank"),
        (F.col("l_linestatus") == "F").cast("int").alias("label"),
    )


CANDIDATES = """candidates AS (
    SELECT l_orderkey * 200000 + l_extendedprice AS id, l_extendedprice / 105000 AS raw, l_discount * 10 AS contrast, l_tax * 2 AS shadow, l_quantity / 10 AS snr,
           CAST(l_partkey % 15 AS DOUBLE) AS aspect, (l_suppkey % 10) / 10 AS compactness, l_linenumber / 7 AS size_rank, CAST(l_linestatus = 'F' AS INTEGER) AS label
    FROM lineitem)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select("doc_id", F.least(F.col("n_chars") / 35000, F.lit(1.0)).alias("score"), F.col("quality").alias("label"))


SCORED = "scored AS (SELECT doc_id, least(n_chars / 35000, 1.0::DOUBLE) AS score, quality AS label FROM documents JOIN labels USING (doc_id))"


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``frame, ping, bin, v``: the vectors as sonar rows of 64 samples, 50 to a frame.

    Even frames get a dark band at bins 27 to 36 with a bright line at 32, and
    every third frame loses ping 30.
    """
    e = read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("frame"), (F.col("vec_id") % 50).alias("ping"), F.posexplode("embedding").alias("bin", "e"))
    v = (F.col("e").cast("double") + 0.6) / 1.2
    dark = (F.col("frame") % 2 == 0) & F.col("bin").between(27, 36) & (F.col("bin") != 32)
    dead = (F.col("frame") % 3 == 0) & (F.col("ping") == 30)
    return e.select("frame", "ping", "bin", F.when(dead, 0.0).when(dark, v * 0.05).otherwise(v).alias("v"))


def frame_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames of ``pings`` as one row each: ``frame, height, width, pixels``."""
    v = lambda e: (e.cast("double") + 0.6) / 1.2
    frame, ping = F.floor(F.col("vec_id") / 50), F.col("vec_id") % 50
    dark = lambda b: (frame % 2 == 0) & b.between(27, 36) & (b != 32)
    dead = (frame % 3 == 0) & (ping == 30)
    samples = F.transform("embedding", lambda e, b: F.when(dead, 0.0).when(dark(b), v(e) * 0.05).otherwise(v(e)))
    return from_pings(read(spark, sf_dir, "embeddings").select(frame.alias("frame"), ping.alias("ping"), samples.alias("samples")))


PINGS = """raw AS (
    SELECT CAST(floor(vec_id / 50) AS BIGINT) AS frame, vec_id % 50 AS ping, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS bin, unnest(embedding)::DOUBLE AS e FROM embeddings
), pings AS (
    SELECT frame, ping, bin, CASE WHEN frame % 3 = 0 AND ping = 30 THEN 0.0::DOUBLE
        WHEN frame % 2 = 0 AND bin BETWEEN 27 AND 36 AND bin <> 32 THEN (e + 0.6::DOUBLE) / 1.2::DOUBLE * 0.05::DOUBLE ELSE (e + 0.6::DOUBLE) / 1.2::DOUBLE END AS v
    FROM raw)"""
