"""Queries on parsers and sinks: text that Spark derives from the tables is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.numbers import micro
from fathomline.plans.registry import query
from fathomline.plans.views import micro_sql, read
from fathomline.sources import readers as R
from fathomline.sources import writers as W


@query(
    f"""WITH t AS (SELECT l_orderkey AS frame, l_linenumber AS cls, l_discount * 5 AS cx, l_tax * 6 AS cy, l_quantity / 100 AS w, l_quantity / 200 AS h FROM lineitem WHERE l_partkey % 10 <> 0)
    SELECT frame::VARCHAR AS frame, cls, {micro_sql("(cx - w / 2) * 416")} AS x0, {micro_sql("(cy - h / 2) * 320")} AS y0, {micro_sql("(cx + w / 2) * 416")} AS x1, {micro_sql("(cy + h / 2) * 320")} AS y1 FROM t"""
)
def yolo_text_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC6, DQ2: label lines; every tenth part's line is broken and goes."""
    line = read(spark, sf_dir, "lineitem")
    fields = [F.col("l_linenumber"), F.col("l_discount") * 5, F.col("l_tax") * 6, F.col("l_quantity") / 100, F.col("l_quantity") / 200]
    value = F.when(F.col("l_partkey") % 10 != 0, F.concat_ws(" ", *[f.cast("string") for f in fields])).otherwise("broken line")
    text = line.select(F.concat(F.lit("/labels/"), F.col("l_orderkey").cast("string"), F.lit(".txt")).alias("path"), value.alias("value"))
    return R.yolo_labels(text, 416, 320).withColumns({c: micro(F.col(c)) for c in ("x0", "y0", "x1", "y1")})


@query(f"SELECT 'frame-' || l_orderkey || '.jpg' AS file_name, l_returnflag AS category, l_quantity AS x0, l_tax AS y0, {micro_sql('l_quantity + 7.5')} AS x1, {micro_sql('l_tax + l_discount')} AS y1 FROM lineitem")
def jsonl_boxes_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC5: box lists in JSON lines."""
    line = read(spark, sf_dir, "lineitem")
    box = F.array(F.array(F.col("l_quantity"), F.col("l_tax"), F.lit(7.5), F.col("l_discount")))
    objects = F.struct(box.alias("bbox"), F.array("l_returnflag").alias("categories"))
    text = line.select(F.to_json(F.struct(F.concat(F.lit("frame-"), F.col("l_orderkey").cast("string"), F.lit(".jpg")).alias("file_name"), objects.alias("objects"))).alias("value"))
    return R.jsonl_boxes(text).select("file_name", "category", "x0", "y0", micro(F.col("x1")).alias("x1"), micro(F.col("y1")).alias("y1"))


@query("SELECT event_id::DOUBLE AS ping, (12.5 + user_id)::DOUBLE AS latitude, (80.25 + event_id)::DOUBLE AS longitude, CASE WHEN event_id % 5 <> 0 THEN user_id::DOUBLE END AS heading FROM events WHERE event_id % 9 <> 0")
def nav_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC7, ST1, ST8, MP2: navigation lines; banners, and lines without coordinates, go."""
    e = read(spark, sf_dir, "events")
    heading = F.when(F.col("event_id") % 5 != 0, F.col("user_id").cast("string")).otherwise("n/a")
    lat = F.when(F.col("event_id") % 9 != 0, (F.col("user_id") + 12.5).cast("string")).otherwise("lost")
    value = F.concat_ws(",", F.col("event_id").cast("string"), lat, (F.col("event_id") + 80.25).cast("string"), heading)
    banner = e.filter("event_id % 100 = 0").select(F.lit("nav.csv").alias("path"), F.lit("# survey export").alias("value"))
    text = e.select(F.lit("nav.csv").alias("path"), value.alias("value")).unionByName(banner)
    return R.nav_table(text, "Ping, Lat ,LON,Heading").select("ping", "latitude", "longitude", "heading")


@query("SELECT l_orderkey AS frame, l_linenumber::BIGINT AS n, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 0 END::BIGINT AS class_id FROM lineitem")
def class_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST9: class names to numbers, with digits and 0 to fall back on."""
    line = read(spark, sf_dir, "lineitem")
    return line.select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").cast("long").alias("n"), R.class_id(F.col("l_returnflag"), ["A", "N"]).alias("class_id"))


@query("SELECT '| ' || n_name || ' | ' || n_regionkey || ' | ' || coalesce(nullif(n_nationkey, 3)::VARCHAR, '-') || ' |' AS line FROM nation")
def markdown_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK9: rows of a Markdown table."""
    n = read(spark, sf_dir, "nation")
    return W.markdown_rows(n.select("n_name", "n_regionkey", F.when(F.col("n_nationkey") != 3, F.col("n_nationkey")).alias("k")))


@query("SELECT l_orderkey AS frame, CASE l_returnflag WHEN 'A' THEN 'MILCO' WHEN 'N' THEN 'NOMBO' ELSE 'UNMAPPED_R' END AS name, CASE l_returnflag WHEN 'A' THEN 'MAN_MADE' ELSE 'AMBIGUOUS' END AS level1, count(*) AS n FROM lineitem GROUP BY ALL")
def taxonomy_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC8, PRJ4: classes by a small table; unknown ones are unmapped."""
    from fathomline.operators.reports import translate
    from fathomline.plans.register import TAXONOMY

    parts = translate(F.col("l_returnflag"), TAXONOMY)
    line = read(spark, sf_dir, "lineitem")
    return line.groupBy(F.col("l_orderkey").alias("frame"), parts["detector_class"].alias("name"), parts["level1"].alias("level1")).agg(F.count(F.lit(1)).alias("n"))
