"""Sinks. Each writes with all tasks; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.operators.reports import CSV_COLUMNS, feature_collection, flat, geojson_features, report_document


def write_csv(records: DataFrame, path: str) -> None:
    """The flat table with a header line."""
    flat(records).select(*CSV_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def write_geojson(records: DataFrame, path: str) -> int:
    """A GeoJSON FeatureCollection over the files of ``path`` in their order; returns how many hazards have no position and were left out."""
    feature_collection(records).write.mode("overwrite").text(path)
    return geojson_features(records)[1].first()["skipped"]


def write_report(records: DataFrame, path: str, survey: dict, provenance: dict, version: str, utc: str) -> None:
    """The nested report as one JSON document over the files of ``path`` in their order."""
    report_document(records, survey, provenance, version, utc).write.mode("overwrite").text(path)


def append_registry(rows: DataFrame, path: str) -> None:
    """Adds rows to a registry of JSON lines, whose columns may differ from run to run."""
    rows.write.mode("append").json(path)


def write_splits(frames: DataFrame, path: str, labels: DataFrame | None = None) -> None:
    """A data set in a folder for each split, and ``manifest``: frames of each split, with and without labels, and its objects of each class.

    ``labels`` are rows ``frame, cls``; without them every frame counts as negative.
    """
    frames.write.mode("overwrite").partitionBy("split").parquet(f"{path}/data")
    split_manifest(frames, labels).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")  # one row a split


def split_manifest(frames: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``split, frames, positive_frames, negative_frames, total_objects, objects`` (a map of class to number)."""
    members = frames.select("frame", "split").distinct()
    total = members.groupBy("split").agg(F.count(F.lit(1)).alias("frames"))
    if labels is None:
        none = F.lit(0).cast("long")
        return total.select("split", "frames", none.alias("positive_frames"), F.col("frames").alias("negative_frames"), none.alias("total_objects"), F.create_map().cast("map<string, long>").alias("objects"))
    held = labels.join(members, "frame")
    positive = held.select("split", "frame").distinct().groupBy("split").agg(F.count(F.lit(1)).alias("positive_frames"))
    classes = held.groupBy("split", F.col("cls").cast("string").alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    objects = classes.groupBy("split").agg(F.sum("n").alias("total_objects"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("cls", "n")))).alias("objects"))
    joined = total.join(positive, "split", "left").join(objects, "split", "left").na.fill(0, ["positive_frames", "total_objects"])
    return joined.select("split", "frames", "positive_frames", (F.col("frames") - F.col("positive_frames")).alias("negative_frames"), "total_objects", F.coalesce("objects", F.create_map().cast("map<string, long>")).alias("objects"))


#: What a scenario says of its navigation. Fixed values of the format.
SYNTHETIC_NAVIGATION = "SYNTHETIC - see navigation.csv header"
NO_NAVIGATION = "none - geolocation will report UNAVAILABLE"


def scenarios(frames: DataFrame, info: DataFrame) -> DataFrame:
    """``scenario, value``: a JSON description of each scenario from its frames (``scenario, frame``) and what ``info`` says of it (one row a scenario).

    ``synthetic_navigation`` of ``info`` tells whether a made-up track comes
    with it; every other column goes into the description as it is. A scenario
    is as large as a demonstration, so its frames are one list.
    """
    listed = frames.groupBy("scenario").agg(F.count(F.lit(1)).alias("frame_count"), F.array_sort(F.collect_list("frame")).alias("frames"))
    named = info.join(listed, "scenario", "left").withColumns({"frame_count": F.coalesce("frame_count", F.lit(0)), "frames": F.coalesce("frames", F.array().cast("array<string>"))})
    told = named.withColumn("navigation", F.when(F.col("synthetic_navigation"), SYNTHETIC_NAVIGATION).otherwise(NO_NAVIGATION))
    return told.select("scenario", F.to_json(F.struct(*told.columns)).alias("value"))


def write_scenarios(described: DataFrame, path: str) -> None:
    """A folder for each scenario with its description."""
    described.write.mode("overwrite").partitionBy("scenario").text(path)


def markdown_rows(table: DataFrame) -> DataFrame:
    """``line``: each row as a Markdown table row; missing values are dashes."""
    return table.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in table.columns]), F.lit(" |")).alias("line"))
