"""Hazard records and their outputs."""

from __future__ import annotations

import json
import platform
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions import confidence as C
from fathomline.functions import geo as G
from fathomline.functions import priority as P
from fathomline.functions.numbers import ratio

#: The columns of the flat table, in the order that its readers expect. Fixed values of the format.
CSV_COLUMNS = [
    "hazard_id", "survey_id", "detector_class", "level1", "level2",
    "confidence_pct", "confidence_band", "calibrated", "raw_detector_score",
    "priority_score", "priority_band",
    "latitude", "longitude", "utm_easting", "utm_northing", "utm_zone",
    "geolocation_method", "geolocation_confidence", "geoloc_uncertainty_m",
    "estimated_length_m", "estimated_width_m", "ground_sample_distance_m",
    "bbox_x0", "bbox_y0", "bbox_x1", "bbox_y1",
    "observation_count", "association_mode", "frame_ids", "ping_id", "timestamp_utc",
    "frame_quality_score", "fp_filter_verdict",
    "evidence_model", "evidence_shadow", "evidence_texture",
    "evidence_persistence", "evidence_data_quality", "notes",
]

#: Sentences of the report. Fixed values.
NO_POSITION = "Geolocation unavailable: no navigation metadata or georeferencing for this survey. No position estimated."
NOT_CALIBRATED = "Confidence is a RAW detector score, not a calibrated probability (no calibration fitted for this model)."
NO_SIZE = "Physical dimensions unavailable: ground sample distance unknown. Bounding box is reported in pixels only."


def translate(cls: Column, taxonomy: Mapping[str, tuple[str, str, str]]) -> dict[str, Column]:
    """``detector_class, level1, level2`` of a class by a small table; a class that is not in it is unmapped and ambiguous."""

    def look(k: int, other: Column) -> Column:
        if not taxonomy:
            return other
        table = F.create_map(*[F.lit(x) for c, row in taxonomy.items() for x in (c, row[k])])
        return F.coalesce(F.element_at(table, cls), other)

    return {"detector_class": look(0, F.concat(F.lit("UNMAPPED_"), cls.cast("string"))), "level1": look(1, F.lit("AMBIGUOUS")), "level2": look(2, F.lit("unknown_anomaly"))}


def hazard_records(hazards: DataFrame, taxonomy: Mapping[str, tuple[str, str, str]], quality: float | None = None, calibrated: bool = False, gsd: float | None = None, survey_id: str = "SURVEY-1", mode: str = "geographic") -> DataFrame:
    """Records of numbered clusters: class, confidence, priority, position, size, evidence and notes.

    Quality, calibration, raw score, verdict, evidence and the method of the
    fix are those of the best member where the observations bring them (see
    ``dedup.EVIDENCE``), else what is given here. What the inputs can't tell is
    null: sizes without a ground sample distance, positions without a fix. A
    frame of unknown quality counts as one of quality 0 for the priority.
    """
    brought = hazards.schema["best"].dataType.names

    def of_best(name: str, other: Column) -> Column:
        return F.coalesce(F.col(f"best.{name}"), other) if name in brought else other

    missing = F.lit(None).cast("double")
    length = F.greatest("width_px", "height_px") * gsd if gsd else missing
    width = F.least("width_px", "height_px") * gsd if gsd else missing
    percent = 100 * F.col("best_confidence")
    located = F.col("lat").isNotNull()
    seen, is_calibrated = of_best("quality", F.lit(quality).cast("double")), of_best("calibrated", F.lit(calibrated))
    named = hazards.withColumns(translate(F.col("best.cls"), taxonomy))
    priority = P.score(percent, F.col("level2"), length, F.col("observation_count"), F.coalesce(seen, F.lit(0.0)), located, F.col("unc"))
    notes = F.array_compact(F.array(F.when(~located, F.lit(NO_POSITION)), F.when(~is_calibrated, F.lit(NOT_CALIBRATED)), F.lit(None if gsd else NO_SIZE)))
    raw = of_best("raw", F.col("best_confidence"))
    evidence = F.struct(
        raw.alias("model"), of_best("shadow_ratio", missing).alias("shadow"), of_best("texture_homogeneity", missing).alias("texture"), F.least(F.lit(1.0), F.col("observation_count") / 8).alias("persistence"), seen.alias("data_quality")
    )
    out = named.select(
        "hazard_id", F.lit(survey_id).alias("survey_id"), "detector_class", "level1", "level2", percent.alias("confidence_pct"), C.confidence_band(percent).alias("confidence_band"), is_calibrated.alias("calibrated"),
        raw.alias("raw_detector_score"), priority.alias("priority_score"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
        F.when(located, of_best("method", F.lit("navigation_pingwise"))).otherwise("none").alias("geolocation_method"), F.when(located, G.uncertainty_band(F.col("unc"))).otherwise("UNAVAILABLE").alias("geolocation_confidence"),
        F.col("unc").alias("geoloc_uncertainty_m"), length.alias("estimated_length_m"), width.alias("estimated_width_m"), F.lit(gsd).cast("double").alias("ground_sample_distance_m"),
        *[F.col(f"best.{c}").alias(f"bbox_{c}") for c in ("x0", "y0", "x1", "y1")], "observation_count", F.lit(mode).alias("association_mode"), "frames", seen.alias("frame_quality_score"),
        of_best("reason", F.lit("")).alias("fp_filter_verdict"), evidence.alias("evidence"), notes.alias("notes"),
    )
    return out.withColumn("priority_band", P.band(F.col("priority_score")))


def with_utm(records: DataFrame) -> DataFrame:
    """Adds projected coordinates of one zone, that of the mean position of all located records; null without a position."""
    mean = records.filter("latitude is not null").agg(F.avg("latitude").alias("_lat"), F.avg("longitude").alias("_lon"))
    joined = records.crossJoin(F.broadcast(mean))  # one row
    zone, south = G.utm_zone(F.col("_lon")), F.col("_lat") < 0
    east, north = G.utm_project(F.col("latitude"), F.col("longitude"), zone, south)
    name = F.when(F.col("latitude").isNotNull(), F.concat(zone.cast("string"), F.when(south, "S").otherwise("N")))
    return joined.withColumn("utm_easting", east).withColumn("utm_northing", north).withColumn("utm_zone", name).drop("_lat", "_lon")


def flat(records: DataFrame) -> DataFrame:
    """The flat table: CSV_COLUMNS as text, lists joined, missing values empty."""
    parts = {
        "frame_ids": F.array_join(F.array_sort(F.transform("frames", lambda f: f.cast("string"))), ";"), "notes": F.array_join("notes", " | "), "evidence_model": F.col("evidence.model"),
        "evidence_shadow": F.col("evidence.shadow"), "evidence_texture": F.col("evidence.texture"), "evidence_persistence": F.col("evidence.persistence"), "evidence_data_quality": F.col("evidence.data_quality"),
    }
    have = set(records.columns)
    value = {c: parts.get(c, F.col(c) if c in have else F.lit(None)) for c in CSV_COLUMNS}
    return records.select(*[F.coalesce(v.cast("string"), F.lit("")).alias(c) for c, v in value.items()])


def geojson_features(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``feature`` texts of the located records, and one row with how many were left out (``skipped``)."""
    located = records.filter("latitude is not null and longitude is not null")
    properties = F.struct(*[c for c in records.columns if not c.startswith("bbox_")])
    geometry = F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates"))
    lines = located.select("hazard_id", F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))).alias("feature"))
    return lines, records.agg(F.count_if(F.col("latitude").isNull() | F.col("longitude").isNull()).alias("skipped"))


def framed(bodies: DataFrame, order: str, body: str, head: Column, tail: str) -> DataFrame:
    """``line``: one JSON document over many lines: ``head``, then each body with a comma but for the first, then ``tail``.

    Lines are dealt by ranges of ``order`` and sorted inside them, so files
    written from them, read one after the other, are the document; nothing
    gathers it in one task.
    """
    spark = bodies.sparkSession
    first = bodies.agg(F.min(order).alias("first"))
    middle = bodies.crossJoin(F.broadcast(first)).select(F.lit(1).alias("k"), F.col(order).cast("string").alias("o"), F.concat(F.when(F.col(order) == F.col("first"), "").otherwise(","), F.col(body)).alias("line"))  # one row
    ends = spark.range(1).select(F.lit(0).alias("k"), F.lit("").alias("o"), head.alias("line")).unionByName(spark.range(1).select(F.lit(2).alias("k"), F.lit("").alias("o"), F.lit(tail).alias("line")))
    return middle.unionByName(ends).repartitionByRange("k", "o").sortWithinPartitions("k", "o").select("line")


def feature_collection(records: DataFrame) -> DataFrame:
    """``line``: a GeoJSON FeatureCollection over many lines, with how many hazards have no position and were left out."""
    lines, skipped = geojson_features(records)
    head = F.concat(F.lit('{"type":"FeatureCollection","omitted_without_position":'), F.lit(skipped.first()["skipped"]).cast("string"), F.lit(',"features":['))
    return framed(lines, "hazard_id", "feature", head, "]}")


def summary(records: DataFrame, observations: DataFrame, frames: DataFrame | None = None, verdicts: DataFrame | None = None) -> DataFrame:
    """The survey's figures in one row.

    ``observations`` is a one-row count. ``frames`` (``quality_score``, one row
    a frame) and ``verdicts`` (``accepted``, one row a candidate) give the
    figures of quality control and of the filter where they are known.
    """
    own = records.agg(
        F.count(F.lit(1)).alias("unique_hazards"), F.count_if(F.col("level1") == "MAN_MADE").alias("man_made_hazards"), F.count_if(F.col("level1") == "AMBIGUOUS").alias("ambiguous_hazards"),
        F.count_if(F.col("confidence_band").isin("HIGH", "CRITICAL")).alias("high_confidence_hazards"), F.count_if(F.col("priority_band").isin("HIGH", "URGENT")).alias("high_priority_hazards"),
        F.count("latitude").alias("geolocated_hazards"), F.avg("latitude").alias("centre_lat"), F.avg("longitude").alias("centre_lon"),
    )
    out = observations.crossJoin(own).withColumn("deduplication_ratio", ratio(F.col("observations"), F.col("unique_hazards")))
    if frames is not None:
        out = out.crossJoin(frames.agg(F.count(F.lit(1)).alias("frames_processed"), F.coalesce(F.avg("quality_score"), F.lit(0.0)).alias("mean_frame_quality")))
    if verdicts is not None:
        raw = verdicts.agg(F.count(F.lit(1)).alias("candidate_detections_raw"), F.count_if("accepted").alias("detections_accepted"), F.count_if(~F.col("accepted")).alias("detections_rejected"))
        out = out.crossJoin(raw.withColumn("rejection_rate", ratio(F.col("detections_rejected"), F.col("candidate_detections_raw"))))
    return out


#: What the report says of its figures. Fixed value.
DISCLAIMER = (
    "Confidence values are produced by an automated detector. Where 'calibrated' is false they are RAW detector scores and must not be read as probabilities. Coordinates carry an uncertainty in metres; "
    "hazards without a position fix are reported with null coordinates rather than an estimated position."
)


def report_head(survey: Mapping, provenance: Mapping, version: str, utc: str) -> str:
    """The report up to its hazards: what made it and when, the survey's figures and where they come from."""
    host = {"platform": platform.platform(), "machine": platform.machine()}
    made = {"generator": {"version": version, "generated_utc": utc, "host": host}, "survey": dict(survey), "provenance": dict(provenance), "disclaimer": DISCLAIMER}
    return json.dumps(made, default=str)[:-1] + ', "hazards": ['


def report_document(records: DataFrame, survey: Mapping, provenance: Mapping, version: str, utc: str) -> DataFrame:
    """``line``: the nested report as one JSON document over many lines, hazards in the order of their identifiers.

    ``survey`` has the identifier and the figures of ``summary`` (one row, so it
    is given as a mapping); a register of any size is written by all tasks.
    """
    bodies = records.select("hazard_id", F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}).alias("body"))
    return framed(bodies, "hazard_id", "body", F.lit(report_head(survey, provenance, version, utc)), "]}")
