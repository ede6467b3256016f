import json

from pyspark.sql import functions as F

from fathomline.functions.confidence import LinearFilter, Platt, RuleFilter
from fathomline.functions.numbers import feature_map
from fathomline.operators import frames as K
from fathomline.operators.matching import better_cell
from fathomline.operators.store import undeclared_navigation
from fathomline.sources import models


def test_filters_and_calibrators_come_back(spark, tmp_path):
    linear = LinearFilter({"snr": 0.5, "aspect": -0.25}, {"snr": 1.0, "aspect": 2.0}, {"snr": 1.5, "aspect": 1.0}, 0.1, 0.6)
    models.save_filter(spark, linear, f"{tmp_path}/filter")
    assert models.load_filter(spark, f"{tmp_path}/filter") == linear
    models.save_calibrator(spark, Platt(0.8, -0.3, True), f"{tmp_path}/platt")
    assert models.load_calibrator(spark, f"{tmp_path}/platt") == Platt(0.8, -0.3, True)
    models.save_calibrator(spark, Platt(), f"{tmp_path}/raw")
    assert models.load_calibrator(spark, f"{tmp_path}/raw") == Platt()


def test_missing_models_fall_back(spark, tmp_path):
    assert models.load_filter(spark, f"{tmp_path}/none") == RuleFilter()
    assert models.load_calibrator(spark, f"{tmp_path}/none") == Platt()
    assert models.read_experiments(spark, f"{tmp_path}/none") is None
    (tmp_path / "unfitted").write_text('{"fitted": false}')
    assert models.load_filter(spark, f"{tmp_path}/unfitted") == RuleFilter()


def test_model_cards(spark, tmp_path):
    (tmp_path / "a.meta.json").write_text(json.dumps({"preprocess_profile": "standard"}, indent=2))
    (tmp_path / "b.meta.json").write_text("{broken")
    assert models.read_model_card(spark, f"{tmp_path}/a.pt")["preprocess_profile"] == "standard"
    for name in ("b", "c"):
        card = models.read_model_card(spark, f"{tmp_path}/{name}.pt")
        assert card["preprocess_profile"] == "none" and card["_assumed"] is True


def test_experiments(spark, tmp_path):
    (tmp_path / "registry.jsonl").write_text('{"name": "a", "f1": 0.5}\n\n{"name": "b", "f1": 0.25}\n')
    assert {r["name"]: r["f1"] for r in models.read_experiments(spark, f"{tmp_path}/registry.jsonl").collect()} == {"a": 0.5, "b": 0.25}


def test_feature_maps_have_no_holes(spark):
    row = spark.createDataFrame([(1.23456, float("nan"), float("-inf"), None)], "a double, b double, c double, d double").select(feature_map("a", "b", "c", "d").alias("m")).first()
    assert row["m"] == {"a": 1.2346, "b": 0.0, "c": 0.0, "d": 0.0}


def test_undeclared_navigation(spark):
    rows = [(1, "none", "CC0", None, None), (2, None, "CC0", True, None), (3, "x", None, True, None), (4, "x", "y", None, "# synthetic"), (5, "x", "y", True, "ping,lat"), (6, "x", "y", True, "# Synthetic track"), (7, "x", "y", True, " " * 400 + "synthetic")]
    found = undeclared_navigation(spark.createDataFrame(rows, "scenario int, navigation string, license string, synthetic boolean, track string"))
    assert {r["scenario"]: r["reason"] for r in found.collect()} == {2: "no navigation status", 3: "no license", 4: "not declared synthetic", 5: "track not labelled", 7: "track not labelled"}


def test_better_cell(spark):
    cells = [("raw", "raw", 10, 10, 5), ("preprocessed", "preprocessed", 10, 6, 6), ("raw", "preprocessed", 10, 10, 1)]
    schema = "trained_on string, inference_on string, n_gt int, n_det int, tp int"
    assert better_cell(spark.createDataFrame(cells, schema)).first().asDict() == {"raw_f1": 0.5, "preprocessed_f1": 0.75, "mismatched_f1": 0.1, "better": "preprocessing"}
    assert better_cell(spark.createDataFrame(cells[:1], schema)).first()["better"] == "raw imagery"


def test_target_stats_of_odd_boxes(spark):
    pixels = spark.range(2 * 10 * 10).select((F.col("id") / 100).cast("int").alias("frame"), (F.col("id") / 10 % 10).cast("int").alias("ping"), (F.col("id") % 10).cast("int").alias("bin"), F.lit(0.0).alias("v"))
    pixels = pixels.withColumn("v", F.expr("if(ping = 4 and bin = 4, 1.0, 0.0)"))
    boxes = spark.createDataFrame([(0, 0, 3.9, 3.2, 6.0, 6.0), (0, 1, -5.0, -5.0, 2.0, 2.0), (0, 2, 30.0, 30.0, 40.0, 40.0)], "frame int, idx int, x0 double, y0 double, x1 double, y1 double")
    found = {r["frame"]: r for r in K.target_stats(pixels, boxes).collect()}
    assert found[1].asDict() == {"frame": 1, "n": 0, "area": 0.0, "contrast": 0.0}
    assert found[0]["n"] == 3
    assert abs(found[0]["area"] - (0.09 + 0.04) / 2) < 1e-12
    assert abs(found[0]["contrast"] - ((1 - 0.01) + (0 - 0.01)) / 2) < 1e-12
