"""Small JSON files beside the data: fitted filters and calibrators, what a model was trained on, experiments.

All paths are Spark's, so that a shared or remote folder works; models are a
few numbers and are read on the driver.
"""

from __future__ import annotations

import json
from dataclasses import asdict
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.confidence import LinearFilter, Platt, RuleFilter


def _text(spark: SparkSession, path: str) -> str | None:
    """The text at ``path``, a file or a folder of one; None if nothing is there."""
    try:
        row = spark.read.text(path, wholetext=True).first()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return row["value"] if row else None


def _save(spark: SparkSession, path: str, content: dict[str, Any]) -> None:
    spark.range(1).select(F.lit(json.dumps(content)).alias("value")).write.mode("overwrite").text(path)


def save_filter(spark: SparkSession, model: LinearFilter, path: str) -> None:
    _save(spark, path, {"kind": "linear", "fitted": True, "threshold": model.threshold, "weights": dict(model.weights), "bias": model.bias, "mean": dict(model.mean), "sd": dict(model.sd)})


def load_filter(spark: SparkSession, path: str) -> LinearFilter | RuleFilter:
    """The filter at ``path``, or the rule filter if there is none or it was not fitted. A broken file is an error."""
    text = _text(spark, path)
    found = json.loads(text) if text else {}
    if not found.get("fitted"):
        return RuleFilter()
    return LinearFilter(found["weights"], found["mean"], found["sd"], found["bias"], found.get("threshold", 0.5))


def save_calibrator(spark: SparkSession, model: Platt, path: str) -> None:
    _save(spark, path, {"kind": "platt", **asdict(model)})


def load_calibrator(spark: SparkSession, path: str) -> Platt:
    """The calibrator at ``path``, or one that leaves scores as they are if there is none or it was not fitted."""
    text = _text(spark, path)
    found = json.loads(text) if text else {}
    return Platt(found["a"], found["b"], True) if found.get("fitted") else Platt()


def _card_path(weights: str) -> str:
    folder, _, name = weights.rpartition("/")
    card = f"{name.rpartition('.')[0] or name}.meta.json"
    return f"{folder}/{card}" if folder else card


def save_model_card(spark: SparkSession, weights: str, content: dict[str, Any]) -> None:
    """Writes what a model was trained on beside its weights."""
    _save(spark, _card_path(weights), content)


def read_model_card(spark: SparkSession, weights: str) -> dict[str, Any]:
    """What is known of a model: the ``.meta.json`` beside its weights, or the profile "none", marked as assumed, if that is missing or broken."""
    path = _card_path(weights)
    text = _text(spark, path)
    try:
        return {**json.loads(text or ""), "_source": path}
    except json.JSONDecodeError:
        return {"preprocess_profile": "none", "_source": None, "_assumed": True}


def read_experiments(spark: SparkSession, path: str) -> DataFrame | None:
    """Experiments as JSON lines; blank lines don't count; None if there is no file."""
    try:
        return spark.read.json(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
