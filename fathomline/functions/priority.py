"""Priority of a hazard as column expressions."""

from __future__ import annotations

from dataclasses import astuple, dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomline.functions.numbers import clip

#: Relative harm of each class; others count as OTHER_HARM. Fixed values of the priority rule.
CLASS_HARM = {
    "ghost_fishing_gear": 1.00,
    "shipwreck_structure": 0.70,
    "pipe_cylinder": 0.65,
    "mine_like_object": 0.85,
    "other_man_made": 0.55,
    "unknown_anomaly": 0.40,
    "bottom_object_uncertain": 0.30,
}
OTHER_HARM = 0.4


@dataclass(frozen=True)
class Weights:
    """How much each factor counts. The defaults are fixed values of the priority rule."""

    confidence: float = 0.35
    hazard_class: float = 0.25
    size: float = 0.15
    persistence: float = 0.15
    actionability: float = 0.10


def harm(level2: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in CLASS_HARM.items() for x in pair])
    return F.coalesce(F.element_at(table, level2), F.lit(OTHER_HARM))


def size_factor(length_m: Column) -> Column:
    """Log scale from half a metre to twenty; an unknown length is neutral."""
    scaled = F.log10(F.greatest(length_m, F.lit(0.5)) / 0.5) / F.log10(F.lit(40.0))
    return F.when(length_m.isNull() | (length_m <= 0), 0.5).otherwise(clip(scaled, 0.0, 1.0))


def persistence_factor(observations: Column) -> Column:
    return F.least(F.lit(1.0), F.log1p(F.greatest(observations, F.lit(1))) / F.log1p(F.lit(8.0)))


def actionability_factor(located: Column, uncertainty_m: Column) -> Column:
    near = F.sqrt(F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.lit(5.0) / F.greatest(uncertainty_m, F.lit(5.0)))))
    return F.when(~located, 0.15).when(uncertainty_m.isNull(), 0.6).otherwise(near)


def score(percent: Column, level2: Column, length_m: Column, observations: Column, quality: Column, located: Column, uncertainty_m: Column, weights: Weights = Weights()) -> Column:
    """0 to 100: the weighted mean of the factors, damped down to half by poor image quality."""
    factors = (clip(percent / 100, 0.0, 1.0), harm(level2), size_factor(length_m), persistence_factor(observations), actionability_factor(located, uncertainty_m))
    total = F.lit(0.0)
    for weight, factor in zip(astuple(weights), factors, strict=True):
        total = total + weight * factor
    return 100 * (total / sum(astuple(weights))) * (0.5 + 0.5 * clip(quality, 0.0, 1.0))


def band(score_: Column) -> Column:
    return F.when(score_ >= 75, "URGENT").when(score_ >= 55, "HIGH").when(score_ >= 35, "ELEVATED").otherwise("ROUTINE")
