"""Filtering, calibration and confidence as column expressions."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomline.functions.numbers import clip, fixed


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    q = clip(p, 1e-6, 1 - 1e-6)
    return F.ln(q / (1 - q))


@dataclass(frozen=True)
class Platt:
    """A logistic calibration a * logit(score) + b. Not fitted, it leaves scores as they are."""

    a: float = 1.0
    b: float = 0.0
    fitted: bool = False

    def transform(self, score: Column) -> Column:
        return sigmoid(self.a * logit(score) + self.b) if self.fitted else score


@dataclass(frozen=True)
class RuleFilter:
    """Least raw score, signal to noise and shadow, and the largest aspect ratio."""

    raw: float = 0.15
    snr: float = 1.5
    shadow: float = 0.03
    aspect: float = 12.0

    def reasons(self) -> Column:
        """What speaks against a candidate, joined by "; "; empty if nothing does."""
        snr, shadow, aspect = F.col("snr"), F.col("shadow"), F.col("aspect")
        return F.concat_ws(
            "; ",
            F.when(F.col("raw") < self.raw, F.format_string("raw_score %s < %s", fixed(F.col("raw"), 2), F.lit(str(self.raw)))),
            F.when(snr < self.snr, F.format_string("local_snr %s < %s", fixed(snr, 2), F.lit(str(self.snr)))),
            F.when(shadow < self.shadow, F.format_string("no coherent acoustic shadow (%s < %s)", fixed(shadow, 3), F.lit(str(self.shadow)))),
            F.when(aspect > self.aspect, F.format_string("extreme aspect ratio %s (likely ripple/seam artefact)", fixed(aspect, 1))),
        )

    def accepted(self) -> Column:
        return self.reasons() == ""

    def score(self) -> Column:
        """The raw score, halved if the candidate is rejected."""
        return F.when(self.accepted(), F.col("raw")).otherwise(F.col("raw") * 0.5)


@dataclass(frozen=True)
class LinearFilter:
    """A logistic filter over standardised features."""

    weights: Mapping[str, float]
    mean: Mapping[str, float]
    sd: Mapping[str, float]
    bias: float = 0.0
    threshold: float = 0.5
    names: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "names", tuple(self.weights))

    def contribution(self, name: str) -> Column:
        return self.weights[name] * ((F.col(name) - self.mean[name]) / self.sd[name])

    def score(self) -> Column:
        total = F.lit(self.bias)
        for name in self.names:
            total = total + self.contribution(name)
        return sigmoid(total)

    def strongest(self, n: int = 3) -> Column:
        """The ``n`` features of largest contribution either way, largest first; equal ones by name."""
        parts = F.array(*[F.struct((-F.abs(self.contribution(name))).alias("o"), F.lit(name).alias("feature"), self.contribution(name).alias("contribution")) for name in self.names])
        return F.transform(F.slice(F.array_sort(parts), 1, n), lambda x: F.struct(x["feature"], x["contribution"]))


def fused(calibrated: Column, probability: Column) -> Column:
    """Geometric mean of the calibrated score and the filter's probability, both at least 1e-9."""
    return F.sqrt(F.greatest(calibrated, F.lit(1e-9)) * F.greatest(probability, F.lit(1e-9)))


def confidence_band(percent: Column) -> Column:
    return F.when(percent >= 85, "CRITICAL").when(percent >= 65, "HIGH").when(percent >= 40, "MEDIUM").otherwise("LOW")
