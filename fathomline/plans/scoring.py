"""Queries on filtering, calibration and thresholds."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.confidence import LinearFilter, Platt, RuleFilter, confidence_band, fused
from fathomline.functions.numbers import feature_map, micro
from fathomline.operators import calibration as C
from fathomline.plans.registry import query
from fathomline.plans.views import CANDIDATES, SCORED, candidates, micro_sql, read, scored
from fathomline.session import shared_folder
from fathomline.sources import models

FEATURES = ["contrast", "shadow", "snr", "aspect", "compactness", "size_rank", "raw"]
WEIGHTS = dict(zip(FEATURES, (0.8, -0.3, 1.1, -0.4, 0.25, 0.1, 0.9), strict=True))
MEAN = dict(zip(FEATURES, (0.5, 0.08, 2.5, 7.0, 0.45, 0.5, 0.5), strict=True))
SD = dict(zip(FEATURES, (0.3, 0.05, 1.4, 4.3, 0.29, 0.28, 0.22), strict=True))
LINEAR = LinearFilter(WEIGHTS, MEAN, SD, bias=-0.2, threshold=0.63)
PLATT = Platt(0.85, -0.4, True)

_REASONS = """concat_ws('; ', CASE WHEN raw < 0.15 THEN printf('raw_score %.2f < 0.15', raw) END, CASE WHEN snr < 1.5 THEN printf('local_snr %.2f < 1.5', snr) END,
    CASE WHEN shadow < 0.03 THEN printf('no coherent acoustic shadow (%.3f < 0.03)', shadow) END, CASE WHEN aspect > 12 THEN printf('extreme aspect ratio %.1f (likely ripple/seam artefact)', aspect) END)"""
_PARTS = {n: f"{WEIGHTS[n]} * (({n} - {MEAN[n]}) / {SD[n]})" for n in FEATURES}
_LOGIT = "ln(least(greatest(raw, 1e-6), 1 - 1e-6) / (1 - least(greatest(raw, 1e-6), 1 - 1e-6)))"
_P = f"1 / (1 + exp(-(-0.2 + {' + '.join(_PARTS.values())})))"
_CAL = f"1 / (1 + exp(-(0.85 * {_LOGIT} + -0.4)))"
_FUSED = f"sqrt(greatest({_CAL}, 1e-9) * greatest({_P}, 1e-9))"


@query(f"WITH {CANDIDATES}, r AS (SELECT id, raw, {_REASONS} AS reason FROM candidates) SELECT id, reason = '' AS accepted, reason, {micro_sql('CASE WHEN reason = $$$$ THEN raw ELSE raw * 0.5 END')} AS score FROM r")
def rule_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC21, FLT2: the rule filter's verdict, its reasons and its score."""
    rules = RuleFilter()
    return candidates(spark, sf_dir).select("id", rules.accepted().alias("accepted"), rules.reasons().alias("reason"), micro(rules.score()).alias("score"))


@query(f"WITH {CANDIDATES} SELECT id, {micro_sql(_P)} AS p, {_P} >= 0.63 AS accepted FROM candidates")
def learned_filter_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC19, FLT2: probabilities of a fitted linear filter."""
    return candidates(spark, sf_dir).select("id", micro(LINEAR.score()).alias("p"), (LINEAR.score() >= LINEAR.threshold).alias("accepted"))


@query(f"WITH {CANDIDATES} SELECT id, {micro_sql(_CAL)} AS calibrated FROM candidates")
def platt_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC18: calibrated scores."""
    return candidates(spark, sf_dir).select("id", micro(PLATT.transform(F.col("raw"))).alias("calibrated"))


@query(
    f"""WITH {CANDIDATES}, f AS (SELECT id, {_FUSED} AS s FROM candidates) SELECT id, {micro_sql("s")} AS confidence,
    CASE WHEN 100 * s >= 85 THEN 'CRITICAL' WHEN 100 * s >= 65 THEN 'HIGH' WHEN 100 * s >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM f"""
)
def fused_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC17, SC20: calibrated score and filter probability in one, and its band."""
    both = candidates(spark, sf_dir).select("id", fused(PLATT.transform(F.col("raw")), LINEAR.score()).alias("s"))
    return both.select("id", micro(F.col("s")).alias("confidence"), confidence_band(100 * F.col("s")).alias("band"))


@query(
    f"""WITH {CANDIDATES}, each AS MATERIALIZED (SELECT *, row_number() OVER () AS one FROM candidates), parts AS ({" UNION ALL ".join(f"SELECT one, id, '{n}' AS feature, {p} AS c FROM each" for n, p in _PARTS.items())}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY one ORDER BY abs(c) DESC, feature) AS place FROM parts) SELECT id, place, feature, {micro_sql("c")} AS contribution FROM ranked WHERE place <= 3"""
)
def top3_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN12: the three features that move a candidate most."""
    top = candidates(spark, sf_dir).select("id", F.posexplode(LINEAR.strongest(3)).alias("k", "x"))
    return top.select("id", (F.col("k") + 1).alias("place"), F.col("x.feature").alias("feature"), micro(F.col("x.contribution")).alias("contribution"))


@query(
    f"""WITH {CANDIDATES}, w AS (SELECT count_if(label = 0) / greatest(count_if(label = 1), 1) AS pos_weight FROM candidates)
    {" UNION ALL ".join(f"SELECT '{n}' AS feature, {micro_sql(f'avg({n})')} AS mean, {micro_sql(f'stddev_pop({n})')} AS sd, any_value((SELECT {micro_sql('pos_weight')} FROM w)) AS pos_weight FROM candidates" for n in FEATURES)}"""
)
def standardise_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG7: means, deviations and the class weight."""
    return C.standardise(candidates(spark, sf_dir), FEATURES).select("feature", *[micro(F.col(c)).alias(c) for c in ("mean", "sd", "pos_weight")])


_EDGES = [float(e) for e in np.linspace(0.0, 1.0, 11)]
_BINS = f"""{SCORED}, spine(bin, lo, hi) AS (VALUES {", ".join(f"({k}, {_EDGES[k]!r}::DOUBLE, {_EDGES[k + 1]!r}::DOUBLE)" for k in range(10))}), bins AS (
    SELECT bin, any_value(lo) AS lo, any_value(hi) AS hi, coalesce(avg(score), (any_value(lo) + any_value(hi)) / 2) AS mean_score, avg(label) AS accuracy, count(score) AS n
    FROM spine LEFT JOIN scored ON score <= hi AND (score > lo OR (bin = 0 AND score >= lo)) GROUP BY bin)"""


@query(f"WITH {_BINS} SELECT bin, lo, hi, {micro_sql('mean_score')} AS mean_score, {micro_sql('accuracy')} AS accuracy, n FROM bins")
def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG5: the reliability curve."""
    return C.reliability_bins(scored(spark, sf_dir)).withColumns({c: micro(F.col(c)) for c in ("mean_score", "accuracy")})


@query(f"WITH {_BINS} SELECT {micro_sql('sum(n * abs(accuracy - mean_score)) / sum(n)')} AS ece, {micro_sql('max(CASE WHEN n > 0 THEN abs(accuracy - mean_score) END)')} AS mce FROM bins")
def ece_mce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG5: expected and largest calibration error."""
    return C.calibration_error(C.reliability_bins(scored(spark, sf_dir))).select(micro(F.col("ece")).alias("ece"), micro(F.col("mce")).alias("mce"))


_THRESHOLDS = [float(t) for t in np.linspace(0.05, 0.95, 91)]
_SWEEP = f"""{CANDIDATES}, t(threshold) AS (VALUES {", ".join(f"({t!r}::DOUBLE)" for t in _THRESHOLDS)}), counts AS (
    SELECT threshold, count_if(raw >= threshold AND label = 1) AS tp, count_if(raw >= threshold AND label = 0) AS fp, count_if(raw < threshold AND label = 1) AS fn FROM candidates CROSS JOIN t GROUP BY threshold
), pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM counts
), sweep AS (SELECT threshold, tp, fp, fn, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM pr)"""
_SHOWN = f'threshold, tp, fp, fn, {micro_sql("p")} AS "precision", {micro_sql("r")} AS recall, {micro_sql("f1")} AS f1'


def _micro_rates(df: DataFrame) -> DataFrame:
    return df.withColumns({c: micro(F.col(c)) for c in ("precision", "recall", "f1")})


def _raw_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("id", F.col("raw").alias("score"), "label")


@query(f"WITH {_SWEEP} SELECT {_SHOWN} FROM sweep")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG6: precision, recall and F1 at 91 thresholds."""
    return _micro_rates(C.threshold_sweep(_raw_scored(spark, sf_dir), _THRESHOLDS))


@query(f"WITH {_SWEEP} SELECT {_SHOWN} FROM sweep ORDER BY CASE WHEN r >= 0.8 THEN 0 ELSE 1 END, CASE WHEN r >= 0.8 THEN f1 ELSE r END DESC, threshold LIMIT 1")
def chosen_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG6: the threshold of best F1 that keeps four fifths of the targets."""
    return _micro_rates(C.choose_threshold(C.threshold_sweep(_raw_scored(spark, sf_dir), _THRESHOLDS)))


@query(
    f"""WITH {SCORED}, ranked AS (SELECT label, row_number() OVER (ORDER BY score, label) AS r FROM scored), s AS (SELECT sum(CASE WHEN label = 1 THEN r END)::BIGINT AS ranks, count_if(label = 1) AS p, count_if(label = 0) AS m FROM ranked)
    SELECT {micro_sql("(ranks - p * (p + 1) / 2) / (p * m)")} AS auc, p AS positives, m AS negatives FROM s"""
)
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG10, PL6: area under the curve by the rank sum."""
    return C.roc_auc(scored(spark, sf_dir), "doc_id").withColumn("auc", micro(F.col("auc")))


@query()
def logistic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG8, SC24: weights of the filter fitted on the candidates."""
    fit = C.fit_logistic(candidates(spark, sf_dir), FEATURES)
    return spark.createDataFrame([(n, float(fit["weights"][n])) for n in FEATURES] + [("bias", float(fit["bias"]))], "feature string, weight double")


@query()
def platt_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG9: slope and intercept fitted on the scored documents."""
    fit = C.fit_platt(scored(spark, sf_dir))
    return spark.createDataFrame([(float(fit["a"]), float(fit["b"]), fit["n"], fit["positives"])], "a double, b double, n long, positives long")


@query(
    f"""SELECT event_type AS stage, count(*) AS n, {micro_sql("avg(value)")} AS mean, {micro_sql("quantile_cont(value, 0.5)")} AS p50, {micro_sql("quantile_cont(value, 0.95)")} AS p95, {micro_sql("min(value)")} AS least FROM events GROUP BY 1"""
)
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG11: mean, median, 95th percentile and minimum of timings by stage."""
    p = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95)))
    t = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("n"), micro(F.avg("value")).alias("mean"), p.alias("p"), micro(F.min("value")).alias("least"))
    return t.select("stage", "n", "mean", micro(F.get("p", F.lit(0))).alias("p50"), micro(F.get("p", F.lit(1))).alias("p95"), "least")


@query(f"""SELECT {micro_sql("avg(value) FILTER (WHERE event_type = 'click') / avg(value) FILTER (WHERE event_type = 'view')")} AS speed_up FROM events""")
def device_speed_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG26: ratio of two devices' mean timings."""
    kind = F.col("event_type")
    return read(spark, sf_dir, "events").agg(micro(F.avg(F.when(kind == "click", F.col("value"))) / F.avg(F.when(kind == "view", F.col("value")))).alias("speed_up"))


_MAPPED = ("snr", "aspect", "compactness", "size_rank", "odds")


@query(f"WITH {CANDIDATES}, o AS (SELECT *, CASE WHEN label = 1 THEN snr ELSE 'inf'::DOUBLE END AS odds FROM candidates) SELECT id, round(snr, 4) AS snr, round(aspect, 4) AS aspect, round(compactness, 4) AS compactness, round(size_rank, 4) AS size_rank, CASE WHEN label = 1 THEN round(odds, 4) ELSE 0 END AS odds, 5 AS entries FROM o")
def feature_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MP1: the features of each candidate as a map, one of them infinite where the label is 0."""
    c = candidates(spark, sf_dir).withColumn("odds", F.when(F.col("label") == 1, F.col("snr")).otherwise(F.lit(float("inf"))))
    return c.select("id", feature_map(*_MAPPED).alias("m")).select("id", *[F.col("m")[n].alias(n) for n in _MAPPED], F.size("m").alias("entries"))


@query(
    f"""WITH {CANDIDATES} SELECT id, {micro_sql("1 / (1 + exp(-(-0.2 + 0.7 * ((snr - 2.5) / 1.4) - 0.4 * ((aspect - 7.0) / 4.3))))")} AS score, {micro_sql("1 / (1 + exp(-(0.8 * ln(greatest(1e-6, least(1 - 1e-6, raw)) / (1 - greatest(1e-6, least(1 - 1e-6, raw)))) - 0.3)))")} AS calibrated,
    {micro_sql("raw")} AS uncalibrated, 'linear' AS filter, 'rules' AS fallback, 'standard' AS profile, 'none' AS assumed FROM candidates"""
)
def stored_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRV2, SRC9: a filter, a calibrator and a model card written and read again, and what stands in where there is none."""
    path = f"{shared_folder(spark)}/models-{uuid.uuid4().hex}"
    models.save_filter(spark, LinearFilter({"snr": 0.7, "aspect": -0.4}, {"snr": 2.5, "aspect": 7.0}, {"snr": 1.4, "aspect": 4.3}, -0.2), f"{path}/filter")
    models.save_calibrator(spark, Platt(0.8, -0.3, True), f"{path}/platt")
    models.save_model_card(spark, f"{path}/net.pt", {"preprocess_profile": "standard"})
    found, fallback = models.load_filter(spark, f"{path}/filter"), models.load_filter(spark, f"{path}/missing")
    kind = lambda m: F.lit("linear" if isinstance(m, LinearFilter) else "rules")
    return candidates(spark, sf_dir).select(
        "id", micro(found.score()).alias("score"), micro(models.load_calibrator(spark, f"{path}/platt").transform(F.col("raw"))).alias("calibrated"), micro(models.load_calibrator(spark, f"{path}/missing").transform(F.col("raw"))).alias("uncalibrated"),
        kind(found).alias("filter"), kind(fallback).alias("fallback"), F.lit(models.read_model_card(spark, f"{path}/net.pt")["preprocess_profile"]).alias("profile"), F.lit(models.read_model_card(spark, f"{path}/other.pt")["preprocess_profile"]).alias("assumed"),
    )
