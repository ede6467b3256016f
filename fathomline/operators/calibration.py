"""Calibration statistics, threshold choice and logistic fits over scored candidates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.numbers import ratio
from fathomline.session import checkpoint


def reliability_bins(scored: DataFrame, bins: int = 10) -> DataFrame:
    """``bin, lo, hi, mean_score, accuracy, n`` of equal bins of ``score``; ``label`` is 0 or 1.

    The first bin is closed on both sides, the others on the upper one. An
    empty bin has its midpoint for a score and no accuracy.
    """
    edges = [float(e) for e in np.linspace(0.0, 1.0, bins + 1)]
    spine = scored.sparkSession.createDataFrame([(k, edges[k], edges[k + 1]) for k in range(bins)], "bin int, lo double, hi double")
    place = F.lit(None).cast("int")
    for k in range(bins - 1, -1, -1):
        above = F.col("score") >= edges[k] if k == 0 else F.col("score") > edges[k]
        place = F.when(above & (F.col("score") <= edges[k + 1]), k).otherwise(place)
    held = scored.withColumn("bin", place).filter("bin is not null").groupBy("bin").agg(F.avg("score").alias("mean_score"), F.avg(F.col("label").cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))
    joined = spine.join(held, "bin", "left")
    return joined.withColumn("mean_score", F.coalesce("mean_score", (F.col("lo") + F.col("hi")) / 2)).na.fill(0, ["n"])


def calibration_error(bins: DataFrame) -> DataFrame:
    """``ece, mce``: the mean gap between accuracy and score weighted by count, and the largest gap."""
    gap = F.abs(F.col("accuracy") - F.col("mean_score"))
    total = bins.agg(F.sum(F.col("n") * gap).alias("_sum"), F.sum("n").alias("_n"), F.coalesce(F.max(F.when(F.col("n") > 0, gap)), F.lit(0.0)).alias("mce"))
    return total.select((F.coalesce("_sum", F.lit(0.0)) / F.greatest("_n", F.lit(1))).alias("ece"), "mce")


def threshold_sweep(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """``threshold, tp, fp, fn, precision, recall, f1`` of accepting scores from each threshold on.

    Each candidate counts for all thresholds up to its score: candidates are
    counted once by the highest threshold they reach, and the counts summed up
    from above, so nothing is multiplied by the thresholds.
    """
    ranks = sorted(thresholds)
    reached = F.lit(-1)
    for k, t in enumerate(ranks):
        reached = F.when(F.col("score") >= t, k).otherwise(reached)
    counted = scored.groupBy(reached.alias("k")).agg(F.sum("label").cast("long").alias("pos"), F.count(F.lit(1)).alias("n"))
    spine = scored.sparkSession.createDataFrame([(k, float(t)) for k, t in enumerate(ranks)] + [(-1, None)], "k int, threshold double")
    up = Window.orderBy(F.desc("k"))
    # One row a threshold from here on.
    summed = spine.join(counted, "k", "left").na.fill(0, ["pos", "n"]).withColumns({"tp": F.sum("pos").over(up), "took": F.sum("n").over(up)})
    all_pos = F.max("tp").over(Window.partitionBy())
    out = summed.withColumn("fp", F.col("took") - F.col("tp")).withColumn("fn", all_pos - F.col("tp")).filter("k >= 0")
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("threshold", "tp", "fp", "fn", "precision", "recall", "f1")


def choose_threshold(sweep: DataFrame, least_recall: float = 0.8) -> DataFrame:
    """The threshold of best F1 among those that keep ``least_recall``, else of best recall; the lowest of equal ones."""
    fine = F.col("recall") >= least_recall
    best = F.when(F.count_if(fine) > 0, F.max_by(F.when(fine, F.col("threshold")), F.when(fine, F.struct("f1", -F.col("threshold")))))
    return sweep.agg(F.coalesce(best, F.max_by("threshold", F.struct("recall", -F.col("threshold")))).alias("threshold")).join(sweep, "threshold")


def roc_auc(scored: DataFrame, id_col: str) -> DataFrame:
    """``auc, positives, negatives`` by the rank sum; equal scores go by ``id_col``, negatives first.

    Ranks come from counts per distinct score, so the order is built over
    scores, not over one sorted list of all rows: the share of negatives below
    a positive is summed, which is the same number.
    """
    per = scored.groupBy("score").agg(F.sum("label").cast("long").alias("p"), F.sum(1 - F.col("label")).cast("long").alias("m"))
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written, as a range that is dealt anew after a lost executor could have other bounds.
    ranged = checkpoint(per.repartitionByRange(parts, "score").withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy("score")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("part").agg(F.sum("m").alias("m")).withColumn("below", F.coalesce(F.sum("m").over(before), F.lit(0))).drop("m")
    # Negatives of the same score come first, so they count as below.
    ranked = ranged.join(F.broadcast(starts), "part").withColumn("below", F.col("below") + F.sum("m").over(inside))
    total = ranked.agg(F.sum(F.col("p") * F.col("below")).alias("won"), F.sum("p").alias("positives"), F.sum("m").alias("negatives"))
    return total.select(F.when((F.col("positives") > 0) & (F.col("negatives") > 0), F.col("won") / (F.col("positives") * F.col("negatives"))).alias("auc"), "positives", "negatives")


def standardise(df: DataFrame, names: list[str], label: str = "label") -> DataFrame:
    """``feature, mean, sd`` (of the population; 1 where it vanishes) and the weight of a positive against a negative."""
    stats = df.agg(*[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names], ratio(F.count_if(F.col(label) == 0), F.greatest(F.count_if(F.col(label) == 1), F.lit(1))).alias("pos_weight"))
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"m_{n}").alias("mean"), F.when(F.col(f"s_{n}") < 1e-6, 1.0).otherwise(F.col(f"s_{n}")).alias("sd")) for n in names])
    return stats.select(F.inline(rows), "pos_weight")


def l2_for(n: int) -> float:
    """The penalty for a sample of ``n`` candidates."""
    return 1e-3 if n >= 400 else 1e-2 if n >= 150 else 5e-2


def fit_logistic(df: DataFrame, names: list[str], label: str = "label", steps: int = 100, l2: float | None = None, tolerance: float = 1e-9) -> dict:
    """Class-weighted logistic weights over standardised features, by Newton steps.

    Refuses (``fitted`` false, with a reason) under 30 rows or with one class,
    and where the gradient is still above ``tolerance`` after ``steps`` passes.
    Whatever the size, a pass is one aggregation in Spark of the loss, the
    gradient and the Hessian; a step that raises the loss is halved.
    """
    clean = df.select(F.col(label).cast("double").alias(label), *names).na.drop()
    n, positives = clean.agg(F.count(F.lit(1)), F.sum(label).cast("long")).first()
    if n < 30 or positives in (0, n):
        return {"fitted": False, "reason": "too few rows or one class", "n": n}
    stats = {r["feature"]: (r["mean"], r["sd"], r["pos_weight"]) for r in standardise(clean, names, label).collect()}
    mean, sd, weight = np.array([stats[k][0] for k in names]), np.array([stats[k][1] for k in names]), next(iter(stats.values()))[2]
    penalty = l2_for(n) if l2 is None else l2
    z = [F.lit(1.0), *[F.col(f"_{k}") for k in range(len(names))]]
    held = clean.select(F.col(label).alias("_y"), *[((F.col(c) - float(m)) / float(s)).alias(f"_{k}") for k, (c, m, s) in enumerate(zip(names, mean, sd, strict=True))]).persist()
    ridge = np.array([0.0, *[penalty] * len(names)])
    upper = [(i, j) for i in range(len(z)) for j in range(i, len(z))]

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss, gradient and Hessian at the bias and weights ``w``."""
        score = F.lit(float(w[0]))
        for k, wk in enumerate(w[1:]):
            score = score + float(wk) * F.col(f"_{k}")
        rows = held.select("*", score.alias("_s"), F.when(F.col("_y") == 1, float(weight)).otherwise(1.0).alias("_c"))
        rows = rows.withColumn("_p", 1 / (1 + F.exp(-F.col("_s"))))
        g, h = F.col("_c") * (F.col("_p") - F.col("_y")), F.col("_c") * F.col("_p") * (1 - F.col("_p"))
        loss = F.col("_c") * (F.greatest("_s", F.lit(0.0)) - F.col("_y") * F.col("_s") + F.log1p(F.exp(-F.abs("_s"))))
        sums = np.array(rows.agg(F.sum(loss), *[F.sum(g * c) for c in z], *[F.sum(h * z[i] * z[j]) for i, j in upper]).first(), dtype=float) / n
        hessian = np.zeros((len(z), len(z)))
        for (i, j), v in zip(upper, sums[1 + len(z) :], strict=True):
            hessian[i, j] = hessian[j, i] = v
        return sums[0] + (ridge * w * w).sum() / 2, sums[1 : 1 + len(z)] + ridge * w, hessian + np.diag(ridge)

    w, step, loss = np.zeros(len(z)), np.zeros(len(z)), np.inf
    try:
        for _ in range(steps):
            tried, gradient, hessian = at(w + step)
            if tried > loss + 1e-12 * (1 + abs(loss)):
                step = step / 2
                continue
            w, loss = w + step, tried
            if np.abs(gradient).max() <= tolerance:
                break
            step = -np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        else:
            return {"fitted": False, "reason": "no convergence", "n": n}
    finally:
        held.unpersist()
    return {"fitted": True, "n": n, "positives": positives, "weights": dict(zip(names, w[1:].tolist(), strict=True)), "mean": dict(zip(names, mean.tolist(), strict=True)), "sd": dict(zip(names, sd.tolist(), strict=True)), "bias": float(w[0]), "l2": penalty}


def fit_platt(scored: DataFrame, steps: int = 4000, rate: float = 0.05, bins: int = 20_000) -> dict:
    """Slope and intercept of a logistic calibration on the logit of ``score``.

    Refuses under 10 rows or with one class. Rows are first summed by their
    score to a fine grid, so what reaches the driver is bounded by ``bins``.
    """
    q = F.least(F.greatest(F.col("score"), F.lit(1e-6)), F.lit(1 - 1e-6))
    cells = scored.select(F.ln(q / (1 - q)).alias("x"), "label").groupBy(F.floor(F.col("x") * (bins / 28)).alias("cell")).agg(F.avg("x"), F.sum("label"), F.count(F.lit(1))).collect()
    x, pos, n = (np.array([r[k] for r in cells], dtype=float) for k in (1, 2, 3))
    if n.sum() < 10 or pos.sum() in (0, n.sum()):
        return {"fitted": False, "reason": "too few rows or one class", "n": int(n.sum())}
    a, b = 1.0, 0.0
    for _ in range(steps):
        g = n / (1 + np.exp(-(a * x + b))) - pos
        a, b = a - rate * float((g * x).sum()) / n.sum(), b - rate * float(g.sum()) / n.sum()
    return {"fitted": True, "a": a, "b": b, "n": int(n.sum()), "positives": int(pos.sum())}
