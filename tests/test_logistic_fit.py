"""The logistic fit reaches the optimum, by one method at every size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.operators import calibration


def gradient(fit, x, y):
    z = (x - [fit["mean"][k] for k in fit["mean"]]) / [fit["sd"][k] for k in fit["sd"]]
    w = np.array(list(fit["weights"].values()))
    g = (1 / (1 + np.exp(-(z @ w + fit["bias"]))) - y) * np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)
    return np.append(z.T @ g / len(y) + fit["l2"] * w, g.mean())


def rare(spark, times):
    """One positive in fifty and two features that are nearly the same, each row repeated ``times``."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 3))
    y = (np.arange(3000) % 50 == 0).astype(int)
    x[:, 0] += 1.5 * y
    x[:, 1] = x[:, 0] + 0.02 * rng.normal(size=3000)
    df = spark.createDataFrame([(int(t), *map(float, r)) for t, r in zip(y, x, strict=True)], "label int, a double, b double, c double")
    return df.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("k"), x, y


@pytest.mark.parametrize("times", [1, 35])
def test_gradient_vanishes_at_every_size(spark, times):
    df, x, y = rare(spark, times)
    fit = calibration.fit_logistic(df, ["a", "b", "c"])
    assert fit["fitted"] and (fit["n"], fit["positives"]) == (3000 * times, 60 * times)
    assert np.abs(gradient(fit, x, y)).max() < 1e-8


def test_weights_do_not_jump_with_the_size(spark):
    small, large = (calibration.fit_logistic(rare(spark, times)[0], ["a", "b", "c"]) for times in (1, 35))
    assert list(large["weights"].values()) == pytest.approx(list(small["weights"].values()), abs=1e-6)
    assert large["bias"] == pytest.approx(small["bias"], abs=1e-6)


def test_without_an_optimum_there_is_no_fit(spark):
    apart = spark.createDataFrame([(int(i >= 40), float(i)) for i in range(80)], "label int, a double")
    assert calibration.fit_logistic(apart, ["a"])["fitted"] is True
    assert calibration.fit_logistic(apart, ["a"], l2=0.0, steps=5) == {"fitted": False, "reason": "no convergence", "n": 80}
