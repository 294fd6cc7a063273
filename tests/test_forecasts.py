"""Closed-form forecasts against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from emipanel.operators import forecasts


def holt_reference(s, damped):
    if not s:
        return 0.0
    if len(s) == 1:
        return max(s[0], 0.0)
    z = [np.log1p(max(v, 0)) for v in s]
    runs = []
    for a in forecasts.HOLT_ALPHA:
        for b in forecasts.HOLT_BETA:
            for p in (forecasts.HOLT_PHI if damped else (1.0,)):
                level, trend, sse = z[0], z[1] - z[0], 0.0
                for v in z[1:]:
                    guess = level + p * trend
                    sse += (v - guess) ** 2
                    new = a * v + (1 - a) * guess
                    trend = b * (new - level) + (1 - b) * p * trend
                    level = new
                runs.append((sse, level + p * trend))
    least = min(e for e, _ in runs)
    out = np.expm1(next(f for e, f in runs if e <= least + forecasts.HOLT_TIE))
    return out if out >= 0 else max(s[-1], 0.0)


@pytest.mark.parametrize("damped", [False, True])
def test_holt(spark, damped):
    series = [[10.0, 12.0, 15.0], [5.0], [], [100.0, 3.0], [7.0, 7.0, 7.0, 9.0], [1.0, None, 4.0]]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in series], "h array<double>").select(forecasts.holt("h", damped)).collect()]
    for s, g in zip(series, got):
        assert g == pytest.approx(holt_reference([v for v in s if v is not None], damped), rel=1e-9)


def test_ar1_rules(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (None, None, 5.0), (4.0, 4.0, 4.0), (None, None, None), (None, 9.0, 1.0)], "a double, b double, c double")
    got = [r[0] for r in df.select(forecasts.ar1(["a", "b", "c"], log_space=False)).collect()]
    x, y = np.array([1.0, 2.0]), np.array([2.0, 3.0])
    phi = np.clip(((x * y).mean() - x.mean() * y.mean()) / x.var(), -0.99, 0.99)
    assert got == pytest.approx([y.mean() - phi * x.mean() + phi * 3.0, 5.0, 4.0, 0.0, 1.0])


def test_ar_diff_falls_back(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0), (0.0, 1.0, 3.0, 6.0)], "a double, b double, c double, d double")
    pred, failed = forecasts.ar_diff(["a", "b", "c", "d"])
    got = [tuple(r) for r in df.select(pred, failed).collect()]
    assert got[0] == (1.0, True) and got[1] == (pytest.approx(6 + (1 * 2 + 2 * 3) / (1 + 4) * 3), False)


def test_trend_and_blend(spark):
    df = spark.createDataFrame([("a", 2018, 1.0), ("a", 2019, 2.0), ("b", 2019, 7.0)], "e string, y int, t double")
    assert {r["e"]: r["pred"] for r in forecasts.ols_trend(df, "e", "y", "t", 2021).collect()} == {"a": pytest.approx(4.0), "b": 7.0}
    s = spark.createDataFrame([(float(i), 2.0 * i + (i % 3), 1.0 * i) for i in range(40)], "y double, a double, b double")
    out = {r["strategy"]: r["mae"] for r in forecasts.blend_scores(s, "y", "a", "b").collect()}
    assert out["second_only"] == 0.0 and out["first_only"] == out["alpha=0"]
    x = s.withColumn("split", F.when(F.col("y") % 2 == 0, "train").otherwise("test"))
    assert forecasts.ridge_stack(x, "y", "a", "b").first()["r2"] > 0.99
