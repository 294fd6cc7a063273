"""Closed-form estimators: group statistics, history rules and small recursions as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emipanel.functions.numeric import log_target
from emipanel.operators.skew import attach_row, exact_median, join_null_safe
from emipanel.tasks import HOLT_ALPHA, HOLT_BETA, HOLT_PHI, HOLT_TIE, holt_block  # noqa: F401


def global_mean(train: DataFrame, test: DataFrame, y: str, pred: str = "pred") -> DataFrame:
    """expm1 of the training mean of log1p."""
    return attach_row(test, train.agg(F.expm1(F.avg(log_target(y))).alias(pred)))


def group_mean(train: DataFrame, test: DataFrame, keys, y: str, pred: str = "pred") -> DataFrame:
    """Group mean in log1p space, the global one for unseen groups."""
    per = train.groupBy(*keys).agg(F.avg(log_target(y)).alias("__m"))
    out = attach_row(join_null_safe(test, per, keys), train.agg(F.avg(log_target(y)).alias("__g")))
    return out.withColumn(pred, F.expm1(F.coalesce("__m", "__g"))).drop("__m", "__g")


def sector_stat(train: DataFrame, test: DataFrame, sector: str, y: str, stat: str = "mean",
                pred: str = "pred") -> DataFrame:
    """Mean or median of positive raw targets per known sector, the one over all known sectors elsewhere."""
    pos = train.where((F.col(y) > 0) & F.col(sector).isNotNull())
    if stat == "median":
        per, overall = exact_median(pos, [sector], y, "__m"), exact_median(pos, [], y, "__g")
    else:
        per, overall = pos.groupBy(sector).agg(F.avg(y).alias("__m")), pos.agg(F.avg(y).alias("__g"))
    out = attach_row(join_null_safe(test, per, [sector]), overall)
    return out.withColumn(pred, F.coalesce("__m", "__g")).drop("__m", "__g")


def sector_log_mean(train: DataFrame, test: DataFrame, sector: str, y_log: str, pred: str = "pred_log") -> DataFrame:
    per = train.groupBy(sector).agg(F.avg(y_log).alias("__m"))
    out = attach_row(join_null_safe(test, per, [sector]), train.agg(F.avg(y_log).alias("__g")))
    return out.withColumn(pred, F.coalesce("__m", "__g")).drop("__m", "__g")


def persistence(lag1: str = "lag1") -> Column:
    return F.col(lag1)


def moving_average(lag_cols, log_space: bool = False) -> Column:
    """Mean of the lags that exist; in log space the mean of log1p, transformed back."""
    total, n = F.lit(0.0), F.lit(0)
    for c in lag_cols:
        v = F.log1p(F.greatest(F.col(c), F.lit(0.0))) if log_space else F.col(c)
        v = F.when(F.col(c).isNotNull(), v)
        total, n = total + F.coalesce(v, F.lit(0.0)), n + v.isNotNull().cast("int")
    mean = F.try_divide(total, n)
    return F.expm1(mean) if log_space else mean


def two_point_trend(lag1: str = "lag1", lag2: str = "lag2") -> Column:
    """2 x lag1 - lag2, never negative; lag1 alone when there is no lag2."""
    return F.greatest(F.coalesce(F.lit(2.0) * F.col(lag1) - F.col(lag2), F.col(lag1)), F.lit(0.0))


def ols_trend(df: DataFrame, entity: str, year: str, y: str, target_year: int, pred: str = "pred") -> DataFrame:
    """Least-squares line through each entity's history, extended to ``target_year``; one point stays level.

    Years are counted back from the target year, so the forecast is the intercept and no precision is
    lost to large year numbers."""
    ahead = F.col(year) - F.lit(target_year)
    return df.where(ahead < 0).groupBy(entity).agg(F.coalesce(F.regr_intercept(F.col(y), ahead), F.avg(y)).alias(pred))


def wide_growth(wide: DataFrame, years) -> Column:
    """Mean yearly change over a wide history: only its ends matter."""
    first, last = f"`{years[0]}`", f"`{years[-1]}`"
    return (F.col(last) - F.col(first)) / F.lit(float(len(years) - 1))


def sector_growth(wide: DataFrame, sector: str, years, steps: int = 1, pred: str = "pred") -> DataFrame:
    """Last value plus the sector's median yearly change (0 where the sector is unknown)."""
    src = wide.withColumn("__g", wide_growth(wide, years))
    med = exact_median(src.where(F.col(sector).isNotNull()), [sector], "__g", "__m")
    out = join_null_safe(src, med, [sector])
    last = F.col(f"`{years[-1]}`")
    return out.withColumn(pred, last + F.lit(steps) * F.coalesce("__m", F.lit(0.0))).drop("__g", "__m")


def growth_baselines(wide: DataFrame, sector: str, years) -> DataFrame:
    """Four forecasts of the next change: none, mean past, last, sector median of mean past."""
    y0, y1 = F.col(f"`{years[-2]}`"), F.col(f"`{years[-1]}`")
    src = wide.withColumn("avg_past_growth", wide_growth(wide, years))
    med = exact_median(src.where(F.col(sector).isNotNull()), [sector], "avg_past_growth", "__m")
    return (join_null_safe(src, med, [sector])
            .withColumn("zero_change", F.lit(0.0)).withColumn("last_growth", y1 - y0)
            .withColumn("sector_median_growth", F.coalesce("__m", F.lit(0.0))).drop("__m"))


def ar1(lag_cols, log_space: bool = True) -> Column:
    """AR(1) with constant, by moments of the consecutive pairs that exist; columns run oldest to newest.

    The slope is 0 for a flat history and held within +-0.99; without a pair the last value is used,
    and a negative forecast becomes 0.
    """
    s = [F.log1p(F.greatest(F.col(c), F.lit(0.0))) if log_space else F.col(c).cast("double") for c in lag_cols]
    s = [F.when(F.col(c).isNotNull(), v) for c, v in zip(lag_cols, s)]
    both = [a.isNotNull() & b.isNotNull() for a, b in zip(s[:-1], s[1:])]

    def mean(f):
        total, n = F.lit(0.0), F.lit(0)
        for ok, x, y in zip(both, s[:-1], s[1:]):
            total, n = total + F.when(ok, f(x, y)).otherwise(0.0), n + ok.cast("int")
        return F.try_divide(total, n)

    mx, my = mean(lambda x, y: x), mean(lambda x, y: y)
    var = mean(lambda x, y: x * x) - mx * mx
    cov = mean(lambda x, y: x * y) - mx * my
    phi = F.when(var > 1e-6, F.greatest(F.least(F.try_divide(cov, var), F.lit(0.99)), F.lit(-0.99))).otherwise(0.0)
    last = F.coalesce(*reversed(s))
    yhat = F.coalesce(my - phi * mx + phi * last, last, F.lit(0.0))
    return F.greatest(F.expm1(yhat) if log_space else yhat, F.lit(0.0))


def holt(history: Column | str, damped: bool = False, log_space: bool = True) -> Column:
    """One-step Holt forecast of an oldest-to-newest array, the smoothing constants chosen from a small
    grid by squared one-step error. One value: itself; none: 0; a negative forecast: the last value.

    The recursion has no built-in form, so Arrow batches of histories go through one array computation.
    """
    @F.pandas_udf("double")
    def forecast(values: pd.Series) -> pd.Series:
        kept = [[] if v is None else [x for x in v if x is not None and x == x] for v in values]
        length = np.array([len(k) for k in kept])
        out = np.array([max(k[-1], 0.0) if k else 0.0 for k in kept])
        many = np.flatnonzero(length >= 2)
        if len(many):
            width = length.max()
            block = np.array([kept[i] + [0.0] * (width - length[i]) for i in many])
            pred = holt_block(np.log1p(np.maximum(block, 0)) if log_space else block, length[many], damped)
            pred = np.expm1(pred) if log_space else pred
            out[many] = np.where(pred >= 0, pred, out[many])
        return pd.Series(out)

    return forecast(F.col(history) if isinstance(history, str) else history)


def ar_diff(cols) -> tuple[Column, Column]:
    """ARIMA(1,1,0)-style step by conditional least squares on differences; columns run oldest to newest.

    Returns (forecast, fell back to the last value).
    """
    d = [F.col(b) - F.col(a) for a, b in zip(cols[:-1], cols[1:])]
    num, den = F.lit(0.0), F.lit(0.0)
    for a, b in zip(d[:-1], d[1:]):
        num, den = num + a * b, den + a * a
    step = F.try_divide(num, den) * d[-1]
    return F.coalesce(F.col(cols[-1]) + step, F.col(cols[-1])), step.isNull()


def factor_prediction(factor: str, revenue: str) -> Column:
    return F.col(factor) * F.col(revenue)


def blend(a: str, b: str, alpha: float = 0.5) -> Column:
    """(1 - alpha) x a + alpha x b."""
    return F.lit(1 - alpha) * F.col(a) + F.lit(alpha) * F.col(b)


BLEND_ALPHAS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5)


def blend_scores(df: DataFrame, y: str, a: str, b: str, alphas=BLEND_ALPHAS) -> DataFrame:
    """Scores of both models, their mean and every weight of the grid, from a single pass over the rows."""
    from emipanel.operators.metrics import mae, r2, rmse

    named = {"first_only": 0.0, "second_only": 1.0, "avg": 0.5, **{f"alpha={x:g}": x for x in alphas}}
    wide = df.withColumns({f"__p{i}": blend(a, b, x) for i, x in enumerate(named.values())})
    wide = wide.where(F.col(y).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull())
    scores = wide.agg(F.count(F.lit(1)).alias("n"), F.array(*[
        F.struct(F.lit(name).alias("strategy"), mae(y, f"__p{i}").alias("mae"), rmse(y, f"__p{i}").alias("rmse"),
                 r2(y, f"__p{i}").alias("r2")) for i, name in enumerate(named)]).alias("__s"))
    return scores.select(F.explode("__s").alias("s"), "n").select("s.*", "n")


def ridge_stack(df: DataFrame, y: str, a: str, b: str, split: str = "split", alpha: float = 0.1) -> DataFrame:
    """Ridge on two predictions, fitted on ``train`` and scored on ``test``.

    The two coefficients solve a 2x2 system of centred sums, so fitting is one aggregation.
    """
    from emipanel.operators.metrics import mae, r2, rmse

    ok = df.where(F.col(y).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull())
    n = F.count(F.lit(1))
    s = ok.where(F.col(split) == "train").agg(
        n.alias("n"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.avg(y).alias("my"),
        (F.var_pop(a) * n + alpha).alias("saa"), (F.var_pop(b) * n + alpha).alias("sbb"),
        (F.covar_pop(a, b) * n).alias("sab"), (F.covar_pop(a, y) * n).alias("say"), (F.covar_pop(b, y) * n).alias("sby"))
    det = F.col("saa") * F.col("sbb") - F.col("sab") * F.col("sab")
    coef = s.select(F.try_divide(F.col("say") * F.col("sbb") - F.col("sby") * F.col("sab"), det).alias("coef_a"),
                    F.try_divide(F.col("sby") * F.col("saa") - F.col("say") * F.col("sab"), det).alias("coef_b"),
                    "ma", "mb", "my")
    coef = coef.select("coef_a", "coef_b",
                       (F.col("my") - F.col("coef_a") * F.col("ma") - F.col("coef_b") * F.col("mb")).alias("intercept"))
    test = attach_row(ok.where(F.col(split) == "test"), coef).withColumn(
        "__p", F.col("coef_a") * F.col(a) + F.col("coef_b") * F.col(b) + F.col("intercept"))
    return attach_row(test.agg(F.count(F.lit(1)).alias("n"), mae(y, "__p").alias("mae"), rmse(y, "__p").alias("rmse"),
                               r2(y, "__p").alias("r2")), coef)
