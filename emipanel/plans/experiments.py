"""Experiments: history features, closed-form forecasts, learner grids, scores in the long results form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emipanel.operators.forecasts import ar1, holt, moving_average, persistence, two_point_trend
from emipanel.operators.learners import LEARNERS, persisted, sized
from emipanel.operators.metrics import METRICS, all_metrics, macro, to_long
from emipanel.operators.windows import history_array, lag_features

FORECASTERS = ("persistence", "moving_average", "two_point_trend", "ar1", "holt")


def forecast_frame(panel: DataFrame, entity: str, year: str, y: str, n_lags: int = 3) -> DataFrame:
    """Panel with lags and one column per closed-form forecast; rows without a history are dropped."""
    out = lag_features(panel, entity, year, y, n_lags).where(F.col("lag1").isNotNull())
    lags = [f"lag{k}" for k in range(n_lags, 0, -1)]
    out = out.withColumn("history", history_array(lags))
    return out.withColumns({
        "persistence": persistence(), "moving_average": moving_average(lags), "two_point_trend": two_point_trend(),
        "ar1": ar1(lags), "holt": holt("history")})


def score_wide(df: DataFrame, keys, y: str, preds, names=METRICS) -> DataFrame:
    """Scores of several prediction columns: (keys, model, n, metrics).

    Each row is unrolled to one pair per model inside the scan stage and combined there, so the shuffle
    carries one partial result per (keys, model) and task.
    """
    keys = list(keys)
    pair = F.explode(F.array(*[F.struct(F.lit(p).alias("model"), F.col(p).cast("double").alias("p")) for p in preds]))
    long = df.where(F.col(y).isNotNull()).select(*keys, F.col(y), pair.alias("__e")).select(*keys, y, "__e.*")
    return all_metrics(long, [*keys, "model"], y, "p", names=names)


def forecast_report(panel: DataFrame, entity: str, year: str, y: str, city: str, min_n: int = 5) -> DataFrame:
    """Macro-averaged city scores of every closed-form forecast."""
    frame = forecast_frame(panel, entity, year, y)
    per_city = score_wide(frame, [city], y, FORECASTERS).where(F.col("n") >= min_n)
    return macro(per_city, ["model"])


def forecast_runs(panel: DataFrame, entity: str, year: str, y: str, city: str, first_test_year: int) -> DataFrame:
    """Every closed-form forecast of the test years, scored overall, per city and per test year: (scope, scope_value, model, n, metrics).

    History before ``first_test_year`` only feeds the lags. All scopes come from one aggregation; each row is unrolled to its three
    scopes inside the scan stage and combined there.
    """
    frame = forecast_frame(panel, entity, year, y).where(F.col(year) >= first_test_year)
    scopes = {"overall": F.lit("all"), "city": F.col(city).cast("string"), "test_year": F.col(year).cast("string")}
    scope = F.explode(F.array(*[F.struct(F.lit(n).alias("scope"), v.alias("scope_value")) for n, v in scopes.items()]))
    unrolled = frame.select(y, *FORECASTERS, scope.alias("__s")).select(y, *FORECASTERS, "__s.*")
    return score_wide(unrolled, ["scope", "scope_value"], y, FORECASTERS)


def run_grid(tiers: dict, models: dict, train: DataFrame, test: DataFrame, y: str, city: str, seed: int = 42,
             split_type: str = "grouped", task: str = "a", done: set | None = None) -> DataFrame:
    """Long results of every (tier, model) not in ``done``: overall, per city and macro.

    ``tiers``: tier -> feature columns; ``models``: name -> (learner name, settings). Fits are separate
    distributed jobs; the scores of a cell are one lazy frame.
    """
    out = None
    need = dict.fromkeys([y, *[c for cols in tiers.values() for c in cols]])
    with persisted(train.select(*need)) as kept:
        kept = sized(kept)
        for tier, cols in tiers.items():
            for name, (learner, params) in models.items():
                if done and (tier, name) in done:
                    continue
                pred = LEARNERS[learner](kept, cols, y, **params).predict(test)
                overall = to_long(all_metrics(pred, [], y, "pred").drop("n"), []).select(
                    F.lit("overall").alias("scope"), F.lit("all").alias("scope_value"), "metric", "value")
                cities = all_metrics(pred, [city], y, "pred")
                by_city = to_long(cities.drop("n"), [city]).select(
                    F.lit("city").alias("scope"), F.col(city).cast("string").alias("scope_value"), "metric", "value")
                mac = macro(cities.where(F.col("n") >= 5)).select(*[F.col(f"macro_{m}").alias(m) for m in METRICS])
                mac = to_long(mac, []).select(F.lit("macro").alias("scope"), F.lit("all").alias("scope_value"),
                                              "metric", "value")
                cell = overall.unionByName(by_city).unionByName(mac).select(
                    F.lit(task).alias("task"), F.lit(tier).alias("feature_set"), F.lit(name).alias("model"),
                    F.lit(seed).cast("long").alias("seed"), F.lit(split_type).alias("split_type"), "*")
                out = cell if out is None else out.unionByName(cell)
    return out
