"""History features. Panels hold one row per (entity, year), so a window partition is as long as the
entity has years; all features of one call share one window specification and one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emipanel.operators.skew import BUCKET_ROWS, attach_row, dense_ids, exact_quantiles, join_null_safe, rank_in_group


def _w(entity: str, year: str):
    return Window.partitionBy(entity).orderBy(year)


def lags(df: DataFrame, entity: str, year: str, c: str, n: int = 3, prefix: str | None = None) -> DataFrame:
    """Values of the n previous rows (rows, not calendar years: gaps are not filled)."""
    p = prefix or f"{c}_lag"
    return df.withColumns({f"{p}{k}": F.lag(c, k).over(_w(entity, year)) for k in range(1, n + 1)})


def hist_mean(df: DataFrame, entity: str, year: str, c: str, n: int = 3, name: str = "mean_hist") -> DataFrame:
    return df.withColumn(name, F.avg(c).over(_w(entity, year).rowsBetween(-n, -1)))


def hist_std(df: DataFrame, entity: str, year: str, c: str, n: int = 3, name: str = "std_hist") -> DataFrame:
    """Sample deviation of the previous n rows; fewer than two values give 0."""
    return df.withColumn(name, F.coalesce(F.stddev_samp(c).over(_w(entity, year).rowsBetween(-n, -1)), F.lit(0.0)))


def change_1y(df: DataFrame, lag1: str, lag2: str, name: str = "change_1y") -> DataFrame:
    return df.withColumn(name, F.col(lag1) - F.col(lag2))


def lag_features(df: DataFrame, entity: str, year: str, target: str, n: int = 3, climate=(),
                 prefix: str = "lag") -> DataFrame:
    """Target lags, rolling mean and deviation, one-year change, and lags of climate channels.

    The contemporaneous climate columns are removed: they are not known ahead of time.
    """
    w = _w(entity, year)
    past = w.rowsBetween(-n, -1)
    new = {f"{prefix}{k}": F.lag(target, k).over(w) for k in range(1, n + 1)}
    new["mean_hist"] = F.avg(target).over(past)
    new["std_hist"] = F.coalesce(F.stddev_samp(target).over(past), F.lit(0.0))
    for c in climate:
        new.update({f"{c}_lag{k}": F.lag(c, k).over(w) for k in range(1, n + 1)})
    out = df.withColumns(new).withColumn("change_1y", F.col(f"{prefix}1") - F.col(f"{prefix}2"))
    return out.drop(*climate)


def climate_lags(df: DataFrame, entity: str, year: str, channels, n: int = 3) -> DataFrame:
    w = _w(entity, year)
    return df.withColumns({f"{c}_lag{k}": F.lag(c, k).over(w) for c in channels
                           for k in range(1, n + 1)}).drop(*channels)


def leads(df: DataFrame, entity: str, year: str, c: str, horizons=(1, 2, 3), prefix: str = "target_h") -> DataFrame:
    return df.withColumns({f"{prefix}{h}": F.lead(c, h).over(_w(entity, year)) for h in horizons})


def number_rows(df: DataFrame, group, h, tie, name: str = "row_no", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """1-based number inside each group in hash order, without gathering a hot group."""
    return rank_in_group(df, group, h, tie, name, "__size", bucket_rows).drop("__size")


def shard_ids(df: DataFrame, order, name: str = "row_id") -> DataFrame:
    return dense_ids(df, order, name)


def with_count(df: DataFrame, keys, name: str = "group_rows") -> DataFrame:
    """Group size on every row: counted map-side, then joined, so a hot group is never one window."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return join_null_safe(df, n, keys, "left")


def quantile_zone(df: DataFrame, c: str, probs=(0.25, 0.5, 0.75), name: str = "zone") -> DataFrame:
    """Zone 1..n+1 by cut points of the table itself; a value equal to a cut point goes up."""
    cuts = [f"__cut{i}" for i in range(len(probs))]
    out = attach_row(df, exact_quantiles(df, [], c, list(probs), cuts))
    zone = F.lit(1)
    for cut in cuts:
        zone = zone + F.when(F.col(c) >= F.col(cut), 1).otherwise(0)
    return out.withColumn(name, F.when(F.col(c).isNotNull(), zone)).drop(*cuts)


def growth(df: DataFrame, entity: str, year: str, c: str, name: str = "delta") -> DataFrame:
    """First difference to the previous row."""
    return df.withColumn(name, F.col(c) - F.lag(c, 1).over(_w(entity, year)))


def mean_growth(history: Column | str) -> Column:
    """Mean first difference of an oldest-to-newest array: the ends decide."""
    h = F.col(history) if isinstance(history, str) else history
    return F.try_divide(F.try_element_at(h, F.lit(-1)) - F.try_element_at(h, F.lit(1)), F.size(h) - 1)


def history_array(lag_cols) -> Column:
    """Oldest-to-newest array without leading nulls; an empty history is [0.0].

    ``lag_cols`` runs from the oldest lag to lag 1.
    """
    raw = F.array(*[F.col(c).cast("double") for c in lag_cols])
    present = F.transform(raw, lambda v, i: F.when(v.isNotNull(), i))
    first = F.array_min(F.array_compact(present))
    kept = F.slice(raw, first + 1, F.size(raw) - first)
    return F.when(first.isNull(), F.array(F.lit(0.0))).otherwise(kept)
