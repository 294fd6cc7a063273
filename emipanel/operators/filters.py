"""Row predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emipanel.functions.numeric import finite
from emipanel.operators.skew import attach_row, join_null_safe


def with_target(df: DataFrame, y: str) -> DataFrame:
    return df.where(F.col(y).isNotNull())


def positive_target(df: DataFrame, y: str) -> DataFrame:
    return df.where(F.col(y) > 0)


def positive_or_null(df: DataFrame, c: str) -> DataFrame:
    return df.where(F.col(c).isNull() | (F.col(c) > 0))


def any_target(df: DataFrame, cols) -> DataFrame:
    return df.where(F.coalesce(*[F.col(c) for c in cols]).isNotNull())


# Plausible ranges of a target (tonnes).
SCOPE12_PANEL = (10.0, 5e8)
SINGLE_SCOPE = (1.0, 5e8)
SCOPE3 = (100.0, 2e9)


def outlier_window(df: DataFrame, c: str, low: float, high: float, keep_null: bool = False) -> DataFrame:
    inside = F.col(c).between(F.lit(low), F.lit(high))
    return df.where(inside | F.col(c).isNull()) if keep_null else df.where(inside)


def outlier_rules(c: str, low: float = SCOPE12_PANEL[0], high: float = SCOPE12_PANEL[1]) -> list:
    """Named reasons for dropping a target value, for the audit sink."""
    y = F.col(c)
    return [("too_high", y > F.lit(high)), ("zero", y == 0), ("too_low", (y > 0) & (y < F.lit(low)))]


def in_set(df: DataFrame, c: str, values) -> DataFrame:
    return df.where(F.col(c).isin(list(values)))


def year_between(df: DataFrame, year: str, first: int, last: int) -> DataFrame:
    return df.where(F.col(year).between(first, last))


def usable_embeddings(df: DataFrame, status: str = "status", source: str = "img_source") -> DataFrame:
    return df.where((F.col(status) == "ok") & (F.col(source) == "building_patch"))


def with_prefix(df: DataFrame, c: str, prefix: str) -> DataFrame:
    return df.where(F.col(c).startswith(prefix))


def having_count(df: DataFrame, keys, n: int) -> DataFrame:
    """Rows of groups with at least ``n`` rows (count combined map-side, then a semi join)."""
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= n).select(*keys)
    return join_null_safe(df, big, keys, "left_semi")


def min_years(df: DataFrame, entity: str, year: str, n: int) -> DataFrame:
    long = (df.groupBy(entity).agg(F.count_distinct(year).alias("__n"))
            .where(F.col("__n") >= n).select(entity))
    return df.join(long, entity, "left_semi")


def turning_points(df: DataFrame, last: str, before: str, threshold: float = 0.08) -> DataFrame:
    """Entities whose log target moved by more than ``threshold`` in the last step."""
    return df.where(F.abs(F.col(last) - F.col(before)) > F.lit(threshold))


def finite_pairs(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.where(finite(y) & finite(p))


def all_null_columns(train: DataFrame, cols) -> list[str]:
    """Columns without any value in ``train`` (one pass; one row comes to the driver)."""
    row = train.agg(*[F.count(c).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] == 0]


def drop_all_null(train: DataFrame, cols) -> list[str]:
    gone = set(all_null_columns(train, cols))
    return [c for c in cols if c not in gone]


def require_lag1(df: DataFrame, lag1: str = "lag1") -> DataFrame:
    """Must run before imputation, which would otherwise invent a history."""
    return df.where(F.col(lag1).isNotNull())


def share_kept(df: DataFrame, kept: DataFrame) -> DataFrame:
    total = df.agg(F.count(F.lit(1)).alias("rows_before"))
    return attach_row(kept.agg(F.count(F.lit(1)).alias("rows_after")), total)
