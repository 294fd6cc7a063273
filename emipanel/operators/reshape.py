"""Unions, fixed schemas, wide/long conversions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emipanel.functions.core import as_col
from emipanel.functions.numeric import all_not_null
from emipanel.schema import conform  # noqa: F401  (part of this module's interface)
from emipanel.sources.readers import load_results


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def melt_years(df: DataFrame, ids, years, year: str = "year", value: str = "value") -> DataFrame:
    """One row per (ids, year column); null cells stay rows."""
    out = df.unpivot(list(ids), [str(y) for y in years], "__y", value)
    return out.select(*ids, F.col("__y").cast("long").alias(year), value)


def balanced_panel(df: DataFrame, keys, year: str, value: str, years, order) -> DataFrame:
    """Wide table of the entities observed in every year; null keys are dropped.

    The first value by ``order`` is used where a year occurs twice; the years are given, so the
    pivot needs no extra pass.
    """
    src = df.dropna(subset=list(keys)).where(F.col(year).isin(list(years)))
    rank = F.struct(*[as_col(o) for o in order])
    wide = src.groupBy(*keys).agg(*[
        F.min_by(F.when(F.col(year) == y, F.col(value)),
                 F.when((F.col(year) == y) & F.col(value).isNotNull(), rank)).alias(str(y)) for y in years])
    return wide.where(all_not_null([F.col(f"`{y}`") for y in years]))


def feature_diff(cols, drop) -> list[str]:
    gone = set(drop)
    return [c for c in cols if c not in gone]


def feature_common(a, b) -> list[str]:
    other = set(b)
    return [c for c in a if c in other]


def align_columns(a: DataFrame, b: DataFrame, fill: float = 0.0, keep=()) -> tuple[DataFrame, DataFrame]:
    """Both frames with the union of their feature columns, missing ones filled."""
    names = sorted((set(a.columns) | set(b.columns)) - set(keep))

    def to(df):
        return df.select(*[c for c in keep if c in df.columns],
                         *[F.col(c) if c in df.columns else F.lit(fill).alias(c) for c in names])

    return to(a), to(b)


def results_to_long(df: DataFrame, keys, prefixes=("r2_", "mae_"), city: str = "city") -> DataFrame:
    """Ragged ``<metric>_<city>`` columns to (keys, metric, city, value)."""
    cols = [c for c in df.columns if c.startswith(tuple(prefixes))]
    pattern = "^(" + "|".join(p.rstrip("_") for p in prefixes) + ")_(.+)$"
    long = df.unpivot(list(keys), cols, "__c", "value")
    return long.select(*keys, F.regexp_extract("__c", pattern, 1).alias("metric"),
                       F.regexp_extract("__c", pattern, 2).alias(city), "value")


def merge_results(spark: SparkSession, paths) -> DataFrame:
    return union_all(*[load_results(spark, p) for p in paths])
