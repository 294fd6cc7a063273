"""Sorting and top-k. A limit is used only where it is the feature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def order_by(df: DataFrame, keys) -> DataFrame:
    return df.orderBy(*keys)


def limit(df: DataFrame, n: int, order) -> DataFrame:
    """First n rows of a total order, for smoke runs."""
    return df.orderBy(*order).limit(n)


def top_k(df: DataFrame, c: str, k: int, tie=(), absolute: bool = False) -> DataFrame:
    value = F.abs(F.col(c)) if absolute else F.col(c)
    return df.orderBy(value.desc(), *tie).limit(k)


def order_by_reference_model(df: DataFrame, group: str, model: str, reference: str, score: str) -> DataFrame:
    """Groups sorted by the score one reference model has there."""
    ref = df.where(F.col(model) == reference).groupBy(group).agg(F.max(score).alias("reference_score"))
    return df.join(ref, group, "left").orderBy(F.desc_nulls_last("reference_score"), group, model)
