"""Helpers shared by the column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """NaN is the sources' only missing marker; Spark aggregates skip NULL, not NaN."""
    c = as_col(c)
    return F.when(~F.isnan(c), c)


def hash32(seed, *keys) -> Column:
    """32-bit number from an md5 prefix: reproducible, uniform, the same in any SQL engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[as_col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
