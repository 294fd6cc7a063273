"""Least squares over many folds from one pass: every group's sums of products are added and taken away, rows are never repeated.

A group's moments are the sums of all products of (1, features, target). Moments of disjoint rows add, so what a fold trains on is the
total less the held-out group, or the sum of its source groups, and both the fit and its squared errors follow from moments alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emipanel.functions.core import as_col
from emipanel.operators.skew import attach_row


def _size(n_features: int) -> int:
    return (n_features + 2) * (n_features + 3) // 2


def group_moments(df: DataFrame, keys, features, target, held=None) -> DataFrame:
    """Per group: ``fit`` and ``held``, moments of the rows outside and inside ``held`` (a condition; without it all rows are in ``fit``).

    Features and target are columns or expressions; rows in which one of them is null or NaN are left out. One aggregation,
    combined before the shuffle: a row per group and task leaves a task, whatever the group's size.
    """
    keys = list(keys)
    values = [as_col(c).cast("double") for c in (*features, target)]
    names = [f"__v{i}" for i in range(len(values))]
    kept = F.lit(False) if held is None else F.coalesce(as_col(held), F.lit(False))
    rows = df.select(*keys, *[v.alias(n) for v, n in zip(values, names)], kept.alias("__held"))
    for n in names:
        rows = rows.where(F.col(n).isNotNull() & ~F.isnan(n))
    z = [F.lit(1.0), *map(F.col, names)]
    products = [z[i] * z[j] for i in range(len(z)) for j in range(i, len(z))]

    def sums(side: Column):
        return [F.coalesce(F.sum(F.when(side, p)), F.lit(0.0)) for p in products]

    # a plain list of sums, then arrays: an array inside an aggregate would be built for every row
    outside = [s.alias(f"__f{i}") for i, s in enumerate(sums(~F.col("__held")))]
    inside = [s.alias(f"__h{i}") for i, s in enumerate(sums(F.col("__held")))] if held is not None else []
    out = rows.groupBy(*keys).agg(*outside, *inside)
    nothing = [F.lit(0.0)] * len(products)
    return out.select(*keys, F.array(*[f"__f{i}" for i in range(len(products))]).alias("fit"),
                      F.array(*([f"__h{i}" for i in range(len(products))] if held is not None else nothing)).alias("held"))


def _plus(a, b) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _minus(a, b) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def _summed(moments: DataFrame, keys, columns, size: int) -> DataFrame:
    """Sums of moment columns, element by element."""
    sums = moments.groupBy(*keys).agg(*[F.sum(F.get(c, F.lit(i))).alias(f"__{c}{i}") for c in columns for i in range(size)])
    return sums.select(*keys, *[F.array(*[f"__{c}{i}" for i in range(size)]).alias(c) for c in columns])


def leave_one_out_folds(moments: DataFrame, key: str, n_features: int, min_rows: int = 1) -> DataFrame:
    """Per group a fold that tests on it and trains on all others: ``key``, train, val (the others' held rows) and test."""
    total = _summed(moments, [], ["fit", "held"], _size(n_features)).select(F.col("fit").alias("__fit"), F.col("held").alias("__held"))
    out = attach_row(moments, total).select(key, _minus("__fit", "fit").alias("train"), _minus("__held", "held").alias("val"), _plus("fit", "held").alias("test"))
    return _enough(out, min_rows)


def transfer_score_folds(moments: DataFrame, pairs: DataFrame, key: str, n_features: int, min_rows: int = 1) -> DataFrame:
    """Folds of directed transfers ``pairs(fold, source, target)``, several sources being rows; a null source means all others."""
    size = _size(n_features)
    total = _summed(moments, [], ["fit", "held"], size).select(F.col("fit").alias("__fit"), F.col("held").alias("__held"))
    source = moments.select(F.col(key).alias("source"), F.col("fit").alias("sf"), F.col("held").alias("sh"))
    target = moments.select(F.col(key).alias("target"), F.col("fit").alias("tf"), F.col("held").alias("th"))
    out = attach_row(pairs.join(target, "target").join(source, "source", "left"), total)
    others, known = F.col("source").isNull(), F.col("sf").isNotNull()
    out = out.where(others | known).select("fold", "target", F.when(others, _minus("__fit", "tf")).otherwise(F.col("sf")).alias("train"),
                                           F.when(others, _minus("__held", "th")).otherwise(F.col("sh")).alias("val"), _plus("tf", "th").alias("test"))
    # the target's moments are the same in all rows of a fold
    trained = _summed(out, ["fold", "target"], ["train", "val"], size)
    return _enough(trained.join(out.groupBy("fold", "target").agg(F.first("test").alias("test")), ["fold", "target"]), min_rows)


def few_shot_folds(df: DataFrame, roles: DataFrame, key: str, features, target, held=None, min_rows: int = 1) -> DataFrame:
    """Folds of ``splits.few_shot`` roles (rows of target groups with k and role): trained on all other groups and the target's shots."""
    size = _size(len(features))
    groups = group_moments(df, [key], features, target, held)
    shots = group_moments(roles.where(F.col("role") == "shot"), [key, "k"], features, target, held)
    rest = group_moments(roles.where(F.col("role") == "test"), [key, "k"], features, target).select(key, "k", F.col("fit").alias("test"))
    total = _summed(groups, [], ["fit", "held"], size).select(F.col("fit").alias("__fit"), F.col("held").alias("__held"))
    shots = shots.select(key, "k", F.col("fit").alias("sf"), F.col("held").alias("sh"))
    out = attach_row(rest.join(shots, [key, "k"]).join(groups, key), total)
    out = out.select(key, "k", _plus(_minus("__fit", "fit"), F.col("sf")).alias("train"), _plus(_minus("__held", "held"), F.col("sh")).alias("val"), "test")
    return _enough(out, min_rows)


def _enough(folds: DataFrame, min_rows: int) -> DataFrame:
    """Folds with enough rows to train and to test."""
    return folds.where((F.get("test", F.lit(0)) >= min_rows) & (F.get("train", F.lit(0)) + F.get("val", F.lit(0)) >= min_rows))


def _centred(m: np.ndarray, p: int):
    """n, means of (features, target) and their centred products."""
    full = np.zeros((p + 2, p + 2))
    full[np.triu_indices(p + 2)] = m
    full = full + np.triu(full, 1).T
    n = full[0, 0]
    mean = full[0, 1:] / n if n else np.zeros(p + 1)
    return n, mean, full[1:, 1:] - n * np.outer(mean, mean)


def _solve(train: np.ndarray, p: int, ridge: float):
    n, mean, c = _centred(train, p)
    # on features of one scale, so that one that hardly varies is told from rounding
    scale = np.sqrt(np.maximum(np.diag(c)[:p], 0))
    scale[scale <= 1e-9 * np.sqrt(n) * (1 + np.abs(mean[:p]))] = np.inf
    gram = c[:p, :p] / np.outer(scale, scale)
    b = np.linalg.lstsq(gram + ridge * np.eye(p), c[:p, p] / scale, rcond=1e-10)[0] / scale
    return mean[p] - b @ mean[:p], b


def _errors(m: np.ndarray, intercept: float, b: np.ndarray, p: int):
    """n, squared errors, their total and the mean error of a linear fit on rows with these moments."""
    n, mean, c = _centred(m, p)
    bias = intercept + b @ mean[:p] - mean[p]
    sse = max(c[p, p] - 2 * b @ c[:p, p] + b @ c[:p, :p] @ b, 0.0) + n * bias * bias
    return n, sse, c[p, p], bias


def fold_scores(folds: DataFrame, n_features: int, ridge: float = 0.0) -> DataFrame:
    """Fit and score of every fold: its keys, n_train, n_val, n_test, rmse, r2, bias (mean of prediction less target), val_rmse,
    intercept and coef. ``ridge`` is added to the diagonal of the features' correlations. A feature without variance gets 0. ``folds``
    has a row per fold, so this is not per row of data."""
    keys = [f for f in folds.schema if f.name not in ("train", "val", "test")]
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in keys], "n_train bigint, n_val bigint, n_test bigint, rmse double, r2 double, "
                        "bias double, val_rmse double, intercept double, coef array<double>"])
    p, names = n_features, [f.name for f in keys]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                train, val, test = (np.array(getattr(row, c), float) for c in ("train", "val", "test"))
                intercept, b = _solve(train, p, ridge)
                n, sse, sst, bias = _errors(test, intercept, b, p)
                n_val, val_sse, _, _ = _errors(val, intercept, b, p)
                r2 = 1 - sse / sst if sst > 0 else float(sse == 0)
                out.append((*[getattr(row, k) for k in names], round(train[0]), round(n_val), round(n), (sse / n) ** 0.5, r2, bias,
                            (val_sse / n_val) ** 0.5 if n_val else None, intercept, b.tolist()))
            yield pd.DataFrame(out, columns=[*names, "n_train", "n_val", "n_test", "rmse", "r2", "bias", "val_rmse", "intercept", "coef"])

    return folds.mapInPandas(run, schema)


def transfer_rows(df: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """The rows themselves of every fold of ``pairs(fold, source, target)``, a table written by hand, with fold, target and role. A row is
    repeated once per fold it belongs to; nothing is shuffled."""
    folds = pairs.groupBy("fold", "target").agg(F.collect_set("source").alias("sources"), F.bool_or(F.col("source").isNull()).alias("others"))
    listed = folds.agg(F.collect_list(F.struct("fold", "target", "sources", "others")).alias("__folds"))
    rows = attach_row(df, listed).withColumn("__fold", F.explode("__folds"))
    same = F.col(key).eqNullSafe(F.col("__fold.target"))
    source = F.col("__fold.others") | F.coalesce(F.array_contains("__fold.sources", F.col(key)), F.lit(False))
    role = F.when(same, "test").when(source, "train")
    return rows.select(*df.columns, F.col("__fold.fold").alias("fold"), F.col("__fold.target").alias("target"), role.alias("role")).where(F.col("role").isNotNull())
