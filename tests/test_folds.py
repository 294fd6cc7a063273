"""Fold scores from moments against fits and predictions row by row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from emipanel.operators import folds


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    n = 600
    group = rng.choice(["a", "b", "c", "d"], n, p=[0.5, 0.3, 0.15, 0.05])
    x1, x2 = rng.normal(50, 3, n), rng.normal(size=n)
    y = 2.0 * x1 - x2 + rng.normal(size=n) + 5
    rows = [(str(g), float(a), float(b), 7.0, float(t), bool(h)) for g, a, b, t, h in zip(group, x1, x2, y, rng.random(n) < 0.2)]
    rows += [("a", None, 1.0, 7.0, 1.0, False), ("b", float("nan"), 1.0, 7.0, 1.0, True), (None, 50.0, 0.0, 7.0, 104.0, False), (None, 51.0, 0.5, 7.0, 106.0, None)]
    frame = spark.createDataFrame(rows, "g string, x1 double, x2 double, same double, y double, held boolean").repartition(5)
    return rows, frame


def _fit(train):
    a = np.array([[1, r[1], r[2]] for r in train])
    return np.linalg.lstsq(a, np.array([r[4] for r in train]), rcond=None)[0]


def _rmse(b, rows):
    return float(np.sqrt(np.mean([(r[4] - b @ [1, r[1], r[2]]) ** 2 for r in rows])))


def _good(rows):
    return [r for r in rows if r[1] is not None and r[1] == r[1]]


def test_leave_one_out_equals_fits_by_hand(data):
    rows, frame = data
    good = _good(rows)
    got = {r["g"]: r for r in folds.fold_scores(folds.leave_one_out_folds(folds.group_moments(frame, ["g"], ["x1", "x2"], "y", F.col("held")), "g", 2), 2).collect()}
    assert set(got) == {"a", "b", "c", "d", None}
    for g, row in got.items():
        train, test = [r for r in good if r[0] != g and not r[5]], [r for r in good if r[0] == g]
        val, b = [r for r in good if r[0] != g and r[5]], _fit(train)
        assert (row["n_train"], row["n_val"], row["n_test"]) == (len(train), len(val), len(test))
        assert row["coef"] == pytest.approx(list(b[1:]), abs=1e-7) and row["intercept"] == pytest.approx(b[0], abs=1e-5)
        assert row["rmse"] == pytest.approx(_rmse(b, test)) and row["val_rmse"] == pytest.approx(_rmse(b, val))


def test_feature_without_variance_and_small_groups(data):
    _, frame = data
    moments = folds.group_moments(frame, ["g"], ["x1", "x2", "same"], "y")
    rows = folds.fold_scores(folds.leave_one_out_folds(moments, "g", 3, 10), 3).collect()
    assert {r["g"] for r in rows} == {"a", "b", "c", "d"} and all(r["coef"][2] == 0.0 and r["n_val"] == 0 and r["val_rmse"] is None for r in rows)


def test_transfers_and_their_rows(spark, data):
    rows, frame = data
    good = _good(rows)
    pairs = spark.createDataFrame([("two", "a", "c"), ("two", "b", "c"), ("all", None, "d"), ("gone", "zzz", "a")], "fold string, source string, target string")
    got = {r["fold"]: r for r in folds.fold_scores(folds.transfer_score_folds(folds.group_moments(frame, ["g"], ["x1", "x2"], "y"), pairs, "g", 2), 2).collect()}
    assert set(got) == {"two", "all"}
    for fold, source, target in (("two", ("a", "b"), "c"), ("all", ("a", "b", "c", None), "d")):
        b = _fit([r for r in good if r[0] in source])
        assert got[fold]["rmse"] == pytest.approx(_rmse(b, [r for r in good if r[0] == target]))
    counts = {(r["fold"], r["role"]): r["count"] for r in folds.transfer_rows(frame, pairs, "g").groupBy("fold", "role").count().collect()}
    size = lambda *gs: sum(r[0] in gs for r in rows)
    assert counts == {("two", "train"): size("a", "b"), ("two", "test"): size("c"), ("all", "train"): size("a", "b", "c", None), ("all", "test"): size("d"), ("gone", "test"): size("a")}


def test_few_shots_join_the_training_rows(spark, data):
    rows, frame = data
    good = _good(rows)
    frame = frame.withColumn("row", F.xxhash64("x1", "x2", "y"))
    roles = frame.where("g = 'c'").withColumn("k", F.lit(1)).withColumn("role", F.when(F.col("x2") > 0, "shot").otherwise("test"))
    row = folds.fold_scores(folds.few_shot_folds(frame, roles, "g", ["x1", "x2"], "y"), 2).collect()
    b = _fit([r for r in good if r[0] != "c" or r[2] > 0])
    assert len(row) == 1 and row[0]["rmse"] == pytest.approx(_rmse(b, [r for r in good if r[0] == "c" and r[2] <= 0]))


def test_one_scan_of_the_rows(data):
    _, frame = data
    plan = folds.leave_one_out_folds(folds.group_moments(frame, ["g"], ["x1"], "y"), "g", 1)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
