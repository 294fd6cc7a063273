"""Splits partition the rows, keep their fractions and never tear an entity apart."""

import pandas as pd
import pytest

from emipanel.operators import splits


@pytest.fixture(scope="module")
def panel(spark):
    pdf = pd.DataFrame([(f"c{i % 4 if i % 3 else 0}", i, y, ["office", "hotel"][i % 2]) for i in range(200) for y in (2018, 2019, 2020, 2021)],
                       columns=["city", "building", "year", "kind"])
    return spark.createDataFrame(pdf).cache()


def test_stratified_fractions(panel):
    got = splits.stratified_split(panel, ["city"], ["building", "year"]).toPandas()
    assert len(got) == 800 and not got.duplicated(["building", "year"]).any()
    for _, part in got.groupby("city"):
        share = part.split.value_counts()
        assert share["train"] == pytest.approx(len(part) * 0.8, abs=1) and share["test"] == pytest.approx(len(part) * 0.1, abs=1)


def test_split_ignores_row_order(panel):
    a = splits.stratified_split(panel, ["city"], ["building", "year"]).toPandas().sort_values(["building", "year"])
    b = splits.stratified_split(panel.repartition(13).orderBy("kind"), ["city"], ["building", "year"]).toPandas().sort_values(["building", "year"])
    assert list(a.split) == list(b.split)


def test_grouped_split_keeps_buildings_whole(panel):
    got = splits.grouped_split(panel, ["city", "building"], ["kind"]).toPandas()
    assert got.groupby("building").split.nunique().max() == 1
    assert set(got.split) == {"train", "val", "test"}


@pytest.mark.parametrize("n,label", [(5, "s|c"), (4, "s|_tinyRoW"), (1, "_global")])
def test_small_strata_collapse(spark, n, label):
    rest = [("s", f"x{i}") for i in range(2)] if n == 4 else []
    df = spark.createDataFrame([("s", "c")] * n + rest, "a string, b string")
    assert {r["stratum"] for r in splits.stratum_label(df, "a", "b").where("b = 'c'").collect()} == {label}


def test_folds_and_few_shot(panel):
    folds = list(splits.leave_one_out(panel, "city", 50))
    assert all(tr.count() + te.count() == 800 for _, tr, te in folds)
    sizes = {r["city"]: (r["n_train"], r["n_test"]) for r in splits.leave_one_out_sizes(panel, "city").collect()}
    assert all(a + b == 800 for a, b in sizes.values())
    shots = splits.few_shot(panel, "city", "building", ["building", "year"], ["c0"], (5, 10)).toPandas()
    assert shots[shots.role == "shot"].groupby("k").building.nunique().to_dict() == {5: 5, 10: 10}
    assert (shots.groupby(["k", "building"]).role.nunique() == 1).all()


def test_samples(panel):
    assert splits.cap_rows(panel, 37, ["building", "year"]).count() == 37
    quota = splits.quota_sample(panel, "city", "year", ["building", "year"], 40).toPandas()
    assert quota.groupby("city").size().max() == 40
    assert quota.groupby(["city", "year"]).size().min() == 10
    assert splits.one_per_group(panel, "kind", ["building", "year"]).count() == 2
    held = splits.entity_holdout(panel, "building").toPandas()
    assert held.groupby("building").split.nunique().max() == 1 and held[held.split == "test"].building.nunique() == 100
    assert splits.carve_validation(panel.where("building < 9"), "building").where("split = 'val'").count() == 0
