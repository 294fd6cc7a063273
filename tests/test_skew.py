"""The skew-safe primitives give what the plain definitions give."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from emipanel.functions import hash32
from emipanel.operators import skew
from emipanel.operators.skew import (attach_row, dense_ids, exact_median, exact_quantiles, first_per_key, join_null_safe, lowest_by_hash, rank_in_group,
                                     smallest_mode)

PROBS = [0.0, 0.025, 0.25, 0.5, 0.975, 1.0]


@pytest.mark.parametrize("sketch", [5, 50, 10_000])
def test_quantiles_by_group(spark, sketch, monkeypatch):
    """A coarse sketch leaves most values of the large group outside the brackets."""
    monkeypatch.setattr(skew, "SKETCH", sketch)
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": np.r_[np.zeros(900), rng.integers(1, 40, 300)].astype(int),
                        "v": np.r_[rng.lognormal(3, 5, 500), -rng.lognormal(1, 3, 300), np.zeros(100), rng.normal(1e6, 1e-3, 300)]})
    got = exact_quantiles(spark.createDataFrame(pdf), ["k"], "v", PROBS).toPandas().set_index("k").sort_index()
    want = pdf.groupby("k").v.quantile(PROBS).unstack()
    np.testing.assert_allclose(got.to_numpy(), want.to_numpy(), rtol=1e-12, atol=1e-12)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=64, min_value=-1e300, max_value=1e300), min_size=1, max_size=40))
def test_global_median_of_any_doubles(spark, values):
    got = exact_median(spark.createDataFrame([(v,) for v in values], "v double"), [], "v").first()[0]
    assert got == pytest.approx(float(np.median(values)), rel=1e-9, abs=1e-300)


@pytest.mark.parametrize("values", [[1, 2, "inf"], [1, "inf", "inf"], [1, 2, "nan"], ["-inf", "-inf", 5], ["-inf", 0, 1, "inf"]])
def test_infinities_and_nan_agree_for_every_group_size(spark, values, monkeypatch):
    df = spark.createDataFrame([("a", float(v)) for v in values] * 200, "k string, v double")
    plain = exact_quantiles(df, ["k"], "v", [0.25, 0.5, 1.0]).first()
    monkeypatch.setattr(skew, "SKETCH", 20)
    coarse = exact_quantiles(df, ["k"], "v", [0.25, 0.5, 1.0]).first()
    built_in = df.groupBy("k").agg(*[F.percentile("v", p) for p in (0.25, 0.5, 1.0)]).first()
    np.testing.assert_array_equal(np.array(coarse[1:]), np.array(plain[1:]))
    np.testing.assert_array_equal(np.array(plain[1:]), np.array(built_in[1:]))


def test_values_that_a_second_pass_computes_a_little_differently(spark):
    """As sums of doubles do whose parts arrive in another order."""
    @F.udf("double")
    def computed_again(v):
        import os
        return v * (1 + int.from_bytes(os.urandom(2), "big") * 1e-16)

    values = [1.1 if i % 3 == 0 else (i - 30000) / 7 for i in range(60000)]
    few = spark.range(9).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    many = spark.createDataFrame([(0, v) for v in values], "k int, v double")
    for df in (few, many):
        got = exact_quantiles(df.withColumn("v", computed_again.asNondeterministic()("v")), ["k"], "v", PROBS).toPandas().set_index("k").sort_index()
        want = df.toPandas().groupby("k").v.quantile(PROBS).unstack()
        np.testing.assert_allclose(got.to_numpy(), want.to_numpy(), rtol=1e-9)


def test_whole_column_ties_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(skew, "SKETCH", 50)
    values = [0.0] * 3000 + [1.0] * 10 + list(np.linspace(2, 3, 5000))
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(5)
    got = exact_quantiles(df, [], "v", PROBS).first()
    np.testing.assert_allclose(list(got), np.quantile(values, PROBS), rtol=1e-12)
    assert exact_quantiles(df.filter("false"), [], "v", PROBS).count() == 0 and exact_quantiles(df.filter("false"), ["v"], "v", [0.5]).count() == 0


def test_defining_a_query_starts_no_job(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 as g", "cast(id as double) as v")
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    exact_quantiles(df, ["g"], "v", [0.5])
    rank_in_group(df, ["g"], hash32(1, "id"), ["id"])
    assert set(tracker.getJobIdsForGroup(None)) == before


def test_null_keys_and_values(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None), ("b", 2.0)], "k string, v double")
    got = {r["k"]: r["median"] for r in exact_median(df, ["k"], "v").collect()}
    assert got == {None: 2.0, "b": 2.0}
    joined = join_null_safe(df, spark.createDataFrame([(None, 9)], "k string, w int"), ["k"])
    assert sorted((r["k"] or "", r["w"]) for r in joined.where("w is not null").collect()) == [("", 9), ("", 9)]


def test_mode_takes_smallest_tie(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", "x"), ("a", "y"), ("b", None)], "k string, v string")
    assert [tuple(r) for r in smallest_mode(df, ["k"], "v").collect()] == [("a", "x")]


def test_first_per_key_ties_on_order(spark):
    df = spark.createDataFrame([("a", 2, "p"), ("a", 1, "q"), ("a", 1, "r")], "k string, o int, v string")
    assert first_per_key(df, ["k"], ["o", "v"]).first()["v"] == "q"


@pytest.mark.parametrize("bucket_rows", [1, 100, 10**9])
def test_ranks_are_a_permutation_of_each_group(spark, bucket_rows):
    pdf = pd.DataFrame({"g": ["hot"] * 3000 + ["cold"] * 5 + [None] * 7, "id": range(3012)})
    got = rank_in_group(spark.createDataFrame(pdf), ["g"], hash32(1, "id"), ["id"], bucket_rows=bucket_rows).toPandas()
    for _, part in got.groupby("g", dropna=False):
        assert sorted(part.rank_in_group) == list(range(1, len(part) + 1))
        assert set(part.group_size) == {len(part)}
        order = part.id.map(lambda i: int(hashlib.md5(f"1|{i}".encode()).hexdigest()[:8], 16)).rank()
        assert list(part.rank_in_group) == list(order.astype(int))


def test_dense_ids_follow_the_sort(spark):
    df = spark.range(5000).selectExpr("cast(id * 7919 % 5000 as int) as v").repartition(7)
    got = dense_ids(df, ["v"]).toPandas().sort_values("v")
    assert list(got.row_id) == list(range(5000))


def test_attach_row_adds_one_row_to_all(spark):
    df = spark.range(4)
    assert {r["m"] for r in attach_row(df, df.selectExpr("max(id) as m")).collect()} == {3}


def test_lowest_by_hash_keeps_the_lowest_and_few_others(spark):
    df = spark.range(20_000).selectExpr("id", "case when id < 19000 then 'hot' when id < 19990 then 'cold' end as g")
    h = hash32(3, "id")
    kept = lowest_by_hash(df, ["g"], h, 50).withColumn("h", h).toPandas()
    everything = df.withColumn("h", h).toPandas()
    for name, part in everything.groupby("g", dropna=False):
        mine = kept[kept.g == name] if isinstance(name, str) else kept[kept.g.isna()]
        assert set(part.nsmallest(50, "h").id) <= set(mine.id) and len(mine) <= 60
    assert len(lowest_by_hash(df, [], h, 100).toPandas()) <= 110 and lowest_by_hash(df, [], h, 10**6).count() == 20_000
