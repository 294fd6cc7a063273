"""Joins, duplicates, reports and windows on tiny frames."""

import random

import pytest
from pyspark.sql import functions as F

from emipanel.operators import aggregates, dedup, filters, joins, reshape, windows
from emipanel.sources import readers, sinks


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_collapse_keeps_null_keys_and_smallest_mode(spark):
    df = spark.createDataFrame([("a", 1, 1.0, "y"), ("a", 1, 2.0, "x"), (None, 1, None, None), ("b", 2, 5.0, "z")],
                               "k string, yr int, v double, t string")
    assert rows(dedup.collapse_duplicates(df, ["k", "yr"])) == rows(spark.createDataFrame(
        [("a", 1, 1.5, "x"), (None, 1, None, None), ("b", 2, 5.0, "z")], "k string, yr int, v double, t string"))


def test_collapse_of_small_and_large_keys_agrees(spark, monkeypatch):
    draw = random.Random(5)
    cells = [(draw.choice(["a", "b", None]), draw.choice([1, 2]), draw.choice([None, 0.5, 2.0, 7.25]), draw.choice(["x", "y", None])) for _ in range(90)]
    df = spark.createDataFrame([*cells, ("alone", 1, float("nan"), "z"), ("empty", 1, None, None)], "k string, yr int, v double, t string").coalesce(1)
    small = rows(dedup.collapse_duplicates(df, ["k", "yr"]))
    monkeypatch.setattr(dedup, "GATHERED", 12)  # some keys have more rows
    assert str(rows(dedup.collapse_duplicates(df, ["k", "yr"]))) == str(small)
    monkeypatch.setattr(dedup, "GATHERED", 0)
    assert str(rows(dedup.collapse_duplicates(df, ["k", "yr"]))) == str(small) and len(small) == 8


def test_ranked_dedup_falls_back_to_order(spark):
    df = spark.createDataFrame([("a", "ok", None, 2), ("a", "ok", None, 1), ("a", "no_images", 9, 0)], "k string, status string, n int, o int")
    assert dedup.ranked_dedup(df, ["k"], [F.when(F.col("status") == "ok", 1).otherwise(0), F.col("n")], "o").first()["o"] == 1


def test_upsert_and_replace(spark):
    prev = spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string")
    new = spark.createDataFrame([(2, "new"), (3, "new")], "k int, v string")
    assert rows(sinks.upsert_keep_last(prev, new, ["k"])) == [(1, "old"), (2, "new"), (3, "new")]
    assert rows(sinks.replace_partitions(prev, new, "k")) == [(1, "old"), (2, "new"), (3, "new")]


def test_audit_reasons(spark):
    df = spark.createDataFrame([(0.0,), (9.99,), (10.0,), (5e8,), (5e8 + 1,), (None,)], "y double")
    kept, audit = sinks.split_with_audit(df, filters.outlier_rules("y"))
    assert rows(kept) == [(10.0,), (500000000.0,), (None,)]
    assert rows(audit) == [(0.0, "zero"), (500000001.0, "too_high"), (9.99, "too_low")]


def test_backfill_never_changes_known_values(spark):
    df = spark.createDataFrame([("a", 1, None, 5.0), ("a", 2, 1.0, 2.0), ("a", 3, 3.0, 4.0), ("b", 1, None, None)],
                               "e string, y int, la double, lo double").withColumn("src", F.lit("file"))
    each = rows(joins.backfill_from_history(df, "e", ["la", "lo"], ["y"], "src"))
    assert each[0] == ("a", 1, 1.0, 5.0, "history_backfill") and each[2] == ("a", 3, 3.0, 4.0, "file") and each[3][2] is None
    both = rows(joins.backfill_from_history(df, "e", ["la", "lo"], ["y"], "src", together=True))
    assert both[0] == ("a", 1, 1.0, 2.0, "history_backfill")


def test_join_guard(spark):
    with pytest.raises(ValueError):
        joins.assert_preserves_rows(spark.createDataFrame([(1,), (1,)], "k int"), ["k"])
    with pytest.raises(ValueError):
        dedup.assert_unique(spark.createDataFrame([(1,), (1,)], "k int"), ["k"])


def test_preserving_join_fails_only_when_a_key_repeats(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "n")], "k int, v string")
    fine = spark.createDataFrame([(1, 5.0, [1]), (3, 6.0, None), (None, 7.0, None), (None, 8.0, None)], "k int, `w.x` double, l array<int>")
    got = joins.left_join_preserving(a, fine, ["k"])
    assert got.columns == ["k", "v", "w.x", "l"]
    assert sorted(map(tuple, got.select("v", "`w.x`", "l").collect())) == [("n", None, None), ("x", 5.0, [1]), ("y", 5.0, [1]), ("z", None, None)]
    joined = joins.left_join_preserving(a, fine.unionByName(fine.where("k = 3")), ["k"])
    with pytest.raises(Exception, match="join would multiply rows"):
        joined.write.parquet(str(tmp_path / "multiplied"))
    assert not (tmp_path / "multiplied" / "_SUCCESS").exists()


def test_audit_is_counted_while_it_is_written(spark, tmp_path):
    df = spark.createDataFrame([(0.0,), (9.99,), (10.0,), (5e8,), (5e8 + 1,), (None,)], "y double")
    assert sinks.write_with_audit(df, filters.outlier_rules("y"), str(tmp_path / "out")) == {"all": 6, "kept": 3, "too_high": 1, "zero": 1, "too_low": 1}
    again = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.outlier_reason, r.y) for r in again.collect() if r.y) == [("kept", 10.0), ("kept", 5e8), ("too_high", 5e8 + 1), ("too_low", 9.99)]


def test_replacement_refuses_duplicate_keys(spark, tmp_path):
    base = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0), (None, 1, 3.0)], "g string, k int, v double")
    fine, twice = spark.createDataFrame([("a", 2, 9.0)], base.schema), spark.createDataFrame([(None, 1, 8.0), (None, 1, 9.0)], base.schema)
    assert sinks.replace_partitions(base, fine, "g", ["g", "k"]).count() == 3
    assert sinks.replace_partitions(base, twice, "g").count() == 4
    with pytest.raises(Exception, match="keys are not unique: 1 occur"):
        sinks.replace_partitions(base, twice, "g", ["g", "k"]).write.parquet(str(tmp_path / "out"))


def _token_set(a, b):
    a, b = set(a.lower().split()), set(b.lower().split())
    m, s = min(len(" ".join(a)), len(" ".join(b))), len(" ".join(a & b))
    return 200.0 * s / (s + m) if s else 0.0


@pytest.mark.parametrize("threshold", [40, 60, 90, 100])
def test_fuzzy_match_equals_brute_force(spark, threshold):
    rng = random.Random(threshold)
    words = ["inc", "co", "group", "of", *["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(25)]]
    make = lambda: " ".join(rng.choice(words[:4] if rng.random() < 0.4 else words) for _ in range(rng.randint(1, 5)))
    left = ["acme", "Acme Inc", "inc", "", "  ", "beta foods", *[make() for _ in range(80)]]
    right = ["acme", "acme inc", "gamma acme holdings", "inc co", "beta foods inc", "", *[make() for _ in range(80)]]
    got = {r["n"]: (r["matched_name"], r["score"]) for r in joins.fuzzy_match(
        spark.createDataFrame([(x,) for x in left] * 2, "n string"), spark.createDataFrame([(x,) for x in right] * 2, "m string"), "n", "m", threshold).collect()}
    for a in left:
        score, name = min((-_token_set(a, b), b) for b in right)
        assert got[a] == ((name, pytest.approx(-score)) if -score >= threshold else (None, None)), a


def test_fuzzy_match_finds_contained_names(spark):
    def match(a, b):
        return joins.fuzzy_match(spark.createDataFrame([(a,)], "n string"), spark.createDataFrame([(b,)], "m string"), "n", "m").first()["score"]

    assert match("Acme", "Acme Inc") == 100.0 and match("Acme Holdings Inc", "acme") == 100.0 and match("Acme Inc", "Beta Inc") is None


def test_factor_join_uses_last_year(spark):
    f = spark.createDataFrame([("DE", "Energy", 2022, 2.0)], "region string, sector string, year int, factor double")
    df = spark.createDataFrame([("DE", "Energy", 2024), ("DE", "Energy", 2021), (None, "Energy", 2022)], "r string, s string, y int")
    assert [r[-1] for r in joins.factor_join(df, f, "r", "s", "y").orderBy("y").collect()] == [None, None, 2.0]


@pytest.mark.parametrize("days,gap,full", [(359, False, False), (360, False, True), (360, True, False)])
def test_degree_days_need_a_full_year(spark, days, gap, full):
    df = spark.range(days).select(F.lit("g").alias("k"), F.when(F.lit(not gap) | (F.col("id") > 0), 20.0).alias("t"))
    row = aggregates.annual_climate(df, ["k"], "t").first()
    assert (row["cdd_18c"] is not None) == full and row["annual_mean_temp_c"] == 20.0
    if full:
        assert row["hdd_18c"] == 0.0 and row["cdd_18c"] == pytest.approx(2.0 * days)


def test_intensity_without_value_added_is_null(spark):
    df = spark.createDataFrame([(1000.0, 0.0), (1080.0, 1.0)], "ghg_kgco2e double, va_meur double")
    assert [r[-1] for r in aggregates.intensity(df).collect()] == [None, pytest.approx(1.0)]


def test_coverage_tells_totals_from_null_source(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, None)], "s string, v int")
    assert rows(aggregates.coverage(df, "s", ["v"])) == [("ALL", 3, 2), ("a", 1, 1), (None, 2, 1)]


def test_lags_ignore_gap_years(spark):
    df = spark.createDataFrame([("a", 2018, 1.0), ("a", 2020, 3.0), ("a", 2021, 7.0), ("b", 2020, 5.0)], "e string, y int, t double")
    got = {(r["e"], r["y"]): r for r in windows.lag_features(df, "e", "y", "t").collect()}
    last = got["a", 2021]
    assert (last["lag1"], last["lag2"], last["lag3"], last["mean_hist"], last["change_1y"]) == (3.0, 1.0, None, 2.0, 2.0)
    assert last["std_hist"] == pytest.approx(2 ** 0.5) and got["a", 2020]["std_hist"] == 0.0 and got["b", 2020]["lag1"] is None


def test_history_array(spark):
    df = spark.createDataFrame([(None, 2.0, 3.0), (None, None, None), (1.0, None, 3.0)], "l3 double, l2 double, l1 double")
    assert [r[0] for r in df.select(windows.history_array(["l3", "l2", "l1"])).collect()] == [[2.0, 3.0], [0.0], [1.0, None, 3.0]]


def test_zone_is_right_open(spark):
    got = windows.quantile_zone(spark.createDataFrame([(float(i),) for i in range(5)], "v double"), "v").orderBy("v").collect()
    assert [r["zone"] for r in got] == [1, 2, 3, 4, 4]


def test_balanced_panel_drops_null_keys_and_gaps(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 1.0), (None, 1, 1.0), (None, 2, 2.0)], "k string, y int, v double")
    assert rows(reshape.balanced_panel(df, ["k"], "y", "v", [1, 2], ["v"])) == [("a", 1.0, 2.0)]


def test_resolver_prefers_pattern_order():
    cols = ["Site EUI (weather normalized kBtu)", "Source EUI (kBtu)", " Site EUI (kBtu/sq ft)", "Property ID"]
    rules = {"eui": [(["site eui", "kbtu"], ["weather"])], "id": ["property id"], "none": [(["zzz"], [])]}
    assert readers.resolve_columns(cols, rules) == {"eui": " Site EUI (kBtu/sq ft)", "id": "Property ID"}


def test_statement_cells(spark):
    df = spark.createDataFrame([("t", "Rev", "2020-03-31", 1.0), ("t", "Rev", "2020-12-31", 2.0), ("t", "Rev", "2021-12-31", float("nan")),
                                ("t", "Ebitda", "2020-12-31", 5.0), ("t", "Junk", "2020-12-31", 9.0)], "k string, f string, d string, v double")
    got = readers.statement_to_panel(df.withColumn("d", F.to_date("d")), ["k"], "f", "d", "v", {"Rev": "rev", "Ebitda": "ebitda"})
    assert rows(got) == [("t", 2020, 2.0, 5.0)]
