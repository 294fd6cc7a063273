"""Scalar rules on the edge rows that decide them."""

import pytest
from pyspark.sql import functions as F

from emipanel import dims
from emipanel.functions import (convert_by_header, extract_number, format_metric, grid_key, hash32, in_radius, is_retryable,
                                map_category, mj_intensity, normalize_city, normalize_metro, null_out, nan_to_null, snap,
                                strip_commas, sum_if_all, sum_unless_all_null, to_numeric_safe, utm_epsg, valid_coord, year_of)
from emipanel.functions.text import clean_text, coalesce_id, make_id, norm_name, slug
from emipanel.functions.numeric import BUILDING_RULES, clean_dash, clip_pred, safe
from emipanel.operators.joins import fx_to_musd, map_region, resolve_with_source


def column(spark, values, kind, *cols):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    rows = df.select("i", *[c.alias(f"c{j}") for j, c in enumerate(cols)]).orderBy("i").collect()
    return [r[1] if len(cols) == 1 else tuple(r)[1:] for r in rows]


def test_numbers_from_text(spark):
    raw = ["Not Available", "N/A", "NA", "", "None", "-", " 12 ", "1,200", "abc", "NaN", "1e3", "12d", None, "-.5"]
    assert column(spark, raw, "string", to_numeric_safe("v")) == [None] * 6 + [12.0, None, None, None, 1000.0, None, None, -0.5]
    assert column(spark, ["—", "7", "1,200"], "string", clean_dash("v")) == [None, 7.0, None]
    assert column(spark, ["1,200", "3", "x"], "string", strip_commas("v")) == [1200.0, 3.0, None]


def test_first_number_in_prose(spark):
    raw = ["no digits", "about -1,234.5e3 t", "12", ",", "", None, "a 7 b 8"]
    assert column(spark, raw, "string", extract_number("v")) == [None, -1234500.0, 12.0, None, None, None, 7.0]


def test_category_order(spark):
    raw = ["medical office", "Medical Office", "Other - Lodging/Residential", "Commercial", "commercial loft", "LAB", "labs",
           "medical office tower", None, "Senior high school", "strip MALL"]
    assert column(spark, raw, "string", map_category("v")) == [
        "Hospital/Medical", "Hospital/Medical", "Hotel", "Commercial (Mixed)", "Commercial (Mixed)", "Laboratory", "Other",
        "Office", None, "K-12 School", "Retail"]


def test_places(spark):
    df = spark.createDataFrame([("Carlton/South", "VIC", ""), ("city", "VIC", "1 Road VIC"), ("city", "ACT", ""), ("city", "NSW", ""),
                                ("", "nt", ""), (None, None, None), ("Box-Hill", "VIC", "")], "s string, st string, a string")
    got = df.select(normalize_city("s", "st", "a"), normalize_metro("s", "st")).collect()
    assert [r[0] for r in got] == ["melbourne", "melbourne", "canberra", "city", "darwin", "australia_unknown", "box_hill"]
    assert [r[1] for r in got] == ["melbourne", "canberra", "canberra", "canberra", "darwin", "australia_unknown", "melbourne"]


def test_rule_bounds_are_strict(spark):
    df = spark.createDataFrame([(0.0, 100000.0, 1800.0, 0.0), (1000.0, 100000.1, 2026.0, 1.0), (1000.1, -0.1, 1799.0, 50.0),
                                (-1.0, None, 2027.0, None)],
                               "site_eui_kbtu_sqft double, total_ghg_emissions_mtco2e double, year_built double, energy_star_score double")
    got = [tuple(r) for r in null_out(df, BUILDING_RULES).collect()]
    assert got == [(0.0, 100000.0, 1800.0, None), (1000.0, None, 2026.0, 1.0), (None, None, None, 50.0), (None, None, None, None)]


def test_coordinates(spark):
    df = spark.createDataFrame([(42.71, -74.01), (42.72, -74.01), (0.0, -74.0), (None, 1.0), (float("nan"), -74.0)], "la double, lo double")
    near = df.select(valid_coord("la", "lo", F.lit(40.71), F.lit(-74.01))).collect()
    assert [r[0] for r in near][1:] == [False, False, False, False]
    assert df.select(in_radius("la", "lo", F.lit(None).cast("double"), F.lit(None).cast("double"))).first()[0] is True
    assert column(spark, [0.25, 0.75, -0.25, 40.71], "double", snap("v")) == [0.0, 1.0, 0.0, 40.5]
    assert column(spark, [40.5], "double", grid_key("v", F.lit(-74.0), F.lit(2020))) == ["40.5000|-74.0000|2020"]
    assert column(spark, [-33.87, 40.71], "double", utm_epsg("v", F.lit(151.21))) == [32756, 32656]


def test_years_units_and_status(spark):
    assert column(spark, ["12/31/2012", "2015-02-01", "x"], "string", year_of("v", ["M/d/yyyy", "yyyy-MM-dd"], F.lit(1999))) == [2012, 2015, 1999]
    assert column(spark, [2000.0], "double", convert_by_header("v", "Total GHG (kgCO2e)"), convert_by_header("v", "tCO2e")) == [(2.0, 2000.0)]
    assert column(spark, [10.0], "double", mj_intensity("v", F.lit(0.0))) == [None]
    raw = ["err:Timeout", "http_503", "http_404", "http_x", "ok"]
    assert column(spark, raw, "string", is_retryable("v")) == [True, True, False, False, False]


def test_null_rules(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (2.0, 3.0)], "a double, b double")
    assert [tuple(r) for r in df.select(sum_unless_all_null("a", "b"), sum_if_all("a", "b")).collect()] == [(1.0, None), (None, None), (5.0, 5.0)]
    assert column(spark, [float("nan"), 1.0, None], "double", nan_to_null("v")) == [None, 1.0, None]
    assert column(spark, [float("inf"), 1.0], "double", safe("v")) == [None, 1.0]
    assert column(spark, [-1.0, 5.0, 99.0], "double", clip_pred("v", F.lit(4.0)), clip_pred("v", F.lit(float("inf")))) == [
        (0.0, 0.0), (5.0, 5.0), (8.0, 99.0)]
    assert column(spark, [1234.5, float("nan"), 2.5e6], "double", format_metric(F.lit("mae"), "v")) == ["1,235", "--", "2.50e+06"]


def test_lookups_with_provenance(spark):
    df = spark.createDataFrame([("Financials", "Energy", "DE", "EUR", 92.0), ("Information Not Available", " Tech ", "TH", "xxx", 1.0),
                                ("Nope", " ", "ZZ", None, 1.0)], "p string, f string, iso string, currency string, rev double")
    got = resolve_with_source(df, "p", "f").select("sector", "sector_source").collect()
    assert [tuple(r) for r in got] == [("Financial Services", "primary"), ("Tech", "fallback"), (None, None)]
    regions = spark.createDataFrame([("DE",)], "iso2 string")
    assert [r["factor_region"] for r in map_region(df, "iso", regions).collect()] == ["DE", "WA", None]
    got = fx_to_musd(df, ["rev"]).collect()
    assert got[0]["rev"] == pytest.approx(100.0) and got[0]["currency"] == "EUR" and got[1]["rev"] is None
    assert len(dims.FX_PER_USD) == 47


def test_all_white_space_is_trimmed(spark):
    raw = ["\n a\tb \r\n", "\t", None]
    assert column(spark, raw, "string", clean_text("v"), slug("v"), norm_name("v"), make_id("x_", "v"), coalesce_id("v", F.lit("St 1"))) == [
        ("a b", "a_b", "a\tb", "x_a\tb", "aus_a\tb"), ("", "", "", "x_", "aus_st_1"), ("", None, None, None, "aus_st_1")]


def test_hash_matches_md5(spark):
    import hashlib
    want = int(hashlib.md5(b"42|7").hexdigest()[:8], 16)
    assert column(spark, [7], "long", hash32(42, "v")) == [want]
