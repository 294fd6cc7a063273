"""End-to-end jobs on hand-written sources."""

import pytest
from pyspark.sql import functions as F

from emipanel.plans import building, company
from emipanel.sources import readers

RAW_A = """Property Id,Calendar Year,Primary Property Type - Self Selected,Year Built,Property GFA - Self-Reported (ft2),Site EUI (kBtu/ft2),Weather Normalized Site EUI (kBtu/ft2),ENERGY STAR Score,Total GHG Emissions (Metric Tons CO2e),Electricity Use - Grid Purchase (kWh),Natural Gas Use (kBtu),Latitude,Longitude
1,2019,Office,1990,1000,50,1,80,10,5,6,40.7,-74.0
1,2019,Office,1990,3000,70,1,0,30,5,6,40.7,-74.0
1,2020,Office,1799,1000,1000.1,1,80,Not Available,5,6,,
2,2020,medical office,2000,-5,50,1,80,10,5,6,40.7,-74.0
3,2020,Hotel,2000,10,-1,1,80,100001,5,6,40.7,-74.0
,2020,Zoo,2000,10,5,1,80,7,5,6,,
"""
RAW_B = """OSEBuildingID,DataYear,Property Type,YearBuilt,PropertyGFATotal,SiteEUI(kBtu/sf),ENERGYSTARScore,Total GHG (kgCO2e),Electricity(kBtu),NaturalGas(therms)
9,2021,Hotel,1950,200,20,50,5000,3412,2
"""


def load(spark, tmp_path, name, text):
    (tmp_path / f"{name}.csv").write_text(text)
    raw = readers.read_csv(spark, str(tmp_path / f"{name}.csv"))
    return raw.withColumn("ingest_ordinal", F.monotonically_increasing_id())


def test_building_panel(spark, tmp_path):
    a = building.standardize_city(load(spark, tmp_path, "a", RAW_A), "nyc")
    b = building.standardize_city(load(spark, tmp_path, "b", RAW_B), "seattle")
    geo = spark.createDataFrame([("nyc", "nyc_row_5", 40.0, -74.0), ("seattle", "seattle_9", 10.0, 10.0)],
                                "city string, building_id string, latitude double, longitude double")
    got = {(r["building_id"], r["year"]): r for r in building.build_panel([a, b], geo).collect()}
    assert set(got) == {("nyc_1", 2019), ("nyc_row_5", 2020), ("seattle_9", 2021)}
    one = got["nyc_1", 2019]
    assert (one["gross_floor_area_sqft"], one["site_eui_kbtu_sqft"], one["energy_star_score"], one["total_ghg_emissions_mtco2e"]) == (
        2000.0, 60.0, 80.0, 20.0)
    assert got["nyc_row_5", 2020]["coord_source"] == "geocoded_address" and got["nyc_row_5", 2020]["property_type"] == "Other"
    west = got["seattle_9", 2021]
    assert west["total_ghg_emissions_mtco2e"] == 5.0 and west["electricity_kwh"] == pytest.approx(1000.0)
    assert west["natural_gas_kbtu"] == 200.0 and west["latitude"] is None and west["coord_source"] == "missing"


def test_climate_is_computed_once_per_grid_cell(spark):
    panel = spark.createDataFrame([("nyc", "a", 2020, 40.71, -74.01), ("nyc", "b", 2020, 0.0, 0.0), ("boston", "c", 2020, None, None)],
                                  "city string, building_id string, year int, latitude double, longitude double")
    daily = spark.range(366).selectExpr("'40.5000|-74.0000|2020' as query_key", "10.0D as temp", "50.0D as humidity", "100.0D as solar", "3.0D as wind")
    got = {r["building_id"]: r for r in building.climate_table(panel, daily).collect()}
    assert got["a"]["hdd_18c"] == pytest.approx(366 * 8.0) and got["a"]["annual_ssrd_mj_m2_day"] == pytest.approx(8.64)
    assert got["a"]["climate_source"] == "building_grid" and got["b"]["climate_source"] == "city_fallback"
    assert got["b"]["hdd_18c"] == got["a"]["hdd_18c"] and got["c"]["hdd_18c"] is None


def test_company_baseline_and_splits(spark):
    accounts = spark.createDataFrame([("DE", "steel", 2022, 2000.0, 1.0), ("DE", "iron", 2022, 160.0, 1.0), ("DE", "school", 2022, 5.0, 1.0)],
                                     "region string, sector string, year int, ghg_kgco2e double, va_meur double")
    cross = spark.createDataFrame([("steel", "Industrials"), ("iron", "Industrials"), ("school", "Other")], "detail string, bucket string")
    factors = company.factor_table(accounts, cross)
    assert factors.count() == 1 and factors.first()["factor"] == pytest.approx(2.16 / (2 * 1.08))
    disc = spark.createDataFrame([(i, 2023, "DE", "Services", 100.0 + i, None) for i in range(40)] + [(99, 2023, "DE", "Services", None, None)],
                                 "nz_id int, reporting_year int, country_iso2 string, sics_sector string, scope1_tco2e double, scope2_lb_tco2e double")
    tick = spark.createDataFrame([(i, f"T{i}") for i in range(100)], "nz_id int, ticker string")
    fin = spark.createDataFrame([(f"T{i}", "Energy", 92e6, "EUR" if i else "???") for i in range(100)],
                                "ticker string, yf_sector string, revenue_usd double, currency string")
    base = company.factor_baseline(disc, tick, fin, factors)
    rows = {r["nz_id"]: r for r in base.collect()}
    assert rows[1]["revenue_musd"] == pytest.approx(100.0) and rows[1]["scope12_pred_tco2e"] == pytest.approx(100.0)
    assert rows[0]["revenue_musd"] is None and rows[99]["scope12_actual_tco2e"] is None
    fpanel = spark.createDataFrame([("T1", 2023, 7.0)], "ticker string, year int, revenue_musd double")
    summ = spark.createDataFrame([("T1", "text")], "ticker string, business_summary string")
    merged = company.merge_time_aligned(base, fpanel, summ, ["ticker"])
    kept, audit = company.modelling_rows(merged)
    out = {r["nz_id"]: r for r in kept.collect()}
    assert len(out) == 40 and audit.count() == 0 and out[1]["revenue_best_musd"] == 7.0 and out[1]["financials_timevary"]
    assert not out[0]["subset_strict"] and out[1]["subset_strict"] and out[1]["has_factor_baseline"]
    assert sorted(r["split"] for r in out.values()).count("train") == 32


def test_master_adds_only_unknown_companies(spark):
    main = spark.createDataFrame([("Acme ", 2020, 1)], "company_name string, reporting_year int, nz_id int")
    other = spark.createDataFrame([("acme", 2021), ("New", 2021)], "company_name string, reporting_year int")
    got = company.build_master(main, [other], [other])
    assert sorted(r["company_name"] for r in got.collect()) == ["Acme ", "New", "New", "acme"]
    assert "scope3_c15_tco2e" in got.columns
