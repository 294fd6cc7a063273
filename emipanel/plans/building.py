"""Building panel: raw city tables to one clean row per (city, building, year)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emipanel import dims
from emipanel.functions.numeric import BUILDING_RULES, convert, convert_by_header, null_out, to_numeric_safe
from emipanel.functions.text import make_id, map_category, year_of
from emipanel.operators.aggregates import annual_climate, availability_long, validation_summary
from emipanel.operators.dedup import collapse_duplicates
from emipanel.operators.filters import any_target, positive_or_null
from emipanel.operators.joins import backfill_from_history, fan_out, location_or_fallback, merge_with_provenance
from emipanel.operators.reshape import union_all
from emipanel.schema import BUILDING_PANEL, conform
from emipanel.sources.readers import clean_headers, fallback_ids, resolve_columns, select_resolved

KEYS = ["city", "building_id", "year"]
NUMERIC = [f.name for f in BUILDING_PANEL.fields if f.name not in (*KEYS, "property_type")]

# Words that identify a column in city disclosure headers, in order of preference.
HEADER_RULES = {
    "raw_id": ["property id", (["building", "id"], []), "id"],
    "year": [(["calendar year"], []), (["data year"], []), (["datayear"], [])],
    "year_ending": [(["year ending"], [])],
    "property_type": [(["primary property type", "self"], []), (["largest property use type"], ["gross"]),
                      (["property type"], [])],
    "year_built": ["year built", "yearbuilt"],
    "gross_floor_area_sqft": [(["property gfa", "self", "ft"], []), (["dof gross floor area"], []),
                              (["gross floor area"], []), (["gross area"], []), (["gfa"], [])],
    "site_eui_kbtu_sqft": [(["site eui", "kbtu"], ["weather"]), (["siteeui", "kb"], ["wn"])],
    "source_eui_kbtu_sqft": [(["source eui", "kbtu"], ["weather"]), (["sourceeui", "kb"], ["wn"])],
    "energy_star_score": [(["energy star score"], ["alert"]), (["energystarscore"], [])],
    "total_ghg_emissions_mtco2e": [(["total", "ghg", "metric tons"], []), (["ghg emissions", "mtco2e"], []),
                                   (["total ghg", "kgco2e"], []), (["totalghgemissions"], [])],
    "electricity_kwh": [(["electricity use", "grid", "kwh"], []), (["electricity", "kwh"], [])],
    "electricity_kbtu": [(["electricity", "kbtu"], [])],
    "natural_gas_kbtu": [(["natural gas use", "kbtu"], []), (["naturalgas", "kbtu"], [])],
    "natural_gas_therms": [(["natural", "gas", "therms"], [])],
    "latitude": ["latitude"],
    "longitude": ["longitude"],
}
DATE_FORMATS = ["M/d/yyyy", "yyyy-MM-dd"]


def standardize_city(raw: DataFrame, city: str, rules: dict | None = None, ordinal="ingest_ordinal",
                     file_year: str | None = None) -> DataFrame:
    """One city's raw text table to the 14-column panel schema, in one projection."""
    rules = rules or HEADER_RULES
    raw = clean_headers(raw)
    found = resolve_columns(raw.columns, rules)
    out = select_resolved(raw.withColumn("__o", F.col(ordinal)).withColumn(
        "__fy", F.col(file_year) if file_year else F.lit(None).cast("long")), {**rules, "__o": ["__o"], "__fy": ["__fy"]})
    nums = {n: to_numeric_safe(n) for n in [*NUMERIC, "electricity_kbtu", "natural_gas_therms"] if n in out.columns}
    out = out.withColumns(nums)
    ghg = found.get("total_ghg_emissions_mtco2e", "")
    out = out.withColumns({
        "city": F.lit(city),
        "building_id": make_id(f"{city}_", "raw_id"),
        "year": F.coalesce(to_numeric_safe("year").cast("long"), year_of("year_ending", DATE_FORMATS).cast("long"),
                           F.col("__fy").cast("long")),
        "property_type": map_category("property_type"),
        "total_ghg_emissions_mtco2e": convert_by_header("total_ghg_emissions_mtco2e", ghg),
        "electricity_kwh": F.coalesce("electricity_kwh", convert("electricity_kbtu", "kbtu_to_kwh")),
        "natural_gas_kbtu": F.coalesce("natural_gas_kbtu", convert("natural_gas_therms", "therms_to_kbtu")),
    })
    return conform(fallback_ids(out, city, "__o"), BUILDING_PANEL)


def clean_panel(combined: DataFrame) -> DataFrame:
    """Rule-based nulling, area filter, duplicate collapse, target filter, in this order."""
    out = null_out(combined, BUILDING_RULES)
    out = positive_or_null(out, "gross_floor_area_sqft")
    out = collapse_duplicates(out, KEYS)
    return any_target(out, ["total_ghg_emissions_mtco2e", "site_eui_kbtu_sqft"])


def build_panel(cities: list[DataFrame], geocodes: DataFrame | None = None) -> DataFrame:
    """Union, clean, backfill coordinates from the same building's other years, then from geocodes."""
    panel = clean_panel(union_all(*cities))
    own = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    panel = panel.withColumn("coord_source", F.when(own, "city_disclosure").otherwise("missing"))
    panel = backfill_from_history(panel, "building_id", ["latitude", "longitude"], ["year"], "coord_source")
    if geocodes is None:
        return panel
    return merge_with_provenance(panel, geocodes, ["city", "building_id"],
                                 [F.col("latitude"), F.col("longitude")], dims.centres(panel.sparkSession))


def climate_table(panel: DataFrame, daily: DataFrame) -> DataFrame:
    """Climate of every (building, year): distinct grid-year keys are computed once and fanned out.

    ``daily(query_key, temp, humidity, solar, wind)``: landed daily values of the grid points.
    """
    plan = location_or_fallback(panel.select(*KEYS, "latitude", "longitude"), dims.centres(panel.sparkSession))

    def compute(keys):
        return annual_climate(daily.join(keys, "query_key"), ["query_key"], "temp", "humidity", "solar", "wind")

    return fan_out(plan.select(*KEYS, "climate_source", "grid_lat", "grid_lon", "query_key"), "query_key",
                   compute).drop("query_key")


def reports(panel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Validation summary and availability by city."""
    summary = validation_summary(panel, "city", "building_id", "year",
                                 {"target": "total_ghg_emissions_mtco2e", "site_eui": "site_eui_kbtu_sqft"})
    return summary, availability_long(panel, "city", [c for c in panel.columns if c != "city"])
