"""Declared schemas and conforming to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emipanel.functions.core import nan_to_null

BUILDING_PANEL = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("city", "building_id")]
    + [T.StructField("year", T.LongType()), T.StructField("property_type", T.StringType())]
    + [T.StructField(n, T.DoubleType()) for n in (
        "year_built", "gross_floor_area_sqft", "site_eui_kbtu_sqft", "source_eui_kbtu_sqft", "energy_star_score",
        "total_ghg_emissions_mtco2e", "electricity_kwh", "natural_gas_kbtu", "latitude", "longitude")])

COMPANY_MASTER = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("source", "company_name")]
    + [T.StructField("reporting_year", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("country", "industry_raw", "industry_naics2")]
    + [T.StructField(n, T.DoubleType()) for n in (
        "scope1_tco2e", "scope2_lb_tco2e", "scope3_tco2e", "ghg_total_tco2e", "revenue_musd", "ebitda_musd",
        "profit_musd", "employees", "market_cap_musd")]
    + [T.StructField(n, T.StringType()) for n in ("ticker", "lei", "data_provider")]
    + [T.StructField("nz_id", T.LongType())]
    + [T.StructField(f"scope3_c{i}_tco2e", T.DoubleType()) for i in range(1, 16)])

RESULTS_LONG = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("task", "feature_set", "model")]
    + [T.StructField("seed", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("split_type", "scope", "scope_value", "metric")]
    + [T.StructField("value", T.DoubleType())])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the declared columns: missing ones as typed nulls, extra ones dropped, NaN as null."""
    cols = []
    for f in schema.fields:
        if f.name not in df.columns:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        c = F.col(f.name).try_cast(f.dataType)
        if isinstance(f.dataType, T.DoubleType):
            c = nan_to_null(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def missing_as_null(df: DataFrame) -> DataFrame:
    """NaN to null in every floating column."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(c) for c in floats}) if floats else df
