"""Small dimension tables. Their size is fixed by the literals below, so they may be broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Units of local currency per US dollar.
FX_PER_USD = {
    "USD": 1.0, "JPY": 150.0, "EUR": 0.92, "GBP": 0.78, "CNY": 7.2, "KRW": 1370.0, "INR": 84.0, "CAD": 1.35,
    "AUD": 1.50, "BRL": 5.2, "MXN": 17.0, "SEK": 10.5, "TWD": 32.0, "CHF": 0.88, "HKD": 7.8, "SGD": 1.35,
    "NOK": 10.9, "DKK": 6.9, "ZAR": 18.0, "THB": 36.0, "IDR": 15800.0, "TRY": 34.0, "PLN": 4.0, "HUF": 370.0,
    "ILS": 3.7, "AED": 3.67, "SAR": 3.75, "CZK": 23.0, "PHP": 57.0, "MYR": 4.7, "RON": 4.6, "COP": 4200.0,
    "CLP": 950.0, "PEN": 3.8, "EGP": 49.0, "PKR": 280.0, "NZD": 1.65, "QAR": 3.64, "VND": 25000.0,
    "BHD": 0.377, "KWD": 0.307, "OMR": 0.385, "ARS": 950.0, "RUB": 95.0, "UAH": 41.0, "NGN": 1600.0,
    "KES": 130.0,
}

# City centres (latitude, longitude).
CITY_CENTRES = {
    "nyc": (40.71, -74.01), "la": (34.05, -118.24), "seattle": (47.61, -122.33), "dc": (38.91, -77.04),
    "chicago": (41.88, -87.63), "sf": (37.77, -122.42), "boston": (42.36, -71.06), "denver": (39.74, -104.99),
    "portland": (45.52, -122.68), "philadelphia": (39.95, -75.17), "sydney": (-33.87, 151.21),
    "melbourne": (-37.81, 144.96), "brisbane": (-27.47, 153.03), "perth": (-31.95, 115.86),
    "adelaide": (-34.93, 138.60), "canberra": (-35.28, 149.13), "hobart": (-42.88, 147.33),
    "darwin": (-12.46, 130.84), "newcastle": (-32.93, 151.78), "wollongong": (-34.43, 150.89),
    "gold_coast": (-28.02, 153.40), "townsville": (-19.26, 146.82), "cairns": (-16.92, 145.77),
    "geelong": (-38.15, 144.36), "port_macquarie": (-31.43, 152.91), "singapore": (1.35, 103.82),
}

# Grid intensity in 2020 (tCO2e per MWh) and its yearly change.
GRID_BASE = {"nyc": 0.260, "chicago": 0.385, "seattle": 0.080, "dc": 0.310, "sf": 0.210, "la": 0.240,
             "boston": 0.280, "denver": 0.530, "philadelphia": 0.300, "portland": 0.090, "melbourne": 0.790,
             "singapore": 0.449}
GRID_RATES = [(-0.03, ["melbourne"]), (-0.01, ["singapore"]), (-0.005, ["seattle", "portland"]),
              (-0.02, ["sf", "la"]), (-0.015, ["chicago", "denver"])]
GRID_DEFAULT_RATE = -0.012
GRID_BASE_YEAR = 2020
GRID_FLOOR = 0.01

# Disclosure sector -> benchmark sector ("Information Not Available" maps to nothing).
SECTOR_MAP = {
    "Consumer Goods": "Consumer Cyclical",
    "Extractives & Minerals Processing": "Energy",
    "Financials": "Financial Services",
    "Food & Beverage": "Consumer Defensive",
    "Health Care": "Healthcare",
    "Infrastructure": "Industrials",
    "Renewable Resources & Alternative Energy": "Utilities",
    "Resource Transformation": "Industrials",
    "Services": "Industrials",
    "Technology & Communications": "Technology",
    "Transportation": "Industrials",
}
SECTOR_UNKNOWN = "Information Not Available"

# Rest-of-world bucket of countries without factors of their own.
REST_OF_WORLD = {
    "WA": ["TH", "SG", "MY", "NZ", "VN", "PH", "BD", "LK", "KH", "PK", "MN", "FJ", "MH", "AF"],
    "WE": ["IS", "RS", "UA", "BY", "MK", "SM", "MC", "LI"],
    "WF": ["EG", "NG", "KE", "MU", "TN", "MA", "MZ", "MG", "CM", "GQ", "LY"],
    "WL": ["CO", "AR", "CL", "PE", "EC", "CR", "GT", "PA", "UY", "DO", "HN", "BO", "VE", "GY", "PY", "TT"],
    "WM": ["AE", "SA", "IL", "KW", "QA", "JO", "BH", "OM", "IQ", "AZ", "KZ"],
}

# World regions of the transfer experiments.
WORLD_REGIONS = {
    "US": ["US"],
    "EU": ["DE", "FR", "IT", "ES", "NL", "BE", "SE", "FI", "DK", "AT", "IE", "PT", "GR", "LU", "CZ", "PL", "HU",
           "RO", "BG", "HR", "SI", "SK", "LT", "LV", "EE", "CY", "MT", "GB", "CH", "NO", "IS"],
    "APAC": ["JP", "KR", "CN", "IN", "AU", "NZ", "SG", "HK", "TW", "TH", "MY", "ID", "PH", "VN", "BD", "PK",
             "LK"],
}


def fx(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FX_PER_USD.items()), "currency string, local_per_usd double")


def centres(spark: SparkSession) -> DataFrame:
    rows = [(c, lat, lon) for c, (lat, lon) in CITY_CENTRES.items()]
    return spark.createDataFrame(rows, "city string, centre_lat double, centre_lon double")


def sectors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SECTOR_MAP.items()), "sector_raw string, sector_mapped string")


def rest_of_world(spark: SparkSession) -> DataFrame:
    rows = [(iso, bucket) for bucket, members in REST_OF_WORLD.items() for iso in members]
    return spark.createDataFrame(rows, "iso2 string, bucket string")


def world_regions(spark: SparkSession) -> DataFrame:
    rows = [(iso, region) for region, members in WORLD_REGIONS.items() for iso in members]
    return spark.createDataFrame(rows, "iso2 string, world_region string")


def literal(spark: SparkSession, mapping: dict, key: str, value: str) -> DataFrame:
    """Any caller-supplied lookup of string to string, e.g. a sector crosswalk or country codes."""
    return spark.createDataFrame([(str(k), None if v is None else str(v)) for k, v in mapping.items()],
                                 f"{key} string, {value} string")


def grid_base(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(GRID_BASE.items()), "city string, base double")


def trend(base, rate, year, base_year: int = GRID_BASE_YEAR, floor: float = GRID_FLOOR) -> Column:
    """Linear change per year since ``base_year``, never under ``floor``."""
    return F.greatest(F.lit(floor), base * (F.lit(1.0) + rate * (year - F.lit(base_year))))


def rate_of(city: Column) -> Column:
    out = F.lit(GRID_DEFAULT_RATE)
    for rate, members in GRID_RATES:
        out = F.when(city.isin(members), rate).otherwise(out)
    return out


def expand_trend(dim: DataFrame, years: range, city: str = "city", base: str = "base",
                 value: str = "grid_co2e_per_mwh", keep=()) -> DataFrame:
    """One row per row of ``dim`` and year of ``years``."""
    out = dim.withColumn("year", F.explode(F.sequence(F.lit(years.start), F.lit(years.stop - 1))))
    return out.select(*keep, city, F.col("year"),
                      F.round(trend(F.col(base), rate_of(F.col(city)), F.col("year")), 4).alias(value))
