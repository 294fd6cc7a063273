"""Whole panels: raw city tables to the building panel, disclosures to the company panel with splits."""

from pyspark.sql import functions as F

from emipanel import dims
from emipanel.plans import building, company
from workload import stage as S
from workload.registry import query
from workload.splitting import STRATA, _cut, _ranked
from workload.stage import pick, r, sql_hash, sql_list, sql_pick, sql_text, t

# ---- building panel: every order is a disclosure row of its customer's building, in the text format of the building's city

CITIES = ["nyc", "seattle", "chicago"]
LABELS = ["Office", "medical office", " Strip Mall ", "Zoo", "GRAND HOTEL", None, "apartment block"]
CATEGORIES = ["Office", "Hospital/Medical", "Retail", "Other", "Hotel", None, "Multifamily Housing"]
# What each city calls the columns of _disclosures.
HEADERS = {
    "nyc": {"raw_id": "Property Id", "ending": "Year Ending", "kind": "Primary Property Type - Self Selected", "built": "Year Built",
            "area": "Property GFA - Self-Reported (ft2)", "eui": "Site EUI (kBtu/ft2)", "weather": "Weather Normalized Site EUI (kBtu/ft2)",
            "source_eui": "Source EUI (kBtu/ft2)", "score": "ENERGY STAR Score", "ghg": "Total GHG Emissions (Metric Tons CO2e)",
            "power": "Electricity Use - Grid Purchase (kWh)", "gas": "Natural Gas Use (kBtu)", "lat": "Latitude", "lon": "Longitude"},
    "seattle": {"raw_id": "OSEBuildingID", "yr": "DataYear", "kind": "Largest Property Use Type", "built": "YearBuilt", "area": "Property Gross Floor Area",
                "eui": "SiteEUI(kBtu/sf)", "source_eui": "SourceEUI(kBtu/sf)", "score": "ENERGYSTARScore", "ghg": "Total GHG (kgCO2e)",
                "power": "Electricity(kBtu)", "gas": "NaturalGas(therms)", "lat": "Latitude", "lon": "Longitude"},
    "chicago": {"raw_id": "\nID ", "kind": "Property Type", "built": "Year Built", "area": "Gross Area", "eui": "Site EUI (kBtu/sq ft)",
                "source_eui": "Source EUI (kBtu/sq ft)", "score": "ENERGY STAR Score", "ghg": "GHG Emissions (MTCO2e)",
                "power": "Electricity Use (kWh)", "lat": "Latitude", "lon": "Longitude"},
}


def _disclosures(spark, sf):
    """Everything as text, with ``ordinal`` and ``file_year`` as a reader of yearly files adds them."""
    k, o, day = F.col("o_custkey"), F.col("o_orderkey"), F.col("o_orderdate")
    city = pick(k, CITIES)
    lat = pick(k, [dims.CITY_CENTRES[c][0] for c in CITIES]) + k % 10 * 0.01
    lon = pick(k, [dims.CITY_CENTRES[c][1] for c in CITIES]) + o % 10 * 0.01
    known = (o % 4 == 0) & (k % 5 != 0)
    cells = {"raw_id": F.when(o % 97 != 0, F.concat(F.lit(" "), k.cast("string"))), "yr": F.year(day), "ending": F.date_format(day, "M/d/yyyy"),
             "kind": pick(k + o, LABELS), "built": k % 240 + 1790, "area": o % 5000 - 100, "eui": F.when(o % 7 != 0, (o % 1100).cast("string")).otherwise("Not Available"),
             "weather": o % 3, "source_eui": o % 900 - 20, "score": o % 101, "ghg": F.when(o % 11 != 0, F.col("o_totalprice").cast("string")).otherwise("-"),
             "power": o % 4000, "gas": o % 700, "lat": F.when(known, lat), "lon": F.when(known & (o % 16 != 4), lon)}
    return t(spark, sf, "orders").select(city.alias("city"), o.alias("ordinal"), F.year(day).cast("long").alias("file_year"),
                                         *[c.cast("string").alias(n) for n, c in cells.items()])


def _standardized(spark, sf):
    rows, out = _disclosures(spark, sf), []
    for city, names in HEADERS.items():
        raw = rows.where(F.col("city") == city).select("ordinal", "file_year", *[F.col(c).alias(h) for c, h in names.items()])
        out.append(building.standardize_city(raw, city, ordinal="ordinal", file_year="file_year"))
    return out


def _geocodes(spark, sf):
    """Two points per building; every tenth building's lie far from its city."""
    k = F.col("c_custkey")
    points = t(spark, sf, "customer").select(pick(k, CITIES).alias("city"), k, F.explode(F.array(F.lit(0.2), F.lit(0.1))).alias("off"))
    far = F.when(k % 10 == 0, 5.0).otherwise(0.0)
    return points.select("city", F.concat_ws("_", "city", k.cast("string")).alias("building_id"),
                         (pick(k, [dims.CITY_CENTRES[c][0] for c in CITIES]) + far + F.col("off")).alias("latitude"),
                         (pick(k, [dims.CITY_CENTRES[c][1] for c in CITIES]) + F.col("off")).alias("longitude"))


def _doubles(key: str, place: int) -> str:
    return f"({sql_list([dims.CITY_CENTRES[c][place] for c in CITIES])}::DOUBLE[])[CAST({key} % {len(CITIES)} AS BIGINT) + 1]"


_NUMBERS = ["year_built", "gross_floor_area_sqft", "site_eui_kbtu_sqft", "source_eui_kbtu_sqft", "energy_star_score",
            "total_ghg_emissions_mtco2e", "electricity_kwh", "natural_gas_kbtu", "latitude", "longitude"]
_BUILDING = f"""raw AS (SELECT o_custkey AS k, o_orderkey AS o, {sql_pick('o_custkey', CITIES)} AS city,
    CAST(year(o_orderdate) AS BIGINT) AS year, o_totalprice AS price FROM orders),
  std AS (SELECT city, city || '_' || CASE WHEN o % 97 <> 0 THEN CAST(k AS VARCHAR) ELSE 'row_' || CAST(o AS VARCHAR) END AS building_id, year,
    {sql_pick('(k + o)', CATEGORIES)} AS property_type,
    CASE WHEN 1790 + k % 240 BETWEEN 1800 AND 2026 THEN CAST(1790 + k % 240 AS DOUBLE) END AS year_built,
    CAST(o % 5000 - 100 AS DOUBLE) AS gross_floor_area_sqft,
    CASE WHEN o % 7 <> 0 AND o % 1100 <= 1000 THEN CAST(o % 1100 AS DOUBLE) END AS site_eui_kbtu_sqft,
    CASE WHEN o % 900 >= 20 THEN CAST(o % 900 - 20 AS DOUBLE) END AS source_eui_kbtu_sqft,
    CASE WHEN o % 101 <> 0 THEN CAST(o % 101 AS DOUBLE) END AS energy_star_score,
    CASE WHEN o % 11 = 0 THEN NULL WHEN city = 'seattle' THEN price / 1000 WHEN price <= 100000 THEN price END AS total_ghg_emissions_mtco2e,
    CASE WHEN city = 'seattle' THEN (o % 4000) / 3.412::DOUBLE ELSE CAST(o % 4000 AS DOUBLE) END AS electricity_kwh,
    CASE city WHEN 'nyc' THEN CAST(o % 700 AS DOUBLE) WHEN 'seattle' THEN (o % 700) * 100::DOUBLE END AS natural_gas_kbtu,
    CASE WHEN o % 4 = 0 AND k % 5 <> 0 THEN {_doubles('k', 0)} + k % 10 * 0.01::DOUBLE END AS latitude,
    CASE WHEN o % 4 = 0 AND k % 5 <> 0 AND o % 16 <> 4 THEN {_doubles('k', 1)} + o % 10 * 0.01::DOUBLE END AS longitude
    FROM raw WHERE o % 5000 - 100 > 0),
  kinds AS (SELECT city, building_id, year, arg_min(property_type, (-n, property_type)) AS property_type FROM (
    SELECT city, building_id, year, property_type, count(*) AS n FROM std WHERE property_type IS NOT NULL GROUP BY ALL) GROUP BY ALL),
  one AS (SELECT city, building_id, year, {', '.join(f'median({c}) AS {c}' for c in _NUMBERS)} FROM std GROUP BY ALL),
  clean AS (SELECT one.*, property_type FROM one LEFT JOIN kinds USING (city, building_id, year)
    WHERE total_ghg_emissions_mtco2e IS NOT NULL OR site_eui_kbtu_sqft IS NOT NULL),
  hist AS (SELECT building_id, arg_min(latitude, year) AS h_lat, arg_min(longitude, year) AS h_lon FROM clean
    WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY 1),
  geo AS (SELECT {sql_pick('c_custkey', CITIES)} || '_' || CAST(c_custkey AS VARCHAR) AS building_id, {_doubles('c_custkey', 0)} + 0.1::DOUBLE AS g_lat,
    {_doubles('c_custkey', 1)} + 0.1::DOUBLE AS g_lon FROM customer WHERE c_custkey % 10 <> 0),
  built AS (SELECT clean.* EXCLUDE (latitude, longitude), coalesce(latitude, h_lat, g_lat) AS latitude,
    CASE WHEN coalesce(latitude, h_lat) IS NULL AND g_lat IS NOT NULL THEN g_lon ELSE coalesce(longitude, h_lon) END AS longitude,
    CASE WHEN coalesce(latitude, h_lat) IS NULL AND g_lat IS NOT NULL THEN 'geocoded_address'
      WHEN (latitude IS NULL OR longitude IS NULL) AND h_lat IS NOT NULL THEN 'history_backfill'
      WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN 'city_disclosure' ELSE 'missing' END AS coord_source
    FROM clean LEFT JOIN hist USING (building_id) LEFT JOIN geo USING (building_id))"""


@query("panel_building", f"""WITH {_BUILDING} SELECT city, building_id, year, property_type,
  {', '.join(f'round({c}, 3) AS {c}' for c in _NUMBERS)}, coord_source FROM built""")
def panel_building(spark, sf):
    """Three cities' text tables with headers, units and year columns of their own to one clean panel."""
    out = building.build_panel(_standardized(spark, sf), _geocodes(spark, sf))
    return out.select(*building.KEYS, "property_type", *[r(c, 3).alias(c) for c in _NUMBERS], "coord_source")


@query("panel_building_report", f"""WITH {_BUILDING} SELECT city, coord_source, count(*) AS n, count(DISTINCT building_id) AS buildings,
  count(total_ghg_emissions_mtco2e) AS with_target, round(sum(total_ghg_emissions_mtco2e), 1) AS total FROM built GROUP BY 1, 2""")
def panel_building_report(spark, sf):
    out = building.build_panel(_standardized(spark, sf), _geocodes(spark, sf))
    return out.groupBy("city", "coord_source").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("building_id").alias("buildings"),
        F.count("total_ghg_emissions_mtco2e").alias("with_target"), r(F.sum("total_ghg_emissions_mtco2e"), 1).alias("total"))


# ---- company panel: one disclosure per (customer, year), factors from the detailed accounts

REGIONS = ["US", "DE", "JP", "WA", "WL", "WF"]
BUCKETS = ["Consumer Cyclical", "Energy", "Financial Services", "Industrials", "Technology", "Other"]
_SHIFT = 22  # the tables' years end in 2001, factors in 2022


def _factors(spark, sf):
    x = S.accounts(spark, sf)
    x = x.select(pick(F.col("nation"), REGIONS).alias("region"), F.col("p_brand").alias("sector"), (F.col("year") + _SHIFT).alias("year"),
                 F.col("ghg").alias("ghg_kgco2e"), F.col("va").alias("va_meur"))
    number = F.substring("p_brand", 7, 2).cast("int")
    cross = t(spark, sf, "part").select("p_brand").distinct().where(number % 7 != 0).select(F.col("p_brand").alias("detail"), pick(number, BUCKETS).alias("bucket"))
    return company.factor_table(x, cross)


def _baseline(spark, sf):
    k, c = F.col("nz_id"), S.companies(spark, sf)
    who = c.select("nz_id", "country_iso2", "sics_sector")
    p = S.panel(spark, sf).select(F.col("building_id").alias("nz_id"), (F.col("year") + _SHIFT).alias("reporting_year"), "target", "n_orders")
    both = F.col("nz_id") + F.col("reporting_year")
    disclosures = p.join(who, "nz_id").select(
        "nz_id", "reporting_year", "country_iso2", "sics_sector", F.when(both % 7 != 0, F.col("target") / 10000).alias("scope1_tco2e"),
        F.when(both % 5 != 0, F.col("n_orders") * 3.0).alias("scope2_lb_tco2e"))
    ticker = F.concat(F.lit("T"), k.cast("string"))
    tickers = c.where(k % 3 != 0).select("nz_id", ticker.alias("ticker"))
    financials = c.where(k % 4 != 1).select(ticker.alias("ticker"), "yf_sector", F.col("revenue").alias("revenue_usd"), "currency")
    base = company.factor_baseline(disclosures, tickers, financials, _factors(spark, sf))
    yearly = p.where((k % 3 != 0) & (k % 2 == 0)).select(ticker.alias("ticker"), F.col("reporting_year").alias("year"), (F.col("n_orders") * 1.5).alias("revenue_musd"))
    summaries = c.where(k % 6 == 1).select(ticker.alias("ticker"), F.col("company_name").alias("summary"))
    return company.merge_time_aligned(base, yearly, summaries, [F.col("nz_id")])


def _table(mapping) -> str:
    return ", ".join(f"({sql_text(a)}, {sql_text(b)}{'' if isinstance(b, str) else '::DOUBLE'})" for a, b in mapping)


_COMPANY = f"""{S.ACCOUNTS}, {S.COMPANIES}, {S.PANEL},
  sector_map(raw, mapped) AS (VALUES {_table(dims.SECTOR_MAP.items())}), rest(iso, bucket) AS (VALUES {_table((i, b) for b, all_ in dims.REST_OF_WORLD.items() for i in all_)}),
  fx(cur, rate) AS (VALUES {_table(dims.FX_PER_USD.items())}),
  acc AS (SELECT {sql_pick('nation', REGIONS)} AS region, CASE WHEN CAST(substr(p_brand, 7, 2) AS INT) % 7 = 0 THEN 'Other'
    ELSE {sql_pick('CAST(substr(p_brand, 7, 2) AS INT)', BUCKETS)} END AS sector, year + {_SHIFT} AS year, ghg, va FROM accounts),
  factors AS (SELECT region, sector, year, sum(ghg) / 1000 / nullif(sum(va) * 1.08::DOUBLE, 0) AS factor FROM acc WHERE sector <> 'Other' GROUP BY 1, 2, 3),
  own AS (SELECT DISTINCT region FROM factors),
  disc AS (SELECT nz_id, year + {_SHIFT} AS reporting_year, country_iso2, sics_sector, yf_sector, currency, revenue, company_name, n_orders,
    CASE WHEN (nz_id + year + {_SHIFT}) % 7 <> 0 THEN target / 10000 END AS s1, CASE WHEN (nz_id + year + {_SHIFT}) % 5 <> 0 THEN n_orders * 3.0::DOUBLE END AS s2,
    CASE WHEN nz_id % 3 <> 0 THEN 'T' || CAST(nz_id AS VARCHAR) END AS ticker, nz_id % 3 <> 0 AND nz_id % 4 <> 1 AS fin FROM panel JOIN companies ON nz_id = building_id),
  located_in AS (SELECT disc.*, coalesce(own.region, rest.bucket) AS factor_region, coalesce(mapped, CASE WHEN fin THEN nullif(trim(yf_sector), '') END) AS sector,
    CASE WHEN mapped IS NOT NULL THEN 'primary' WHEN fin AND nullif(trim(yf_sector), '') IS NOT NULL THEN 'fallback' END AS sector_source,
    CASE WHEN fin THEN nullif(revenue, 0) / 1000000 / rate END AS revenue_musd, CASE WHEN fin THEN cur END AS cur
    FROM disc LEFT JOIN own ON own.region = country_iso2 LEFT JOIN rest ON iso = country_iso2 LEFT JOIN sector_map ON raw = sics_sector
    LEFT JOIN fx ON cur = upper(trim(currency))),
  base AS (SELECT l.*, factor, revenue_musd * factor AS predicted, CASE WHEN s1 IS NOT NULL OR s2 IS NOT NULL THEN coalesce(s1, 0) + coalesce(s2, 0) END AS actual,
    CASE WHEN nz_id % 3 <> 0 AND nz_id % 2 = 0 THEN n_orders * 1.5::DOUBLE END AS ty
    FROM located_in l LEFT JOIN factors f ON f.region = factor_region AND f.sector = l.sector AND f.year = least(reporting_year, 2022))"""


@query("panel_company_baseline", f"""WITH {_COMPANY} SELECT nz_id, reporting_year, ticker, cur AS currency, factor_region, sector, sector_source,
  round(factor, 5) AS factor, round(revenue_musd, 5) AS revenue_musd, round(predicted, 3) AS predicted, round(actual, 4) AS actual,
  ty IS NOT NULL AS financials_timevary, round(coalesce(ty, revenue_musd), 5) AS revenue_best_musd,
  CASE WHEN nz_id % 3 <> 0 AND nz_id % 6 = 1 THEN company_name END AS summary FROM base""")
def panel_company_baseline(spark, sf):
    """Disclosures, tickers, financials in local currency, sector accounts, yearly revenue and descriptions to one row per company-year."""
    return _baseline(spark, sf).select(
        "nz_id", "reporting_year", "ticker", "currency", "factor_region", "sector", "sector_source", r("factor_tco2e_per_musd", 5).alias("factor"),
        r("revenue_musd", 5).alias("revenue_musd"), r("scope12_pred_tco2e", 3).alias("predicted"), r("scope12_actual_tco2e").alias("actual"),
        "financials_timevary", r("revenue_best_musd", 5).alias("revenue_best_musd"), "summary")


_MODEL = f"""WITH {_COMPANY}, rows_in AS (SELECT *, coalesce(sector, 'Unknown') AS a, country_iso2 AS b FROM base WHERE actual > 0), {STRATA},
  {_ranked('stratum', sql_hash(42, 'nz_id', 'reporting_year'), 'nz_id, reporting_year', 'strata')}, sp AS (SELECT *, {_cut('rn', 'sz')} AS split FROM rk)"""


@query("panel_company_splits", f"""{_MODEL} SELECT nz_id, reporting_year, stratum, split, ticker IS NOT NULL AND coalesce(coalesce(ty, revenue_musd) > 0, false) AS subset_strict,
  factor IS NOT NULL AS has_factor_baseline, round(log10(actual), 6) AS y FROM sp WHERE actual BETWEEN 10 AND 5e8""")
def panel_company_splits(spark, sf):
    """Company panel to modelling rows: outliers set aside, the split made over all rows before, target in logarithms."""
    rows, _ = company.modelling_rows(_baseline(spark, sf))
    return rows.select("nz_id", "reporting_year", "stratum", "split", "subset_strict", "has_factor_baseline", r("y", 6).alias("y"))


@query("panel_company_audit", f"""WITH {_COMPANY} SELECT nz_id, reporting_year, CASE WHEN actual > 5e8 THEN 'too_high' WHEN actual = 0 THEN 'zero'
  ELSE 'too_low' END AS outlier_reason FROM base WHERE actual > 5e8 OR actual = 0 OR (actual > 0 AND actual < 10)""")
def panel_company_audit(spark, sf):
    _, audit = company.modelling_rows(_baseline(spark, sf))
    return audit.select("nz_id", "reporting_year", "outlier_reason")
