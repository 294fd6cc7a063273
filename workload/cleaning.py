"""Scalar cleaning and row filters."""

from pyspark.sql import functions as F

from emipanel import dims
from emipanel.functions import *  # noqa: F403
from emipanel.functions.numeric import BUILDING_RULES  # noqa: F401
from emipanel.functions.text import (CATEGORY_LABELS, CATEGORY_RULES, METRO_LOCALITIES, STATE_CAPITALS,
                                     WIDE_METRO_LOCALITIES)
from emipanel.operators import filters as D
from emipanel.operators import joins as E
from emipanel.operators.splits import stratum_label
from emipanel.operators.windows import lags
from workload import stage as S
from workload.registry import query
from workload.stage import pick, r, sql_in, sql_list, sql_pick, sql_text, t

_RAW_NUMBERS = ["Not Available", "N/A", "NA", "", "None", "-", "—", " 12 ", "1,200", "abc", "12e3", "NaN", None]


def _raw_number(k, value):
    return F.when(F.pmod(k, F.lit(17)) < 13, pick(F.pmod(k, F.lit(17)), _RAW_NUMBERS)).otherwise(value.cast("string"))


_RAW_SQL = f"""CASE WHEN p_partkey % 17 < 13 THEN {sql_pick('(p_partkey % 17)', _RAW_NUMBERS)}
  ELSE CAST(p_retailprice AS VARCHAR) END"""


@query("clean_numeric_text", f"""WITH x AS (SELECT p_partkey, {_RAW_SQL} AS raw FROM part)
  SELECT p_partkey, CASE WHEN raw IN ('Not Available', 'N/A', 'NA', '', 'None', '-', 'NaN') THEN NULL
      ELSE TRY_CAST(raw AS DOUBLE) END AS safe,
    CASE WHEN raw IN ('—', 'NaN') THEN NULL ELSE TRY_CAST(raw AS DOUBLE) END AS dashed,
    CASE WHEN raw = 'NaN' THEN NULL ELSE TRY_CAST(replace(raw, ',', '') AS DOUBLE) END AS separated FROM x""")
def clean_numeric_text(spark, sf):
    x = t(spark, sf, "part").select("p_partkey", _raw_number(F.col("p_partkey"), F.col("p_retailprice")).alias("raw"))
    return x.select("p_partkey", to_numeric_safe("raw").alias("safe"), clean_dash("raw").alias("dashed"),
                    strip_commas("raw").alias("separated"))


_LABELS = ["Office", " medical office ", "Apartment Block", "MOTEL 6", "Other - Lodging/Residential", "Commercial",
           "commercial loft", "Big Mall", "lab", "Gymnasium hall", "WAREHOUSE", "Condo Tower", "Mixed thing",
           "Private Storage", "Zoo", "unknown thing", None, "Synagogue", "Nursing home", "Dormitory", "Grocery shop"]


def _category_sql(label: str) -> str:
    out = []
    for cat, known in CATEGORY_LABELS.items():
        out.append(f"WHEN {label} IN {sql_in([k.lower() for k in known])} THEN {sql_text(cat)}")
    for cat, words in CATEGORY_RULES:
        tests = [f"starts_with({label}, '{w[1:]}')" if w[0] == "^" else f"{label} = '{w[1:]}'" if w[0] == "="
                 else f"contains({label}, '{w}')" for w in words]
        out.append(f"WHEN {' OR '.join(tests)} THEN {sql_text(cat)}")
    return "CASE " + " ".join(out) + " ELSE 'Other' END"


@query("clean_category", f"""WITH x AS (SELECT p_partkey, {sql_pick('p_partkey', _LABELS)} AS raw FROM part)
  SELECT p_partkey, raw, CASE WHEN raw IS NOT NULL THEN {_category_sql('lower(trim(raw))')} END AS category FROM x""")
def clean_category(spark, sf):
    x = t(spark, sf, "part").select("p_partkey", pick(F.col("p_partkey"), _LABELS).alias("raw"))
    return x.withColumn("category", map_category("raw"))


_SUBURBS = ["Carlton South", " west-perth ", "Box Hill", "City", "civic", None, "", "Wagga/Wagga", "Hobart",
            "St  Leonards", "Southport", "Ipswich"]
_STATES = ["VIC", "nsw", "ACT", None, "QLD", "??", "TAS"]
_ADDRESSES = ["1 Main St VIC 3000", "2 High St", None]


def _places(spark, sf):
    k = F.col("c_custkey")
    return t(spark, sf, "customer").select("c_custkey", pick(k, _SUBURBS).alias("suburb"), pick(k, _STATES).alias("state"),
                                           pick(k, _ADDRESSES).alias("address"))


_PLACES = f"""places AS (SELECT c_custkey, {sql_pick('c_custkey', _SUBURBS)} AS suburb,
  {sql_pick('c_custkey', _STATES)} AS state, {sql_pick('c_custkey', _ADDRESSES)} AS address FROM customer),
tok AS (SELECT *, trim(regexp_replace(lower(coalesce(suburb, '')), '[/\\-\\s]+', ' ', 'g')) AS place,
  upper(trim(coalesce(state, ''))) AS code, ' ' || lower(trim(coalesce(address, ''))) AS street FROM places)"""
_CAPITAL = "CASE code " + " ".join(f"WHEN '{s}' THEN '{c}'" for s, c in STATE_CAPITALS.items()) + " END"


def _metro_case(value, sets, extra=()):
    parts = []
    for name, members in sets.items():
        test = f"{value} IN {sql_in(members)}"
        parts.append(f"WHEN {dict(extra).get(name, '{}').format(test)} THEN '{name}'")
    return "CASE " + " ".join(parts) + " END"


_CITY_CASE = _metro_case("place", METRO_LOCALITIES, {
    "melbourne": "({} OR (contains(street, ' vic') AND place = 'city'))", "canberra": "({} AND code = 'ACT')"}.items())


@query("clean_city", f"""WITH {_PLACES} SELECT c_custkey, coalesce({_CITY_CASE}, nullif(replace(place, ' ', '_'), ''),
  {_CAPITAL}, 'australia_unknown') AS city FROM tok""")
def clean_city(spark, sf):
    return _places(spark, sf).select("c_custkey", normalize_city("suburb", "state", "address").alias("city"))


@query("clean_metro", f"""WITH {_PLACES} SELECT c_custkey, coalesce(
  {_metro_case("replace(place, ' ', '_')", WIDE_METRO_LOCALITIES)}, {_CAPITAL}, nullif(replace(place, ' ', '_'), ''),
  'australia_unknown') AS city FROM tok""")
def clean_metro(spark, sf):
    return _places(spark, sf).select("c_custkey", normalize_metro("suburb", "state").alias("city"))


@query("clean_text_tokens", """SELECT doc_id, regexp_replace(lower(trim(source)), '[^a-z0-9]+', '_', 'g') AS slug,
  CAST(length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS BIGINT) AS clean_length,
  md5(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS clean_md5, lower(trim(source, ' ')) AS name FROM documents""")
def clean_text_tokens(spark, sf):
    d = t(spark, sf, "documents")
    one = clean_text("text")
    return d.select("doc_id", slug("source").alias("slug"), F.length(F.trim(one)).cast("long").alias("clean_length"),
                    F.md5(one).alias("clean_md5"), norm_name("source").alias("name"))


_GEO = ["abc123", "", "NaN", None, " g7 "]


@query("clean_ids", f"""WITH x AS (SELECT *, {sql_pick('p_partkey', _GEO)} AS geo FROM part)
  SELECT p_partkey, 'nyc_' || CAST(p_partkey AS VARCHAR) AS prefixed, 'SG_' || replace(upper(trim(p_name)), ' ', '_')
    AS upper_id, 'aus_' || CASE WHEN trim(geo) <> '' AND lower(trim(geo)) <> 'nan' THEN trim(geo)
      ELSE regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g') END AS geo_id,
    coalesce(CASE WHEN p_size > 25 THEN 'id' || p_size END, 'la_row_' || p_partkey) AS building_id FROM x""")
def clean_ids(spark, sf):
    from emipanel.sources.readers import fallback_ids
    x = t(spark, sf, "part").withColumn("geo", pick(F.col("p_partkey"), _GEO)).withColumn(
        "building_id", F.when(F.col("p_size") > 25, F.concat(F.lit("id"), F.col("p_size"))))
    x = fallback_ids(x, "la", "p_partkey")
    return x.select("p_partkey", make_id("nyc_", "p_partkey").alias("prefixed"), upper_id("SG_", "p_name").alias("upper_id"),
                    coalesce_id("geo", "p_name").alias("geo_id"), "building_id")


@query("clean_units", """SELECT p_partkey, round(p_retailprice / 3.412, 9) AS kwh, round(p_retailprice * 100, 9) AS kbtu,
  round(p_retailprice / 1000, 9) AS tonnes, round(p_size * 10.764::DOUBLE, 9) AS sqft,
  round(p_retailprice * 3.412 / 10.764, 9) AS eui, round(p_retailprice * 0.9478 / nullif(p_size - 1, 0), 9) AS mj_eui,
  round(p_retailprice / 1000, 9) AS by_header_kg, round(p_retailprice, 9) AS by_header_t,
  CASE WHEN p_size % 2 = 0 THEN p_retailprice * 1e6 ELSE p_retailprice END AS by_row,
  round(p_size * p_retailprice * 0.44876 / 1000, 9) AS emissions, round(p_size * p_retailprice, 9) AS energy
  FROM part""")
def clean_units(spark, sf):
    x = t(spark, sf, "part").withColumn("unit", F.when(F.col("p_size") % 2 == 0, "Million Tonnes").otherwise("tonnes"))
    v, s = "p_retailprice", F.col("p_size").cast("double")
    return x.select("p_partkey", r(convert(v, "kbtu_to_kwh"), 9).alias("kwh"), r(convert(v, "therms_to_kbtu"), 9).alias("kbtu"),
                    r(convert(v, "kg_to_tonnes"), 9).alias("tonnes"), r(convert(s, "sqm_to_sqft"), 9).alias("sqft"),
                    r(convert(v, "kwh_sqm_to_kbtu_sqft"), 9).alias("eui"), r(mj_intensity(v, s - 1), 9).alias("mj_eui"),
                    r(convert_by_header(v, "Total GHG (kgCO2e)"), 9).alias("by_header_kg"),
                    r(convert_by_header(v, "GHG (MTCO2e)"), 9).alias("by_header_t"), scale_by_unit(v, "unit").alias("by_row"),
                    r(estimate_emissions(s, v), 9).alias("emissions"), r(energy_from_intensity(s, v), 9).alias("energy"))


_FX_SQL = "fx(cur, rate) AS (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in dims.FX_PER_USD.items()) + ")"


@query("clean_currency", f"""WITH {S.COMPANIES}, {_FX_SQL}
  SELECT nz_id, fx.cur AS currency, round(revenue / rate / 1e6, 8) AS revenue,
    round(nullif(c.revenue, 0) / 1e6, 8) AS local_musd, round(coalesce(revenue / rate / 1e6, nation), 8) AS best
  FROM companies c LEFT JOIN fx ON upper(trim(c.currency)) = fx.cur""")
def clean_currency(spark, sf):
    c = S.companies(spark, sf).withColumn("local_musd", musd("revenue"))
    out = E.fx_to_musd(c, ["revenue"], in_units=True)
    return out.select("nz_id", "currency", r("revenue", 8).alias("revenue"), r("local_musd", 8).alias("local_musd"),
                      r(best_of("revenue", F.col("nation").cast("double")), 8).alias("best"))


_SECTOR_SQL = "sec(a, b) AS (VALUES " + ", ".join(f"({sql_text(k)}, {sql_text(v)})" for k, v in dims.SECTOR_MAP.items()) + ")"


@query("clean_sector_source", f"""WITH {S.COMPANIES}, {_SECTOR_SQL}
  SELECT nz_id, coalesce(b, nullif(trim(yf_sector), '')) AS sector, CASE WHEN b IS NOT NULL THEN 'primary'
    WHEN nullif(trim(yf_sector), '') IS NOT NULL THEN 'fallback' END AS sector_source
  FROM companies LEFT JOIN sec ON a = sics_sector""")
def clean_sector_source(spark, sf):
    return E.resolve_with_source(S.companies(spark, sf), "sics_sector", "yf_sector").select("nz_id", "sector", "sector_source")


_ROW_SQL = "rw(iso, bucket) AS (VALUES " + ", ".join(
    f"('{i}', '{b}')" for b, m in dims.REST_OF_WORLD.items() for i in m) + ")"


@query("clean_factor_region", f"""WITH {S.COMPANIES}, {_ROW_SQL}
  SELECT nz_id, CASE WHEN country_iso2 IN (SELECT country_iso2 FROM companies WHERE nation = 3 AND country_iso2 IN
    ('US', 'DE', 'JP', 'BR', 'GB', 'TH')) THEN country_iso2 ELSE bucket END AS factor_region
  FROM companies LEFT JOIN rw ON iso = country_iso2""")
def clean_factor_region(spark, sf):
    c = S.companies(spark, sf)
    own = c.where((F.col("nation") == 3) & F.col("country_iso2").isin("US", "DE", "JP", "BR", "GB", "TH"))
    return E.map_region(c, "country_iso2", own.select(F.col("country_iso2").alias("iso2"))).select("nz_id", "factor_region")


@query("clean_world_region", f"""WITH {S.COMPANIES}
  SELECT nz_id, CASE {' '.join(f"WHEN country_iso2 IN {sql_in(m)} THEN '{k}'" for k, m in dims.WORLD_REGIONS.items())}
    ELSE 'Other' END AS world_region FROM companies""")
def clean_world_region(spark, sf):
    return E.region_of(S.companies(spark, sf), "country_iso2").select("nz_id", "world_region")


@query("clean_iso_codes", """SELECT c_custkey, substr(n_name, 8, 2) AS country_iso2, 'N' || substr(n_name, 8, 2) AS country_iso3
  FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON n_nationkey = c_nationkey""")
def clean_iso_codes(spark, sf):
    n = t(spark, sf, "nation")
    table = n.where("n_regionkey < 3").select(F.col("n_name").alias("country_name"),
                                              F.substring("n_name", 8, 2).alias("country_iso2"),
                                              F.concat(F.lit("N"), F.substring("n_name", 8, 2)).alias("country_iso3"))
    c = t(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).withColumn(
        "country", F.concat(F.lit(" "), F.upper("n_name")))
    return E.iso_codes(c, "country", table).select("c_custkey", "country_iso2", "country_iso3")


@query("clean_year", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 2 THEN 2012 WHEN 3 THEN 2013
  ELSE year(o_orderdate) END::BIGINT AS year FROM orders""")
def clean_year(spark, sf):
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    text = (F.when(k == 0, F.date_format(d, "MM/dd/yyyy")).when(k == 1, F.date_format(d, "yyyy-MM-dd"))
            .when(k == 2, "not a date"))
    file_year = F.when(k == 2, 2012).when(k == 3, 2013)
    return t(spark, sf, "orders").select("o_orderkey", year_of(text, ["M/d/yyyy", "yyyy-MM-dd"], file_year).cast("long").alias("year"))


_RULE_SQL = """SELECT p_partkey, CASE WHEN NOT (a < 0 OR a > 1000) THEN a END AS site_eui_kbtu_sqft,
  CASE WHEN NOT a < 0 THEN a END AS source_eui_kbtu_sqft, CASE WHEN NOT (g < 0 OR g > 100000) THEN g END
  AS total_ghg_emissions_mtco2e, CASE WHEN NOT (y < 1800 OR y > 2026) THEN y END AS year_built,
  CASE WHEN e <> 0 THEN e END AS energy_star_score FROM raw"""
_RAW_PANEL_SQL = """raw AS (SELECT p_partkey, p_retailprice - 950.0::DOUBLE AS a, (p_retailprice - 950.0::DOUBLE) * 200.0::DOUBLE AS g,
  CAST(1795 + p_partkey % 240 AS DOUBLE) AS y, CAST(p_size % 5 AS DOUBLE) AS e FROM part)"""


def _raw_panel(spark, sf):
    a = F.col("p_retailprice") - 950.0
    return t(spark, sf, "part").select(
        "p_partkey", a.alias("site_eui_kbtu_sqft"), a.alias("source_eui_kbtu_sqft"),
        (a * 200.0).alias("total_ghg_emissions_mtco2e"), (F.lit(1795) + F.col("p_partkey") % 240).cast("double").alias("year_built"),
        (F.col("p_size") % 5).cast("double").alias("energy_star_score"))


@query("clean_null_rules", f"WITH {_RAW_PANEL_SQL} {_RULE_SQL}")
def clean_null_rules(spark, sf):
    return null_out(_raw_panel(spark, sf), BUILDING_RULES)


@query("clean_rule_counts", f"""WITH {_RAW_PANEL_SQL}, k AS ({_RULE_SQL})
  SELECT count(*) - count(site_eui_kbtu_sqft) AS site_eui_kbtu_sqft, count(*) - count(source_eui_kbtu_sqft)
    AS source_eui_kbtu_sqft, count(*) - count(total_ghg_emissions_mtco2e) AS total_ghg_emissions_mtco2e,
    count(*) - count(year_built) AS year_built, count(*) - count(energy_star_score) AS energy_star_score FROM k""")
def clean_rule_counts(spark, sf):
    return rule_counts(_raw_panel(spark, sf), BUILDING_RULES)


@query("clean_clipped_predictions", f"""WITH {S.PAIRS}, m AS (SELECT max(y) AS top FROM pairs WHERE year < 1997)
  SELECT l_orderkey, l_linenumber, round(least(greatest(p * 4 - 90000, 0), top * 2), 4) AS pred FROM pairs, m""")
def clean_clipped_predictions(spark, sf):
    from emipanel.operators.skew import attach_row
    p = S.pairs(spark, sf)
    x = attach_row(p, p.where("year < 1997").agg(F.max("y").alias("top")))
    return x.select("l_orderkey", "l_linenumber", r(clip_pred(F.col("p") * 4 - 90000, "top")).alias("pred"))


@query("clean_log_transforms", """SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(log10(c_acctbal), 8) END AS lg,
  round(ln(1 + greatest(c_acctbal, 0)), 8) AS l1p, round(exp(ln(1 + greatest(c_acctbal, 0))) - 1, 4) AS back,
  round(pow(10, c_acctbal / 10000), 8) AS p10 FROM customer""")
def clean_log_transforms(spark, sf):
    b = F.col("c_acctbal")
    return t(spark, sf, "customer").select("c_custkey", r(log10_pos(b), 8).alias("lg"), r(log_target(b), 8).alias("l1p"),
                                           r(unlog(log_target(b)), 4).alias("back"), r(pow10(b / 10000), 8).alias("p10"))


_VALID = """latitude IS NOT NULL AND longitude IS NOT NULL AND latitude <> 0 AND longitude <> 0
  AND abs(latitude - centre_lat) <= 2 AND abs(longitude - centre_lon) <= 2"""


@query("clean_coordinates", f"""WITH {S.LOCATED} SELECT building_id, ({_VALID}) AS valid,
  (l.city <> 'nyc' AND coalesce(abs(latitude - centre_lat) <= 2 AND abs(longitude - centre_lon) <= 2, false)) OR l.city = 'nyc'
  AS passes FROM located l JOIN centres c ON c.city = l.city""")
def clean_coordinates(spark, sf):
    x = S.located(spark, sf).join(F.broadcast(dims.centres(spark)), "city")
    known = [F.when(F.col("city") != "nyc", F.col(c)) for c in ("centre_lat", "centre_lon")]
    return x.select("building_id", valid_coord("latitude", "longitude", "centre_lat", "centre_lon").alias("valid"),
                    in_radius("latitude", "longitude", *known).alias("passes"))


_SNAP = "(SELECT CASE WHEN z = 0 THEN 0.0::DOUBLE ELSE z END FROM (SELECT round(round_even({} / 0.5::DOUBLE, 0) * 0.5::DOUBLE, 4) AS z))"


@query("clean_grid_location", f"""WITH {S.LOCATED}, v AS (SELECT l.*, centre_lat, centre_lon, ({_VALID}) AS ok
    FROM located l JOIN centres c ON c.city = l.city),
  g AS (SELECT *, {_SNAP.format('CASE WHEN ok THEN latitude ELSE centre_lat END')} AS grid_lat,
    {_SNAP.format('CASE WHEN ok THEN longitude ELSE centre_lon END')} AS grid_lon FROM v)
  SELECT building_id, CASE WHEN ok THEN 'building_grid' ELSE 'city_fallback' END AS climate_source, grid_lat, grid_lon,
    printf('%.4f|%.4f|%d', grid_lat, grid_lon, year) AS query_key FROM g""")
def clean_grid_location(spark, sf):
    return E.location_or_fallback(S.located(spark, sf), F.broadcast(dims.centres(spark))).select(
        "building_id", "climate_source", "grid_lat", "grid_lon", "query_key")


@query("clean_position_features", f"""WITH {S.LOCATED} SELECT building_id,
  CASE WHEN latitude >= 0 THEN 32600 ELSE 32700 END + CAST(trunc((longitude + 180.0) / 6.0) AS BIGINT) + 1 AS epsg,
  round(sin(radians(latitude)), 8) AS lat_sin, round(cos(radians(latitude)), 8) AS lat_cos,
  round(sin(radians(longitude)), 8) AS lon_sin, round(cos(radians(longitude)), 8) AS lon_cos,
  round(sin(2 * pi() * 26 / 52), 8) AS week_sin, round(cos(2 * pi() * 26 / 52), 8) AS week_cos,
  round(sin(2 * pi() * 12 / 24), 8) AS hour_sin, round(cos(2 * pi() * 12 / 24), 8) AS hour_cos FROM located""")
def clean_position_features(spark, sf):
    f = position_features("latitude", "longitude")
    return S.located(spark, sf).select("building_id", utm_epsg("latitude", "longitude").cast("long").alias("epsg"),
                                       *[r(v, 8).alias(k) for k, v in f.items()])


@query("clean_defaults", f"""SELECT c_custkey, coalesce({sql_pick('c_custkey', ['A', None])}, 'Unknown') AS sector,
  coalesce({sql_pick('c_custkey', ['US', None, 'DE'])}, 'XX') AS country FROM customer""")
def clean_defaults(spark, sf):
    k = F.col("c_custkey")
    x = t(spark, sf, "customer").select(k, pick(k, ["A", None]).alias("sector"), pick(k, ["US", None, "DE"]).alias("country"))
    return x.fillna({"sector": "Unknown", "country": "XX"})


_STATUS = ["ok", "no_images", "err:429 Too Many Requests", "err:Internal Error", "http_503", "http_404", "http_x",
           "err:Timeout", "no_match"]


@query("clean_status_scores", f"""WITH x AS (SELECT event_id, {sql_pick('event_id', _STATUS)} AS status,
    {sql_pick('event_id', ['building_patch', 'city_patch'])} AS src FROM events)
  SELECT event_id, CAST(CASE WHEN status = 'ok' THEN 4 WHEN status = 'no_images' THEN 3
    WHEN contains(status, 'Too Many Requests') THEN 2 WHEN contains(lower(status), 'internal error') THEN 1 ELSE 0 END AS BIGINT)
    AS status_score, CAST(src = 'building_patch' AS BIGINT) AS source_score,
    status LIKE 'err:%' OR coalesce(TRY_CAST(regexp_extract(status, '^http_([0-9]+)$', 1) AS INT) BETWEEN 500 AND 599, false)
    AS retry FROM x""")
def clean_status_scores(spark, sf):
    k = F.col("event_id")
    x = t(spark, sf, "events").select(k, pick(k, _STATUS).alias("status"), pick(k, ["building_patch", "city_patch"]).alias("src"))
    return x.select("event_id", score_status("status").cast("long").alias("status_score"),
                    score_source("src").cast("long").alias("source_score"), is_retryable("status").alias("retry"))


@query("clean_address_query", f"""WITH {_PLACES} SELECT c_custkey, trim(concat_ws(' ', concat_ws(', ', nullif(address, ''),
  nullif(suburb, ''), nullif(state, '')), {sql_pick('c_custkey', ['3000', ''])}), ' ') AS q,
  concat_ws(', ', nullif(address, ''), nullif(suburb, ''), nullif(state, '')) AS fallback FROM places""")
def clean_address_query(spark, sf):
    zip_code = pick(F.col("c_custkey"), ["3000", ""])
    parts = ["address", "suburb", "state"]
    return _places(spark, sf).select("c_custkey", build_query(parts, zip_code).alias("q"),
                                     F.concat_ws(", ", *[F.nullif(F.col(p), F.lit("")) for p in parts]).alias("fallback"))


@query("clean_record_text", """SELECT doc_id, concat_ws(chr(10), 'Company: ' || source, 'Country: ' || lang,
  'Sector (GICS): ' || coalesce(CASE WHEN doc_id % 2 = 0 THEN 'Energy' END, 'Unknown'), 'Reporting year: 2020',
  'Annual revenue: ~$' || format('{:,}', n_chars * 10) || ' million USD',
  'Business description: ' || substr(text, 1, 800)) AS record FROM documents""")
def clean_record_text(spark, sf):
    d = t(spark, sf, "documents")
    return d.select("doc_id", render_record("source", "lang", F.when(F.col("doc_id") % 2 == 0, "Energy"), F.lit(2020),
                                            (F.col("n_chars") * 10).cast("double"), "text").alias("record"))


_PROSE = ["about 12,345.5 tonnes", "-1,234.5e3 t", "none", "1.5E+2!", ",", "", "approx. 7", "- 5"]


@query("clean_number_in_text", f"""WITH x AS (SELECT conv_id, turn, {sql_pick('(conv_id + turn)', _PROSE)} || ' ' || text AS txt
    FROM conversations)
  SELECT conv_id, turn, TRY_CAST(replace(regexp_extract(txt, '(-?[0-9,]+\\.?[0-9]*(?:[eE][-+]?[0-9]+)?)', 1), ',', '')
    AS DOUBLE) AS number FROM x""")
def clean_number_in_text(spark, sf):
    txt = F.concat(pick(F.col("conv_id") + F.col("turn"), _PROSE), F.lit(" "), F.col("text"))
    return t(spark, sf, "conversations").select("conv_id", "turn", extract_number(txt).alias("number"))


_MAG = ["mae", "r2", "mape", "log_mae", "other"]


@query("clean_display_text", f"""WITH x AS (SELECT p_partkey, {sql_pick('p_partkey', _MAG)} AS metric,
    p_retailprice * 1.000123456789::DOUBLE * pow(10, p_partkey % 9 - 3) AS v FROM part)
  SELECT p_partkey, CASE WHEN abs(v) >= 1e9 THEN printf('%.2fG tCO2e', v / 1e9) WHEN abs(v) >= 1e6 THEN
    printf('%.2fM tCO2e', v / 1e6) WHEN abs(v) >= 1e3 THEN printf('%.2fK tCO2e', v / 1e3) ELSE printf('%.2f tCO2e', v) END AS magnitude,
    CASE WHEN metric IN ('r2', 'log_mae') THEN printf('%.3f', v) WHEN metric = 'mape' THEN printf('%.2f', v)
      WHEN metric = 'mae' THEN CASE WHEN abs(v) >= 1e6 THEN printf('%.2e', v) WHEN abs(v) >= 1000 THEN
        format('{{:,}}', CAST(round(v) AS BIGINT)) ELSE printf('%.1f', v) END ELSE printf('%.4f', v) END AS display FROM x""")
def clean_display_text(spark, sf):
    k = F.col("p_partkey")
    x = t(spark, sf, "part").select(k, pick(k, _MAG).alias("metric"),
                                    (F.col("p_retailprice") * 1.000123456789 * F.pow(F.lit(10.0), k % 9 - 3)).alias("v"))
    return x.select("p_partkey", format_magnitude("v").alias("magnitude"), format_metric("metric", "v").alias("display"))


STRATA = """cells AS (SELECT *, count(*) OVER (PARTITION BY a, b) AS n1 FROM rows_in),
  wide AS (SELECT *, CASE WHEN n1 >= 5 THEN a || '|' || b ELSE a || '|_tinyRoW' END AS l FROM cells),
  strata AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY l) >= 5 THEN l ELSE '_global' END AS stratum FROM wide)"""


@query("clean_strata", f"""WITH rows_in AS (SELECT c_custkey AS id, c_mktsegment || '_' || CAST(floor(c_acctbal / 500) AS BIGINT) AS a,
    CAST(c_nationkey AS VARCHAR) AS b FROM customer), {STRATA}
  SELECT id, stratum FROM strata""")
def clean_strata(spark, sf):
    c = t(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.concat_ws("_", "c_mktsegment", F.floor(F.col("c_acctbal") / 500)).alias("a"),
        F.col("c_nationkey").cast("string").alias("b"))
    return stratum_label(c, "a", "b").select("id", "stratum")


@query("clean_flags", f"""WITH {S.COMPANIES} SELECT nz_id, (nz_id % 3 <> 0 AND coalesce(revenue > 0, false)) AS subset_strict,
  (nation < 10) AS has_factor_baseline FROM companies""")
def clean_flags(spark, sf):
    from emipanel.plans.company import flag_subsets
    c = S.companies(spark, sf).select(
        "nz_id", F.when(F.col("nz_id") % 3 != 0, "T").alias("ticker"), F.col("revenue").alias("revenue_best_musd"),
        F.when(F.col("nation") < 10, 1.0).alias("factor_tco2e_per_musd"))
    return flag_subsets(c).select("nz_id", "subset_strict", "has_factor_baseline")


@query("clean_any_all_present", f"""WITH {S.PANEL}, w AS (SELECT building_id, sum(target) FILTER (year = 1997) AS a,
    sum(target) FILTER (year = 1998) AS b FROM panel GROUP BY 1)
  SELECT building_id, (a IS NOT NULL OR b IS NOT NULL) AS any_year, (a IS NOT NULL AND b IS NOT NULL) AS all_years,
    CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE round(coalesce(a, 0) + coalesce(b, 0), 2) END AS lenient,
    round(a + b, 2) AS strict FROM w""")
def clean_any_all_present(spark, sf):
    w = S.panel(spark, sf).groupBy("building_id").agg(F.sum(F.when(F.col("year") == 1997, F.col("target"))).alias("a"),
                                                      F.sum(F.when(F.col("year") == 1998, F.col("target"))).alias("b"))
    return w.select("building_id", any_not_null(["a", "b"]).alias("any_year"), all_not_null(["a", "b"]).alias("all_years"),
                    r(sum_unless_all_null("a", "b"), 2).alias("lenient"), r(sum_if_all("a", "b"), 2).alias("strict"))


# ---------------------------------------------------------------- filters

@query("filter_targets", """SELECT p_partkey FROM part WHERE (p_size > 5) AND (p_size <= 10 OR p_retailprice > 950)
  AND (p_size > 20 OR p_retailprice > 1050)""")
def filter_targets(spark, sf):
    x = t(spark, sf, "part").withColumns({
        "y": F.when(F.col("p_size") > 5, F.col("p_size")), "area": F.when(F.col("p_size") > 10, F.col("p_retailprice") - 950),
        "a": F.when(F.col("p_size") > 20, 1), "b": F.when(F.col("p_retailprice") > 1050, 1)})
    x = D.positive_target(D.with_target(x, "y"), "y")
    return D.any_target(D.positive_or_null(x, "area"), ["a", "b"]).select("p_partkey")


@query("filter_outlier_window", """SELECT p_partkey, p_size > 40 AS missing FROM part
  WHERE p_size > 40 OR p_retailprice BETWEEN 950 AND 1400""")
def filter_outlier_window(spark, sf):
    x = t(spark, sf, "part").withColumn("v", F.when(F.col("p_size") <= 40, F.col("p_retailprice")))
    return D.outlier_window(x, "v", 950.0, 1400.0, keep_null=True).select("p_partkey", F.col("v").isNull().alias("missing"))


@query("filter_membership", f"""WITH {S.PANEL} SELECT building_id, year, city FROM panel
  WHERE city IN ('NATION_1', 'NATION_2', 'NATION_10') AND year BETWEEN 1996 AND 1999 AND city LIKE 'NATION_1%'""")
def filter_membership(spark, sf):
    x = D.in_set(S.panel(spark, sf), "city", ["NATION_1", "NATION_2", "NATION_10"])
    return D.with_prefix(D.year_between(x, "year", 1996, 1999), "city", "NATION_1").select("building_id", "year", "city")


@query("filter_usable_embeddings", f"""SELECT vec_id, CAST(label AS BIGINT) AS label FROM embeddings WHERE
  {sql_pick('vec_id', ['ok', 'no_images'])} = 'ok' AND {sql_pick('vec_id', ['building_patch', 'city', 'building_patch'])} = 'building_patch'""")
def filter_usable_embeddings(spark, sf):
    k = F.col("vec_id")
    x = t(spark, sf, "embeddings").withColumns({"status": pick(k, ["ok", "no_images"]),
                                                "img_source": pick(k, ["building_patch", "city", "building_patch"])})
    return D.usable_embeddings(x).select("vec_id", F.col("label").cast("long").alias("label"))


@query("filter_min_group_size", f"""WITH {S.PANEL} SELECT city, year, building_id FROM panel
  QUALIFY count(*) OVER (PARTITION BY city, year) >= 50""")
def filter_min_group_size(spark, sf):
    return D.having_count(S.panel(spark, sf), ["city", "year"], 50).select("city", "year", "building_id")


@query("filter_min_years", f"""WITH {S.PANEL} SELECT building_id, year FROM panel WHERE building_id IN
  (SELECT building_id FROM panel GROUP BY 1 HAVING count(DISTINCT year) >= 6)""")
def filter_min_years(spark, sf):
    return D.min_years(S.panel(spark, sf), "building_id", "year", 6).select("building_id", "year")


@query("filter_turning_points", f"""WITH {S.PANEL}, {S.LAGGED} SELECT building_id, year FROM lagged
  WHERE abs(log10(target) - log10(lag1)) > 0.08""")
def filter_turning_points(spark, sf):
    x = lags(S.panel(spark, sf), "building_id", "year", "target", 1, "lag")
    x = x.withColumns({"a": F.log10("target"), "b": F.log10("lag1")})
    return D.turning_points(x, "a", "b").select("building_id", "year")


@query("filter_finite_pairs", """SELECT p_partkey FROM part WHERE p_size % 5 NOT IN (1, 2, 3)""")
def filter_finite_pairs(spark, sf):
    k = F.col("p_size") % 5
    x = t(spark, sf, "part").withColumns({
        "y": F.when(k == 1, float("nan")).when(k == 2, None).otherwise(F.col("p_retailprice")),
        "p": F.when(k == 3, float("-inf")).otherwise(F.col("p_retailprice"))})
    return D.finite_pairs(x, "y", "p").select("p_partkey")


@query("filter_all_null_features", """SELECT p_type, count(p_size) AS size_present, count(*) AS n FROM part GROUP BY 1""")
def filter_all_null_features(spark, sf):
    x = t(spark, sf, "part").withColumn("empty", F.lit(None).cast("double"))
    cols = D.drop_all_null(x.where("p_size < 25"), ["p_size", "empty"])
    return x.groupBy("p_type").agg(*[F.count(c).alias(f"{c[2:]}_present") for c in cols], F.count(F.lit(1)).alias("n"))


@query("filter_require_lag1", f"""WITH {S.PANEL}, {S.LAGGED} SELECT building_id, year, lag1 FROM lagged WHERE lag1 IS NOT NULL""")
def filter_require_lag1(spark, sf):
    x = lags(S.panel(spark, sf), "building_id", "year", "target", 1, "lag")
    return D.require_lag1(x).select("building_id", "year", "lag1")
