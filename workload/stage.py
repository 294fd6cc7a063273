"""Stand-ins for the domain tables, derived from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(c, n: int = 4) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, n)


def pick(index: Column, values) -> Column:
    """values[index % len(values)]"""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def sql_text(v) -> str:
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v)


def sql_list(values) -> str:
    return "[" + ", ".join(sql_text(v) for v in values) + "]"


def sql_in(values) -> str:
    return "(" + ", ".join(sql_text(v) for v in values) + ")"


def sql_pick(index: str, values) -> str:
    return f"({sql_list(values)})[CAST({index} % {len(values)} AS BIGINT) + 1]"


def sql_hash(seed, *keys) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(keys)})), 1, 8) AS BIGINT)"


# Prices are cents, so averages of them often end in an exact 5, which two engines may round apart;
# a unit factor with many digits removes such ties.
SCALE = 1.000123456789


# ---- building panel: one row per (city, building, year)

def panel(spark, sf) -> DataFrame:
    """Orders are reduced to (customer, year) before they meet a dimension."""
    o = (t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("building_id"),
                                        F.year("o_orderdate").cast("long").alias("year"))
         .agg((F.round(F.sum("o_totalprice"), 2) * SCALE).alias("target"), F.count(F.lit(1)).alias("n_orders")))
    c = t(spark, sf, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("property_type"),
                                        F.abs("c_acctbal").alias("area"))
    n = t(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("city"),
                                      F.col("n_regionkey").cast("long").alias("region"))
    return (o.join(c, o.building_id == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
            .select("city", "building_id", "year", "property_type", "target", "area", "n_orders", "region"))


PANEL = f"""panel AS (
  SELECT n_name AS city, building_id, year, c_mktsegment AS property_type, target, abs(c_acctbal) AS area,
         n_orders, CAST(n_regionkey AS BIGINT) AS region
  FROM (SELECT o_custkey AS building_id, CAST(year(o_orderdate) AS BIGINT) AS year,
               round(sum(o_totalprice), 2) * {SCALE}::DOUBLE AS target, count(*) AS n_orders
        FROM orders GROUP BY 1, 2) o
  JOIN customer ON c_custkey = building_id JOIN nation ON n_nationkey = c_nationkey)"""

WIN = "(PARTITION BY building_id ORDER BY year)"
PAST = "(PARTITION BY building_id ORDER BY year ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"
LAGGED = f"""lagged AS (
  SELECT *, lag(target, 1) OVER {WIN} AS lag1, lag(target, 2) OVER {WIN} AS lag2,
         lag(target, 3) OVER {WIN} AS lag3, avg(target) OVER {PAST} AS mean_hist,
         coalesce(stddev_samp(target) OVER {PAST}, 0) AS std_hist
  FROM panel)"""


# ---- prediction pairs: truth, two predictions, groups

def pairs(spark, sf) -> DataFrame:
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag",
                                         F.year("l_shipdate").cast("long").alias("year"),
                                         F.col("l_extendedprice").alias("y"), "l_quantity", "l_discount", "l_tax")
    p = t(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_retailprice")
    out = li.join(p, li.l_partkey == p.p_partkey)
    return out.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", "l_suppkey",
                      "l_returnflag", "year", "p_brand", "p_type", "y",
                      (F.col("l_quantity") * F.col("p_retailprice") * SCALE).alias("p"),
                      (F.col("l_quantity") * (1500.0 * SCALE)).alias("q"),
                      "l_quantity", "l_discount", "l_tax", "p_retailprice")


PAIRS = f"""pairs AS (
  SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, l_returnflag,
         CAST(year(l_shipdate) AS BIGINT) AS year, p_brand, p_type, l_extendedprice AS y,
         l_quantity * p_retailprice * {SCALE}::DOUBLE AS p, l_quantity * {1500.0 * SCALE!r}::DOUBLE AS q, l_quantity, l_discount, l_tax,
         p_retailprice
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""


# ---- company-like rows: one per customer, with currency, sector and country labels

CURRENCIES = ["USD", "JPY", "EUR", "gbp", "XXX", "AUD", "INR"]
SECTORS_RAW = ["Consumer Goods", "Financials", "Information Not Available", "Transportation", "Unlisted",
               "Extractives & Minerals Processing"]
SECTORS_ALT = [" Energy ", "", "Real Estate", "Technology"]
COUNTRIES = ["US", "DE", "JP", "TH", "BR", "EG", "CO", "AE", "GB", "ZZ", "IS"]


def companies(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    return t(spark, sf, "customer").select(
        k.alias("nz_id"), F.col("c_name").alias("company_name"), pick(k, CURRENCIES).alias("currency"),
        pick(k, SECTORS_RAW).alias("sics_sector"), pick(k, SECTORS_ALT).alias("yf_sector"),
        pick(k, COUNTRIES).alias("country_iso2"), (F.col("c_acctbal") * 1000.0).alias("revenue"),
        F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("long").alias("nation"))


COMPANIES = f"""companies AS (
  SELECT c_custkey AS nz_id, c_name AS company_name, {sql_pick('c_custkey', CURRENCIES)} AS currency,
         {sql_pick('c_custkey', SECTORS_RAW)} AS sics_sector, {sql_pick('c_custkey', SECTORS_ALT)} AS yf_sector,
         {sql_pick('c_custkey', COUNTRIES)} AS country_iso2, c_acctbal * 1000.0::DOUBLE AS revenue,
         c_mktsegment AS segment, CAST(c_nationkey AS BIGINT) AS nation FROM customer)"""


# ---- located buildings: customers placed around known city centres

def located(spark, sf) -> DataFrame:
    from emipanel import dims

    k = F.col("c_custkey")
    names = list(dims.CITY_CENTRES)
    lat = pick(k, [v[0] for v in dims.CITY_CENTRES.values()])
    lon = pick(k, [v[1] for v in dims.CITY_CENTRES.values()])
    step = F.pmod(k, F.lit(11)) * 0.5
    return t(spark, sf, "customer").select(
        pick(k, names).alias("city"), k.alias("building_id"), F.lit(2000).cast("long").alias("year"),
        F.when(F.pmod(k, F.lit(13)) == 0, None).when(F.pmod(k, F.lit(17)) == 0, 0.0)
        .otherwise(lat + step - 2.5).alias("latitude"),
        F.when(F.pmod(k, F.lit(13)) == 0, None).otherwise(lon + step - 2.75).alias("longitude"))


def _located_sql() -> str:
    from emipanel import dims

    names, lat = list(dims.CITY_CENTRES), [v[0] for v in dims.CITY_CENTRES.values()]
    lon = [v[1] for v in dims.CITY_CENTRES.values()]

    def doubles(values):
        return f"({sql_list(values)}::DOUBLE[])[CAST(c_custkey % {len(values)} AS BIGINT) + 1]"

    centres = ", ".join(f"({sql_text(c)}, {a}::DOUBLE, {b}::DOUBLE)" for c, (a, b) in dims.CITY_CENTRES.items())
    return f"""located AS (
  SELECT {sql_pick('c_custkey', names)} AS city, c_custkey AS building_id, CAST(2000 AS BIGINT) AS year,
         CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN 0.0::DOUBLE
              ELSE {doubles(lat)} + (c_custkey % 11) * 0.5::DOUBLE - 2.5::DOUBLE END AS latitude,
         CASE WHEN c_custkey % 13 = 0 THEN NULL
              ELSE {doubles(lon)} + (c_custkey % 11) * 0.5::DOUBLE - 2.75::DOUBLE END AS longitude
  FROM customer),
centres(city, centre_lat, centre_lon) AS (VALUES {centres})"""


LOCATED = _located_sql()


# ---- detailed accounts: emissions and value added by supplier nation, part brand/type and year

def accounts(spark, sf) -> DataFrame:
    """Line items are reduced to (part, supplier, year) sums before the joins."""
    li = (t(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey", F.year("l_shipdate").cast("long").alias("year"))
          .agg(F.sum("l_extendedprice").alias("ghg"), F.sum("l_quantity").alias("va")))
    p = t(spark, sf, "part").select("p_partkey", "p_type", "p_brand")
    s = t(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("nation"))
    return (li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey)
            .select("nation", "p_type", "p_brand", "year", "ghg", "va"))


ACCOUNTS = """accounts AS (
  SELECT CAST(s_nationkey AS BIGINT) AS nation, p_type, p_brand, CAST(year(l_shipdate) AS BIGINT) AS year,
         l_extendedprice AS ghg, l_quantity AS va
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)"""


# ---- daily series per grid cell

def daily(spark, sf) -> DataFrame:
    return (t(spark, sf, "events").groupBy(F.pmod("user_id", F.lit(5)).alias("grid"), F.to_date("ts").alias("day"))
            .agg((F.avg("value") * SCALE - 2.0).alias("temp"), (F.max("value") * SCALE).alias("humidity")))


DAILY = f"""daily AS (
  SELECT user_id % 5 AS grid, CAST(ts AS DATE) AS day, avg(value) * {SCALE}::DOUBLE - 2.0::DOUBLE AS temp,
         max(value) * {SCALE}::DOUBLE AS humidity FROM events GROUP BY 1, 2)"""


# ---- results of "models" (brands) over "seeds" (years) and "cities" (return flags), long form

def results(spark, sf) -> DataFrame:
    from emipanel.operators.metrics import all_metrics, to_long

    p = pairs(spark, sf).withColumn("feature_set", pick(F.substring("p_brand", 7, 2).cast("int"),
                                                        ["core_all_cities", "core_all_cities_climate_plus",
                                                         "us_core"]))
    s = all_metrics(p, ["feature_set", "p_brand", "year", "l_returnflag"], "y", "p", names=("mae", "r2"))
    return to_long(s, ["feature_set", "p_brand", "year", "l_returnflag", "n"], ("mae", "r2")).select(
        "feature_set", F.col("p_brand").alias("model"), F.col("year").alias("seed"),
        F.col("l_returnflag").alias("city"), "n", "metric", "value")


MAE_SQL = "avg(abs(y - p))"
R2_SQL = ("CASE WHEN var_pop(y) = 0 THEN CASE WHEN sum((y - p) * (y - p)) = 0 THEN 1.0 ELSE 0.0 END "
          "ELSE 1 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(*), 0) END")
RESULTS = f"""{PAIRS},
scored AS (
  SELECT (['core_all_cities', 'core_all_cities_climate_plus', 'us_core'])
           [CAST(CAST(substr(p_brand, 7, 2) AS INT) % 3 AS BIGINT) + 1] AS feature_set,
         p_brand AS model, year AS seed, l_returnflag AS city, count(*) AS n,
         {MAE_SQL} AS mae, CAST({R2_SQL} AS DOUBLE) AS r2
  FROM pairs GROUP BY 1, 2, 3, 4),
results AS (
  SELECT feature_set, model, seed, city, n, 'mae' AS metric, mae AS value FROM scored
  UNION ALL SELECT feature_set, model, seed, city, n, 'r2', r2 FROM scored)"""
