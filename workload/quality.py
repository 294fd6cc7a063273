"""Aggregations and data-quality reports."""

from pyspark.sql import functions as F

from emipanel.functions import extract_number
from emipanel.operators import aggregates as G
from workload import stage as S
from workload.registry import query
from workload.stage import pick, r, sql_pick, t


@query("agg_sector_totals", f"""WITH {S.ACCOUNTS} SELECT nation, p_type, year, round(sum(ghg), 2) AS ghg_kgco2e,
  round(sum(va), 2) AS va_meur, count(DISTINCT p_brand) AS n_sectors FROM accounts WHERE p_type <> 'PROMO' GROUP BY 1, 2, 3""")
def agg_sector_totals(spark, sf):
    out = G.sector_totals(S.accounts(spark, sf), ["nation", "p_type", "year"], "ghg", "va", "p_brand", "p_type", "PROMO")
    return out.withColumns({"ghg_kgco2e": r("ghg_kgco2e", 2), "va_meur": r("va_meur", 2)})


@query("agg_intensity", f"""WITH {S.ACCOUNTS} SELECT nation, year, round(sum(ghg) / 1000 / (sum(va) * 1.08::DOUBLE), 6) AS tco2e_per_musd
  FROM accounts GROUP BY 1, 2""")
def agg_intensity(spark, sf):
    x = S.accounts(spark, sf).groupBy("nation", "year").agg(F.sum("ghg").alias("ghg_kgco2e"), F.sum("va").alias("va_meur"))
    return G.intensity(x).select("nation", "year", r("tco2e_per_musd", 6).alias("tco2e_per_musd"))


_LEVELS = {"type": "p_type", "brand": "p_brand", "flag": "l_returnflag"}


@query("agg_intensity_ladder", f"""WITH {S.PAIRS}, g AS (SELECT 'type' AS level, p_type AS label, y, l_quantity FROM pairs
    UNION ALL SELECT 'brand', p_brand, y, l_quantity FROM pairs UNION ALL SELECT 'flag', l_returnflag, y, l_quantity FROM pairs)
  SELECT level, label, round(sum(y) / sum(l_quantity), 4) AS factor, count(*) AS n_train FROM g WHERE l_quantity > 0 GROUP BY 1, 2""")
def agg_intensity_ladder(spark, sf):
    return G.intensity_ladder(S.pairs(spark, sf), _LEVELS, "y", "l_quantity").withColumn("factor", r("factor"))


@query("agg_ladder_over_ratio", f"""WITH {S.PAIRS}, g AS (SELECT 'type' AS level, p_type AS label, y, l_quantity FROM pairs WHERE year < 1999
    UNION ALL SELECT 'brand', p_brand, y, l_quantity FROM pairs WHERE year < 1999),
  f AS (SELECT level, label, sum(y) / sum(l_quantity) AS factor FROM g GROUP BY 1, 2),
  c AS (SELECT 'type' AS level, p_type AS label, y, l_quantity FROM pairs WHERE year >= 1999
    UNION ALL SELECT 'brand', p_brand, y, l_quantity FROM pairs WHERE year >= 1999)
  SELECT level, count(*) AS n, round(avg(factor * l_quantity), 4) AS mean_pred, round(avg(factor * l_quantity / y), 6) AS mean_over
  FROM c JOIN f USING (level, label) GROUP BY 1""")
def agg_ladder_over_ratio(spark, sf):
    p = S.pairs(spark, sf)
    levels = {"type": "p_type", "brand": "p_brand"}
    ladder = G.intensity_ladder(p.where("year < 1999"), levels, "y", "l_quantity")
    out = G.apply_ladder(ladder, p.where("year >= 1999").select("p_type", "p_brand", "y", "l_quantity"), levels, "y", "l_quantity")
    return out.groupBy("level").agg(F.count(F.lit(1)).alias("n"), r(F.avg("pred_tco2e")).alias("mean_pred"),
                                    r(F.avg("over_ratio"), 6).alias("mean_over"))


_RAW = """raw AS (SELECT n_name AS city, CASE WHEN o_orderkey % 29 = 0 THEN 'x_row_' || o_orderkey ELSE CAST(o_custkey AS VARCHAR) END
    AS building, CAST(year(o_orderdate) AS BIGINT) AS year, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS target,
    CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status, CAST(NULL AS DOUBLE) AS empty
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"""


def _raw(spark, sf):
    o, c, n = t(spark, sf, "orders"), t(spark, sf, "customer"), t(spark, sf, "nation")
    k = F.col("o_orderkey")
    return (o.join(c, F.col("c_custkey") == F.col("o_custkey")).join(n, F.col("n_nationkey") == F.col("c_nationkey"))
            .select(F.col("n_name").alias("city"), F.when(k % 29 == 0, F.concat(F.lit("x_row_"), k)).otherwise(
                F.col("o_custkey").cast("string")).alias("building"), F.year("o_orderdate").cast("long").alias("year"),
                F.when(k % 5 != 0, F.col("o_totalprice")).alias("target"),
                F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"),
                F.lit(None).cast("double").alias("empty")))


@query("agg_validation_summary", f"""WITH {_RAW} SELECT city, count(*) AS n_rows, count(DISTINCT building) AS unique_buildings,
  min(year) AS year_min, max(year) AS year_max, count(DISTINCT year) AS n_years, count(target) AS target_non_null,
  count(status) AS status_non_null, count(*) - count(DISTINCT (building, year)) AS duplicate_rows,
  count(*) FILTER (contains(building, '_row_')) AS fallback_ids FROM raw GROUP BY 1""")
def agg_validation_summary(spark, sf):
    return G.validation_summary(_raw(spark, sf), "city", "building", "year", {"target": "target", "status": "status"})


@query("agg_availability_long", f"""WITH {_RAW}, a AS (SELECT city, count(*) AS n, count(target) AS t, count(status) AS s, count(empty) AS e
    FROM raw GROUP BY 1), l AS (SELECT city, n, 'target' AS "column", t AS c FROM a UNION ALL SELECT city, n, 'status', s FROM a
    UNION ALL SELECT city, n, 'empty', e FROM a)
  SELECT city, "column", c AS non_null_count, round((1 - c / n) * 100, 6) AS missing_rate_pct, c = 0 AS all_null FROM l""")
def agg_availability_long(spark, sf):
    return G.availability_long(_raw(spark, sf), "city", ["target", "status", "empty"]).withColumn(
        "missing_rate_pct", r("missing_rate_pct", 6))


@query("agg_availability_wide", f"""WITH {_RAW} SELECT city, count(*) AS n_rows, count(DISTINCT building) AS n_buildings,
  round(100.0::DOUBLE * count(target) / count(*), 1) AS target, round(100.0::DOUBLE * count(status) / count(*), 1) AS status
  FROM raw GROUP BY 1""")
def agg_availability_wide(spark, sf):
    return G.availability_wide(_raw(spark, sf), "city", ["target", "status"], "building")


@query("agg_coverage", f"""WITH {_RAW} SELECT CASE WHEN GROUPING(status) = 1 THEN 'ALL' ELSE status END AS status, count(*) AS n_rows,
  count(target) AS target_present, count(empty) AS empty_present FROM raw GROUP BY ROLLUP (status)""")
def agg_coverage(spark, sf):
    return G.coverage(_raw(spark, sf), "status", ["target", "empty"])


@query("agg_top_categories", "SELECT p_name, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7")
def agg_top_categories(spark, sf):
    return G.value_counts(t(spark, sf, "part"), "p_name", 7)


@query("agg_id_statistics", f"""WITH {_RAW}, b AS (SELECT city, building, count(DISTINCT year) AS y FROM raw GROUP BY 1, 2)
  SELECT city, count(*) AS n_buildings, round(avg(CASE WHEN y > 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS multi_year_share,
    round(avg(y), 6) AS mean_years, count(*) FILTER (contains(building, '_row_')) AS fallback_ids FROM b GROUP BY 1""")
def agg_id_statistics(spark, sf):
    return G.id_statistics(_raw(spark, sf), "city", "building", "year").withColumns(
        {"multi_year_share": r("multi_year_share", 6), "mean_years": r("mean_years", 6)})


@query("agg_missing_rates", f"""WITH {_RAW} SELECT 'target' AS "column", round(1 - count(target) / count(*), 6) AS missing_rate FROM raw
  UNION ALL SELECT 'status', round(1 - count(status) / count(*), 6) FROM raw
  UNION ALL SELECT 'empty', round(1 - count(empty) / count(*), 6) FROM raw""")
def agg_missing_rates(spark, sf):
    return G.missing_rates(_raw(spark, sf), ["target", "status", "empty"]).withColumn("missing_rate", r("missing_rate", 6))


@query("agg_median_top", """SELECT p_brand, round(median(p_retailprice), 4) AS median_price FROM part GROUP BY 1
  ORDER BY 2 DESC, 1 LIMIT 10""")
def agg_median_top(spark, sf):
    return G.median_by(t(spark, sf, "part"), ["p_brand"], "p_retailprice", "median_price", 10).withColumn(
        "median_price", r("median_price"))


@query("agg_median_hot_groups", """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1,
  round(median(l_extendedprice), 4) AS q2, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3 FROM lineitem GROUP BY 1""")
def agg_median_hot_groups(spark, sf):
    """Three groups hold all line items."""
    from emipanel.operators.skew import exact_quantiles
    q = exact_quantiles(t(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.25, 0.5, 0.75], ["q1", "q2", "q3"])
    return q.withColumns({c: r(c) for c in ("q1", "q2", "q3")})


@query("agg_before_after", """SELECT round(max(l_extendedprice), 4) AS max_before, round(max(l_extendedprice / 0.92::DOUBLE), 4) AS max_after,
  round(median(l_extendedprice), 4) AS median_before, round(median(l_extendedprice / 0.92::DOUBLE), 4) AS median_after FROM lineitem""")
def agg_before_after(spark, sf):
    x = t(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("b"), (F.col("l_extendedprice") / 0.92).alias("a"))
    out = G.before_after(x, "b", "a")
    return out.select(*[r(c).alias(c) for c in out.columns])


@query("agg_annual_climate", f"""WITH {S.DAILY}, d AS (SELECT grid, CAST(month(day) AS BIGINT) AS period,
    CASE WHEN grid <> 2 OR day(day) <> 9 THEN temp END AS temp, humidity FROM daily)
  SELECT grid, period, CASE WHEN count(*) >= 29 AND count(temp) = count(*) THEN round(sum(greatest(18 - temp, 0)), 4) END AS hdd_18c,
    CASE WHEN count(*) >= 29 AND count(temp) = count(*) THEN round(sum(greatest(temp - 18, 0)), 4) END AS cdd_18c,
    round(avg(temp), 4) AS annual_mean_temp_c, round(avg(humidity), 4) AS annual_rh_mean,
    round(avg(humidity) * 0.0864::DOUBLE, 6) AS annual_ssrd_mj_m2_day, round(avg(temp), 4) AS annual_wind_ms FROM d GROUP BY 1, 2""")
def agg_annual_climate(spark, sf):
    d = S.daily(spark, sf).withColumn("period", F.month("day").cast("long")).withColumn(
        "temp", F.when((F.col("grid") != 2) | (F.dayofmonth("day") != 9), F.col("temp")))
    out = G.annual_climate(d, ["grid", "period"], "temp", "humidity", "humidity", "temp", full_year=29)
    return out.select("grid", "period", *[r(c, 6 if "ssrd" in c else 4).alias(c) for c in out.columns[2:]])


@query("agg_seed_summary", f"""WITH {S.RESULTS} SELECT feature_set, model, city, metric, count(DISTINCT seed) AS n_seeds,
  array_to_string(list_sort(list_distinct(list(seed))), ',') AS seeds, count(value) AS n, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS std
  FROM results GROUP BY 1, 2, 3, 4""")
def agg_seed_summary(spark, sf):
    out = G.aggregate_seeds(S.results(spark, sf), ["feature_set", "model", "city"])
    return out.withColumns({"mean": r("mean", 5), "std": r("std", 5)})


@query("agg_drop_city_summary", f"""WITH {S.RESULTS}, x AS (SELECT * FROM results WHERE metric = 'r2')
  SELECT feature_set, model, seed, max(CASE WHEN city = 'N' AND value IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS dropped_was_present,
    count(value) FILTER (city <> 'N') AS n_cities_retained, round(avg(value) FILTER (city <> 'N'), 5) AS macro,
    round(min(value) FILTER (city <> 'N'), 5) AS lowest, round(max(value) FILTER (city <> 'N'), 5) AS highest,
    round(quantile_cont(value, 0.25) FILTER (city <> 'N'), 5) AS q1, round(quantile_cont(value, 0.5) FILTER (city <> 'N'), 5) AS median,
    round(quantile_cont(value, 0.75) FILTER (city <> 'N'), 5) AS q3, 'N' AS drop_city FROM x GROUP BY 1, 2, 3""")
def agg_drop_city_summary(spark, sf):
    x = S.results(spark, sf).where("metric = 'r2'")
    out = G.drop_city_summary(x, ["feature_set", "model", "seed"], "city", "N")
    return out.withColumns({c: r(c, 5) for c in ("macro", "q1", "median", "q3", "lowest", "highest")}).withColumn(
        "dropped_was_present", F.col("dropped_was_present").cast("long"))


@query("agg_pivot_summary", f"""WITH {S.RESULTS}, x AS (SELECT model, city, avg(value) AS v FROM results WHERE metric = 'mae' GROUP BY 1, 2)
  SELECT model, round(max(v) FILTER (city = 'A'), 4) AS A, round(max(v) FILTER (city = 'N'), 4) AS N, round(max(v) FILTER (city = 'R'), 4) AS R,
    round(avg(v), 4) AS row_mean FROM x GROUP BY 1""")
def agg_pivot_summary(spark, sf):
    out = G.pivot_summary(S.results(spark, sf).where("metric = 'mae'"), ["model"], "city", ["A", "N", "R"], "value")
    return out.select("model", *[r(c).alias(c) for c in ("A", "N", "R", "row_mean")])


@query("agg_ratio_quality", f"""WITH {S.PAIRS} SELECT count(*) AS n, round(corr(log10(p), log10(y)), 6) AS pearson_log,
  round(median(abs(log10(p) - log10(y))), 6) AS median_abs_log_ratio, round(median(abs(p - y) / y), 6) AS median_ape
  FROM pairs WHERE p > 0 AND y > 0""")
def agg_ratio_quality(spark, sf):
    out = G.ratio_quality(S.pairs(spark, sf), "p", "y")
    return out.select("n", *[r(c, 6).alias(c) for c in out.columns[1:]])


@query("agg_cohort_ratio", f"""WITH {S.PAIRS} SELECT p_type, l_returnflag, count(*) AS n, round(pow(10, avg(abs(log10(p / y)))), 6) AS geo_fold_error,
  round(median(log10(p / y)), 6) AS median_log_ratio FROM pairs WHERE p > 0 AND y > 0 GROUP BY 1, 2""")
def agg_cohort_ratio(spark, sf):
    out = G.cohort_ratio(S.pairs(spark, sf), ["p_type", "l_returnflag"], "p", "y")
    return out.withColumns({c: r(c, 6) for c in ("geo_fold_error", "median_log_ratio")})


@query("agg_status_counts", """SELECT event_type, user_id % 5 AS city, count(*) AS n FROM events GROUP BY 1, 2""")
def agg_status_counts(spark, sf):
    return G.status_counts(t(spark, sf, "events").withColumn("city", F.pmod("user_id", F.lit(5))), ["event_type", "city"])


_PROSE = ["about 12,345.5 t", "none", "1.5E+2!", "no digits"]


@query("agg_parse_counts", f"""WITH x AS (SELECT role, {sql_pick('(conv_id + turn)', _PROSE)} AS txt FROM conversations)
  SELECT role, count(*) AS n_rows, count(TRY_CAST(replace(regexp_extract(txt, '(-?[0-9,]+\\.?[0-9]*(?:[eE][-+]?[0-9]+)?)', 1), ',', '')
    AS DOUBLE)) AS n_parsed, round(count(TRY_CAST(replace(regexp_extract(txt, '(-?[0-9,]+\\.?[0-9]*(?:[eE][-+]?[0-9]+)?)', 1), ',', '')
    AS DOUBLE)) / count(*), 6) AS parsed_share FROM x GROUP BY 1""")
def agg_parse_counts(spark, sf):
    x = t(spark, sf, "conversations").withColumn("number", extract_number(pick(F.col("conv_id") + F.col("turn"), _PROSE)))
    return G.parse_counts(x, "number", ["role"]).withColumn("parsed_share", r("parsed_share", 6))


@query("agg_dedup_factor", """SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, max(n) AS largest_group,
  round(sum(n) / count(*), 6) AS avg_dedup_factor FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, year(o_orderdate))""")
def agg_dedup_factor(spark, sf):
    x = t(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("y"))
    return G.dedup_factor(x, ["o_custkey", "y"]).withColumn("avg_dedup_factor", r("avg_dedup_factor", 6))


@query("agg_seed_spread", f"""WITH {S.RESULTS} SELECT model, count(value) AS n, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS std,
  round(min(value), 5) AS min, round(max(value), 5) AS max, round(median(value), 5) AS median FROM results WHERE metric = 'mae' GROUP BY 1""")
def agg_seed_spread(spark, sf):
    out = G.seed_spread(S.results(spark, sf).where("metric = 'mae'"), ["model"], "value")
    return out.withColumns({c: r(c, 5) for c in ("mean", "std", "median", "min", "max")})
