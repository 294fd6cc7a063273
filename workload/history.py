"""Windows, ordering, reshaping and closed-form forecasts."""

from pyspark.sql import functions as F

from emipanel.operators import forecasts as M
from emipanel.operators import ordering as I
from emipanel.operators import reshape as J
from emipanel.operators import windows as H
from emipanel.operators.metrics import METRICS
from emipanel.functions import hash32
from emipanel.plans.experiments import FORECASTERS, forecast_frame, score_wide
from emipanel.plans.experiments import forecast_report, forecast_runs
from workload import stage as S
from workload.registry import query
from workload.stage import r, sql_hash, t

_P = ("building_id", "year")


def _panel(spark, sf):
    return S.panel(spark, sf)


_METRIC_SQL = """round(avg(mae), 4) AS macro_mae, round(avg(rmse), 4) AS macro_rmse, round(avg(mape), 4) AS macro_mape,
  round(avg(r2), 5) AS macro_r2, round(avg(nrmse), 5) AS macro_nrmse, round(avg(log_mae), 5) AS macro_log_mae"""
SCORES = """avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse,
  100 * avg(CASE WHEN abs(y) > 1 THEN abs(y - p) / abs(y) END) AS mape,
  CASE WHEN var_pop(y) = 0 THEN CASE WHEN sum((y - p) * (y - p)) = 0 THEN 1.0 ELSE 0.0 END
    ELSE 1 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(*), 0) END AS r2,
  sqrt(avg((y - p) * (y - p))) / nullif(avg(abs(y)), 0) AS nrmse,
  avg(abs(ln(greatest(y, 0) + 1) - ln(greatest(p, 0) + 1))) AS log_mae"""
AR1_SQL = """ar_s AS (SELECT building_id, year, ln(1 + lag3) AS a, ln(1 + lag2) AS b, ln(1 + lag1) AS c FROM lagged WHERE lag1 IS NOT NULL),
  ar_m AS (SELECT *, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT AS n FROM ar_s),
  ar_q AS (SELECT *, (coalesce(a, 0) + coalesce(b, 0)) / nullif(n, 0) AS mx, (CASE WHEN a IS NOT NULL THEN b ELSE 0 END
    + CASE WHEN b IS NOT NULL THEN c ELSE 0 END) / nullif(n, 0) AS my, (coalesce(a * a, 0) + coalesce(b * b, 0)) / nullif(n, 0) AS sxx,
    (coalesce(a * b, 0) + coalesce(b * c, 0)) / nullif(n, 0) AS sxy FROM ar_m),
  ar_z AS (SELECT *, CASE WHEN sxx - mx * mx > 1e-6 THEN greatest(least((sxy - mx * my) / (sxx - mx * mx), 0.99), -0.99) ELSE 0 END AS phi FROM ar_q),
  ar1 AS (SELECT building_id, year, greatest(exp(coalesce(my - phi * mx + phi * c, c)) - 1, 0) AS p FROM ar_z)"""


def holt_sql(name: str, phis) -> str:
    """Holt over up to three lags, unrolled: the first two values start level and trend, each later one updates them."""
    grid = [(a, b, p) for a in M.HOLT_ALPHA for b in M.HOLT_BETA for p in phis]
    values = ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE, {p}::DOUBLE)" for i, (a, b, p) in enumerate(grid))
    return f"""{name}_g(i, al, be, ph) AS (VALUES {values}),
  {name}_s AS (SELECT building_id, year, lag1, ln(1 + coalesce(lag3, lag2)) AS z1, ln(1 + CASE WHEN lag3 IS NULL THEN lag1 ELSE lag2 END) AS z2,
    CASE WHEN lag3 IS NOT NULL THEN ln(1 + lag1) END AS z3 FROM lagged WHERE lag1 IS NOT NULL),
  {name}_1 AS (SELECT *, z1 + ph * (z2 - z1) AS g1 FROM {name}_s, {name}_g WHERE z1 IS NOT NULL),
  {name}_2 AS (SELECT *, al * z2 + (1 - al) * g1 AS l1 FROM {name}_1),
  {name}_3 AS (SELECT *, be * (l1 - z1) + (1 - be) * ph * (z2 - z1) AS t1, (z2 - g1) * (z2 - g1) AS e1 FROM {name}_2),
  {name}_4 AS (SELECT *, l1 + ph * t1 AS g2 FROM {name}_3),
  {name}_5 AS (SELECT *, al * z3 + (1 - al) * g2 AS l2 FROM {name}_4),
  {name}_6 AS (SELECT *, be * (l2 - l1) + (1 - be) * ph * t1 AS t2, e1 + (z3 - g2) * (z3 - g2) AS e2 FROM {name}_5),
  {name}_7 AS (SELECT building_id, year, arg_min(f, i) AS f FROM (SELECT building_id, year, i, coalesce(e2, e1) AS e,
    CASE WHEN z3 IS NULL THEN g2 ELSE l2 + ph * t2 END AS f, min(coalesce(e2, e1)) OVER (PARTITION BY building_id, year) AS least_e FROM {name}_6)
    WHERE e <= least_e + 1e-9 GROUP BY 1, 2),
  {name} AS (SELECT building_id, year, CASE WHEN f IS NULL OR exp(f) - 1 < 0 THEN lag1 ELSE exp(f) - 1 END AS p
    FROM {name}_s LEFT JOIN {name}_7 USING (building_id, year))"""


_FORECAST_SQL = f"""{S.PANEL}, {S.LAGGED}, h AS (SELECT * FROM lagged WHERE lag1 IS NOT NULL),
  f AS (SELECT 'persistence' AS model, city, target AS y, lag1 AS p FROM h
    UNION ALL SELECT 'moving_average', city, target, mean_hist FROM h
    UNION ALL SELECT 'two_point_trend', city, target, greatest(coalesce(2 * lag1 - lag2, lag1), 0) FROM h)"""


@query("forecast_city_scores", f"""WITH {_FORECAST_SQL}, c AS (SELECT model, city, count(*) AS n, {SCORES} FROM f GROUP BY 1, 2)
  SELECT model, city, n, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(mape, 4) AS mape, round(r2, 5) AS r2,
    round(nrmse, 5) AS nrmse, round(log_mae, 5) AS log_mae FROM c WHERE n >= 5""")
def forecast_city_scores(spark, sf):
    x = H.lag_features(_panel(spark, sf), *_P, "target", 3).where("lag1 is not null")
    x = x.withColumns({"persistence": M.persistence(), "moving_average": F.col("mean_hist"),
                       "two_point_trend": M.two_point_trend()})
    out = score_wide(x, ["city"], "target", ["persistence", "moving_average", "two_point_trend"]).where("n >= 5")
    return out.select("model", "city", "n", *[r(m, 4 if m in ("mae", "rmse", "mape") else 5).alias(m) for m in METRICS])


@query("forecast_macro", f"""WITH {_FORECAST_SQL}, {AR1_SQL}, {holt_sql('hl', (1.0,))}, f5 AS (SELECT * FROM f
    UNION ALL SELECT 'ar1', city, target, p FROM h JOIN ar1 USING (building_id, year)
    UNION ALL SELECT 'holt', city, target, p FROM h JOIN hl USING (building_id, year)),
  c AS (SELECT model, city, count(*) AS n, {SCORES} FROM f5 GROUP BY 1, 2)
  SELECT model, count(*) AS n_groups, {_METRIC_SQL} FROM c WHERE n >= 5 GROUP BY 1""")
def forecast_macro(spark, sf):
    """Flagship: panel, history features, five closed-form forecasts, city scores, macro average."""
    out = forecast_report(_panel(spark, sf), *_P, "target", "city")
    return out.select("model", "n_groups", *[r(f"macro_{m}", 4 if m in ("mae", "rmse", "mape") else 5).alias(f"macro_{m}") for m in METRICS])


@query("forecast_runs", f"""WITH {S.PANEL}, {S.LAGGED}, h AS (SELECT * FROM lagged WHERE lag1 IS NOT NULL), {AR1_SQL}, {holt_sql('hl', (1.0,))},
  f AS (SELECT 'persistence' AS model, city, year, target AS y, lag1 AS p FROM h UNION ALL SELECT 'moving_average', city, year, target, mean_hist FROM h
    UNION ALL SELECT 'two_point_trend', city, year, target, greatest(coalesce(2 * lag1 - lag2, lag1), 0) FROM h
    UNION ALL SELECT 'ar1', city, year, target, p FROM h JOIN ar1 USING (building_id, year)
    UNION ALL SELECT 'holt', city, year, target, p FROM h JOIN hl USING (building_id, year)),
  s AS (SELECT 'overall' AS scope, 'all' AS scope_value, model, y, p FROM f WHERE year >= 1999 UNION ALL SELECT 'city', city, model, y, p FROM f WHERE year >= 1999
    UNION ALL SELECT 'test_year', CAST(year AS VARCHAR), model, y, p FROM f WHERE year >= 1999),
  c AS (SELECT scope, scope_value, model, count(*) AS n, {SCORES} FROM s GROUP BY 1, 2, 3)
  SELECT scope, scope_value, model, n, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(mape, 4) AS mape, round(r2, 5) AS r2,
    round(nrmse, 5) AS nrmse, round(log_mae, 5) AS log_mae FROM c""")
def forecast_runs_query(spark, sf):
    """Forecasts of 1999 and later, scored overall, per city and per year; earlier years are their history."""
    out = forecast_runs(_panel(spark, sf), *_P, "target", "city", 1999)
    return out.select("scope", "scope_value", "model", "n", *[r(m, 4 if m in ("mae", "rmse", "mape") else 5).alias(m) for m in METRICS])


@query("forecast_macro_simple", f"""WITH {_FORECAST_SQL}, c AS (SELECT model, city, count(*) AS n, {SCORES} FROM f GROUP BY 1, 2)
  SELECT model, count(*) AS n_groups, {_METRIC_SQL} FROM c WHERE n >= 5 GROUP BY 1""")
def forecast_macro_simple(spark, sf):
    from emipanel.operators.metrics import macro
    x = H.lag_features(_panel(spark, sf), *_P, "target", 3).where("lag1 is not null")
    x = x.withColumns({"persistence": M.persistence(), "moving_average": F.col("mean_hist"),
                       "two_point_trend": M.two_point_trend()})
    out = macro(score_wide(x, ["city"], "target", ["persistence", "moving_average", "two_point_trend"]).where("n >= 5"), ["model"])
    return out.select("model", "n_groups", *[r(f"macro_{m}", 4 if m in ("mae", "rmse", "mape") else 5).alias(f"macro_{m}") for m in METRICS])


@query("window_lag_features", f"""WITH {S.PANEL}, {S.LAGGED} SELECT building_id, year, target, lag1, lag2, lag3, round(mean_hist, 4) AS mean_hist,
  round(std_hist, 4) AS std_hist, round(lag1 - lag2, 4) AS change_1y,
  lag(area_y, 1) OVER {S.WIN} AS area_y_lag1, lag(area_y, 2) OVER {S.WIN} AS area_y_lag2, lag(area_y, 3) OVER {S.WIN} AS area_y_lag3
  FROM (SELECT *, area + year AS area_y FROM lagged)""")
def window_lag_features(spark, sf):
    x = _panel(spark, sf).select("building_id", "year", "target", (F.col("area") + F.col("year")).alias("area_y"))
    out = H.lag_features(x, *_P, "target", 3, climate=["area_y"])
    return out.withColumns({c: r(c) for c in ("mean_hist", "std_hist", "change_1y")})


@query("window_history_stats", f"""WITH {S.PANEL}, {S.LAGGED} SELECT building_id, year, round(mean_hist, 4) AS mean_hist,
  round(std_hist, 4) AS std_hist, lag1, lag2, round(lag1 - lag2, 4) AS change_1y FROM lagged""")
def window_history_stats(spark, sf):
    x = H.lags(_panel(spark, sf), *_P, "target", 2, "lag")
    x = H.change_1y(H.hist_std(H.hist_mean(x, *_P, "target"), *_P, "target"), "lag1", "lag2")
    return x.select(*_P, r("mean_hist").alias("mean_hist"), r("std_hist").alias("std_hist"), "lag1", "lag2", r("change_1y").alias("change_1y"))


@query("window_climate_lags", f"""WITH {S.PANEL} SELECT building_id, year, lag(n_orders, 1) OVER {S.WIN} AS n_orders_lag1,
  lag(n_orders, 2) OVER {S.WIN} AS n_orders_lag2 FROM panel""")
def window_climate_lags(spark, sf):
    return H.climate_lags(_panel(spark, sf).select(*_P, "n_orders"), *_P, ["n_orders"], 2)


@query("window_leads", f"""WITH {S.PANEL} SELECT building_id, year, lead(target, 1) OVER {S.WIN} AS target_h1,
  lead(target, 2) OVER {S.WIN} AS target_h2, lead(target, 3) OVER {S.WIN} AS target_h3 FROM panel""")
def window_leads(spark, sf):
    return H.leads(_panel(spark, sf), *_P, "target").select(*_P, "target_h1", "target_h2", "target_h3")


@query("window_row_numbers", f"""WITH {S.PANEL} SELECT city, building_id, year, row_number() OVER (PARTITION BY city
  ORDER BY {sql_hash(7, 'building_id', 'year')}, building_id, year) AS row_no FROM panel""")
def window_row_numbers(spark, sf):
    return H.number_rows(_panel(spark, sf).select("city", *_P), ["city"], hash32(7, *_P), list(_P))


@query("window_row_numbers_hot", f"""WITH {S.PANEL} SELECT property_type, building_id, year, row_number() OVER (PARTITION BY property_type
  ORDER BY {sql_hash(7, 'building_id', 'year')}, building_id, year) AS row_no FROM panel""")
def window_row_numbers_hot(spark, sf):
    """Five groups hold all rows; small hash ranges, so that a group has many of them."""
    return H.number_rows(_panel(spark, sf).select("property_type", *_P), ["property_type"], hash32(7, *_P), list(_P), bucket_rows=100)


@query("window_dense_ids", f"""WITH {S.PANEL} SELECT city, building_id, year, row_number() OVER (ORDER BY city, building_id, year) - 1
  AS row_id FROM panel""")
def window_dense_ids(spark, sf):
    return H.shard_ids(_panel(spark, sf).select("city", *_P), ["city", *_P])


@query("window_group_size", f"""WITH {S.PANEL} SELECT building_id, year, count(*) OVER (PARTITION BY city, year) AS group_rows FROM panel""")
def window_group_size(spark, sf):
    return H.with_count(_panel(spark, sf), ["city", "year"]).select(*_P, "group_rows")


@query("window_quantile_zone", f"""WITH {S.PANEL}, q AS (SELECT quantile_cont(target, 0.25) AS a, median(target) AS b,
    quantile_cont(target, 0.75) AS c FROM panel)
  SELECT building_id, year, CAST(1 + (target >= a)::INT + (target >= b)::INT + (target >= c)::INT AS BIGINT) AS zone FROM panel, q""")
def window_quantile_zone(spark, sf):
    return H.quantile_zone(_panel(spark, sf), "target").select(*_P, F.col("zone").cast("long").alias("zone"))


@query("window_growth", f"""WITH {S.PANEL}, d AS (SELECT building_id, year, log10(target) - lag(log10(target)) OVER {S.WIN} AS delta FROM panel)
  SELECT building_id, count(delta) AS n, round(avg(delta), 6) AS mean_delta FROM d GROUP BY 1""")
def window_growth(spark, sf):
    x = H.growth(_panel(spark, sf).withColumn("y", F.log10("target")), *_P, "y")
    return x.groupBy("building_id").agg(F.count("delta").alias("n"), r(F.avg("delta"), 6).alias("mean_delta"))


@query("window_history_array", f"""WITH {S.PANEL}, {S.LAGGED} SELECT building_id, year,
  greatest(1, (lag1 IS NOT NULL)::INT + (lag2 IS NOT NULL)::INT + (lag3 IS NOT NULL)::INT)::BIGINT AS n_values,
  coalesce(lag3, lag2, lag1, 0) AS oldest, coalesce(lag1, 0) AS newest,
  CASE WHEN lag2 IS NOT NULL THEN round((lag1 - coalesce(lag3, lag2)) / CASE WHEN lag3 IS NULL THEN 1 ELSE 2 END, 4) END AS mean_growth
  FROM lagged""")
def window_history_array(spark, sf):
    x = H.lags(_panel(spark, sf), *_P, "target", 3, "lag").withColumn("h", H.history_array(["lag3", "lag2", "lag1"]))
    return x.select(*_P, F.size("h").cast("long").alias("n_values"), F.element_at("h", 1).alias("oldest"),
                    F.element_at("h", -1).alias("newest"), r(H.mean_growth("h")).alias("mean_growth"))


# ---------------------------------------------------------------- ordering

@query("sort_total", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_custkey, o_orderkey")
def sort_total(spark, sf):
    return I.order_by(t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"),
                      ["o_orderpriority", "o_custkey", "o_orderkey"])


@query("sort_limit", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 20")
def sort_limit(spark, sf):
    return I.limit(t(spark, sf, "orders").select("o_orderkey", "o_custkey"), 20, ["o_custkey", "o_orderkey"])


@query("sort_top_k", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15")
def sort_top_k(spark, sf):
    return I.top_k(t(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 15, ["c_custkey"])


@query("sort_top_k_absolute", "SELECT c_custkey, c_acctbal - 5000 AS d FROM customer ORDER BY abs(c_acctbal - 5000) DESC, c_custkey LIMIT 15")
def sort_top_k_absolute(spark, sf):
    x = t(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") - 5000).alias("d"))
    return I.top_k(x, "d", 15, ["c_custkey"], absolute=True)


@query("sort_by_reference_model", f"""WITH {S.RESULTS}, x AS (SELECT city || seed AS grp, model, value FROM results WHERE metric = 'mae')
  SELECT x.grp, model, round(value, 5) AS value, round(reference_score, 5) AS reference_score FROM x LEFT JOIN (SELECT grp, max(value) AS reference_score FROM x WHERE model = 'Brand#1' GROUP BY 1) s
  USING (grp)""")
def sort_by_reference_model(spark, sf):
    x = S.results(spark, sf).where("metric = 'mae'").select(F.concat("city", "seed").alias("grp"), "model", "value")
    return I.order_by_reference_model(x, "grp", "model", "Brand#1", "value").withColumns(
        {c: r(c, 5) for c in ("value", "reference_score")})


# ---------------------------------------------------------------- reshape

_YEARS = [1995, 1996, 1997, 1998, 1999, 2000, 2001]  # every year of the orders
_FIRST, _LAST = _YEARS[0], _YEARS[-1]
_WIDE = f"""{S.PANEL}, wide AS (SELECT building_id, city, property_type, {', '.join(f'max(target) FILTER (year = {y}) AS y{y}' for y in _YEARS)}
  FROM panel GROUP BY 1, 2, 3)"""
_ALL = " AND ".join(f"y{y} IS NOT NULL" for y in _YEARS)


def _wide(spark, sf):
    return J.balanced_panel(_panel(spark, sf), ["building_id", "city", "property_type"], "year", "target", _YEARS, ["target"])


@query("reshape_balanced_panel", f"WITH {_WIDE} SELECT * FROM wide WHERE {_ALL}")
def reshape_balanced_panel(spark, sf):
    return _wide(spark, sf).withColumnsRenamed({str(y): f"y{y}" for y in _YEARS})


@query("reshape_melt_years", f"""WITH {_WIDE} SELECT building_id, CAST(year AS BIGINT) AS year, value FROM (
  {' UNION ALL '.join(f'SELECT building_id, {y} AS year, y{y} AS value FROM wide WHERE {_ALL}' for y in _YEARS)})""")
def reshape_melt_years(spark, sf):
    return J.melt_years(_wide(spark, sf).select("building_id", *[str(y) for y in _YEARS]), ["building_id"], _YEARS)


@query("reshape_feature_columns", "SELECT p_brand, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS p_size FROM part GROUP BY 1")
def reshape_feature_columns(spark, sf):
    p = t(spark, sf, "part")
    cols = J.feature_common(J.feature_diff(p.columns, ["p_name", "p_retailprice", "p_partkey"]), ["p_brand", "p_size", "x"])
    return p.select(*cols).groupBy(cols[0]).agg(F.count(F.lit(1)).alias("n"), F.sum(cols[1]).alias(cols[1]))


@query("reshape_aligned_dummies", """SELECT p_partkey, 'a' AS side, CAST(p_type = 'ECONOMY' AS DOUBLE) AS type_ECONOMY, 0.0::DOUBLE AS type_PROMO,
  CAST(p_type = 'SMALL' AS DOUBLE) AS type_SMALL FROM part WHERE p_size < 25 UNION ALL SELECT p_partkey, 'b', 0.0::DOUBLE,
  CAST(p_type = 'PROMO' AS DOUBLE), CAST(p_type = 'SMALL' AS DOUBLE) FROM part WHERE p_size >= 25""")
def reshape_aligned_dummies(spark, sf):
    from emipanel.operators.features import one_hot
    p = t(spark, sf, "part").select("p_partkey", F.col("p_type").alias("type"), "p_size")
    a = one_hot(p.where("p_size < 25"), {"type": ["ECONOMY", "SMALL"]}).drop("type", "p_size").withColumn("side", F.lit("a"))
    b = one_hot(p.where("p_size >= 25"), {"type": ["PROMO", "SMALL"]}).drop("type", "p_size").withColumn("side", F.lit("b"))
    a, b = J.align_columns(a, b, keep=["p_partkey", "side"])
    return a.unionByName(b)


@query("reshape_results_to_long", f"""WITH {S.RESULTS} SELECT feature_set, model, seed, metric, city, round(value, 5) AS value FROM results""")
def reshape_results_to_long(spark, sf):
    x = S.results(spark, sf)
    wide = x.groupBy("feature_set", "model", "seed").agg(*[F.max(F.when((F.col("metric") == m) & (F.col("city") == c), F.col("value")))
                                            .alias(f"{m}_{c}") for m in ("r2", "mae") for c in ("A", "N", "R")])
    return J.results_to_long(wide, ["feature_set", "model", "seed"]).withColumn("value", r("value", 5))


# ---------------------------------------------------------------- closed-form forecasts

def _split(spark, sf):
    p = _panel(spark, sf)
    return p.where("year <= 1998"), p.where("year >= 1999")


_TT = f"{S.PANEL}, tr AS (SELECT * FROM panel WHERE year <= 1998), te AS (SELECT * FROM panel WHERE year >= 1999)"


@query("model_global_mean", f"""WITH {_TT} SELECT building_id, year, round(exp((SELECT avg(ln(1 + target)) FROM tr)) - 1, 3) AS pred FROM te""")
def model_global_mean(spark, sf):
    tr, te = _split(spark, sf)
    return M.global_mean(tr, te, "target").select(*_P, r("pred", 3).alias("pred"))


@query("model_group_mean", f"""WITH {_TT}, g AS (SELECT city, property_type, avg(ln(1 + target)) AS m FROM tr WHERE city <> 'NATION_3' GROUP BY 1, 2)
  SELECT building_id, year, round(exp(coalesce(m, (SELECT avg(ln(1 + target)) FROM tr WHERE city <> 'NATION_3'))) - 1, 3) AS pred
  FROM te LEFT JOIN g USING (city, property_type)""")
def model_group_mean(spark, sf):
    tr, te = _split(spark, sf)
    return M.group_mean(tr.where("city <> 'NATION_3'"), te, ["city", "property_type"], "target").select(*_P, r("pred", 3).alias("pred"))


@query("model_sector_mean", f"""WITH {_TT}, g AS (SELECT property_type, avg(target) AS m FROM tr WHERE target > 0 AND property_type <> 'MACHINERY' GROUP BY 1)
  SELECT building_id, year, round(coalesce(m, (SELECT avg(target) FROM tr WHERE target > 0 AND property_type <> 'MACHINERY')), 3) AS pred
  FROM te LEFT JOIN g USING (property_type)""")
def model_sector_mean(spark, sf):
    tr, te = _split(spark, sf)
    return M.sector_stat(tr.where("property_type <> 'MACHINERY'"), te, "property_type", "target").select(*_P, r("pred", 3).alias("pred"))


@query("model_sector_median", f"""WITH {_TT}, g AS (SELECT property_type, median(target) AS m FROM tr WHERE property_type <> 'MACHINERY' GROUP BY 1)
  SELECT building_id, year, round(coalesce(m, (SELECT median(target) FROM tr WHERE property_type <> 'MACHINERY')), 3) AS pred
  FROM te LEFT JOIN g USING (property_type)""")
def model_sector_median(spark, sf):
    tr, te = _split(spark, sf)
    return M.sector_stat(tr.where("property_type <> 'MACHINERY'"), te, "property_type", "target", "median").select(
        *_P, r("pred", 3).alias("pred"))


@query("model_sector_log_mean", f"""WITH {_TT}, g AS (SELECT property_type, avg(log10(target)) AS m FROM tr GROUP BY 1)
  SELECT building_id, year, round(m, 6) AS pred_log FROM te LEFT JOIN g USING (property_type)""")
def model_sector_log_mean(spark, sf):
    tr, te = _split(spark, sf)
    return M.sector_log_mean(tr.withColumn("yl", F.log10("target")), te, "property_type", "yl").select(*_P, r("pred_log", 6).alias("pred_log"))


_L1P = "ln(1 + greatest({}, 0))"


@query("model_history_rules", f"""WITH {S.PANEL}, {S.LAGGED} SELECT building_id, year, lag1 AS persistence, round(mean_hist, 4) AS moving_average,
  round(exp((coalesce({_L1P.format('lag1')}, 0) + coalesce({_L1P.format('lag2')}, 0) + coalesce({_L1P.format('lag3')}, 0)) /
    nullif((lag1 IS NOT NULL)::INT + (lag2 IS NOT NULL)::INT + (lag3 IS NOT NULL)::INT, 0)) - 1, 3) AS log_moving_average,
  round(greatest(coalesce(2 * lag1 - lag2, lag1), 0), 4) AS two_point_trend FROM lagged WHERE lag1 IS NOT NULL""")
def model_history_rules(spark, sf):
    x = H.lags(_panel(spark, sf), *_P, "target", 3, "lag").where("lag1 is not null")
    lags = ["lag3", "lag2", "lag1"]
    return x.select(*_P, M.persistence().alias("persistence"), r(M.moving_average(lags)).alias("moving_average"),
                    r(M.moving_average(lags, log_space=True), 3).alias("log_moving_average"), r(M.two_point_trend()).alias("two_point_trend"))


@query("model_ols_trend", f"""WITH {S.PANEL} SELECT building_id, round(coalesce(regr_intercept(target, year - 2000), avg(target)), 2) AS pred FROM panel WHERE year < 2000 GROUP BY 1""")
def model_ols_trend(spark, sf):
    return M.ols_trend(_panel(spark, sf), *_P, "target", 2000).select("building_id", r("pred", 2).alias("pred"))


_LOGW = f"""{_WIDE}, lw AS (SELECT building_id, property_type, {', '.join(f'log10(y{y}) AS l{y}' for y in _YEARS)} FROM wide WHERE {_ALL}),
  gr AS (SELECT *, (l{_LAST} - l{_FIRST}) / {_LAST - _FIRST} AS g FROM lw), md AS (SELECT property_type, median(g) AS m FROM gr GROUP BY 1)"""


def _logwide(spark, sf):
    return _wide(spark, sf).withColumns({str(y): F.log10(f"`{y}`") for y in _YEARS})


@query("model_sector_growth", f"""WITH {_LOGW} SELECT building_id, round(l{_LAST} + 2 * m, 6) AS pred FROM gr JOIN md USING (property_type)""")
def model_sector_growth(spark, sf):
    return M.sector_growth(_logwide(spark, sf), "property_type", _YEARS, 2).select("building_id", r("pred", 6).alias("pred"))


@query("model_growth_baselines", f"""WITH {_LOGW} SELECT building_id, 0.0::DOUBLE AS zero_change, round(g, 6) AS avg_past_growth,
  round(l{_LAST} - l{_LAST - 1}, 6) AS last_growth, round(m, 6) AS sector_median_growth FROM gr JOIN md USING (property_type)""")
def model_growth_baselines(spark, sf):
    out = M.growth_baselines(_logwide(spark, sf), "property_type", _YEARS)
    return out.select("building_id", *[r(c, 6).alias(c) for c in ("zero_change", "avg_past_growth", "last_growth", "sector_median_growth")])


@query("model_ar1", f"WITH {S.PANEL}, {S.LAGGED}, {AR1_SQL} SELECT building_id, year, round(ln(1 + p), 6) AS pred_log FROM ar1")
def model_ar1(spark, sf):
    x = H.lags(_panel(spark, sf), *_P, "target", 3, "lag").where("lag1 is not null")
    return x.select(*_P, r(F.log1p(M.ar1(["lag3", "lag2", "lag1"])), 6).alias("pred_log"))


@query("model_holt", f"""WITH {S.PANEL}, {S.LAGGED}, {holt_sql('hl', (1.0,))}, {holt_sql('hd', M.HOLT_PHI)}
  SELECT building_id, year, round(ln(1 + hl.p), 6) AS linear, round(ln(1 + hd.p), 6) AS damped FROM hl JOIN hd USING (building_id, year)""")
def model_holt(spark, sf):
    x = H.lags(_panel(spark, sf), *_P, "target", 3, "lag").where("lag1 is not null")
    x = x.withColumn("h", H.history_array(["lag3", "lag2", "lag1"]))
    return x.select(*_P, r(F.log1p(M.holt("h")), 6).alias("linear"), r(F.log1p(M.holt("h", damped=True)), 6).alias("damped"))


@query("model_ar_differences", f"""WITH {_LOGW}, d AS (SELECT building_id, l{_LAST} AS last, l{_LAST} - l{_LAST - 1} AS step,
    {' + '.join(f'(l{y} - l{y - 1}) * (l{y + 1} - l{y})' for y in _YEARS[1:-1])} AS cross_sum,
    {' + '.join(f'(l{y} - l{y - 1}) * (l{y} - l{y - 1})' for y in _YEARS[1:-1])} AS square_sum FROM lw)
  SELECT building_id, round(coalesce(last + cross_sum / nullif(square_sum, 0) * step, last), 6) AS pred,
    nullif(square_sum, 0) IS NULL AS fell_back FROM d""")
def model_ar_differences(spark, sf):
    pred, failed = M.ar_diff([f"`{y}`" for y in _YEARS])
    return _logwide(spark, sf).select("building_id", r(pred, 6).alias("pred"), failed.alias("fell_back"))


_BL = {"first_only": 0.0, "second_only": 1.0, "avg": 0.5, **{f"alpha={x:g}": x for x in M.BLEND_ALPHAS}}


@query("model_blend_grid", f"""WITH {S.PAIRS}, g(strategy, a) AS (VALUES {', '.join(f"('{k}', {v}::DOUBLE)" for k, v in _BL.items())}),
  b AS (SELECT strategy, y, (1 - a) * p + a * q AS p FROM pairs, g), s AS (SELECT strategy, count(*) AS n, {SCORES} FROM b GROUP BY 1)
  SELECT strategy, n, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(r2, 6) AS r2 FROM s""")
def model_blend_grid(spark, sf):
    out = M.blend_scores(S.pairs(spark, sf), "y", "p", "q")
    return out.select("strategy", "n", r("mae").alias("mae"), r("rmse").alias("rmse"), r("r2", 6).alias("r2"))


@query("model_ridge_stack", f"""WITH {S.PAIRS}, u AS (SELECT y / 1000 AS y, p / 1000 AS a, l_quantity AS b, l_orderkey % 2 AS h FROM pairs),
  s AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) * count(*) + 0.1 AS saa, var_pop(b) * count(*) + 0.1 AS sbb,
    covar_pop(a, b) * count(*) AS sab, covar_pop(a, y) * count(*) AS say, covar_pop(b, y) * count(*) AS sby FROM u WHERE h = 0),
  c AS (SELECT (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS ca, (sby * saa - say * sab) / (saa * sbb - sab * sab) AS cb, ma, mb, my FROM s),
  t AS (SELECT y, ca * a + cb * b + my - ca * ma - cb * mb AS p FROM u, c WHERE h = 1), m AS (SELECT count(*) AS n, {SCORES} FROM t)
  SELECT n, round(mae, 5) AS mae, round(rmse, 5) AS rmse, round(r2, 6) AS r2, round(ca, 5) AS coef_a, round(cb, 5) AS coef_b,
    round(my - ca * ma - cb * mb, 4) AS intercept FROM m, c""")
def model_ridge_stack(spark, sf):
    x = S.pairs(spark, sf).select((F.col("y") / 1000).alias("y"), (F.col("p") / 1000).alias("a"), F.col("l_quantity").alias("b"),
                                  F.when(F.col("l_orderkey") % 2 == 0, "train").otherwise("test").alias("split"))
    out = M.ridge_stack(x, "y", "a", "b")
    return out.select("n", r("mae", 5).alias("mae"), r("rmse", 5).alias("rmse"), r("r2", 6).alias("r2"), r("coef_a", 5).alias("coef_a"),
                      r("coef_b", 5).alias("coef_b"), r("intercept").alias("intercept"))


@query("model_forecast_frame_rows", f"""WITH {S.PANEL}, {S.LAGGED} SELECT city, count(*) AS n, round(avg(lag1), 2) AS persistence
  FROM lagged WHERE lag1 IS NOT NULL GROUP BY 1""")
def model_forecast_frame_rows(spark, sf):
    x = forecast_frame(_panel(spark, sf), *_P, "target")
    return x.groupBy("city").agg(F.count(FORECASTERS[-1]).alias("n"), r(F.avg("persistence"), 2).alias("persistence"))
