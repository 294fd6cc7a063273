"""Metrics, bootstrap and results tables."""

from pyspark.sql import functions as F

from emipanel.operators import metrics as N
from workload import stage as S
from workload.history import SCORES
from workload.registry import query
from workload.stage import r, t

_ROUND = {"mae": 4, "rmse": 4, "mape": 4, "r2": 6, "nrmse": 6, "log_mae": 6}
_OUT = ", ".join(f"round({m}, {n}) AS {m}" for m, n in _ROUND.items())


def _rounded(df, *keys):
    return df.select(*keys, *[r(m, n).alias(m) for m, n in _ROUND.items()])


@query("eval_all_metrics", f"""WITH {S.PAIRS}, s AS (SELECT p_brand, count(*) AS n, {SCORES} FROM pairs GROUP BY 1)
  SELECT p_brand, n, {_OUT} FROM s""")
def eval_all_metrics(spark, sf):
    return _rounded(N.all_metrics(S.pairs(spark, sf), ["p_brand"], "y", "p"), "p_brand", "n")


_SM = "2 * abs(y - p) / (abs(y) + abs(p))"


@query("eval_single_metrics", f"""WITH {S.PAIRS}, x AS (SELECT l_returnflag, y, CASE WHEN l_linenumber = 7 THEN NULL ELSE p END AS p FROM pairs)
  SELECT l_returnflag, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse,
    round(100 * avg(CASE WHEN abs(y) > 20000 THEN abs(y - p) / abs(y) END), 5) AS mape_big,
    round(100 * avg({_SM}), 5) AS smape, round(sqrt(avg((y - p) * (y - p))) / (max(y) - min(y)), 7) AS nrmse_range,
    round(sqrt(avg((y - p) * (y - p))) / stddev_pop(y), 7) AS nrmse_std, round(avg(abs(ln(greatest(y, 0) + 10) - ln(greatest(p, 0) + 10))), 6) AS log_mae_10
  FROM x WHERE p IS NOT NULL GROUP BY 1""")
def eval_single_metrics(spark, sf):
    x = S.pairs(spark, sf).withColumn("p", F.when(F.col("l_linenumber") != 7, F.col("p"))).where("p is not null")
    return x.groupBy("l_returnflag").agg(
        r(N.mae("y", "p")).alias("mae"), r(N.rmse("y", "p")).alias("rmse"), r(N.mape("y", "p", 20000.0), 5).alias("mape_big"),
        r(N.smape("y", "p"), 5).alias("smape"), r(N.nrmse("y", "p", "range"), 7).alias("nrmse_range"),
        r(N.nrmse("y", "p", "std"), 7).alias("nrmse_std"), r(N.log_mae("y", "p", 10.0), 6).alias("log_mae_10"))


@query("eval_constant_target", """SELECT p_type, CASE WHEN p_type = 'PROMO' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r2,
  CASE WHEN p_type = 'PROMO' THEN NULL ELSE NULL END::DOUBLE AS nrmse_std FROM part GROUP BY 1""")
def eval_constant_target(spark, sf):
    x = t(spark, sf, "part").select("p_type", F.lit(7.0).alias("y"), F.when(F.col("p_type") == "PROMO", 7.0).otherwise(F.col("p_retailprice")).alias("p"))
    return x.groupBy("p_type").agg(N.r2("y", "p").alias("r2"), N.nrmse("y", "p", "std").alias("nrmse_std"))


@query("eval_log_suite", f"""WITH {S.PAIRS}, x AS (SELECT p_type, log10(y) AS a, log10(p) AS b, abs(y - p) / abs(y) AS ape FROM pairs)
  SELECT p_type, count(*) AS n, round(avg(abs(a - b)), 6) AS mae_log, round(sqrt(avg((a - b) * (a - b))), 6) AS rmse_log,
    round(1 - sum((a - b) * (a - b)) / (var_pop(a) * count(*)), 6) AS r2_log, round(corr(a, b), 6) AS pearson_r,
    round(avg(ape), 6) AS mape, round(median(ape), 6) AS median_ape FROM x GROUP BY 1""")
def eval_log_suite(spark, sf):
    x = S.pairs(spark, sf).withColumns({"a": F.log10("y"), "b": F.log10("p")})
    out = N.log_suite(x, ["p_type"], "a", "b")
    return out.select("p_type", "n", *[r(c, 6).alias(c) for c in out.columns[2:]])


@query("eval_safe_correlation", f"""WITH {S.PAIRS} SELECT p_type, round(corr(y, p), 6) AS linked, 0.0::DOUBLE AS flat FROM pairs GROUP BY 1""")
def eval_safe_correlation(spark, sf):
    x = S.pairs(spark, sf).withColumn("c", F.lit(3.0))
    return x.groupBy("p_type").agg(r(N.safe_corr("y", "p"), 6).alias("linked"), N.safe_corr("y", "c").alias("flat"))


@query("eval_metrics_by", f"""WITH {S.PAIRS}, s AS (SELECT p_type, year, l_returnflag, count(*) AS n, {SCORES} FROM pairs GROUP BY 1, 2, 3)
  SELECT p_type, year, l_returnflag, n, {_OUT} FROM s WHERE n >= 300""")
def eval_metrics_by(spark, sf):
    keys = ["p_type", "year", "l_returnflag"]
    return _rounded(N.metrics_by(S.pairs(spark, sf), keys, "y", "p", 300), *keys, "n")


@query("eval_macro", f"""WITH {S.PAIRS}, s AS (SELECT year, p_brand, count(*) AS n, {SCORES} FROM pairs GROUP BY 1, 2)
  SELECT year, count(*) AS n_groups, {', '.join(f'round(avg({m}), {n}) AS macro_{m}' for m, n in _ROUND.items())} FROM s GROUP BY 1""")
def eval_macro(spark, sf):
    out = N.macro(N.all_metrics(S.pairs(spark, sf), ["year", "p_brand"], "y", "p"), ["year"])
    return out.select("year", "n_groups", *[r(f"macro_{m}", n).alias(f"macro_{m}") for m, n in _ROUND.items()])


@query("eval_stratified", f"""WITH {S.PAIRS}, q AS (SELECT quantile_cont(p, 0.25) AS a, median(p) AS b, quantile_cont(p, 0.75) AS c FROM pairs),
  z AS (SELECT y, p, p_brand, CASE WHEN p_type = 'PROMO' THEN 'unknown' ELSE p_type END AS kind,
    'q' || (1 + (p >= a)::INT + (p >= b)::INT + (p >= c)::INT) AS zone FROM pairs, q),
  u AS (SELECT 'city' AS stratum, p_brand AS label, y, p FROM z UNION ALL SELECT 'property_type', kind, y, p FROM z UNION ALL
    SELECT 'zone', zone || printf(' [%.0f-%.0f]', min(p) OVER (PARTITION BY zone), max(p) OVER (PARTITION BY zone)), y, p FROM z),
  s AS (SELECT stratum, label, count(*) AS n, {SCORES} FROM u GROUP BY 1, 2)
  SELECT stratum, label, n, {_OUT} FROM s WHERE n >= 50""")
def eval_stratified(spark, sf):
    x = S.pairs(spark, sf).withColumn("kind", F.when(F.col("p_type") != "PROMO", F.col("p_type")))
    return _rounded(N.stratified_metrics(x, "y", "p", "p_brand", "kind", "p"), "stratum", "label", "n")


# ---- bootstrap: the SQL twin draws the same Poisson weights from the same hashes

_B = 1000


def _boot_sql(models: dict, n_boot: int = _B) -> str:
    table = ", ".join(f"({b}, {a}::BIGINT, {c}::BIGINT)" for b, (a, c) in enumerate(N.replicate_table(n_boot)))
    weight = " + ".join(f"(u >= {c!r}::DOUBLE)::INT" for c in N.POISSON_CDF)
    union = " UNION ALL ".join(f"SELECT '{m}' AS model, l_orderkey, l_linenumber, y, {col} AS p FROM pairs" for m, col in models.items())
    return f"""{S.PAIRS}, long AS ({union}), rep(b, ra, rc) AS (VALUES {table}),
  h AS (SELECT model, y, p, CAST('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber)), 1, 7) AS BIGINT) AS h FROM long),
  d AS (SELECT model, b, y, p, ((h * ra + rc) % {N.MODULUS}) / {N.MODULUS}::DOUBLE AS u FROM h, rep),
  w AS (SELECT model, b, y - (SELECT avg(y) FROM pairs) AS yc, y, p, {weight} AS w FROM d),
  sc AS (SELECT model, b, 1 - sum(w * (y - p) * (y - p)) / (sum(w * yc * yc) - sum(w * yc) * sum(w * yc) / sum(w)) AS r2,
    sum(w * abs(y - p)) / sum(w) AS mae, sum(w * abs(ln(greatest(y, 0) + 1) - ln(greatest(p, 0) + 1))) / sum(w) AS log_mae FROM w GROUP BY 1, 2)"""


@query("eval_bootstrap", f"""WITH {_boot_sql({'m': 'p'})}, l AS (SELECT 'r2' AS metric, r2 AS v FROM sc UNION ALL SELECT 'mae', mae FROM sc
    UNION ALL SELECT 'log_mae', log_mae FROM sc)
  SELECT metric, round(avg(v), 5) AS mean, round(quantile_cont(v, 0.025), 5) AS lo, round(quantile_cont(v, 0.975), 5) AS hi FROM l GROUP BY 1""")
def eval_bootstrap(spark, sf):
    out = N.bootstrap_ci(S.pairs(spark, sf), ["l_orderkey", "l_linenumber"], "y", "p", _B)
    return out.select("metric", *[r(c, 5).alias(c) for c in ("mean", "lo", "hi")])


_MODELS = {"factor": "p", "flat": "q", "scaled": "p * 1.5"}


def _pair_sql(models: dict, n_boot: int) -> str:
    return f"""WITH {_boot_sql(models, n_boot)}, m AS (SELECT a.model AS model_a, c.model AS model_b, a.b, a.r2 - c.r2 AS d_r2,
    a.mae - c.mae AS d_mae, a.log_mae - c.log_mae AS d_log FROM sc a JOIN sc c ON a.b = c.b AND a.model < c.model),
  l AS (SELECT model_a, model_b, 'r2' AS metric, d_r2 AS d FROM m UNION ALL SELECT model_a, model_b, 'mae', d_mae FROM m
    UNION ALL SELECT model_a, model_b, 'log_mae', d_log FROM m),
  p AS (SELECT model_a, model_b, metric, round(avg(d), 5) AS delta_mean, round(quantile_cont(d, 0.025), 5) AS delta_lo,
    round(quantile_cont(d, 0.975), 5) AS delta_hi, round(2 * least(avg((d <= 0)::INT), avg((d >= 0)::INT)), 6) AS p_two_sided,
    round(CASE WHEN metric = 'r2' THEN avg((d > 0)::INT) ELSE avg((d < 0)::INT) END, 6) AS a_wins_frac,
    (SELECT count(*) FROM pairs) AS n_test FROM l GROUP BY 1, 2, 3)"""


@query("eval_paired_bootstrap", _pair_sql(_MODELS, _B) + " SELECT * FROM p")
def eval_paired_bootstrap(spark, sf):
    x = S.pairs(spark, sf).withColumn("scaled", F.col("p") * 1.5)
    out = N.all_pairs(x, ["l_orderkey", "l_linenumber"], "y", {"factor": "p", "flat": "q", "scaled": "scaled"}, _B)
    return out.select("model_a", "model_b", "metric", *[r(c, 5).alias(c) for c in ("delta_mean", "delta_lo", "delta_hi")],
                      r("p_two_sided", 6).alias("p_two_sided"), r("a_wins_frac", 6).alias("a_wins_frac"), "n_test")


@query("eval_bootstrap_200", _pair_sql({"a": "p", "b": "q"}, 200) + """ SELECT metric, delta_mean, delta_lo, delta_hi, p_two_sided,
  a_wins_frac, n_test FROM p""")
def eval_bootstrap_200(spark, sf):
    """The usual number of replicates."""
    out = N.paired_bootstrap(S.pairs(spark, sf), ["l_orderkey", "l_linenumber"], "y", "p", "q", 200)
    return out.select("metric", *[r(c, 5).alias(c) for c in ("delta_mean", "delta_lo", "delta_hi")],
                      r("p_two_sided", 6).alias("p_two_sided"), r("a_wins_frac", 6).alias("a_wins_frac"), "n_test")


@query("eval_sector_accuracy", """WITH x AS (SELECT CASE WHEN p_size < 20 THEN p_type END AS tr, p_type AS s, CASE WHEN p_partkey % 3 = 0 THEN 'SMALL' ELSE p_type END AS pr
    FROM part)
  SELECT count(*) AS n, round(avg((s = pr)::INT), 6) AS accuracy FROM x WHERE s IN (SELECT tr FROM x WHERE tr <> 'PROMO')""")
def eval_sector_accuracy(spark, sf):
    p = t(spark, sf, "part").withColumn("pred", F.when(F.col("p_partkey") % 3 == 0, "SMALL").otherwise(F.col("p_type")))
    return N.sector_accuracy(p, p.where("p_size < 20 and p_type <> 'PROMO'"), "p_type", "pred").withColumn("accuracy", r("accuracy", 6))


@query("eval_transfer_gap", f"""WITH {S.RESULTS}, x AS (SELECT model, seed, city, value FROM results WHERE metric = 'r2')
  SELECT model, seed, x.city, round(x.value, 5) AS value, round(x.value - b.value, 5) AS gap FROM x LEFT JOIN
  (SELECT model, seed, value FROM x WHERE city = 'A') b USING (model, seed)""")
def eval_transfer_gap(spark, sf):
    x = S.results(spark, sf).where("metric = 'r2'").select("model", "seed", "city", "value")
    return N.gap(x, ["model", "seed"], "city", "A", "value").withColumns({"value": r("value", 5), "gap": r("gap", 5)})


@query("eval_summary_filter", f"""WITH {S.RESULTS} SELECT model, seed, city, metric, round(value, 5) AS value FROM results
  WHERE feature_set = 'us_core' AND metric IN ('r2') AND city IN ('A', 'R')""")
def eval_summary_filter(spark, sf):
    out = N.summary(S.results(spark, sf), feature_set="us_core", metric=["r2"], city=["A", "R"])
    return out.select("model", "seed", "city", "metric", r("value", 5).alias("value"))


@query("eval_evaluator_table", f"""WITH {S.RESULTS}, x AS (SELECT model, seed, metric, value, CASE city WHEN 'A' THEN 'val' WHEN 'N' THEN 'test' ELSE 'train' END AS split FROM results)
  SELECT model, seed, {', '.join(f"round(max(value) FILTER (split = '{s}' AND metric = '{m}'), 5) AS {s}_{m}" for s in ('train', 'val', 'test') for m in ('mae', 'r2'))}
  FROM x GROUP BY 1, 2""")
def eval_evaluator_table(spark, sf):
    x = S.results(spark, sf).withColumn("split_type", F.when(F.col("city") == "A", "val").when(F.col("city") == "N", "test").otherwise("train"))
    out = N.evaluator_table(x, ["model", "seed"], splits=("train", "val", "test"), names=("mae", "r2"))
    return out.select("model", "seed", *[r(c, 5).alias(c) for c in out.columns[2:]])


_BEST = """b AS (SELECT seed, city, metric, model AS best_model, value AS best_value FROM results QUALIFY row_number() OVER (PARTITION BY seed, city, metric
    ORDER BY CASE WHEN metric = 'r2' THEN -value ELSE value END, model) = 1)"""


@query("eval_best_model", f"WITH {S.RESULTS}, {_BEST} SELECT seed, city, metric, best_model, round(best_value, 5) AS best_value FROM b")
def eval_best_model(spark, sf):
    return N.best_model(S.results(spark, sf), keys=["seed", "city"]).withColumn("best_value", r("best_value", 5))


@query("eval_flag_best", f"""WITH {S.RESULTS}, {_BEST} SELECT seed, city, metric, model, value = best_value AS is_best FROM results JOIN b USING (seed, city, metric)""")
def eval_flag_best(spark, sf):
    return N.flag_best(S.results(spark, sf), keys=["seed", "city"]).select("seed", "city", "metric", "model", "is_best")


_HZ = "h AS (SELECT p_brand AS model, CAST(year - 1994 AS BIGINT) AS horizon, y, p FROM pairs)"


@query("eval_horizon_table", f"""WITH {S.PAIRS}, {_HZ}, s AS (SELECT model, horizon, {SCORES} FROM h GROUP BY 1, 2)
  SELECT model, count(DISTINCT horizon) AS n_horizons, {', '.join(f'round(avg({m}), {n}) AS avg_{m}' for m, n in _ROUND.items())} FROM s GROUP BY 1""")
def eval_horizon_table(spark, sf):
    x = S.pairs(spark, sf).select(F.col("p_brand").alias("model"), (F.col("year") - 1994).alias("horizon"), "y", "p")
    out = N.horizon_table(N.all_metrics(x, ["model", "horizon"], "y", "p"))
    return out.select("model", "n_horizons", *[r(f"avg_{m}", n).alias(f"avg_{m}") for m, n in _ROUND.items()])


@query("eval_domain_pivot", f"""WITH {S.RESULTS} SELECT model, {', '.join(f"round(avg(value) FILTER (city = '{d}' AND metric = '{m}'), 5) AS {d}_{m}"
  for d in ('A', 'N', 'R') for m in ('r2', 'mae'))} FROM results GROUP BY 1""")
def eval_domain_pivot(spark, sf):
    out = N.domain_pivot(S.results(spark, sf), ["A", "N", "R"], ["r2", "mae"], domain="city")
    return out.select("model", *[r(c, 5).alias(c) for c in out.columns[1:]])


@query("eval_headline", f"""WITH {S.RESULTS} SELECT feature_set, model, seed, city, round(value, 5) AS value FROM results WHERE metric = 'mae'
  AND feature_set IN ('core_all_cities', 'core_all_cities_climate_plus')""")
def eval_headline(spark, sf):
    out = N.headline(S.results(spark, sf).where("metric = 'mae'"), cols=["feature_set", "model", "seed", "city", "value", "absent"])
    return out.withColumn("value", r("value", 5))


@query("eval_tier_ladder", f"""WITH {S.RESULTS} SELECT feature_set, model, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS std, count(value) AS n,
  CASE feature_set WHEN 'us_core' THEN 1 ELSE 2 END::BIGINT AS tier_rank FROM results WHERE metric = 'r2' AND feature_set IN ('us_core', 'core_all_cities') GROUP BY 1, 2""")
def eval_tier_ladder(spark, sf):
    out = N.tier_ladder(S.results(spark, sf).where("metric = 'r2'"), ["us_core", "core_all_cities"])
    return out.withColumns({"mean": r("mean", 5), "std": r("std", 5), "tier_rank": F.col("tier_rank").cast("long")})


@query("eval_loco_table", f"""WITH {S.RESULTS} SELECT city, model, seed, round(value, 5) AS value, city IN ('R') AS is_outlier FROM results WHERE metric = 'r2'""")
def eval_loco_table(spark, sf):
    x = S.results(spark, sf).where("metric = 'r2'")
    flag = N.loco_table(x.select("city", F.struct("model", "seed", "value").alias("v")), "city", "v", ["R"])
    return flag.select("city", "v.model", "v.seed", r(F.col("v.value"), 5).alias("value"), "is_outlier")
