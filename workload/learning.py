"""Feature preparation and learners."""

from pyspark.sql import functions as F

from emipanel.operators import features as L
from emipanel.operators import learners as M
from emipanel.operators import splits as K
from emipanel.operators.metrics import METRICS, all_metrics
from emipanel.operators.windows import lag_features, leads
from emipanel.plans.experiments import run_grid
from workload import stage as S
from workload.history import SCORES
from workload.registry import query
from workload.stage import r, sql_hash, t

_P = ("building_id", "year")
_SPLIT = "CASE WHEN year <= 1998 THEN 'train' WHEN year = 1999 THEN 'val' ELSE 'test' END"


def _frame(spark, sf):
    """Panel with lags and a split; early rows miss their lags."""
    x = lag_features(S.panel(spark, sf), *_P, "target", 3)
    return K.temporal_split(x, "year", 1998, 1999, 2000)


_FRAME = f"{S.PANEL}, {S.LAGGED}, fr AS (SELECT *, {_SPLIT} AS split FROM lagged)"
_COLS = ["lag1", "lag2", "area"]


@query("prep_median_impute", f"""WITH {_FRAME}, m AS (SELECT median(lag1) AS a, median(lag2) AS b, median(area) AS c FROM fr WHERE split = 'train')
  SELECT building_id, year, round(coalesce(lag1, a), 3) AS lag1, round(coalesce(lag2, b), 3) AS lag2, round(area, 3) AS area FROM fr, m""")
def prep_median_impute(spark, sf):
    x = _frame(spark, sf)
    out = L.apply_medians(x, L.fit_medians(x.where("split = 'train'"), _COLS), _COLS)
    return out.select(*_P, *[r(c, 3).alias(c) for c in _COLS])


def _company_sql(by_split: bool) -> str:
    src = "SELECT split, median(lag1) AS a, median(lag2) AS b FROM fr GROUP BY 1" if by_split else \
        "SELECT s.split, m.a, m.b FROM (SELECT DISTINCT split FROM fr) s, (SELECT median(lag1) AS a, median(lag2) AS b FROM fr WHERE split = 'train') m"
    return f"""WITH {_FRAME}, m AS ({src}) SELECT building_id, year, round(ln(1 + greatest(coalesce(lag1, a), 0)), 6) AS lag1,
      round(ln(1 + greatest(coalesce(lag2, b), 0)), 6) AS lag2, CAST(year AS DOUBLE) AS reporting_year FROM fr JOIN m USING (split)"""


def _company(spark, sf, scope):
    x = _frame(spark, sf).withColumn("reporting_year", F.col("year"))
    out = L.company_numeric_features(x, ["lag1", "lag2", "reporting_year"], scope=scope)
    return out.select(*_P, r("lag1", 6).alias("lag1"), r("lag2", 6).alias("lag2"), "reporting_year")


@query("prep_numeric_by_train", _company_sql(False))
def prep_numeric_by_train(spark, sf):
    return _company(spark, sf, "train")


@query("prep_numeric_by_partition", _company_sql(True))
def prep_numeric_by_partition(spark, sf):
    return _company(spark, sf, "partition")


@query("prep_one_hot", """SELECT p_partkey, """ + ", ".join(f"CAST(p_type = '{v}' AS DOUBLE) AS p_type_{v}" for v in
                                                             ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")) + " FROM part")
def prep_one_hot(spark, sf):
    p = t(spark, sf, "part")
    return L.one_hot(p.select("p_partkey", "p_type"), {"p_type": L.categories(p, "p_type")}).drop("p_type")


@query("prep_label_index", """WITH k AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS i, count(*) OVER () AS n FROM
    (SELECT DISTINCT p_type FROM part WHERE p_type <> 'MEDIUM'))
  SELECT p_partkey, CAST(coalesce(i, (SELECT max(n) FROM k)) AS DOUBLE) AS p_type_idx FROM part LEFT JOIN k USING (p_type)""")
def prep_label_index(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", "p_type")
    return L.apply_index(L.fit_index(p.where("p_type <> 'MEDIUM'"), "p_type"), p).select("p_partkey", "p_type_idx")


@query("prep_standardise", """WITH s AS (SELECT avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS d FROM part WHERE p_size < 30)
  SELECT p_partkey, round((p_retailprice - m) / d, 6) AS p_retailprice, 0.0::DOUBLE AS flat FROM part, s""")
def prep_standardise(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size", F.lit(5.0).alias("flat"))
    out = L.apply_scaler(p, L.fit_scaler(p.where("p_size < 30"), ["p_retailprice", "flat"]), ["p_retailprice", "flat"])
    return out.select("p_partkey", r("p_retailprice", 6).alias("p_retailprice"), "flat")


@query("prep_target_encode", f"""WITH {_FRAME}, tr AS (SELECT *, log10(target) AS y FROM fr WHERE split = 'train' AND city <> 'NATION_3'),
  g AS (SELECT avg(y) AS g FROM tr), c AS (SELECT city, sum(y) AS s, count(*) AS n FROM tr GROUP BY 1)
  SELECT building_id, year, round(coalesce((s + 20 * g) / (n + 20), g), 6) AS city_te FROM fr LEFT JOIN c USING (city), g""")
def prep_target_encode(spark, sf):
    x = _frame(spark, sf).withColumn("y", F.log10("target"))
    out = L.target_encode(x.where("split = 'train' and city <> 'NATION_3'"), x, "city", "y")
    return out.select(*_P, r("city_te", 6).alias("city_te"))


@query("prep_mean_impute", f"""WITH {_FRAME}, m AS (SELECT avg(lag1) AS a, avg(lag3) AS b FROM fr WHERE split = 'train')
  SELECT building_id, year, round(coalesce(lag1, a), 3) AS lag1, round(coalesce(lag3, b), 3) AS lag3 FROM fr, m""")
def prep_mean_impute(spark, sf):
    x = _frame(spark, sf)
    out = L.apply_means(x, L.fit_means(x.where("split = 'train'"), ["lag1", "lag3"]), ["lag1", "lag3"])
    return out.select(*_P, r("lag1", 3).alias("lag1"), r("lag3", 3).alias("lag3"))


_CLIMATE = """cl AS (SELECT city, building_id, year, n_orders * 1.5::DOUBLE AS hdd, n_orders + 0.25::DOUBLE AS cdd FROM panel WHERE property_type <> 'MACHINERY')"""


def _climate(spark, sf):
    return S.panel(spark, sf).where("property_type <> 'MACHINERY'").select(
        "city", *_P, (F.col("n_orders") * 1.5).alias("hdd_18c"), (F.col("n_orders") + 0.25).alias("cdd_18c"),
        *[F.lit(1.0).alias(c) for c in L.CLIMATE_PLUS])


@query("prep_tier_panel", f"""WITH {S.PANEL}, {_CLIMATE} SELECT building_id, year, target, hdd, cdd FROM panel LEFT JOIN cl USING (city, building_id, year)""")
def prep_tier_panel(spark, sf):
    return L.load_panel(S.panel(spark, sf), _climate(spark, sf), "core_all_cities").select(*_P, "target", "hdd", "cdd")


@query("prep_forecast_tier", f"""WITH {S.PANEL}, {_CLIMATE}, j AS (SELECT p.*, hdd, cdd FROM panel p LEFT JOIN cl USING (city, building_id, year))
  SELECT building_id, year, lag(target) OVER {S.WIN} AS lag1, lag(hdd) OVER {S.WIN} AS hdd_lag1, lag(cdd, 2) OVER {S.WIN} AS cdd_lag2 FROM j""")
def prep_forecast_tier(spark, sf):
    x = L.load_panel(S.panel(spark, sf), _climate(spark, sf), "core_all_cities")
    out = lag_features(x, *_P, "target", 3, climate=["hdd", "cdd"])
    wanted = [c for c in L.forecast_features("core_all_cities") if c in ("lag1", "hdd_lag1", "cdd_lag2")]
    return out.select(*_P, *wanted)


@query("prep_valid_rows", f"WITH {_FRAME} SELECT building_id, year FROM fr WHERE lag2 IS NOT NULL AND lag3 IS NOT NULL")
def prep_valid_rows(spark, sf):
    return L.valid_rows(_frame(spark, sf), ["lag2", "lag3"]).select(*_P)


@query("prep_city_weights", f"WITH {S.PANEL} SELECT building_id, year, round(1.0::DOUBLE / count(*) OVER (PARTITION BY city), 9) AS weight FROM panel")
def prep_city_weights(spark, sf):
    return L.city_weights(S.panel(spark, sf)).select(*_P, r("weight", 9).alias("weight"))


def _emb(spark, sf):
    return t(spark, sf, "embeddings").select("vec_id", "embedding", F.col("label").cast("double").alias("y"),
                                             F.when(F.col("label") >= 8, "test").otherwise("train").alias("split"))


@query("prep_pca")
def prep_pca(spark, sf):
    """Components of the training rows; the sign of a component is free, so absolute scores are reported."""
    e = _emb(spark, sf)
    out = L.fit_pca(e.where("split = 'train'"), "embedding", 8)(e)
    return out.select("vec_id", *[r(F.abs(F.element_at("embedding_pca", i + 1)), 4).alias(f"pc{i + 1}") for i in range(8)])


@query("prep_pls")
def prep_pls(spark, sf):
    e = _emb(spark, sf)
    out = L.fit_pls(e.where("split = 'train'"), "embedding", "y", 8)(e)
    return out.select("vec_id", *[r(F.element_at("embedding_pls", i + 1), 4).alias(f"c{i + 1}") for i in range(8)])


@query("prep_concat_block", """SELECT vec_id, CAST(65 AS BIGINT) AS width, round(CAST(embedding[1] AS DOUBLE), 6) AS second FROM embeddings""")
def prep_concat_block(spark, sf):
    from pyspark.ml.functions import vector_to_array
    out = L.concat_features(_emb(spark, sf), ["y"], "embedding").withColumn("a", vector_to_array("features"))
    return out.select("vec_id", F.size("a").cast("long").alias("width"), r(F.element_at("a", 2), 6).alias("second"))


# ---------------------------------------------------------------- learners

_FEATS = ["lag1", "lag2", "mean_hist", "area"]


def _parts(spark, sf):
    x = _frame(spark, sf).where("lag1 is not null").withColumn("y2", F.col("target"))
    return x.where("split = 'train'"), x.where("split = 'val'"), x.where("split = 'test'")


def _scored(df, name):
    s = all_metrics(df, [], "target", "pred")
    return s.select(F.lit(name).alias("model"), "n", *[r(m, 4).alias(m) for m in METRICS])


@query("learn_ols", f"""WITH {_FRAME}, z AS (SELECT * FROM fr WHERE lag1 IS NOT NULL AND split = 'train'),
  k AS (SELECT avg(lag1) AS ml, avg(area) AS ma, avg(ln(1 + target)) AS my, var_pop(lag1) AS vl, var_pop(area) AS va, covar_pop(lag1, area) AS c,
    covar_pop(lag1, ln(1 + target)) AS cl, covar_pop(area, ln(1 + target)) AS ca, max(target) AS top FROM z),
  b AS (SELECT *, (cl * va - ca * c) / (vl * va - c * c) AS bl, (ca * vl - cl * c) / (vl * va - c * c) AS ba FROM k)
  SELECT building_id, year, round(ln(1 + least(greatest(exp(my + bl * (lag1 - ml) + ba * (area - ma)) - 1, 0), 2 * top)), 5) AS pred_log
  FROM fr, b WHERE split = 'test' AND lag1 IS NOT NULL""")
def learn_ols(spark, sf):
    train, _, test = _parts(spark, sf)
    out = M.ols(train, ["lag1", "area"], "target").predict(test)
    return out.select(*_P, r(F.log1p("pred"), 5).alias("pred_log"))


@query("learn_linear_family")
def learn_linear_family(spark, sf):
    train, _, test = _parts(spark, sf)
    out = [_scored(f(train, _FEATS, "target").predict(test), n) for n, f in (("ols", M.ols), ("ridge", M.ridge), ("lasso", M.lasso))]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("learn_random_forest")
def learn_random_forest(spark, sf):
    train, _, test = _parts(spark, sf)
    return _scored(M.random_forest(train, _FEATS, "target").predict(test), "random_forest")


@query("learn_boosted_trees")
def learn_boosted_trees(spark, sf):
    train, val, test = _parts(spark, sf)
    return _scored(M.gbt(train, _FEATS, "target", val=val).predict(test), "gbt")


@query("learn_classify_then_regress")
def learn_classify_then_regress(spark, sf):
    train, _, test = _parts(spark, sf)
    forests = M.SectorForests(train, _FEATS, "property_type", "target")
    a = M.classify_then_regress(train, test, _FEATS, "property_type", "target", trained=forests)
    b = M.classify_then_regress(train, test, _FEATS, "property_type", "target", oracle=True, trained=forests)
    return _scored(a, "predicted_sector").unionByName(_scored(b, "true_sector"))


_R4 = ", ".join(f"round({m}, 4) AS {m}" for m in METRICS)


def line_sql(name: str, x: str, y: str, train: str, rows: str, src: str = "fr", alpha: float = 0.0) -> str:
    """Least squares (ridge) of log1p(y) on one standardised feature, clipped to [0, 2 x largest training target]: (rows..., p)."""
    slope = f"regr_slope(ln(1 + {y}), {x})" + (f" * count(*) / (count(*) + {alpha}::DOUBLE)" if alpha else "")
    return f"""{name}_k AS (SELECT {slope} AS b, avg(ln(1 + {y})) - {slope} * avg({x}) AS a, max({y}) AS top FROM {src} WHERE {train}
    AND {y} IS NOT NULL), {name} AS (SELECT {src}.*, least(greatest(exp(a + b * {x}) - 1, 0), 2 * top) AS p FROM {src}, {name}_k WHERE {rows})"""


@query("learn_next_year", f"""WITH {_FRAME}, {line_sql('o', 'lag1', 'target', "split = 'train' AND lag1 IS NOT NULL", "split <> 'train' AND lag1 IS NOT NULL")},
  s AS (SELECT split AS split_type, count(*) AS n, {SCORES} FROM (SELECT split, target AS y, p FROM o) GROUP BY 1)
  SELECT 'ols' AS model, split_type, n, {_R4} FROM s""")
def learn_next_year(spark, sf):
    out = M.run_next_year(M.ols, *_parts(spark, sf), ["lag1"], "target", "ols")
    return out.select("model", "split_type", "n", *[r(m, 4).alias(m) for m in METRICS])


@query("learn_multi_horizon", f"""WITH {_FRAME}, ld AS (SELECT *, lead(target, 1) OVER {S.WIN} AS h1, lead(target, 2) OVER {S.WIN} AS h2 FROM fr),
  {line_sql('a1', 'lag1', 'h1', 'year <= 1997 AND lag1 IS NOT NULL', 'year >= 1998 AND lag1 IS NOT NULL AND h1 IS NOT NULL', 'ld')},
  {line_sql('a2', 'lag1', 'h2', 'year <= 1997 AND lag1 IS NOT NULL', 'year >= 1998 AND lag1 IS NOT NULL AND h2 IS NOT NULL', 'ld')},
  s AS (SELECT CAST(horizon AS BIGINT) AS horizon, count(*) AS n, {SCORES} FROM (SELECT 1 AS horizon, h1 AS y, p FROM a1 UNION ALL SELECT 2, h2, p FROM a2) GROUP BY 1)
  SELECT 'ols' AS model, horizon, n, {_R4} FROM s""")
def learn_multi_horizon(spark, sf):
    x = leads(_frame(spark, sf), *_P, "target", (1, 2)).where("lag1 is not null")
    out = M.run_multi_horizon(M.ols, x.where("year <= 1997"), x.where("year >= 1998"), ["lag1"], {1: "target_h1", 2: "target_h2"}, "ols")
    return out.select("model", F.col("horizon").cast("long").alias("horizon"), "n", *[r(m, 4).alias(m) for m in METRICS])


@query("learn_random_search")
def learn_random_search(spark, sf):
    train, val, test = _parts(spark, sf)
    trials, _, _ = M.random_search(M.ridge, {"alpha": [0.01, 0.1, 1.0, 10.0, 100.0, 1000.0]}, 12, train, val, test, _FEATS, "target")
    return trials.select(F.col("trial").cast("long").alias("trial"), "config", r("score").alias("score"), "is_best")


@query("learn_residual_stage", f"""WITH {_FRAME}, z AS (SELECT * FROM fr WHERE lag1 IS NOT NULL AND split <> 'val'),
  {line_sql('b1', 'area', 'target', "split = 'train'", 'true', 'z')},
  k2 AS (SELECT regr_slope(target - p, lag1) AS b, regr_intercept(target - p, lag1) AS a, max(target) AS top FROM b1 WHERE split = 'train'),
  f AS (SELECT target AS y, least(greatest(p + a + b * lag1, 0), 2 * top) AS p FROM b1, k2 WHERE split = 'test'),
  s AS (SELECT count(*) AS n, {SCORES} FROM f) SELECT 'residual' AS model, n, {_R4} FROM s""")
def learn_residual_stage(spark, sf):
    train, _, test = _parts(spark, sf)
    return _scored(M.residual_stage(train, test, ["area"], ["lag1"], "target", M.ols, M.ols), "residual")


_TURNS = ", ".join(f"('{c}', {i}, {M.rotation(c, i)}::BIGINT)" for c in ("lag1", "area") for i in range(5))


_R2 = ("CASE WHEN var_pop(y) = 0 THEN CASE WHEN sum((y - p) * (y - p)) = 0 THEN 1.0 ELSE 0.0 END "
       "ELSE 1 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(*), 0) END")


@query("learn_permutation_importance", f"""WITH {_FRAME}, te AS (SELECT *, row_number() OVER (ORDER BY {sql_hash('permute', 'building_id', 'year')},
      building_id, year) AS rk, count(*) OVER () AS n FROM fr WHERE split = 'test' AND lag1 IS NOT NULL AND target IS NOT NULL),
  m AS (SELECT var_pop(lag1) AS s11, var_pop(area) AS s22, covar_pop(lag1, area) AS s12, covar_pop(lag1, l) AS s1, covar_pop(area, l) AS s2,
    avg(lag1) AS m1, avg(area) AS m2, avg(l) AS ml, max(target) AS top FROM (SELECT *, ln(1 + target) AS l FROM fr WHERE split = 'train'
    AND lag1 IS NOT NULL AND target IS NOT NULL)),
  k AS (SELECT (s1 * s22 - s2 * s12) / (s11 * s22 - s12 * s12) AS b1, (s2 * s11 - s1 * s12) / (s11 * s22 - s12 * s12) AS b2, m1, m2, ml, top FROM m),
  base AS (SELECT {_R2} AS r0 FROM (SELECT target AS y, least(greatest(exp(ml + b1 * (lag1 - m1) + b2 * (area - m2)) - 1, 0), 2 * top) AS p FROM te, k)),
  turns(feature, rep, turn) AS (VALUES {_TURNS}),
  sh AS (SELECT feature, rep, x.target AS y, least(greatest(exp(ml + b1 * ((CASE feature WHEN 'lag1' THEN v.lag1 ELSE x.lag1 END) - m1)
      + b2 * ((CASE feature WHEN 'area' THEN v.area ELSE x.area END) - m2)) - 1, 0), 2 * top) AS p
    FROM te x, turns, te v, k WHERE v.rk = (x.rk - 1 + 1 + turn % greatest(x.n - 1, 1)) % x.n + 1),
  d AS (SELECT feature, rep, (SELECT r0 FROM base) - ({_R2}) AS d FROM sh GROUP BY 1, 2)
  SELECT feature, round(avg(d), 5) AS r2_drop_mean, round(stddev_pop(d), 5) AS r2_drop_std FROM d GROUP BY 1""")
def learn_permutation_importance(spark, sf):
    train, _, test = _parts(spark, sf)
    out = M.permutation_importance(M.ols(train, ["lag1", "area"], "target"), test, list(_P), "target")
    return out.select("feature", r("r2_drop_mean", 5).alias("r2_drop_mean"), r("r2_drop_std", 5).alias("r2_drop_std"))


_CELLS = {("history", "ols"): "lag1", ("area", "ols"): "area", ("history", "ridge"): "lag1", ("area", "ridge"): "area"}


def _grid_sql() -> str:
    made = ", ".join(line_sql(f"g{i}", x, "target", "split = 'train' AND lag1 IS NOT NULL", "split = 'test' AND lag1 IS NOT NULL",
                              alpha=M.RIDGE_ALPHA if m == "ridge" else 0.0) for i, ((_, m), x) in enumerate(_CELLS.items()))
    rows = " UNION ALL ".join(f"SELECT '{t}' AS feature_set, '{m}' AS model, city, target AS y, p FROM g{i}" for i, (t, m) in enumerate(_CELLS))
    unp = " UNION ALL ".join(f"SELECT feature_set, model, scope, scope_value, '{m}' AS metric, {m} AS value FROM w" for m in METRICS)
    avgs = ", ".join(f"avg({m})" for m in METRICS)
    return f"""WITH {_FRAME}, {made}, rows_in AS ({rows}),
  c AS (SELECT feature_set, model, city, count(*) AS n, {SCORES} FROM rows_in GROUP BY 1, 2, 3),
  a AS (SELECT feature_set, model, {SCORES} FROM rows_in GROUP BY 1, 2),
  w AS (SELECT feature_set, model, 'city' AS scope, city AS scope_value, {', '.join(METRICS)} FROM c
    UNION ALL SELECT feature_set, model, 'overall', 'all', {', '.join(METRICS)} FROM a
    UNION ALL SELECT feature_set, model, 'macro', 'all', {avgs} FROM c WHERE n >= 5 GROUP BY 1, 2), u AS ({unp})
  SELECT 'a' AS task, feature_set, model, CAST(42 AS BIGINT) AS seed, 'grouped' AS split_type, scope, scope_value, metric,
    round(value, 4) AS value FROM u"""


@query("learn_grid", _grid_sql())
def learn_grid(spark, sf):
    train, _, test = _parts(spark, sf)
    out = run_grid({"history": ["lag1"], "area": ["area"]}, {"ols": ("ols", {}), "ridge": ("ridge", {})}, train, test, "target", "city")
    return out.withColumn("value", r("value"))
