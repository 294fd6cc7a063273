"""Fold runners: leave one out, transfers, few shots, regions, each fold fitted and scored; twins fit and predict row by row."""

from pyspark.sql import functions as F

from emipanel.functions.core import hash32
from emipanel.operators import folds as X
from emipanel.operators import splits as K
from workload import stage as S
from workload.registry import ORACLES, query
from workload.splitting import _KEY, _PAIRS
from workload.stage import pick, r, sql_hash


def _model():
    """Features, target and the condition of validation rows."""
    return [F.log1p("area"), F.col("n_orders").cast("double")], F.log1p("target"), F.pmod(hash32(7, "building_id"), F.lit(100)) < 15


_ROWS = f"""{S.PANEL}, p AS (SELECT *, ln(1 + target) AS y, ln(1 + area) AS x1, n_orders::DOUBLE AS x2,
  {sql_hash(7, 'building_id')} % 100 < 15 AS held FROM panel)"""


def _twin(train: str, test: str, keys: str, least: int, before: str = "") -> str:
    """Per fold: slopes of two features from covariances of its training rows, then errors over its rows."""
    on = " AND ".join(f"b.{k.strip()} = q.{k.strip()}" for k in keys.split(","))
    by = ", ".join(f"q.{k.strip()}" for k in keys.split(","))
    err = "q.y - b.my - b.b1 * (q.x1 - b.m1) - b.b2 * (q.x2 - b.m2)"
    return f"""WITH {_ROWS}{before}, tr AS ({train}), te AS ({test}),
  m AS (SELECT {keys}, count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS v1, var_pop(x2) AS v2,
    covar_pop(x1, x2) AS c12, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2 FROM tr WHERE NOT held GROUP BY {keys}),
  b AS (SELECT *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM m),
  v AS (SELECT {by}, count(*) AS n_val, sqrt(avg(({err}) ** 2)) AS val_rmse FROM tr q JOIN b ON {on} WHERE q.held GROUP BY {by}),
  e AS (SELECT {by}, max(b.n) AS n_train, count(*) AS n_test, sqrt(avg(({err}) ** 2)) AS rmse,
    1 - avg(({err}) ** 2) / var_pop(q.y) AS r2, -avg({err}) AS bias FROM te q JOIN b ON {on} GROUP BY {by})
  SELECT {', '.join('b.' + k.strip() for k in keys.split(','))}, e.n_train, coalesce(v.n_val, 0) AS n_val, e.n_test, round(e.rmse, 6) AS rmse, round(e.r2, 6) AS r2,
    round(e.bias, 6) AS bias, round(v.val_rmse, 6) AS val_rmse, round(b.b1, 6) AS slope_area, round(b.b2, 6) AS slope_orders
  FROM e q JOIN e USING ({keys}) JOIN b USING ({keys}) LEFT JOIN v USING ({keys}) WHERE e.n_test >= {least} AND e.n_train + coalesce(v.n_val, 0) >= {least}"""


def _scored(folds, *keys):
    out = X.fold_scores(folds, 2)
    return out.select(*keys, "n_train", "n_val", "n_test", *[r(c, 6).alias(c) for c in ("rmse", "r2", "bias", "val_rmse")],
                      r(F.get("coef", F.lit(0)), 6).alias("slope_area"), r(F.get("coef", F.lit(1)), 6).alias("slope_orders"))


def _moments(spark, sf, key):
    return X.group_moments(S.panel(spark, sf), [key], *_model())


def _loo_twin(col: str, least: int, src: str = "p") -> str:
    return _twin(f"SELECT g.{col}, y, x1, x2, held FROM {src} x JOIN (SELECT DISTINCT {col} FROM {src}) g ON x.{col} <> g.{col}",
                 f"SELECT {col}, y, x1, x2 FROM {src}", col, least)


@query("fold_leave_one_city_out", _loo_twin("city", 50))
def fold_leave_one_city_out(spark, sf):
    return _scored(X.leave_one_out_folds(_moments(spark, sf, "city"), "city", 2, 50), "city")


@query("fold_leave_one_type_out", _loo_twin("property_type", 200))
def fold_leave_one_type_out(spark, sf):
    return _scored(X.leave_one_out_folds(_moments(spark, sf, "property_type"), "property_type", 2, 200), "property_type")


@query("fold_leave_region_out", _twin(
    "SELECT g.wr, y, x1, x2, held FROM w x JOIN (SELECT DISTINCT wr FROM w) g ON x.wr <> g.wr", "SELECT wr, y, x1, x2 FROM w", "wr", 1,
    ", w AS (SELECT * FROM (SELECT *, (['US', 'EU', 'APAC', 'Other', 'Other'])[region + 1] AS wr FROM p) WHERE wr <> 'Other')"))
def fold_leave_region_out(spark, sf):
    x = S.panel(spark, sf).withColumn("wr", pick(F.col("region"), ["US", "EU", "APAC", "Other", "Other"])).where(F.col("wr") != "Other")
    return _scored(X.leave_one_out_folds(X.group_moments(x, ["wr"], *_model()), "wr", 2), "wr")


_PR = ", ".join(f"('{f}', {'NULL' if s is None else repr(s)}, '{g}')" for f, s, g in _PAIRS)


@query("fold_transfer", _twin(
    "SELECT fold, target_city, y, x1, x2, held FROM p JOIN pr ON CASE WHEN source IS NULL THEN city <> target_city ELSE city = source END",
    "SELECT fold, target_city, y, x1, x2 FROM p JOIN (SELECT DISTINCT fold, target_city FROM pr) ON city = target_city", "fold, target_city", 1,
    f", pr(fold, source, target_city) AS (VALUES {_PR})"))
def fold_transfer(spark, sf):
    pairs = spark.createDataFrame(_PAIRS, "fold string, source string, target string")
    return _scored(X.transfer_score_folds(_moments(spark, sf, "city"), pairs, "city", 2), "fold", F.col("target").alias("target_city"))


@query("split_transfer_rows", f"""WITH {S.PANEL}, pr(fold, source, target_city) AS (VALUES {_PR})
  SELECT DISTINCT building_id, year, city, fold, target_city AS target, CASE WHEN city = target_city THEN 'test' ELSE 'train' END AS role
  FROM panel JOIN pr ON city = target_city OR source IS NULL OR city = source""")
def split_transfer_rows(spark, sf):
    pairs = spark.createDataFrame(_PAIRS, "fold string, source string, target string")
    return X.transfer_rows(S.panel(spark, sf).select("building_id", "year", "city"), pairs, "city")


@query("fold_few_shot", _twin(
    """SELECT c AS city, k, y, x1, x2, held FROM (SELECT DISTINCT city AS c, k FROM roles) JOIN p ON city <> c
      UNION ALL SELECT city, k, y, x1, x2, held FROM p JOIN roles USING (city, building_id, year) WHERE role = 'shot'""",
    "SELECT city, k, y, x1, x2 FROM p JOIN roles USING (city, building_id, year) WHERE role = 'test'", "city, k", 30,
    f", roles AS (SELECT * FROM ({ORACLES['split_few_shot']}))"))
def fold_few_shot(spark, sf):
    panel = S.panel(spark, sf)
    roles = K.few_shot(panel, "city", "building_id", _KEY, ["NATION_1", "NATION_7", "NATION_20"], (10, 50))
    return _scored(X.few_shot_folds(panel, roles, "city", *_model(), 30), "city", F.col("k").cast("long").alias("k"))
