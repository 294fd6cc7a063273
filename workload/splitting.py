"""Splits and samples."""

from pyspark.sql import functions as F

from emipanel.operators import splits as K
from workload import stage as S
from workload.cleaning import STRATA
from workload.registry import query
from workload.stage import pick, r, sql_hash, sql_pick, t

_KEY = ["building_id", "year"]
_H = sql_hash(42, "building_id", "year")
_HB = sql_hash(42, "building_id")


def _cut(rank: str, size: str, cuts=(0.8, 0.9)) -> str:
    a, b = cuts
    return f"CASE WHEN {rank} <= round({size} * {a}::DOUBLE) THEN 'train' WHEN {rank} <= round({size} * {b}::DOUBLE) THEN 'val' ELSE 'test' END"


def _ranked(strata: str, h: str, order: str, src: str = "panel") -> str:
    over = f"PARTITION BY {strata}" if strata else ""
    return (f"rk AS (SELECT *, row_number() OVER ({over} ORDER BY {h}, {order}) AS rn, count(*) OVER ({over}) AS sz FROM {src})")


def _p(spark, sf):
    return S.panel(spark, sf).select("city", "building_id", "year", "property_type", "target", "region")


_STRATIFIED = f"""WITH {S.PANEL}, rows_in AS (SELECT *, property_type AS a, city AS b FROM panel), {STRATA},
  {_ranked('stratum', _H, 'building_id, year', 'strata')}, sp AS (SELECT *, {_cut('rn', 'sz')} AS split FROM rk)"""


def _stratified(spark, sf):
    x = K.stratum_label(_p(spark, sf), "property_type", "city")
    return K.stratified_split(x, ["stratum"], _KEY)


@query("split_stratified", f"{_STRATIFIED} SELECT building_id, year, stratum, split FROM sp")
def split_stratified(spark, sf):
    return _stratified(spark, sf).select("building_id", "year", "stratum", "split")


@query("split_inherited", f"""{_STRATIFIED}, c AS (SELECT building_id, year FROM panel WHERE target BETWEEN 100000 AND 900000)
  SELECT building_id, year, split FROM c JOIN sp USING (building_id, year)""")
def split_inherited(spark, sf):
    clean = _p(spark, sf).where("target between 100000 and 900000").select(*_KEY)
    return K.inherit_split(clean, _stratified(spark, sf), _KEY)


@query("split_grouped", f"""WITH {S.PANEL}, g AS (SELECT city, building_id, min(property_type) AS property_type FROM panel GROUP BY 1, 2),
  {_ranked('property_type', sql_hash(42, 'city', 'building_id'), 'city, building_id', 'g')}
  SELECT p.building_id, p.year, {_cut('rn', 'sz', (0.7, 0.8))} AS split FROM panel p JOIN rk USING (city, building_id)""")
def split_grouped(spark, sf):
    return K.grouped_split(_p(spark, sf), ["city", "building_id"], ["property_type"]).select("building_id", "year", "split")


@query("split_random_rows", f"""WITH {S.PANEL}, {_ranked('city, property_type', _H, 'building_id, year')}
  SELECT building_id, year, {_cut('rn', 'sz', (0.7, 0.8))} AS split FROM rk""")
def split_random_rows(spark, sf):
    return K.random_split(_p(spark, sf), ["city", "property_type"], _KEY).select("building_id", "year", "split")


_TEMPORAL = "CASE WHEN year <= 1998 THEN 'train' WHEN year = 1999 THEN 'val' WHEN year >= 2000 THEN 'test' END AS split"


@query("split_temporal", f"WITH {S.PANEL} SELECT building_id, year, {_TEMPORAL} FROM panel")
def split_temporal(spark, sf):
    return K.temporal_split(_p(spark, sf), "year", 1998, 1999, 2000).select("building_id", "year", "split")


@query("split_yearly_tests", f"""WITH {S.PANEL}, s AS (SELECT *, CASE WHEN year <= 1997 THEN 'train' WHEN year IN (1998, 1999, 2000)
  THEN 'test_' || year END AS split FROM panel) SELECT split, count(*) AS n, round(avg(target), 4) AS mean_target FROM s
  WHERE split IS NOT NULL GROUP BY 1""")
def split_yearly_tests(spark, sf):
    x = K.yearly_tests(_p(spark, sf), "year", 1997, (1998, 1999, 2000))
    return x.groupBy("split").agg(F.count(F.lit(1)).alias("n"), r(F.avg("target")).alias("mean_target"))


@query("split_forecast", f"""WITH {S.PANEL} SELECT building_id, year, {_TEMPORAL} FROM panel WHERE building_id IN
  (SELECT building_id FROM panel GROUP BY 1 HAVING count(DISTINCT year) >= 5)""")
def split_forecast(spark, sf):
    return K.forecast_split(_p(spark, sf), "building_id", "year", 5, 1998, 1999, 2000).select("building_id", "year", "split")


_LOO = """WITH {}, c AS (SELECT {} AS grp, count(*) AS n_test FROM panel GROUP BY 1)
  SELECT grp, n_test, (SELECT count(*) FROM panel) - n_test AS n_train FROM c WHERE n_test >= {}"""


@query("split_leave_one_city_out", _LOO.format(S.PANEL, "city", 50))
def split_leave_one_city_out(spark, sf):
    return K.leave_one_out_sizes(_p(spark, sf), "city", 50).withColumnRenamed("city", "grp")


@query("split_leave_one_type_out", _LOO.format(S.PANEL, "property_type", 200))
def split_leave_one_type_out(spark, sf):
    return K.leave_one_out_sizes(_p(spark, sf), "property_type", 200).withColumnRenamed("property_type", "grp")


@query("split_leave_one_out_mean", f"""WITH {S.PANEL}, c AS (SELECT city, sum(ln(1 + target)) AS s, count(*) AS n FROM panel GROUP BY 1)
  SELECT city, n AS n_test, round(ln(1 + exp(((SELECT sum(s) FROM c) - s) / ((SELECT sum(n) FROM c) - n)) - 1), 6) AS loo_log_mean FROM c""")
def split_leave_one_out_mean(spark, sf):
    out = K.leave_one_out_mean(_p(spark, sf), "city", "target")
    return out.select("city", "n_test", r(F.log1p("loo_mean"), 6).alias("loo_log_mean"))


_PAIRS = [("west", "NATION_1", "NATION_9"), ("west", "NATION_2", "NATION_9"), ("all", None, "NATION_3"), ("one", "NATION_4", "NATION_5")]


@query("split_transfer_folds", f"""WITH {S.PANEL}, pr(fold, source, target_city) AS (VALUES {', '.join(
    f"('{f}', {'NULL' if s is None else repr(s)}, '{g}')" for f, s, g in _PAIRS)}), c AS (SELECT city, count(*) AS n FROM panel GROUP BY 1)
  SELECT fold, target_city AS target, CAST(sum(CASE WHEN source IS NULL THEN (SELECT count(*) FROM panel) - b.n ELSE a.n END) AS BIGINT) AS n_train,
    max(b.n) AS n_test FROM pr LEFT JOIN c a ON a.city = source JOIN c b ON b.city = target_city GROUP BY 1, 2""")
def split_transfer_folds(spark, sf):
    pairs = spark.createDataFrame(_PAIRS, "fold string, source string, target string")
    return K.transfer_folds(_p(spark, sf), pairs)


@query("split_few_shot", f"""WITH {S.PANEL}, x AS (SELECT * FROM panel WHERE city IN ('NATION_1', 'NATION_7', 'NATION_20')),
  rr AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY {_H}, building_id, year) AS row_rank FROM x),
  bb AS (SELECT city, building_id, row_number() OVER (PARTITION BY city ORDER BY {_HB}, building_id) AS b_rank,
    count(*) OVER (PARTITION BY city) AS nb FROM (SELECT DISTINCT city, building_id FROM x)),
  e AS (SELECT rr.city, building_id, year, k, CASE WHEN (CASE WHEN nb >= 50 + 10 THEN b_rank ELSE row_rank END) <= k THEN 'shot' ELSE 'test' END AS role
    FROM rr JOIN bb USING (city, building_id), (VALUES (10), (50)) ks(k))
  SELECT city, building_id, year, CAST(k AS BIGINT) AS k, role FROM e QUALIFY count(*) FILTER (role = 'test') OVER (PARTITION BY city, k) >= 30""")
def split_few_shot(spark, sf):
    out = K.few_shot(_p(spark, sf), "city", "building_id", _KEY, ["NATION_1", "NATION_7", "NATION_20"], (10, 50))
    return out.select("city", "building_id", "year", F.col("k").cast("long").alias("k"), "role")


@query("split_leave_region_out", f"""WITH {S.PANEL}, x AS (SELECT *, (['US', 'EU', 'APAC', 'Other', 'Other'])[region + 1] AS wr FROM panel)
  SELECT g AS region, count(*) FILTER (wr <> g) AS n_train, count(*) FILTER (wr = g) AS n_test FROM x, (VALUES ('US'), ('EU'), ('APAC')) f(g)
  WHERE wr <> 'Other' GROUP BY 1""")
def split_leave_region_out(spark, sf):
    x = _p(spark, sf).withColumn("wr", pick(F.col("region"), ["US", "EU", "APAC", "Other", "Other"]))
    out = None
    for name, train, test in K.leave_region_out(x, "wr"):
        n = (train.select(F.lit("n_train").alias("part")).unionByName(test.select(F.lit("n_test").alias("part")))
             .agg(F.count_if(F.col("part") == "n_train").alias("n_train"), F.count_if(F.col("part") == "n_test").alias("n_test"))
             .select(F.lit(name).alias("region"), "n_train", "n_test"))
        out = n if out is None else out.unionByName(n)
    return out


def _entity(frac, held, minimum=0):
    return f"""WITH {S.PANEL}, ids AS (SELECT DISTINCT building_id FROM panel), {_ranked('', _HB, 'building_id', 'ids')}
  SELECT building_id, year, {held} AS split FROM panel JOIN rk USING (building_id)"""


@query("split_entity_holdout", _entity(0.5, "CASE WHEN rn <= round(sz * 0.5::DOUBLE) THEN 'train' ELSE 'test' END"))
def split_entity_holdout(spark, sf):
    return K.entity_holdout(_p(spark, sf), "building_id", 0.5).select("building_id", "year", "split")


@query("split_carved_validation", _entity(0.15, "CASE WHEN sz >= 10 AND rn <= round(sz * 0.15::DOUBLE) THEN 'val' ELSE 'train' END"))
def split_carved_validation(spark, sf):
    return K.carve_validation(_p(spark, sf), "building_id", 0.15).select("building_id", "year", "split")


@query("sample_capped_rows", f"""WITH {S.PANEL} SELECT building_id, year FROM panel ORDER BY {_H}, building_id, year LIMIT 1000""")
def sample_capped_rows(spark, sf):
    return K.cap_rows(_p(spark, sf), 1000, _KEY).select(*_KEY)


@query("split_row_holdout", f"""WITH {S.PANEL}, {_ranked('', _H, 'building_id, year')} SELECT building_id, year,
  CASE WHEN rn <= round(sz * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM rk""")
def split_row_holdout(spark, sf):
    return K.holdout(_p(spark, sf), _KEY, 0.2).select("building_id", "year", "split")


@query("sample_city_quota", f"""WITH {S.PANEL}, a AS (SELECT *, {_H} AS h, row_number() OVER (PARTITION BY city, year ORDER BY {_H}, building_id, year) AS rn
    FROM panel), q AS (SELECT city, greatest(1, 100 // greatest(1, count(DISTINCT year))) AS quota FROM panel GROUP BY 1),
  o AS (SELECT a.*, row_number() OVER (PARTITION BY city ORDER BY CASE WHEN rn <= quota THEN 0 ELSE 1 END, h >> 1, h, building_id, year) AS rk
    FROM a JOIN q USING (city))
  SELECT city, building_id, year FROM o WHERE rk <= 100""")
def sample_city_quota(spark, sf):
    return K.quota_sample(_p(spark, sf), "city", "year", _KEY, 100).select("city", "building_id", "year")


@query("split_within_city", f"""WITH {S.PANEL}, {_ranked('city, property_type', _H, 'building_id, year')}
  SELECT city, building_id, year, {_cut('rn', 'sz', (0.7, 0.8))} AS split FROM rk""")
def split_within_city(spark, sf):
    return K.split_within(_p(spark, sf), "city", ["property_type"], _KEY).select("city", "building_id", "year", "split")


@query("sample_one_per_group", f"""WITH {S.PANEL}, {_ranked('property_type', _H, 'building_id, year')}
  SELECT property_type, building_id, year FROM rk WHERE rn = 1""")
def sample_one_per_group(spark, sf):
    return K.one_per_group(_p(spark, sf), "property_type", _KEY).select("property_type", "building_id", "year")


@query("split_for_seeds", f"""WITH {S.PANEL}, s AS (SELECT panel.*, seed FROM panel, (VALUES (42), (123), (456)) v(seed)),
  rk AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY CAST('0x' || substr(md5(concat_ws('|', seed, building_id, year)), 1, 8) AS BIGINT),
    building_id, year) AS rn, count(*) OVER (PARTITION BY seed) AS sz FROM s)
  SELECT CAST(seed AS BIGINT) AS seed, building_id, year, {_cut('rn', 'sz')} AS split FROM rk""")
def split_for_seeds(spark, sf):
    from emipanel.operators.skew import rank_in_group
    x = K.for_seeds(_p(spark, sf), (42, 123, 456))
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in ("seed", *_KEY)])
    h = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    x = rank_in_group(x, ["seed"], h, _KEY, "rk", "sz")
    label = F.when(F.col("rk") <= F.round(F.col("sz") * 0.8), "train").when(F.col("rk") <= F.round(F.col("sz") * 0.9), "val").otherwise("test")
    return x.select(F.col("seed").cast("long").alias("seed"), "building_id", "year", label.alias("split"))


@query("sample_embedding_subset", f"""WITH {S.PANEL} SELECT city, building_id, year FROM panel WHERE building_id IN
  (SELECT vec_id FROM embeddings WHERE {sql_pick('vec_id', ['ok', 'no_images', 'ok'])} = 'ok')""")
def sample_embedding_subset(spark, sf):
    from emipanel.operators.filters import usable_embeddings
    e = t(spark, sf, "embeddings").select(F.col("vec_id").alias("building_id"), pick(F.col("vec_id"), ["ok", "no_images", "ok"]).alias("status"),
                                          F.lit("building_patch").alias("img_source"))
    return K.filter_to_embedding_subset(_p(spark, sf), usable_embeddings(e), ["building_id"]).select("city", "building_id", "year")
