"""Joins and duplicate handling."""

from pyspark.sql import functions as F

from emipanel import dims
from emipanel.functions import log10_pos
from emipanel.operators import dedup as U
from emipanel.operators import joins as E
from workload import stage as S
from workload.registry import query
from workload.stage import pick, r, sql_pick, t


@query("join_left_one_key", """SELECT p_partkey, p_brand, n, qty FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n,
  round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""")
def join_left_one_key(spark, sf):
    li = t(spark, sf, "lineitem").groupBy(
        F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"), r(F.sum("l_quantity"), 2).alias("qty"))
    return E.left_join(t(spark, sf, "part").select("p_partkey", "p_brand"), li, ["p_partkey"])


_TWO = f"""WITH {S.PANEL}, o AS (SELECT o_custkey AS building_id, CAST(year(o_orderdate) AS BIGINT) AS year,
  max(o_totalprice) AS biggest FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2)
  SELECT building_id, year, target, biggest FROM panel {{}} JOIN o USING (building_id, year)"""


def _urgent(spark, sf):
    return t(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").groupBy(
        F.col("o_custkey").alias("building_id"), F.year("o_orderdate").cast("long").alias("year")).agg(
        F.max("o_totalprice").alias("biggest"))


@query("join_left_two_keys", _TWO.format("LEFT"))
def join_left_two_keys(spark, sf):
    return E.left_join(S.panel(spark, sf).select("building_id", "year", "target"), _urgent(spark, sf), ["building_id", "year"])


@query("join_inner_two_keys", _TWO.format(""))
def join_inner_two_keys(spark, sf):
    return E.inner_join(S.panel(spark, sf).select("building_id", "year", "target"), _urgent(spark, sf), ["building_id", "year"])


@query("join_lookup_chain", """SELECT o_orderkey, c_mktsegment AS segment, n_name AS nation, r_name AS region FROM orders
  LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
  LEFT JOIN region ON r_regionkey = n_regionkey""")
def join_lookup_chain(spark, sf):
    out = E.lookup_chain(t(spark, sf, "orders").select("o_orderkey", "o_custkey"), [
        (t(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "o_custkey", "c_custkey"),
        (t(spark, sf, "nation"), "c_nationkey", "n_nationkey"), (t(spark, sf, "region"), "n_regionkey", "r_regionkey")])
    return out.select("o_orderkey", F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"),
                      F.col("r_name").alias("region"))


_FACTORS = f"""{S.ACCOUNTS}, factors AS (SELECT nation AS region, p_type AS sector, year,
  round(sum(ghg) / 1000 / nullif(sum(va) * 1.08::DOUBLE, 0), 8) AS factor FROM accounts WHERE p_type <> 'PROMO' GROUP BY 1, 2, 3)"""
_TYPES = ["ECONOMY", "SMALL", "PROMO", "nothing"]


def _factors(spark, sf):
    from emipanel.operators.aggregates import intensity, sector_totals
    x = sector_totals(S.accounts(spark, sf), ["nation", "p_type", "year"], "ghg", "va", "p_brand", "p_type", "PROMO")
    return intensity(x).select(F.col("nation").alias("region"), F.col("p_type").alias("sector"), "year",
                               F.round("tco2e_per_musd", 8).alias("factor"))


@query("join_factor_lookup", f"""WITH {_FACTORS}, c AS (SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS nation,
    {sql_pick('c_custkey', _TYPES)} AS sector, 1996 + c_custkey % 9 AS year, c_acctbal FROM customer)
  SELECT c_custkey, factor, round(factor * c_acctbal, 4) AS prediction FROM c LEFT JOIN factors f ON f.region = c.nation
    AND f.sector = c.sector AND f.year = least(c.year, 2000)""")
def join_factor_lookup(spark, sf):
    from emipanel.operators.forecasts import factor_prediction
    k = F.col("c_custkey")
    c = t(spark, sf, "customer").select(k, F.col("c_nationkey").cast("long").alias("nation"), pick(k, _TYPES).alias("kind"),
                                        (k % 9 + 1996).alias("yr"), "c_acctbal")
    out = E.factor_join(c, _factors(spark, sf), "nation", "kind", "yr", 2000, "factor")
    return out.select("c_custkey", "factor", r(factor_prediction("factor", "c_acctbal")).alias("prediction"))


@query("join_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def join_semi(spark, sf):
    o = t(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return E.semi(t(spark, sf, "customer").select("c_custkey"), o, ["c_custkey"])


@query("join_anti", """SELECT c_custkey FROM customer WHERE c_custkey NOT IN
  (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""")
def join_anti(spark, sf):
    o = t(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return E.anti(t(spark, sf, "customer").select("c_custkey"), o, ["c_custkey"])


_GAPS = f"""{S.PANEL}, gaps AS (SELECT building_id, year, CASE WHEN (building_id + year) % 3 <> 0 THEN target END AS latitude,
  CASE WHEN (building_id + year) % 4 <> 0 THEN area + year END AS longitude, 'file' AS src FROM panel),
  known AS (SELECT building_id, latitude AS lat, longitude AS lon FROM (SELECT *, row_number() OVER (PARTITION BY building_id
    ORDER BY year) AS rn FROM gaps WHERE latitude IS NOT NULL AND longitude IS NOT NULL) WHERE rn = 1)"""


def _gaps(spark, sf):
    k = F.col("building_id") + F.col("year")
    return S.panel(spark, sf).select("building_id", "year", F.when(k % 3 != 0, F.col("target")).alias("latitude"),
                                     F.when(k % 4 != 0, F.col("area") + F.col("year")).alias("longitude"),
                                     F.lit("file").alias("src"))


_FILLED = "CASE WHEN (latitude IS NULL OR longitude IS NULL) AND lat IS NOT NULL THEN 'history_backfill' ELSE src END AS src"


@query("join_backfill_each", f"""WITH {_GAPS} SELECT building_id, year, coalesce(latitude, lat) AS latitude,
  coalesce(longitude, lon) AS longitude, {_FILLED} FROM gaps LEFT JOIN known USING (building_id)""")
def join_backfill_each(spark, sf):
    return E.backfill_from_history(_gaps(spark, sf), "building_id", ["latitude", "longitude"], ["year"], "src")


@query("join_backfill_together", f"""WITH {_GAPS} SELECT building_id, year,
  CASE WHEN latitude IS NULL OR longitude IS NULL THEN lat ELSE latitude END AS latitude,
  CASE WHEN latitude IS NULL OR longitude IS NULL THEN lon ELSE longitude END AS longitude, {_FILLED}
  FROM gaps LEFT JOIN known USING (building_id)""")
def join_backfill_together(spark, sf):
    return E.backfill_from_history(_gaps(spark, sf), "building_id", ["latitude", "longitude"], ["year"], "src", together=True)


@query("join_coordinates_with_provenance", f"""WITH {S.LOCATED}, main AS (SELECT city, building_id,
    CASE WHEN building_id % 5 <> 0 THEN latitude END AS latitude, CASE WHEN building_id % 5 <> 0 THEN longitude END AS longitude,
    CASE WHEN building_id % 7 = 0 THEN 'history_backfill' WHEN building_id % 7 = 1 THEN '' END AS coord_source FROM located),
  side AS (SELECT city, building_id, latitude AS lat, longitude AS lon FROM located JOIN centres USING (city)
    WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND abs(latitude - centre_lat) <= 2 AND abs(longitude - centre_lon) <= 2),
  lab AS (SELECT *, coalesce(nullif(trim(coord_source), ''), CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL
    THEN 'city_disclosure' ELSE 'missing' END) AS cs FROM main)
  SELECT city, building_id, CASE WHEN latitude IS NULL AND lat IS NOT NULL THEN lat ELSE latitude END AS latitude,
    CASE WHEN latitude IS NULL AND lat IS NOT NULL THEN lon ELSE longitude END AS longitude,
    CASE WHEN latitude IS NULL AND lat IS NOT NULL THEN 'geocoded_address' ELSE cs END AS coord_source
  FROM lab LEFT JOIN side USING (city, building_id)""")
def join_coordinates_with_provenance(spark, sf):
    x, k = S.located(spark, sf), F.col("building_id")
    main = x.select("city", "building_id", F.when(k % 5 != 0, F.col("latitude")).alias("latitude"),
                    F.when(k % 5 != 0, F.col("longitude")).alias("longitude"),
                    F.when(k % 7 == 0, "history_backfill").when(k % 7 == 1, "").alias("coord_source"))
    side = x.select("city", "building_id", "latitude", "longitude")
    return E.merge_with_provenance(main, side, ["city", "building_id"], [F.col("latitude")], F.broadcast(dims.centres(spark)))


@query("join_row_guard", "SELECT o_orderkey, c_mktsegment AS segment FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def join_row_guard(spark, sf):
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    return E.left_join_preserving(t(spark, sf, "orders"), c, ["o_custkey"]).select("o_orderkey", "segment")


@query("join_fan_out", """SELECT o_orderkey, CAST(length(o_orderpriority) AS BIGINT) AS cost FROM orders""")
def join_fan_out(spark, sf):
    return E.fan_out(t(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority",
                     lambda keys: keys.withColumn("cost", F.length("o_orderpriority").cast("long"))).select("o_orderkey", "cost")


@query("join_attach_target", f"""WITH {S.PANEL} SELECT building_id, year, target, price FROM panel JOIN
  (SELECT o_custkey, CAST(year(o_orderdate) AS BIGINT) AS y, o_totalprice AS price, row_number() OVER (PARTITION BY o_custkey,
    year(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS rn FROM orders WHERE o_orderstatus = 'F') o
  ON o_custkey = building_id AND y = year AND rn = 1""")
def join_attach_target(spark, sf):
    o = t(spark, sf, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("building_id"), F.year("o_orderdate").cast("long").alias("year"),
        F.col("o_totalprice").alias("price"), "o_orderdate", "o_orderkey")
    p = S.panel(spark, sf).select("building_id", "year", "target")
    return E.attach_target(p, o, ["building_id", "year"], "price", ["o_orderdate", "o_orderkey"])


@query("join_entity_dimension", """SELECT o_custkey, o_orderpriority AS priority, o_orderstatus AS status FROM (SELECT *, row_number()
  OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def join_entity_dimension(spark, sf):
    o = t(spark, sf, "orders").select("o_custkey", F.col("o_orderpriority").alias("priority"),
                                      F.col("o_orderstatus").alias("status"), "o_orderdate", "o_orderkey")
    return E.entity_dim(o, "o_custkey", ["priority", "status"], ["o_orderdate", "o_orderkey"])


@query("join_relabel", f"""WITH {S.PANEL} SELECT building_id, year, CASE WHEN c_acctbal > 5000 THEN 'metro_' || c_nationkey
  ELSE city END AS city FROM panel JOIN customer ON c_custkey = building_id""")
def join_relabel(spark, sf):
    m = t(spark, sf, "customer").where("c_acctbal > 5000").select(
        F.col("c_custkey").alias("building_id"), F.concat(F.lit("metro_"), F.col("c_nationkey")).alias("metro"))
    return E.relabel(S.panel(spark, sf).select("building_id", "year", "city"), m, "building_id", "city", "metro")


@query("join_aligned_predictions", f"""WITH {S.PANEL} SELECT building_id, year, round(log10(target), 8) AS y_log,
  CASE WHEN c_acctbal > 0 THEN round(log10(c_acctbal), 8) END AS pred_log FROM panel LEFT JOIN
  (SELECT * FROM customer WHERE c_mktsegment <> 'MACHINERY') ON c_custkey = building_id""")
def join_aligned_predictions(spark, sf):
    preds = t(spark, sf, "customer").where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("building_id"),
                                                                       F.col("c_acctbal").alias("pred"))
    out = E.align_predictions(S.panel(spark, sf), preds, ["building_id"], "pred")
    return out.select("building_id", "year", r(log10_pos("target"), 8).alias("y_log"), r("pred_log", 8).alias("pred_log"))


@query("join_fuzzy_names", """WITH l AS (SELECT DISTINCT p_name AS ln, list_sort(list_distinct(string_split(lower(p_name), ' '))) AS ls FROM part),
  r AS (SELECT DISTINCT lower(p_type) || ' ' || p_name AS rn FROM part WHERE length(p_brand) <= 8),
  rs AS (SELECT rn, list_sort(list_distinct(string_split(rn, ' '))) AS rs FROM r),
  p AS (SELECT ln, rn, len(array_to_string(ls, ' ')) AS lm, len(array_to_string(rs, ' ')) AS rm, len(array_to_string(list_intersect(ls, rs), ' ')) AS s FROM l, rs),
  s AS (SELECT ln, rn, 200.0::DOUBLE * s / (s + least(lm, rm)) AS score FROM p WHERE s > 0),
  b AS (SELECT * FROM s WHERE score >= 60 QUALIFY row_number() OVER (PARTITION BY ln ORDER BY score DESC, rn) = 1)
  SELECT p_partkey, rn AS matched_name, round(score, 4) AS score FROM part LEFT JOIN b ON ln = p_name""")
def join_fuzzy_names(spark, sf):
    part = t(spark, sf, "part")
    right = part.select(F.concat_ws(" ", F.lower("p_type"), "p_name").alias("name"), F.col("p_brand").alias("symbol"))
    return E.fuzzy_match(part.select("p_partkey", "p_name"), right, "p_name", "name", 60, "symbol", 8).select(
        "p_partkey", "matched_name", r("score").alias("score"))


# ---------------------------------------------------------------- duplicates

@query("dedup_distinct", "SELECT DISTINCT p_brand, p_type, CAST(p_size AS BIGINT) AS size FROM part")
def dedup_distinct(spark, sf):
    return U.distinct(t(spark, sf, "part").select("p_brand", "p_type", F.col("p_size").cast("long").alias("size")))


def _orders(spark, sf):
    return t(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").cast("long").alias("year"), "o_orderkey",
                                         "o_orderdate", "o_totalprice", "o_orderpriority", "o_orderstatus")


_RN = """SELECT o_custkey, year, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, year
  ORDER BY {}) AS rn FROM (SELECT *, CAST(year(o_orderdate) AS BIGINT) AS year FROM orders)) WHERE rn = 1"""


@query("dedup_keep_first", _RN.format("o_orderdate, o_orderkey"))
def dedup_keep_first(spark, sf):
    return U.keep_first(_orders(spark, sf), ["o_custkey", "year"], ["o_orderdate", "o_orderkey"]).select(
        "o_custkey", "year", "o_orderkey", "o_totalprice")


@query("dedup_keep_last", _RN.format("o_orderdate DESC, o_orderkey DESC"))
def dedup_keep_last(spark, sf):
    return U.keep_last(_orders(spark, sf), ["o_custkey", "year"], ["o_orderdate", "o_orderkey"]).select(
        "o_custkey", "year", "o_orderkey", "o_totalprice")


@query("dedup_latest", """SELECT o_custkey, year, o_orderkey FROM (SELECT *, CAST(year(o_orderdate) AS BIGINT) AS year, row_number() OVER
  (PARTITION BY o_custkey ORDER BY year(o_orderdate) DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def dedup_latest(spark, sf):
    return U.latest(_orders(spark, sf), "o_custkey", "year", ["o_orderkey"]).select("o_custkey", "year", "o_orderkey")


_ST = ["ok", "no_images", "err:429 Too Many Requests", "x"]
_SR = ["building_patch", "city_patch", "building_patch"]


@query("dedup_ranked", f"""WITH e AS (SELECT event_id, user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
    {sql_pick('event_id', _ST)} AS status, {sql_pick('event_id', _SR)} AS img_source,
    CASE WHEN event_id % 3 <> 0 THEN event_id % 7 END AS n_images FROM events),
  k AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY CASE status WHEN 'ok' THEN 4 WHEN 'no_images' THEN 3
    WHEN 'x' THEN 0 ELSE 2 END DESC, CASE img_source WHEN 'building_patch' THEN 1 ELSE 0 END DESC, coalesce(n_images, -1) DESC, event_id)
    AS rn FROM e)
  SELECT user_id, day, event_id, status, row_number() OVER (ORDER BY user_id, day) - 1 AS row_id FROM k WHERE rn = 1""")
def dedup_ranked(spark, sf):
    k = F.col("event_id")
    e = t(spark, sf, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), k, pick(k, _ST).alias("status"),
                                      pick(k, _SR).alias("img_source"), F.when(k % 3 != 0, k % 7).alias("n_images"))
    out = U.ranked_dedup(e, ["user_id", "day"], U.embedding_ranks(), "event_id", "row_id")
    return out.select("user_id", "day", "event_id", "status", "row_id")


_MODES = """o AS (SELECT o_custkey, CAST(year(o_orderdate) AS BIGINT) AS year, o_totalprice, o_orderpriority, o_orderstatus
    FROM orders),
  m AS (SELECT o_custkey, year, median(o_totalprice) AS price FROM o GROUP BY 1, 2),
  p AS (SELECT o_custkey, year, o_orderpriority AS priority FROM (SELECT o_custkey, year, o_orderpriority, row_number() OVER
    (PARTITION BY o_custkey, year ORDER BY count(*) DESC, o_orderpriority) AS rn FROM o GROUP BY 1, 2, 3) WHERE rn = 1),
  s AS (SELECT o_custkey, year, o_orderstatus AS status FROM (SELECT o_custkey, year, o_orderstatus, row_number() OVER
    (PARTITION BY o_custkey, year ORDER BY count(*) DESC, o_orderstatus) AS rn FROM o GROUP BY 1, 2, 3) WHERE rn = 1)"""


@query("dedup_collapse", f"""WITH {_MODES} SELECT o_custkey, year, round(price, 4) AS price, priority, status FROM m
  JOIN p USING (o_custkey, year) JOIN s USING (o_custkey, year)""")
def dedup_collapse(spark, sf):
    o = _orders(spark, sf).select("o_custkey", "year", F.col("o_totalprice").alias("price"),
                                  F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    return U.collapse_duplicates(o, ["o_custkey", "year"]).withColumn("price", r("price"))


@query("dedup_collapse_hot_keys", """WITH o AS (SELECT o_orderstatus, o_totalprice, o_orderpriority FROM orders)
  SELECT o_orderstatus AS status, round(median(o_totalprice), 4) AS price,
    (SELECT o_orderpriority FROM o i WHERE i.o_orderstatus = o.o_orderstatus GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    AS priority FROM o GROUP BY 1""")
def dedup_collapse_hot_keys(spark, sf):
    """Three keys hold all rows."""
    o = t(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"),
                                      F.col("o_orderpriority").alias("priority"))
    return U.collapse_duplicates(o, ["status"]).withColumn("price", r("price"))


@query("dedup_collapse_report", """SELECT count(*) AS rows_before, count(DISTINCT (o_custkey, year(o_orderdate))) AS rows_after,
  count(*) - count(DISTINCT (o_custkey, year(o_orderdate))) AS rows_collapsed FROM orders""")
def dedup_collapse_report(spark, sf):
    return U.collapse_report(_orders(spark, sf), ["o_custkey", "year"])


@query("dedup_offenders", """SELECT o_custkey, CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS n_rows FROM orders GROUP BY 1, 2
  HAVING count(*) > 1 ORDER BY 3 DESC, 1, 2 LIMIT 10""")
def dedup_offenders(spark, sf):
    return U.duplicate_sample(_orders(spark, sf), ["o_custkey", "year"])


@query("dedup_count", """SELECT o_orderstatus, count(*) - count(DISTINCT (o_custkey, year(o_orderdate))) AS duplicate_rows
  FROM orders GROUP BY 1""")
def dedup_count(spark, sf):
    return U.count_duplicates(_orders(spark, sf), ["o_custkey", "year"], ["o_orderstatus"])


@query("dedup_representative", """SELECT c.o_custkey, coalesce(a.o_orderpriority, '') AS o_orderpriority,
  coalesce(b.st, '') AS st FROM (SELECT DISTINCT o_custkey FROM orders) c LEFT JOIN (SELECT o_custkey, o_orderpriority FROM
  (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS rn
   FROM orders GROUP BY 1, 2) WHERE rn = 1) a USING (o_custkey) LEFT JOIN (SELECT o_custkey, o_orderstatus AS st FROM
  (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderstatus) AS rn
   FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2) WHERE rn = 1) b USING (o_custkey)""")
def dedup_representative(spark, sf):
    o = t(spark, sf, "orders").withColumn("st", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    return U.representative(o, "o_custkey", ["o_orderpriority", "st"])
