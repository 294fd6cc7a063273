"""Scans and sinks."""

from pyspark.sql import functions as F

from emipanel import dims
from emipanel.functions import to_numeric_safe
from emipanel.operators.filters import outlier_rules
from emipanel.operators.reshape import merge_results, union_all
from emipanel.schema import conform
from emipanel.session import scratch_dir
from emipanel.sources import readers, sinks
from workload import stage as S
from workload.registry import query
from workload.stage import pick, r, t

_ORDERS_BY_YEAR = """SELECT CAST(year(o_orderdate) AS BIGINT) AS file_year, count(*) AS n,
  round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1"""


@query("scan_csv_text", """SELECT p_type, count(*) AS n, round(sum(p_retailprice), 2) AS total,
  CAST(max(p_size) AS DOUBLE) AS max_size FROM part GROUP BY 1""")
def scan_csv_text(spark, sf):
    path = scratch_dir(spark, "csv")
    sinks.write_table(t(spark, sf, "part"), path, fmt="csv")
    raw = readers.read_csv(spark, path)
    return raw.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"),
                                     r(F.sum(to_numeric_safe("p_retailprice")), 2).alias("total"),
                                     F.max(to_numeric_safe("p_size")).alias("max_size"))


@query("scan_csv_latin1", "SELECT doc_id, 'Café ' || source AS label FROM documents")
def scan_csv_latin1(spark, sf):
    path = scratch_dir(spark, "latin1")
    src = t(spark, sf, "documents").select("doc_id", F.concat(F.lit("Café "), F.col("source")).alias("label"))
    src.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return readers.read_latin1(spark, path).select(F.col("doc_id").cast("long").alias("doc_id"), "label")


@query("scan_yearly_files", _ORDERS_BY_YEAR)
def scan_yearly_files(spark, sf):
    path = scratch_dir(spark, "yearly")
    o = t(spark, sf, "orders").withColumn("part", F.concat(F.lit("cy"), F.year("o_orderdate")))
    o.write.partitionBy("part").option("header", True).csv(path)
    raw = readers.read_yearly_files(spark, f"{path}/*", r"cy([0-9]{4})")
    return raw.groupBy("file_year").agg(F.count(F.lit(1)).alias("n"),
                                        r(F.sum(to_numeric_safe("o_totalprice")), 2).alias("total"))


_RULES = {
    "building": ["property id", (["order", "key"], [])],
    "total": [(["total", "ghg"], ["weather"]), (["price"], [])],
    "priority": [(["priority"], [])],
    "absent": [(["no such"], [])],
}


@query("scan_resolved_columns", """SELECT o_orderkey AS building, round(o_totalprice, 2) AS total,
  o_orderpriority AS priority, CAST(NULL AS VARCHAR) AS absent FROM orders""")
def scan_resolved_columns(spark, sf):
    raw = t(spark, sf, "orders").select(
        F.col("o_orderkey").alias(" Property Id "), F.col("o_custkey").alias("Customer\nKey"),
        F.lit("decoy").alias("Weather Normalized Total GHG"), F.col("o_totalprice").alias("Total GHG\n(Metric Tons)"),
        F.col("o_orderpriority").alias("Order Priority"))
    out = readers.select_resolved(readers.clean_headers(raw), _RULES)
    return out.withColumn("total", r("total", 2))


@query("scan_pruned_columns", """SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price
  FROM orders WHERE o_totalprice > 100000 GROUP BY 1""")
def scan_pruned_columns(spark, sf):
    df = readers.read_cols(spark, f"{sf}/orders.parquet", ["o_orderstatus", "o_totalprice"])
    return df.where(F.col("o_totalprice") > 100000).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("o_totalprice")).alias("mean_price"))


@query("scan_json_map", """SELECT event_type, 'k' AS key, count(*) AS n,
  CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1, 2""")
def scan_json_map(spark, sf):
    rows = readers.explode_map(t(spark, sf, "events"), "props", "bigint", keep=["event_type"])
    return rows.groupBy("event_type", "key").agg(F.count("value").alias("n"), F.sum("value").alias("total"))


@query("scan_json_cache", """SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS ticker,
  CASE WHEN s_acctbal > 0 THEN s_acctbal END AS revenue_usd FROM supplier""")
def scan_json_cache(spark, sf):
    path = scratch_dir(spark, "cache")
    rec = F.struct(F.col("s_name").alias("ticker"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal"))
                   .alias("revenue_usd"))
    doc = F.to_json(F.create_map(F.col("s_suppkey").cast("string"), rec))
    t(spark, sf, "supplier").select(doc.alias("value")).write.text(path)
    lines = spark.read.text(path)
    return (readers.explode_map(lines, "value", "struct<ticker:string,revenue_usd:double>", "id", "record")
            .select("id", "record.*"))


@query("scan_json_panel", f"""SELECT o_custkey AS id, CAST(year(o_orderdate) AS BIGINT) AS year,
  round(round(sum(o_totalprice), 2) * {S.SCALE}::DOUBLE, 4) AS revenue_usd, count(*) AS n_orders FROM orders GROUP BY 1, 2""")
def scan_json_panel(spark, sf):
    per_year = S.panel(spark, sf).select(F.col("building_id").alias("id"), "year", "target", "n_orders")
    entry = F.struct(F.col("year").cast("string"),
                     F.struct(F.col("target").alias("revenue_usd"), F.col("n_orders")))
    doc = per_year.groupBy("id").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("doc"))
    parsed = doc.withColumn("panel", F.from_json("doc", "map<string,struct<revenue_usd:double,n_orders:bigint>>"))
    return readers.explode_panel(parsed, "id").withColumn("revenue_usd", r("revenue_usd"))


@query("scan_json_summary", """SELECT c_custkey AS ticker, c_mktsegment AS summary FROM customer
  WHERE c_acctbal >= 0""")
def scan_json_summary(spark, sf):
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("ticker"),
                                        F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("summary"))
    return readers.explode_summary(c, "ticker")


@query("scan_statement_panel", """SELECT o_custkey, CAST(year(o_orderdate) AS BIGINT) AS year,
  arg_max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END,
          CASE WHEN o_orderstatus = 'F' THEN {'a': o_orderdate, 'b': o_totalprice} END) AS revenue_usd,
  arg_max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END,
          CASE WHEN o_orderstatus = 'O' THEN {'a': o_orderdate, 'b': o_totalprice} END) AS ebitda_usd
  FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2""")
def scan_statement_panel(spark, sf):
    return readers.statement_to_panel(t(spark, sf, "orders"), ["o_custkey"], "o_orderstatus", "o_orderdate",
                                      "o_totalprice", {"F": "revenue_usd", "O": "ebitda_usd"})


@query("scan_climate_payload", f"""WITH {S.DAILY}
  SELECT grid, 'T2M' AS variable, CAST(day AS VARCHAR) AS day, round(temp, 4) AS value FROM daily
  UNION ALL SELECT grid, 'RH2M', CAST(day AS VARCHAR), round(humidity, 4) FROM daily""")
def scan_climate_payload(spark, sf):
    day = F.date_format("day", "yyyyMMdd")
    g = S.daily(spark, sf).groupBy("grid").agg(
        F.map_from_entries(F.collect_list(F.struct(day, F.col("temp")))).alias("T2M"),
        F.map_from_entries(F.collect_list(F.struct(day, F.col("humidity")))).alias("RH2M"))
    doc = F.to_json(F.struct(F.struct(F.create_map(F.lit("T2M"), "T2M", F.lit("RH2M"), "RH2M")
                                      .alias("parameter")).alias("properties")))
    rows = readers.explode_daily(g.select("grid", doc.alias("doc")), "doc", keep=["grid"])
    return rows.select("grid", "variable", F.col("day").cast("string").alias("day"), r("value").alias("value"))


@query("scan_shards", """SELECT event_type AS shard, count(*) AS n, round(sum(value), 2) AS total
  FROM events GROUP BY 1""")
def scan_shards(spark, sf):
    path = scratch_dir(spark, "shards")
    t(spark, sf, "events").withColumn("kind", F.col("event_type")).write.partitionBy("kind").parquet(path)
    return readers.read_shards(spark, path, r"kind=([^/]+)/").groupBy("shard").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("value"), 2).alias("total"))


@query("scan_selected_shards", """SELECT event_type AS shard, user_id % 4 AS city, count(*) AS n FROM events
  WHERE event_type = 'click' OR (event_type = 'view' AND user_id % 4 IN (1, 2))
     OR (event_type = 'error' AND user_id % 4 <> 3) GROUP BY 1, 2""")
def scan_selected_shards(spark, sf):
    ev = t(spark, sf, "events").select(F.col("event_type").alias("shard"), F.pmod("user_id", F.lit(4)).alias("city"))
    specs = spark.createDataFrame([("click", None, None), ("view", [1, 2], None), ("error", None, [3])],
                                  "shard string, include array<bigint>, exclude array<bigint>")
    return readers.select_shards(ev, specs).groupBy("shard", "city").agg(F.count(F.lit(1)).alias("n"))


@query("scan_gathered_embeddings", """SELECT doc_id AS row_id, CAST(quality AS BIGINT) AS quality,
  CAST(len(embedding) AS BIGINT) AS dims, round(CAST(embedding[1] AS DOUBLE), 6) AS first_value
  FROM labels JOIN embeddings ON vec_id = doc_id""")
def scan_gathered_embeddings(spark, sf):
    meta = t(spark, sf, "labels").select(F.col("doc_id").alias("row_id"), F.col("quality").cast("long").alias("quality"))
    emb = t(spark, sf, "embeddings").withColumnRenamed("vec_id", "row_id")
    g = readers.gather_embeddings(meta, emb)
    return g.select("row_id", "quality", F.size("embedding").cast("long").alias("dims"),
                    r(F.element_at("embedding", 1).cast("double"), 6).alias("first_value"))


_GRID_CITIES = list(dims.GRID_BASE)


@query("dim_grid_trend", f"""WITH base AS (
    SELECT c_nationkey, {S.sql_pick('c_nationkey', _GRID_CITIES)} AS city,
           round(avg(c_acctbal), 2) / 20000.0::DOUBLE AS base
    FROM customer GROUP BY 1, 2),
  y AS (SELECT unnest(range(2010, 2025)) AS year)
  SELECT CAST(c_nationkey AS BIGINT) AS nation, city, CAST(year AS BIGINT) AS year,
    round(greatest(0.01::DOUBLE, base * (1 + (CASE WHEN city = 'melbourne' THEN -0.03 WHEN city = 'singapore' THEN -0.01
      WHEN city IN ('seattle', 'portland') THEN -0.005 WHEN city IN ('sf', 'la') THEN -0.02
      WHEN city IN ('chicago', 'denver') THEN -0.015 ELSE -0.012 END)::DOUBLE * (year - 2020))), 4) AS grid_co2e_per_mwh
  FROM base, y""")
def dim_grid_trend(spark, sf):
    base = t(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("long").alias("nation")).agg(
        (F.round(F.avg("c_acctbal"), 2) / 20000.0).alias("base")).withColumn("city", pick(F.col("nation"), _GRID_CITIES))
    out = dims.expand_trend(base, range(2010, 2025), keep=["nation"])
    return out.withColumn("year", F.col("year").cast("long"))


@query("load_results_by_suffix", """SELECT fmt, count(*) AS n, round(sum(s_acctbal), 2) AS total
  FROM supplier, (VALUES ('csv'), ('json'), ('parquet')) f(fmt) GROUP BY 1""")
def load_results_by_suffix(spark, sf):
    base = scratch_dir(spark, "results")
    out = []
    for fmt in ("csv", "json", "parquet"):
        sinks.save_results(t(spark, sf, "supplier"), f"{base}/out.{fmt}", fmt)
        loaded = readers.load_results(spark, f"{base}/out.{fmt}")
        out.append(loaded.select(F.lit(fmt).alias("fmt"), F.col("s_acctbal").cast("double").alias("v")))
    return union_all(*out).groupBy("fmt").agg(F.count(F.lit(1)).alias("n"), r(F.sum("v"), 2).alias("total"))


@query("sink_overwrite", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def sink_overwrite(spark, sf):
    path = scratch_dir(spark, "table")
    o = t(spark, sf, "orders").withColumn("status", F.col("o_orderstatus"))
    sinks.write_table(o, path, ["status"])
    sinks.write_table(o, path, ["status"])
    return spark.read.parquet(path).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("sink_upsert", f"""WITH {S.PANEL}, both_rows AS (
    SELECT building_id, target, year, 0 AS gen FROM panel WHERE year <= 1998
    UNION ALL SELECT building_id, target, year, 1 FROM panel WHERE year >= 1998)
  SELECT building_id, target, year FROM (SELECT *, row_number() OVER (PARTITION BY building_id
    ORDER BY gen DESC, year DESC) AS rn FROM both_rows) WHERE rn = 1""")
def sink_upsert(spark, sf):
    p = S.panel(spark, sf).select("building_id", "target", "year")
    return sinks.upsert_keep_last(p.where("year <= 1998"), p.where("year >= 1998"), ["building_id"], [-F.col("year")])


@query("sink_append", """SELECT s_nationkey AS seed, 2 * count(*) AS n FROM (SELECT CAST(s_nationkey AS BIGINT)
  AS s_nationkey FROM supplier) GROUP BY 1""")
def sink_append(spark, sf):
    path = scratch_dir(spark, "log")
    rows = t(spark, sf, "supplier").select(F.col("s_nationkey").cast("long").alias("seed"), "s_acctbal")
    sinks.append_results(rows, path)
    sinks.append_results(rows, path)
    return spark.read.parquet(path).groupBy("seed").agg(F.count(F.lit(1)).alias("n"))


@query("sink_audit", f"""WITH {S.PANEL}
  SELECT building_id, year, target, CASE WHEN target > 900000 THEN 'too_high' WHEN target = 0 THEN 'zero'
    WHEN target > 0 AND target < 50000 THEN 'too_low' ELSE 'kept' END AS outlier_reason FROM panel""")
def sink_audit(spark, sf):
    kept, audit = sinks.split_with_audit(S.panel(spark, sf).select("building_id", "year", "target"),
                                         outlier_rules("target", 50000.0, 900000.0))
    return kept.withColumn("outlier_reason", F.lit("kept")).unionByName(audit)


@query("sink_audit_observed", f"""WITH {S.PANEL}, x AS (SELECT CASE WHEN target > 900000 THEN 'too_high' WHEN target = 0 THEN 'zero'
    WHEN target > 0 AND target < 50000 THEN 'too_low' ELSE 'kept' END AS outlier_reason FROM panel)
  SELECT outlier_reason, count(*) AS n_written, count(*) AS n_observed, (SELECT count(*) FROM x) AS n_all FROM x GROUP BY 1""")
def sink_audit_observed(spark, sf):
    """Rows written by reason, beside what was observed while they were written."""
    path = scratch_dir(spark, "audited")
    seen = sinks.write_with_audit(S.panel(spark, sf).select("building_id", "year", "target"), outlier_rules("target", 50000.0, 900000.0), path)
    observed = F.create_map(*[v for name, n in seen.items() for v in (F.lit(name), F.lit(n).cast("long"))])
    return (spark.read.parquet(path).groupBy("outlier_reason").agg(F.count(F.lit(1)).alias("n_written"))
            .select("outlier_reason", "n_written", F.try_element_at(observed, F.col("outlier_reason")).alias("n_observed"), F.lit(seen["all"]).cast("long").alias("n_all")))


@query("sink_replace_groups", f"""WITH {S.PANEL},
  repl AS (SELECT city, building_id, year, -target AS target FROM panel WHERE region = 1 AND year >= 1999)
  SELECT city, building_id, year, target FROM panel WHERE city NOT IN (SELECT city FROM repl)
  UNION ALL SELECT * FROM repl""")
def sink_replace_groups(spark, sf):
    p = S.panel(spark, sf)
    base = p.select("city", "building_id", "year", "target")
    repl = p.where("region = 1 and year >= 1999").select("city", "building_id", "year", (-F.col("target")).alias("target"))
    return sinks.replace_partitions(base, repl, "city", ["city", "building_id", "year"])


@query("sink_overwrite_partitions", f"""WITH {S.PANEL}
  SELECT city, count(*) AS n, round(sum(CASE WHEN region = 1 THEN 0 ELSE target END), 1) AS total
  FROM panel GROUP BY 1""")
def sink_overwrite_partitions(spark, sf):
    path = scratch_dir(spark, "parts")
    p = S.panel(spark, sf).select("building_id", "region", "target", "city")
    sinks.write_table(p, path, ["city"])
    sinks.overwrite_partitions(p.where("region = 1").withColumn("target", F.lit(0.0)), path, "city")
    return spark.read.parquet(path).groupBy("city").agg(F.count(F.lit(1)).alias("n"), r(F.sum("target"), 1).alias("total"))


_STATUS = ["ok", "no_images", "err:Too Many Requests", "err:Internal Error", "other"]


@query("sink_manifest", f"""WITH {S.PANEL}, s AS (SELECT *, {S.sql_pick('building_id', _STATUS)} AS status FROM panel),
  a AS (SELECT * FROM s WHERE year >= 1997)
  SELECT region, (SELECT count(*) FROM s WHERE s.region = a.region) AS rows_before, count(*) AS rows_after,
    (SELECT count(*) FROM s WHERE s.region = a.region) - count(*) AS rows_removed,
    count(*) FILTER (WHERE status = 'ok') AS rows_ok, min(year) AS year_min, max(year) AS year_max,
    string_agg(DISTINCT city, ',' ORDER BY city) AS cities FROM a GROUP BY region""")
def sink_manifest(spark, sf):
    p = S.panel(spark, sf).withColumn("status", pick(F.col("building_id"), _STATUS))
    return sinks.manifest(p.where("year >= 1997"), p, ["region"])


@query("sink_save_results", """SELECT p_partkey, CASE WHEN p_size = 1 THEN NULL
  ELSE round(p_retailprice / (p_size - 1), 4) END AS value FROM part""")
def sink_save_results(spark, sf):
    path = scratch_dir(spark, "saved")
    bad = F.when(F.col("p_size") == 1, F.lit(float("inf"))).otherwise(
        F.try_divide(F.col("p_retailprice"), F.col("p_size") - 1))
    sinks.save_results(t(spark, sf, "part").select("p_partkey", r(bad).alias("value")), path, "json")
    return spark.read.schema("p_partkey bigint, value double").json(path)


@query("reshape_conform", """SELECT CAST(c_custkey AS VARCHAR) AS building_id, c_mktsegment AS property_type,
  c_acctbal AS latitude, CAST(NULL AS DOUBLE) AS longitude FROM customer""")
def reshape_conform(spark, sf):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("building_id", T.StringType()), T.StructField("property_type", T.StringType()),
                           T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType())])
    src = t(spark, sf, "customer").select(F.col("c_custkey").alias("building_id"),
                                          F.col("c_mktsegment").alias("property_type"),
                                          F.col("c_acctbal").alias("latitude"), F.lit(1).alias("extra"))
    return conform(src, schema)


@query("reshape_union", """SELECT 'customer' AS source, c_custkey AS id, c_acctbal AS balance,
  c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS brand FROM customer
  UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL, NULL FROM supplier
  UNION ALL SELECT 'part', p_partkey, NULL, NULL, p_brand FROM part""")
def reshape_union(spark, sf):
    return union_all(
        t(spark, sf, "customer").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("id"),
                                        F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")),
        t(spark, sf, "supplier").select(F.lit("supplier").alias("source"), F.col("s_suppkey").alias("id"),
                                        F.col("s_acctbal").alias("balance")),
        t(spark, sf, "part").select(F.lit("part").alias("source"), F.col("p_partkey").alias("id"),
                                    F.col("p_brand").alias("brand")))


@query("reshape_merge_results", """SELECT feature_set, count(*) AS n FROM (
  SELECT 'wide' AS feature_set FROM supplier UNION ALL SELECT 'strict' FROM customer) GROUP BY 1""")
def reshape_merge_results(spark, sf):
    base = scratch_dir(spark, "merge")
    sinks.save_results(t(spark, sf, "supplier").select(F.lit("wide").alias("feature_set"), "s_acctbal"),
                       f"{base}/a.parquet")
    sinks.save_results(t(spark, sf, "customer").select(F.lit("strict").alias("feature_set"), "c_acctbal"),
                       f"{base}/b.parquet")
    return merge_results(spark, [f"{base}/a.parquet", f"{base}/b.parquet"]).groupBy("feature_set").agg(
        F.count(F.lit(1)).alias("n"))
