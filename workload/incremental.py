"""Resumable work and file streams."""

from pyspark.sql import functions as F

from emipanel.functions import is_retryable  # noqa: F401
from emipanel.session import scratch_dir
from emipanel.streaming import incremental as O
from workload import stage as S
from workload.registry import query
from workload.stage import pick, r, sql_pick, t

_STATUS = ["ok", "err:Timeout", "http_503", "ok", "no_match"]


def _log(spark, sf):
    k = F.col("event_id")
    return t(spark, sf, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), pick(k, _STATUS).alias("status"))


_LOG = f"log AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, {sql_pick('event_id', _STATUS)} AS status FROM events)"


@query("incr_pending", f"""WITH {_LOG} SELECT DISTINCT user_id, day FROM log WHERE (user_id, day) NOT IN
  (SELECT (user_id, day) FROM log WHERE status = 'no_match')""")
def incr_pending(spark, sf):
    log = _log(spark, sf)
    plan = log.select("user_id", "day").distinct()
    return O.pending(plan, log.where("status = 'no_match'"), ["user_id", "day"])


@query("incr_retry_failed", f"""WITH {_LOG} SELECT DISTINCT user_id, day FROM log WHERE (user_id, day) NOT IN
  (SELECT (user_id, day) FROM log WHERE status = 'ok')""")
def incr_retry_failed(spark, sf):
    log = _log(spark, sf)
    return O.pending(log.select("user_id", "day").distinct(), O.done_ok(log), ["user_id", "day"])


def _landing(spark, sf):
    path = scratch_dir(spark, "landing")
    ev = t(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    ev.repartition(4, "event_id").sortWithinPartitions("event_id").write.parquet(path)
    return path, ev.schema


@query("incr_ingest", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def incr_ingest(spark, sf):
    path, schema = _landing(spark, sf)
    ckpt, sink = scratch_dir(spark, "offsets"), scratch_dir(spark, "bronze")
    O.ingest_incremental(spark, path, schema, ckpt, sink, files_per_batch=2)
    # a second run finds nothing new, so no row is taken twice
    df = O.ingest_incremental(spark, path, schema, ckpt, sink, files_per_batch=2)
    return df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r(F.sum("value"), 2).alias("total"))


@query("incr_upsert", """SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2""")
def incr_upsert(spark, sf):
    """Four increments in id order, landed one after another; most keys meet again, and the largest id wins."""
    path, offsets, silver = (scratch_dir(spark, n) for n in ("increments", "offsets", "silver"))
    ev = t(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    lo, hi = ev.agg(F.min("event_id"), F.max("event_id")).first()
    part = F.floor((F.col("event_id") - (lo or 0)) * 4 / ((hi or 0) - (lo or 0) + 1))
    for i in range(4):
        ev.where(part == i).write.mode("append").parquet(path)
        out = O.upsert_stream(spark, path, ev.schema, offsets, silver, ["user_id", "event_type"], [-F.col("event_id")],
                              files_per_batch=1_000_000, buckets=16)
    return out


@query("incr_resume_grid", f"""WITH {S.RESULTS}, g AS (SELECT DISTINCT feature_set, model FROM results),
  d AS (SELECT DISTINCT feature_set, model FROM results WHERE metric = 'mae' AND value < 33500)
  SELECT feature_set, model FROM g WHERE (feature_set, model) NOT IN (SELECT (feature_set, model) FROM d)""")
def incr_resume_grid(spark, sf):
    res = S.results(spark, sf)
    return O.resume_grid(res.select("feature_set", "model").distinct(), res.where("metric = 'mae' and value < 33500"))
