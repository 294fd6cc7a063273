"""Resumable jobs."""

from pyspark.sql import functions as F

from emipanel.streaming import incremental


def test_ingest_takes_each_file_once(spark, tmp_path):
    src, ckpt, sink = (str(tmp_path / n) for n in ("src", "ckpt", "sink"))
    spark.range(10).write.parquet(src)
    schema = spark.read.parquet(src).schema
    assert incremental.ingest_incremental(spark, src, schema, ckpt, sink).count() == 10
    assert incremental.ingest_incremental(spark, src, schema, ckpt, sink).count() == 10
    spark.range(10, 15).write.mode("append").parquet(src)
    assert incremental.ingest_incremental(spark, src, schema, ckpt, sink).count() == 15


def test_upsert_stream_and_repeated_batch(spark, tmp_path):
    src, ckpt, table = (str(tmp_path / n) for n in ("src", "ckpt", "table"))
    spark.createDataFrame([(1, 1, "a"), (2, 1, "a")], "k int, v int, t string").coalesce(1).write.parquet(src)
    schema = spark.read.parquet(src).schema
    incremental.upsert_stream(spark, src, schema, ckpt, table, ["k"], [-F.col("v")])
    spark.createDataFrame([(2, 5, "b"), (3, 2, "b")], "k int, v int, t string").coalesce(1).write.mode("append").parquet(src)
    out = incremental.upsert_stream(spark, src, schema, ckpt, table, ["k"], [-F.col("v")])
    want = [(1, 1, "a"), (2, 5, "b"), (3, 2, "b")]
    assert sorted(tuple(r) for r in out.collect()) == want
    # the same batch again, as after a failure between write and commit
    batch = spark.createDataFrame([(2, 5, "b"), (3, 2, "b")], "k int, v int, t string")
    incremental.foreach_batch_upsert(table, ["k"], [-F.col("v")])(batch, 1)
    assert sorted(tuple(r) for r in incremental.current_table(spark, table).collect()) == want


def test_upsert_leaves_other_buckets_and_repairs_lost_ones(spark, tmp_path):
    import shutil

    table, work = str(tmp_path / "table"), str(tmp_path / "work")
    first = spark.range(40).selectExpr("id as k", "0 as v")
    apply = incremental.foreach_batch_upsert(table, ["k"], [], work, buckets=8)
    apply(first, 0)
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "table").rglob("*.parquet")}
    second = spark.createDataFrame([(3, 1), (None, 1)], "k long, v int")
    apply(second, 1)
    kept = [f for f, at in files.items() if f.exists() and f.stat().st_mtime_ns == at]
    assert 6 <= len(kept) < len(files)
    want = sorted([(k, 0) for k in range(40) if k != 3] + [(3, 1), (-1, 1)])

    def rows():
        return sorted((-1 if r["k"] is None else r["k"], r["v"]) for r in incremental.current_table(spark, table).collect())

    assert rows() == want
    # a failure after the old bucket was removed: the batch is repeated and goes on from its marked rows
    shutil.rmtree([p for p in (tmp_path / "table").glob("__bucket=*") if not any(f.parent == p for f in kept)][0])
    assert rows() != want
    apply(second, 1)
    assert rows() == want
    apply(second.limit(0), 2)
    assert rows() == want


def test_pending_and_grid(spark):
    plan = spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], "k string, y int")
    done = spark.createDataFrame([("a", 1, "ok"), (None, 2, "err:x")], "k string, y int, status string")
    left = incremental.pending(plan, incremental.done_ok(done), ["k", "y"])
    assert sorted((r["k"] or "", r["y"]) for r in left.collect()) == [("", 2), ("c", 3)]
    grid = spark.createDataFrame([("t", "m"), ("t", "n")], "feature_set string, model string")
    assert incremental.resume_grid(grid, grid.where("model = 'm'")).first()["model"] == "n"
