"""Resumable work: what is pending, what counts as done, and file-stream ingestion with upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emipanel.operators.skew import join_null_safe
from emipanel.sources.sinks import upsert_keep_last


def pending(plan: DataFrame, done: DataFrame, keys) -> DataFrame:
    return join_null_safe(plan, done.select(*keys), keys, "left_anti")


def done_ok(df: DataFrame, status: str = "status", ok: str = "ok") -> DataFrame:
    """Only successes count as done; everything else is tried again."""
    return df.where(F.col(status) == ok)


def resume_grid(grid: DataFrame, results: DataFrame, keys=("feature_set", "model")) -> DataFrame:
    """Grid cells without a result."""
    return pending(grid, results, keys)


def ingest_incremental(spark: SparkSession, source: str, schema, checkpoint: str, sink: str,
                       fmt: str = "parquet", files_per_batch: int = 1000):
    """Append every file not seen before; the checkpoint keeps the offsets, so a restart continues."""
    stream = (spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch)
              .load(source))
    query = (stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", sink)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(schema).parquet(sink)


def _ready(spark: SparkSession, work: str) -> int:
    """Batch whose merged rows lie complete in ``work``, -1 before the first."""
    spark.createDataFrame([], "batch_id bigint").write.mode("ignore").parquet(f"{work}/ready")
    last = spark.read.schema("batch_id bigint").parquet(f"{work}/ready").agg(F.max("batch_id")).first()[0]
    return -1 if last is None else last


def current_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Rows of an upserted table, without its bucket column. With a schema a table that has no rows yet is empty."""
    rows = spark.read.parquet(path) if schema is None else _stored_rows(spark, path, schema)
    return rows.drop("__bucket")


def _stored_rows(spark: SparkSession, path: str, schema) -> DataFrame:
    empty = spark.createDataFrame([], schema).withColumn("__bucket", F.lit(0))
    empty.write.partitionBy("__bucket").mode("ignore").parquet(path)  # makes the folder, adds nothing
    return spark.read.schema(empty.schema).parquet(path)


def foreach_batch_upsert(path: str, keys, order=(), work: str | None = None, buckets: int = 64):
    """Batch function: replaces the rows of the increment's keys in a table laid out by a hash of the key.

    Only the buckets that the increment touches are read and rewritten; files of all others stay as they are. The merged rows are
    first written to ``work`` with a mark, then they take the buckets' place, so a batch repeated after a failure goes on from the
    marked rows, even if it had lost a bucket half way. ``buckets`` fixes the layout: choose it so that one bucket suits one task,
    and never change it for a table that has rows.
    """
    work = work or f"{path}-work"

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        if _ready(spark, work) != batch_id:
            rows = _stored_rows(spark, path, batch.schema)
            touched = [r[0] for r in batch.select(bucket).distinct().collect()]  # at most ``buckets`` numbers
            old = rows.where(F.col("__bucket").isin(touched)).select(*batch.columns)
            merged = upsert_keep_last(old, batch, keys, order).withColumn("__bucket", bucket)
            merged.write.mode("overwrite").parquet(f"{work}/merged")
            spark.range(batch_id, batch_id + 1).toDF("batch_id").write.mode("append").parquet(f"{work}/ready")
        staged = spark.read.parquet(f"{work}/merged")
        (staged.repartition("__bucket").write.partitionBy("__bucket").mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").parquet(path))

    return apply


def upsert_stream(spark: SparkSession, source: str, schema, checkpoint: str, table: str, keys, order=(),
                  fmt: str = "parquet", files_per_batch: int = 1000, buckets: int = 64) -> DataFrame:
    """Run all waiting files through the upsert and return the table."""
    stream = (spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch)
              .load(source))
    batch = foreach_batch_upsert(table, keys, order, f"{checkpoint}-work", buckets)
    query = (stream.writeStream.foreachBatch(batch)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return current_table(spark, table, schema)
