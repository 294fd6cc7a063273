"""Writers: overwrite, upsert, append, audit, replacement, manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emipanel.functions.numeric import safe
from emipanel.operators.dedup import refuse_duplicates
from emipanel.operators.skew import first_per_key, join_null_safe


def write_table(df: DataFrame, path: str, partition_by=(), fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(fmt).option("header", fmt == "csv").save(path)


def upsert_keep_last(prev: DataFrame, new: DataFrame, keys, order=()) -> DataFrame:
    """Previous and new rows, the newest generation per key; ``order`` settles rows of one generation
    (the smallest wins, so pass negated values to keep the last)."""
    both = (prev.withColumn("__gen", F.lit(0))
            .unionByName(new.withColumn("__gen", F.lit(1)), allowMissingColumns=True))
    return first_per_key(both, keys, [-F.col("__gen"), *order]).drop("__gen")


def append_results(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def split_with_audit(df: DataFrame, rules, reason: str = "outlier_reason") -> tuple[DataFrame, DataFrame]:
    """(kept, dropped with the first rule that applies). ``rules``: list of (name, condition)."""
    label = F.lit(None).cast("string")
    for name, cond in reversed(list(rules)):
        label = F.when(cond, name).otherwise(label)
    marked = df.withColumn(reason, label)
    return marked.where(F.col(reason).isNull()).drop(reason), marked.where(F.col(reason).isNotNull())


def write_with_audit(df: DataFrame, rules, path: str, reason: str = "outlier_reason") -> dict[str, int]:
    """Kept and dropped rows side by side under ``path``, in partitions by ``reason`` ("kept", or the first rule that applies), from one
    read of ``df``. Returns rows by reason and in all, observed while they were written.
    """
    label = F.lit("kept")
    for name, cond in reversed(list(rules)):
        label = F.when(cond, name).otherwise(label)
    seen = Observation()
    counts = [F.count_if(F.col(reason) == name).alias(name) for name in ("kept", *[n for n, _ in rules])]
    marked = df.withColumn(reason, label).observe(seen, F.count(F.lit(1)).alias("all"), *counts)
    marked.write.mode("overwrite").partitionBy(reason).parquet(path)
    return seen.get


def replace_partitions(base: DataFrame, repl: DataFrame, col: str, keys=None) -> DataFrame:
    """Groups present in ``repl`` replace those of ``base`` whole, the null group too. With ``keys``, the result cannot be used if a key
    occurs twice in it."""
    names = repl.select(col).distinct()
    merged = join_null_safe(base, names, [col], "left_anti").unionByName(repl, allowMissingColumns=True)
    return merged if keys is None else refuse_duplicates(merged, keys)


def overwrite_partitions(df: DataFrame, path: str, col: str) -> None:
    """Rewrite only the partitions that occur in ``df``."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(col).parquet(path))


def manifest(df: DataFrame, before: DataFrame, by=(), city: str = "city", year: str = "year") -> DataFrame:
    """Rows before and after, removed and usable rows, cities and year range, per ``by``.

    The city list is built from the distinct cities, not from rows.
    """
    by = list(by)
    after = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows_after"),
                                F.count_if(F.col("status") == "ok").alias("rows_ok"),
                                F.min(year).alias("year_min"), F.max(year).alias("year_max"))
    cities = (df.select(*by, city).distinct().groupBy(*by)
              .agg(F.array_join(F.sort_array(F.collect_list(city)), ",").alias("cities")))
    start = before.groupBy(*by).agg(F.count(F.lit(1)).alias("rows_before"))
    if by:
        out = start.join(after, by, "left").join(cities, by, "left")
    else:
        one = F.lit(1).alias("__one")
        out = (start.select("*", one).join(after.select("*", one), "__one")
               .join(cities.select("*", one), "__one").drop("__one"))
    out = out.withColumn("rows_after", F.coalesce("rows_after", F.lit(0)))
    return out.withColumn("rows_removed", F.col("rows_before") - F.col("rows_after"))


def json_ready(df: DataFrame) -> DataFrame:
    """Non-finite numbers to null."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: safe(c) for c in floats}) if floats else df


def save_results(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    if fmt not in ("json", "parquet", "csv"):
        raise ValueError(f"no writer for {fmt}")
    write_table(json_ready(df), path, fmt=fmt)
