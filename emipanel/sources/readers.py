"""Scans: text files by alias, yearly files, JSON caches, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emipanel.functions.core import as_col


def read_csv(spark: SparkSession, path, schema=None, encoding: str = "UTF-8") -> DataFrame:
    """Everything as text unless a schema is given; types are decided by later coercion, never guessed."""
    reader = spark.read.option("header", True).option("encoding", encoding)
    return reader.csv(path, schema=schema) if schema else reader.option("inferSchema", False).csv(path)


def read_latin1(spark: SparkSession, path) -> DataFrame:
    return read_csv(spark, path, encoding="ISO-8859-1")


def with_file_year(df: DataFrame, pattern: str = r"([0-9]{4})", name: str = "file_year") -> DataFrame:
    """Year found in the path of the file each row came from."""
    return df.withColumn(name, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).try_cast("long"))


def read_yearly_files(spark: SparkSession, paths, pattern: str, fmt: str = "csv") -> DataFrame:
    df = read_csv(spark, paths) if fmt == "csv" else spark.read.format(fmt).load(paths)
    return with_file_year(df, pattern)


def resolve_columns(columns, rules: dict) -> dict:
    """Header per wanted name. A rule is a list of patterns tried in order; each pattern is
    ``(all of these words, none of those)`` or a text the whole header must equal."""
    headers = [(c, c.strip().lower()) for c in columns]
    found = {}
    for name, patterns in rules.items():
        for pattern in patterns:
            if isinstance(pattern, str):
                match = (c for c, low in headers if low == pattern)
            else:
                need, avoid = pattern
                match = (c for c, low in headers
                         if all(w in low for w in need) and not any(w in low for w in avoid))
            hit = next(match, None)
            if hit is not None:
                found[name] = hit
                break
    return found


def select_resolved(df: DataFrame, rules: dict) -> DataFrame:
    """One projection from the resolved headers; unresolved names become null text columns."""
    found = resolve_columns(df.columns, rules)
    return df.select(*[(F.col(f"`{found[n]}`") if n in found else F.lit(None).cast("string")).alias(n)
                       for n in rules])


def clean_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace("\n", " ").strip() for c in df.columns])


def read_cols(spark: SparkSession, path, cols, fmt: str = "parquet") -> DataFrame:
    """Column-pruned scan: the columns reach the file reader."""
    df = read_csv(spark, path) if fmt == "csv" else spark.read.format(fmt).load(path)
    return df.select(*cols)


def load_results(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: json, parquet or csv."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        return read_csv(spark, path)
    if suffix in ("json", "parquet"):
        return spark.read.format(suffix).load(path)
    raise ValueError(f"no reader for .{suffix}")


def explode_map(df: DataFrame, json_col, value_schema: str, key: str = "key", value: str = "value",
                keep=()) -> DataFrame:
    """Id -> record documents to one row per id; records that are not objects come out null."""
    parsed = F.from_json(as_col(json_col), f"map<string,{value_schema}>")
    return df.select(*keep, F.explode(parsed).alias(key, value))


def read_json_map(spark: SparkSession, path, value_schema: str) -> DataFrame:
    """Id -> record cache files, one document per file (land big caches as many files)."""
    text = spark.read.option("wholetext", True).text(path)
    return (explode_map(text, "value", value_schema, "id", "record")
            .where(F.col("record").isNotNull()).select("id", "record.*"))


def explode_panel(df: DataFrame, id_col: str, panel: str = "panel") -> DataFrame:
    """``panel`` map of year -> fields to (id, year, fields...)."""
    return (df.select(id_col, F.explode(panel).alias("year", "__f"))
            .select(id_col, F.col("year").try_cast("long").alias("year"), "__f.*"))


def explode_summary(df: DataFrame, id_col: str, summary: str = "summary") -> DataFrame:
    return df.where(F.col(summary).isNotNull() & (F.trim(summary) != "")).select(id_col, summary)


def statement_to_panel(df: DataFrame, keys, field: str, date: str, value: str, fields: dict) -> DataFrame:
    """(field, date, value) statement cells to one row per (keys, year) with a column per wanted field.

    A later date of the same year wins, as it does in a map filled in date order.
    """
    keys = list(keys)
    cells = df.where(F.col(field).isin(list(fields)) & F.col(value).isNotNull() & ~F.isnan(value))
    cells = cells.withColumn("year", F.year(date).cast("long"))
    return cells.groupBy(*keys, "year").agg(*[
        F.max_by(F.when(F.col(field) == f, F.col(value)),
                 F.when(F.col(field) == f, F.struct(F.col(date), F.col(value)))).alias(name)
        for f, name in fields.items()])


DAILY_SCHEMA = "struct<properties:struct<parameter:map<string,map<string,double>>>>"


def explode_daily(df: DataFrame, json_col, keep=()) -> DataFrame:
    """Climate payload {properties:{parameter:{variable:{yyyymmdd: v}}}} to (keep, variable, day, value)."""
    doc = F.from_json(as_col(json_col), DAILY_SCHEMA)
    out = df.select(*keep, F.explode(doc.getField("properties").getField("parameter")).alias("variable", "__d"))
    return (out.select(*keep, "variable", F.explode("__d").alias("__day", "value"))
            .select(*keep, "variable", F.to_date(F.try_to_timestamp("__day", F.lit("yyyyMMdd"))).alias("day"),
                    "value"))


def read_shards(spark: SparkSession, path, pattern: str = r"([^/]+?)(?:\.[a-z.]+)?$") -> DataFrame:
    """Directory of Parquet shards; each row keeps the name of its shard (found in the file path) and its
    place in the file."""
    df = spark.read.parquet(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)
    return df.withColumn("shard", name).withColumn("shard_row", F.col("_metadata.row_index"))


def select_shards(df: DataFrame, specs: DataFrame, shard: str = "shard", city: str = "city") -> DataFrame:
    """Rows of the shards named in ``specs(shard, include, exclude)``; null lists do not restrict.

    ``specs`` is a hand-written list and is left to the size check of the automatic broadcast.
    """
    s = specs.select(F.col(shard).alias("__shard"), "include", "exclude")
    joined = df.join(s, F.col(shard) == F.col("__shard"))
    kept = ((F.col("include").isNull() | F.array_contains("include", F.col(city)))
            & (F.col("exclude").isNull() | ~F.array_contains("exclude", F.col(city))))
    return joined.where(kept).select(*df.columns)


def gather_embeddings(meta: DataFrame, emb: DataFrame, key: str = "row_id", vector: str = "embedding") -> DataFrame:
    """Vectors by key; a row without a vector is dropped, as metadata and vectors must pair up."""
    return meta.join(emb.select(key, vector), key)


def with_ordinal(df: DataFrame, name: str = "ingest_ordinal") -> DataFrame:
    """Order of ingestion of a Parquet scan: (file, row in file). Needed wherever 'first' matters."""
    return df.withColumn(name, F.struct(F.col("_metadata.file_path").alias("file"),
                                        F.col("_metadata.row_index").alias("row")))


def fallback_ids(df: DataFrame, city: str, ordinal, name: str = "building_id") -> DataFrame:
    """Rows without an id get ``<city>_row_<n>`` from their ingest ordinal."""
    made = F.concat(F.lit(f"{city}_row_"), as_col(ordinal).cast("string"))
    return df.withColumn(name, F.coalesce(F.col(name), made))


__all__ = [n for n in dir() if not n.startswith("_") and n not in
           ("annotations", "DataFrame", "SparkSession", "F", "as_col")]
