"""Corpus pipeline: quality, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before has kept, and returns all columns of documents; the
last returns the packed pieces. run() writes each stage to the shared checkpoint folder and reads it back, so a lost executor
costs no finished stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emipanel.llm import jaccard, mixing, packing, pii, quality
from emipanel.llm.common import stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It is fitted on all labels of documents that are there."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: the one with the smallest doc_id, with all its rows if repeated."""
    groups = jaccard.similar_documents(docs)
    dropped = stored(groups.filter(F.col("component_id") != F.col("doc_id")).select("doc_id"), "dropped")
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in brackets."""
    return pii.without_personal_data(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: whole passes over a document repeat its row, a part of it is a row with the text's first words."""
    mixed = mixing.mix(docs)
    passes = mixed.select(F.col("doc_id").alias("__doc"), F.col("size").alias("__size"), F.col("taken").alias("__taken")).filter("__taken > 0").dropDuplicates(["__doc"])
    rows = docs.join(passes, docs["doc_id"].eqNullSafe(passes["__doc"]))
    whole = F.array_repeat(F.col("__size"), F.floor(F.col("__taken") / F.col("__size")).cast("int"))
    part = F.when(F.col("__taken") % F.col("__size") > 0, F.array(F.col("__taken") % F.col("__size"))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("__words", F.explode(F.concat(whole, part)))
    text = F.when(F.col("__words") == F.col("__size"), F.col("text")).otherwise(mixing.first_words(F.col("text"), F.col("__words")))
    rows = rows.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))
    return rows.select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of full token windows."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("personal data", personal_data_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: A fitted model, connected components and a tokenizer are not SQL. tests/llm looks at columns and a few rows of run(); the operators have tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
