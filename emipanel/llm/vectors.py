"""Vectors in blocks: what the two searches share.

Usable vectors are dealt into shards of a fixed size and, apart, into blocks of queries; each shard and each block becomes one row
with a matrix. Shards meet blocks through a key, so a task holds one of either.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD = 4096
QUERY_BLOCK = 512


def usable(vectors: DataFrame, id_col: str, vector_col: str, zero: bool) -> DataFrame:
    """id, v (doubles), dim; without null ids, null, empty or (unless ``zero``) all-zero vectors, and those that hold a null, NaN or infinity."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = vectors.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).filter("id is not null and v is not null and size(v) > 0").filter(~bad)
    if not zero:
        out = out.filter(F.exists("v", lambda x: x != 0))
    return out.withColumn("dim", F.size("v"))


def packed(rows: DataFrame, size: int, name: str, build=None) -> DataFrame:
    """One row per block of about ``size`` vectors of equal dimension: dim, <name>, ids, matrix (both binary), extra (what build(matrix) gives)."""
    blocks = max(1, -(-rows.count() // size))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        matrix = np.stack([np.asarray(v, "<f8") for v in pdf["v"]])
        extra = build(matrix) if build else b""
        return pd.DataFrame({"dim": [int(pdf["dim"].iloc[0])], name: [int(pdf[name].iloc[0])], f"{name}_ids": [pdf["id"].to_numpy("<i8").tobytes()],
                             f"{name}_matrix": [matrix.tobytes()], f"{name}_extra": [extra]})

    return (rows.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).groupBy("dim", name)
            .applyInPandas(run, f"dim int, {name} int, {name}_ids binary, {name}_matrix binary, {name}_extra binary"))


def search(shards: DataFrame, queries: DataFrame, find, k: int, score_type: str) -> DataFrame:
    """Every block of queries against every shard of its dimension by find(matrix, ids, extra, query, query_id) -> (ids, scores), then
    the k best per query: query_id, rank, vec_id, score; ties to the smaller vec_id."""
    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64() if score_type == "double" else pa.int64())])
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                matrix = np.frombuffer(r["shard_matrix"], "<f8").reshape(-1, r["dim"])
                ids = np.frombuffer(r["shard_ids"], "<i8")
                queries = np.frombuffer(r["block_matrix"], "<f8").reshape(-1, r["dim"])
                prepared = find.prepare(matrix, ids, r["shard_extra"])
                out_q, out_v, out_s = [], [], []
                for q, query_id in zip(queries, np.frombuffer(r["block_ids"], "<i8")):
                    v, s = find(prepared, q, query_id, k)
                    out_q.append(np.full(len(v), query_id, np.int64))
                    out_v.append(v)
                    out_s.append(s)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), f.type) for x, f in zip((out_q, out_v, out_s), schema)], schema=schema)

    # every shard number of the dimension for every block: the key that they meet by
    met = queries.join(shards.select("dim", "shard"), "dim").join(shards, ["dim", "shard"])
    found = met.repartition("dim", "shard", "block").mapInArrow(run, f"query_id bigint, vec_id bigint, score {score_type}")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= cut)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]
