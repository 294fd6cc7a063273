"""Exact top-k by Fagin's threshold algorithm.

Each shard keeps a list per dimension, sorted by that component. A query reads the lists in step, from the end that its own
component favours; every vector it meets is scored in full. No vector that it has not met can score more than the sum of the
lists' current components times the query's, so it stops when that bound cannot beat the kth score.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emipanel.llm.common import stored
from emipanel.llm.vectors import QUERY_BLOCK, SHARD, packed, search, top, usable

SCALE = 256
#: List places read between two looks at the bound.
STEP = 32


class Threshold:
    def prepare(self, matrix, ids, extra):
        whole = matrix.astype(np.int64)
        order = np.argsort(whole, axis=0, kind="stable")  # ascending, per dimension
        return whole, ids, order, np.take_along_axis(whole, order, axis=0)

    def __call__(self, prepared, query, query_id, k):
        whole, ids, order, values = prepared
        q = query.astype(np.int64)
        n = len(ids)
        used = np.flatnonzero(q)
        seen = ids == query_id
        best_s, best_i = np.zeros(0, np.int64), np.zeros(0, np.int64)
        down = q[used] > 0
        for at in range(0, n, STEP):
            stop = min(at + STEP, n)
            met = np.concatenate([order[n - stop:n - at, used[down]].ravel(), order[at:stop, used[~down]].ravel()]) if len(used) else np.arange(at, stop)
            new = np.zeros(n, bool)
            new[met] = True
            new = np.flatnonzero(new & ~seen)
            seen[new] = True
            s, i = np.concatenate([best_s, whole[new] @ q]), np.concatenate([best_i, ids[new]])
            keep = top(s, i, k)
            best_s, best_i = s[keep], i[keep]
            bound = int((values[n - stop, used[down]] * q[used[down]]).sum() + (values[stop - 1, used[~down]] * q[used[~down]]).sum())
            # a tie could still go to a smaller id, so the bound has to be below the kth score
            if len(used) and len(best_s) >= k and bound < best_s[-1]:
                break
        return best_i, best_s


def top_scores(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
               scale: int = SCALE, shard: int = SHARD, block: int = QUERY_BLOCK) -> DataFrame:
    """The k rows of ``vectors`` with the highest integer inner product per row of ``queries``, its own id apart: query_id, rank,
    vec_id, score, over components floor(scale * x). Fewer than k if there are fewer; ties go to the smaller vec_id.

    Vectors that are null, empty or hold a null, NaN or infinity take no part; zero vectors do. Vectors meet those of their own
    dimension only. Repeated rows are candidates each. The result is exact.
    """
    def whole(df):
        return usable(df, id_col, vector_col, zero=True).withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))

    return search(stored(packed(whole(vectors), shard, "shard"), "shards"), stored(packed(whole(queries), block, "block"), "blocks"),
                  Threshold(), k, "bigint")
