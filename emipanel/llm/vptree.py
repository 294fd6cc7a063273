"""Nearest neighbours by largest inner product with a vantage-point tree per shard.

One more coordinate makes all vectors equally long, so that the largest inner product is the smallest Euclidean distance and the
triangle inequality holds. Each shard has a tree: a node's vantage point splits its vectors at the median distance, leaves hold a
few dozen. A search goes down the nearer side first and skips a side when the triangle inequality, multiplied by ``factor``,
rules it out: factor 1 is exact, larger factors prune sooner and may miss.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emipanel.llm.common import stored
from emipanel.llm.vectors import QUERY_BLOCK, SHARD, packed, search, top, usable

LEAF = 256
#: Pruning factor of the registered query: one, which is exact.
FACTOR = 1.0


def lifted(matrix: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest ** 2 - (matrix ** 2).sum(axis=1), 0.0))
    return np.concatenate([matrix, rest[:, None]], axis=1)


def build_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, list]:
    """An order of the points and nodes (begin, end, vantage, inner bounds, outer bounds, left, right); leaves have vantage -1."""
    order, nodes = np.arange(len(points)), []

    def grow(begin: int, end: int) -> int:
        me = len(nodes)
        nodes.append(None)
        if end - begin <= leaf:
            nodes[me] = (begin, end, -1, 0.0, 0.0, 0.0, 0.0, -1, -1)
            return me
        part = order[begin:end]
        # the point farthest from the first one sees its group spread out
        far = part[np.argmax(((points[part] - points[part[0]]) ** 2).sum(axis=1))]
        distance = np.sqrt(((points[part] - points[far]) ** 2).sum(axis=1))
        rank = np.argsort(distance, kind="stable")
        order[begin:end], distance, half = part[rank], distance[rank], len(part) // 2
        left, right = grow(begin, begin + half), grow(begin + half, end)
        nodes[me] = (begin, end, int(far), distance[0], distance[half - 1], distance[half], distance[-1], left, right)
        return me

    grow(0, len(points))
    return order, nodes


class TreeSearch:
    def __init__(self, longest: float, factor: float):
        self.longest, self.factor = longest, factor

    def prepare(self, matrix, ids, extra):
        points = lifted(matrix, self.longest)
        order, nodes = build_tree(points)
        return matrix, ids, points, order, nodes, np.ascontiguousarray(matrix[order]), ids[order]

    def __call__(self, prepared, query, query_id, k):
        matrix, ids, points, order, nodes, laid, laid_ids = prepared
        length = float(query @ query)
        q = np.append(query, 0.0)
        slack = 1e-12 * (1 + np.sqrt(length) * self.longest)
        shift = length + self.longest ** 2  # squared distance = shift - 2 inner product
        best_s, best_i = np.zeros(0), np.zeros(0, np.int64)
        worst = np.inf
        stack = [(0.0, 0)]
        while stack:
            bound, at = stack.pop()
            if bound * self.factor > worst + 1e-9:
                continue
            begin, end, vantage, in0, in1, out0, out1, left, right = nodes[at]
            if vantage < 0:
                own, rough = laid_ids[begin:end], laid[begin:end] @ query
                rough[own == query_id] = -np.inf
                cut = best_s[-1] if len(best_s) >= k else np.partition(rough, len(rough) - min(k, len(rough)))[len(rough) - min(k, len(rough))]
                fit = np.flatnonzero((rough >= cut - slack) & (own != query_id))
                if len(fit):
                    # of those that may enter: products added in order, as a plain loop would
                    exact = np.cumsum(laid[begin:end][fit] * query, axis=1)[:, -1]
                    s, i = np.concatenate([best_s, exact]), np.concatenate([best_i, own[fit]])
                    keep = top(s, i, k)
                    best_s, best_i = s[keep], i[keep]
                    if len(best_s) >= k:
                        worst = np.sqrt(max(shift - 2 * best_s[-1], 0.0))
                continue
            d = float(np.sqrt(((points[vantage] - q) ** 2).sum()))
            inner, outer = max(in0 - d, d - in1, 0.0), max(out0 - d, d - out1, 0.0)
            sides = [(max(bound, inner), left), (max(bound, outer), right)]
            stack += sides if outer <= inner else sides[::-1]  # the nearer side is taken up first
        return best_i, best_s


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            factor: float = FACTOR, shard: int = SHARD, block: int = QUERY_BLOCK) -> DataFrame:
    """The k rows of ``vectors`` with the largest inner product per row of ``queries``, its own id apart: query_id, rank, vec_id,
    score (the inner product of the vectors as doubles). Fewer than k if there are fewer. Ties go to the smaller vec_id.

    Vectors that are null, empty, all zero, or hold a null, NaN or infinity take no part; vectors meet those of their own dimension
    only. Repeated rows are candidates each. Every vector is indexed; nothing is sampled.
    """
    base = stored(usable(vectors, id_col, vector_col, zero=False), "vectors")
    asked = usable(queries, id_col, vector_col, zero=False)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    longest = base.agg(F.max(norm).alias("m")).first()["m"] or 0.0
    return search(stored(packed(base, shard, "shard"), "shards"), stored(packed(asked, block, "block"), "blocks"),
                  TreeSearch(longest * (1 + 1e-12), factor), k, "double")
