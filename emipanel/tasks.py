"""Array computations that run inside tasks, on Arrow batches that Spark has partitioned.

They are sent to the executors by value, so an executor needs NumPy but no copy of this package.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

HOLT_ALPHA = (0.2, 0.4, 0.6, 0.8, 1.0)
HOLT_BETA = (0.0, 0.2, 0.4, 0.6, 0.8)
HOLT_PHI = (0.8, 0.9, 0.98)
HOLT_TIE = 1e-9


def holt_block(s: np.ndarray, length: np.ndarray, damped: bool) -> np.ndarray:
    """One-step forecasts of the rows of ``s`` (left-aligned, ``length`` values each), all rows and all
    smoothing settings at once; rows need at least two values."""
    grid = np.array([(a, b, p) for a in HOLT_ALPHA for b in HOLT_BETA for p in (HOLT_PHI if damped else (1.0,))])
    a, b, p = (grid[:, i][None, :] for i in range(3))
    level = np.repeat(s[:, :1], len(grid), axis=1)
    trend = np.repeat(s[:, 1:2] - s[:, :1], len(grid), axis=1)
    sse = np.zeros_like(level)
    for i in range(1, s.shape[1]):
        live = (length > i)[:, None]
        v = s[:, i:i + 1]
        guess = level + p * trend
        new = a * v + (1 - a) * guess
        slope = b * (new - level) + (1 - b) * p * trend
        sse = np.where(live, sse + (v - guess) ** 2, sse)
        level, trend = np.where(live, new, level), np.where(live, slope, trend)
    # short histories fit many settings equally well; the first of them is taken
    best = np.argmax(sse <= sse.min(axis=1, keepdims=True) + HOLT_TIE, axis=1)
    rows = np.arange(len(s))
    return (level + p * trend)[rows, best]


MODULUS = (1 << 31) - 1
# Cumulative Poisson(1) probabilities: the weight is the number of cut points at or below u.
POISSON_CDF = [float(c) for c in np.cumsum([np.exp(-1.0) / float(np.prod(np.arange(1, k + 1))) for k in range(12)])]


def cut_points() -> np.ndarray:
    """Smallest residue r with r / MODULUS at or above each cumulative probability."""
    cuts = []
    for c in POISSON_CDF:
        k = int(np.ceil(c * MODULUS))
        while k > 0 and (k - 1) / MODULUS >= c:
            k -= 1
        while k / MODULUS < c:
            k += 1
        cuts.append(k)
    return np.array(cuts, dtype=np.int64)


#: Low bits of a residue that the table of weights leaves out.
COARSE_BITS = 18


def weight_table(cuts: np.ndarray) -> np.ndarray:
    """Weight by the high bits of a residue that may still hold the modulus once (then what is left is below every cut point); 255 where
    a cut point, or the modulus itself, lies among the residues with those bits."""
    edge = np.arange(((MODULUS + (1 << 28) + 2) >> COARSE_BITS) + 1, dtype=np.int64) << COARSE_BITS
    low = np.searchsorted(cuts, edge, side="right")
    high = np.searchsorted(cuts, edge + (1 << COARSE_BITS) - 1, side="right")
    table = np.where(low == high, low, 255).astype(np.uint8)
    table[MODULUS >> COARSE_BITS] = 255
    table[(MODULUS >> COARSE_BITS) + 1:] = 0
    return table


def poisson_weights(h: np.ndarray, a: np.ndarray, c: np.ndarray, cuts: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """Rows x replicates block of weights, ``h`` below 2^28. The remainder by 2^31-1 is taken by folding the high bits; its own high bits
    give the weight by ``weight_table(cuts)``, and only the few residues beside a cut point are compared."""
    table = weight_table(cuts) if table is None else table
    z = h[:, None] * a
    z += c
    high = z >> 31
    z &= MODULUS
    z += high
    w = table.take(z >> COARSE_BITS).ravel()
    near = np.flatnonzero(w == 255)
    r = z.ravel()[near]
    w[near] = np.searchsorted(cuts, np.where(r >= MODULUS, r - MODULUS, r), side="right")
    return w.reshape(z.shape).astype(float)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
