"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader updates.

A word gives two normal forms: its letters in lower case, and its shape (case, digits and punctuation, repeats collapsed).
Features are words, word pairs, shapes, shape pairs and triples, and the pair of a word with itself, hashed into a fixed number of buckets; counts are scaled
to unit length. Training goes over shards of a bounded sample in parallel and averages their weights; scoring is a sparse dot
product per text inside the scan.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emipanel.llm.common import Memo, keyed_text, mix64, pieces, rows, split_words

BUCKETS = 1 << 18
#: Most labelled documents that a fit reads; with fewer labels all are used.
SAMPLE = 12_000
#: Documents of the sample per shard that is trained on its own; a small sample is one shard.
PER_SHARD = 3000
THRESHOLD = 0.3
ALPHA, BETA, L1, L2 = 4.0, 1.0, 0.001, 0.01
EPOCHS = 6

_PUNCTUATION = bytes(c for c in range(128) if not chr(c).isalnum())
_SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))
_REPEATS = re.compile(rb"(.)\1+", re.S)
_WORD, _SHAPES = 0x9E3779B9, 0x85EBCA6B


def forms(word: bytes) -> int:
    """Two 31-bit numbers in one: of the word's letters and of its shape."""
    core = word.lower().translate(None, _PUNCTUATION)
    shape = _REPEATS.sub(rb"\1", word.translate(_SHAPE))[:12]
    return ((xxhash.xxh3_64_intdigest(core, _WORD) & 0x7FFFFFFF) << 31) | (xxhash.xxh3_64_intdigest(shape, _SHAPES) & 0x7FFFFFFF)


def features(codes: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers and unit-length values of a text given by its words' forms."""
    core, shape = codes >> 31, codes & 0x7FFFFFFF
    two = (shape[:-1] * 1_000_003) ^ (shape[1:] << 7)
    parts = [core * 2 + 1, (core[:-1] * 1_000_003) ^ (core[1:] << 9), shape * 2 + (1 << 40), two + (1 << 50),
             (two[:-1] * 999_983) ^ (shape[2:] << 11), np.full(int((core[1:] == core[:-1]).sum()), 1 << 60)]
    hashed = mix64(np.concatenate(parts).view(np.uint64)) % np.uint64(buckets)
    index, count = np.unique(hashed.astype(np.int64), return_counts=True)
    return index, count / np.sqrt(float((count.astype(float) ** 2).sum()) or 1.0)


def ftrl(examples, buckets: int, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """FTRL-proximal over [(index, value, label)] in the given order; weights and intercept."""
    z, n = np.zeros(buckets + 1), np.zeros(buckets + 1)

    def weight(i):
        return np.where(np.abs(z[i]) <= L1, 0.0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for index, value, label in examples:
            i, x = np.append(index, buckets), np.append(value, 1.0)
            w = weight(i)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - label) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    every = weight(np.arange(buckets + 1))
    return every[:-1], float(every[-1])


class QualityModel:
    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights.astype(np.float32), intercept

    def score(self, codes: np.ndarray) -> float:
        index, value = features(codes, len(self.weights))
        return float(1.0 / (1.0 + np.exp(-np.clip(self.weights[index] @ value + self.intercept, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        sample: int = SAMPLE, per_shard: int = PER_SHARD, buckets: int = BUCKETS, seed: int = 7) -> QualityModel:
    """Fit on at most ``sample`` labelled documents, drawn by a hash of the key.

    Rows of ``labels`` with a null key or label are left out; of repeated keys the lowest label counts. Without any labelled
    document the model says 0.5 of everything; with one class only, its intercept alone speaks. The drawn keys (at most
    ``sample`` numbers) are sent to the scan, so texts are not shuffled but for the sample.
    """
    known = (labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
             .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).groupBy("doc_id").agg(F.min("label").alias("label")))
    draw = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))
    total = max(known.count(), 1)
    rate = min(1.0, 1.2 * sample / total)
    drawn = (known.withColumn("draw", draw).filter(F.pmod("draw", F.lit(1 << 20)) < int(np.ceil(rate * (1 << 20))))
             .orderBy("draw", "doc_id").limit(sample))
    shards = -(-min(sample, total) // per_shard)
    texts = keyed_text(docs, id_col, text_col).join(F.broadcast(drawn), "doc_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        memo = Memo(forms)
        pdf = pdf.assign(size=pdf["text"].map(lambda t: len(t) if t is not None else 0)).sort_values(["draw", "doc_id", "size"])
        examples = [(*features(memo.ids(split_words(t), np.int64), buckets), int(y > 0)) for t, y in zip(pdf["text"], pdf["label"])]
        weights, intercept = ftrl(examples, buckets)
        return pd.DataFrame({"weights": [weights.astype("<f4").tobytes()], "intercept": [intercept], "n": [len(pdf)]})

    # one row of fixed size per shard comes back
    parts = (texts.withColumn("shard", F.pmod(F.shiftright("draw", 24), F.lit(shards))).groupBy("shard")
             .applyInPandas(run, "weights binary, intercept double, n bigint").collect())
    if not parts:
        return QualityModel(np.zeros(buckets), 0.0)
    parts = sorted(parts, key=lambda r: (r["n"], bytes(r["weights"])))
    share = np.array([r["n"] for r in parts], float)
    share /= share.sum()
    return QualityModel(sum(s * np.frombuffer(bytes(r["weights"]), "<f4").astype(float) for s, r in zip(share, parts)),
                        float(sum(s * r["intercept"] for s, r in zip(share, parts))))


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, score (0 to 1), predicted (1 if score >= threshold, else 0).

    Whole texts; null and empty ones have no features and get the intercept's score. Equal texts get equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept))  # fixed size: one float per bucket
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        memo, model = Memo(forms), QualityModel(*shared.value)
        for batch in batches:
            schema = pa.schema([batch.schema.field("doc_id"), pa.field("score", pa.float64()), pa.field("predicted", pa.int32())])
            for part in pieces(batch):
                scores = [model.score(memo.ids(split_words(t), np.int64)) for t in part["text"]]
                yield rows(schema, doc_id=part["doc_id"], score=scores, predicted=[int(s >= threshold) for s in scores])

    return keyed_text(docs, id_col, text_col).mapInArrow(run, f"doc_id {id_type}, score double, predicted int")


def accepted(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at or above the threshold: a filter inside the scan."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept))
    position = docs.columns.index(text_col)

    def run(batches):
        memo, model = Memo(forms), QualityModel(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(position).cast(pa.binary()).to_pylist()
                yield part.filter(pa.array([model.score(memo.ids(split_words(t), np.int64)) >= threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
