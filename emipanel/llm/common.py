"""Helpers shared by the operators: words of a text, batches of bounded size, intermediate tables."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emipanel.session import scratch_dir

#: Entries after which a task's word memo is emptied; it bounds memory, not results.
MEMO_WORDS = 400_000
#: Bytes of text that a kernel works on at a time (one longer text is a piece of its own).
PIECE_BYTES = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the key and the text (as UTF-8 bytes), so other columns of any name cannot clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def stored(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """Write an intermediate table to the shared checkpoint folder and read it back: cuts the lineage and
    keeps the work when executors are lost. ``group_rows``: rows in a row group at most, for rows of megabytes."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    options = {"parquet.block.row.count.limit": group_rows} if group_rows else {}
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_batches_of(spark: SparkSession, size: int):
    """Inside the block Python workers get batches of about ``size`` bytes; for work that ends there."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, f"{size}b")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def split_words(text: bytes | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of a text; none for null. bytes.split() cuts at exactly those six bytes."""
    return text.split() if text else []


class Memo(dict):
    """word -> make(word), computed once per word. Beyond ``most`` entries the memo becomes the older of two generations, which
    bounds memory, not results."""

    def __init__(self, make, most: int = MEMO_WORDS):
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, word):
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        value = self.older.get(word)
        if value is None:
            value = self.make(word)
        self[word] = value
        return value

    def ids(self, words: list[bytes], dtype=np.uint64) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=dtype, count=len(words))


def kept_in_worker(key, make):
    """What make() gives, kept for the tasks that follow in the same Python worker: for memos, never for results."""
    kept = vars(sys.modules.setdefault("_kept_in_worker", types.ModuleType("_kept_in_worker")))
    if key not in kept:
        kept[key] = make()
    return kept[key]


def forgotten_in_worker(key) -> None:
    """Frees what kept_in_worker has kept, if it has, for work after it that needs the memory."""
    if vars(sys.modules.setdefault("_kept_in_worker", types.ModuleType("_kept_in_worker"))).pop(key, None) is not None:
        pa.default_memory_pool().release_unused()


def word_memo() -> Memo:
    return Memo(xxhash.xxh3_64_intdigest)


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut so that each slice holds about ``limit`` bytes of text."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = column.fill_null(b"").cast(pa.large_binary())
    ends = np.cumsum(np.diff(np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset:sizes.offset + len(sizes) + 1]))
    start = 0
    while start < len(column):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def pieces(batch: pa.RecordBatch, text: str = "text", limit: int = PIECE_BYTES) -> Iterator[dict]:
    """The slices of a batch as dicts of Python lists."""
    for part in slices(batch, text, limit):
        yield part.to_pydict()


def rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit numbers over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def crc_mod(column, n: int):
    """crc32(id as text) mod n, the split that the labelled operators hold out by."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))
