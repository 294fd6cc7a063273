"""Packing documents into token windows: bounded-space online packing.

Each task keeps a fixed number of open windows. A document's full windows leave at once; its rest is placed into the open
window that it fits best. When it fits none, the fullest window is topped up with the head of the rest and emitted, and the
tail is placed anew. What is left open at the end of a task is merged: windows are filled in turn until one is left, and
those of many tasks are merged the same way in rounds, so that the last one is all that may be padded.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emipanel.llm.common import Memo, kept_in_worker, keyed_text, pieces, rows, split_words, stored

WINDOW = 2048
OPEN_WINDOWS = 64
#: Tasks whose leftovers (under one window each) are merged in one group.
MERGE_GROUP = 256
END_ID = 1

_FIELDS = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
           ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]
_SQL = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def word_tokens(path: str) -> Memo:
    """word -> its ids as little-endian 32-bit bytes. The tokenizer lower-cases, cuts at white space and drops it, and nothing of
    its normalising reaches across it, so a text's ids are its words' ids in a row. A single full stop or comma after a letter is
    a token of its own, so it is looked up apart and more words are met again."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def make(word: bytes) -> bytes:
        lower = word.lower()  # ASCII letters only; the tokenizer does the others
        if lower != word and b"<|" not in word:
            return memo[lower]
        if len(word) > 1 and word[-1] in b".," and 97 <= word[-2] <= 122:
            return memo[word[:-1]] + memo[word[-1:]]
        return np.array(tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    memo = Memo(make, 500_000)
    return memo


class Packer:
    """Pieces are (doc, start, doc_tokens, ids); a window is a list of pieces with its filling."""

    def __init__(self, window: int, open_windows: int, number):
        self.window, self.most, self.number = window, open_windows, number
        self.open: list[list] = []
        self.used: list[int] = []
        self.out: list[tuple] = []
        self.count = 0

    def emit(self, pieces):
        at, sequence = 0, self.number(self.count)
        self.count += 1
        for doc, start, total, ids in pieces:
            self.out.append((doc, start, total, ids, sequence, at))
            at += len(ids)

    def add(self, doc, start, total, ids):
        while len(ids) >= self.window:
            self.emit([(doc, start, total, ids[:self.window])])
            start, ids = start + self.window, ids[self.window:]
        if not len(ids):
            return
        best, room = -1, self.window + 1
        for i, used in enumerate(self.used):
            if len(ids) <= self.window - used < room:
                best, room = i, self.window - used
        if best < 0 and len(self.open) < self.most:
            self.open.append([(doc, start, total, ids)])
            self.used.append(len(ids))
            return
        if best < 0:  # fits none: the fullest is topped up and leaves
            best = max(range(len(self.used)), key=self.used.__getitem__)
            head = self.window - self.used[best]
            self.emit([*self.open.pop(best), (doc, start, total, ids[:head])])
            self.used.pop(best)
            self.add(doc, start + head, total, ids[head:])
        elif room == len(ids):
            self.emit([*self.open.pop(best), (doc, start, total, ids)])
            self.used.pop(best)
        else:
            self.open[best].append((doc, start, total, ids))
            self.used[best] += len(ids)

    def leftovers(self):
        """Fill the open windows from one another, the fullest first; the pieces of the one that stays open."""
        order = sorted(range(len(self.open)), key=lambda i: (-self.used[i], i))
        queue = [p for i in order for p in self.open[i]]
        self.open, self.used, held, used = [], [], [], 0
        for doc, start, total, ids in queue:
            while used + len(ids) >= self.window:
                head = self.window - used
                self.emit([*held, (doc, start, total, ids[:head])])
                held, used, start, ids = [], 0, start + head, ids[head:]
            if len(ids):
                held.append((doc, start, total, ids))
                used += len(ids)
        return held

    def take(self):
        out, self.out = self.out, []
        return out


def _record(schema, placed, with_ids, loose=()):
    """Placed pieces and loose ones (no sequence yet; they carry their ids)."""
    everything = [*placed, *[(*p, None, None) for p in loose]]
    ids = [np.ascontiguousarray(p[3]).tobytes() for p in everything]
    return rows(schema, doc_id=[p[0] for p in everything], start=[p[1] for p in everything], length=[len(p[3]) for p in everything],
                ids_crc32=[zlib.crc32(i) for i in ids], doc_tokens=[p[2] for p in everything],
                sequence_id=[p[4] for p in everything], offset=[p[5] for p in everything],
                ids=[i if with_ids or p[4] is None else None for p, i in zip(everything, ids)])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = WINDOW,
         open_windows: int = OPEN_WINDOWS, merge_group: int = MERGE_GROUP, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ``ids`` on request.

    A document's ids are the tokenizer's for its text and then END_ID, so null and empty texts are the one id END_ID. Each id
    lies in exactly one piece. Repeated rows are packed each for itself. No sequence is longer than ``window``; all but one per
    last merge group are exactly full. Whole texts are read once, in the tasks that Spark gives them; memory is the open windows
    and one text. ``tokenizer`` is the path of a tokenizer file. Sequence ids depend on how the table is split into tasks.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    id_field = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        memo, task, schema = kept_in_worker(("tokens", path), lambda: word_tokens(path)), TaskContext.get().partitionId(), None
        packer = Packer(window, open_windows, lambda n: (task << 32) + n)
        for batch in batches:
            schema = schema or pa.schema([batch.schema.field("doc_id"), *[pa.field(*f) for f in _FIELDS], pa.field("task", pa.int64())])
            for part in pieces(batch):
                for doc, text in zip(part["doc_id"], part["text"]):
                    ids = np.frombuffer(b"".join([*map(memo.__getitem__, split_words(text)), END_ID.to_bytes(4, "little")]), "<u4")
                    packer.add(doc, 0, len(ids), ids)
                yield tagged(schema, packer.take(), [], task)
        if schema is not None:
            loose = packer.leftovers()
            yield tagged(schema, packer.take(), loose, task)

    def tagged(schema, placed, loose, task):
        bare = pa.schema(list(schema)[:-1])
        record = _record(bare, placed, with_ids, loose)
        return pa.RecordBatch.from_arrays([*record.columns, pa.array([task] * record.num_rows, pa.int64())], schema=schema)

    packed = stored(keyed_text(docs, id_col, text_col).mapInArrow(run, f"doc_id {id_field}, {_SQL}, task bigint"), "packed")

    def merge(last):
        def run_group(key, group):
            slot = int(key[0].as_py())
            packer = Packer(window, 1, lambda n: -1 - ((slot << 32) + n))
            group = group.sort_by([("task", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
            packer.open = [[(d, s, t, np.frombuffer(i, "<u4")) for d, s, t, i in
                            zip(*(group.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")))]]
            packer.used = [0]
            loose = packer.leftovers()
            if last:
                packer.emit(loose) if loose else None
                loose = []
            schema = pa.schema([group.schema.field("doc_id"), *[pa.field(*f) for f in _FIELDS]])
            record = _record(schema, packer.take(), with_ids, loose)
            return pa.Table.from_batches([record]).append_column("task", pa.array([slot] * record.num_rows, pa.int64()))

        return run_group

    done = packed.filter(F.col("sequence_id").isNotNull())
    open_pieces = packed.filter(F.col("sequence_id").isNull())
    merged = (open_pieces.withColumn("slot", F.floor(F.col("task") / merge_group)).groupBy("slot")
              .applyInArrow(merge(True), f"doc_id {id_field}, {_SQL}, task bigint"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    return done.select(columns).unionByName(merged.select(columns))
