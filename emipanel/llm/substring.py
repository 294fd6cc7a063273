"""Substring dedup by recompression.

Rounds over a text's words name runs of an equal symbol and pairs of neighbouring symbols. A name is a hash of what it stands
for, and whether a pair is joined depends on its two symbols alone, so the rounds name globally without an exchange: in equal
passages all symbols are equal, but for a few at the edges. Of each window of words the symbols are followed that no
context outside it can change; the longest of them (the window's anchor) is therefore the same wherever the window stands, and
windows next to each other mostly share one. Per anchor one row is shuffled: its symbol and a digest of the words that its
windows span. Symbols that only one document holds end there. Where all spans of a shared symbol are equal they are verified
repeats; where they differ, one document per distinct span is expanded into its windows, which are compared by digest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emipanel.llm.common import keyed_text, mix64, pieces, rows, split_words, stored, word_memo

WINDOW = 50
#: Rounds: R names runs, P names pairs.
ROUNDS = "RPPRPPRPP"
#: Levels that anchors are taken from: the highest first, the words themselves last (a window always has those).
LEVELS = (9, 4, 0)
#: No symbol stands for more words than this.
LONGEST = 24


class Parse:
    """Symbols of some texts in a row after each round, with where they start and how bounds move one level up.

    ``fresh`` marks the words that begin a text; no symbol reaches over such a place. ``first[k][i]`` is the symbol that begins
    what is certain at level k + 1 if symbol i does at level k; ``last[k][j]`` is the same for exclusive ends.
    """

    def __init__(self, words: np.ndarray, fresh: np.ndarray):
        self.symbols, self.fresh = [words], fresh
        self.starts = [np.arange(len(words), dtype=np.int32)]
        self.sizes = [np.ones(len(words), np.int32)]
        self.first: list[np.ndarray] = []
        self.last: list[np.ndarray] = []
        for level, kind in enumerate(ROUNDS):
            (self._runs if kind == "R" else self._pairs)(np.uint64((level + 1) * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF))

    def _add(self, head, symbols, sizes, first, last):
        up = np.cumsum(head, dtype=np.int32)  # one more than the symbol of the next level
        heads = np.flatnonzero(head)
        ends = np.empty(len(head) + 1, np.int32)
        ends[:-1], ends[-1] = up - 1, len(heads)
        self.first.append(np.append(ends[first], np.int32(len(heads))))
        self.last.append(np.concatenate([np.zeros(1, np.int32), last(up)]))
        self.symbols.append(symbols[heads])
        self.sizes.append(sizes[heads])
        self.starts.append(self.starts[-1][heads])
        self.fresh = self.fresh[heads]

    def _runs(self, salt):
        s, size = self.symbols[-1], self.sizes[-1]
        new = self.fresh.copy()
        new[1:] |= s[1:] != s[:-1]
        begin = np.flatnonzero(new).astype(np.int32)
        length = np.diff(begin, append=np.int32(len(s)))
        run = np.cumsum(new, dtype=np.int32) - 1
        short = (length > 1) & (length * size[begin] <= LONGEST)
        symbols, sizes = s.copy(), size.copy()
        at = begin[short]
        symbols[at] = mix64(s[at] ^ (length[short].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt))
        sizes[at] *= length[short]
        # the run at the beginning may go on outside, and so may the one at the end
        self._add(new | ~short[run], symbols, sizes, (begin + length)[run], lambda up: up[begin[run]] - 1)

    def _pairs(self, salt):
        s, size = self.symbols[-1], self.sizes[-1]
        right = (mix64(s + salt) & np.uint64(1)).astype(bool)
        joined = np.zeros(len(s), bool)
        joined[:-1] = ~right[:-1] & right[1:] & ~self.fresh[1:] & (size[:-1] + size[1:] <= LONGEST)
        head = np.ones(len(s), bool)
        head[1:] = ~joined[:-1]
        symbols, sizes = s.copy(), size.copy()
        at = np.flatnonzero(joined)
        symbols[at] = mix64(s[at] * np.uint64(0x9E3779B97F4A7C15) + mix64(s[at + 1] + salt))
        sizes[at] += size[at + 1]
        # a right symbol at the beginning may belong to one outside, a left symbol at the end likewise
        place = np.arange(len(s), dtype=np.int32)
        self._add(head, symbols, sizes, place + right, lambda up: np.where(right, up, up - 1))


def anchors(words: np.ndarray, lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """For the windows of texts that stand in a row, grouped by the anchor they share: arrays of the anchor's symbol, its first
    word, the first window's start (both counted over all texts) and the number of windows."""
    stop = np.cumsum(lengths)
    left = np.repeat(stop, lengths) - np.arange(len(words))
    starts = np.flatnonzero(left >= window)
    if not len(starts):
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    fresh = np.zeros(len(words), bool)
    fresh[(stop - lengths)[lengths > 0]] = True
    parse, count = Parse(words, fresh), len(starts)
    symbol, place = np.zeros(count, np.uint64), np.full(count, -1, np.int64)
    lo, hi = starts, starts + window
    bounds = {0: (lo, hi)}
    for level in range(len(ROUNDS)):
        lo, hi = parse.first[level][lo], parse.last[level][hi]
        if level + 1 in LEVELS:
            bounds[level + 1] = (lo, hi)
    for level in LEVELS:
        lo, hi = bounds[level]
        todo = np.flatnonzero((place < 0) & (lo < hi))
        if not len(todo):
            continue
        lo, hi = lo[todo], hi[todo]
        s = parse.symbols[level]
        # longest first, then by hash, then the leftmost: all from what the window holds
        key = (np.minimum(parse.sizes[level], 31).astype(np.uint64) << np.uint64(58)) | (mix64(s ^ np.uint64(77)) >> np.uint64(6))
        best = np.arange(len(s))
        span, step = hi - lo, 1
        choice = np.full(len(todo), -1, np.int64)
        while True:  # maxima over 1, 2, 4 ... symbols; each window is covered by two of them
            mine = (span >= step) & (span < 2 * step)
            if mine.any():
                a, b = best[lo[mine]], best[hi[mine] - step]
                choice[mine] = np.where(key[b] > key[a], b, a)
            if not (span >= 2 * step).any():
                break
            a, b = best[:-step], best[step:]
            best = np.where(key[b] > key[a], b, a)
            step *= 2
        symbol[todo], place[todo] = s[choice] + np.uint64(level), parse.starts[level][choice]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (symbol[1:] != symbol[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    return symbol[new], place[new], starts[new], np.diff(new, append=count)


def _joined(words: list[bytes]) -> tuple[bytes, np.ndarray]:
    """Words joined by one space, and where each begins (and, at the end, where a next one would)."""
    return b" ".join(words), np.r_[0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)]


def _digests(text: bytes, place: np.ndarray, first: np.ndarray, stop: np.ndarray) -> list[bytes]:
    begins, ends = place[first].tolist(), (place[stop] - 1).tolist()
    return [xxhash.xxh3_128_digest(text[a:b]) for a, b in zip(begins, ends)]


def versioned_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Key and text, with ``version``, a hash that tells texts of one doc_id apart: places in a text hold for that text only."""
    return keyed_text(docs, id_col, text_col).withColumn("version", F.xxhash64("text"))


def anchor_rows(texts: DataFrame, window: int, id_type: str) -> DataFrame:
    def run(batches):
        memo = word_memo()
        for batch in batches:
            schema = pa.schema([("symbol", pa.int64()), ("span", pa.binary()), batch.schema.field("doc_id"), ("version", pa.int64()),
                                ("at", pa.int64()), ("n", pa.int64())])
            for part in pieces(batch):
                texts_words = [split_words(t) if d is not None else [] for d, t in zip(part["doc_id"], part["text"])]
                lengths = np.array([len(w) for w in texts_words], np.int64)
                flat = [w for words in texts_words for w in words]
                symbol, place, at, n = anchors(memo.ids(flat), lengths, window)
                if not len(symbol):
                    continue
                whole, begins = _joined(flat)
                owner = np.searchsorted(np.cumsum(lengths), at, side="right")
                # what the windows span, and where in it their anchor stands
                spans = [d + p for d, p in zip(_digests(whole, begins, at, at + n + window - 1),
                                               map(bytes, (place - at).astype("<i4").view("u1").reshape(-1, 4)))]
                yield rows(schema, symbol=symbol.view(np.int64), span=spans, doc_id=[part["doc_id"][i] for i in owner.tolist()],
                           version=[part["version"][i] for i in owner.tolist()], at=at - (np.cumsum(lengths) - lengths)[owner], n=n)

    return texts.mapInArrow(run, f"symbol bigint, span binary, doc_id {id_type}, version bigint, at bigint, n bigint")


def window_rows(texts: DataFrame, window: int, id_type: str) -> DataFrame:
    """Texts with ``parts`` (starts and numbers of windows) -> a row per window: digest, doc_id, at."""
    def run(batches):
        for batch in batches:
            schema = pa.schema([("digest", pa.binary()), batch.schema.field("doc_id"), ("version", pa.int64()), ("at", pa.int64())])
            for part in pieces(batch):
                for doc, version, text, spans in zip(part["doc_id"], part["version"], part["text"], part["parts"]):
                    whole, begins = _joined(split_words(text))
                    at = np.unique(np.concatenate([np.arange(p["at"], p["at"] + p["n"]) for p in spans]))
                    yield rows(schema, digest=_digests(whole, begins, at, at + window), doc_id=[doc] * len(at),
                               version=[version] * len(at), at=at)

    return texts.mapInArrow(run, f"digest binary, doc_id {id_type}, version bigint, at bigint")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Windows of ``window`` words whose word sequence also starts in a document with a smaller id: doc_id, version (of its
    text), at, n (n windows in a row from word ``at``)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = versioned_text(docs, id_col, text_col)
    found = stored(anchor_rows(texts, window, id_type), "anchors")
    shared = (found.groupBy("symbol").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("span").alias("s0"), F.max("span").alias("s1"))
              .filter("lo < hi").select("symbol", "lo", (F.col("s0") == F.col("s1")).alias("same")))
    met = stored(found.join(shared, "symbol"), "met")
    whole = met.filter("same and doc_id > lo").select("doc_id", "version", "at", "n")
    # spans that differ around one symbol: equal ones are settled by their first document, which alone is expanded
    mixed = met.filter("not same").select("symbol", "span", "doc_id", "version", "at", "n")
    firsts = mixed.groupBy("symbol", "span").agg(F.min("doc_id").alias("lo"))
    settled = stored(mixed.join(firsts, ["symbol", "span"]), "settled")
    equal = settled.filter("doc_id > lo").select("doc_id", "version", "at", "n")
    parts = settled.filter("doc_id = lo").groupBy("doc_id", "version").agg(F.collect_list(F.struct("at", "n")).alias("parts"))
    windows = stored(window_rows(texts.join(parts, ["doc_id", "version"]), window, id_type), "windows")
    lowest = windows.groupBy("digest").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi")
    single = windows.join(lowest, "digest").filter("doc_id > lo").select("doc_id", "version", "at", F.lit(1).cast("bigint").alias("n"))
    return whole.unionByName(equal).unionByName(single)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, and on request ``kept`` (the kept words joined by a space).

    A word is removed if a window that covers it also starts in a document with a smaller id. Null texts have no words; texts
    shorter than a window keep all. Rows that share an id are not repeats of one another; a null id is compared with nothing.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    found = repeats(docs, id_col, text_col, window)
    cuts = found.groupBy("doc_id", "version").agg(F.collect_list(F.struct("at", "n")).alias("cuts"))
    texts = versioned_text(docs, id_col, text_col).join(cuts, ["doc_id", "version"], "left")

    def run(batches):
        for batch in batches:
            fields = [batch.schema.field("doc_id"), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
            schema = pa.schema(fields + ([("kept", pa.string())] if with_text else []))
            for part in pieces(batch):
                out = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
                for text, spans in zip(part["text"], part["cuts"]):
                    words = split_words(text)
                    kept = words
                    if spans:
                        depth = np.zeros(len(words) + 1, np.int64)
                        at = np.array([p["at"] for p in spans])
                        stop = np.minimum(at + np.array([p["n"] for p in spans]) + window - 1, len(words))
                        np.add.at(depth, at, 1)
                        np.add.at(depth, stop, -1)
                        kept = [w for w, d in zip(words, np.cumsum(depth[:-1]).tolist()) if not d]
                    whole = b" ".join(kept)
                    out["n_words"].append(len(words))
                    out["n_removed"].append(len(words) - len(kept))
                    out["kept_sha256"].append(hashlib.sha256(whole).hexdigest())
                    out["kept"].append(whole.decode() if with_text else None)
                yield rows(schema, doc_id=part["doc_id"], **out)

    return texts.mapInArrow(run, f"doc_id {id_type}, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept string" if with_text else ""))
