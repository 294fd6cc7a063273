"""Alignment of two tokenizers over the same bytes, and how often their ids meet in the corpus.

Both tokenizers' tokens end at byte offsets. Dictionaries lead from an end to its token; the ends that both have, sorted, cut both
id lists into groups, and a group's tokens are expanded to the pairs whose bytes overlap. Both cut before a single space between
two other characters, so a text is aligned word by word and a word that was met before is not aligned again.

Corpus-wide counts of id pairs don't fit a task. A batch of documents keeps its pairs once, as a table, and its documents refer to
them by number; pairs are counted and joined per batch, not per document, and come back to their batch as two arrays.
"""

from __future__ import annotations

import hashlib
import struct
from array import array
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emipanel.llm.common import arrow_batches_of, forgotten_in_worker, kept_in_worker, keyed_text, pieces, rows, stored
from emipanel.llm.wavelet import _WHITE, MEMO_CHARS, PLAIN_LETTERS, ByteEncoder, cut_at_spaces, cut_before_spaces

#: Bytes of text whose pairs are kept in one table (a longer text is a batch of its own).
BATCH_BYTES = 2 << 20
#: Batches in a row group of their file: so many are in memory when they are written and read, however long a task's input is.
GROUP_ROWS = 4
#: Words (and parts of such) after which a task's memo becomes the older of two generations.
MEMO_WORDS = 150_000
LOW = (1 << 32) - 1
#: What a word's record begins with (tokens of both kinds, groups, links), and its bytes.
_HEAD, _HEAD_BYTES = "<4I", 16
#: Words that the second tokenizer reads at a time.
READ_WORDS = 4096


def align(ids_a, sizes_a, ids_b, sizes_b) -> tuple[list, list]:
    """(groups, links) of two id lists over the same bytes. A group is (a ids, b ids) between ends that both lists have; a link is a pair
    of ids whose byte ranges overlap."""
    groups, links, i, j, n_a, n_b = [], [], 0, 0, len(ids_a), len(ids_b)
    from_i = from_j = done = 0
    left, right = sizes_a[0] if n_a else 0, sizes_b[0] if n_b else 0
    while i < n_a and j < n_b:
        links.append((ids_a[i], ids_b[j]))
        # the token that ends first passes its partner on to its successor; where both end, so does the group
        if left < right:
            right, i = right - left, i + 1
            left = sizes_a[i] if i < n_a else 0
        elif right < left:
            left, j = left - right, j + 1
            right = sizes_b[j] if j < n_b else 0
        else:
            i, j = i + 1, j + 1
            groups.append((ids_a[from_i:i], ids_b[from_j:j]))
            from_i, from_j, done = i, j, len(links)
            left, right = sizes_a[i] if i < n_a else 0, sizes_b[j] if j < n_b else 0
    return groups, links[:done]


class Aligner:
    """Aligns words, each as if a space stood before it, which is what both tokenizers see inside a text."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = ByteEncoder(path_a, special=False, most=20_000)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        backend = self.a.tokenizer
        self.size_a = [len(backend.id_to_token(i) or "") for i in range(backend.get_vocab_size())]
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.size_b = list(map(len, self.bytes_b))
        self.names = list(map(str, range(max(len(self.size_a), len(self.size_b)))))
        # a piece with a space after another character could join what a cut parts
        self.cuts = not any("▁" in p.lstrip("▁") for p in names)
        # a line's end is a byte of its own; after it, and before a full stop or comma after a letter, no piece goes on
        self.line = self.b.encode("\n")
        self.parts = (self.cuts and len(self.line) == 2 and names[self.line[0]] == "▁" and self.bytes_b[self.line[1]] == b"\n"
                      and not any("\n" in p or any(x.isalpha() and x < PLAIN_LETTERS and y in ".," for x, y in zip(p, p[1:])) for p in names))
        self.known: dict = {}
        self.older: dict = {}

    def words(self, raw: bytes | None) -> list[str]:
        """The words of a text; each but the first stood after a space, which is left away. A text that is no UTF-8 has none."""
        text = (raw or b"").decode(errors="replace")
        if not text or "\ufffd" in text and text.encode() != raw:
            return []
        if not self.cuts:
            return [text]
        parts = cut_at_spaces(text, raw)
        if parts is None:
            parts = cut_before_spaces(text)
            parts = [parts[0], *[p[1:] for p in parts[1:]]]
        return parts

    def atoms(self, word: str) -> list:
        """The word's parts, each of which both tokenizers read alone: the first (str) stood after a space, the others (bytes) did not."""
        if not self.parts or word.isalpha():
            return [word]
        head, line, tail = word.partition("\n")
        if line and head and tail and head[-1] not in _WHITE and tail[0] not in _WHITE:
            first, *others = self.atoms(tail)
            return [*self.atoms(head), b"\n", first.encode(), *others]
        if len(word) > 1 and word[-1] in ".," and word[-2].isalpha() and word[-2] < PLAIN_LETTERS:
            return [*self.atoms(word[:-1]), word[-1].encode()]
        return [word]

    def learn(self, words: list[str]) -> list[bytes]:
        """Per word its record: _HEAD, eight bytes per link (its code) and the groups as text; empty where the bytes differ."""
        new, known, older = [], self.known, self.older
        # a known word is a part of its own
        parts = [[word] if word in known else self.atoms(word) for word in words]
        for atom in dict.fromkeys(chain.from_iterable(parts)):
            if atom not in known:
                if atom in older:
                    known[atom] = older[atom]
                else:
                    new.append(atom)
        texts = [atom if isinstance(atom, str) else "\n" + atom.decode() for atom in new]
        read = (self.b.encode(texts[i:i + READ_WORDS], num_threads=1) for i in range(0, len(texts), READ_WORDS))
        for atom, text, ids_b in zip(new, texts, chain.from_iterable(read)):
            known[atom] = self.record(text, " ", ids_b) if isinstance(atom, str) else self.record(text[1:], "", ids_b[2:])
        out = []
        for atoms in parts:
            if len(atoms) == 1:
                out.append(known[atoms[0]])
                continue
            records = [known[atom] for atom in atoms]
            if all(records):
                heads = [struct.unpack_from(_HEAD, r) for r in records]
                ends = [_HEAD_BYTES + 8 * h[3] for h in heads]
                codes, groups = [r[_HEAD_BYTES:e] for r, e in zip(records, ends)], [r[e:] for r, e in zip(records, ends)]
                out.append(struct.pack(_HEAD, *map(sum, zip(*heads))) + b"".join(codes) + b";".join(groups))
            else:
                out.append(b"")
        for atom in new:
            if len(atom) > MEMO_CHARS:
                del known[atom]
        if len(known) > MEMO_WORDS:
            self.older, self.known = known, {}
        return out

    def record(self, word: str, space: str, ids_b: list[int]) -> bytes:
        if b"".join([self.bytes_b[i] for i in ids_b]) != (space + word).encode():
            return b""
        ids_a = memoryview(self.a.word(word, space)).cast("I").tolist()
        size_a, size_b, names = self.size_a, self.size_b, self.names
        groups, links = align(ids_a, [size_a[i] for i in ids_a], ids_b, [size_b[i] for i in ids_b])
        text = ";".join([f"{','.join([names[i] for i in a])}|{','.join([names[i] for i in b])}" for a, b in groups])
        return struct.pack(_HEAD, len(ids_a), len(ids_b), len(groups), len(links)) + array("q", [a << 32 | b for a, b in links]).tobytes() + text.encode()


class Numbers(dict):
    """Numbers words in the order in which they are met."""

    def __missing__(self, word):
        number = self[word] = len(self)
        return number


def parts_of(records: list[bytes]) -> tuple[np.ndarray, list[bytes], list[bytes]]:
    """The numbers (a row per record, zeros for an empty one), the link codes and the groups as text of the records."""
    sizes = np.frombuffer(b"".join([r[:_HEAD_BYTES] or bytes(_HEAD_BYTES) for r in records]), "<u4").reshape(-1, 4).astype(np.int64)
    ends = (_HEAD_BYTES + 8 * sizes[:, 3]).tolist()
    return sizes, [r[_HEAD_BYTES:e] for r, e in zip(records, ends)], [r[e:] for r, e in zip(records, ends)]


def squeezed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32: how many, then all their lowest bytes, all their second and so on, compressed."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return struct.pack("<I", len(numbers)) + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def unsqueezed(raw: bytes) -> np.ndarray:
    n, = struct.unpack_from("<I", raw)
    planes = pa.Codec("zstd").decompress(raw[4:], decompressed_size=4 * n, asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(4, n).T.copy().view("<u4")[:, 0]


def _aligner(path_a, path_b):
    return kept_in_worker(("aligner", path_a, path_b), lambda: Aligner(path_a, path_b))


def _no_aligner(path_a, path_b):
    forgotten_in_worker(("aligner", path_a, path_b))


def _paths(byte_bpe, piece_model):
    return byte_bpe or public_tokenizers.path("byte_bpe_50k.json"), piece_model or public_tokenizers.path("piece_bpe_32k.model")


def _running(values: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, 2, ... values."""
    out = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=out[1:])
    return out


_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def aligned_batches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str | None = None,
                    piece_model: str | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per batch of documents: arrays over its documents (doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_words), over its
    distinct pairs (``pair``: a id shifted by 32 bits and b id, ``n``), and squeezed its documents' words (``words``: each document's in
    ascending order, as steps modulo 2^32), each word's links (``word_links``) and each link's pair (``links``), all as numbers."""
    path_a, path_b = _paths(byte_bpe, piece_model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        aligner, task, count, schema = _aligner(path_a, path_b), TaskContext.get().partitionId(), 0, None
        for batch in batches:
            longs = pa.list_(pa.int64())
            schema = schema or pa.schema([("batch", pa.int64()), pa.field("doc_id", pa.list_(batch.schema.field("doc_id").type)), *[(c, longs) for c in _NUMBERS],
                                          ("groups_sha256", pa.list_(pa.string())), ("n_words", longs), ("pair", longs), ("n", longs),
                                          ("words", pa.binary()), ("word_links", pa.binary()), ("links", pa.binary())])
            for part in pieces(batch, limit=batch_bytes):
                yield rows(schema, batch=[(task << 32) + count], **{k: [v] for k, v in pack(aligner, part).items()})
                count += 1

    def pack(aligner, part):
        numbers = Numbers()
        lists = []
        for text in part["text"]:
            words = aligner.words(text)
            lists.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        records = aligner.learn(list(numbers))
        good = np.fromiter(map(bool, records), bool, len(records))
        sizes, codes, texts = parts_of(records)
        out = {c: [] for c in (*_NUMBERS, "groups_sha256", "n_words")}
        kept = []
        for words in lists:
            ok = len(words) and good[words].all()
            words = words if ok else words[:0]
            # sums don't ask for the words' order, and steps between sorted numbers are small
            kept.append(np.sort(words))
            for c, v in zip(_NUMBERS, sizes[words].sum(axis=0)):
                out[c].append(int(v))
            out["groups_sha256"].append(hashlib.sha256(b";".join([texts[w] for w in words.tolist()])).hexdigest() if ok else "")
            out["n_words"].append(len(words))
        words = np.concatenate([*kept, np.zeros(0, np.int64)])
        often = np.bincount(words, minlength=len(records))
        pairs, place = np.unique(np.frombuffer(b"".join(codes), np.int64), return_inverse=True)
        n = np.bincount(place, weights=np.repeat(often, sizes[:, 3]), minlength=len(pairs)).astype(np.int64)
        return out | {"doc_id": part["doc_id"], "pair": pairs, "n": n, "words": squeezed(np.diff(words, prepend=0)),
                      "word_links": squeezed(sizes[:, 3]), "links": squeezed(place)}

    columns = ", ".join(["batch bigint", f"doc_id array<{id_type}>", *[f"{c} array<bigint>" for c in _NUMBERS], "groups_sha256 array<string>", "n_words array<bigint>",
                         "pair array<bigint>", "n array<bigint>", "words binary", "word_links binary", "links binary"])
    return keyed_text(docs, id_col, text_col).mapInArrow(run, columns)


def batch_pairs(batches: DataFrame) -> DataFrame:
    """batch, at (the pair's number there), pair and n, without pairs that only documents without tokens have."""
    return (batches.select("batch", F.posexplode(F.arrays_zip("pair", "n")).alias("at", "p"))
            .select("batch", "at", F.col("p.pair").alias("pair"), F.col("p.n").alias("n")).filter("n > 0"))


def pair_counts(pairs: DataFrame, b_ids: int = 32_000) -> DataFrame:
    """pair, count (links in the corpus) and best (no pair with that b id has more). One row per b id is broadcast, so at most the size of
    the second vocabulary, ``b_ids``; without that bound Spark decides."""
    counts = stored(pairs.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    best = counts.groupBy(F.col("pair").bitwiseAND(LOW).alias("b")).agg(F.max("count").alias("most"))
    best = F.broadcast(best) if b_ids <= 1_000_000 else best
    counts = counts.withColumn("b", F.col("pair").bitwiseAND(LOW))
    return counts.join(best, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str | None = None, piece_model: str | None = None,
            batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    The first tokenizer reads a space and the text, the second, which adds the space itself, the text; special tokens' strings are
    plain text. Null and empty texts, and texts whose tokens of either kind don't join to the same bytes, have zeros and an empty
    digest, and their links count nowhere. Repeated rows count each for itself; other columns are not read. ``n_best`` is the links whose
    pair is among the most frequent of its b id in the corpus, ``count_sum`` the sum of its links' corpus-wide counts.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    paths = _paths(byte_bpe, piece_model)
    # a little under four batches at a time, so that no small one is left over
    with arrow_batches_of(docs.sparkSession, 15 * batch_bytes // 4):
        batches = stored(aligned_batches(docs, id_col, text_col, *paths, batch_bytes), "aligned", GROUP_ROWS)
    looked_up = batch_pairs(batches).drop("n").join(pair_counts(batch_pairs(batches)), "pair").select(F.col("batch").alias("of"), "at", "count", "best")

    def finish(key, batch, found):
        _no_aligner(*paths)
        kind = batch.schema.field("doc_id").type.value_type
        out = {c: [] for c in ("doc_id", *_NUMBERS, "n_best", "count_sum", "groups_sha256")}
        for row in batch.to_pylist():
            at = found.column("at").to_numpy()
            count, best = np.zeros(row["n_pairs"], np.int64), np.zeros(row["n_pairs"], np.int64)
            count[at], best[at] = found.column("count").to_numpy(), found.column("best").to_numpy(zero_copy_only=False)
            links, per_word, words = unsqueezed(row["links"]), unsqueezed(row["word_links"]), np.cumsum(unsqueezed(row["words"]), dtype=np.uint32)
            n_words = np.array(row["n_words"], np.int64)
            ends = np.cumsum(n_words)
            for name, values in (("count_sum", count), ("n_best", best)):
                # running sums over links, then over words: their differences are a word's and a document's sum
                by_word = np.diff(_running(values[links])[_running(per_word)])
                by_doc = _running(by_word[words])
                out[name] += (by_doc[ends] - by_doc[ends - n_words]).tolist()
            for c in ("doc_id", *_NUMBERS, "groups_sha256"):
                out[c] += row[c]
        types = {"doc_id": kind, "groups_sha256": pa.string()}
        return pa.table({c: pa.array(v, types.get(c, pa.int64())) for c, v in out.items()})

    columns = ", ".join([f"doc_id {id_type}", *[f"{c} bigint" for c in (*_NUMBERS, "n_best", "count_sum")], "groups_sha256 string"])
    batches = batches.withColumn("n_pairs", F.size("pair")).drop("pair", "n")
    return batches.groupBy("batch").cogroup(looked_up.groupBy("of")).applyInArrow(finish, columns)


def token_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str | None = None, piece_model: str | None = None) -> DataFrame:
    """The alignment itself: doc_id, group (from 0), start and stop (bytes of the space and the text), a_ids and b_ids of every group."""
    path_a, path_b = _paths(byte_bpe, piece_model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        aligner, schema = _aligner(path_a, path_b), None
        for batch in batches:
            schema = schema or pa.schema([batch.schema.field("doc_id"), ("group", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()),
                                          ("a_ids", pa.list_(pa.int64())), ("b_ids", pa.list_(pa.int64()))])
            for part in pieces(batch):
                for doc, text in zip(part["doc_id"], part["text"]):
                    words = aligner.words(text)
                    distinct = list(dict.fromkeys(words))
                    records = aligner.learn(distinct)
                    if not words or not all(records):
                        continue
                    found = dict(zip(distinct, parts_of(records)[2]))
                    groups = [[[*map(int, side.split(b","))] for side in g.split(b"|")] for w in words for g in found[w].split(b";")]
                    stops = np.cumsum([sum(aligner.size_a[i] for i in a) for a, _ in groups])
                    yield rows(schema, doc_id=[doc] * len(groups), group=range(len(groups)), start=[0, *stops[:-1]], stop=stops,
                               a_ids=[a for a, _ in groups], b_ids=[b for _, b in groups])

    return keyed_text(docs, id_col, text_col).mapInArrow(run, f"doc_id {id_type}, group bigint, start bigint, stop bigint, a_ids array<bigint>, b_ids array<bigint>")
