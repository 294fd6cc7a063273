"""Token ids in wavelet matrices: one compressed file per shard that answers access, counting and occurrence lookup.

File format. A shard is one zstd-compressed Parquet file; each of its rows is a segment, a run of ids with

* ``shard``, ``segment`` (from 0), ``n_tokens``, ``first_document`` (ordinal in the shard of the segment's first document),
* ``doc_id`` and ``lengths``: the documents whose ids lie here, in order, and how many of their ids do; a document longer than
  a segment goes on in the next, whose ``continues`` is true,
* ``zeros``: per bit-plane the number of zero bits; ``planes``: per bit-plane, the highest bit of the ids first, the bits as
  little-endian 64-bit words and then, as little-endian 32-bit numbers, the ones before each block of 512 bits.

In each plane the ids stand as the planes above sorted them: all with bit 0 first, then all with bit 1, order kept. A rank is a block's
number plus the bits counted in at most eight words; a select is a binary search over the blocks.
"""

from __future__ import annotations

import re
import zlib
from array import array
from itertools import compress

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emipanel.llm.common import Memo, kept_in_worker, rows, slices, stored
from emipanel.session import scratch_dir

END_ID = 2
SEGMENT_TOKENS = 1 << 18
BLOCK_BITS = 512
#: Words up to so many characters are kept in the memo; longer ones are encoded each time.
MEMO_CHARS = 64
#: Letters below this one have been letters in all Unicode versions: a run of them is one pre-token.
PLAIN_LETTERS = "\u0530"
_LETTERS = "".join(c for c in map(chr, range(ord(PLAIN_LETTERS))) if c.isalpha())
#: Words of plain letters and printing ASCII characters, and the tokenizer's pattern on such words.
_PLAIN_WORD = re.compile(f"[!-~{_LETTERS}]+")
_PRE_TOKENS = re.compile(f"'(?:[sdmt]|ll|ve|re)| ?[{_LETTERS}]+| ?[0-9]+| ?[^ 0-9{_LETTERS}]+")
#: Bytes of text whose words are looked up at a time (one longer text is a piece of its own).
TEXT_BYTES = 4 << 20
#: White space beside the space and the line end, and characters that some Unicode versions count as such.
_ODD = [chr(c) for c in (*range(9, 10), *range(11, 14), *range(28, 32), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]
_WHITE = frozenset([" ", "\n", *_ODD])
_PAIRS = [b"  ", b" \n", b"\n ", b"\n\n"]
#: The single bytes among them, and what the bytes of the others begin with.
_CONTROLS = b"\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
_ODD_BYTES = [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe1\xa0\x8e", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80\x80", b"\xef\xbb\xbf"]


class WaveletMatrix:
    """Ids below 2^width. Positions and counts are vectorised: every method takes numbers or arrays."""

    def __init__(self, n: int, zeros, planes: bytes):
        self.n, self.zeros, self.width = n, np.asarray(zeros, np.int64), len(zeros)
        words, blocks = self.shape(n)
        size = 8 * words + 4 * blocks
        whole = np.frombuffer(planes, np.uint8).reshape(self.width, size) if self.width else np.zeros((0, size), np.uint8)
        self.words = [whole[p, :8 * words].view("<u8") for p in range(self.width)]
        self.ones = [whole[p, 8 * words:].view("<u4").astype(np.int64) for p in range(self.width)]

    @staticmethod
    def shape(n: int) -> tuple[int, int]:
        """Words and blocks of a plane; one block more than there are bits for, so that a rank at the end finds one."""
        blocks = n // BLOCK_BITS + 1
        return blocks * (BLOCK_BITS // 64), blocks

    @classmethod
    def encode(cls, ids: np.ndarray, width: int) -> tuple[list[int], bytes]:
        """(zeros, planes) of the ids."""
        ids = np.asarray(ids).astype(np.uint16 if width <= 16 else np.uint32)
        words, blocks = cls.shape(len(ids))
        zeros, out = [], []
        for p in range(width - 1, -1, -1):
            bit = (ids & (1 << p)) != 0
            packed = np.zeros(8 * words, np.uint8)
            some = np.packbits(bit, bitorder="little")
            packed[:len(some)] = some
            counts = np.bitwise_count(packed.view("<u8")).reshape(blocks, -1).sum(axis=1)
            before = np.zeros(blocks, "<u4")
            np.cumsum(counts[:-1], out=before[1:])
            out += [packed.tobytes(), before.tobytes()]
            low = ids.compress(~bit)
            zeros.append(len(low))
            ids = np.concatenate([low, ids.compress(bit)])
        return zeros, b"".join(out)

    def bits(self, p: int, at) -> np.ndarray:
        at = np.asarray(at, np.int64)
        return (self.words[p][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)

    def rank1(self, p: int, at) -> np.ndarray:
        """Ones of a plane before ``at`` (0 to n)."""
        at = np.asarray(at, np.int64)
        word, block = at >> 6, at // BLOCK_BITS
        total = self.ones[p][block]
        for i in range(BLOCK_BITS // 64):
            each = block * (BLOCK_BITS // 64) + i
            inside = np.where(each == word, self.words[p][each] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)), self.words[p][each])
            total = total + np.where(each <= word, np.bitwise_count(inside), 0)
        return total

    def select(self, p: int, bit: int, k) -> np.ndarray:
        """Place of the k-th (from 0) bit of that kind in a plane; it must be there."""
        k = np.asarray(k, np.int64)
        starts = self.ones[p] if bit else np.arange(len(self.ones[p])) * BLOCK_BITS - self.ones[p]
        block = np.searchsorted(starts, k, side="right") - 1
        left, each = k - starts[block], block * (BLOCK_BITS // 64)
        for _ in range(BLOCK_BITS // 64 - 1):
            there = np.bitwise_count(self.words[p][each] if bit else ~self.words[p][each]).astype(np.int64)
            on = left >= there
            # once a word is not skipped, none after it is: what is left stays below its count
            left, each = np.where(on, left - there, left), np.where(on, each + 1, each)
        word = self.words[p][each] if bit else ~self.words[p][each]
        place = np.zeros(np.shape(k), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(word >> place.astype(np.uint64) & np.uint64((1 << half) - 1)).astype(np.int64)
            on = left >= low
            left, place = np.where(on, left - low, left), np.where(on, place + half, place)
        return each * 64 + place

    def access(self, at) -> np.ndarray:
        """The ids at these places."""
        at = np.asarray(at, np.int64)
        out = np.zeros(np.shape(at), np.int64)
        for p in range(self.width):
            bit, ones = self.bits(p, at), self.rank1(p, at)
            out = out << 1 | bit
            at = np.where(bit == 1, self.zeros[p] + ones, at - ones)
        return out

    def span(self, token: int, lo, hi) -> tuple[np.ndarray, np.ndarray]:
        """Where the last plane's order holds the token's occurrences between lo and hi."""
        lo, hi = np.asarray(lo, np.int64), np.asarray(hi, np.int64)
        for p in range(self.width):
            a, b = self.rank1(p, lo), self.rank1(p, hi)
            lo, hi = (self.zeros[p] + a, self.zeros[p] + b) if token >> (self.width - 1 - p) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo=0, hi=None) -> np.ndarray:
        """How often the token stands between lo and hi."""
        if token < 0 or token >> self.width:
            return np.zeros(np.shape(lo), np.int64)
        lo, hi = self.span(token, lo, self.n if hi is None else hi)
        return hi - lo

    def occurrences(self, token: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """All places of the token between lo and hi, ascending."""
        if token < 0 or token >> self.width:
            return np.zeros(0, np.int64)
        first, stop = self.span(token, lo, self.n if hi is None else hi)
        at = np.arange(int(first), int(stop))
        for p in range(self.width - 1, -1, -1):
            bit = token >> (self.width - 1 - p) & 1
            at = self.select(p, bit, at - self.zeros[p] if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids, from the last plane's order back to the first's."""
        ids = np.zeros(self.n, np.uint16 if self.width <= 16 else np.uint32)
        for p in range(self.width - 1, -1, -1):
            bit = np.unpackbits(self.words[p].view(np.uint8), count=self.n, bitorder="little").view(bool)
            back = np.empty_like(ids)
            # what stands below this plane are its zeros in order, then its ones
            ids[self.zeros[p]:] |= ids.dtype.type(1 << (self.width - 1 - p))
            back[np.flatnonzero(~bit)] = ids[:self.zeros[p]]
            back[np.flatnonzero(bit)] = ids[self.zeros[p]:]
            ids = back
        return ids


class WordMemo(Memo):
    """A memo that keeps short words only, so that its entries bound its bytes."""

    def __missing__(self, word):
        return super().__missing__(word) if len(word) <= MEMO_CHARS else self.make(word)


def strings(column: pa.Array) -> pa.Array:
    """UTF-8 bytes as strings; what is no UTF-8 is read as replacement characters."""
    try:
        return column.cast(pa.large_string())
    except pa.ArrowInvalid:
        return pa.array([text.decode(errors="replace") for text in column.to_pylist()], pa.large_string())


def cut_at_spaces(text: str, raw: bytes) -> list[str] | None:
    """The parts between single spaces of a text (``raw``: its bytes), if all white space in it is single spaces and line ends between
    other characters."""
    odd = len(raw.translate(None, _CONTROLS)) < len(raw) or any(map(raw.__contains__, _ODD_BYTES)) and any(map(text.__contains__, _ODD))
    if odd or not raw or any(map(raw.__contains__, _PAIRS)) or raw[0] in b" \n" or raw[-1] in b" \n":
        return None
    return text.split(" ")


def cut_before_spaces(text: str) -> list[str]:
    """Any text cut before those single spaces that stand between two characters that are no white space; the spaces stay."""
    out: list[str] = []
    for part in text.split(" "):
        if out and part and part[0] not in _WHITE and out[-1] and out[-1][-1] not in _WHITE:
            out.append(" " + part)
        elif out:
            out[-1] += " " + part
        else:
            out.append(part)
    return [part for part in out if part]


class ByteEncoder:
    """A text's ids by a byte-level BPE file of the tokenizers library, from a memo of its words.

    The tokenizer's pattern never takes a space into a token that began before it, and takes a single space together with what
    follows it. So where a single space stands between two other characters, the text may be cut before it without changing an id,
    and a text's ids are its words' ids in a row. A special token has no white space in it; its string gives its own id unless
    ``special`` is false.
    """

    def __init__(self, path: str, special: bool = True, most: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # bytes that print stand for themselves, the others for characters from 256 on
        prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = iter(range(256, 512))
        self.letters = {b: chr(b) if b in prints else chr(next(others)) for b in range(256)}
        self.bare, self.spaced = WordMemo(lambda w: self.word(w, ""), most), WordMemo(lambda w: self.word(w, " "), most)

    def encode(self, piece: str) -> bytes:
        """Ids as little-endian 32-bit bytes, by the tokenizer as a whole."""
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str, space: str) -> bytes:
        """A word, after a space or not. Letters, with the space before them, are one pre-token, which the model takes directly. A full
        stop or comma after a letter begins a pre-token, and a line's end between two others is one of its own, so such words are looked
        up in parts that are met again; so are the pre-tokens of other plain words."""
        memo = self.spaced if space else self.bare
        if word.isascii() and word.isalpha():  # these letters stand for themselves
            text = self.letters[32] + word if space else word
            return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
        if word.isalpha() and max(word) < PLAIN_LETTERS:
            text = (space + word).encode().decode("latin-1").translate(self.letters)
            return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
        head, line, tail = word.partition("\n")
        if line and head and tail and head[-1] not in _WHITE and tail[0] not in _WHITE:
            return memo[head] + self.bare["\n"] + self.bare[tail]
        if len(word) > 1 and word[-1] in ".," and word[-2].isalpha() and word[-2] < PLAIN_LETTERS:
            return memo[word[:-1]] + self.bare[word[-1]]
        if _PLAIN_WORD.fullmatch(word) and not any(map(word.__contains__, self.added)):
            first, *others = _PRE_TOKENS.findall(space + word)
            if others:
                return memo[first[len(space):]] + b"".join(map(self.bare.__getitem__, others))
        return self.encode(space + word)

    def ids(self, raw: bytes) -> np.ndarray:
        """Ids of a text in UTF-8 (what is none is read as replacement characters)."""
        return self.column(pa.array([raw], pa.binary()))[0]

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (UTF-8 in binary, none null) in a row, and where each text's ids end. Every distinct word of the column
        is looked up once."""
        lists = pc.split_pattern(strings(texts), " ")
        starts = lists.offsets.to_numpy()
        words = lists.values.dictionary_encode()
        names, at = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()
        # a part begins with a text and after each space that stands between two characters that are no white space
        opens = np.fromiter((not w or w[0] in _WHITE for w in names), bool, len(names))
        closes = np.fromiter((not w or w[-1] in _WHITE for w in names), bool, len(names))
        begins = np.ones(len(at) + 1, bool)
        begins[1:-1] = ~(closes[at[:-1]] | opens[at[1:]])
        begins[starts] = True
        begins = np.flatnonzero(begins)
        firsts = np.searchsorted(begins, starts)
        longer = np.diff(begins) > 1
        alone = longer.copy()
        alone[firsts[:-1]] = True
        # parts of one word after a space are known by the word, the others by themselves
        at_part = at[begins[:-1]]
        used = np.zeros(len(names), bool)
        used[at_part[~alone]] = True
        found = list(map(self.spaced.__getitem__, compress(names, used)))
        entry = (np.cumsum(used) - 1)[at_part]
        entry[alone] = np.arange(len(found), len(found) + np.count_nonzero(alone))
        first = np.zeros(len(alone), bool)
        first[firsts[:-1]] = True
        for i in np.flatnonzero(alone).tolist():
            part = " ".join([names[w] for w in at[begins[i]:begins[i + 1]].tolist()]) if longer[i] else names[at_part[i]]
            found.append((self.bare if first[i] else self.spaced)[part])
        # each part's ids are taken from those of its entry
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        lengths = sizes[entry]
        ends = np.append(0, np.cumsum(lengths))
        source = np.repeat((np.cumsum(sizes) - sizes)[entry] - ends[:-1], lengths)
        source += np.arange(len(source))
        return np.frombuffer(b"".join(found), "<u4")[source], ends[firsts[1:]]


def encode_to_files(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
                    end_id: int = END_ID, segment_tokens: int = SEGMENT_TOKENS) -> str:
    """Write the documents' ids, each document's followed by ``end_id``, as one file per shard in ascending order of ``id_col``; returns
    the folder (a new one beside the checkpoints unless ``path`` is given).

    Null ids come first. Rows with one id go by a digest of their text; equal rows stand side by side, each for itself. Null texts
    are empty, so they give the end id alone. Rows are dealt out by ranges, so a hot id is cut as well. A task holds one segment of
    ids and one text. Other columns are not read.
    """
    file = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    path = path or scratch_dir(spark, "wavelet")
    id_type = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(
        "doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("digest"), F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", "digest", "row"]
    spread = docs.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("shard"))

    def run(batches):
        encoder = kept_in_worker(("byte ids", file), lambda: ByteEncoder(file))
        width = max(encoder.tokenizer.get_vocab_size(), end_id + 1, 2) - 1
        width = width.bit_length()
        schema, shard, segment, ordinal, first, continues = None, 0, 0, -1, 0, False
        held: list[np.ndarray] = []
        names: list = []
        lengths: list[int] = []
        size = 0

        def emit():
            nonlocal segment, held, names, lengths, size
            ids = np.concatenate(held)
            zeros, planes = WaveletMatrix.encode(ids, width)
            record = rows(schema, shard=[shard], segment=[segment], n_tokens=[size], first_document=[first], continues=[continues],
                          doc_id=[names], lengths=[lengths], zeros=[zeros], planes=[planes])
            segment, held, names, lengths, size = segment + 1, [], [], [], 0
            return record

        for batch in batches:
            if schema is None:
                schema = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("n_tokens", pa.int64()), ("first_document", pa.int64()),
                                    ("continues", pa.bool_()), pa.field("doc_id", pa.list_(batch.schema.field("doc_id").type)),
                                    ("lengths", pa.list_(pa.int64())), ("zeros", pa.list_(pa.int64())), ("planes", pa.binary())])
            for part in slices(batch, limit=TEXT_BYTES):
                encoded, ends = encoder.column(part.column("text"))
                for doc, ids, shard in zip(part.column("doc_id").to_pylist(), np.split(encoded, ends[:-1]), part.column("shard").to_pylist()):
                    ids = np.append(ids, np.array([end_id], "<u4"))
                    ordinal, again = ordinal + 1, False
                    while len(ids):
                        if not size:
                            first, continues = ordinal, again
                        # a document is cut only where it is longer than a segment
                        room = segment_tokens - size
                        if len(ids) > room and size and len(ids) <= segment_tokens:
                            yield emit()
                            continue
                        held.append(ids[:room])
                        names.append(doc)
                        lengths.append(min(len(ids), room))
                        size, ids, again = size + lengths[-1], ids[room:], True
                        if size == segment_tokens:
                            yield emit()
        if size:
            yield emit()

    columns = f"shard int, segment int, n_tokens bigint, first_document bigint, continues boolean, doc_id array<{id_type}>, lengths array<bigint>, zeros array<bigint>, planes binary"
    spread.mapInArrow(run, columns).write.option("compression", "zstd").parquet(path)
    return path


def open_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def matrix(row: dict) -> WaveletMatrix:
    return WaveletMatrix(row["n_tokens"], row["zeros"], row["planes"])


def one_by_one(batch: pa.RecordBatch):
    """Rows of a batch, one in memory as Python values at a time."""
    for i in range(batch.num_rows):
        yield {k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()}


def shard_offsets(files: DataFrame) -> DataFrame:
    """shard and the ids in all shards before it; one row per shard."""
    sums = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))


def segment_offsets(files: DataFrame) -> DataFrame:
    """shard, segment and the ids before that segment in all files; one row per segment."""
    inside = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sizes = files.select("shard", "segment", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("start"))
    return sizes.join(shard_offsets(files), "shard").select("shard", "segment", (F.col("start") + F.col("shard_start")).alias("segment_start"))


def joined_crc(first: int, second: int, second_bytes: int) -> int:
    """crc32 of two pieces in a row from theirs: the first is shifted over the second's zero bits by repeated squaring."""

    def times(matrix, vector):
        total, i = 0, 0
        while vector:
            if vector & 1:
                total ^= matrix[i]
            vector, i = vector >> 1, i + 1
        return total

    # one zero bit; bits are reversed, so the polynomial comes in when the lowest leaves
    step = [0xEDB88320, *[1 << i for i in range(31)]]
    bits = 8 * second_bytes
    while bits:
        if bits & 1:
            first = times(step, first)
        step, bits = [times(step, v) for v in step], bits >> 1
    return first ^ second


def documents(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files, the end id included.

    The check number is the unsigned crc32 of the ids as little-endian 32-bit numbers. Documents that lie in several segments are put
    together from their pieces' numbers, one row per piece.
    """
    id_type = files.schema["doc_id"].dataType.elementType.simpleString()

    def run(batches):
        schema = None
        for batch in batches:
            schema = schema or pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("document", pa.int64()), pa.field("doc_id", batch.schema.field("doc_id").type.value_type),
                                          ("inside", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("edge", pa.bool_())])
            for row in one_by_one(batch):
                ids = np.ascontiguousarray(matrix(row).decode().astype("<u4"))
                n = len(row["lengths"])
                ends = np.cumsum(row["lengths"])
                starts = ends - np.array(row["lengths"])
                view = memoryview(ids).cast("B")
                yield rows(schema, shard=[row["shard"]] * n, segment=[row["segment"]] * n, document=np.arange(n) + row["first_document"], doc_id=row["doc_id"],
                           inside=starts, n_tokens=row["lengths"], ids_crc32=[zlib.crc32(view[4 * a:4 * b]) for a, b in zip(starts, ends)],
                           # only a segment's first and last document can lie in another one as well
                           edge=[i in (0, n - 1) for i in range(n)])

    found = files.mapInArrow(run, f"shard int, segment int, document bigint, doc_id {id_type}, inside bigint, n_tokens bigint, ids_crc32 bigint, edge boolean")
    found = stored(found, "read-back").join(segment_offsets(files), ["shard", "segment"]).withColumn("start", F.col("segment_start") + F.col("inside"))
    whole = found.filter("not edge").select("doc_id", "start", "n_tokens", "ids_crc32")

    def together(key, group):
        group = group.sort_by("start")
        crc = 0
        for piece, n in zip(group.column("ids_crc32").to_pylist(), group.column("n_tokens").to_pylist()):
            crc = joined_crc(crc, piece, 4 * n)
        return pa.table({"doc_id": group.column("doc_id")[:1], "start": group.column("start")[:1], "n_tokens": pa.array([sum(group.column("n_tokens").to_pylist())], pa.int64()),
                         "ids_crc32": pa.array([crc], pa.int64())})

    cut = found.filter("edge").select("shard", "document", "doc_id", "start", "n_tokens", "ids_crc32")
    cut = cut.groupBy("shard", "document").applyInArrow(together, f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")
    return whole.unionByName(cut)


def token_counts(files: DataFrame, tokens: list[int]) -> DataFrame:
    """token and n, its occurrences in all files, by rank queries in every segment."""
    tokens = [int(t) for t in dict.fromkeys(tokens)]

    def run(batches):
        for batch in batches:
            for row in one_by_one(batch):
                m = matrix(row)
                yield pa.RecordBatch.from_pydict({"token": pa.array(tokens, pa.int64()), "n": pa.array([int(m.count(t)) for t in tokens], pa.int64())})

    found = files.select("n_tokens", "zeros", "planes").mapInArrow(run, "token bigint, n bigint")
    return found.groupBy("token").agg(F.sum("n").alias("n"))


def token_occurrences(files: DataFrame, tokens: list[int]) -> DataFrame:
    """token, position (among the ids of all documents) and doc_id of every occurrence, by select queries in every segment."""
    tokens = [int(t) for t in dict.fromkeys(tokens)]
    id_type = files.schema["doc_id"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            id_field = batch.schema.field("doc_id").type.value_type
            for row in one_by_one(batch):
                m, ends = matrix(row), np.cumsum(row["lengths"])
                for t in tokens:
                    at = m.occurrences(t)
                    docs = [row["doc_id"][i] for i in np.searchsorted(ends, at, side="right")]
                    yield pa.RecordBatch.from_pydict({"shard": pa.array([row["shard"]] * len(at), pa.int32()), "segment": pa.array([row["segment"]] * len(at), pa.int32()),
                                                      "token": pa.array([t] * len(at), pa.int64()), "inside": pa.array(at, pa.int64()), "doc_id": pa.array(docs, id_field)})

    found = files.mapInArrow(run, f"shard int, segment int, token bigint, inside bigint, doc_id {id_type}")
    return found.join(segment_offsets(files), ["shard", "segment"]).select("token", (F.col("segment_start") + F.col("inside")).alias("position"), "doc_id")


def tokens_at(files: DataFrame, positions: DataFrame, column: str = "position") -> DataFrame:
    """position and token of every asked position (null and out of range ones give no row), by access queries: positions are joined to the
    segments that hold them by a coarse grid, then looked up there."""
    starts = segment_offsets(files)
    spans = files.select("shard", "segment", "n_tokens").join(starts, ["shard", "segment"])
    grid = 1 << 16
    cells = spans.select("shard", "segment", "segment_start", "n_tokens", F.explode(F.sequence(
        F.floor(F.col("segment_start") / grid), F.floor((F.col("segment_start") + F.col("n_tokens") - 1) / grid))).alias("cell"))
    asked = positions.select(F.col(column).cast("long").alias("position")).filter("position is not null").withColumn("cell", F.floor(F.col("position") / grid))
    inside = F.col("position") - F.col("segment_start")
    placed = asked.join(cells, "cell").where((inside >= 0) & (inside < F.col("n_tokens"))).select(
        F.col("shard").alias("in_shard"), F.col("segment").alias("in_segment"), "position", inside.alias("inside"))

    def look_up(key, segments, places):
        row = next(one_by_one(segments.to_batches()[0])) if segments.num_rows else None
        at = places.column("inside").to_numpy()
        found = matrix(row).access(at) if row else np.zeros(0, np.int64)
        return pa.table({"position": places.column("position") if row else pa.array([], pa.int64()), "token": pa.array(found, pa.int64())})

    return (files.select("shard", "segment", "n_tokens", "zeros", "planes").groupBy("shard", "segment")
            .cogroup(placed.groupBy("in_shard", "in_segment")).applyInArrow(look_up, "position bigint, token bigint"))


def token_files(docs: DataFrame, **options) -> DataFrame:
    """Write the documents' ids to files and read them back: doc_id, start, n_tokens, ids_crc32. An empty table gives no rows."""
    return documents(open_files(docs.sparkSession, encode_to_files(docs, **options)))
