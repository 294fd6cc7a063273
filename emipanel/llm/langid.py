"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter holds the n-grams of all languages at once: each of its cells is a bitmask with a bit per language, and
the AND of an n-gram's cells is the set of all languages that contain it, however rarely. A second set of bits holds those of them
in which it is common, relative to the others. In either set an n-gram of m languages counts 1 / m for each of them, so what many share
decides little; each language's count is corrected for the false positives that its filling implies, and the highest sum decides.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emipanel.llm.common import keyed_text, mix64, pieces, rows

#: Bytes per n-gram.
SIZES = (3, 5)
#: Cells of the filter (a power of two) and probes per n-gram.
CELLS, PROBES = 1 << 23, 2
#: Most documents per language that the filters are learned from, drawn by a hash of the key.
SAMPLE = 3000
#: An n-gram is common in a language if its share of the language's n-grams is at least this part of its highest share.
RELATIVE = 0.15
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_ONES = np.array([bin(m).count("1") for m in range(256)])
_BLANK = bytes(32 if c < 33 or chr(c) in "0123456789.,;:!?%&$#*|\"()[]{}+=/_-@<>" and c < 128 else c for c in range(256))


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in _LETTER.findall(text.decode()))


def grams(text: bytes) -> np.ndarray:
    """Hashes of the byte n-grams of a text in lower case, digits and punctuation as blanks, with a blank at both ends."""
    flat = b" " + text.lower().translate(_BLANK) + b" " * max(SIZES)
    b = np.frombuffer(flat, np.uint8).astype(np.uint64)
    count = len(text) + 1
    out, packed = [], np.zeros(count, np.uint64)
    for k in range(max(SIZES)):
        packed = (packed << np.uint64(8)) | b[k:k + count]
        if k + 1 in SIZES:
            out.append(mix64(packed + np.uint64((k + 1) << 56)))
    return np.concatenate(out)


def probes(hashes: np.ndarray, cells: int) -> list[np.ndarray]:
    return [((hashes >> np.uint64(29 * k)) & np.uint64(cells - 1)).astype(np.int64) for k in range(PROBES)]


class Filters:
    """Languages, and per plane of eight languages the filter's cells as bytes: planes of all n-grams, then those of the common ones."""

    def __init__(self, languages: list[str], planes: list[np.ndarray], common: str | None):
        self.languages, self.planes, self.common = languages, planes, common
        self.false = [np.array([((p >> k) & 1).mean() ** PROBES for k in range(8)]) for p in planes]

    def decide(self, text: bytes | None) -> tuple[str, float]:
        if text is None or not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0
        at = probes(grams(text), len(self.planes[0]))
        share, half = 0.0, len(self.planes) // 2
        for level in (slice(0, half), slice(half, None)):
            masks = []
            for plane in self.planes[level]:
                mask = plane[at[0]]
                for more in at[1:]:
                    mask = mask & plane[more]
                masks.append(mask)
            weight = 1.0 / np.maximum(sum(_ONES[m] for m in masks), 1)
            total, shares = weight.sum(), []
            for mask, false in zip(masks, self.false[level]):
                by_mask = np.bincount(mask, weights=weight, minlength=256)
                hits = np.array([by_mask[(np.arange(256) >> k) & 1 == 1].sum() for k in range(8)])
                shares.append(np.maximum((hits - total * false) / (1 - np.minimum(false, 0.999)), 0.0))
            share = share + np.concatenate(shares)[:len(self.languages)]
        if share.max() <= 0:
            return self.common, 0.0
        best = int(share.argmax())  # of equal ones the first by code point
        return self.languages[best], float(share[best] / share.sum())


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE,
          cells: int = CELLS, seed: int = 11) -> Filters:
    """Filters from labelled documents; rows with a null language or text teach nothing. At most ``sample`` documents per
    language are read (a few more where draws tie), chosen by a hash of the key, so a language of any size costs the same.

    Languages are expected to be few: one filter plane of ``cells`` bytes for eight of them is sent to the tasks.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Filters([], [np.zeros(cells, np.uint8)] * 2, None)
    languages = sorted(counts)
    rates = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(int(min(1.0, sample / counts[lang]) * (1 << 30))))])
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col).cast("string")), F.lit(1 << 30))
    drawn = known.filter(draw <= rates[F.col(lang_col).cast("string")])
    number = {lang: i for i, lang in enumerate(languages)}
    texts = keyed_text(drawn.select(F.col(lang_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")))

    def run(batches):
        schema = pa.schema([("gram", pa.int64()), ("lang", pa.int32()), ("n", pa.int64())])
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def flush():
            for lang, arrays in held.items():
                gram, n = np.unique(np.concatenate(arrays), return_counts=True)
                yield rows(schema, gram=gram.view(np.int64), lang=np.full(len(gram), lang, np.int32), n=n)
            held.clear()

        for batch in batches:
            for part in pieces(batch):
                for lang, text in zip(part["doc_id"], part["text"]):
                    g = grams(text)
                    held.setdefault(number[lang], []).append(g)
                    size += len(g)
                if size > 6_000_000:
                    yield from flush()
                    size = 0
        yield from flush()

    counted = texts.mapInArrow(run, "gram bigint, lang int, n bigint").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    n_planes = -(-len(languages) // 8)
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))  # one row per language
    share = counted.join(F.broadcast(totals), "lang").select("gram", F.struct("lang", (F.col("n") / F.col("total")).alias("share")).alias("of"))
    of_gram = share.groupBy("gram").agg(F.collect_list("of").alias("of"), F.max("of.share").alias("top"))  # a row per language at most
    common = F.expr(f"transform(filter(of, x -> x.share >= top * {RELATIVE}D), x -> x.lang + {8 * n_planes})")
    kept = of_gram.select("gram", F.explode(F.concat("of.lang", common)).alias("lang"))
    # bits are OR-ed per cell and come back one row per plane block
    block = 1 << 16

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(block, np.uint8)
        np.bitwise_or.at(bits, pdf["cell"].to_numpy() & (block - 1), (1 << (pdf["lang"].to_numpy() % 8)).astype(np.uint8))
        return pd.DataFrame({"plane": [int(pdf["plane"].iloc[0])], "block": [int(pdf["block"].iloc[0])], "bits": [bits.tobytes()]})

    def spread(batches):
        for batch in batches:
            pdf = batch.to_pandas()
            at = probes(pdf["gram"].to_numpy().view(np.uint64), cells)
            out = pd.DataFrame({"cell": np.concatenate(at), "lang": np.tile(pdf["lang"].to_numpy(), PROBES)}).drop_duplicates()
            yield pa.RecordBatch.from_pandas(out.astype({"cell": "int64", "lang": "int32"}), preserve_index=False)

    slices = (kept.mapInArrow(spread, "cell bigint, lang int").distinct()
              .withColumn("plane", F.floor(F.col("lang") / 8).cast("int")).withColumn("block", F.floor(F.col("cell") / block).cast("int"))
              .groupBy("plane", "block").applyInPandas(fill, "plane int, block int, bits binary").collect())
    planes = [np.zeros(cells, np.uint8) for _ in range(2 * n_planes)]
    for r in slices:
        planes[r["plane"]][r["block"] * block:(r["block"] + 1) * block] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return Filters(languages, planes, max(languages, key=lambda x: (counts[x], x)))


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score (its share of the corrected counts, 0 to 1).

    ``und`` with score 0 for null texts and texts without a letter; a text none of whose n-grams is known is said to be in the
    most frequent language, with score 0. Whole texts, inside the scan; repeated rows are judged each for itself.
    """
    shared = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.planes, filters.common))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        filters = Filters(*shared.value)
        for batch in batches:
            schema = pa.schema([batch.schema.field("doc_id"), ("lang_pred", pa.string()), ("score", pa.float64())])
            for part in pieces(batch):
                found = [filters.decide(t) for t in part["text"]]
                yield rows(schema, doc_id=part["doc_id"], lang_pred=[f[0] for f in found], score=[f[1] for f in found])

    return keyed_text(docs, id_col, text_col).mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")
