"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

The incidence matrix is cut by columns (n-grams), which a shuffle deals out, and only the entries that can decide are built:
of a set of n n-grams in one global order, rarest first, two sets with Jaccard similarity t or more share one among the first
n - ceil(t n) + 1 of either. Documents with equal sets are linked by a digest beforehand, and only the smallest of them goes
into the products. The product runs column by column. A first product multiplies by centres only (the smallest
document of each column), which is linear in the entries; each document keeps the centre with the highest accumulated count
and the exact similarity to it. What these links connect needs no more products. A few more products of that kind follow, each
with other centres (a hash picks them) from components that share a column and are not connected yet, so that a large group of
near copies becomes one component. The last product takes every pair of a column whose documents are not connected yet,
accumulates the pairs' overlap counts, and discards pairs below the bounds that their sizes, and the distances to a centre they
share, imply; what is left is compared exactly. So no pair of documents that could
join two components is left out, and no group of copies is multiplied with itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emipanel.llm.common import keyed_text, mix64, pieces, rows, stored

WORDS = 5
#: Similarity as a fraction, so that bounds are exact integers.
NUM, DEN = 75, 100
#: Most entries of the table of frequent n-grams; it only orders n-grams, results do not depend on it.
FREQUENT = 1 << 16
#: Products with other centres before the last one. They only make the last one smaller, results do not depend on it.
TURNS = 2
#: Columns before a shared one that are looked at for an earlier meeting of the same pair; results do not depend on it.
BEFORE = 8
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_STEP = 0xD1342543DE82EF97
_WHITE = np.isin(np.arange(256), [*b" \t\n\x0b\x0c\r"])
#: A fixed random number per byte, 0 for white space.
_BYTES = np.where(_WHITE, np.uint64(0), mix64(np.arange(1, 257, dtype=np.uint64) * _FACTOR))
#: Words beyond so many bytes are hashed one by one: sums of powers can collide on long strings made for that.
LONG_WORD = 64


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class WordHashes:
    """Text -> 64-bit hashes of its words [^\\x20\\x09-\\x0D]+, all of a text at once: a word's bytes weigh by powers of their place in
    the text, and its sum is taken back to place 0."""

    def __init__(self):
        self.grow(1 << 14)

    def grow(self, n: int):
        self.up, self.down = powers(_STEP, n), powers(pow(_STEP, -1, 1 << 64), n)

    def __call__(self, text: bytes | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint64)
        raw = np.frombuffer(text, np.uint8)
        if len(raw) > len(self.up):
            self.grow(2 * len(raw))
        white = np.ones(len(raw) + 2, bool)
        np.take(_WHITE, raw, out=white[1:-1])
        edges = np.flatnonzero(white[1:] != white[:-1])
        start, stop = edges[::2], edges[1::2]
        if not len(start):
            return np.zeros(0, np.uint64)
        weights = _BYTES[raw]
        weights *= self.up[:len(raw)]
        total = np.cumsum(weights)[stop - 1]
        total[1:] -= total[:-1].copy()
        total *= self.down[start]
        total ^= total >> np.uint64(32)
        total *= _FACTOR
        for i in np.flatnonzero(stop - start > LONG_WORD):
            total[i] = xxhash.xxh3_64_intdigest(text[start[i]:stop[i]])
        return total


def shingles(ids: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words; of fewer words the whole sequence is one; none has none."""
    if len(ids) == 0:
        return ids
    width = min(words, len(ids))
    total = np.full(len(ids) - width + 1, width, np.uint64)
    for k in range(width):
        total *= _FACTOR
        total += ids[k:len(ids) - width + 1 + k]
    total = mix64(total)
    total.sort()
    return total[np.r_[True, total[1:] != total[:-1]]]


def least_common(n: np.ndarray | int, num: int, den: int):
    """ceil(t n)"""
    return -(-n * num // den)


class Text:
    """Text -> its n-gram set."""

    def __init__(self, words: int):
        self.words, self.hashes = words, WordHashes()

    def grams(self, text: bytes | None) -> np.ndarray:
        return shingles(self.hashes(text.lower() if text else text), self.words)


def sizes_and_frequent(texts: DataFrame, words: int, id_type: str) -> DataFrame:
    """One pass: a row (doc_id, n_shingles, digest of the set) per document, and rows (gram, n) of the n-grams that a task has
    met in four documents or more."""
    def run(batches):
        reader = Text(words)
        held: list[np.ndarray] = []
        size, schema = 0, None

        def flush():
            gram, n = np.unique(np.concatenate(held), return_counts=True)
            gram, n = gram[n >= 4], n[n >= 4]
            top = np.argsort(-n, kind="stable")[:4096]
            return rows(schema, doc_id=[None] * len(top), n_shingles=[None] * len(top), digest=[None] * len(top),
                        gram=gram[top].view(np.int64), n=n[top])

        for batch in batches:
            schema = pa.schema([batch.schema.field("doc_id").with_nullable(True), ("n_shingles", pa.int64()),
                                ("digest", pa.binary()), ("gram", pa.int64()), ("n", pa.int64())])
            for part in pieces(batch):
                sets = [reader.grams(t) for t in part["text"]]
                none = [None] * len(sets)
                yield rows(schema, doc_id=part["doc_id"], n_shingles=[len(s) for s in sets],
                           digest=[xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], gram=none, n=none)
                held += [s for s in sets if len(s)]
                size += sum(map(len, sets))
                if size > 4_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return texts.mapInArrow(run, f"doc_id {id_type}, n_shingles bigint, digest binary, gram bigint, n bigint")


def equal_sets(passed: DataFrame) -> DataFrame:
    """Links (a, b): every document b of one text whose set is that of others, with the smallest doc_id of those."""
    single = (passed.filter("doc_id is not null").groupBy("doc_id")
              .agg(F.count(F.lit(1)).alias("texts"), F.max("digest").alias("digest")).filter("texts = 1 and digest is not null"))
    firsts = single.groupBy("digest").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return single.join(firsts, "digest").filter("doc_id <> a").select("a", F.col("doc_id").alias("b"))


def frequent_grams(counts: DataFrame, most: int = FREQUENT) -> np.ndarray:
    """Hashes of the n-grams that many documents hold, rarest first, at most ``most``: a documented bound of what is sent to
    the tasks. They only order n-grams."""
    top = counts.filter("gram is not null").groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(most).collect()
    return np.array([r["gram"] for r in reversed(top)], np.int64).view(np.uint64)


def entries(texts: DataFrame, order: np.ndarray, words: int, num: int, den: int, id_type: str) -> DataFrame:
    """The deciding entries of the incidence: gram, doc_id, n (size of the set)."""
    shared = texts.sparkSession.sparkContext.broadcast(order)

    def run(batches):
        reader = Text(words)
        frequent = shared.value
        where = np.argsort(frequent, kind="stable")
        known = frequent[where]
        for batch in batches:
            schema = pa.schema([("gram", pa.int64()), pa.field("doc_id", batch.schema.field("doc_id").type), ("n", pa.int64())])
            for part in pieces(batch):
                grams, at_row, sizes = [], [], []
                for row, (doc, text) in enumerate(zip(part["doc_id"], part["text"])):
                    s = reader.grams(text)
                    if not len(s) or doc is None:
                        continue
                    prefix = len(s) - int(least_common(len(s), num, den)) + 1
                    if len(known):
                        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        rank = np.where(known[at] == s, where[at] + 1, 0)
                        s = s[np.argsort(rank, kind="stable")]
                    grams.append(s[:prefix])
                    at_row.append(np.full(prefix, row))
                    sizes.append(np.full(prefix, len(s), np.int64))
                if grams:
                    docs = pa.array(part["doc_id"], schema.field("doc_id").type).take(pa.array(np.concatenate(at_row)))
                    yield rows(schema, gram=np.concatenate(grams).view(np.int64), doc_id=docs, n=np.concatenate(sizes))

    return texts.mapInArrow(run, f"gram bigint, doc_id {id_type}, n bigint")


def columns_with_centres(cells: DataFrame, id_type: str) -> DataFrame:
    """Entries of columns that hold two documents or more, each with its column's centre: the smallest doc_id. The entries
    come sorted by column and document, so the pass holds one batch at a time."""
    def run(batches):
        gram = centre = size = None
        waiting = True
        for batch in batches:
            g = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(g):
                continue
            d, n = batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
            schema = pa.schema([("gram", pa.int64()), pa.field("doc_id", batch.schema.field(1).type), ("n", pa.int64()),
                                pa.field("centre", batch.schema.field(1).type), ("centre_n", pa.int64())])
            first = np.r_[g[0] != gram if gram is not None else True, g[1:] != g[:-1]]
            start = np.maximum.accumulate(np.where(first, np.arange(len(g)), -1))
            # start < 0: goes on with the column of the batch before
            if not first[0] and waiting:  # the centre's own row was the last of the batch before
                yield rows(schema, gram=[gram], doc_id=[centre], n=[size], centre=[centre], centre_n=[size])
            # members, and the centres that a member follows
            index = np.nonzero(~first | np.r_[~first[1:], False])[0]
            own = index[start[index] >= 0]
            carried = len(index) - len(own)
            of = pa.array(start[own])
            yield rows(schema, gram=g[index], doc_id=d.take(pa.array(index)),
                       n=n[index], centre=pa.concat_arrays([pa.array([centre] * carried, d.type), d.take(of)]),
                       centre_n=np.r_[np.full(carried, size or 0, np.int64), n[start[own]]])
            waiting = bool(first[-1])
            if start[-1] >= 0:
                gram, centre, size = g[-1], d[int(start[-1])].as_py(), int(n[start[-1]])

    sorted_cells = cells.repartition("gram").sortWithinPartitions("gram", "doc_id")
    return sorted_cells.mapInArrow(run, f"gram bigint, doc_id {id_type}, n bigint, centre {id_type}, centre_n bigint")


def overlaps(pairs: DataFrame, texts: DataFrame, words: int, id_type: str) -> DataFrame:
    """Exact sizes for pairs (a, b): a, b, common, either (sizes of intersection and union)."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def run(batches):
        reader, seen = Text(words), {}

        def grams(doc, text):  # rows of one document can hold different texts
            if (doc, text) not in seen:
                if len(seen) >= 64:
                    seen.clear()
                seen[doc, text] = reader.grams(text)
            return seen[doc, text]

        for batch in batches:
            field = batch.schema.field("a")
            schema = pa.schema([field, pa.field("b", field.type), ("common", pa.int64()), ("either", pa.int64())])
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128).to_pydict()
                common, either = [], []
                for a, b, s, t in zip(part["a"], part["b"], part["text_a"], part["text_b"]):
                    x = grams(a, s)
                    y = reader.grams(t)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    common.append(both)
                    either.append(len(x) + len(y) - both)
                yield rows(schema, a=part["a"], b=part["b"], common=common, either=either)

    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, f"a {id_type}, b {id_type}, common bigint, either bigint")


def components(links: DataFrame, id_type: str) -> DataFrame:
    """(doc_id, component_id) of all documents in a link (a, b): the smallest id that links reach.

    Every document takes the smallest label among itself and its neighbours, then its label's label, until nothing changes;
    labels are written out each round. Neighbours' labels are combined before the shuffle, so a star costs its edges only.
    """
    edges = stored(links.select(F.col("a").alias("x"), F.col("b").alias("y"))
                   .unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y"))).filter("x <> y").distinct(), "edges")
    labels = edges.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("label")).withColumnRenamed("x", "doc_id")
    labels = stored(labels, "labels")
    while True:
        spread = (edges.join(labels.withColumnRenamed("doc_id", "y"), "y").groupBy("x").agg(F.min("label").alias("near"))
                  .withColumnRenamed("x", "doc_id"))
        nearer = labels.join(spread, "doc_id").select("doc_id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("doc_id").alias("label"), F.col("label").alias("further"))
        new = stored(nearer.join(jump, "label", "left").select("doc_id", "was", F.least("label", "further").alias("label")), "labels")
        done = new.filter(F.col("was") != F.col("label")).isEmpty()
        labels = new.select("doc_id", "label")
        if done:
            return labels.withColumnRenamed("label", "component_id")


def near(a: str, b: str, num: int, den: int):
    """Bound from sizes: t n_a <= n_b for n_b <= n_a."""
    return F.least(F.col(a), F.col(b)) * den >= F.greatest(F.col(a), F.col(b)) * num


def best_centres(met: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (doc_id, n, centre, centre_n), one per shared column -> (a, b): every document b with the centre a that it shares most
    columns with. Too few of them give no row: half of what a link needs, as some shared columns have other centres."""
    counted = met.groupBy("doc_id", "centre", "n", "centre_n").agg(F.count(F.lit(1)).alias("c"))
    deciding = (F.col("n") + F.col("centre_n")) * num / (num + den) - F.greatest("n", "centre_n") * num / den
    best = counted.filter(F.col("c") * 2 >= deciding).groupBy("doc_id").agg(
        F.max_by("centre", F.struct("c", F.xxhash64("centre"))).alias("centre"))
    return best.select(F.col("centre").alias("a"), F.col("doc_id").alias("b"))


def open_columns(placed: DataFrame) -> DataFrame:
    """Entries of columns whose documents are in two components or more."""
    spread = placed.groupBy("gram").agg(F.min("component_id").alias("lo"), F.max("component_id").alias("hi")).filter("lo < hi")
    return placed.join(spread.select("gram"), "gram")


def other_centres(entries: DataFrame, turn: int) -> DataFrame:
    """(doc_id, n, centre, centre_n): for each entry a document of the same column in another component. A column has two
    centres, from the components that come first and last in the turn's hash order."""
    order = F.xxhash64("component_id", F.lit(turn))
    who = [F.xxhash64("doc_id", F.lit(turn)).alias("h"), F.col("doc_id"), F.col("n"), F.col("component_id")]
    two = entries.groupBy("gram").agg(F.min(F.struct(order.alias("o"), *who)).alias("lo"),
                                      F.min(F.struct(F.bitwise_not(order).alias("o"), *who)).alias("hi"))
    centre = F.when(F.col("component_id") == F.col("lo.component_id"), F.col("hi")).otherwise(F.col("lo"))
    return (entries.join(two, "gram").withColumn("centre", centre)
            .select("doc_id", "n", F.col("centre.doc_id").alias("centre"), F.col("centre.n").alias("centre_n")))


def least_shared(a: str, b: str, num: int, den: int):
    """Deciding entries that sets of sizes a and b must share to link: the overlap ceil(t / (1 + t) (a + b)), less all that can
    follow the deciding ones of the larger set."""
    overlap = F.ceil(F.expr(f"({a} + {b}) * {num} / {num + den}D") - 1e-9)
    return F.greatest(overlap - F.ceil(F.expr(f"greatest({a}, {b}) * {num} / {den}D") - 1e-9) + 1, F.lit(1))


def fewest_shared(n: str, lo: str, hi: str, num: int, den: int):
    """The smallest least_shared(n, b) for lo <= b <= hi. Up to n it grows with b. Beyond, each of its two ceilings may step alone,
    but s = ceil(1 / t) sizes further the first has stepped once at most and the second once at least, so the last s sizes hold
    the smallest."""
    last = [least_shared(n, f"greatest({hi} - {back}, {lo}, {n})", num, den) for back in range(-(-den // num))]
    return F.least(least_shared(n, lo, num, den), *last)


def open_lists(entries: DataFrame, num: int, den: int) -> DataFrame:
    """A row per document of open columns: its columns (m documents, gram), least filled first, and k, the fewest of them that
    a partner can share. The sizes met in a column bound k (see fewest_shared); a document with fewer columns than that can link
    with none that is not connected yet, and has 0 columns. Such rows are to be filtered out of the written table: before, the filter
    would be moved below the projections, where a list is sorted again for each of its columns."""
    spans = entries.groupBy("gram").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    met = (entries.join(spans, "gram").withColumn("lo", F.greatest("lo", F.expr(f"ceil(n * {num} / {den}D - 1e-9)")))
           .withColumn("hi", F.least("hi", F.expr(f"floor(n * {den} / {num}D + 1e-9)"))).filter("lo <= hi"))
    lists = (met.withColumn("k", fewest_shared("n", "lo", "hi", num, den))
             .groupBy("doc_id", "n", "component_id", "star", "far").agg(F.sort_array(F.collect_set(F.struct("m", "gram", "k"))).alias("cells")))
    for _ in range(2):  # a column whose partners would have to share more columns than there are leads to no link
        lists = lists.withColumn("cells", F.expr("filter(cells, x -> x.k <= size(cells))"))
    return lists.withColumn("cols", F.size("cells")).withColumn("k", F.array_min("cells.k"))


def meetings(lists: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (a, n, b, n_b): pairs of documents in different components at the columns where they meet.

    Two documents that share k columns have the first of these, in an order common to all, among the first cols - k + 1 of
    either, so they are multiplied in those, the least filled ones, only. A meeting counts once: where the ``BEFORE`` columns before
    it in either list have one in common, the pair has met already, as all other conditions hold there as well. So a pair gives a row
    for each of its shared columns that follows none so closely, not for each that it shares.
    """
    grams = lists.select("doc_id", "n", "component_id", "star", "far", "cols", "k", F.col("cells.gram").alias("grams"))
    entries = grams.select("*", F.posexplode("grams").alias("at", "gram"))
    keys = ["doc_id", "n", "component_id", "star", "far", "cols"]
    probes = entries.filter("at <= cols - k").withColumn("before", F.expr(f"slice(grams, greatest(at - {BEFORE}, 0) + 1, least(at, {BEFORE}))"))
    probes = probes.select("gram", "at", "before", *keys)
    other = probes.select("gram", *[F.col(c).alias(f"{c}_b") for c in ["at", "before", *keys]])
    return (probes.join(other, "gram").filter(F.col("component_id") != F.col("component_id_b")).filter(near("n", "n_b", num, den))
            .filter("cols < cols_b or (cols = cols_b and doc_id < doc_id_b)")
            .filter(F.least(F.col("cols") - F.col("at"), F.col("cols_b") - F.col("at_b")) >= least_shared("n", "n_b", num, den))
            # Jaccard distance is a metric: documents too unlike in their distance to one centre cannot link
            .filter((F.col("star") != F.col("star_b")) | (F.abs(F.col("far") - F.col("far_b")) * den <= den - num + 1e-6))
            .filter(~F.arrays_overlap("before", "before_b"))
            .select(F.col("doc_id").alias("a"), "n", F.col("doc_id_b").alias("b"), "n_b"))


def possible_pairs(lists: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of documents in different components that share enough columns to link: the whole overlap of columns is counted for
    the distinct pairs that meet."""
    pairs = meetings(lists, num, den).distinct()
    columns = lists.select("doc_id", "n", F.col("cells.gram").alias("cells"))
    both = pairs.join(columns.toDF("a", "n", "cells_a"), ["a", "n"]).join(columns.toDF("b", "n_b", "cells_b"), ["b", "n_b"])
    shared = F.size(F.array_intersect("cells_a", "cells_b"))
    return both.filter(shared >= least_shared("n", "n_b", num, den)).select("a", "b")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, num: int = NUM,
                      den: int = DEN) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included).

    A-Z is lower-cased; a document's set has its distinct runs of ``words`` words, or its whole text if shorter. Null, empty and
    blank texts have no set and link with nothing. Two documents link when den * intersection >= num * union. Rows that share a
    doc_id are one document, which links when one of its texts does; its n_shingles is the largest. Rows with a null key are left out.
    Texts are read three times and shuffled once, to bring together those that share a column with another.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = keyed_text(docs, id_col, text_col).filter(F.col("doc_id").isNotNull())
    passed = stored(sizes_and_frequent(texts, words, id_type), "sizes")
    order = frequent_grams(passed)
    copies = stored(equal_sets(passed), "copies")
    texts = texts.join(copies.select(F.col("b").alias("doc_id")), "doc_id", "left_anti")
    cells = stored(columns_with_centres(entries(texts, order, words, num, den, id_type), id_type), "cells")

    def linked(compared):
        return compared.filter(F.col("common") * den >= F.col("either") * num).select("a", "b")

    stars = cells.filter((F.col("doc_id") != F.col("centre")) & near("n", "centre_n", num, den))
    best = best_centres(stars.select("doc_id", "n", "centre", "centre_n"), num, den)
    # texts of documents that share a column with another: all that is compared from here on
    held = stored(texts.join(cells.select("doc_id").distinct(), "doc_id", "left_semi"), "texts")
    first = stored(overlaps(stored(best, "stars"), held, words, id_type), "first")
    joined = components(linked(first), id_type)

    # columns whose documents are still in two components or more
    to_centre = first.select(F.col("b").alias("doc_id"), F.col("a").alias("star"),
                             (1 - F.col("common") / F.col("either")).alias("far"))
    placed = (cells.select("gram", "doc_id", "n").join(joined, "doc_id", "left")
              .withColumn("component_id", F.coalesce("component_id", "doc_id")).join(to_centre, "doc_id", "left")
              .withColumn("star", F.coalesce("star", "doc_id")).withColumn("far", F.coalesce("far", F.lit(0.0))))
    rest = stored(open_columns(placed), "open")
    compared = first
    for turn in range(TURNS):
        met = other_centres(rest, turn).filter((F.col("doc_id") != F.col("centre")) & near("n", "centre_n", num, den))
        best = best_centres(met, num, den).join(compared.select("a", "b"), ["a", "b"], "left_anti")
        more = stored(overlaps(stored(best, "stars"), held, words, id_type), "turn")
        compared = compared.unionByName(more)
        if linked(more).isEmpty():
            break
        at = rest.select("doc_id", "component_id").distinct()
        edges = (linked(more).join(at.toDF("a", "x"), "a").join(at.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b")))
        moved = components(edges, id_type).toDF("component_id", "into")
        rest = stored(open_columns(rest.join(moved, "component_id", "left")
                                   .withColumn("component_id", F.coalesce("into", "component_id")).drop("into")), "open")

    lists = stored(open_lists(rest, num, den), "lists").filter("cols > 0")
    open_pairs = possible_pairs(lists, num, den).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(
        compared.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    second = overlaps(stored(open_pairs, "open-pairs"), held, words, id_type)
    final = components(stored(linked(compared.unionByName(second)).unionByName(copies), "links"), id_type)

    sizes = passed.filter("doc_id is not null").groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    return (sizes.join(final, "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))

