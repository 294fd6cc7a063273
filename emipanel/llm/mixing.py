"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sizes are aggregated per source; targets come from weights and caps; the mix's blocks are apportioned to sources, and
each source's blocks to its shards, by the highest quotients weight / (2 k - 1). Within a shard the documents, in an
order drawn from a seed, form a tape that is cut into blocks; the shard's quota takes whole passes over the tape and
then its first blocks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emipanel.llm.common import stored

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
REPEATS = 2.0
BLOCK = 16
#: Words per shard of a source: a source, however large, is cut into shards of about this size.
SHARD_WORDS = 1 << 19


def n_words(text):
    """Number of [^\\x20\\x09-\\x0D]+ in a text (null: 0): word starts are counted without building the words."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(spaced, " ", -1), lambda w: w != "")).cast("long")


def seats(weights: np.ndarray, total: int, caps: np.ndarray) -> np.ndarray:
    """Sainte-Lague: ``total`` seats to the highest quotients w / (2 k - 1), no party beyond its cap.

    The seats of all quotients at or above a divisor are counted in closed form, so a bisection finds the divisor and
    only the quotients next to it are ranked. Ties go to the earlier party. Fewer seats only if all caps are reached.
    """
    w = np.maximum(np.asarray(weights, float), 0.0)
    caps = np.where(w > 0, np.asarray(caps, np.int64), 0)
    total = int(min(total, caps.sum()))

    def held(divisor):  # quotients >= divisor, within the caps
        return np.minimum(np.floor((w / divisor + 1) / 2).astype(np.int64), caps)

    if total <= 0:
        return np.zeros(len(w), np.int64)
    high = float(w.max()) * 2
    low = high
    while held(low).sum() < total:
        low /= 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if held(mid).sum() >= total else (low, mid)
    got = held(high)
    while (short := total - int(got.sum())) > 0:
        quotient = np.where(got < caps, w / (2 * got + 1), -1.0)
        best = np.argsort(-quotient, kind="stable")[:short]
        best = best[quotient[best] >= quotient[best[0]] * (1 - 1e-12)]
        got[best] += 1
    return got


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """sizes (source, source_size) -> + target: ``share`` of all words by weight, at most ``repeats`` times the source.

    Sources stand by code point, null last, and weigh ``weights`` in turn. The excess of capped sources goes to the others
    by weight until none is above its cap; which are capped follows from one pass in order of cap / weight: those for
    which even the level that is left when all before them are capped reaches the cap. It works on one row per source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8")))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(repeats))
    ranked = sizes.withColumn("rank", rank).withColumn("weight", w).withColumn("cap", cap)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = ranked.withColumn("level", left / weight_left).withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
    # after the first source that is not capped levels fall and ratios rise, so no later one is capped
    free = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    first = level.withColumn("free", free)
    target = F.when(F.col("capped") | F.col("free").isNull(), F.col("cap")).otherwise(F.least(F.col("weight") * F.col("free"), F.col("cap")))
    return first.select("source", "source_size", "rank", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS,
        share: float = SHARE, repeats: float = REPEATS, block: int = BLOCK, shard_words: int = SHARD_WORDS,
        seed: int = 42) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target (its source's), taken.

    ``taken`` counts the words that the mix takes of the document, repeats included: whole passes plus the part of it that
    lies in the chosen blocks; never more than ``repeats`` times its size. Null and empty texts have size 0 and are taken 0
    times. A null source is a source of its own. Rows with equal ids are documents of their own; where even their texts are
    equal they are interchangeable. The same input gives the same mix, however it is partitioned.

    The texts are read once; key, size and source of each row are kept in the checkpoint folder and are all that is
    shuffled. A source is cut into shards of ``shard_words`` words, so no group grows with its source.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"),
                        F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(text_col)).alias("draw"))
    id_type = docs.schema[id_col].dataType.simpleString()
    sized = stored(sized, "mix-sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, repeats)

    def quota(pdf):
        blocks = int(round(pdf["target"].sum() / block))
        caps = -(-np.floor(pdf["source_size"].to_numpy() * repeats).astype(np.int64) // block)
        pdf = pdf.sort_values("rank")
        return pdf.assign(blocks=seats(pdf["target"].to_numpy(), blocks, caps[pdf.index]))

    per_source = (targets.withColumn("one", F.lit(1)).groupBy("one")
                  .applyInPandas(lambda pdf: quota(pdf.reset_index(drop=True))[["source", "source_size", "rank", "target", "blocks"]],
                                 "source string, source_size bigint, rank int, target double, blocks bigint"))
    per_source = per_source.withColumn("shards", F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)))
    # one row per source: small enough to send along, unless there are very many sources
    placed = (sized.join(per_source.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
              .withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "draw"), F.col("shards"))))
    shards = placed.groupBy("rank", "shard", "blocks").agg(F.sum("size").alias("shard_size"))

    def shard_quota(pdf):
        pdf = pdf.sort_values("shard")
        caps = -(-np.floor(pdf["shard_size"].to_numpy() * repeats).astype(np.int64) // block)
        pdf["shard_blocks"] = seats(pdf["shard_size"].to_numpy(), int(pdf["blocks"].iloc[0]), caps)
        return pdf[["rank", "shard", "shard_size", "shard_blocks"]]

    quotas = shards.groupBy("rank").applyInPandas(shard_quota, "rank int, shard bigint, shard_size bigint, shard_blocks bigint")
    tape = Window.partitionBy("rank", "shard").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wanted = F.least(F.col("shard_blocks") * block, F.floor(F.col("shard_size") * F.lit(float(repeats))))
    passes = F.when(F.col("shard_size") > 0, F.floor(wanted / F.col("shard_size"))).otherwise(0)
    rest = wanted - passes * F.col("shard_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("end") - F.col("size"))))
    return (placed.join(quotas, ["rank", "shard"]).withColumn("end", F.sum("size").over(tape))
            .select(F.col("doc_id").cast(id_type).alias("doc_id"), "source", "size", "source_size", "target",
                    (passes * F.col("size") + part).cast("long").alias("taken")))


def first_words(text, n):
    """The first n words of a text as they stand, up to the end of the nth: what a partly taken document contributes."""
    spaced = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    # lengths of the space-separated parts give the place where the nth non-empty part ends
    parts = F.split(spaced, " ", -1)
    ends = F.aggregate(parts, F.struct(F.lit(0).cast("bigint").alias("words"), F.lit(0).alias("at"), F.lit(0).alias("end")),
                       lambda acc, w: F.struct((acc.words + F.when(w != "", 1).otherwise(0)).alias("words"),
                                               (acc["at"] + F.length(w) + 1).alias("at"),
                                               F.when((w != "") & (acc.words < n), acc["at"] + F.length(w)).otherwise(acc["end"]).alias("end")))
    return F.substring(text, F.lit(1), ends["end"])
