"""Primitives that keep working when one group holds a third of all rows.

* joins that treat null keys as equal,
* exact quantiles and modes without holding a group in one task,
* exact ranks inside groups by hash ranges, as many as a group's size asks for,
* one row per key by aggregation (combined before the shuffle) instead of a window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emipanel.functions.core import as_col

#: Accuracy of the sketch that brackets quantiles: a rank is off by at most rows / SKETCH.
SKETCH = 10_000
#: Brackets are widened by this share of their ends, far more than a value computed again (a sum in another order) moves.
AGAIN = 1e-9
#: Rows that a window over hash buckets should hold, and bits of the hash.
BUCKET_ROWS = 1 << 18
HASH_BITS = 32


def join_null_safe(left: DataFrame, right: DataFrame, keys, how: str = "left") -> DataFrame:
    """Equi join in which null keys match each other."""
    keys = list(keys)
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    out = left.join(renamed, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__r_{k}" for k in keys])


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row (a scalar subquery, no join)."""
    value = one_row.select(F.struct(*[F.col(c) for c in one_row.columns])).scalar()
    return (df.withColumn("__one_row", value)
            .select(*[F.col(c) for c in df.columns], *[F.col(f"__one_row.{c}").alias(c) for c in one_row.columns]))


def first_per_key(df: DataFrame, keys, order: list[Column]) -> DataFrame:
    """Row with the smallest ``order`` per key. Negate a number to sort it descending.

    An aggregate, so a hot key is reduced on the map side and no group is gathered.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*[as_col(o) for o in order])).alias("__p"))
    return picked.select(*keys, *[F.col(f"__p.{c}").alias(c) for c in rest]).select(*df.columns)


def _cumulate(df: DataFrame, part, order: str, n: str, base=None) -> DataFrame:
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(n).over(w)
    if base is not None:
        end = end + F.col(base)
    return df.withColumn("__end", end).withColumn("__start", F.col("__end") - F.col(n))


def exact_quantiles(df: DataFrame, keys, value, probs, names=None) -> DataFrame:
    """Exact interpolated quantiles per group; null values are skipped, all-null groups are absent.
    ``value``: a column name or expression. NaN is the largest value, as in Spark's order.

    Two lazy passes, the same for every group size. A sketch per group, combined before the shuffle, brackets each wanted rank from
    both sides. Then values inside a bracket are counted one by one and those between brackets together, so a group comes to
    at most some 6 x rows / SKETCH counts for each quantile (and to all its distinct values where it has fewer than 4 x SKETCH), of
    which the one that holds the rank is picked. A rank outside its bracket would raise, it cannot give a wrong value.

    The two passes may compute a value again (a sum of doubles in another order), so it can differ in its last digits: the sketch decides
    only which values are counted one by one, brackets that reach the smallest or largest value have no end there, and the others
    are a little wider than the sketch says.
    """
    keys, probs = list(keys), [float(p) for p in probs]
    names = list(names or [f"q{int(round(p * 1000)):04d}" for p in probs])
    src = df.select(*keys, as_col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull())
    inf = float("inf")
    src = src.withColumn("__y", F.nanvl("__v", F.lit(inf)))
    off = 2.0 / SKETCH
    ends = [max(p - off, 0.0) for p in probs] + [min(p + off, 1.0) for p in probs]
    sketch = src.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx("__y", ends, SKETCH).alias("__q")).where(F.col("__n") > 0)
    few = F.col("__n") < 4 * SKETCH

    def wider(end, by):
        return end * F.when(end < 0, 1 - by).otherwise(1 + by)

    low = [F.when(few | F.lit(p - off <= 0), -inf).otherwise(wider(F.get("__q", F.lit(i)), -AGAIN)) for i, p in enumerate(probs)]
    high = [F.when(few | F.lit(p + off >= 1), inf).otherwise(wider(F.get("__q", F.lit(len(probs) + i)), AGAIN)) for i, p in enumerate(probs)]
    brackets = sketch.select(*keys, F.array(*[F.struct(a.alias("a"), b.alias("b")) for a, b in zip(low, high)]).alias("__brackets"))
    near = join_null_safe(src, brackets, keys, "inner") if keys else attach_row(src, brackets)
    y = F.col("__y")
    # values outside all brackets that have passed as many lower ends have no bracket between them
    near = near.select(*keys, "__v", F.when(F.exists("__brackets", lambda x: (x["a"] <= y) & (y <= x["b"])), F.col("__v")).alias("__one"),
                       F.size(F.filter("__brackets", lambda x: x["a"] <= y)).alias("__side"))
    cells = near.groupBy(*keys, "__side", "__one").agg(F.count(F.lit(1)).alias("__c"), F.max("__v").alias("__top"))
    part = keys or [F.lit(0)]
    cells = _cumulate(cells, part, "__top", "__c").withColumn("__tot", F.sum("__c").over(Window.partitionBy(*part)))
    exact = F.coalesce("__one", F.raise_error(F.lit("a quantile lies outside the bracket of its sketch")).cast("double"))
    picks = []
    for i, p in enumerate(probs):
        pos = (F.col("__tot") - 1) * F.lit(p)
        for tag, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            picks.append(F.max(F.when((rank >= F.col("__start")) & (rank < F.col("__end")), exact)).alias(f"__{tag}{i}"))
    out = cells.groupBy(*keys).agg(F.max("__tot").alias("__tot"), *picks).where(F.col("__tot") > 0)
    for i, (p, name) in enumerate(zip(probs, names)):
        pos = (F.col("__tot") - 1) * F.lit(p)
        frac = pos - F.floor(pos)
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        # equal ends need no arithmetic, which would make NaN of infinities
        out = out.withColumn(name, F.when((frac == 0) | (lo == hi), lo).otherwise(lo * (1 - frac) + hi * frac))
    return out.select(*keys, *names)


def exact_median(df: DataFrame, keys, value, name: str = "median") -> DataFrame:
    return exact_quantiles(df, keys, value, [0.5], [name])


def smallest_mode(df: DataFrame, keys, col: str, name: str | None = None) -> DataFrame:
    """Most frequent non-null value per group, the smallest of tied ones.

    Counting by (group, value) first spreads a hot group over its values.
    """
    keys = list(keys)
    counts = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*keys).agg(F.min_by(col, F.struct(-F.col("__n"), F.col(col))).alias(name or col))


def rank_in_group(df: DataFrame, group, h: Column, tie, rank: str = "rank_in_group", size: str = "group_size",
                  bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Exact 1-based rank by (h, tie) inside each group, ``h`` being a uniform 32-bit hash.

    A group is cut into hash ranges of about ``bucket_rows`` rows, as many as its size asks for; each is sorted by itself and the
    rows of the ranges before it, a row per range, are added. Groups are counted map-side; nothing runs before the result is used.
    """
    group, tie = list(group), [as_col(t) for t in tie]
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias(size))
    work = df.withColumn("__h", h)
    work = join_null_safe(work, counts, group, "inner") if group else attach_row(work, counts)
    ranges = F.ceil(F.col(size) / F.lit(bucket_rows))
    work = work.withColumn("__b", F.shiftright(F.col("__h") * ranges, HASH_BITS))
    keys = [*group, "__b"]
    before = work.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = _cumulate(before, group or [F.lit(0)], "__b", "__n").select(*keys, "__start")
    inner = Window.partitionBy(*keys).orderBy("__h", *tie)
    return (join_null_safe(work.withColumn("__row", F.row_number().over(inner)), before, keys, "inner")
            .withColumn(rank, F.col("__start") + F.col("__row")).select(*df.columns, rank, size))


def lowest_by_hash(df: DataFrame, group, h: Column, n: int) -> DataFrame:
    """Rows among which are the ``n`` with the smallest hash of each group (all ties too), and few others.

    Rows are counted by group and the upper 16 bits of the 32-bit hash, combined before the shuffle; the range in which the n-th row
    lies ends what is kept, so no other row is shuffled later on. Groups of up to n rows stay whole.
    """
    group = list(group)
    coarse = F.shiftright(h, 16)
    counts = df.groupBy(*group, coarse.alias("__range")).agg(F.count(F.lit(1)).alias("__n"))
    counts = _cumulate(counts, group or [F.lit(0)], "__range", "__n")
    last = counts.groupBy(*group).agg(F.min(F.when(F.col("__end") >= n, F.col("__range"))).alias("__last"))
    near = join_null_safe(df, last, group, "inner") if group else attach_row(df, last)
    return near.where(F.col("__last").isNull() | (coarse <= F.col("__last"))).drop("__last")


def dense_ids(df: DataFrame, order, name: str = "row_id") -> DataFrame:
    """0-based ids in sort order without a single-task sort.

    The range-sorted rows are checkpointed, so their partitions are fixed; each then needs only
    the offset of its partition (one row per partition).
    """
    from emipanel.session import stable

    placed = stable(df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("__m"), 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    # one row per partition of the sort: the only thing this window gathers
    offsets = sizes.withColumn("__off", F.coalesce(F.sum("__n").over(
        Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    return (placed.withColumn("__part", part).join(offsets.select("__part", "__off"), "__part")
            .withColumn(name, F.col("__off") + inside).select(*df.columns, name))
