"""Duplicate handling. 'First' always has an explicit order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emipanel.functions.core import as_col
from emipanel.functions.text import score_source, score_status
from emipanel.operators.skew import attach_row, dense_ids, exact_median, first_per_key, join_null_safe, smallest_mode


def distinct(df: DataFrame, cols=()) -> DataFrame:
    return df.select(*cols).distinct() if cols else df.distinct()


def keep_first(df: DataFrame, keys, order) -> DataFrame:
    return first_per_key(df, keys, [as_col(o) for o in order])


def keep_last(df: DataFrame, keys, order) -> DataFrame:
    """``order`` must identify rows inside a key."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*[as_col(o) for o in order])).alias("__p"))
    return picked.select(*keys, *[F.col(f"__p.{c}").alias(c) for c in rest]).select(*df.columns)


def latest(df: DataFrame, entity: str, year: str, tie=()) -> DataFrame:
    """Newest record per entity; ``tie`` orders records of one year (smallest first)."""
    return first_per_key(df, [entity], [-F.col(year), *[as_col(t) for t in tie]])


def ranked_dedup(df: DataFrame, keys, ranks, ordinal, row_id: str | None = None) -> DataFrame:
    """Best row per key by descending ``ranks`` (null counts as -1), then ingest order; optional dense ids."""
    best = first_per_key(df, keys, [*[-F.coalesce(as_col(r).cast("double"), F.lit(-1.0)) for r in ranks],
                                    as_col(ordinal)])
    return dense_ids(best, list(keys), row_id) if row_id else best


def embedding_ranks(status: str = "status", source: str = "img_source", images: str = "n_images") -> list:
    return [score_status(status), score_source(source), F.col(images)]


#: Rows of a key up to which they are reduced by one task.
GATHERED = 10_000


def collapse_duplicates(df: DataFrame, keys) -> DataFrame:
    """One row per key: median of numbers, smallest mode of labels; null keys are kept.

    Keys are counted first. Those of up to ``GATHERED`` rows are reduced in one shuffle of the rows; the fields of others, at most one key
    in ``GATHERED`` rows, are unrolled to (key, field, value) and reduced by the distributed median and mode, so a key may have any number
    of rows.
    """
    keys = list(keys)
    rest = [f for f in df.schema.fields if f.name not in keys]
    if not rest:
        return df.select(*keys).distinct()
    large = F.broadcast(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > GATHERED).select(*keys))
    few = _collapse_gathered(join_null_safe(df, large, keys, "left_anti"), keys, rest)
    many = _collapse_spread(join_null_safe(df, large, keys, "left_semi"), keys, rest)
    return few.select(*df.columns).unionByName(many.select(*df.columns))


def _median_of(values):
    """Median of an array without nulls, null if empty; NaN is the largest value."""
    x, n = F.sort_array(values), F.size(values)
    lo, hi = F.get(x, F.floor((n - 1) / 2).cast("int")), F.get(x, F.floor(n / 2).cast("int"))
    return F.when(n > 0, F.when(lo == hi, lo).otherwise(lo * 0.5 + hi * 0.5))


def _collapse_gathered(df: DataFrame, keys, rest) -> DataFrame:
    numeric = [f.name for f in rest if isinstance(f.dataType, T.NumericType)]
    labels = {f.name: f.dataType for f in rest if f.name not in numeric}
    out = df.groupBy(*keys).agg(*[F.collect_list(F.col(c).cast("double")).alias(c) for c in numeric],
                                *[F.mode(F.col(c).cast("string"), True).alias(c) for c in labels])
    return out.select(*keys, *[_median_of(c).alias(c) for c in numeric], *[F.col(c).cast(t).alias(c) for c, t in labels.items()])


def _collapse_spread(df: DataFrame, keys, rest) -> DataFrame:
    numeric = [f.name for f in rest if isinstance(f.dataType, T.NumericType)]
    labels = [f.name for f in rest if f.name not in numeric]
    out = df.select(*keys).distinct()
    if numeric:
        long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in numeric]).unpivot(keys, numeric, "field", "x")
        out = join_null_safe(out, _wide(exact_median(long, [*keys, "field"], "x", "x"), keys, numeric, {}), keys)
    if labels:
        long = df.select(*keys, *[F.col(c).cast("string").alias(c) for c in labels]).unpivot(keys, labels, "field", "x")
        kinds = {f.name: f.dataType for f in rest if f.name in labels}
        out = join_null_safe(out, _wide(smallest_mode(long, [*keys, "field"], "x"), keys, labels, kinds), keys)
    return out


def _wide(long: DataFrame, keys, fields, kinds: dict) -> DataFrame:
    return long.groupBy(*keys).agg(*[F.max(F.when(F.col("field") == c, F.col("x"))).cast(kinds.get(c, "double")).alias(c)
                                     for c in fields])


def collapse_report(df: DataFrame, keys) -> DataFrame:
    """Rows before, rows after, rows collapsed."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.sum("n").alias("rows_before"), F.count(F.lit(1)).alias("rows_after"),
                       (F.sum("n") - F.count(F.lit(1))).alias("rows_collapsed"))


def duplicate_sample(df: DataFrame, keys, n: int = 10) -> DataFrame:
    """The n worst repeated keys, as evidence for a broken uniqueness rule."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)
            .orderBy(F.desc("n_rows"), *keys).limit(n))


def assert_unique(df: DataFrame, keys) -> None:
    bad = duplicate_sample(df, keys).collect()
    if bad:
        raise ValueError(f"keys are not unique: {[tuple(r) for r in bad]}")


def refuse_duplicates(df: DataFrame, keys) -> DataFrame:
    """The rows of ``df``, whose use fails if a key occurs twice (null keys count as equal), so that no write of them can succeed. Only
    keys are shuffled, counted map-side; the rows are read a second time and pass through where they are."""
    keys = list(keys)
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1)
    found = twice.agg(F.count(F.lit(1)).alias("__twice"), F.min(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})).alias("__key"))
    message = F.concat(F.lit("keys are not unique: "), F.col("__twice"), F.lit(" occur more than once, one is "), F.col("__key"))
    return (attach_row(df, found).where(F.when(F.col("__twice") > 0, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
            .drop("__twice", "__key"))


def count_duplicates(df: DataFrame, keys, by=(), name: str = "duplicate_rows") -> DataFrame:
    """Rows after the first of their key."""
    per_key = df.groupBy(*by, *[k for k in keys if k not in by]).agg(F.count(F.lit(1)).alias("__n"))
    return per_key.groupBy(*by).agg((F.sum("__n") - F.count(F.lit(1))).alias(name))


def representative(df: DataFrame, entity: str, cols, default: str = "") -> DataFrame:
    """Most frequent value of each column per entity, ``default`` where there is none."""
    out = df.select(entity).distinct()
    for c in cols:
        out = out.join(smallest_mode(df, [entity], c), entity, "left")
    return out.fillna(default, subset=list(cols))
