"""Reproducible splits and samples.

Every random choice is a hash of (seed, key), so a split depends on neither row order nor partitioning
and any SQL engine can reproduce it. Ranks inside strata come from ``rank_in_group``, which spreads a
stratum over hash buckets. Membership differs from a library's random generator; sizes do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emipanel.functions.core import as_col, hash32
from emipanel.operators.filters import min_years
from emipanel.operators.skew import first_per_key, join_null_safe, lowest_by_hash, rank_in_group

NAMES = ("train", "val", "test")


def stratum_label(df: DataFrame, a: str, b: str, min_n: int = 5, name: str = "stratum",
                  tiny: str = "_tinyRoW", rest: str = "_global") -> DataFrame:
    """``a|b``; strata under ``min_n`` rows fall to ``a|_tinyRoW``, and those still too small to ``_global``.

    Counted per (a, b) cell; only the cell table is regrouped, then joined to the rows.
    """
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("__n"))
    label = F.concat_ws("|", F.coalesce(F.col(a).cast("string"), F.lit("Unknown")),
                        F.coalesce(F.col(b).cast("string"), F.lit("Unknown")))
    wide = F.concat_ws("|", F.coalesce(F.col(a).cast("string"), F.lit("Unknown")), F.lit(tiny))
    cells = cells.withColumn("__l", F.when(F.col("__n") >= min_n, label).otherwise(wide))
    sizes = cells.groupBy("__l").agg(F.sum("__n").alias("__m"))
    cells = cells.join(sizes, "__l").select(a, b, F.when(F.col("__m") >= min_n, F.col("__l")).otherwise(rest)
                                            .alias(name))
    return join_null_safe(df, cells, [a, b])


def _cut(rank: str, size: str, fractions, names=NAMES) -> Column:
    """Label by rank with rounded cumulative cut points."""
    out, upto = None, 0.0
    for name, fr in zip(names[:-1], fractions[:-1]):
        upto += fr
        test = F.col(rank) <= F.round(F.col(size) * F.lit(round(upto, 6)))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(names[-1])


def stratified_split(df: DataFrame, strata, key, fractions=(0.8, 0.1, 0.1), seed: int = 42,
                     name: str = "split") -> DataFrame:
    """Exact fractions inside every stratum. ``key``: columns that identify a row."""
    key = list(key)
    ranked = rank_in_group(df, strata, hash32(seed, *key), key, "__rank", "__size")
    return ranked.withColumn(name, _cut("__rank", "__size", fractions)).drop("__rank", "__size")


def random_split(df: DataFrame, strata, key, test: float = 0.2, val: float = 0.1, seed: int = 42) -> DataFrame:
    return stratified_split(df, strata, key, (1 - test - val, val, test), seed)


def inherit_split(df: DataFrame, parent: DataFrame, keys, name: str = "split") -> DataFrame:
    """Rows of a subset keep the label they have in the parent split; rows unknown there are dropped."""
    return df.join(parent.select(*keys, name), list(keys))


def grouped_split(df: DataFrame, group, strata, test: float = 0.2, val: float = 0.1, seed: int = 42,
                  name: str = "split") -> DataFrame:
    """Whole groups per part, stratified; a group's stratum is its smallest one."""
    group, strata = list(group), [s for s in strata if s not in group]
    rest = [F.min(s).alias(s) for s in strata]
    groups = df.groupBy(*group).agg(*rest) if rest else df.select(*group).distinct()
    labelled = stratified_split(groups, strata, group, (1 - test - val, val, test), seed, name)
    return join_null_safe(df, labelled.select(*group, name), group)


def split_within(df: DataFrame, by: str, strata, key, fractions=(0.7, 0.1, 0.2), seed: int = 42) -> DataFrame:
    """Independent split in every group of ``by``."""
    return stratified_split(df, [by, *strata], key, fractions, seed)


def temporal_split(df: DataFrame, year: str, train_end: int = 2019, val: int = 2020, test_start: int = 2021,
                   name: str = "split") -> DataFrame:
    y = F.col(year)
    label = F.when(y <= train_end, "train").when(y == val, "val").when(y >= test_start, "test")
    return df.withColumn(name, label)


def yearly_tests(df: DataFrame, year: str, train_end: int = 2018, tests=(2019, 2020, 2021)) -> DataFrame:
    """Train up to ``train_end``; each later year is its own test set."""
    y = F.col(year)
    label = F.when(y <= train_end, "train")
    for t in tests:
        label = label.when(y == t, f"test_{t}")
    return df.withColumn("split", label).where(F.col("split").isNotNull())


def forecast_split(df: DataFrame, entity: str, year: str, years_needed: int, train_end: int, val: int,
                   test_start: int) -> DataFrame:
    """Temporal split of the entities with enough distinct years."""
    return temporal_split(min_years(df, entity, year, years_needed), year, train_end, val, test_start)


def leave_one_out(df: DataFrame, col: str, min_rows: int = 1):
    """Yield (value, train, test) per group; the rows are filtered lazily, never multiplied."""
    sizes = df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows).orderBy(col)
    for row in sizes.toLocalIterator():
        value = row[col]
        same = F.col(col).eqNullSafe(F.lit(value))
        yield value, df.where(~same), df.where(same)


def leave_one_out_sizes(df: DataFrame, col: str, min_rows: int = 1) -> DataFrame:
    """Train and test rows of every fold: the total less the group itself."""
    from emipanel.operators.skew import attach_row

    per = df.groupBy(col).agg(F.count(F.lit(1)).alias("n_test"))
    out = attach_row(per, df.agg(F.count(F.lit(1)).alias("__all")))
    return (out.where(F.col("n_test") >= min_rows)
            .withColumn("n_train", F.col("__all") - F.col("n_test")).drop("__all"))


def leave_one_out_mean(df: DataFrame, col: str, y: str, name: str = "loo_mean") -> DataFrame:
    """Mean log1p target of all other groups, from group totals (no fold is materialised)."""
    from emipanel.operators.skew import attach_row

    per = df.where(F.col(y).isNotNull()).groupBy(col).agg(
        F.sum(F.log1p(y)).alias("__s"), F.count(F.lit(1)).alias("__n"))
    out = attach_row(per, per.agg(F.sum("__s").alias("__ts"), F.sum("__n").alias("__tn")))
    mean = F.expm1(F.try_divide(F.col("__ts") - F.col("__s"), F.col("__tn") - F.col("__n")))
    return out.select(col, F.col("__n").alias("n_test"), mean.alias(name))


def transfer_folds(df: DataFrame, pairs: DataFrame, city: str = "city", min_rows: int = 1) -> DataFrame:
    """Row counts of directed transfers ``pairs(fold, source, target)``; a null source means all others.

    Cities are counted once; the pair table, a hand-written list, is joined to the counts, not to rows.
    """
    from emipanel.operators.skew import attach_row

    sizes = df.groupBy(F.col(city).alias("__c")).agg(F.count(F.lit(1)).alias("__n"))
    src = sizes.select(F.col("__c").alias("source"), F.col("__n").alias("__ns"))
    tgt = sizes.select(F.col("__c").alias("target"), F.col("__n").alias("n_test"))
    out = attach_row(pairs, df.agg(F.count(F.lit(1)).alias("__all")))
    out = out.join(tgt, "target").join(src, "source", "left")
    part = F.when(F.col("source").isNull(), F.col("__all") - F.col("n_test")).otherwise(F.col("__ns"))
    return (out.groupBy("fold", "target").agg(F.sum(part).alias("n_train"), F.first("n_test").alias("n_test"))
            .where(F.col("n_test") >= min_rows))


def few_shot(df: DataFrame, city: str, building: str, key, targets=None, ks=(10, 50, 100), seed: int = 42,
             min_rows: int = 30) -> DataFrame:
    """Role of every row of a target city for every k: ``shot`` (joins the training rows) or ``test``.

    k buildings are drawn, or k rows where the city has fewer than max(k)+10 buildings. Rows of other
    cities are training rows of every fold and are not repeated here; a fold whose rest is smaller
    than ``min_rows`` is left out.
    """
    key = list(key)
    rows = df if targets is None else df.where(F.col(city).isin(list(targets)))
    rows = rank_in_group(rows, [city], hash32(seed, *key), key, "__row_rank", "__city_rows")
    buildings = rank_in_group(rows.select(city, building).distinct(), [city], hash32(seed, building), [building],
                              "__b_rank", "__city_buildings")
    out = join_null_safe(rows, buildings, [city, building])
    by_building = F.col("__city_buildings") >= max(ks) + 10
    out = out.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    rank = F.when(by_building, F.col("__b_rank")).otherwise(F.col("__row_rank"))
    out = out.withColumn("role", F.when(rank <= F.col("k"), "shot").otherwise("test"))
    rest = (out.where(F.col("role") == "test").groupBy(city, "k").agg(F.count(F.lit(1)).alias("__rest"))
            .where(F.col("__rest") >= min_rows).select(city, "k"))
    out = join_null_safe(out, rest, [city, "k"], "left_semi")
    return out.drop("__row_rank", "__city_rows", "__b_rank", "__city_buildings")


def leave_region_out(df: DataFrame, region: str, named=("US", "EU", "APAC")):
    """Yield (region, train, test): train on the other named regions; the remainder is never used."""
    inside = df.where(F.col(region).isin(list(named)))
    for r in named:
        yield r, inside.where(F.col(region) != r), inside.where(F.col(region) == r)


def entity_holdout(df: DataFrame, entity: str, frac: float = 0.5, seed: int = 42,
                   name: str = "split") -> DataFrame:
    """A share of the entities, with all their rows, is held out."""
    ids = df.select(entity).distinct()
    ranked = rank_in_group(ids, [], hash32(seed, entity), [entity], "__rank", "__size")
    label = F.when(F.col("__rank") <= F.round(F.col("__size") * F.lit(1 - frac)), "train").otherwise("test")
    return join_null_safe(df, ranked.select(entity, label.alias(name)), [entity])


def carve_validation(df: DataFrame, entity: str, frac: float = 0.15, min_entities: int = 10,
                     seed: int = 42) -> DataFrame:
    """Validation rows out of the training rows: a share of the entities, none when there are few."""
    ids = df.select(entity).distinct()
    ranked = rank_in_group(ids, [], hash32(seed, entity), [entity], "__rank", "__size")
    take = (F.col("__size") >= min_entities) & (F.col("__rank") <= F.round(F.col("__size") * F.lit(frac)))
    return join_null_safe(df, ranked.select(entity, F.when(take, "val").otherwise("train").alias("split")), [entity])


def holdout(df: DataFrame, key, frac: float = 0.2, seed: int = 42, name: str = "split",
            held: str = "test") -> DataFrame:
    """A share of the rows, chosen by rank of their hash."""
    ranked = rank_in_group(df, [], hash32(seed, *key), key, "__rank", "__size")
    label = F.when(F.col("__rank") <= F.round(F.col("__size") * F.lit(1 - frac)), "train").otherwise(held)
    return ranked.withColumn(name, label).drop("__rank", "__size")


def cap_rows(df: DataFrame, n: int, key, seed: int = 42) -> DataFrame:
    """At most n rows without replacement (the row cap of in-context models): those with the smallest hashes, found before any other
    row is shuffled."""
    h = hash32(seed, *key)
    return rank_in_group(lowest_by_hash(df, [], h, n), [], h, key, "__rank", "__size").where(
        F.col("__rank") <= n).drop("__rank", "__size")


def quota_sample(df: DataFrame, city: str, year: str, key, cap: int = 1200, seed: int = 42) -> DataFrame:
    """At most ``cap`` rows per city, spread evenly over its years, topped up from the remainder.

    A row with ``cap`` smaller hashes in its city and year cannot be taken, so such rows are left out before ranking.
    """
    key = list(key)
    h = hash32(seed, *key)
    per = df.groupBy(city, year).agg(F.count(F.lit(1)).alias("__n")).groupBy(city).agg(
        F.count(year).alias("__years"))
    near = lowest_by_hash(df, [city, year], h, cap)
    ranked = join_null_safe(rank_in_group(near, [city, year], h, key, "__r", "__s"), per, [city])
    quota = F.greatest(F.lit(1), F.floor(F.lit(cap) / F.greatest(F.lit(1), F.col("__years"))))
    # quota rows first, then the rest; halving the hash keeps both parts uniform in 32 bits
    order = F.when(F.col("__r") <= quota, F.shiftright(h, 1)).otherwise(F.shiftright(h, 1) + F.lit(1 << 31))
    out = rank_in_group(ranked.drop("__s"), [city], order, [h, *[as_col(k) for k in key]], "__rank", "__size")
    return out.where(F.col("__rank") <= cap).select(*df.columns)


def one_per_group(df: DataFrame, group: str, key, seed: int = 42) -> DataFrame:
    """One labelled example per group, the one with the smallest hash."""
    return first_per_key(df.withColumn("__h", hash32(seed, *key)), [group],
                         [F.col("__h"), *[as_col(k) for k in key]]).drop("__h")


def for_seeds(df: DataFrame, seeds) -> DataFrame:
    """Every row once per seed; use ``seed`` inside the hash of the split that follows."""
    return df.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))


def filter_to_embedding_subset(df: DataFrame, usable: DataFrame,
                               keys=("city", "building_id", "year")) -> DataFrame:
    return df.join(usable.select(*keys), list(keys), "left_semi")
