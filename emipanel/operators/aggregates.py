"""Aggregations and data-quality reports. Sums and counts combine before the shuffle; medians and
quantiles go through the skew-safe primitives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emipanel.functions.numeric import KG_PER_TONNE, USD_PER_EUR, WATT_M2_TO_MJ_DAY
from emipanel.operators.skew import attach_row, exact_median, exact_quantiles, join_null_safe

BASE_TEMP_C = 18.0
FULL_YEAR_DAYS = 360


def _n() -> Column:
    return F.count(F.lit(1))


def sector_totals(df: DataFrame, keys, emissions: str, value_added: str, detail: str, bucket: str,
                  drop: str = "Other") -> DataFrame:
    """Sums and number of detailed sectors per key; null keys and one bucket are dropped."""
    return (df.dropna(subset=list(keys)).where(F.col(bucket) != drop).groupBy(*keys)
            .agg(F.sum(emissions).alias("ghg_kgco2e"), F.sum(value_added).alias("va_meur"),
                 F.count_distinct(detail).alias("n_sectors")))


def intensity(df: DataFrame, emissions: str = "ghg_kgco2e", value_added: str = "va_meur",
              name: str = "tco2e_per_musd") -> DataFrame:
    """kg per million EUR of value added to tonnes per million USD; no value added gives null."""
    return df.withColumn(name, F.try_divide(F.col(emissions) / KG_PER_TONNE, F.col(value_added) * USD_PER_EUR))


def intensity_ladder(train: DataFrame, levels: dict, target: str, revenue: str) -> DataFrame:
    """Ratio-of-sums factor per group at every level of detail: (level, label, factor, n_train).

    One grouping-sets aggregation over the training rows, whatever the number of levels.
    """
    cols = list(levels.values())
    train = train.where(F.col(target).isNotNull() & (F.col(revenue) > 0))
    sets = [[F.col(c)] for c in cols]
    out = train.groupingSets(sets, *cols).agg(
        F.grouping_id().alias("__gid"), F.sum(target).alias("__t"), F.sum(revenue).alias("__r"), _n().alias("n_train"))
    level, label = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (name, c) in enumerate(levels.items()):
        here = F.col("__gid") == ((1 << len(cols)) - 1) ^ (1 << (len(cols) - 1 - i))
        level, label = F.when(here, name).otherwise(level), F.when(here, F.col(c).cast("string")).otherwise(label)
    return out.select(level.alias("level"), label.alias("label"), F.try_divide("__t", "__r").alias("factor"),
                      "n_train")


def apply_ladder(ladder: DataFrame, case: DataFrame, levels: dict, target: str, revenue: str) -> DataFrame:
    """Implied prediction and over-ratio of every case row at every level."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.col(c).cast("string").alias("label"))
                                for n, c in levels.items()]))
    long = case.withColumn("__p", pairs).select(*case.columns, "__p.level", "__p.label")
    out = long.join(ladder, ["level", "label"])
    pred = F.col("factor") * F.col(revenue)
    return out.withColumn("pred_tco2e", pred).withColumn("over_ratio", F.try_divide(pred, F.col(target)))


def validation_summary(df: DataFrame, city: str, building: str, year: str, non_null: dict,
                       fallback: str = "_row_") -> DataFrame:
    """Per city: rows, buildings, year range, number of years, non-null counts, duplicate rows, fallback ids.

    First by (city, building, year), so a city holding most rows is spread; then by city.
    """
    base = df.groupBy(city, building, year).agg(_n().alias("__n"), *[F.count(c).alias(f"__nn_{n}")
                                                                     for n, c in non_null.items()])
    return base.groupBy(city).agg(
        F.sum("__n").alias("n_rows"), F.count_distinct(building).alias("unique_buildings"),
        F.min(year).alias("year_min"), F.max(year).alias("year_max"), F.count_distinct(year).alias("n_years"),
        *[F.sum(f"__nn_{n}").alias(f"{n}_non_null") for n in non_null],
        (F.sum("__n") - _n()).alias("duplicate_rows"),
        F.sum(F.when(F.col(building).cast("string").contains(fallback), F.col("__n")).otherwise(0))
        .alias("fallback_ids"))


def availability_long(df: DataFrame, city: str, cols) -> DataFrame:
    """(city, column, non-null count, missing %, all null)."""
    agg = df.groupBy(city).agg(_n().alias("__n"), *[F.count(c).alias(c) for c in cols])
    long = agg.unpivot([city, "__n"], list(cols), "column", "non_null_count")
    return long.select(city, "column", "non_null_count",
                       ((1 - F.col("non_null_count") / F.col("__n")) * 100).alias("missing_rate_pct"),
                       (F.col("non_null_count") == 0).alias("all_null"))


def availability_wide(df: DataFrame, city: str, cols, building: str) -> DataFrame:
    """Non-null % with one decimal per column, biggest city first."""
    return (df.groupBy(city).agg(_n().alias("n_rows"), F.count_distinct(building).alias("n_buildings"),
                                 *[F.round(F.lit(100.0) * F.count(c) / _n(), 1).alias(c) for c in cols])
            .orderBy(F.desc("n_rows"), city))


def coverage(df: DataFrame, source: str, cols, total: str = "ALL") -> DataFrame:
    """Non-null counts by source and overall; totals are told from a null source by grouping_id."""
    return (df.rollup(source).agg(F.grouping_id().alias("__g"), _n().alias("n_rows"),
                                  *[F.count(c).alias(f"{c}_present") for c in cols])
            .withColumn(source, F.when(F.col("__g") == 1, total).otherwise(F.col(source))).drop("__g"))


def value_counts(df: DataFrame, c: str, k: int | None = None) -> DataFrame:
    out = df.groupBy(c).agg(_n().alias("n"))
    return out.orderBy(F.desc("n"), c).limit(k) if k else out


def id_statistics(df: DataFrame, city: str, building: str, year: str, fallback: str = "_row_") -> DataFrame:
    """Continuity of buildings: distinct ids, share seen in several years, mean years, fallback ids."""
    per = df.groupBy(city, building).agg(F.count_distinct(year).alias("__y"))
    return per.groupBy(city).agg(
        _n().alias("n_buildings"), F.avg((F.col("__y") > 1).cast("double")).alias("multi_year_share"),
        F.avg("__y").alias("mean_years"),
        F.count_if(F.col(building).cast("string").contains(fallback)).alias("fallback_ids"))


def missing_rates(df: DataFrame, cols) -> DataFrame:
    """Missing share of every column over the whole table."""
    one = df.agg(_n().alias("__n"), *[F.count(c).alias(c) for c in cols])
    return one.unpivot(["__n"], list(cols), "column", "non_null").select(
        "column", (1 - F.try_divide("non_null", "__n")).alias("missing_rate"))


def median_by(df: DataFrame, keys, c: str, name: str = "median_value", k: int | None = None) -> DataFrame:
    out = exact_median(df, keys, c, name)
    return out.orderBy(F.desc(name), *keys).limit(k) if k else out


def before_after(df: DataFrame, before: str, after: str) -> DataFrame:
    """Median and maximum of a column before and after a correction."""
    a = exact_median(df, [], before, "median_before")
    b = exact_median(df, [], after, "median_after")
    top = df.agg(F.max(before).alias("max_before"), F.max(after).alias("max_after"))
    return attach_row(attach_row(top, a), b)


def annual_climate(daily: DataFrame, keys, temp: str, humidity: str | None = None, solar: str | None = None,
                   wind: str | None = None, full_year: int = FULL_YEAR_DAYS) -> DataFrame:
    """Heating and cooling degree days and means per (location, year).

    Degree days need a full year without a gap; the means skip missing days.
    """
    t = F.col(temp)
    full = (_n() >= full_year) & (F.count(temp) == _n())
    aggs = [F.when(full, F.sum(F.greatest(F.lit(BASE_TEMP_C) - t, F.lit(0.0)))).alias("hdd_18c"),
            F.when(full, F.sum(F.greatest(t - F.lit(BASE_TEMP_C), F.lit(0.0)))).alias("cdd_18c"),
            F.avg(t).alias("annual_mean_temp_c")]
    if humidity:
        aggs.append(F.avg(humidity).alias("annual_rh_mean"))
    if solar:
        aggs.append((F.avg(solar) * WATT_M2_TO_MJ_DAY).alias("annual_ssrd_mj_m2_day"))
    if wind:
        aggs.append(F.avg(wind).alias("annual_wind_ms"))
    return daily.groupBy(*keys).agg(*aggs)


def aggregate_seeds(long: DataFrame, keys, seed: str = "seed", metric: str = "metric", value: str = "value",
                    exclude=()) -> DataFrame:
    """Per key and metric: number of seeds, their sorted list, mean and sample deviation (null for one)."""
    if exclude:
        long = long.where(~F.col(metric).isin(list(exclude)))
    return long.groupBy(*keys, metric).agg(
        F.count_distinct(seed).alias("n_seeds"),
        F.array_join(F.sort_array(F.collect_set(seed)).cast("array<string>"), ",").alias("seeds"),
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def drop_city_summary(long: DataFrame, keys, city: str, drop: str, value: str = "value") -> DataFrame:
    """Distribution of city scores without one city, and whether that city was there."""
    kept = long.where(F.col(city) != drop)
    seen = long.groupBy(*keys).agg(
        F.max(F.when((F.col(city) == drop) & F.col(value).isNotNull(), 1).otherwise(0)).alias("dropped_was_present"))
    stats = kept.groupBy(*keys).agg(F.count(value).alias("n_cities_retained"), F.avg(value).alias("macro"),
                                    F.min(value).alias("lowest"), F.max(value).alias("highest"))
    q = exact_quantiles(kept, keys, value, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    out = join_null_safe(join_null_safe(seen, stats, keys), q, keys)
    return out.withColumn("drop_city", F.lit(drop))


def pivot_summary(df: DataFrame, rows, col: str, values, metric: str, mean: bool = True) -> DataFrame:
    """Average metric per row and column value, with the row mean."""
    out = df.groupBy(*rows).pivot(col, list(values)).agg(F.avg(metric))
    if mean:
        cols = [F.col(f"`{v}`") for v in values]
        total, n = F.lit(0.0), F.lit(0)
        for c in cols:
            total, n = total + F.coalesce(c, F.lit(0.0)), n + c.isNotNull().cast("int")
        out = out.withColumn("row_mean", F.try_divide(total, n))
    return out


def ratio_quality(df: DataFrame, pred: str, actual: str) -> DataFrame:
    """Median |log10 ratio|, median relative error and correlation of logs over positive pairs."""
    ok = df.where((F.col(pred) > 0) & (F.col(actual) > 0)).withColumns({
        "__lp": F.log10(pred), "__la": F.log10(actual),
        "__ape": F.abs(F.col(pred) - F.col(actual)) / F.col(actual)})
    ok = ok.withColumn("__d", F.abs(F.col("__lp") - F.col("__la")))
    base = ok.agg(_n().alias("n"), F.try_divide(F.covar_pop("__lp", "__la"), F.stddev_pop("__lp") * F.stddev_pop("__la")).alias("pearson_log"))
    return attach_row(attach_row(base, exact_median(ok, [], "__d", "median_abs_log_ratio")),
                      exact_median(ok, [], "__ape", "median_ape"))


def cohort_ratio(df: DataFrame, keys, pred: str, actual: str) -> DataFrame:
    """Median log ratio and geometric-mean fold error per cohort."""
    ok = df.where((F.col(pred) > 0) & (F.col(actual) > 0)).withColumn(
        "__r", F.log10(F.col(pred) / F.col(actual)))
    base = ok.groupBy(*keys).agg(_n().alias("n"), F.pow(F.lit(10.0), F.avg(F.abs("__r"))).alias("geo_fold_error"))
    return join_null_safe(base, exact_median(ok, keys, "__r", "median_log_ratio"), keys)


def status_counts(df: DataFrame, keys) -> DataFrame:
    return df.groupBy(*keys).agg(_n().alias("n"))


def parse_counts(df: DataFrame, value: str, by=()) -> DataFrame:
    """Rows, rows with a parsed value, and their share."""
    return df.groupBy(*by).agg(_n().alias("n_rows"), F.count(value).alias("n_parsed"),
                               F.try_divide(F.count(value), _n()).alias("parsed_share"))


def dedup_factor(df: DataFrame, keys) -> DataFrame:
    """Rows per distinct key."""
    per = df.groupBy(*keys).agg(_n().alias("__n"))
    return per.agg(F.sum("__n").alias("n_rows"), _n().alias("n_keys"), F.max("__n").alias("largest_group"),
                   F.try_divide(F.sum("__n"), _n()).alias("avg_dedup_factor"))


def seed_spread(df: DataFrame, keys, value: str) -> DataFrame:
    """Mean, deviation, range and median of a metric over seeds."""
    base = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"),
                                 F.stddev_samp(value).alias("std"), F.min(value).alias("min"),
                                 F.max(value).alias("max"))
    return join_null_safe(base, exact_median(df, keys, value, "median"), keys)
