"""Company panel: disclosures and side sources to a factor baseline, splits and modelling rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emipanel.functions.numeric import best_of, log10_pos, musd, sum_unless_all_null
from emipanel.functions.text import norm_name
from emipanel.operators.aggregates import intensity, sector_totals
from emipanel.operators.dedup import keep_first
from emipanel.operators.filters import outlier_rules
from emipanel.operators.joins import (factor_join, fx_to_musd, lookup_chain, map_region, resolve_with_source, semi)
from emipanel.operators.reshape import union_all
from emipanel.operators.splits import stratified_split, stratum_label
from emipanel.schema import COMPANY_MASTER, conform
from emipanel.sources.sinks import split_with_audit

KEYS = ["nz_id", "reporting_year"]


def build_master(main: DataFrame, extra: list[DataFrame], keep_all: list[DataFrame] = ()) -> DataFrame:
    """Sources to one schema. ``extra`` sources only add companies the main one lacks (by normalised
    name); ``keep_all`` sources are added whole."""
    known = main.select(norm_name("company_name").alias("__name")).distinct()
    fresh = [e.withColumn("__name", norm_name("company_name")).join(known, "__name", "left_anti").drop("__name")
             for e in extra]
    return union_all(*[conform(d, COMPANY_MASTER) for d in (main, *fresh, *keep_all)])


def factor_table(accounts: DataFrame, crosswalk: DataFrame, region="region", sector="sector", year="year",
                 emissions="ghg_kgco2e", value_added="va_meur", other: str = "Other") -> DataFrame:
    """(region, sector, year, factor) from detailed accounts. ``crosswalk(detail, bucket)``; details
    missing from it fall into ``other``, which is dropped."""
    x = crosswalk.select(F.col("detail").alias(sector), F.col("bucket"))
    src = accounts.join(x, sector, "left").withColumn("bucket", F.coalesce("bucket", F.lit(other)))
    totals = sector_totals(src, [region, "bucket", year], emissions, value_added, sector, "bucket", other)
    return intensity(totals).select(F.col(region).alias("region"), F.col("bucket").alias("sector"),
                                    F.col(year).alias("year"), "n_sectors", F.col("tco2e_per_musd").alias("factor"))


def factor_baseline(disclosures: DataFrame, tickers: DataFrame, financials: DataFrame,
                    factors: DataFrame) -> DataFrame:
    """Region, sector with provenance, factor, revenue and implied emissions of every disclosure row.

    Currency is converted here, before any flag is computed from revenue.
    """
    out = lookup_chain(disclosures, [(tickers.select("nz_id", "ticker"), "nz_id", "nz_id")])
    out = lookup_chain(out, [(financials.select("ticker", "yf_sector", "revenue_usd", "currency"), "ticker", "ticker")])
    out = map_region(out, "country_iso2", factors.select(F.col("region").alias("iso2")))
    out = resolve_with_source(out, "sics_sector", "yf_sector")
    out = factor_join(out, factors, "factor_region", "sector", "reporting_year")
    out = fx_to_musd(out.withColumn("revenue_musd", musd("revenue_usd")), ["revenue_musd"])
    return (out.withColumn("scope12_pred_tco2e", F.col("revenue_musd") * F.col("factor_tco2e_per_musd"))
            .withColumn("scope12_actual_tco2e", sum_unless_all_null("scope1_tco2e", "scope2_lb_tco2e")))


def merge_time_aligned(base: DataFrame, panel: DataFrame, summaries: DataFrame, order) -> DataFrame:
    """Yearly financials (converted already) and descriptions joined to one row per company-year."""
    one = keep_first(base, KEYS, order)
    p = panel.select("ticker", F.col("year").alias("reporting_year"), F.col("revenue_musd").alias("revenue_musd_ty"))
    out = one.join(p, ["ticker", "reporting_year"], "left").join(summaries, "ticker", "left")
    return (out.withColumn("financials_timevary", F.col("revenue_musd_ty").isNotNull())
            .withColumn("revenue_best_musd", best_of("revenue_musd_ty", "revenue_musd")))


def flag_subsets(df: DataFrame) -> DataFrame:
    strict = F.col("ticker").isNotNull() & F.coalesce(F.col("revenue_best_musd") > 0, F.lit(False))
    return (df.withColumn("subset_strict", strict)
            .withColumn("has_factor_baseline", F.col("factor_tco2e_per_musd").isNotNull()))


def build_splits(df: DataFrame, seed: int = 42) -> DataFrame:
    rows = df.where((F.col("scope12_actual_tco2e") > 0) & F.col("country_iso2").isNotNull())
    rows = stratum_label(rows.fillna("Unknown", subset=["sector"]), "sector", "country_iso2")
    return stratified_split(flag_subsets(rows), ["stratum"], KEYS, (0.8, 0.1, 0.1), seed)


def modelling_rows(df: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(rows with split and log target, audit of dropped outliers)."""
    kept, audit = split_with_audit(df, outlier_rules("scope12_actual_tco2e"))
    split = semi(build_splits(df, seed), kept, KEYS)
    return split.withColumn("y", log10_pos("scope12_actual_tco2e")), audit
