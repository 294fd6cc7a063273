"""Numeric cleaning, units, currency, rules and target transforms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emipanel.functions.core import as_col, nan_to_null

# Markers for a missing number, the dash placeholder, unit factors.
NULL_TOKENS = ("Not Available", "N/A", "NA", "", "None", "-")
DASH = "—"
KBTU_PER_KWH = 3.412
KBTU_PER_THERM = 100.0
KG_PER_TONNE = 1000.0
SQFT_PER_SQM = 10.764
KBTU_PER_MJ = 0.9478
GRID_KG_PER_KWH = 0.44876
USD_PER_EUR = 1.08
WATT_M2_TO_MJ_DAY = 0.0864

_NUMBER = r"^\s*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$"


def parse_number(c) -> Column:
    """Text to double; anything that is not a plain number becomes null."""
    c = as_col(c).cast("string")
    return F.when(c.rlike(_NUMBER), F.trim(c).try_cast("double"))


def to_numeric_safe(c) -> Column:
    c = as_col(c).cast("string")
    return parse_number(F.when(~c.isin(*NULL_TOKENS), c))


def clean_dash(c) -> Column:
    return parse_number(F.nullif(as_col(c).cast("string"), F.lit(DASH)))


def strip_commas(c) -> Column:
    return parse_number(F.regexp_replace(as_col(c).cast("string"), ",", ""))


# Unit name -> (factor, divide?) applied to the source value.
_UNITS = {
    "kbtu_to_kwh": (KBTU_PER_KWH, True),
    "therms_to_kbtu": (KBTU_PER_THERM, False),
    "kg_to_tonnes": (KG_PER_TONNE, True),
    "sqm_to_sqft": (SQFT_PER_SQM, False),
    "eur_to_usd": (USD_PER_EUR, False),
    "w_m2_to_mj_m2_day": (WATT_M2_TO_MJ_DAY, False),
}


def convert(c, unit: str) -> Column:
    c = as_col(c)
    if unit == "kwh_sqm_to_kbtu_sqft":
        return c * F.lit(KBTU_PER_KWH) / F.lit(SQFT_PER_SQM)
    factor, divide = _UNITS[unit]
    return c / F.lit(factor) if divide else c * F.lit(factor)


def mj_intensity(mj, sqft) -> Column:
    """MJ over a floor area to kBtu per square foot; no area gives null."""
    return F.try_divide(as_col(mj) * F.lit(KBTU_PER_MJ), as_col(sqft))


def convert_by_header(c, header: str) -> Column:
    """A header that mentions kg holds kilograms; the column is returned in tonnes."""
    return convert(c, "kg_to_tonnes") if "kg" in header.lower() else as_col(c)


def scale_by_unit(value, unit) -> Column:
    value = as_col(value)
    return F.when(F.lower(as_col(unit)).contains("million"), value * F.lit(1e6)).otherwise(value)


def energy_from_intensity(eui, area) -> Column:
    return as_col(eui) * as_col(area)


def estimate_emissions(eui, area, kg_per_kwh: float = GRID_KG_PER_KWH) -> Column:
    """Energy intensity x floor area x grid factor, in tonnes."""
    return energy_from_intensity(eui, area) * F.lit(kg_per_kwh) / F.lit(KG_PER_TONNE)


def musd(c) -> Column:
    """Units to millions, with zero meaning 'not reported'."""
    return F.nullif(as_col(c).cast("double"), F.lit(0.0)) / F.lit(1e6)


def best_of(*cols) -> Column:
    return F.coalesce(*[as_col(c) for c in cols])


def clip_pred(c, upper) -> Column:
    """Predictions into [0, 2 x largest training target]; no finite upper bound means only >= 0."""
    c, upper = as_col(c), as_col(upper)
    finite = upper.isNotNull() & ~F.isnan(upper) & (upper < F.lit(float("inf")))
    return F.when(finite, F.least(F.greatest(c, F.lit(0.0)), upper * 2)).otherwise(F.greatest(c, F.lit(0.0)))


def log10_pos(c) -> Column:
    c = as_col(c)
    return F.when(c > 0, F.log10(c))


def log_target(c) -> Column:
    return F.log1p(F.greatest(as_col(c), F.lit(0.0)))


def unlog(c) -> Column:
    return F.expm1(as_col(c))


def pow10(c) -> Column:
    return F.pow(F.lit(10.0), as_col(c))


# Plausibility limits of the building panel.
BUILDING_RULES = {
    "site_eui_kbtu_sqft": (0.0, 1000.0),
    "source_eui_kbtu_sqft": (0.0, None),
    "total_ghg_emissions_mtco2e": (0.0, 100000.0),
    "year_built": (1800.0, 2026.0),
    "energy_star_score": ("nonzero", None),
}


def _violates(c: Column, rule) -> Column:
    low, high = rule
    if low == "nonzero":
        return c == 0
    bad = c < F.lit(low)
    return bad | (c > F.lit(high)) if high is not None else bad


def null_out(df: DataFrame, rules: dict) -> DataFrame:
    """Implausible values become null; rows stay."""
    return df.withColumns({c: F.when(~_violates(F.col(c), r), F.col(c))
                           for c, r in rules.items() if c in df.columns})


def rule_counts(df: DataFrame, rules: dict) -> DataFrame:
    """How many values each rule would null, in one pass."""
    return df.agg(*[F.count_if(_violates(F.col(c), r)).alias(c)
                    for c, r in rules.items() if c in df.columns])


def cyclic(c, period: float) -> tuple[Column, Column]:
    angle = as_col(c) * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def format_magnitude(c, unit: str = "tCO2e") -> Column:
    """Display text with a G/M/K suffix (ties round half up, as the JVM formats numbers)."""
    c = as_col(c)
    out = F.format_string(f"%.2f {unit}", c)
    for limit, letter in ((1e3, "K"), (1e6, "M"), (1e9, "G")):
        out = F.when(F.abs(c) >= limit, F.format_string(f"%.2f{letter} {unit}", c / F.lit(limit))).otherwise(out)
    return F.when(c.isNotNull(), out)


def format_metric(metric, c) -> Column:
    """Display text of a metric value, with the number of digits its scale needs."""
    name, c = F.lower(as_col(metric)), as_col(c)
    size = F.abs(c)
    error = (F.when(size >= 1e6, F.format_string("%.2e", c))
             .when(size >= 1000, F.format_string("%,.0f", c))
             .otherwise(F.format_string("%.1f", c)))
    text = (F.when(name.isin("r2", "log_mae"), F.format_string("%.3f", c))
            .when(name.isin("mape", "nrmse"), F.format_string("%.2f", c))
            .when(name.isin("mae", "rmse"), error)
            .otherwise(F.format_string("%.4f", c)))
    usable = c.isNotNull() & ~F.isnan(c) & (size < F.lit(float("inf")))
    return F.when(usable, text).otherwise(F.lit("--"))


def any_not_null(cols) -> Column:
    return F.coalesce(*[as_col(c) for c in cols]).isNotNull()


def all_not_null(cols) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & as_col(c).isNotNull()
    return out


def sum_unless_all_null(*cols) -> Column:
    parts = [as_col(c) for c in cols]
    total = F.lit(0.0)
    for c in parts:
        total = total + F.coalesce(c, F.lit(0.0))
    return F.when(F.coalesce(*parts).isNotNull(), total)


def sum_if_all(*cols) -> Column:
    parts = [as_col(c) for c in cols]
    total = parts[0]
    for c in parts[1:]:
        total = total + c
    return total


def finite(c) -> Column:
    c = as_col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def safe(c) -> Column:
    """NaN or infinite to null (what a results file may hold)."""
    c = as_col(c)
    return F.when(finite(c), c)


__all__ = [n for n in dir() if not n.startswith("_") and n not in
           ("annotations", "math", "Column", "DataFrame", "F", "as_col", "nan_to_null")]
