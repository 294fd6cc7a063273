"""Feature preparation. Whatever is fitted is a one-row or one-row-per-category table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emipanel.operators.skew import attach_row, exact_median, join_null_safe

# Feature tiers by name. Only the core tier's six features and the climate channels are
# published; the contents of the other tiers are our reading of their names.
CORE = ["property_type", "year_built", "gross_floor_area_sqft", "city", "hdd", "cdd"]
CLIMATE_PLUS = ["annual_mean_temp_c", "annual_rh_mean", "annual_ssrd_mj_m2_day", "annual_wind_ms"]
CLIMATE_CHANNELS = ["hdd", "cdd", *CLIMATE_PLUS]
FEATURE_SETS = {
    "core_all_cities": CORE,
    "core_all_cities_climate_plus": CORE + CLIMATE_PLUS,
    "us_core": CORE,
    "us_metadata": CORE + ["energy_star_score"],
    "us_leaky_eui": CORE + ["energy_star_score", "site_eui_kbtu_sqft"],
    "us_leaky_full": CORE + ["energy_star_score", "site_eui_kbtu_sqft", "source_eui_kbtu_sqft", "electricity_kwh",
                             "natural_gas_kbtu"],
    "au_core": CORE,
    "au_eui": CORE + ["site_eui_kbtu_sqft"],
    "au_full": CORE + ["site_eui_kbtu_sqft", "electricity_kwh", "natural_gas_kbtu"],
}
CITY_SETS = {
    "us": ["nyc", "la", "seattle", "dc", "chicago", "sf", "boston", "denver", "portland", "philadelphia"],
    "au": ["sydney", "melbourne", "brisbane", "perth", "adelaide", "canberra", "hobart", "darwin", "newcastle",
           "wollongong", "gold_coast", "townsville", "cairns", "geelong", "port_macquarie"],
}


def cities_of(tier: str) -> list[str] | None:
    """Cities a tier is restricted to; None for all."""
    return CITY_SETS.get(tier.split("_", 1)[0])


def forecast_features(tier: str, n_lags: int = 3) -> list[str]:
    """Known-ahead features of a tier, without climate, plus history and climate lags."""
    base = [c for c in FEATURE_SETS[tier] if c not in CLIMATE_CHANNELS]
    channels = [c for c in FEATURE_SETS[tier] if c in CLIMATE_CHANNELS]
    history = [f"lag{k}" for k in range(1, n_lags + 1)] + ["mean_hist", "std_hist", "change_1y"]
    return base + history + [f"{c}_lag{k}" for c in channels for k in range(1, n_lags + 1)]


def load_panel(panel: DataFrame, climate: DataFrame, tier: str,
               keys=("city", "building_id", "year")) -> DataFrame:
    """Panel rows of a tier; the climate table is joined only when the tier uses a climate channel."""
    cities = cities_of(tier)
    out = panel.where(F.col("city").isin(cities)) if cities else panel
    wanted = [c for c in FEATURE_SETS[tier] if c in CLIMATE_CHANNELS]
    if not wanted:
        return out
    side = climate.withColumnsRenamed({"hdd_18c": "hdd", "cdd_18c": "cdd"})
    return out.join(side.select(*keys, *wanted), list(keys), "left")


def fit_medians(train: DataFrame, cols, by=()) -> DataFrame:
    """Exact medians of all columns in one pass over long rows; a column without values gets 0."""
    cols, by = list(cols), list(by)
    long = train.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(by, cols, "column_name", "x")
    med = exact_median(long, [*by, "column_name"], "x", "med")
    wide = [F.max(F.when(F.col("column_name") == c, F.col("med"))).alias(c) for c in cols]
    if not by:
        return med.agg(*wide).fillna(0.0)
    return join_null_safe(train.select(*by).distinct(), med.groupBy(*by).agg(*wide), by).fillna(0.0, subset=cols)


def _fill(df: DataFrame, fitted: DataFrame, cols) -> DataFrame:
    names = {c: f"__fit_{c}" for c in cols}
    out = attach_row(df, fitted.select(*[F.col(c).alias(n) for c, n in names.items()]))
    return (out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(n)) for c, n in names.items()})
            .drop(*names.values()))


def apply_medians(df: DataFrame, medians: DataFrame, cols) -> DataFrame:
    return _fill(df, medians, cols)


def fit_means(train: DataFrame, cols) -> DataFrame:
    return train.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in cols])


def apply_means(df: DataFrame, means: DataFrame, cols) -> DataFrame:
    return _fill(df, means, cols)


def company_numeric_features(df: DataFrame, cols, split: str = "split", scope: str = "train",
                             no_log=("reporting_year", "factor_tco2e_per_musd")) -> DataFrame:
    """Median impute, then log1p of the positive part, except for year and factor.

    ``scope='train'`` imputes with training medians; ``'partition'`` with those of each row's own
    split, which looks at test rows and is kept for comparison only.
    """
    cols = list(cols)
    if scope == "train":
        out = apply_medians(df, fit_medians(df.where(F.col(split) == "train"), cols), cols)
    else:
        med = fit_medians(df, cols, by=[split]).withColumnsRenamed({c: f"__fit_{c}" for c in cols})
        out = join_null_safe(df, med, [split])
        out = (out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"__fit_{c}")) for c in cols})
               .drop(*[f"__fit_{c}" for c in cols]))
    return out.withColumns({c: F.log1p(F.greatest(F.col(c), F.lit(0.0))) for c in cols if c not in no_log})


def categories(df: DataFrame, col: str) -> list[str]:
    """Distinct labels of a categorical column (a bounded list: it becomes one column each)."""
    return [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col).collect()]


def one_hot(df: DataFrame, cats: dict) -> DataFrame:
    """0/1 column per listed category, so that any two frames line up."""
    return df.withColumns({f"{c}_{v}": F.when(F.col(c) == v, 1.0).otherwise(0.0)
                           for c, values in cats.items() for v in values})


def fit_index(train: DataFrame, col: str, out: str | None = None) -> StringIndexerModel:
    """Alphabetical label codes; labels unseen in training share one extra code."""
    return StringIndexer(inputCol=col, outputCol=out or f"{col}_idx", stringOrderType="alphabetAsc",
                         handleInvalid="keep").fit(train)


def apply_index(model: StringIndexerModel, df: DataFrame) -> DataFrame:
    return model.transform(df)


def fit_scaler(train: DataFrame, cols) -> DataFrame:
    """Mean and population deviation of every column (a zero deviation becomes 1)."""
    return train.agg(*[F.avg(c).alias(f"{c}_mean") for c in cols],
                     *[F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"{c}_std")
                       for c in cols])


def apply_scaler(df: DataFrame, scaler: DataFrame, cols) -> DataFrame:
    out = attach_row(df, scaler)
    return (out.withColumns({c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in cols})
            .drop(*[f"{c}_mean" for c in cols], *[f"{c}_std" for c in cols]))


def target_encode(train: DataFrame, df: DataFrame, col: str, y: str, m: float = 20.0,
                  name: str | None = None) -> DataFrame:
    """Smoothed mean target per category, (n*mean + m*global)/(n + m); unseen categories get the global mean."""
    name = name or f"{col}_te"
    stats = (train.where(F.col(col).isNotNull()).groupBy(col)
             .agg(F.sum(y).alias("__s"), F.count(y).alias("__n")))
    out = attach_row(df.join(stats, col, "left"), train.agg(F.avg(y).alias("__g")))
    enc = (F.col("__s") + F.lit(m) * F.col("__g")) / (F.col("__n") + F.lit(m))
    return out.withColumn(name, F.coalesce(enc, F.col("__g"))).drop("__s", "__n", "__g")


def assemble(df: DataFrame, cols, out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


def concat_features(df: DataFrame, tabular, embedding: str, out: str = "features") -> DataFrame:
    """Tabular columns and an array column in one vector."""
    ready = df.withColumn("__e", array_to_vector(F.col(embedding).cast("array<double>")))
    return VectorAssembler(inputCols=[*tabular, "__e"], outputCol=out).transform(ready).drop("__e")


def fit_pca(train: DataFrame, embedding: str, k: int, out: str = "embedding_pca"):
    """Principal components of the training rows only; scores are centred on the training mean. Returns a function frame -> frame."""
    def vec(d):
        return d.withColumn("__e", array_to_vector(F.col(embedding).cast("array<double>")))

    rows = vec(train)
    model = PCA(k=k, inputCol="__e", outputCol="__p").fit(rows)
    mean = rows.select(Summarizer.mean(F.col("__e")).alias("m")).first()["m"].toArray()
    centre = F.array(*[F.lit(float(x)) for x in mean @ model.pc.toArray()])  # one number per component

    def apply(df: DataFrame) -> DataFrame:
        scores = F.zip_with(vector_to_array("__p"), centre, lambda x, m: x - m)
        return model.transform(vec(df)).withColumn(out, scores).drop("__e", "__p")

    apply.model = model
    return apply


def cross_products(df: DataFrame, embedding: str, y: str, d: int) -> np.ndarray:
    """(d+2)x(d+2) matrix of sums of products of (1, x, y): partial products per task, summed by Spark."""
    width = d + 2

    def partial(batches):
        total = np.zeros((width, width))
        for b in batches:
            if len(b):
                x = np.stack(b["x"].to_numpy()).astype(float)
                z = np.column_stack([np.ones(len(b)), x, b["y"].to_numpy(float)])
                total += z.T @ z
        i, j = np.triu_indices(width)
        yield pd.DataFrame({"i": i, "j": j, "s": total[i, j]})

    src = df.select(F.col(embedding).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y"))
    cells = src.mapInPandas(partial, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    out = np.zeros((width, width))
    for r in cells.toLocalIterator():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["s"]
    return out


def fit_pls(train: DataFrame, embedding: str, y: str, k: int, out: str = "embedding_pls"):
    """Partial least squares directions of a single target from one pass of cross products.

    The data pass is distributed; what is solved on the driver is d x d. Returns frame -> frame.
    """
    d = int(train.select(F.size(embedding)).first()[0])
    s = cross_products(train.where(F.col(y).isNotNull()), embedding, y, d)
    n, mean = s[0, 0], s[0, 1:] / s[0, 0]
    cov = s[1:, 1:] - n * np.outer(mean, mean)
    xx, xy = cov[:d, :d], cov[:d, d].copy()
    weights = []
    basis: list[np.ndarray] = []
    for _ in range(k):
        w = xy / (np.linalg.norm(xy) or 1.0)
        load = xx @ w
        load = load - sum((v * (v @ load) for v in basis), np.zeros(d))
        norm = np.linalg.norm(load)
        if norm < 1e-12:
            break
        load /= norm
        basis.append(load)
        weights.append(w)
        xy = xy - load * (load @ xy)
    center = [float(v) for v in mean[:d]]

    def apply(df: DataFrame) -> DataFrame:
        x = F.col(embedding).cast("array<double>")
        zero = F.zip_with(x, F.lit(center), lambda a, b: a - b)
        scores = [F.aggregate(F.zip_with(zero, F.lit([float(v) for v in w]), lambda a, b: a * b),
                              F.lit(0.0), lambda acc, v: acc + v) for w in weights]
        return df.withColumn(out, F.array(*scores))

    apply.weights = np.array(weights)
    return apply


def valid_rows(df: DataFrame, cols) -> DataFrame:
    return df.dropna(subset=list(cols))


def city_weights(df: DataFrame, city: str = "city", name: str = "weight") -> DataFrame:
    """Weights that give every city the same total."""
    n = df.groupBy(city).agg(F.count(F.lit(1)).alias("__n"))
    return join_null_safe(df, n, [city]).withColumn(name, 1.0 / F.col("__n")).drop("__n")
