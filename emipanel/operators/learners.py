"""Spark ML estimators of the panel experiments: fit on log1p targets, predict in tonnes."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.ml import Estimator
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emipanel.functions.core import hash32
from emipanel.functions.numeric import clip_pred, log_target
from emipanel.operators.features import assemble, fit_index
from emipanel.operators.metrics import HIGHER_IS_BETTER, all_metrics, metric_columns
from emipanel.operators.skew import attach_row, rank_in_group
from emipanel.session import stable

# Default settings of the experiments.
RIDGE_ALPHA = 1.0
LASSO_ALPHA = 0.1
FOREST = {"numTrees": 200, "maxDepth": 10, "minInstancesPerNode": 5, "seed": 42}
#: Rows keep the node they stand in, tree by tree, instead of walking down all trees again for each level. The trees are the same.
FOREST_PASSES = {"cacheNodeIds": True, "checkpointInterval": -1}
#: Bytes a forest holds per training row and tree: how often the tree drew the row, and the node where the row stands.
DRAW_BYTES = 8
BOOSTED = {"maxIter": 300, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8, "minInstancesPerNode": 5,
           "seed": 42}
SECTOR_FOREST = {"numTrees": 100, "maxDepth": 8, "seed": 42}


@contextmanager
def persisted(*frames: DataFrame):
    """Keep frames that several fits read; their storage is given back afterwards."""
    kept = [f.persist() for f in frames]
    try:
        yield kept if len(kept) > 1 else kept[0]
    finally:
        for f in kept:
            f.unpersist()


#: Fewest partitions of training rows.
TRAINING_PARTS = 8


def sized(df: DataFrame, n_rows: int | None = None, n_cols: int | None = None, n_trees: int = 0, near=()) -> DataFrame:
    """Training rows in partitions of about 64 MB, dealt and ordered by a hash of the row: iterative training runs many passes,
    and each pays for every task. What ``n_trees`` trees of a forest hold per row counts as well. Which rows a tree draws depends
    on their partition and place, so both follow from the rows alone, not from the cluster or from how the input was split.
    Where more partitions are needed than the fewest, a partition's rows lie by ``near`` first (see near_rows)."""
    n_rows = df.count() if n_rows is None else n_rows
    n_cols = len(df.columns) if n_cols is None else n_cols
    wanted = -(-n_rows * (n_cols * 8 + n_trees * DRAW_BYTES) // (64 << 20))
    row = F.xxhash64(*[c for c in df.columns if not c.startswith("__near_")])
    order = [*near, row] if wanted > TRAINING_PARTS else [row]
    return df.repartition(int(max(wanted, TRAINING_PARTS)), row).sortWithinPartitions(*order)


def near_rows(cols, stats: dict) -> list:
    """Sort keys that put rows with similar features together, in steps of half a deviation up to two from the mean: they reach the same
    nodes of a forest, whose counts are then still in the processor's cache."""
    keys = []
    for c in cols:
        mean, dev = stats[c]
        steps = (F.coalesce(F.col(c).cast("double"), F.lit(mean)) - F.lit(mean)) / F.lit(dev / 2)
        keys.append(F.floor(F.greatest(F.least(steps, F.lit(3.0)), F.lit(-4.0))))
    return keys


class Fitted:
    """A fitted regressor with the preparation it was fitted with: frame -> frame with ``pred``.

    The preparation is a few numbers per feature (mean, deviation) and the largest training target, so
    prediction is a projection without joins.
    """

    def __init__(self, cols, stats: dict, scale: bool, log_space: bool, features: str = "features"):
        self.model, self.cols, self.stats, self.scale = None, list(cols), stats, scale
        self.log_space, self.features = log_space, features

    def prepare(self, df: DataFrame) -> DataFrame:
        names = {c: f"__x_{c}" for c in self.cols}
        new = {}
        for c, n in names.items():
            x = F.coalesce(F.col(c).cast("double"), F.lit(self.stats[c][0]))
            new[n] = (x - F.lit(self.stats[c][0])) / F.lit(self.stats[c][1]) if self.scale else x
        return assemble(df.withColumns(new), names.values(), self.features).drop(*names.values())

    def predict(self, df: DataFrame, pred: str = "pred") -> DataFrame:
        out = self.model.transform(self.prepare(df))
        value = clip_pred(F.expm1("prediction"), F.lit(self.stats["__top"])) if self.log_space else F.col("prediction")
        return out.withColumn(pred, value).drop("prediction", self.features)


def _training_stats(rows: DataFrame, cols, y: str) -> dict:
    """Mean and population deviation (after mean imputation, 0 becomes 1) per feature, largest target: one pass."""
    aggs = [F.max(F.col(y).cast("double")).alias("__top"), F.count(F.lit(1)).alias("__n")]
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"m_{c}"), F.stddev_pop(x).alias(f"s_{c}"), F.count(x).alias(f"n_{c}")]
    row = rows.agg(*aggs).first()
    stats = {"__top": row["__top"], "__n": row["__n"]}
    for c in cols:
        share = row[f"n_{c}"] / row["__n"] if row["__n"] else 0.0
        stats[c] = (row[f"m_{c}"] or 0.0, ((row[f"s_{c}"] or 0.0) * share ** 0.5) or 1.0)
    return stats


def fit_regressor(make, train: DataFrame, cols, y: str, log_space: bool = True, scale: bool = False,
                  val: DataFrame | None = None, n_trees: int = 0) -> Fitted:
    """Impute means, optionally standardise, fit ``make()`` on (log1p of) the target.

    With ``val`` its rows join the training frame marked as validation, for early stopping. ``n_trees``: trees that are grown at once.
    """
    cols = list(cols)
    need = [c for c in dict.fromkeys([*cols, y])]
    rows = train.where(F.col(y).isNotNull()).select(*need)
    with persisted(rows) as rows:
        fitted = Fitted(cols, _training_stats(rows, cols, y), scale, log_space)
        full = rows.withColumn("__val", F.lit(False))
        if val is not None:
            full = full.unionByName(val.where(F.col(y).isNotNull()).select(*need).withColumn("__val", F.lit(True)))
        data = fitted.prepare(full).withColumn("label", log_target(y) if log_space else F.col(y).cast("double"))
        keys = {f"__near_{i}": k for i, k in enumerate(near_rows(cols, fitted.stats))} if n_trees else {}
        data = sized(data.select("features", "label", "__val", *[k.alias(n) for n, k in keys.items()]), fitted.stats["__n"], len(cols) + 2,
                     n_trees, list(keys)).drop(*keys)
        with persisted(data) as data:
            fitted.model = make(data).fit(data)
    return fitted


def ols(train, cols, y, **kw) -> Fitted:
    return fit_regressor(lambda d: LinearRegression(standardization=False, solver="normal"), train, cols, y,
                         scale=True, **kw)


def ridge(train, cols, y, alpha: float = RIDGE_ALPHA, **kw) -> Fitted:
    """Usual ridge objective: Spark scales its penalty by the deviation of the label, which is undone here."""
    def make(data):
        row = data.agg(F.stddev_samp("label").alias("s"), F.count(F.lit(1)).alias("n")).first()
        return LinearRegression(standardization=False, solver="l-bfgs", elasticNetParam=0.0,
                                regParam=alpha * (row["s"] or 1.0) / row["n"], maxIter=200, tol=1e-10)

    return fit_regressor(make, train, cols, y, scale=True, **kw)


def lasso(train, cols, y, alpha: float = LASSO_ALPHA, **kw) -> Fitted:
    return fit_regressor(lambda d: LinearRegression(standardization=False, regParam=alpha, elasticNetParam=1.0,
                                                    maxIter=2000, tol=1e-8), train, cols, y, scale=True, **kw)


def random_forest(train, cols, y, log_space: bool = True, **params) -> Fitted:
    params = {**FOREST, **FOREST_PASSES, **params}
    return fit_regressor(lambda d: RandomForestRegressor(**params), train, cols, y, log_space, n_trees=params["numTrees"])


def gbt(train, cols, y, val: DataFrame | None = None, log_space: bool = True, **params) -> Fitted:
    def make(data):
        est = GBTRegressor(**{**BOOSTED, **params})
        return est.setValidationIndicatorCol("__val") if val is not None else est

    return fit_regressor(make, train, cols, y, log_space, val=val)


LEARNERS = {"ols": ols, "ridge": ridge, "lasso": lasso, "random_forest": random_forest, "gbt": gbt}


def estimator_fit(estimator: Estimator, train: DataFrame, cols, y: str, **kw) -> Fitted:
    """Plug-in point: any Spark ML regressor with features/label columns."""
    return fit_regressor(lambda d: estimator, train, cols, y, **kw)


class SectorForests:
    """What classify_then_regress trains: a forest of all rows, one per sector, and (once it is asked for) the classifier of sectors."""

    def __init__(self, train: DataFrame, cols, sector: str, y: str, min_rows: int = 5, params: dict | None = None):
        self.params, self.cols, self.sector, self.y = {**SECTOR_FOREST, **(params or {})}, list(cols), sector, y
        self.train = train.where((F.col(y) > 0) & F.col(sector).isNotNull()).select(*dict.fromkeys([*cols, sector, y]))
        self._classifier = None
        with persisted(self.train) as train:
            train = sized(train, n_trees=self._trees())
            self.fallback = random_forest(train, cols, y, **self.params)
            sizes = train.groupBy(sector).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows)
            self.names = [r[0] for r in sizes.orderBy(sector).collect()]
            with ThreadPoolExecutor(4) as pool:
                self.models = list(pool.map(lambda s: random_forest(train.where(F.col(sector) == s), cols, y, **self.params), self.names))

    def _trees(self) -> int:
        return RandomForestClassifier(**self.params).getNumTrees()

    def classify(self, df: DataFrame) -> DataFrame:
        """Rows with the predicted sector as sector_pred."""
        if self._classifier is None:
            with persisted(self.train) as train:
                train = sized(train, n_trees=self._trees(), near=near_rows(self.cols, self.fallback.stats))
                index = fit_index(train, self.sector, "label")
                with persisted(self.fallback.prepare(index.transform(train)).select("features", "label")) as ready:
                    clf = RandomForestClassifier(**{**FOREST_PASSES, **self.params}).fit(ready)
                self._classifier = clf, IndexToString(inputCol="prediction", outputCol="sector_pred", labels=index.labels)
        clf, back = self._classifier
        return back.transform(clf.transform(self.fallback.prepare(df))).drop("features", "rawPrediction", "probability", "prediction")


def classify_then_regress(train: DataFrame, test: DataFrame, cols, sector: str, y: str, oracle: bool = False,
                          min_rows: int = 5, params: dict | None = None, trained: SectorForests | None = None) -> DataFrame:
    """Predict the sector, then the target with that sector's forest; sectors under ``min_rows`` training
    rows use a forest of all rows. ``oracle`` takes the true sector instead of the predicted one. Only rows
    with a sector and a positive target are trained on. ``trained`` gives the forests of an earlier call with the same
    training rows, which are then not trained again. Routed rows are written once, as every forest reads its own."""
    trained = trained or SectorForests(train, cols, sector, y, min_rows, params)
    routed = stable(test.withColumn("sector_pred", F.col(sector)) if oracle else trained.classify(test))
    names = trained.names
    parts = [m.predict(routed.where(F.col("sector_pred") == s)) for s, m in zip(names, trained.models)]
    parts.append(trained.fallback.predict(routed.where(F.col("sector_pred").isNull() | ~F.col("sector_pred").isin(names))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run_next_year(learner, train: DataFrame, val: DataFrame, test: DataFrame, cols, y: str, model: str = "model",
                  **params) -> DataFrame:
    """Fit, predict, clip, and score on validation and test: one row per split."""
    fitted = learner(train, cols, y, **params)
    scores = None
    for name, part in (("val", val), ("test", test)):
        s = all_metrics(fitted.predict(part), [], y, "pred").select(F.lit(model).alias("model"),
                                                                    F.lit(name).alias("split_type"), "*")
        scores = s if scores is None else scores.unionByName(s)
    return scores


def run_multi_horizon(learner, train: DataFrame, test: DataFrame, cols, targets: dict, model: str = "model",
                      **params) -> DataFrame:
    """One model per horizon: (model, horizon, metrics). ``targets``: horizon -> target column."""
    out = None
    with persisted(train.select(*dict.fromkeys([*cols, *targets.values()]))) as train:
        train = sized(train)
        models = {h: learner(train, cols, y, **params) for h, y in targets.items()}
    for horizon, y in targets.items():
        s = all_metrics(models[horizon].predict(test.where(F.col(y).isNotNull())), [], y, "pred").select(
            F.lit(model).alias("model"), F.lit(int(horizon)).alias("horizon"), "*")
        out = s if out is None else out.unionByName(s)
    return out


def sample_configs(space: dict, n: int, seed: int = 42) -> list[dict]:
    """n settings drawn from lists of choices by hash, the same for a given seed."""
    import hashlib

    def pick(i, name, choices):
        h = int(hashlib.md5(f"{seed}|{i}|{name}".encode()).hexdigest()[:8], 16)
        return choices[h % len(choices)]

    return [{k: pick(i, k, v) for k, v in space.items()} for i in range(n)]


def random_search(learner, space: dict, n: int, train: DataFrame, val: DataFrame, test: DataFrame, cols, y: str,
                  metric: str = "r2", seed: int = 42) -> tuple[DataFrame, dict, Fitted]:
    """(trials, best setting, model refitted on train + val). Fits run a few at a time from the driver;
    each is a distributed job."""
    configs = sample_configs(space, n, seed)
    need = list(dict.fromkeys([*cols, y]))
    with persisted(train.select(*need), val.select(*need)) as (train, val):
        train, val = sized(train), sized(val)
        def trial(cfg):
            fitted = learner(train, cols, y, **cfg)
            return fitted.predict(val).where(F.col(y).isNotNull()).agg(*metric_columns(y, "pred")).first().asDict()

        with ThreadPoolExecutor(2) as pool:
            scores = list(pool.map(trial, configs))
        sign = -1 if metric in HIGHER_IS_BETTER else 1
        order = sorted(range(n), key=lambda i: (scores[i][metric] is None, sign * (scores[i][metric] or 0.0), i))
        best = configs[order[0]]
        final = learner(train.unionByName(val), cols, y, **best)
    rows = [(i, str(configs[i]), scores[i][metric], i == order[0]) for i in range(n)]
    trials = train.sparkSession.createDataFrame(rows, "trial int, config string, score double, is_best boolean")
    return trials, best, final


def residual_stage(train: DataFrame, test: DataFrame, base_cols, extra_cols, y: str, base=None, extra=None,
                   pred: str = "pred") -> DataFrame:
    """Fit on the tabular block, fit the remaining residual on the second block, add, clip."""
    first = (base or ridge)(train, base_cols, y)
    fitted = first.predict(train, "__base").withColumn("__resid", F.col(y) - F.col("__base"))
    second = (extra or ridge)(fitted, extra_cols, "__resid", log_space=False)
    out = second.predict(first.predict(test, "__base"), "__corr")
    value = clip_pred(F.col("__base") + F.col("__corr"), F.lit(first.stats["__top"]))
    return out.withColumn(pred, value).drop("__base", "__corr")


def rotation(feature: str, repeat: int) -> int:
    import hashlib

    return int(hashlib.md5(f"{feature}|{repeat}".encode()).hexdigest()[:8], 16)


def permutation_importance(fitted: Fitted, df: DataFrame, key, y: str, cols=None, repeats: int = 5) -> DataFrame:
    """Mean and deviation of the R2 lost when one feature is shuffled.

    Rows are ranked once, by a hash of their key. A repeat turns that order by an offset of its own (1 to n - 1): every row gets the
    feature of the row so many ranks further on, a random one as the order is random. All features and repeats are one join
    on the rank and one prediction.
    """
    from emipanel.operators.metrics import r2

    cols = list(cols or fitted.cols)
    need = [c for c in dict.fromkeys([*key, y, *fitted.cols])]
    rows = df.where(F.col(y).isNotNull()).select(*need)
    base = fitted.predict(rows).agg(r2(y, "pred").alias("r2_base"))
    ranked = rank_in_group(rows, [], hash32("permute", *key), key, "__r", "__n")
    moved = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(i).alias("repeat"), F.lit(rotation(c, i)).alias("__turn"),
                                         F.col(c).cast("double").alias("__value")) for c in cols for i in range(repeats)]))
    offset = 1 + F.col("__turn") % F.greatest(F.col("__n") - 1, F.lit(1))
    values = (ranked.select("__r", "__n", moved.alias("__m")).select("__r", "__n", "__m.*")
              .select((F.pmod(F.col("__r") - 1 - offset, F.col("__n")) + 1).alias("__r"), "feature", "repeat", "__value"))
    joined = values.join(ranked.select("__r", y, *fitted.cols), "__r").withColumns(
        {c: F.when(F.col("feature") == c, F.col("__value")).otherwise(F.col(c)) for c in cols})
    out = fitted.predict(joined.select("feature", "repeat", y, *fitted.cols)).groupBy("feature", "repeat").agg(r2(y, "pred").alias("r2"))
    drops = attach_row(out, base).withColumn("drop", F.col("r2_base") - F.col("r2"))
    return drops.groupBy("feature").agg(F.avg("drop").alias("r2_drop_mean"), F.stddev_pop("drop").alias("r2_drop_std"))
