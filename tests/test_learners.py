"""Spark ML estimators against closed forms."""

import numpy as np
import pandas as pd
import pytest

from emipanel.operators import features, learners


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2)) * [2.0, 5.0] + [1.0, -3.0]
    y = np.expm1(np.maximum(0.1, 3 + 0.4 * x[:, 0] - 0.1 * x[:, 1] + rng.normal(0, 0.2, 300)))
    pdf = pd.DataFrame({"id": range(300), "a": x[:, 0], "b": x[:, 1], "y": y, "sector": np.where(x[:, 0] > 1, "hi", "lo")})
    return pdf, spark.createDataFrame(pdf).cache()


def standardised(pdf):
    x = pdf[["a", "b"]].to_numpy()
    return (x - x.mean(0)) / x.std(0), np.log1p(pdf.y.to_numpy())


def test_ridge_matches_the_usual_objective(frame):
    pdf, df = frame
    z, t = standardised(pdf)
    want = np.linalg.solve(z.T @ z + 1.0 * np.eye(2), z.T @ (t - t.mean()))
    got = learners.ridge(df, ["a", "b"], "y", alpha=1.0).model.coefficients.toArray()
    np.testing.assert_allclose(got, want, rtol=1e-4)
    ols = learners.ols(df, ["a", "b"], "y").model.coefficients.toArray()
    np.testing.assert_allclose(ols, np.linalg.lstsq(z, t - t.mean(), rcond=None)[0], rtol=1e-6)


def test_predictions_are_clipped_and_nulls_imputed(frame, spark):
    pdf, df = frame
    fitted = learners.ols(df, ["a", "b"], "y")
    wild = spark.createDataFrame([(1e6, None), (-1e6, 0.0), (None, None)], "a double, b double")
    got = [r["pred"] for r in fitted.predict(wild).collect()]
    assert got[0] == pytest.approx(2 * pdf.y.max()) and got[1] == 0.0 and 0 < got[2] < pdf.y.max()


def test_trees_importance_and_routing(frame):
    _, df = frame
    train, test = df.where("id < 220"), df.where("id >= 220")
    scores = learners.run_next_year(learners.random_forest, train, test, test, ["a", "b"], "y", "rf", numTrees=10, maxDepth=4)
    assert {r["split_type"]: r["r2"] > 0.5 for r in scores.collect()} == {"val": True, "test": True}
    imp = learners.permutation_importance(learners.ols(train, ["a", "b"], "y"), test, ["id"], "y", repeats=2)
    drops = {r["feature"]: r["r2_drop_mean"] for r in imp.collect()}
    assert drops["a"] > 0.1
    routed = learners.classify_then_regress(train, test, ["a", "b"], "sector", "y", params={"numTrees": 5, "maxDepth": 3})
    assert routed.count() == 80 and routed.where("pred is null").count() == 0


def test_random_search_is_reproducible(frame):
    _, df = frame
    space = {"alpha": [0.1, 1.0, 100.0]}
    assert learners.sample_configs(space, 4) == learners.sample_configs(space, 4)
    trials, best, final = learners.random_search(learners.ridge, space, 3, df.where("id < 200"), df.where("id >= 200"), df, ["a", "b"], "y")
    assert trials.where("is_best").count() == 1 and best["alpha"] in space["alpha"] and final.predict(df).count() == 300


def test_residual_stage_beats_its_first_stage(frame):
    _, df = frame
    from emipanel.operators.metrics import all_metrics
    both = all_metrics(learners.residual_stage(df, df, ["b"], ["a"], "y"), [], "y", "pred").first()["r2"]
    one = all_metrics(learners.ridge(df, ["b"], "y").predict(df), [], "y", "pred").first()["r2"]
    assert both > one


def test_pls_directions_match_the_dense_algorithm(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 6))
    y = x @ rng.normal(size=6) + rng.normal(size=200)
    df = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y)], "e array<double>, y double")
    w = features.fit_pls(df, "e", "y", 3).weights
    xc, yc = x - x.mean(0), y - y.mean()
    scores, resid, work = [], yc.copy(), xc.copy()
    for k in range(3):                       # NIPALS with deflation of X
        v = work.T @ resid
        t = work @ (v / np.linalg.norm(v))
        scores.append(t)
        work = work - np.outer(t, work.T @ t / (t @ t))
        resid = resid - t * (t @ resid) / (t @ t)
        assert abs(np.corrcoef(xc @ w[k], t)[0, 1]) == pytest.approx(1.0, abs=1e-6)


def test_tiers():
    assert features.forecast_features("core_all_cities")[-1] == "cdd_lag3"
    assert "annual_rh_mean" in features.FEATURE_SETS["core_all_cities_climate_plus"]
    assert features.cities_of("us_core")[0] == "nyc" and features.cities_of("core_all_cities") is None


def test_forests_do_not_depend_on_how_rows_are_split(spark):
    rows = spark.range(600).selectExpr("id", "cast(id % 37 as double) a", "cast(id % 11 as double) b", "cast(id % 37 * 3 + id % 11 as double) y")
    test = rows.where("id % 5 = 0")

    def predicted(n):
        fitted = learners.random_forest(rows.repartition(n), ["a", "b"], "y", numTrees=5, maxDepth=4)
        return sorted((r["id"], r["pred"]) for r in fitted.predict(test).select("id", "pred").collect())

    assert predicted(3) == predicted(13)


def test_permutation_importance_against_rotated_ranks(spark):
    import hashlib

    import numpy as np

    rows = [(i, float(i * 7 % 31), float(i * 5 % 13), float(i * 7 % 31 + 2 * (i * 5 % 13))) for i in range(1, 90)]
    df = spark.createDataFrame(rows + [(90, 1.0, 1.0, None)], "id long, a double, b double, y double")
    fitted = learners.ols(df, ["a", "b"], "y")
    got = {r["feature"]: (r["r2_drop_mean"], r["r2_drop_std"]) for r in learners.permutation_importance(fitted, df, ["id"], "y").collect()}
    order = sorted(rows, key=lambda r: (int(hashlib.md5(f"permute|{r[0]}".encode()).hexdigest()[:8], 16), r[0]))
    n, frames = len(order), []
    for at, name in ((1, "a"), (2, "b")):
        for rep in range(5):
            k = 1 + learners.rotation(name, rep) % (n - 1)
            for i, r in enumerate(order):
                x = list(r)
                x[at] = order[(i + k) % n][at]
                frames.append((f"{name}{rep}", *x[1:]))
    frames += [("base", *r[1:]) for r in rows]
    pred = fitted.predict(spark.createDataFrame(frames, "part string, a double, b double, y double")).toPandas()
    r2 = {part: 1 - ((g.y - g.pred) ** 2).sum() / ((g.y - g.y.mean()) ** 2).sum() for part, g in pred.groupby("part")}
    for name in "ab":
        drops = [r2["base"] - r2[f"{name}{i}"] for i in range(5)]
        assert np.allclose(got[name], (np.mean(drops), np.std(drops)))


def test_forests_keep_nodes_and_count_their_draws_when_rows_are_dealt(spark, frame):
    _, df = frame
    quick, slow = (learners.random_forest(df, ["a", "b"], "y", numTrees=5, maxDepth=4, cacheNodeIds=c).model for c in (True, False))
    assert quick.toDebugString.split("\n", 1)[1] == slow.toDebugString.split("\n", 1)[1]
    assert learners.random_forest(df, ["a", "b"], "y", numTrees=2, maxDepth=2).model.getCacheNodeIds()
    plain, forest = (learners.sized(df.select("a", "b"), 2_000_000, 6, n).rdd.getNumPartitions() for n in (0, 200))
    assert plain == learners.TRAINING_PARTS and 40 <= forest <= 60


def test_sector_forests_are_trained_once_for_both_routings(frame, monkeypatch):
    _, df = frame
    train, test = df.where("id < 220"), df.where("id >= 220")
    settings = {"numTrees": 4, "maxDepth": 3}

    def both(**kw):
        return [sorted((r["id"], r["sector_pred"], r["pred"]) for r in learners.classify_then_regress(
            train, test, ["a", "b"], "sector", "y", oracle=oracle, params=settings, **kw).collect()) for oracle in (False, True)]

    apart, fits, regress = both(), [], learners.random_forest
    monkeypatch.setattr(learners, "random_forest", lambda *a, **kw: fits.append(1) or regress(*a, **kw))
    assert both(trained=learners.SectorForests(train, ["a", "b"], "sector", "y", params=settings)) == apart
    assert len(fits) == 3  # all rows, and two sectors


def test_large_forests_lay_similar_rows_together_and_small_ones_stay(spark):
    df = spark.range(3000).selectExpr("cast(id * 7 % 101 as double) a", "cast(if(id % 9 = 0, null, id % 13) as double) b")
    near = learners.near_rows(["a", "b"], {"a": (50.0, 29.0), "b": (6.0, 3.7)})

    def parts(n_rows, near):
        return learners.sized(df, n_rows, 6, 200, near).rdd.glom().collect()

    def steps(r):
        return [np.floor(np.clip((m if x is None else x) / (d / 2) - m / (d / 2), -4, 3).round(9)) for x, m, d in ((r.a, 50.0, 29.0), (r.b, 6.0, 3.7))]

    large, plain = parts(1_000_000, near), parts(1_000_000, ())
    assert len(large) > learners.TRAINING_PARTS and list(map(sorted_rows, large)) == list(map(sorted_rows, plain))
    assert all([steps(r) for r in part] == sorted(steps(r) for r in part) for part in large)
    assert parts(3000, near) == parts(3000, ()) and large != plain


def sorted_rows(part):
    return sorted((r.a, -1.0 if r.b is None else r.b) for r in part)
