"""Linear models from moments: against numpy on the rows themselves, and an independent proximal solver."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cropframe.operators import linear_models as L
from cropframe.operators import modeling

FEATURES = ["a", "b", "c"]


def rows_of(seed, n=90, collinear=False):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        a, b = rnd.gauss(1000, 3), rnd.gauss(-2, 1)
        c = 2 * a - b + 1 if collinear else rnd.random() + 0.001 * a
        out.append(("x" if i % 3 else "y", 1900 + i, a, b, c, 3 + 0.5 * a - 2 * b + rnd.gauss(0, 1)))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "crop string, year long, a double, b double, c double, yield double").repartition(5)


def scaled(rows):
    x = np.array([r[2:5] for r in rows])
    y = np.array([r[5] for r in rows])
    sd = x.std(0)
    return (x - x.mean(0)) / np.where(sd > 0, sd, 1), y, x.mean(0), np.where(sd > 0, sd, 1)


def proximal(x, y, alpha, ratio, steps=200_000):
    """Elastic net by proximal gradient steps on the rows."""
    n, w = len(y), np.zeros(x.shape[1])
    step = 1 / (np.linalg.norm(x, 2) ** 2 / n + alpha * (1 - ratio))
    for _ in range(steps):
        g = x.T @ (x @ w - (y - y.mean())) / n + alpha * (1 - ratio) * w
        v = w - step * g
        new = np.sign(v) * np.maximum(np.abs(v) - step * alpha * ratio, 0)
        if np.abs(new - w).max() < 1e-13:
            break
        w = new
    return w


def test_moments_of_parts_merge_to_the_whole(spark):
    rows = rows_of(1)
    df = frame(spark, rows).withColumn("fold", F.col("year") % 4)
    got = {r.crop: r for r in L.merged(L.moments(df, FEATURES, "yield", ["crop", "fold"]), ["crop"]).collect()}
    for crop in "xy":
        v = np.array([r[2:] for r in rows if r[0] == crop])
        assert got[crop].n == len(v)
        assert np.allclose(got[crop].means, v.mean(0), rtol=1e-13)
        d = v - v.mean(0)
        assert np.allclose(got[crop].products, d.T @ d, rtol=1e-9, atol=1e-9)


def test_least_squares_equals_numpy(spark):
    rows = rows_of(2)
    df = frame(spark, rows)
    models = L.fit(L.moments(df, FEATURES, "yield", ["crop"]))
    pred = {(r.crop, r.year): r.prediction for r in L.predict(df, models, FEATURES, ["crop"]).collect()}
    for crop in "xy":
        own = [r for r in rows if r[0] == crop]
        x = np.column_stack([np.ones(len(own)), [r[2:5] for r in own]])
        beta, *_ = np.linalg.lstsq(x, np.array([r[5] for r in own]), rcond=None)
        assert np.allclose([pred[crop, r[1]] for r in own], x @ beta, atol=1e-7)


def test_collinear_and_constant_features_get_weight_zero(spark):
    rows = [(c, y, a, 7.0, 2 * a + 1, v) for c, y, a, _, _, v in rows_of(3)]
    m = L.fit(L.moments(frame(spark, rows), FEATURES, "yield", ["crop"])).collect()
    for r in m:
        assert r.weights[0] != 0 and r.weights[1] == 0 and r.weights[2] == 0


@pytest.mark.parametrize("alpha,ratio", [(1.0, 0.5), (0.01, 0.9), (10.0, 0.1), (0.0001, 0.1)])
def test_elastic_net_equals_proximal_gradient(spark, alpha, ratio):
    rows = [r for r in rows_of(4, 60) if r[0] == "x"]
    m = L.fit(L.moments(frame(spark, rows), FEATURES, "yield", ["crop"]), [("elastic_net", alpha, ratio)]).first()
    x, y, means, sd = scaled(rows)
    assert np.allclose(m.weights, proximal(x, y, alpha, ratio), atol=1e-8)
    assert np.allclose(m.means[:3], means) and np.allclose(m.scales, sd) and m.intercept == pytest.approx(y.mean())


def test_cross_validation_from_moments_equals_refitting_on_rows(spark):
    rows = rows_of(5)
    df = modeling.with_folds(frame(spark, rows), 5, 42, key=["year"], by=["crop"])
    penalties = [("linear", 0.0, 0.0), ("elastic_net", 0.5, 0.5)]
    got = {(r.crop, r.map): r for r in L.cross_validated(df, FEATURES, "yield", ["crop"], penalties).collect()}
    fold = {(r.crop, r.year): r.fold for r in df.collect()}
    for crop in "xy":
        own = [r for r in rows if r[0] == crop]
        for k, (_, alpha, ratio) in enumerate(penalties):
            scores = []
            for f in range(5):
                x, y, means, sd = scaled([r for r in own if fold[crop, r[1]] != f])
                w = proximal(x, y, alpha, ratio) if alpha else np.linalg.lstsq(x, y - y.mean(), rcond=None)[0]
                test = [r for r in own if fold[crop, r[1]] == f]
                t = np.array([r[5] for r in test])
                e = t - y.mean() - ((np.array([r[2:5] for r in test]) - means) / sd) @ w
                scores.append(1 - (e @ e) / ((t - t.mean()) ** 2).sum())
            assert got[crop, k].mean_r2 == pytest.approx(np.mean(scores), abs=1e-7)
            assert got[crop, k].std_r2 == pytest.approx(np.std(scores), abs=1e-7)


def test_contributions_add_up_to_the_prediction(spark):
    df = frame(spark, rows_of(6))
    models = L.fit(L.moments(df, FEATURES, "yield", ["crop"]))
    c = L.contributions(L.predict(df, models, FEATURES, ["crop"]).drop("model_type"), models, FEATURES, ["crop"])
    c = c.join(models.select("crop", "intercept"), "crop")
    worst = c.select(F.max(F.abs(F.col("prediction") - F.col("intercept") - sum(F.col(f"contrib_{f}") for f in FEATURES)))).first()[0]
    assert worst < 1e-9


def test_best_map_ties_go_to_the_first(spark):
    s = spark.createDataFrame([("x", 0, "e", 1.0, 0.5, 0.3), ("x", 1, "e", 2.0, 0.5, 0.3 + 1e-12), ("x", 2, "e", 3.0, 0.5, None),
                               ("z", 0, "e", 1.0, 0.5, None)],
                              "crop string, map int, model_type string, alpha double, l1_ratio double, mean_r2 double")
    assert [tuple(r) for r in L.best_of(s, ["crop"]).collect()] == [("x", 2, 0.3, "e", 1.0, 0.5)]


def test_null_rows_and_empty_frames(spark):
    rows = rows_of(7)
    more = rows + [("x", 3000, None, 1.0, 1.0, 1.0), ("x", 3001, 1.0, 1.0, 1.0, None), ("w", 3002, None, 1.0, 1.0, 1.0)]
    a = {r.crop: r.weights for r in L.fit(L.moments(frame(spark, rows), FEATURES, "yield", ["crop"])).collect()}
    b = {r.crop: r.weights for r in L.fit(L.moments(frame(spark, more), FEATURES, "yield", ["crop"])).collect()}
    assert set(a) == set(b) and all(np.allclose(a[c], b[c]) for c in a)
    empty = frame(spark, rows).limit(0).withColumn("fold", F.lit(0))
    assert L.cross_validated(empty, FEATURES, "yield", ["crop"]).count() == 0
