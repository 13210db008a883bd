"""Correlation safety, OLS closed form vs MLlib, exact split, contributions, scenario grid properties."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cropframe.operators import analysis as AN
from cropframe.operators import modeling, scenario


def test_safe_corr_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, None)], "a double, b double")
    m = {(r.var1, r.var2): r.corr for r in AN.correlation_matrix(df, ["a", "b"]).collect()}
    assert m[("a", "b")] is None and m[("b", "b")] == pytest.approx(1.0)


def test_linear_model_matches_closed_form(spark):
    rows = [(float(x), 3.0 + 2.0 * x + (0.5 if x % 2 else -0.5)) for x in range(10)]
    df = spark.createDataFrame(rows, "x double, y double")
    framed, feats, stages = modeling.modeling_frame(df, "y", ["x"])
    model = modeling.build_pipeline(stages, "linear").fit(framed)
    pred = model.transform(framed)
    tl = AN.trend_lines(df, "x", "y").first()
    closed = pred.select(F.max(F.abs(F.col("prediction") - (tl.intercept + tl.slope * F.col("x"))))).first()[0]
    assert closed < 1e-8


def test_exact_split_sizes(spark):
    df = spark.createDataFrame([(c, y, float(y)) for c in ("A", "B") for y in range(1990, 1990 + (7 if c == "A" else 5))],
                               "crop string, year int, yield double")
    s = modeling.exact_split(df, 0.2, 42, by=["crop"])
    got = {r.crop: r.n for r in s.filter("is_test").groupBy("crop").agg(F.count("*").alias("n")).collect()}
    assert got == {"A": 2, "B": 1}  # ceil(0.2 * 7) = 2, ceil(0.2 * 5) = 1


def test_linear_contributions_sum_to_prediction(spark):
    rows = [(float(i), float(i % 3), 1.0 + 2 * i - 3 * (i % 3)) for i in range(12)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    framed, feats, stages = modeling.modeling_frame(df, "y", ["a", "b"])
    m = modeling.build_pipeline(stages, "linear").fit(framed)
    c = modeling.linear_contributions(m.transform(framed), m, feats)
    lin = m.stages[-1]
    diffs = c.select((F.col("prediction") - F.lit(lin.intercept) - F.col("contrib_a") - F.col("contrib_b"))
                     .alias("d")).collect()
    assert max(abs(r.d) for r in diffs) < 1e-8


def test_scenario_grid_zero_cell_is_baseline(spark):
    base = spark.createDataFrame([("CORN", 20.0, 500.0)], "crop string, temperature double, precipitation double")
    g = scenario.scenario_grid(base, (-2.0, 5.0, 8), (-20.0, 20.0, 5))
    assert g.count() == 40
    z = g.filter((F.col("temp_change") == 0) & (F.col("precip_change") == 0)).collect()
    assert len(z) == 1 and z[0].temperature == 20.0 and z[0].precipitation == 500.0
    t = sorted({r.temp_change for r in g.collect()})
    assert t[0] == -2.0 and t[-1] == 5.0 and len(t) == 8


def test_signed_label(spark):
    df = spark.createDataFrame([(1.0,), (-2.0,), (0.0,)], "x double")
    got = [r[0] for r in df.select(scenario.signed_label(F.col("x"), "%")).collect()]
    assert got == ["+1.0%", "-2.0%", "+0.0%"]


def test_percent_grid_leaves_axes_and_other_columns(spark):
    base = spark.createDataFrame([("A", 10.0, 100.0, 5.0)], "crop string, tmean double, ppt_total double, gdd double")
    rows = scenario.scenario_grid(base, (-2.0, 5.0, 8), (-30.0, 30.0, 8), mode="percent").collect()
    assert len(rows) == 64
    assert sorted({round(r.temp_change, 9) for r in rows}) == [float(x) for x in range(-2, 6)]
    for r in rows:
        assert abs(r.tmean - 10.0 * (1 + r.temp_change / 100)) < 1e-12 and r.gdd == 5.0
        assert abs(r.ppt_total - 100.0 * (1 + r.precip_change / 100)) < 1e-12


def test_baseline_needs_no_zero_cell(spark):
    pred = spark.createDataFrame([("A", -1.0, 50.0), ("A", 1.0, 200.0), ("A", 2.0, 100.0)],
                                 "crop string, temp_change double, predicted_yield double")
    base = spark.createDataFrame([("A", 100.0)], "crop string, predicted_yield double")
    got = {r.temp_change: (r.pct_change, r.direction) for r in scenario.change_vs_baseline(pred, base, ["crop"]).collect()}
    assert got == {-1.0: (-50.0, "decrease"), 1.0: (100.0, "increase"), 2.0: (0.0, "increase")}
    with pytest.raises(ValueError):
        scenario.change_vs_baseline(pred, base, [])


def test_random_search_draws_from_the_whole_space():
    for name, size in (("random_forest", 180), ("gradient_boosting", 576), ("elastic_net", 30)):
        space = modeling.SEARCH_SPACES[name]
        assert math.prod(map(len, space.values())) == size
        maps = modeling.random_search_maps(name, 20, 42)
        assert maps == modeling.random_search_maps(name, 20, 42) and len(maps) == 20 < size
        assert all(m[k] in space[k] for m in maps for k in space)


def test_elastic_net_closed_form_on_one_feature(spark):
    rnd = random.Random(3)
    x = [rnd.gauss(5, 2) for _ in range(60)]
    y = [3 * a + rnd.gauss(0, 4) + 7 for a in x]
    df = spark.createDataFrame(list(zip(x, y)), "x double, y double")
    framed, feats, stages = modeling.modeling_frame(df, "y", ["x"])
    for alpha, ratio in ((1.0, 0.5), (0.1, 0.9), (10.0, 0.1)):
        pipe = modeling.build_pipeline(stages, "elastic_net", train=framed, n_features=1, alpha=alpha, l1_ratio=ratio)
        got = pipe.fit(framed).stages[-1].coefficients[0]
        mx, my = sum(x) / 60, sum(y) / 60
        sd = math.sqrt(sum((a - mx) ** 2 for a in x) / 60)
        rho = sum((a - mx) / sd * (b - my) for a, b in zip(x, y)) / 60
        want = math.copysign(max(abs(rho) - alpha * ratio, 0.0), rho) / (1 + alpha * (1 - ratio))
        assert abs(got - want) < 1e-6


def test_forest_considers_all_features():
    assert modeling.regressor("random_forest").getFeatureSubsetStrategy() == "all"


def test_cross_validation_covers_every_row_once(spark):
    rows = [(2000 + i, float(i % 7), 2.0 * (i % 7) + 1 + (i % 3) * 0.01) for i in range(60)]
    framed, _, stages = modeling.modeling_frame(spark.createDataFrame(rows, "year int, x double, y double"), "y", ["x"])
    assert {r.fold for r in modeling.with_folds(framed).collect()} == set(range(5))
    best, means = modeling.cross_validate(framed, lambda train, params: modeling.build_pipeline(stages, "linear"))
    assert best == {} and len(means) == 1 and means[0] > 0.99


def test_exact_split_equals_sort_based_selection(spark):
    from pyspark.sql import Window
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("crop"), F.col("id").alias("year"))
    for digits in (1, 2, 4):
        got = modeling.exact_split(df, 0.2, 7, by=["crop"], key=["year"], digits=digits)
        h = F.md5(F.concat(F.lit("7|"), F.col("year").cast("string")).cast("binary"))
        ref = df.withColumn("r", F.row_number().over(Window.partitionBy("crop").orderBy(h, "year"))) \
                .withColumn("n", F.count("*").over(Window.partitionBy("crop"))) \
                .withColumn("ref", F.col("r") <= F.ceil(F.col("n") * 0.2))
        cmp = got.join(ref.select("crop", "year", "ref"), ["crop", "year"])
        assert cmp.filter(F.col("is_test") != F.col("ref")).count() == 0
        assert got.count() == 1000


def test_folds_are_exact_and_of_equal_size(spark):
    df = spark.range(137).select((F.col("id") % 2).alias("crop"), F.col("id").alias("year"))
    got = modeling.with_folds(df, 5, 3, key=["year"], by=["crop"]).groupBy("crop", "fold").count().collect()
    assert {(r["crop"], r["fold"]): r["count"] for r in got} == {
        **{(0, f): 14 if f < 4 else 13 for f in range(5)}, **{(1, f): 14 if f < 3 else 13 for f in range(5)}}
    again = modeling.with_folds(df.repartition(7), 5, 3, key=["year"], by=["crop"])
    assert modeling.with_folds(df, 5, 3, key=["year"], by=["crop"]).exceptAll(again).count() == 0
    assert modeling.with_folds(df.limit(3), 5, 3, key=["year"]).select("fold").distinct().count() == 3
    assert modeling.with_folds(df.limit(0), 5).count() == 0
