"""Registered queries: yield models and climate scenarios (rows-only checks; brute-force tests in tests/)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cropframe.operators import integrate, modeling, registry, scenario
from cropframe.operators import linear_models as LM
from cropframe.plans import sql_models as SM
from cropframe.plans.q_climate import season_stats
from cropframe.plans.q_features import _station_crop
from cropframe.plans.q_integrate import _J4_SQL
from cropframe.plans.registry import register
from cropframe.session import materialize, scratch_path
from cropframe.sources import bindings as B

_FEATURES = ["growing_season_tmean_mean", "growing_season_tmax_max", "growing_season_tmin_min",
             "growing_season_ppt_total", "growing_degree_days_base10"]


def model_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State-grain integrated dataset (J4): census x season climate per state, year and crop.

    Materialised: every per-crop fit and CV fold rereads it, and it is small
    (one row per state x year x crop) whatever the size of the raw tables.
    """
    return materialize(integrate.crop_specific_merge(B.state_census(spark, sf_dir), season_stats(spark, sf_dir),
                                                     "state"))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


@register("yield_model_metrics", "M1,M2,M4,M5,M6,M8,M11,M15,P13", digits=6)
def q_yield_model_metrics(spark, sf_dir):
    """Per crop, RF / GBT / linear on an exact 80/20 split; mse, rmse, mae, r2, mape on the test rows."""
    df = model_dataset(spark, sf_dir).select("year", "state_code", "crop", "yield", *_FEATURES)
    _, metrics = modeling.train_crop_models(df, features=_FEATURES, min_rows=10)
    return metrics


@register("feature_importance", "M13", digits=6)
def q_feature_importance(spark, sf_dir):
    """Random-forest importances of every feature per crop, ranked."""
    df = model_dataset(spark, sf_dir).select("year", "state_code", "crop", "yield", *_FEATURES)
    models, _ = modeling.train_crop_models(df, features=_FEATURES, model_types=("random_forest",))
    rows = [(crop, name, float(v), rank + 1)
            for (crop, _mt), m in sorted(models.items())
            for rank, (name, v) in enumerate(modeling.feature_importance(m, _FEATURES))]
    return spark.createDataFrame(rows, "crop string, feature string, importance double, rank int")


# Linear models: fitted on moments, one read of the dataset -------------------------
_SOURCE = _J4_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """,
ds AS (SELECT year, state_code, crop, yield, """ + ", ".join(_FEATURES) + """ FROM j4)"""
_PLACED = SM.placed("ds", "CAST(year AS VARCHAR), state_code, crop")
#: Without the degree days, which full seasons give from the mean: elastic nets would share their weight.
_NET = _FEATURES[:4]
_MAPS = modeling.random_search_maps("elastic_net", n_iter=20, seed=42)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_dataset(spark, sf_dir).select("year", "state_code", "crop", "yield", *_FEATURES)


def _split_models(spark: SparkSession, sf_dir: str, features: list[str], penalties) -> tuple[DataFrame, DataFrame]:
    """Rows with ``is_test``, and one model per crop and penalty fitted on the other rows."""
    rows = modeling.exact_split(_rows(spark, sf_dir), 0.2, 42, by=["crop"])
    stats = LM.moments(rows.where(~F.col("is_test")), features, "yield", ["crop"])
    return rows, LM.fit(stats, penalties)


def _test_metrics(rows: DataFrame, models: DataFrame, features: list[str]) -> DataFrame:
    tested = LM.predict(rows.where("is_test"), models, features, ["crop"]).withColumnRenamed("yield", "label")
    return modeling.evaluate(tested, ["crop", "model_type"])


_OLS, _ELASTIC = ("linear", 0.0, 0.0), ("elastic_net", 1.0, 0.5)
_TRAIN_OLS = (_SOURCE + ",\n" + _PLACED + ",\n" + SM.scaled(f"(SELECT * FROM placed WHERE NOT ({SM.IS_TEST}))", "crop", _FEATURES, "yield", "st")
              + ",\n" + SM.least_squares("st", "crop", len(_FEATURES), "ols"))
_TRAIN_NET = (_SOURCE + ",\n" + _PLACED + ",\n" + SM.scaled(f"(SELECT * FROM placed WHERE NOT ({SM.IS_TEST}))", "crop", _NET, "yield", "st")
              + ",\n" + SM.elastic_net("st", "crop", len(_NET), "net", "0.5", "0.5"))


def _metrics_sql(train: str, model: str, kind: str, features: list[str]) -> str:
    return train + f""",
tested AS (SELECT p.crop, '{kind}' AS model_type, p.yield AS label, {SM.predicted([f"p.{x}" for x in features])} AS prediction
           FROM placed p JOIN {model} o ON p.crop = o.crop WHERE {SM.IS_TEST})
{SM.metrics()} FROM tested GROUP BY crop, model_type"""


@register("linear_model_metrics", "M2,M4,M8,M11", sql=_metrics_sql(_TRAIN_OLS, "ols", "linear", _FEATURES))
def q_linear_model_metrics(spark, sf_dir):
    """M8 + M11: least squares per crop on the exact 80/20 split; metrics of the held-out rows."""
    return _test_metrics(*_split_models(spark, sf_dir, _FEATURES, [_OLS]), _FEATURES)


@register("elastic_net_metrics", "M2,M4,M7,M11", sql=_metrics_sql(_TRAIN_NET, "net", "elastic_net", _NET))
def q_elastic_net_metrics(spark, sf_dir):
    """M7: elastic net (alpha 1.0, l1_ratio 0.5) per crop on standardised features, evaluated on the held-out rows."""
    return _test_metrics(*_split_models(spark, sf_dir, _NET, [_ELASTIC]), _NET)


_FOLDED = "folded AS (SELECT *, " + SM.FOLD + " AS fold FROM placed)"
_TRAIN_FOLDS = "(SELECT f.*, h.held_out FROM folded f JOIN (SELECT unnest(range(5)) AS held_out) h ON f.fold <> h.held_out)"


def _fold_scores_sql(model: str, features: list[str], extra: str = "") -> str:
    """CTE ``scored``: r2 of each crop and fold (and map)."""
    more = f", o.{extra}" if extra else ""
    return f"""scored AS (SELECT crop, held_out{", " + extra if extra else ""},
    CASE WHEN var_pop(y) > 0 THEN 1 - sum((y - yhat) ** 2) / (var_pop(y) * count(*)) END AS r2
  FROM (SELECT f.crop, o.held_out{more}, f.yield AS y, {SM.predicted([f"f.{x}" for x in features])} AS yhat
        FROM folded f JOIN {model} o ON f.crop = o.crop AND f.fold = o.held_out) GROUP BY ALL)"""


@register("cross_validation", "M9", sql=",\n".join([
    _SOURCE, _PLACED, _FOLDED, SM.scaled(_TRAIN_FOLDS, "crop, held_out", _FEATURES, "yield", "st"),
    SM.least_squares("st", "crop, held_out", len(_FEATURES), "ols"), _fold_scores_sql("ols", _FEATURES)]) + """
SELECT crop, round(avg(r2), 6) AS cv_r2, round(stddev_pop(r2), 6) AS cv_r2_std FROM scored GROUP BY crop""")
def q_cross_validation(spark, sf_dir):
    """M9: mean and deviation of the 5-fold cross-validated r2 of the linear model, per crop."""
    rows = modeling.with_folds(_rows(spark, sf_dir), 5, 42, by=["crop"])
    return LM.cross_validated(rows, _FEATURES, "yield", ["crop"], [_OLS]).select(
        "crop", F.col("mean_r2").alias("cv_r2"), F.col("std_r2").alias("cv_r2_std"))


_MAP_ROWS = ", ".join(f"({i}, CAST({m['alpha']} AS DOUBLE), CAST({m['l1_ratio']} AS DOUBLE))" for i, m in enumerate(_MAPS))


@register("random_search", "M10,M9,M7", sql=",\n".join([
    _SOURCE, _PLACED, _FOLDED, SM.scaled(_TRAIN_FOLDS, "crop, held_out", _NET, "yield", "st"),
    f"maps AS (SELECT * FROM (VALUES {_MAP_ROWS}) AS v(map, alpha, l1_ratio))",
    "tries AS (SELECT st.*, map, alpha * l1_ratio AS pen1, alpha * (1 - l1_ratio) AS pen2 FROM st, maps)",
    SM.elastic_net("tries", "crop, held_out", len(_NET), "net", "pen1", "pen2", extra="map"),
    _fold_scores_sql("net", _NET, "map"), "means AS (SELECT crop, map, avg(r2) AS r2 FROM scored GROUP BY crop, map)"]) + """
SELECT crop, CAST(count(*) OVER (PARTITION BY crop) AS INTEGER) AS n_maps, round(r2, 6) AS best_cv_r2, alpha, l1_ratio
FROM means JOIN maps USING (map) QUALIFY row_number() OVER (PARTITION BY crop ORDER BY round(r2, 9) DESC, map) = 1""")
def q_random_search(spark, sf_dir):
    """20 seeded draws per crop from the elastic net's space of 30, scored by 5-fold CV r2; best map and score."""
    rows = modeling.with_folds(_rows(spark, sf_dir), 5, 42, by=["crop"])
    scores = LM.cross_validated(rows, _NET, "yield", ["crop"], [("elastic_net", m["alpha"], m["l1_ratio"]) for m in _MAPS])
    return LM.best_of(scores, ["crop"]).drop("model_type")


@register("linear_contributions", "M14", sql=_TRAIN_OLS + "\nSELECT d.crop, " + ", ".join(
    f"round(avg(abs(o.w[{i}] * (d.{x} - o.m[{i}]) / o.s[{i}])), 6) AS mean_abs_{x}" for i, x in enumerate(_FEATURES, 1))
          + " FROM ds d JOIN ols o ON d.crop = o.crop GROUP BY d.crop")
def q_linear_contributions(spark, sf_dir):
    """Exact additive feature contributions of each crop's linear model, averaged per crop."""
    rows, models = _split_models(spark, sf_dir, _FEATURES, [_OLS])
    c = LM.contributions(rows, models, _FEATURES, ["crop"])
    return c.groupBy("crop").agg(*[F.avg(F.abs(F.col(f"contrib_{f}"))).alias(f"mean_abs_{f}") for f in _FEATURES])


# Scenarios: every crop, model and cell from the model table ------------------------
def _scenario_base(df: DataFrame, features: list[str] = _FEATURES) -> DataFrame:
    return df.groupBy("crop").agg(*[F.avg(c).alias(c) for c in features])


_COLUMNS = {"temperature": "growing_season_tmean_mean", "precipitation": "growing_season_ppt_total"}


def _cells_sql(steps_t: int, steps_p: int, p_lo: float, p_step: float) -> str:
    return (f"base AS (SELECT crop, {', '.join(f'avg({x}) AS {x}' for x in _FEATURES)} FROM ds GROUP BY crop),\n"
            f"cells AS (SELECT base.*, CAST(-2 + t.i AS DOUBLE) AS temp_change, CAST({p_lo} + p.i * {p_step} AS DOUBLE) AS precip_change\n"
            f"  FROM base, (SELECT unnest(range({steps_t})) AS i) t, (SELECT unnest(range({steps_p})) AS i) p)")


def _changed(**changes: str) -> list[str]:
    return [f"({changes[x]})" if x in changes else f"b.{x}" for x in _FEATURES]


_ADDITIVE = _changed(growing_season_tmean_mean="b.growing_season_tmean_mean + b.temp_change",
                     growing_season_ppt_total="b.growing_season_ppt_total * (1 + b.precip_change / 100)")
_CHANGE = """round((p - base_p) / nullif(base_p, 0) * 100, 6) AS pct_change,
  CASE WHEN (p - base_p) / nullif(base_p, 0) >= 0 THEN 'increase' WHEN (p - base_p) / nullif(base_p, 0) < 0 THEN 'decrease' END AS direction"""


@register("scenario_grid", "C2,C5,C6,J14,F18,F19", sql=_TRAIN_OLS + ",\n" + _cells_sql(8, 5, -20.0, 10.0) + f""",
scored AS (SELECT b.crop, b.temp_change, b.precip_change, {SM.predicted(_ADDITIVE)} AS p,
                  {SM.predicted([f"b.{x}" for x in _FEATURES])} AS base_p FROM cells b JOIN ols o ON b.crop = o.crop)
SELECT crop, temp_change, precip_change, round(p, 6) AS predicted_yield, round(base_p, 6) AS baseline_yield, {_CHANGE},
  printf('%+.1f degC', temp_change) || ' / ' || printf('%+.1f%%', precip_change) AS label FROM scored""")
def q_scenario_grid(spark, sf_dir):
    """C2 + C6: additive 8 x 5 grid around each crop's mean season, scored by its linear model."""
    rows, models = _split_models(spark, sf_dir, _FEATURES, [_OLS])
    base, models = _scenario_base(rows), materialize(models, "models")
    grid = scenario.score_grid(base, models, _FEATURES, ["crop"], **_COLUMNS)
    own = scenario.score_baseline(base, models, _FEATURES, ["crop"])
    out = scenario.change_vs_baseline(grid.drop("model_type"), own, ["crop"])
    return out.withColumn("label", F.concat_ws(" / ", scenario.signed_label(F.col("temp_change"), " degC"),
                                               scenario.signed_label(F.col("precip_change"), "%")))


@register("scenario_single", "C1,C5,C6", sql=_TRAIN_OLS + f""",
b AS (SELECT year, state_code, ds.*  EXCLUDE (year, state_code), 2.5 AS temp_change, -15.0 AS precip_change FROM ds),
scored AS (SELECT b.year, b.state_code, b.crop, {SM.predicted(_ADDITIVE)} AS p,
                  {SM.predicted([f"b.{x}" for x in _FEATURES])} AS base_p FROM b JOIN ols o ON b.crop = o.crop)
SELECT year, state_code, crop, round(p, 6) AS predicted_yield, round(base_p, 6) AS baseline_yield, {_CHANGE} FROM scored""")
def q_scenario_single(spark, sf_dir):
    """Every season of the dataset 2.5 degrees warmer and 15 % drier, against its own prediction."""
    rows, models = _split_models(spark, sf_dir, _FEATURES, [_OLS])
    keys, models = ["year", "state_code", "crop"], materialize(models, "models")
    changed = scenario.apply_scenario(rows, F.lit(2.5), F.lit(-15.0), **_COLUMNS)
    pred = LM.predict(changed, models, _FEATURES, ["crop"], "predicted_yield").select(*keys, "predicted_yield")
    own = LM.predict(rows, models, _FEATURES, ["crop"], "predicted_yield").select(*keys, "predicted_yield")
    return scenario.change_vs_baseline(pred, own, keys)


def _percent(features: list[str]) -> list[str]:
    return [f"(b.{x} * " + ("(1 + b.temp_change / 100)" if any(k in x for k in ("tmax", "tmin", "tmean"))
                            else "(1 + b.precip_change / 100)" if "ppt" in x else "1") + ")" for x in features]


@register("scenario_grid_percent", "C4", sql=_TRAIN_OLS + ",\n"
          + SM.scaled(f"(SELECT * FROM placed WHERE NOT ({SM.IS_TEST}))", "crop", _FEATURES, "yield", "st2") + ",\n"
          + SM.elastic_net("st2", "crop", len(_FEATURES), "net", "0.5", "0.5") + ",\n"
          + _cells_sql(8, 8, -30.0, 60.0 / 7) + f"""
SELECT b.crop, 'linear' AS model_type, b.temp_change, round(b.precip_change, 6) AS precip_change,
       round({SM.predicted(_percent(_FEATURES))}, 6) AS predicted_yield FROM cells b JOIN ols o ON b.crop = o.crop
UNION ALL SELECT b.crop, 'elastic_net', b.temp_change, round(b.precip_change, 6),
       round({SM.predicted(_percent(_FEATURES))}, 6) FROM cells b JOIN net o ON b.crop = o.crop""")
def q_scenario_grid_percent(spark, sf_dir):
    """C4: 8 x 8 percent grid (temperature-like and precipitation-like features scaled), crops x linear models."""
    rows, models = _split_models(spark, sf_dir, _FEATURES, [_OLS, _ELASTIC])
    return scenario.score_grid(_scenario_base(rows), models, _FEATURES, ["crop"], (-2.0, 5.0, 8), (-30.0, 30.0, 8),
                               mode="percent", features=_FEATURES)


@register("predict_latest_model", "S19,C5", sql=_TRAIN_OLS + f"""
SELECT d.year, d.state_code, d.crop, round({SM.predicted([f"d.{x}" for x in _FEATURES])}, 6) AS predicted_yield
FROM ds d JOIN ols o ON d.crop = o.crop""")
def q_predict_latest_model(spark, sf_dir):
    """S19 + C5: two versions are saved (all rows, then the training split); the newest one predicts every season."""
    root = scratch_path(spark, "registry")
    rows, models = _split_models(spark, sf_dir, _FEATURES, [_OLS])
    first = registry.save(LM.fit(LM.moments(rows, _FEATURES, "yield", ["crop"])), _FEATURES, root)
    registry.save(models, _FEATURES, root, version=first + 1)
    return registry.predict_latest(rows, root, _FEATURES).select("year", "state_code", "crop", "predicted_yield")


@register("scenario_grid_gdd", "C3,F16", digits=6)
def q_scenario_grid_gdd(spark, sf_dir):
    """Crops x models x 8 x 7 GDD-scaled cells on the station-feature models (GDD, precipitation, interaction)."""
    feats = ["AVG_GDD", "GROWING_SEASON_PRCP", "GDD_PRCP_INTERACTION"]
    df = materialize(integrate.engineer_yield_features(_station_crop(spark, sf_dir)).select(
        F.col("YEAR").alias("year"), F.col("CROP").alias("crop"), F.col("YIELD").alias("yield"), *feats))
    models, _ = modeling.train_crop_models(df, features=feats, min_rows=2)
    base = df.groupBy("crop").agg(*[F.avg(c).alias(c) for c in feats])
    parts = []
    for (crop, model_type), m in sorted(models.items()):
        grid = scenario.scenario_grid(base.filter(F.col("crop") == crop), (-2.0, 5.0, 8), (-30.0, 30.0, 7), mode="gdd",
                                      precipitation="GROWING_SEASON_PRCP", gdd="AVG_GDD",
                                      interaction=("AVG_GDD", "GROWING_SEASON_PRCP", "GDD_PRCP_INTERACTION"))
        parts.append(scenario.predict_grid(grid, m).select("crop", F.lit(model_type).alias("model_type"), "temp_change",
                                                           "precip_change", "predicted_yield"))
    return _union(parts)
