"""What-if climate scenarios.

A scenario grid is generated by exploding two ``sequence`` axes on the base
rows (a generator, not a join), transformed with column expressions, and
scored by one batch ``model.transform``.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropframe.operators import linear_models


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def linspace(lo: float, hi: float, n: int) -> Column:
    """array of n evenly spaced values, both ends included."""
    if n == 1:
        return F.array(F.lit(float(lo)))
    step = (hi - lo) / (n - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(lo)) + i * F.lit(step))


def signed_label(x: Column, unit: str = "%") -> Column:
    """'+1.0%' / '-2.0 degC' style labels."""
    return F.format_string("%+.1f" + unit.replace("%", "%%"), x)


AXES = ("temp_change", "precip_change")


def apply_scenario(df: DataFrame, dt: Column, dp: Column, mode: str = "additive",
                   temperature: str = "temperature", precipitation: str = "precipitation",
                   gdd: str = "AVG_GDD", interaction: tuple[str, str, str] | None = None,
                   features: list[str] | None = None) -> DataFrame:
    """C1/C3/C4 transforms, each computed in one projection from the untouched columns.

    additive: temperature += dT, precipitation *= (1 + dP/100)
    gdd:      gdd *= (1 + dT/20), precipitation *= (1 + dP/100), interaction recomputed
    percent:  of ``features`` (all columns but the scenario axes), those named like a
              temperature *= (1 + dT/100), those named like precipitation *= (1 + dP/100)
    """
    pf = F.lit(1.0) + dp / 100
    if mode == "additive":
        changed = {temperature: _q(temperature) + dt, precipitation: _q(precipitation) * pf}
    elif mode == "gdd":
        changed = {gdd: _q(gdd) * (F.lit(1.0) + dt / 20), precipitation: _q(precipitation) * pf}
        if interaction:
            a, b, name = interaction
            changed[name] = changed.get(a, _q(a)) * changed.get(b, _q(b))
    elif mode == "percent":
        changed = {}
        for c in features if features is not None else [c for c in df.columns if c not in AXES]:
            low, value = c.lower(), _q(c)
            if any(k in low for k in ("temp", "tmax", "tmin", "tmean")):
                value = value * (F.lit(1.0) + dt / 100)
            if any(k in low for k in ("prec", "prcp", "ppt")):
                value = value * pf
            changed[c] = value
    else:
        raise ValueError(f"unknown scenario mode {mode!r}")
    return df.select(*[changed.get(c, _q(c)).alias(c) for c in df.columns],
                     *[v.alias(c) for c, v in changed.items() if c not in df.columns])


def scenario_grid(base: DataFrame, t_range: tuple[float, float, int] = (-2.0, 5.0, 8),
                  p_range: tuple[float, float, int] = (-20.0, 20.0, 5), mode: str = "additive",
                  **kw) -> DataFrame:
    """J14 + C2-C4: base rows x temperature steps x precipitation steps, transformed.

    Defaults are the additive grid (8 x 5). The axes are generated per base row
    with ``explode``; base rows are few (one per crop / model), so the output is
    base x nT x nP rows with no join.
    """
    g = (base.select("*", F.explode(linspace(*t_range)).alias("temp_change"))
         .select("*", F.explode(linspace(*p_range)).alias("precip_change")))
    return apply_scenario(g, F.col("temp_change"), F.col("precip_change"), mode, **kw)


def score_grid(base: DataFrame, models: DataFrame, inputs: list[str], by: list[str], t_range=(-2.0, 5.0, 8),
               p_range=(-20.0, 20.0, 5), mode: str = "additive", **kw) -> DataFrame:
    """C1-C4 from a table of linear models: every base row, model of its group and cell in one join and projection.

    ``inputs``: the models' features. Returns ``by``, model_type, the two axes and predicted_yield.
    """
    grid = scenario_grid(base, t_range, p_range, mode, **kw)
    return linear_models.predict(grid, models, inputs, by, "predicted_yield").select(
        *by, "model_type", *AXES, "predicted_yield")


def score_baseline(base: DataFrame, models: DataFrame, features: list[str], by: list[str]) -> DataFrame:
    """C5 on a table of linear models: the base rows as they are."""
    return linear_models.predict(base, models, features, by, "predicted_yield").select(*by, "model_type", "predicted_yield")


def predict_grid(grid: DataFrame, model: PipelineModel) -> DataFrame:
    """One batch transform for the whole grid; rows the model cannot score keep NULL."""
    return model.transform(grid).withColumnRenamed("prediction", "predicted_yield")


def change_vs_baseline(pred: DataFrame, baseline: DataFrame, keys: list[str],
                       value: str = "predicted_yield") -> DataFrame:
    """Percent change against the baseline prediction of the same keys, and its direction.

    ``baseline`` holds the base rows scored with zero deltas, so a grid needs no
    cell of zero change. No change counts as an increase.
    """
    if not keys:
        raise ValueError("change_vs_baseline needs the keys that name a base row")
    out = pred.join(baseline.select(*keys, _q(value).alias("baseline_yield")), keys, "left")
    pct = F.try_divide(_q(value) - F.col("baseline_yield"), F.col("baseline_yield")) * 100
    return (out.withColumn("pct_change", pct)
            .withColumn("direction", F.when(pct >= 0, "increase").when(pct < 0, "decrease")))


def predict_scenario(base: DataFrame, model: PipelineModel, dt: float = 0.0, dp: float = 0.0,
                     mode: str = "additive", required: list[str] | None = None, **kw) -> DataFrame:
    """Score one (or a few) feature rows under one scenario (C5 = zero deltas).

    Missing base features raise (the reference returns an error string, D13).
    """
    missing = [c for c in (required or []) if c not in base.columns]
    if missing:
        raise ValueError(f"base scenario is missing features {missing}")
    sc = apply_scenario(base, F.lit(float(dt)), F.lit(float(dp)), mode, **kw)
    return model.transform(sc).withColumnRenamed("prediction", "predicted_yield")


def grid_table(pred: DataFrame, value: str = "predicted_yield", by: list[str] | None = None) -> DataFrame:
    """Wide table, rows = signed temperature labels, columns = signed precipitation labels."""
    by = by or []
    lab = pred.select(*by, signed_label(F.col("temp_change"), " degC").alias("temperature_change"),
                      F.col("temp_change"), signed_label(F.col("precip_change"), "%").alias("precip_label"), _q(value))
    return (lab.groupBy(*by, "temp_change", "temperature_change").pivot("precip_label").agg(F.avg(_q(value)))
            .orderBy(*by, "temp_change"))
