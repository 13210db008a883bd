"""Yield modelling on MLlib.

Training frames in this domain are small after aggregation (one row per crop x
year x state or county), so a driver loop over the handful of crops around
distributed ``fit`` calls is fine; nothing here collects feature data.
"""

from __future__ import annotations

import itertools
import math
import random
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import ElementwiseProduct, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cropframe.schema import feature_columns
from cropframe.session import materialize

MODEL_TYPES = ("random_forest", "gradient_boosting", "elastic_net", "linear")


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def _default_key(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.lower() in ("year", "state_code", "county_fips", "crop")]


def seeded_parts(df: DataFrame, ends, seed: int = 42, by: list[str] | None = None, key: list[str] | None = None,
                 digits: int = 3) -> DataFrame:
    """Adds ``part``: every group's rows in the order of a seeded hash of their key, cut at exact places.

    ``ends(n)`` gives, for a group of n rows, the rising numbers of rows after
    which a part ends; the rows behind the last one are the last part.

    No group is sorted in one task: rows are counted by the first ``digits``
    hexadecimal digits of their hash, a running sum over these (at most 16^digits a
    group) gives each bucket's place, and a bucket that lies within one part takes it
    as a whole. Only rows of buckets that a cut falls into are ranked.
    """
    by, key = list(by or []), key or _default_key(df)
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[_q(k).cast("string") for k in key]).cast("binary"))
    x = df.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, digits))
    counts = x.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    places = (counts.withColumn("_after", F.sum("_n").over(order)).withColumn("_before", F.col("_after") - F.col("_n"))
              .withColumn("_ends", ends(F.sum("_n").over(Window.partitionBy(*by)))).drop("_n"))

    def part(place: Column) -> Column:
        return F.size(F.filter("_ends", lambda e: e < place)).cast("int")

    x = x.join(places, [*by, "_b"]).withColumn("part", part(F.col("_before") + 1))
    whole = F.col("part") == part(F.col("_after"))
    rank = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", *[_q(k) for k in key]))
    cut = x.where(~whole).withColumn("_rank", rank).withColumn("part", part(F.col("_before") + F.col("_rank"))).drop("_rank")
    return x.where(whole).unionByName(cut).drop("_h", "_b", "_after", "_before", "_ends")


def exact_split(df: DataFrame, test_fraction: float = 0.2, seed: int = 42, by: list[str] | None = None,
                key: list[str] | None = None, digits: int = 3) -> DataFrame:
    """M2: adds ``is_test``: exactly ceil(fraction x n) rows per group, the ones with the smallest seeded hash."""
    x = seeded_parts(df, lambda n: F.array(F.ceil(n * test_fraction)), seed, by, key, digits)
    return x.withColumn("is_test", F.col("part") == 0).drop("part")


def modeling_frame(df: DataFrame, target: str = "yield", features: list[str] | None = None,
                   categorical: list[str] | None = None) -> tuple[DataFrame, list[str], list]:
    """M1 + M3 + P11/P12: feature list, and the stages that build the ``features`` vector.

    Numeric features default to P11's selection (target and identifiers out).
    Categorical columns are one-hot encoded (first level dropped, unknowns kept).
    """
    feats = features or feature_columns(df, target, prefer_standardized=False)
    stages: list = []
    vec_inputs = list(feats)
    for c in categorical or []:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}_idx", handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCol=f"{c}_idx", outputCol=f"{c}_ohe", dropLast=True, handleInvalid="keep"))
        vec_inputs.append(f"{c}_ohe")
    stages.append(VectorAssembler(inputCols=vec_inputs, outputCol="features", handleInvalid="skip"))
    return df.withColumn("label", _q(target).cast("double")), feats, stages


def elastic_penalty(alpha: float, l1_ratio: float, label_sd: float) -> tuple[float, float]:
    """M7: (regParam, elasticNetParam) whose objective is the textbook elastic net of ``alpha`` and ``l1_ratio``.

    MLlib fits the label divided by its population deviation, which leaves the L1
    share as given and divides the L2 share by that deviation.
    """
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio) * label_sd
    return l1 + l2, l1 / (l1 + l2) if l1 + l2 else 0.0


def regressor(model_type: str, seed: int = 42, label_sd: float = 1.0, **params):
    """M5-M8 with the reference's defaults.

    MLlib's limits: a forest without a depth limit stops at depth 30, and there
    is no minimum split size. Forests consider all features at every split.
    """
    if model_type == "random_forest":
        return RandomForestRegressor(featuresCol="features", labelCol="label", seed=seed,
                                     featureSubsetStrategy="all",
                                     numTrees=params.get("n_estimators", 100),
                                     maxDepth=min(params.get("max_depth") or 30, 30),
                                     minInstancesPerNode=params.get("min_samples_leaf", 1))
    if model_type == "gradient_boosting":
        return GBTRegressor(featuresCol="features", labelCol="label", seed=seed,
                            maxIter=params.get("n_estimators", 100), stepSize=params.get("learning_rate", 0.1),
                            maxDepth=params.get("max_depth", 3),
                            minInstancesPerNode=params.get("min_samples_leaf", 1))
    if model_type == "elastic_net":
        reg, ratio = elastic_penalty(params.get("alpha", 1.0), params.get("l1_ratio", 0.5), label_sd)
        return LinearRegression(featuresCol="scaled", labelCol="label", regParam=reg, elasticNetParam=ratio,
                                standardization=False, solver="normal", maxIter=1000, tol=1e-10)
    if model_type == "linear":
        return LinearRegression(featuresCol="scaled", labelCol="label", regParam=0.0, solver="normal")
    raise ValueError(f"unknown model type {model_type!r}; expected one of {MODEL_TYPES}")


def build_pipeline(stages: list, model_type: str, seed: int = 42, train: DataFrame | None = None, n_features: int = 0,
                   **params) -> Pipeline:
    """M4: linear models get a StandardScaler (with mean) in front; trees use raw features.

    The elastic net depends on the spread of its training label and on features
    scaled by the population deviation, so it takes the ``train`` rows and the
    number of features.
    """
    st, label_sd = list(stages), 1.0
    if model_type in ("elastic_net", "linear"):
        st.append(StandardScaler(inputCol="features", outputCol="sample_scaled" if model_type == "elastic_net" else "scaled",
                                 withMean=True, withStd=True))
    if model_type == "elastic_net":
        if train is None or not n_features:
            raise ValueError("an elastic net needs its training rows and number of features")
        n, sd = train.agg(F.count(F.lit(1)), F.stddev_pop("label")).first()
        label_sd = sd or 1.0
        st.append(ElementwiseProduct(inputCol="sample_scaled", outputCol="scaled",
                                     scalingVec=Vectors.dense([math.sqrt(n / max(1, n - 1))] * n_features)))
    st.append(regressor(model_type, seed, label_sd, **params))
    return Pipeline(stages=st)


def evaluate(pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mse, rmse, mae, r2, mape (as a fraction) per group, from one aggregate."""
    by = by or []
    e = F.col("label") - F.col("prediction")
    aggs = [F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
            F.avg(F.try_divide(F.abs(e), F.abs(F.col("label")))).alias("mape"),
            F.sum(e * e).alias("_sse"),
            (F.variance(F.col("label")) * (F.count(F.lit(1)) - 1)).alias("_sst"),
            F.count(F.lit(1)).alias("n")]
    g = pred.groupBy(*by).agg(*aggs) if by else pred.agg(*aggs)
    return (g.withColumn("rmse", F.sqrt("mse"))
            .withColumn("r2", F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.col("_sst")))
            .drop("_sse", "_sst"))


def with_folds(df: DataFrame, folds: int = 5, seed: int = 42, key: list[str] | None = None,
               by: list[str] | None = None) -> DataFrame:
    """Adds ``fold``, 0 to folds - 1: per group folds of equal size, the first n % folds of them one row longer."""
    def ends(n: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.lit(folds - 1)),
                           lambda i: i * F.floor(n / folds) + F.least(i, F.pmod(n, F.lit(folds))))

    return seeded_parts(df, ends, seed, by, key).withColumnRenamed("part", "fold")


def cross_validate(df: DataFrame, build, folds: int = 5, seed: int = 42, param_maps: list[dict] | None = None,
                   parallelism: int = 4) -> tuple[dict, list[float]]:
    """K-fold CV scored by r2; returns (best parameters, mean r2 per parameter map).

    ``build(train, params)`` gives the pipeline for one fold's training rows, so
    whatever depends on them (the elastic net's penalty) is set fold by fold.
    """
    ev = RegressionEvaluator(labelCol="label", predictionCol="prediction", metricName="r2")
    maps = param_maps or [{}]
    rows = with_folds(df, folds, seed).persist()
    parts = [f for (f,) in rows.select("fold").distinct().orderBy("fold").collect()]

    def score(job):
        params, f = job
        train = rows.filter(F.col("fold") != f)
        return ev.evaluate(build(train, params).fit(train).transform(rows.filter(F.col("fold") == f)))

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        found = list(pool.map(score, [(p, f) for p in maps for f in parts]))
    rows.unpersist()
    means = [sum(found[i * len(parts):(i + 1) * len(parts)]) / max(1, len(parts)) for i in range(len(maps))]
    return maps[max(range(len(maps)), key=lambda i: means[i])], means


#: M10, fixed values: the search spaces. MLlib has no minimum split size and stops at depth 30
#: (None and 40 fit as 30); both stay in the spaces.
SEARCH_SPACES = {
    "random_forest": {"n_estimators": [50, 100, 200, 300], "max_depth": [None, 10, 20, 30, 40],
                      "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 4]},
    "gradient_boosting": {"n_estimators": [50, 100, 200, 300], "learning_rate": [0.01, 0.05, 0.1, 0.2],
                          "max_depth": [3, 5, 7, 9], "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 4]},
    "elastic_net": {"alpha": [0.0001, 0.001, 0.01, 0.1, 1.0, 10.0], "l1_ratio": [0.1, 0.3, 0.5, 0.7, 0.9]},
}


def random_search_maps(model_type: str, n_iter: int = 20, seed: int = 42) -> list[dict]:
    """A seeded sample of ``n_iter`` parameter maps from the model's search space."""
    space = SEARCH_SPACES[model_type]
    maps = [dict(zip(space, values)) for values in itertools.product(*space.values())]
    return maps if len(maps) <= n_iter else random.Random(seed).sample(maps, n_iter)


def feature_importance(model: PipelineModel, names: list[str]) -> list[tuple[str, float]]:
    """(feature, importance) sorted desc; linear models report |coefficient|."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        vals = last.featureImportances.toArray().tolist()
    else:
        vals = [abs(v) for v in last.coefficients.toArray().tolist()]
    return sorted(zip(names, vals), key=lambda t: -t[1])


def linear_contributions(df: DataFrame, model: PipelineModel, names: list[str]) -> DataFrame:
    """Exact additive contributions of a linear model, coef_j x (x_j - mean_j) / std_j.

    Means and stds come from the fitted scaler, so this is a column expression
    per feature (no SHAP library, no driver loop over rows).
    """
    scaler = next(s for s in model.stages if hasattr(s, "mean") and hasattr(s, "std"))
    lin = model.stages[-1]
    mean, std = scaler.mean.toArray().tolist(), scaler.std.toArray().tolist()
    coef = lin.coefficients.toArray().tolist()
    cols = [(F.lit(c) * (_q(n) - F.lit(m)) / F.lit(s if s else 1.0)).alias(f"contrib_{n}")
            for n, c, m, s in zip(names, coef, mean, std)]
    return df.select("*", *cols)


def train_crop_models(df: DataFrame, crop_col: str = "crop", target: str = "yield",
                      model_types: tuple[str, ...] = ("random_forest", "gradient_boosting", "linear"),
                      features: list[str] | None = None, min_rows: int = 10, seed: int = 42,
                      crops: list[str] | None = None, parallelism: int = 8) -> tuple[dict, DataFrame]:
    """M15 + P13: per crop (with >= min_rows rows) and model type: split, fit, evaluate.

    Returns ({(crop, model_type): PipelineModel}, metrics DataFrame). The crop
    list is a fixed small dimension, so the loop is over crops, not rows.
    """
    framed, feats, stages = modeling_frame(df, target, features)
    split = materialize(exact_split(framed, 0.2, seed, by=[crop_col]))
    # Crops with fewer than ``min_rows`` rows are skipped (collects one row per crop)
    sizes = {r[0]: r[1] for r in split.groupBy(crop_col).count().collect()}
    eligible = crops or sorted(c for c, n in sizes.items() if n >= min_rows)
    jobs = [(crop, mt) for crop in eligible for mt in model_types]

    def fit(job):
        crop, mt = job
        part = split.filter(_q(crop_col) == crop)
        train = part.filter(~F.col("is_test"))
        m = build_pipeline(stages, mt, seed, train, len(feats)).fit(train)
        pred = m.transform(part.filter(F.col("is_test"))).select(
            F.lit(crop).alias(crop_col), F.lit(mt).alias("model_type"), "label", "prediction")
        return job, m, pred

    # independent fits are submitted concurrently (as CrossValidator does with ``parallelism``)
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(jobs)))) as pool:
        results = list(pool.map(fit, jobs))
    models = {job: m for job, m, _ in results}
    preds = [p for _, _, p in results]
    if not preds:
        schema = f"{crop_col} string, model_type string, mse double, mae double, mape double, n bigint, " \
                 "rmse double, r2 double"
        return models, df.sparkSession.createDataFrame([], schema)
    allp = preds[0]
    for p in preds[1:]:
        allp = allp.unionByName(p)
    return models, evaluate(allp, [crop_col, "model_type"])


def save_model(model: PipelineModel, path: str) -> None:
    """MLlib persistence (overwrite)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
